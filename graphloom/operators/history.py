"""Change history: file histories, co-change, hotspots, ownership, bus factor, rename chains.

Nulls in paths, authors or commits are values of their own in counts and never join; no changes give no rows, except where a total of one row is asked for (zero or null, as each says).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed


def file_history(changes: DataFrame) -> DataFrame:
    """A5: per ``path`` of ``changes(path, author, ts, added, deleted)``: changes (rows, not distinct commits), sums, authors, first and last time."""
    return changes.groupBy("path").agg(
        F.count("*").alias("commits"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.countDistinct("author").alias("authors"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def binary_change(changes: DataFrame) -> DataFrame:
    """Rows with ``is_binary``: nothing added or deleted, and no old path."""
    return changes.withColumn("is_binary", (F.col("added") == 0) & (F.col("deleted") == 0) & F.col("old_path").isNull())


def history_filter(changes: DataFrame, suffixes: Sequence[str], excludes: Sequence[str]) -> DataFrame:
    """Changes to files of the given suffixes, without excluded substrings; commits left empty vanish with their rows."""
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    for x in excludes:
        keep = keep & ~F.col("path").contains(x)
    return changes.where(keep)


def change_coupling(changes: DataFrame, max_files: int = 30, min_support: int = 5, min_confidence: float = 0.3) -> DataFrame:
    """Unordered pairs of paths that change in one commit.

    Commits of more than ``max_files`` distinct files are left out before anything is counted, which also bounds the
    pairs a commit gives. ``confidence`` is the larger of support over either file's commits, ``jaccard`` over their union.
    """
    touched = changes.select("commit", "path").distinct()
    size = touched.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= max_files).select("commit")
    small = touched.join(size, "commit", "left_semi")
    commits = small.groupBy("path").agg(F.count("*").alias("c"))
    gathered = small.groupBy("commit").agg(F.sort_array(F.collect_list("path")).alias("ps"))  # at most max_files each
    pairs = gathered.select(F.posexplode("ps").alias("i", "a"), "ps").select("a", F.explode(F.expr("slice(ps, i + 2, size(ps))")).alias("b"))
    support = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    both = support.join(commits.select(F.col("path").alias("a"), F.col("c").alias("ca")), "a").join(commits.select(F.col("path").alias("b"), F.col("c").alias("cb")), "b")
    confidence = F.col("support") / F.least("ca", "cb")
    jaccard = F.col("support") / (F.col("ca") + F.col("cb") - F.col("support"))
    return both.select("a", "b", "support", confidence.alias("confidence"), jaccard.alias("jaccard")).where(F.col("confidence") >= min_confidence)


def sum_of_coupling(coupling: DataFrame) -> DataFrame:
    """Support summed over both ends."""
    ends = coupling.select(F.explode(F.array("a", "b")).alias("path"), "support")
    return ends.groupBy("path").agg(F.sum("support").alias("soc"))


def hotspots(history: DataFrame, complexity: DataFrame, limit: int | None = None) -> DataFrame:
    """(commits / most) * (complexity / most) over the paths of both; a maximum of 0 counts as 1."""
    both = history.select("path", "commits").join(complexity.select("path", "complexity"), "path")
    most = both.agg(F.max("commits").alias("mc"), F.max("complexity").alias("mx"))
    unit = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    scored = both.crossJoin(F.broadcast(most)).select("path", "commits", "complexity", ((F.col("commits") / unit("mc")) * (F.col("complexity") / unit("mx"))).alias("score"))
    ranked = scored.orderBy(F.desc("score"), "path")
    return ranked if limit is None else ranked.limit(limit)


def ownership(changes: DataFrame, minor: float = 0.05) -> DataFrame:
    """Top author (ties: least name), their share, number of authors, minor authors, orphaned (top share under a half)."""
    by = changes.groupBy("path", "author").agg(F.count("*").alias("n"))
    shares = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("path")))
    return shares.groupBy("path").agg(
        F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("top_author"),
        F.max("share").alias("top_share"),
        F.count("*").alias("authors"),
        F.count_if(F.col("share") < minor).alias("minors"),
        (F.max("share") < 0.5).alias("orphaned"),
    )


def bus_factor(owned: DataFrame) -> DataFrame:
    """The fewest top authors that cover more than half of the files; 0 without files.

    Authors are counted by their number of files and never ranked one by one: what a task orders is a row for each such number,
    of which there are the square root of twice the files at most.
    """
    per = owned.groupBy("top_author").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("authors"))
    down = Window.orderBy(F.desc("n"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    steps = per.select("n", "authors", F.coalesce(F.sum("authors").over(before), F.lit(0)).alias("r"), F.coalesce(F.sum(F.col("n") * F.col("authors")).over(before), F.lit(0)).alias("covered"), F.sum(F.col("n") * F.col("authors")).over(Window.partitionBy()).alias("total"))
    more = F.floor((F.col("total") - 2 * F.col("covered")) / (2 * F.col("n"))) + 1  # of this number, until over half are covered
    return steps.where((F.col("covered") * 2 <= F.col("total")) & (more <= F.col("authors"))).agg(F.coalesce(F.min(F.col("r") + more), F.lit(0)).cast("long").alias("bus_factor"))


def rename_chain(renames: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``renames(old, new)`` followed to the end by pointer jumping: (old, last, steps). A chain that comes back to a name it has had stops there.

    Jumps double, so the rounds are the logarithm of the longest chain; names on a ring never reach an end and keep
    the least name of the ring.
    """
    jump = checkpointed(renames.select("old", F.col("new").alias("last"), F.lit(1).cast("long").alias("steps"), F.col("new").alias("low")))
    for _ in range(max_rounds):
        ahead = jump.select(F.col("old").alias("last"), F.col("last").alias("l2"), F.col("steps").alias("s2"), F.col("low").alias("w2"))
        jump = checkpointed(
            jump.join(ahead, "last", "left").select("old", F.coalesce("l2", "last").alias("last"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.least("low", F.coalesce("w2", "low")).alias("low"), F.col("l2").isNotNull().alias("open"))
        )
        if jump.where("open").limit(1).count() == 0:
            break
        if jump.where("open and steps <= 1000000").limit(1).count() == 0:  # what is left goes round
            break
        jump = jump.drop("open")
    return jump.select("old", F.when(F.col("open"), F.col("low")).otherwise(F.col("last")).alias("last"), F.when(F.col("open"), F.lit(None)).otherwise(F.col("steps")).alias("steps"))
