"""Readers of trees, logs, diffs, decisions, baselines and index files (S1-S4, S6-S14, S17, S18d, S19, F31, F40)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.gate import matches_any

#: Folders that a source scan passes over.
SKIPPED = (".git", "node_modules", "dist", "build", "target", "vendor", "third_party", "site-packages", "__pycache__", ".venv", "venv", ".tox")
SUFFIXES = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".swift": "swift"}
#: Fixed field and record separators of the log format that ``parse_log`` reads.
RECORD, FIELD = "\x1e", "\x00"


def language(path: Column) -> Column:
    """Language by suffix, null if there is none for it."""
    return F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.regexp_extract(path, r"(\.[^./]+)$", 1)]


def source_folders(root: str, excludes: Sequence[str] = ()) -> list[str]:
    """The folders under a local ``root`` that a scan enters: skipped ones, dot folders and those that a glob covers whole are
    never listed, nor what lies in them."""
    import os
    from fnmatch import fnmatch

    out = []
    for at, inner, _ in os.walk(root):
        rel = os.path.relpath(at, root)
        inner[:] = sorted(d for d in inner if d not in SKIPPED and not d.startswith(".") and not any(fnmatch(os.path.normpath(f"{rel}/{d}") + "/", g if g.endswith("/") else g.removesuffix("*") + "*") and g.endswith(("/*", "/**", "/")) for g in excludes))
        out.append(at)
    return out


def source_tree(spark: SparkSession, root: str, excludes: Sequence[str] = ()) -> DataFrame:
    """Files with a known language under ``root``: (path, language, sha, size, content). Skipped and dot folders and globs are left out.

    A local root is walked first, so that skipped folders are pruned and never listed by Spark; files of other stores are listed
    whole and filtered by path before their contents are read.
    """
    import os

    name = F.col("path")
    if os.path.isdir(root):
        folders = source_folders(root, excludes)
        files = spark.read.format("binaryFile").load(folders)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(name, rf"^.*?{root.rstrip('/')}/", "")
    parts = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    skip = F.exists(parts, lambda d: d.isin(*SKIPPED) | d.startswith("."))
    rows = files.select(rel.alias("rel"), "content", F.col("length").alias("size")).withColumn("language", language(F.col("rel")))
    return rows.where(F.col("language").isNotNull() & ~skip & ~matches_any(F.col("rel"), excludes)).select(F.col("rel").alias("path"), "language", F.sha2("content", 256).alias("sha"), "size", "content")


def rename_ends(spec: Column) -> tuple[Column, Column]:
    """Old and new path of ``pre/{a => b}/post`` or ``a => b``; both are the path itself otherwise."""
    brace = r"^(.*)\{(.*) => (.*)\}(.*)$"
    side = lambda i: F.regexp_replace(F.concat(F.regexp_extract(spec, brace, 1), F.regexp_extract(spec, brace, i), F.regexp_extract(spec, brace, 4)), "//", "/")
    plain = lambda i: F.regexp_extract(spec, "^(.*) => (.*)$", i)
    pick = lambda b, p: F.when(spec.rlike(brace), side(b)).when(spec.contains(" => "), plain(p)).otherwise(spec)
    return pick(2, 1), pick(3, 2)


def parse_log(text: DataFrame) -> DataFrame:
    """``text(value)`` of a version log to changes (commit, author, email, ts, subject, path, old_path, added, deleted).

    Records of fewer than five fields, and lines of other than three, are skipped; ``-`` counts 0; an unreadable date
    is the epoch.
    """
    record = text.select(F.explode(F.split("value", RECORD)).alias("r")).select(F.split("r", FIELD).alias("f")).where(F.size("f") >= 5)
    head = record.select(F.trim(F.col("f")[0]).alias("commit"), F.col("f")[1].alias("author"), F.col("f")[2].alias("email"), F.coalesce(F.try_to_timestamp(F.col("f")[3]), F.timestamp_seconds(F.lit(0))).alias("ts"), F.split(F.col("f")[4], "\n", 2).alias("rest"))
    line = head.select("commit", "author", "email", "ts", F.col("rest")[0].alias("subject"), F.explode(F.split(F.coalesce(F.get("rest", F.lit(1)), F.lit("")), "\n")).alias("line"))
    parts = line.withColumn("p", F.split("line", "\t")).where(F.size("p") == 3)
    count = lambda i: F.coalesce(F.col("p")[i].try_cast("long"), F.lit(0))
    old, new = rename_ends(F.col("p")[2])
    return parts.select("commit", "author", "email", "ts", "subject", new.alias("path"), F.when(old != new, old).alias("old_path"), count(0).alias("added"), count(1).alias("deleted"))


def git_log(spark: SparkSession, repository: str, paths: Sequence[str] = (), merges: bool = False, most: int | None = None, since: str | None = None) -> DataFrame:
    """The log of a local repository as changes: of some paths, with merges, at most so many commits, since a date.

    The log goes to a file, record by record, and is read from there by record, so that no process holds it whole.
    """
    import subprocess
    import uuid

    from ..runtime import shared_folder

    command = ["git", "-C", repository, "log", "--numstat", "-M", "-C", *([] if merges else ["--no-merges"]), *([] if most is None else [f"--max-count={most}"]), *([] if since is None else [f"--since={since}"])]
    folder = shared_folder(spark.range(0)).removeprefix("file://")
    import os

    os.makedirs(f"{folder}/graphloom", exist_ok=True)
    path = f"{folder}/graphloom/log-{uuid.uuid4().hex}.txt"
    with open(path, "wb") as out:
        subprocess.run([*command, "--format=%x1e%H%x00%aN%x00%aE%x00%aI%x00%s", "--", *paths], stdout=out, check=True)
    return parse_log(spark.read.option("lineSep", RECORD).text(f"file://{path}"))


def changed_files(spark: SparkSession, repository: str, base: str, head: str) -> DataFrame:
    """The files that a range touched since its merge base and that still exist: (path)."""
    import os
    import subprocess

    done = subprocess.run(["git", "-C", repository, "diff", "--name-only", f"{base}...{head}"], capture_output=True, text=True, check=True)
    return spark.createDataFrame([(x,) for x in done.stdout.splitlines() if x and os.path.isfile(f"{repository}/{x}")], "path string")


def diff_lines(diff: DataFrame) -> DataFrame:
    """``diff(file, pos, value)`` lines of a unified diff to the head side's touched lines (path, line)."""
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("value").startswith("+++ b/"), F.substring("value", 7, 1 << 20))
    rows = diff.withColumn("path", F.last(name, ignorenulls=True).over(order))
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    start, n = F.regexp_extract("value", hunk, 1).try_cast("int"), F.coalesce(F.nullif(F.regexp_extract("value", hunk, 2), F.lit("")).try_cast("int"), F.lit(1))
    hits = rows.where(F.col("value").rlike(hunk)).select("path", start.alias("a"), n.alias("n")).where("n > 0")
    return hits.select("path", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("line")).distinct()


def _entry(meta: Column, key: str, indent: str = "") -> Column:
    """What stands under a key of YAML-like lines: the rest of its line, and the lines below that are indented further or list items."""
    return F.regexp_extract(meta, rf"(?m)^({indent}){key}:[ \t]*([^\n]*(?:\n(?:\1[ \t]+[^\n]*|\1-[^\n]*|[ \t]*(?=\n)))*)", 2)


def _plain(value: Column) -> Column:
    """Without a comment, blanks and quotes around it."""
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"(^|\s)#.*$", "")), "^([\"'])(.*)\\1$", "$2")


def _listed(entry: Column) -> Column:
    """Items of ``[a, b]`` or of lines ``- a``."""
    inline = F.split(F.regexp_extract(entry, r"^\s*\[([^\]]*)\]", 1), ",")
    lines = F.regexp_extract_all(entry, F.lit(r"(?m)^[ \t]*-[ \t]+(.+)$"), 1)
    items = F.transform(F.when(entry.rlike(r"^\s*\["), inline).otherwise(lines), _plain)
    return F.filter(items, lambda x: x != "")


def listed_under(meta: Column, key: str) -> Column:
    """The list under a key of YAML-like text, in brackets or lines; empty if there is none."""
    return _listed(_entry(meta, key))


def decisions(files: DataFrame) -> DataFrame:
    """``files(path, value)`` of whole decision records: (decision, title, status, body, globs, limits, tags, document).

    With frontmatter, ``id`` (else the file's name), ``title``, ``status``, ``applies-to`` and ``tags`` (lists in brackets or lines) and
    the numbers under ``constraints: ceilings:`` (lines or braces) are read; a limit that is no number is left out. Without,
    the title is the first heading and the status the line under its heading; such a record has no globs and no limits.
    Records without a title, and null texts, are skipped; an empty list or map is empty, not null.
    """
    front = r"(?s)^---\n(.*?)\n---(?:\n|$)"
    meta, body = F.regexp_extract("value", front, 1), F.regexp_replace("value", front, "")
    field = lambda k: F.nullif(_plain(F.regexp_extract(meta, rf"(?m)^{k}:[ \t]*(.+)$", 1)), F.lit(""))
    title = F.coalesce(field("title"), F.nullif(F.regexp_extract("value", r"(?m)^# +(?:\d+\.\s*)?(.+)$", 1), F.lit("")))
    status = F.lower(F.coalesce(field("status"), F.nullif(F.regexp_extract("value", r"(?m)^## +Status\s*\n+\s*(\S+)", 1), F.lit(""))))
    ceilings = _entry(_entry(meta, "constraints"), "ceilings", r"[ \t]+")
    pairs = F.regexp_extract_all(F.regexp_replace(ceilings, "[{},]", "\n"), F.lit(r"(?m)^[ \t]*([^\s:#][^:\n]*:[^\n]*)$"), 1)
    named = F.transform(pairs, lambda x: F.struct(_plain(F.substring_index(x, ":", 1)).alias("key"), _plain(F.substring_index(x, ":", -1)).try_cast("double").alias("value")))
    limits = F.map_from_entries(F.filter(named, lambda x: x["value"].isNotNull()))
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select(
        F.coalesce(field("id"), name).alias("decision"), title.alias("title"), status.alias("status"), body.alias("body"), _listed(_entry(meta, "applies-to")).alias("globs"), limits.alias("limits"), _listed(_entry(meta, "tags")).alias("tags"), F.col("path").alias("document")
    ).where("title is not null")


def decision_limits(records: DataFrame, files: DataFrame) -> DataFrame:
    """The limits that accepted ``records`` of ``decisions`` set, by the files that their globs match: (rule, path, limit, decision).

    What ``plans.gate.tightened`` takes. Records of another status, without globs or without limits give nothing.
    """
    from ..plans.gate import scope_paths

    accepted = records.where("status = 'accepted'")
    return scope_paths(accepted.select("decision", "globs"), files).join(accepted.select("decision", F.explode("limits").alias("rule", "limit")), "decision").select("rule", "path", "limit", "decision")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """``{"violations": {key: value}}`` as (key, value)."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.violations"), "map<string,double>")).alias("key", "value"))


def java_packages(files: DataFrame) -> DataFrame:
    """S18d: (package, paths) from the folders after a ``java`` folder."""
    parts = F.split(F.regexp_extract("path", r"(?:^|/)java/(.*)/[^/]+\.java$", 1), "/")
    return files.where(F.col("path").rlike(r"(?:^|/)java/.+/[^/]+\.java$")).groupBy(F.array_join(parts, ".").alias("package")).agg(F.sort_array(F.collect_set("path")).alias("paths"))


def wire_fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protobuf message; malformed input raises."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift >= 70:
                raise ValueError("bad varint")
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, 0, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else -1)
        if size < 0 or at + size > len(data):
            raise ValueError("bad field")
        raw = data[at : at + size]
        at += size
        yield tag >> 3, kind, raw if kind == 2 else int.from_bytes(raw, "little")


def packed(data: bytes) -> list[int]:
    """Packed varints."""
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("bad varint")
    return out


def index_occurrences(files: DataFrame) -> DataFrame:
    """Occurrences of index files ``(path, content)``: (path, symbol, start_line, start_char, end_line, end_char, roles).

    The first document of a path counts (in the order of the file). Ranges have three numbers (one line) or four.
    """
    import pyarrow as pa

    names = ["path", "symbol", "start_line", "start_char", "end_line", "end_char", "roles"]
    types = [pa.string(), pa.string(), *[pa.int32()] * 5]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                seen: set[str] = set()
                for number, _, doc in wire_fields(bytes(data)):
                    if number != 2:
                        continue
                    fields = list(wire_fields(doc))
                    path = next((v.decode() for n, _, v in fields if n == 1), "")
                    if path in seen:
                        continue
                    seen.add(path)
                    for n, _, occurrence in fields:
                        if n != 2:
                            continue
                        got = list(wire_fields(occurrence))
                        span = [x for i, k, v in got if i == 1 for x in (packed(v) if k == 2 else [v])]
                        if len(span) == 3:
                            span = [span[0], span[1], span[0], span[2]]
                        symbol = next((v.decode() for i, _, v in got if i == 2), "")
                        rows.append((path, symbol, *span, next((v for i, _, v in got if i == 3), 0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    return files.select("content").mapInArrow(run, "path string, symbol string, start_line int, start_char int, end_line int, end_char int, roles int")
