"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Who makes a table deletes it: a stage what it alone has read, ``run`` what a stage's result reads, once that is written. A
stage that is called alone can't know when its result has been read, so that what this needs stays: small tables of row
ids or hits, and a checkpoint of its rows, which Spark's cleaner deletes when nothing refers to it any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import collecting, discard, fixed_rows, materialise, remove, settled, without
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.language_id import fit, identify, training_rows
from graphloom.llm.mixing import mix_sources
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.queries import vocabulary_file
from graphloom.llm.token_output import token_output

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Calibrated probability below which a document's language counts as unknown.
LEAST_SCORE = 0.5
#: Share of hit words above which a document goes; below, only its spans do.
MOST_COVERED = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``row_id``, fixed, so that every later scan sees the same ids."""
    return fixed_rows(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go (null, no letter, or a probability under LEAST_SCORE).

    The model is fitted on the labelled rows of ``docs`` outside the held-out fold. Without any labels there is nothing to
    tell languages by, so that every document with a letter stays. Equal texts get equal decisions, so repeated rows stay or go
    together; a very long text is read whole; a null id is never held out. No rows give no rows. Columns beyond those of
    ``documents`` are dropped.
    """
    docs = docs.select(*COLUMNS)
    model = fit(training_rows(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model, keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of least id, null last.

    Word shingles of five words, similarity 0.8. Of rows that repeat the least id (or all have none) one stays. Null texts and
    those without a word are linked with nothing, so that each of their rows stays. No rows give no rows. Only rows that may go
    (by a bitmap of bounded size) are shuffled with their texts.
    """
    docs = _numbered(docs)
    with collecting() as made:
        groups = settled(near_duplicates(docs, k=5, percent=80, row_col="row_id").select("row_id", "doc_id", "component_row"), "groups", made)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    stay = groups.groupBy("component_row").agg(least.alias("least")).select(F.col("least.row_id").alias("row_id"))
    gone = materialise(groups.select("row_id").join(stay.hint("merge"), "row_id", "left_anti"), "gone")
    discard(groups)
    return without(docs, "row_id", gone).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more of benchmark items are cut out; a document that is mostly such passages goes.

    Null texts and those without a word stay as they are, as do all where there are no items; ``n_chars`` is counted anew
    where something was cut. Repeated rows are treated alike. No rows give no rows.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs.select(*COLUMNS), items, window=10, max_coverage=MOST_COVERED, keep=("lang", "source", "n_chars"), with_text=True)
    length = F.when(F.col("n_hit") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~F.coalesce("over", F.lit(False))).select("doc_id", F.col("clean_text").alias("text"), "lang", "source", length.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as so many rows.

    Rows without an id or with a repeated one get their own copies, by row id. A null source is a source; null and empty texts
    have no words and count as documents only. No rows give no rows. Rows and copies meet in a sort-merge join at every size,
    which shuffles the texts once.
    """
    docs = _numbered(docs)
    with collecting() as made:
        mixed = settled(mix_sources(docs, row_col="row_id").where("copies > 0").select("row_id", "copies"), "copies", made)
    taken = docs.join(mixed.hint("merge"), "row_id")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, read back: one row for each document, with its end id even where the text is null or empty."""
    return token_output(docs, vocabulary_file("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language ID", language_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``. When a stage's result is written, its own tables and the one before go; what
    the last one's result reads stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"), made)
        remove(spark, *before)
        before = [docs._scratch]
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
