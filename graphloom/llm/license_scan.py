"""Licence scan by canonical digests: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import LICENSES, SPELLINGS

#: A line that states a copyright and no terms.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
VARIANT = "|".join(found for found, _ in SPELLINGS)


def canonical(text: Column) -> Column:
    """Lower case, copyright lines emptied, one spelling, no punctuation, single spaces; newlines stay."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    low = F.regexp_replace(low, COPYRIGHT_LINE, "")
    same = low
    for found, instead in SPELLINGS:
        same = F.replace(same, F.lit(found), F.lit(instead))
    same = F.when(low.rlike(VARIANT), same).otherwise(low)
    plain = F.regexp_replace(same, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(plain, r" ?\n ?", "\n")


def joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


def known_digests(spark, known: Sequence[tuple[str, str]] | DataFrame = LICENSES) -> DataFrame:
    """(digest, license) of the known texts, a list or a table ``(license, text)``; the least identifier where two have one canonical form."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    return table.select(F.sha2(joined(canonical(F.col("text"))), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = LICENSES) -> DataFrame:
    """Licences of ``docs(doc_id, text)`` by the digests of entire canonical texts.

    The units looked up are the whole text and each of its lines (a notice is a line of its own). Returns ``doc_id,
    digest`` (of the whole canonical text), ``license`` (if the whole text is a known one), ``n_lines`` (lines that
    aren't blank once canonical), ``n_license_lines`` and ``licenses`` (distinct identifiers of the lines, sorted,
    comma-joined, ``''`` if none).

    A list of known texts is what the caller wrote down, so its digests are broadcast; a table of them is joined as its size
    asks for. The units are dealt out and counted by row before anything is shuffled. Edge cases: null is an empty text (no lines,
    no licence); a very long text is so many lines. Repeated ids, rows and lines stay separate and count each. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", canonical(F.col("text")).alias("c"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    units = text.select("uid", "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), joined(F.col("c")).alias("t"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))))).alias("u"))
    units = units.select("uid", "doc_id", F.col("u.whole").alias("whole"), F.sha2(F.col("u.t"), 256).alias("digest"))
    digests = known_digests(spark, known)
    found = units.join(digests if isinstance(known, DataFrame) else F.broadcast(digests), "digest", "left")
    one = found.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_lines"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_license_lines"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license"))))).alias("licenses"),
    )
    return one.drop("uid")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(known: Sequence[tuple[str, str]] = LICENSES) -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``."""
    variants = "low"
    for found, instead in SPELLINGS:
        variants = f"replace({variants}, {_quoted(found)}, {_quoted(instead)})"
    steps = rf"""
  SELECT *, regexp_replace(regexp_replace({variants}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', '\n', 'g') AS c FROM (
  SELECT *, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\r\n?', '\n', 'g'), {_quoted(COPYRIGHT_LINE)}, '', 'g') AS low FROM source)"""
    steps = steps.replace(r"'\n'", "chr(10)")
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in known)
    whole = r"sha256(trim(regexp_replace(c, '\s+', ' ', 'g')))"
    return f"""
WITH k AS (SELECT {whole} AS digest, min(license) AS license FROM ({steps.replace("source", f"(VALUES {values}) v(license, text)")}) GROUP BY 1),
d AS (SELECT doc_id, {whole} AS digest, list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM ({steps.replace("source", "documents")})),
l AS (SELECT doc_id, k.license FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM d) u JOIN k USING (digest)),
a AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS s FROM l GROUP BY 1)
SELECT d.doc_id, d.digest, k.license, len(ls)::BIGINT AS n_lines, coalesce(a.n, 0)::BIGINT AS n_license_lines, coalesce(a.s, '') AS licenses
FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN a ON a.doc_id = d.doc_id
"""
