"""Retrieval, clones and text measures over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import text as X
from ..operators.clones import clones_of_files
from .base import table

_WORDS = r"\S+"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def bm25_rank(spark, sf_dir):
    """The benchmark items whose id is divisible by 100 as queries, against all documents."""
    q = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), "text")
    return X.bm25(_docs(spark, sf_dir), q, 20).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def clone_windows(spark, sf_dir):
    """Windows of 50 words that stand in two places or more, by their least place."""
    d = _docs(spark, sf_dir).select(F.col("id").alias("path"), F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)).alias("tokens"))
    return X.repeated_windows(d, 50).select("path", F.col("pos").cast("long").alias("pos"), "places", "paths")


def clone_classes(spark, sf_dir):
    """The words of all documents as tokens, their lines as lines."""
    split = F.transform(F.split("text", "\n"), lambda l: F.regexp_extract_all(l, F.lit(_WORDS), F.lit(0)))
    lines = F.flatten(F.transform(F.col("by_line"), lambda ws, i: F.array_repeat((i + 1).cast("long"), F.size(ws))))
    words = _docs(spark, sf_dir).select(F.col("id").alias("path"), split.alias("by_line"))
    return clones_of_files(words.select("path", F.flatten("by_line").alias("tokens"), lines.alias("lines")), 50, 1)


def _line_clones(spark, sf_dir):
    """Lines that stand in two documents or more, as clone classes of one line each."""
    lines = _docs(spark, sf_dir).select(F.col("id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    again = lines.groupBy("line").agg(F.countDistinct("path").alias("d")).where("d >= 2").select("line")
    length = F.size(F.regexp_extract_all("line", F.lit(_WORDS), F.lit(0))).cast("long")
    return lines.join(again, "line", "left_semi").select(F.col("line").alias("class"), "path", length.alias("length"), F.col("pos").alias("first_line"), F.col("pos").alias("last_line"))


def duplication_ratio(spark, sf_dir):
    """A11 on lines that recur: tokens of all places but one of each, in ten thousand tokens."""
    return X.duplication(_line_clones(spark, sf_dir), 10_000).select("duplicate_tokens", F.round("ratio", 6).alias("ratio"))


def duplicate_lines(spark, sf_dir):
    """A12 on lines: lines of a document that stand elsewhere too."""
    return X.duplicate_lines(_line_clones(spark, sf_dir)).select(F.col("path").alias("id"), "lines")


def halstead_text(spark, sf_dir):
    """marks as operators, words as operands."""
    d = _docs(spark, sf_dir).select("id", F.regexp_extract_all("text", F.lit(r"[.,;:!?]"), F.lit(0)).alias("ops"), F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("args"))
    m = X.halstead(F.col("ops"), F.col("args"))
    return d.select("id", m["vocabulary"].cast("long").alias("vocabulary"), m["length"].cast("long").alias("length"), F.round(m["volume"], 4).alias("volume"), F.round(m["difficulty"], 4).alias("difficulty"))


def line_counts(spark, sf_dir):
    """lines, blank lines, comment lines (those that shout), code lines."""
    lines = F.split("text", "\n")
    blank, shout = lambda x: F.trim(x) == "", lambda x: x.rlike("!!")
    return _docs(spark, sf_dir).select("id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, blank)).cast("long").alias("blank"), F.size(F.filter(lines, shout)).cast("long").alias("cloc"), F.size(F.filter(lines, lambda x: ~blank(x) & ~shout(x))).cast("long").alias("sloc"))


def quotable_numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.explode(X.numerals(F.col("text"))).alias("numeral"))


def token_terms(spark, sf_dir):
    """Document frequency of identifier tokens in urls."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(X.tokens(F.col("url"))).alias("term"))
    return p.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("page_id").alias("df"))


def resolution_accuracy(spark, sf_dir):
    """Quality as the truth, more than 600 characters as the guess, toxic as unsure."""
    from ..operators.resolve import accuracy

    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    sites = j.select(F.when(F.col("quality") == 1, F.lit("good")).alias("truth"), F.when(F.col("n_chars") > 600, F.lit("good")).alias("answer"), F.when(F.col("toxic") == 1, 0.5).otherwise(1.0).alias("confidence"))
    return accuracy(sites)


def innermost_interval(spark, sf_dir):
    """Each event in its user's innermost activity interval (gaps of 30 minutes)."""
    from ..operators.resolve import innermost

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    order = Window.partitionBy("user_id").orderBy("t")
    gap = F.coalesce((F.col("t") - F.lag("t").over(order) > 1_800_000_000).cast("int"), F.lit(1))
    islands = e.withColumn("gap", gap).withColumn("island", F.sum("gap").over(order)).groupBy("user_id", "island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    whole = islands.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("island", F.lit(0).cast("long"))
    spans = islands.select("user_id", F.col("island").cast("long").alias("name"), "start", "end").unionByName(whole.select("user_id", F.col("island").alias("name"), "start", "end"))
    return innermost(e.select("event_id", "user_id", F.col("t").alias("at")), spans, "user_id").select("event_id", "user_id", "name")


QUERIES = {f.__name__: f for f in (bm25_rank, clone_windows, clone_classes, duplication_ratio, duplicate_lines, halstead_text, line_counts, quotable_numbers, token_terms, resolution_accuracy, innermost_interval)}
_TOK = r"list_transform(regexp_extract_all(regexp_replace({}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda x: lower(x))"
ORACLES = {
    "bm25_rank": f"""WITH d AS (SELECT doc_id AS id, {_TOK.format("text")} AS ts FROM documents), q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({_TOK.format("text")}) AS term FROM benchmark WHERE item_id % 100 = 0) GROUP BY 1, 2),
        st AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM d), p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT qid, id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / average))) AS score FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY qid, id)
        SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR) AS rank FROM s) WHERE rank <= 20""",
    "clone_windows": r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ts FROM documents), w AS (SELECT doc_id, i, md5(array_to_string(ts[i:i + 49], chr(1))) AS digest FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 48)) AS i FROM d WHERE len(ts) >= 50))
        SELECT min(x).d AS path, min(x).p AS pos, count(*) AS places, count(DISTINCT x.d) AS paths FROM (SELECT digest, {'d': doc_id, 'p': i - 1} AS x FROM w) GROUP BY digest HAVING count(*) >= 2""",
    "duplication_ratio": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT max(len(regexp_extract_all(line, '\S+'))) AS n, count(*) AS c FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2)
        SELECT coalesce(sum(n * (c - 1)), 0)::BIGINT AS duplicate_tokens, round(coalesce(sum(n * (c - 1)), 0) / 10000, 6) AS ratio FROM p""",
    "duplicate_lines": """WITH l AS (SELECT doc_id AS id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
        SELECT id, count(DISTINCT pos) AS lines FROM l WHERE line IN (SELECT line FROM l WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT id) >= 2) GROUP BY 1""",
    "halstead_text": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(text, '[.,;:!?]') AS o, regexp_extract_all(text, '[a-z]+') AS a FROM documents), m AS (SELECT id, len(list_distinct(o)) AS n1, len(list_distinct(a)) AS n2, len(o) AS b1, len(a) AS b2 FROM d)
        SELECT id, n1 + n2 AS vocabulary, b1 + b2 AS length, round(CASE WHEN n1 + n2 > 0 THEN (b1 + b2) * log2(n1 + n2) ELSE 0 END, 4) AS volume, round(coalesce(n1 * b2 / nullif(2 * n2, 0), 0), 4) AS difficulty FROM m""",
    "line_counts": """WITH d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents) SELECT id, len(ls) AS lines, len(list_filter(ls, lambda x: trim(x) = '')) AS blank, len(list_filter(ls, lambda x: contains(x, '!!'))) AS cloc,
        len(list_filter(ls, lambda x: trim(x) <> '' AND NOT contains(x, '!!'))) AS sloc FROM d""",
    "quotable_numbers": r"""SELECT DISTINCT id, regexp_replace(regexp_replace(replace(x, ',', ''), '(\.\d*?)0+$', '\1'), '\.$', '') AS numeral FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')) AS x FROM documents)""",
    "token_terms": f"SELECT term, count(*) AS tf, count(DISTINCT page_id) AS df FROM (SELECT page_id, unnest({_TOK.format('url')}) AS term FROM pages) GROUP BY 1",
    "resolution_accuracy": """WITH s AS (SELECT quality = 1 AS t, n_chars > 600 AS a, toxic = 0 AS c FROM labels JOIN documents USING (doc_id)),
        k AS (SELECT count(*) FILTER (t) AS total, count(*) FILTER (t AND a) AS answered, count(*) FILTER (t AND a) AS ok, count(*) FILTER (t AND a AND c) AS sure, count(*) FILTER (NOT t) AS ex, count(*) AS n FROM s)
        SELECT total, answered, ok AS correct, round(ok / answered, 6) AS precision, round(ok / total, 6) AS recall, round(2 * (ok / answered) * (ok / total) / (ok / answered + ok / total), 6) AS f1, round(sure / sure, 6) AS confident_precision, round(sure / total, 6) AS confident_recall, round(ex / n, 6) AS excluded FROM k""",
    "innermost_interval": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS gap FROM e)
        , i AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY t) AS name FROM g), s AS (SELECT user_id, count(DISTINCT name) AS n FROM i GROUP BY 1)
        SELECT event_id, user_id, CASE WHEN n = 1 THEN 0 ELSE name END::BIGINT AS name FROM i JOIN s USING (user_id)""",
}
