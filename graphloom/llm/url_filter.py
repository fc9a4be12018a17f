"""URL filters: rules first, then naive Bayes on host words found by a unigram Viterbi split."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, maybe_in, row_base

#: Letters of a word of the segmenter, and hashed token buckets of the classifier.
SHORTEST, LONGEST, BUCKETS = 2, 24, 1 << 16
#: Leading digits of a number that are tokens.
LEADING = 2
#: Folds of the ruled urls for a held-out measure.
FOLDS = 5
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST, _PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
_RUN = re.compile(r"[^\W\d_]+|\d+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty without one."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = _HOST.match(rest)[0]
    return host.translate(_UPPER), _PATH.match(rest, len(host))[0]


def plain_host(host: str) -> str:
    """The host with its encoded labels as letters; a label that can't be decoded stays."""
    out = []
    for label in host.split("."):
        if label.startswith("xn--"):
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except ValueError:
                pass
        out.append(label)
    return unquote(".".join(out), errors="replace").lower()


class Rules:
    """Rules ``(verdict, host + path)`` by host; of those that fit a url the longest wins, then the first listed."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while at >= 0 and host:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1 or -1
        return best


def letter_runs(host: str, path: str) -> tuple[list[str], list[str], list[str]]:
    """Runs of letters of the host and of the path, in any script, and the tokens of their numbers: the length, and the leading
    digits, on their own and with the run of letters before them, as what a number means hangs on where it stands."""
    runs: tuple[list[str], list[str], list[str]] = [], [], []
    for i, text in enumerate((plain_host(host), unquote(path, errors="replace").lower())):
        before = ""
        for run in _RUN.findall(text):
            if run[0].isdecimal():
                leads = [run[:k] for k in range(1, min(len(run), LEADING) + 1)]
                runs[2].append(f"{'hp'[i]}#{len(run)}")
                runs[2].extend(f"{'hp'[i]}^{lead}" for lead in leads)
                runs[2].extend(f"{'hp'[i]}^{before}/{lead}" for lead in leads)
            else:
                runs[i].append(run)
                before = run[-LONGEST:]
    return runs


def best_split(run: str, costs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Viterbi: the split of least cost of a run into known words ``(start, end)`` and single letters of cost ``unknown``; of equal ones
    the one that ends with the single letter, else with the longest word."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, end), cost in costs.items():
        ending.setdefault(end, []).append((start, cost))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        least = best[end - 1][0] + unknown, end - 1
        for start, cost in sorted(ending.get(end, ())):
            if best[start][0] + cost < least[0]:
                least = best[start][0] + cost, start
        best.append(least)
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


class Segmenter:
    """The unigram model on one machine: costs of known words, and of a letter that none covers, dearer than any word."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + math.log(10)

    def split(self, run: str) -> list[str]:
        pairs = ((i, j) for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST) + 1))
        return best_split(run, {(i, j): self.cost[run[i:j]] for i, j in pairs if run[i:j] in self.cost}, self.unknown)

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host and path, marked by where they stand, and their numbers."""
        h, p, numbers = letter_runs(host, path)
        return [f"h:{w}" for r in h for w in self.split(r)] + [f"p:{w}" for r in p for w in self.split(r)] + numbers


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


class NaiveBayes:
    """Multinomial naive Bayes over token buckets with Laplace smoothing; classes block and allow."""

    def __init__(self, counts: np.ndarray, pages: np.ndarray) -> None:
        self.prior = np.log((pages + 1) / (pages.sum() + 2))
        self.token = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1]))

    def block_odds(self, buckets: list[int]) -> float:
        score = self.prior + self.token[:, buckets].sum(axis=1)
        return float(score[0] - score[1])


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): all words of SHORTEST to LONGEST letters of the visible texts of all pages."""
    text = F.lower(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>|&[a-z]+;", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def fold_of(url: str | None) -> int:
    return zlib.crc32((url or "").encode("utf-8", "surrogatepass")) % FOLDS


def _parsed(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Each row's url in parts, with a row id, its rule and the rule's verdict, its fold, and its runs."""
    table = Rules(rules)

    def make():
        base = row_base()

        def each(c):
            nonlocal base
            for page, url in zip(c["page_id"], c["url"], strict=True):
                base += 1
                host, path = split_url(url)
                h, p, numbers = letter_runs(host, path)
                yield base, page, host, path, *table.find(host, path), fold_of(url), [f"h:{r}" for r in h] + [f"p:{r}" for r in p], numbers

        return each

    schema = "uid long, page_id long, host string, path string, rule string, own string, fold int, runs array<string>, numbers array<string>"
    return materialise(map_rows(pages.select("page_id", "url"), make, schema), "urls")


def _segmented(urls: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words): every distinct run of letters of the urls, split once.

    A run's parts are looked up in the counts of all words by a join (a bitmap spares it the parts that are surely none), so
    that no dictionary is held anywhere: a task sees one run with its known parts.
    """
    words = materialise(words, "words")
    total = words.agg(F.sum("n").alias("t")).first().t or 1
    runs = materialise(urls.select(F.explode("runs").alias("r")).select(F.substring("r", 3, 1 << 30).alias("run")).distinct(), "runs")
    starts = runs.select("run", F.explode(F.sequence(F.lit(0), F.greatest(F.length("run") - SHORTEST, F.lit(0)))).alias("start"))
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("run") - F.col("start")))
    parts = starts.where(F.length("run") - F.col("start") >= SHORTEST).select("run", "start", F.explode(sizes).alias("size")).withColumn("word", F.expr("substring(run, start + 1, size)"))
    known = maybe_in(parts, "word", words).join(words.hint("merge"), "word").groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("parts"))
    unknown = math.log(total) + math.log(10)

    def make():
        def each(c):
            for run, found in zip(c["run"], c["parts"], strict=True):
                costs = {(p["start"], p["start"] + p["size"]): -math.log(p["n"] / total) for p in found or ()}
                yield run, best_split(run, costs, unknown)

        return each

    return materialise(map_rows(runs.join(known, "run", "left"), make, "run string, words array<string>"), "segmented")


def _tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """(uid, bucket): the tokens of every row's url."""
    split = _segmented(urls, words)
    runs = urls.select("uid", F.explode("runs").alias("r")).select("uid", F.substring("r", 1, 2).alias("mark"), F.substring("r", 3, 1 << 30).alias("run"))
    made = runs.join(split.hint("merge"), "run").select("uid", F.explode(F.transform("words", lambda w: F.concat("mark", w))).alias("token"))
    every = made.unionByName(urls.select("uid", F.explode("numbers").alias("token")))
    return materialise(every.select("uid", (F.crc32(F.col("token").cast("binary")) % BUCKETS).cast("int").alias("bucket")), "tokens")


def _taught(urls: DataFrame, tokens: DataFrame, without_fold: int | None = None) -> NaiveBayes:
    """The classifier of the urls that a rule decides: BUCKETS counts for each of the two verdicts reach the driver."""
    ruled = urls.where(F.col("rule").isNotNull() & (F.lit(without_fold is None) | (F.col("fold") != F.lit(-1 if without_fold is None else without_fold))))
    ruled = ruled.select("uid", (F.col("own") != "block").cast("int").alias("k"))
    counts, seen = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in ruled.groupBy("k").agg(F.count("*").alias("n")).collect():
        seen[r.k] = r.n
    for r in tokens.join(ruled, "uid").groupBy("k", "bucket").agg(F.count("*").alias("n")).collect():
        counts[r.k, r.bucket] = r.n
    return NaiveBayes(counts, seen)


def _odds(urls: DataFrame, tokens: DataFrame, bayes: NaiveBayes) -> DataFrame:
    """``urls`` with ``block_odds``, rounded to nine places, so that the order of a sum can't tell."""
    lead = bayes.token[0] - bayes.token[1]
    weights = urls.sparkSession.createDataFrame([(int(i), float(lead[i])) for i in range(BUCKETS)], "bucket int, lead double")
    sums = tokens.join(F.broadcast(weights), "bucket").groupBy("uid").agg(F.sum("lead").alias("lead"))  # BUCKETS rows, whatever the input
    prior = float(bayes.prior[0] - bayes.prior[1])
    return urls.join(sums, "uid", "left").withColumn("block_odds", F.round(F.lit(prior) + F.coalesce("lead", F.lit(0.0)), 9))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Verdict on every url of ``pages(page_id, url, html)``: ``page_id, host, path, rule, verdict, block_odds``.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins. The
    urls that a rule decides teach the classifier: token counts of all of them, by verdict. Host and path are segmented by a unigram
    model of all words of all pages, each distinct run of letters once. Urls without a rule get the more likely class (``allow`` on
    a tie). What is bounded is the classifier: BUCKETS counts for each class.

    Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and the prior's verdict.
    Very long hosts take time in proportion. Null html gives no words. Repeated rows stay. Empty tables give no rows. Other
    columns are ignored, whatever their names.
    """
    urls = _parsed(pages, rules)
    tokens = _tokens(urls, word_counts(pages))
    out = _odds(urls, tokens, _taught(urls, tokens))
    verdict = F.coalesce("own", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_odds")


def held_out(pages: DataFrame, rules: Sequence[tuple[str, str]], fold: int = 0) -> DataFrame:
    """How the classifier alone judges the ruled urls of a fold (by crc32 of the url) that it wasn't taught by: ``truth, verdict, n``."""
    urls = _parsed(pages, rules)
    tokens = _tokens(urls, word_counts(pages))
    own = _odds(urls.where((F.col("fold") == fold) & F.col("rule").isNotNull()), tokens, _taught(urls, tokens, without_fold=fold))
    return own.select(F.col("own").alias("truth"), F.when(F.col("block_odds") > 0, "block").otherwise("allow").alias("verdict")).groupBy("truth", "verdict").agg(F.count("*").alias("n"))
