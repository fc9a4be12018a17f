"""Language ID: sparse multinomial logistic regression on TF-IDF of hashed character n-grams."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

#: Hashed n-gram buckets; n-grams of one to three characters.
BUCKETS_BITS = 16
BUCKETS = 1 << BUCKETS_BITS
#: Labelled documents that the model is fitted on, at most (all languages together).
SAMPLE_ROWS = 6000
#: Bits of a text's draw, and how many of them bins are told apart by: a language has 65,536 bins at most.
DRAW_BITS, BIN_BITS = 40, 16
#: Characters folded at a time, so that a very long text needs no more memory.
PART = 1 << 20

_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased text; all that is no letter counts as one space sign."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, max(1, len(text)), PART):
        part = text[max(0, start - 2) : start + PART].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = codes < len(_LETTER)
        codes = np.where(low & ~_LETTER[np.where(low, codes, 0)], np.uint32(32), codes)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])] if len(codes) else codes
        grams = codes.copy()
        for n in (1, 2, 3):
            if n > 1:
                grams = grams[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            if not len(grams):
                break
            mixed = (grams + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            total += np.bincount(mixed >> np.uint32(32 - BUCKETS_BITS), minlength=BUCKETS)
    return total


def tf_idf(counts: np.ndarray, index: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[index]
    return x / (math.sqrt(float(x @ x)) or 1.0)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for a multinomial logistic model with elastic-net penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((BUCKETS, classes))
        self.n = np.zeros((BUCKETS, classes))

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z = self.z[index]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows, by golden-section search over its logarithm.

    The labels are smoothed by one row in ``n + 2``, as rows without an error would ask for temperature 0.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    share = np.full((n, k), 1 / (n + 2) / (k - 1))
    share[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        return float(-(share * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))).sum(axis=1).mean())

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float) -> None:
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0
        counts = bucket_counts(text)
        index = np.flatnonzero(counts)
        p = softmax(tf_idf(counts[index], index, self.idf) @ self.weights[index] / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def held_out(doc_id: int | None) -> bool:
    """Remainder 0 of crc32(id as text) modulo 5; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def balanced(labelled: DataFrame, languages: int, sample_rows: int, seed: int) -> DataFrame:
    """Distinct (lang, text, draw): of each language the ``sample_rows / languages`` texts of least draw, a hash of the text.

    Draws are counted by their upper bits first, so that only those up to the bin in which a language's share is full are ranked,
    however many rows it has; repeated texts count once.
    """
    each_rows = max(1, sample_rows // languages)
    drawn = labelled.withColumn("draw", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << DRAW_BITS)))
    bin_ = F.shiftright("draw", DRAW_BITS - BIN_BITS)
    bins = drawn.select("lang", "draw").distinct().groupBy("lang", bin_.alias("bin")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = bins.withColumn("before", before).where(F.col("before") < each_rows).groupBy("lang").agg(F.max("bin").alias("bin"))
    low = drawn.select("lang", "draw").join(F.broadcast(full), "lang").where(bin_ <= F.col("bin")).select("lang", "draw").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    last = low.withColumn("rank", rank).where(F.col("rank") <= each_rows).groupBy("lang").agg(F.max("draw").alias("last"))
    return drawn.join(F.broadcast(last), "lang").where("draw <= last").select("lang", "text", "draw").distinct()


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 3, seed: int = 3) -> LanguageModel:
    """Fit on ``labelled(text, lang)``: document frequencies from all rows, weights from a bounded sample.

    The sample takes at most ``sample_rows`` distinct texts, as many of each language as it has up to an equal share,
    chosen by a hash of the text. Every fifth sampled row is kept back to set the temperature.
    """
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")

    def frequencies():
        total = np.zeros(BUCKETS, dtype=np.int64)

        def each(c):
            for text in c["text"]:
                np.add(total, bucket_counts(text) > 0, out=total)
            return ()

        def close():
            for i in np.flatnonzero(total):
                yield int(i), int(total[i])

        each.close = close
        return each

    df = np.zeros(BUCKETS)
    for r in map_rows(labelled.select("text"), frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    idf = np.log((sum(sizes.values()) + 1) / (df + 1)) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), 1.0)
    sample = balanced(labelled, len(languages), sample_rows, seed)

    def features():
        def each(c):
            for text, lang, rank in zip(c["text"], c["lang"], c["draw"], strict=True):
                counts = bucket_counts(text)
                index = np.flatnonzero(counts)
                yield rank, lang, index.astype("<u2").tobytes(), np.minimum(counts[index], (1 << 32) - 1).astype("<u4").tobytes()

        return each

    rows = []
    # texts become features where they are; only those are sorted and sent to the driver
    found = map_rows(sample, features, "rank long, lang string, ids binary, counts binary")
    for r in found.orderBy("rank", "lang", "ids", "counts").limit(sample_rows).collect():
        index = np.frombuffer(r.ids, dtype="<u2")
        rows.append((index, tf_idf(np.frombuffer(r.counts, dtype="<u4"), index, idf).astype(np.float32), languages.index(r.lang)))
    model, rng = Ftrl(len(languages)), np.random.default_rng(seed)
    train = [x for i, x in enumerate(rows) if i % 5]
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            model.learn(*train[i])
    weights = model.weights(slice(None))
    held = [x for i, x in enumerate(rows) if i % 5 == 0]
    logits = np.array([x @ weights[index] for index, x, _ in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, weights.astype(np.float32), temperature(logits, np.array([y for *_, y in held], dtype=np.int64)))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)`` with ``held_out, lang_pred, score`` and the columns of ``keep``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null or has no letter (or nothing was
    learned); ``score`` is the calibrated probability; of equal ones the first language by name is taken. Only the text is looked
    at, a very long one in parts of PART characters. Repeated rows stay; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    from pyspark.sql import types as T

    docs = docs.select(*dict.fromkeys(("doc_id", "text", *keep)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select("doc_id", *keep).schema.fields, *T._parse_datatype_string("held_out boolean, lang_pred string, score double").fields])

    def make():
        own = shared.value

        def each(c):
            for i, (doc, text) in enumerate(zip(c["doc_id"], c["text"], strict=True)):
                yield doc, *(c[k][i] for k in keep), held_out(doc), *own.predict(text)

        return each

    return map_rows(docs, make, schema, flush=500)


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled rows that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return docs.where(F.col("lang").isNotNull() & (F.coalesce(fold, F.lit(1)) != 0)).select("text", "lang")
