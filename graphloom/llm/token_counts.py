"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from itertools import repeat
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, most_frequent, row_base
from .token_output import BYTE_ALPHABET

#: Most frequent pre-tokens whose counts go to every worker (about 100 bytes each there); all others are shuffled.
HEAD = 150_000
#: Pre-tokens that a task offers for the head, and distinct ones that it holds at a time (about 120 bytes each, 25 MB).
OFFER, HOLD = 60_000, 200_000
#: The byte-level pattern, where letters are Latin ones and all else is ASCII; and what makes a text another one.
_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^ \n\t\r!-~À-ÖØ-öø-ÿ]")


class PreTokens:
    """Pre-tokens of a text as the library gives them, as they stand in the text.

    A byte-level tokenizer's pattern over Latin letters and ASCII is matched here; any other text, or tokenizer, goes to the
    library. Added tokens are cut out first, as the library does.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("tokenizers with a normalizer are not supported")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        names = sorted((a.content for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        cut = said["pre_tokenizer"]
        if cut["type"] != "ByteLevel" or cut.get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers without a prefix space are supported")
        self.own = cut.get("use_regex", True)

    def _part(self, text: str) -> list[str]:
        if self.own and not _OTHER.search(text):
            return _PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.split(text)]

    def of(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of added tokens."""
        if self.added is None or not self.added.search(text):
            return self._part(text), 0
        parts = self.added.split(text)
        return [t for part in parts for t in self._part(part)], len(parts) - 1

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token.encode().decode("latin-1").translate(BYTE_ALPHABET)))


_READY: dict[str, PreTokens] = {}


def _ready(tokenizer_path: str) -> PreTokens:
    """A worker's instance, kept for its later tasks; its size is that of the vocabulary."""
    return _READY.get(tokenizer_path) or _READY.setdefault(tokenizer_path, PreTokens(tokenizer_path))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; ids are never made.

    1. Each task offers its most frequent pre-tokens with their counts; the HEAD most frequent of all, a bounded table,
       have their pieces counted once and are broadcast.
    2. Each document's pre-token frequencies are summed against that table. What it lacks is written, with the row's id, as
       its (pre-token, frequency) pairs, which are then dealt by pre-token: there each distinct one is counted once and
       joined to its documents. Which pre-tokens are in the head changes the cost only, not the result.
    3. The parts are summed by row.

    Row ids are given while the parts are written, so both readings of them agree, in whatever order the rows of ``docs``
    come. Edge cases: null is an empty text (0 bytes, 0 tokens); a very long text is one row whose pairs are its distinct
    pre-tokens. Repeated ids or rows stay separate rows (the row id keeps them apart). Special strings in a text count as the
    library's default has it: one token. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(_head(docs, tokenizer_path))

    def sums():
        pre, head, base = _ready(tokenizer_path), shared.value, row_base()

        def each(c):
            nonlocal base
            for doc, text in zip(c["doc_id"], c["text"], strict=True):
                base += 1
                text = text or ""
                found, n = pre.of(text)
                frequency = Counter(found)
                pieces = list(map(head.get, frequency, repeat(0)))
                n += sum(map(mul, pieces, frequency.values()))
                rest = [t for t, k in zip(frequency, pieces, strict=True) if not k]
                yield base, doc, len(text.encode("utf-8", "surrogatepass")), n, rest, [frequency[t] for t in rest]

        return each

    parts = materialise(map_rows(docs, sums, "uid long, doc_id long, n_bytes long, n long, tokens array<string>, times array<int>", flush=500), "pre-tokens")
    rest = parts.select("uid", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("uid", F.col("t.tokens").alias("token"), F.col("t.times").alias("times"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by token: each distinct one of a batch is counted once, the last one is carried over to the next
        pre = _ready(tokenizer_path)
        last: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("token").dictionary_encode()
            words = coded.dictionary.to_pylist()
            pieces = np.array([last[w] if w in last else pre.pieces(w) for w in words], dtype=np.int64)
            last = {words[-1]: int(pieces[-1])}
            n = pieces[coded.indices.to_numpy()] * batch.column("times").to_numpy()
            uid, at = np.unique(batch.column("uid").to_numpy(), return_inverse=True)
            total = np.zeros(len(uid), dtype=np.int64)
            np.add.at(total, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(total)], names=["uid", "n"])

    counted = rest.repartition("token").sortWithinPartitions("token").mapInArrow(count, "uid long, n long")
    missing = F.lit(None).cast("long")
    summed = parts.select("uid", "doc_id", "n_bytes", "n").unionByName(counted.select("uid", missing.alias("doc_id"), missing.alias("n_bytes"), "n"))
    out = summed.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _head(docs: DataFrame, tokenizer_path: str) -> dict[str, int]:
    """Pieces of the HEAD most frequent pre-tokens (of those that tasks offer)."""

    def make():
        pre = _ready(tokenizer_path)
        total: Counter = Counter()

        def offers():
            for token, n in nlargest(OFFER, ((t, n) for t, n in total.items() if n > 1), key=lambda x: (x[1], x[0])):
                yield token, n
            total.clear()

        def each(c):
            for text in c["text"]:
                total.update(pre.of(text or "")[0])
                if len(total) > HOLD:
                    yield from offers()

        each.close = offers
        return each

    offered = map_rows(docs.select("text"), make, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pre = _ready(tokenizer_path)
    return {r.token: pre.pieces(r.token) for r in most_frequent(offered, HEAD)}
