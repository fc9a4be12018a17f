"""MinHash near-dedup: universal hash minima with banding, exact confirmation, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, maybe_in, row_base
from .components import connected_components
from .shingles import LANES, MinHasher, least_agreement, shingle_set, similar

#: Members of a star or of a query block that one task compares at a time.
BLOCK = 256


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, bands: int = 64, rows: int = 8, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Near-duplicate classes of ``docs`` by Jaccard similarity of word shingles.

    Words lie between ASCII white space, A-Z in lower case; a text's set holds its distinct ``k``-word
    shingles (the whole sequence if it is shorter). Two texts are linked if ``100 * |a & b| >= percent
    * |a | b|``, confirmed on the full sets. Returns one row per input row:
    ``doc_id, n_shingles, component_id`` (smallest id reachable over links), ``kept`` (id = component). Where ``row_col``
    names a column of row ids (long, once each), also ``row_id`` and ``component_row``, a row id that the rows of a
    component have in common, whatever their ids.

    1. Texts with one set become one class (grouped by a 128-bit digest), so copies cost one row each.
    2. ``bands * rows`` universal hash minima of each class make ``bands`` keys and a signature of LANES bytes. In every
       bucket of a key the member of least random rank is the pivot; each other member is compared with it, never all pairs:
       first by signatures (pairs that agree far too little go), then on the full sets.
    3. Components of the confirmed links. A bucket's members that still are in different components
       are then compared, the minority as queries against the star's rows in blocks, again by signature first, so
       that no link between two members of a bucket is lost.

    A hot bucket is cut into blocks where its rows come by, so no task gets a whole star. All joins are the same at every size.
    A star of many members that are unlike each other but share a band costs its minority times its size in signatures.

    Edge cases: a null or empty text, or one of white space alone, has ``n_shingles`` 0 and is linked
    with nothing (``component_id`` its own id). A null id gets the component of its class, ``kept`` null if
    that is null. Repeated ids or rows stay separate rows; equal texts are one class; a very long text is one set. Ties
    don't arise: all choices are by id. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"), *([] if row_col is None else [F.col(row_col).alias("row_id")]))
    sketch = materialise(_sketch(docs, k, bands, rows), "sketch")
    least = F.min(F.struct("uid", "th", "bands", "sig")).alias("r")
    classes = materialise(
        sketch.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("min_doc"), F.count("*").alias("copies"), least).select(F.col("r.uid").alias("node"), F.col("r.th").alias("th"), F.col("r.bands").alias("bands"), F.col("r.sig").alias("sig"), "digest", "min_doc", "copies"),
        "classes",
    )
    rows_ = materialise(sketch.select("uid", "doc_id", "n", "digest"), "rows")
    discard(sketch)
    stars = materialise(_stars(classes), "stars")
    alike = materialise(_alike(stars, classes.select("node", "sig"), percent), "alike")
    active = materialise(_ends(alike, "a", "p"), "active")
    sets = materialise(_sets(docs, classes.join(active, "node", "left_semi"), k), "sets")
    first = connected_components(_confirmed(alike, sets, percent))
    label = materialise(active.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("label")), "labels")
    discard(sets, alike, active)
    more = connected_components(_residual(docs, classes, stars, label, k, percent))
    # a class that no first link touches can still be in a later one
    ends = label.select("node", "label").unionByName(more.select("node", F.col("node").alias("label")).join(label.select("node"), "node", "left_anti"))
    final = ends.join(more.select(F.col("node").alias("label"), F.col("component").alias("l2")), "label", "left").select("node", F.coalesce("l2", "label").alias("component"))
    member = classes.select("node", "digest", "min_doc", "copies").join(final, "node", "left").where("component is not null or copies > 1").select("digest", "min_doc", F.coalesce("component", "node").alias("component"))
    smallest = member.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    known = materialise(member.join(smallest, "component").select("digest", "component_id", F.col("component").alias("component_row")), "components")
    discard(classes, stars, label)
    found = rows_.join(known.hint("merge"), "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), *([] if row_col is None else [F.col("uid").alias("row_id"), F.coalesce("component_row", "uid").alias("component_row")]))


def _sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def make():
        hasher, base = MinHasher(bands, rows), row_base()

        def each(c):
            nonlocal base
            for i, (doc, th, text) in enumerate(zip(c["doc_id"], c["th"], c["text"], strict=True)):
                base = c["row_id"][i] if "row_id" in c else base + 1
                shingles = shingle_set((text or "").encode("utf-8", "surrogatepass").lower(), k)
                if len(shingles):
                    minima = hasher.minima(shingles)
                    yield base, doc, th, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), hasher.band_keys(minima).tobytes(), hasher.signature(minima)
                else:
                    yield base, doc, th, 0, None, None, None

        return each

    return map_rows(docs, make, "uid long, doc_id long, th long, n long, digest binary, bands binary, sig binary")


def _block_of(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first members of every bucket of a pivot are block 0; the others, by their place, are apart for different keys."""
    apart = 1 + (key & 63) + 64 * (place // BLOCK)
    return np.where(place < max(2, BLOCK // 64), 0, apart).astype(np.int32)


def _stars(classes: DataFrame) -> DataFrame:
    """Each bucket's members with its pivot, in blocks of about BLOCK in the order they come by: (a, p, block), a pair once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = [np.frombuffer(x, dtype=np.int64) for x in part.column("bands").to_pylist()]
                if keys:
                    node = np.repeat(part.column("node").to_numpy(), [len(x) for x in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node)], names=["key", "node"])

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = pivot = None
        before = 0  # members of the last key in earlier batches
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            head = np.where(at >= 0, node[at], pivot if pivot is not None else 0)
            place = np.where(at >= 0, np.arange(len(key)) - at, np.arange(len(key)) + before)
            last_key, pivot, before = key[-1], head[-1], int(place[-1]) + 1
            keep = head != node
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(head[keep]), pa.array(_block_of(key[keep], place[keep]))], names=["a", "p", "block"])

    keyed = classes.select("node", "bands").mapInArrow(explode, "key long, node long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", F.xxhash64("node"), "node")
    return dealt.mapInArrow(pivots, "a long, p long, block int").groupBy("a", "p").agg(F.min("block").alias("block"))


def _alike(stars: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``stars`` whose signatures agree well enough for the threshold."""
    a = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    p = sigs.select(F.col("node").alias("p"), F.col("sig").alias("sig_p"))
    pivots = stars.select("p", "block").distinct().join(p.hint("merge"), "p")
    both = stars.join(a.hint("merge"), "a").join(pivots.hint("merge"), ["p", "block"])
    least = least_agreement(percent, LANES)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_p"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield batch.select(["a", "p", "block"]).filter(keep)

    return both.select("a", "p", "block", "sig_a", "sig_p").mapInArrow(agree, "a long, p long, block int")


def _ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.col(a).alias("node")).distinct().union(pairs.select(F.col(b).alias("node")).distinct()).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the classes ``wanted``; their texts are found by a hash and checked by the set's digest.

    A bitmap of the hashes spares all other texts the shuffle.
    """
    wanted = wanted.select("node", "th", F.col("digest").alias("want"))
    texts = maybe_in(docs.select("th", "text"), "th", wanted).join(wanted.hint("merge"), "th").select("node", "want", "text")

    def make():
        def each(c):
            for node, want, text in zip(c["node"], c["want"], c["text"], strict=True):
                shingles = shingle_set((text or "").encode("utf-8", "surrogatepass").lower(), k)
                if xxhash.xxh3_128_digest(shingles.tobytes()) == bytes(want):
                    yield node, shingles.tobytes()

        return each

    return map_rows(texts, make, "node long, shingles binary", flush=500).dropDuplicates(["node"])


def _confirmed(alike: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members with their pivot, on the full sets; the pivot's set goes to each block of its star."""
    member = alike.join(sets.withColumnRenamed("node", "a").hint("merge"), "a").select("p", "block", F.lit(1).alias("side"), "a", "shingles")
    pivot = alike.select("p", "block").distinct().join(sets.withColumnRenamed("node", "p").hint("merge"), "p").select("p", "block", F.lit(0).alias("side"), F.col("p").alias("a"), "shingles")

    def make():
        held: list = [None, None]

        def each(c):
            for p, block, side, a, raw in zip(c["p"], c["block"], c["side"], c["a"], c["shingles"], strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                if side == 0:
                    held[:] = (p, block), own
                elif held[0] == (p, block) and similar(own, held[1], percent):
                    yield a, p

        return each

    return map_rows(pivot.unionByName(member).repartition("p", "block").sortWithinPartitions("p", "block", "side"), make, "a long, b long")


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def _part(n: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("a"), F.lit(seed)), F.col(n)).cast("int")


def _residual(docs: DataFrame, classes: DataFrame, stars: DataFrame, label: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components among the members of one star: (a, b) of component labels."""
    star = materialise(stars.join(label.withColumnRenamed("node", "a").hint("merge"), "a", "left").select("p", "a", F.coalesce("label", "a").alias("label")), "labelled")
    sizes = star.groupBy("p", "label").agg(F.count("*").alias("c"))
    major = sizes.groupBy("p").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("d"), F.count("*").alias("labels")).where("labels > 1")
    # a star's size in blocks, its minority's, and its largest component; written, so that the join can split a hot pivot
    mixed = materialise(major.select("p", F.col("m.label").alias("major"), _blocks(F.col("d")).alias("s"), F.greatest(_blocks(F.col("d") - F.col("m.c")), F.lit(1)).alias("x")), "mixed")
    labelled, star = star, materialise(maybe_in(star, "p", mixed).join(mixed.hint("merge"), "p"), "mixed-members")
    discard(labelled, mixed)
    near = _compare(star.join(classes.select(F.col("node").alias("a"), F.col("sig").alias("data")).hint("merge"), "a"), _Signatures, percent)
    near = materialise(near.select(F.col("a").alias("node")).distinct(), "near")
    sets = _sets(docs, classes.join(near, "node", "left_semi"), k)
    return _compare(star.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("data")).hint("merge"), "a"), _Sets, percent)


class _Signatures:
    """Members of a block by signature."""

    def __init__(self, raw: list[bytes], percent: int) -> None:
        self.table = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
        self.least = least_agreement(percent, LANES)

    def found(self, raw: bytes) -> np.ndarray:
        return np.flatnonzero((self.table == np.frombuffer(raw, dtype=np.uint8)).sum(axis=1) >= self.least)


class _Sets:
    """Members of a block by an inverted index of their sets."""

    def __init__(self, raw: list[bytes], percent: int) -> None:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        values, self.n, self.percent = np.concatenate(sets), np.array([len(x) for x in sets]), percent
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]
        self.unique, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))

    def found(self, raw: bytes) -> np.ndarray:
        own = np.frombuffer(raw, dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.unique, own), len(self.unique) - 1)
        at = at[self.unique[at] == own]
        lens = self.first[at + 1] - self.first[at]
        flat = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum()) if len(at) else np.zeros(0, dtype=np.int64)
        common = np.bincount(self.owner[flat], minlength=len(self.n))
        return np.flatnonzero(100 * common >= self.percent * (self.n + len(own) - common))


def _compare(full: DataFrame, kind: type, percent: int) -> DataFrame:
    """Each block's minority against its members: by signature, the members with a possible partner in another component
    (a; b null), each once a task; by sets, pairs of linked components (a, b), each once a block."""
    member = full.select("p", _part("s", 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("xb"), F.lit(0).alias("side"), "a", "label", "data")
    query = full.where("label <> major").select("p", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("block"), _part("x", 2).alias("xb"), F.lit(1).alias("side"), "a", "label", "data")
    by_sets = kind is _Sets

    def make():
        state: dict = {"key": None}
        told: set[int] = set()

        def each(c):
            for p, block, xb, side, a, lab, raw in zip(c["p"], c["block"], c["xb"], c["side"], c["a"], c["label"], c["data"], strict=True):
                if state["key"] != (p, block, xb):
                    state.update(key=(p, block, xb), ids=[], labels=[], raw=[], index=None, said=set())
                if side == 0:
                    state["ids"].append(a), state["labels"].append(lab), state["raw"].append(bytes(raw))
                    continue
                if not state["ids"]:
                    continue
                state["index"] = state["index"] or kind(state["raw"], percent)
                for i in state["index"].found(bytes(raw)):
                    other = state["labels"][i]
                    if other == lab:
                        continue
                    if by_sets:
                        pair = min(lab, other), max(lab, other)
                        if pair not in state["said"]:
                            state["said"].add(pair)
                            yield pair
                        continue
                    for node in {a, state["ids"][i]} - told:
                        told.add(node)
                        yield node, None

        return each

    dealt = query.unionByName(member).repartition("p", "block", "xb").sortWithinPartitions("p", "block", "xb", "side")
    return map_rows(dealt, make, "a long, b long")
