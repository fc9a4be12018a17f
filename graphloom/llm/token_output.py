"""Token-ID output: ids in ascending document order, Huffman-coded in blocks with bit-offset checkpoints."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, row_base, scratch
from .huffman import Code, code_lengths

#: Ids in one independently decodable block, and ids (about) in one segment.
BLOCK, SEGMENT = 256, 1 << 18
#: Longest code in bits; 49,408 ids need 16.
LIMIT = 20
#: Distinct pieces of text whose ids a task keeps (about 150 bytes each, 60 MB), and those of them that stay when it is full.
CACHE, STAY = 400_000, 200_000
_LETTERS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
#: Fixed value: the pre-token pattern of the word tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MAGIC, _HEAD = b"GLTK", "<4sHHIQQQQ"


class Known(dict):
    """A dictionary that learns what it is asked for."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        self[key] = value = self.learn(key)
        return value

    def trim(self, most: int, stay: int) -> None:
        """With more than ``most`` entries, only the ``stay`` first learnt remain: frequent keys come early."""
        if len(self) > most:
            first = list(islice(self.items(), stay))
            self.clear()
            self.update(first)


class WordEncoder:
    """Ids of whole texts; where the tokenizer allows, by way of pieces without white space, CACHE of them remembered.

    It does if its file says that it lower-cases, drops white space and never joins text across it (``by_words``). A piece
    of Latin letters is then one pre-token, so it goes to the library's model at once, in the byte alphabet; a run of ASCII
    marks at its end (but an apostrophe) is a pre-token of its own. Any other piece goes through the whole library, as does
    every text where the tokenizer is of another kind.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.kind = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.by_words = by_words(tokenizer_path)
        self.known = Known(self._learn)

    def _model(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_ALPHABET)
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace").lower()
        plain = _LETTERS.fullmatch(text)
        if plain is None:
            return self._whole(piece.decode("utf-8", "replace"))
        marks = plain[2]
        if not marks:
            return self._model(text)
        return self.known[text[: -len(marks)].encode()] + self.known[marks.encode()]

    def encode(self, text: str) -> list[bytes]:
        if not self.by_words:
            return [self._whole(text)]
        self.known.trim(CACHE, STAY)
        raw = text.encode("utf-8", "surrogatepass")
        pieces = (raw if b"<|" in raw else raw.lower()).split()  # special strings are told by their case
        return list(map(self.known.__getitem__, pieces))


def by_words(tokenizer_path: str) -> bool:
    """Does the file describe a byte-level BPE with word ends over lower-cased runs of letters or of marks?"""
    with open(tokenizer_path, encoding="utf-8") as f:
        said = json.load(f)
    steps = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
    cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = cuts[0].get("pattern", {}).get("Regex") if len(cuts) == 2 and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed" else None
    level = len(cuts) == 2 and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("use_regex", True) and not cuts[1].get("add_prefix_space", True)
    special = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") for t in said.get("added_tokens") or [])
    return bool(steps == ["NFC", "Replace", "Lowercase"] and split == WORDS and level and special and not (said.get("post_processor") or said.get("truncation") or said.get("padding")))


_ENCODERS: dict[str, WordEncoder] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """``docs(doc_id, text)`` to rows ``(doc_id, ids, counts)``: the ids of each whole text as little-endian unsigned integers.

    Each piece between white space is encoded once while a task remembers it (see ``WordEncoder``) and the pieces' ids are
    joined. Ids take two bytes if the vocabulary allows, else four. Null is an empty text. ``end_id`` follows each
    document. A task's last row has null ids and, in ``counts``, how often it met each id (64-bit).
    """

    def make():
        # a worker keeps the encoder, whose size is that of the vocabulary; what it remembers goes with the task
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        end = b"" if end_id is None else array(encoder.kind, [end_id]).tobytes()
        total = np.zeros(encoder.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)

        def each(c):
            for doc, text in zip(c["doc_id"], c["text"], strict=True):
                ids = b"".join(encoder.encode(text or "")) + end
                held.append(ids)
                yield doc, ids, None
            fold()

        held: list[bytes] = []

        def fold() -> None:
            np.add(total, np.bincount(np.frombuffer(b"".join(held), dtype=encoder.kind), minlength=len(total)), out=total)
            held.clear()

        def close():
            encoder.known.clear()
            if total.any():
                yield None, None, total.tobytes()

        each.close = close
        return each

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids binary, counts binary", flush=500)


def id_type(vocabulary: int) -> str:
    """Two or four bytes (``array`` and numpy name them alike; this machine's order is little-endian)."""
    return "H" if vocabulary <= 1 << 16 else "I"


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def global_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of every id over all documents, from the tasks' own counts; one row per id and task is shuffled."""

    def make():
        total = np.zeros(vocabulary, dtype=np.int64)

        def each(c):
            for counts in c["counts"]:
                np.add(total, np.frombuffer(counts, dtype=np.int64), out=total)
            return ()

        def close():
            for i in np.flatnonzero(total):
                yield int(i), int(total[i])

        each.close = close
        return each

    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in map_rows(tokens.where("ids is null").select("counts"), make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def pack(docs: list[tuple[int | None, np.ndarray]], code: Code, first: int) -> bytes:
    """One segment: header, document ids and lengths, block checkpoints, payload. ``first``: ids before it in its shard."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, dtype=np.uint32)
    payload, offsets = code.encode(ids, BLOCK)
    names = np.array([0 if d is None else d for d, _ in docs], dtype="<i8").tobytes()
    nulls = bytes(d is None for d, _ in docs)
    lengths = np.array([len(x) for _, x in docs], dtype="<u8").tobytes()
    head = struct.pack(_HEAD, _MAGIC, 1, BLOCK, 0, len(docs), len(ids), first, len(payload))
    body = names + nulls + lengths + offsets.astype("<u8").tobytes() + payload
    return head + body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes, code: Code) -> tuple[list[tuple[int | None, np.ndarray]], int]:
    """The documents of a segment and the number of ids before it in its shard."""
    magic, version, block, _, n_docs, n_ids, first, size = struct.unpack_from(_HEAD, data)
    body = data[struct.calcsize(_HEAD) : -4]
    if magic != _MAGIC or version != 1 or zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole segment")
    at = 0

    def read(n: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    names, nulls, lengths = read(n_docs, "<i8"), read(n_docs, "u1"), read(n_docs, "<u8").astype(np.int64)
    offsets = read(-(-n_ids // block), "<u8")
    ids = code.decode(body[at : at + size], n_ids, offsets, block)
    ends = np.cumsum(lengths)
    return [(None if nulls[i] else int(names[i]), ids[ends[i] - lengths[i] : ends[i]]) for i in range(n_docs)], first


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None) -> None:
    """Tokenise ``docs(doc_id, text)`` and write the token files under ``path``.

    ``path/code`` holds the code length of each id (one row), ``path/segments`` rows ``(shard, segment, data)``:
    every ``data`` is a whole segment (see ``pack``) and decodes alone. Shards are ranges of doc_id, ascending (null
    first), segments ascend inside a shard. Spark's committer writes both, so a lost task leaves no part behind.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary_size(tokenizer_path)
    kind = id_type(vocabulary)
    tokens = materialise(tokenize(docs, tokenizer_path, end_id), "tokens")
    lengths = code_lengths(global_counts(tokens, vocabulary), LIMIT)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def make():
        code = Code(shared.value)
        shard = row_base() >> 33
        state = {"docs": [], "n": 0, "segment": 0, "first": 0}

        def flush():
            data = pack(state["docs"], code, state["first"])
            row = shard, state["segment"], data
            state.update(docs=[], n=0, segment=state["segment"] + 1, first=state["first"] + state["n"])
            return row

        def each(c):
            for doc, raw in zip(c["doc_id"], c["ids"], strict=True):
                ids = np.frombuffer(raw, dtype=kind)
                state["docs"].append((doc, ids))
                state["n"] += len(ids)
                if state["n"] >= SEGMENT or len(state["docs"]) >= SEGMENT:
                    yield flush()

        def close():
            if state["docs"]:
                yield flush()

        each.close = close
        return each

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.where("ids is not null").select("doc_id", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    map_rows(dealt, make, "shard long, segment long, data binary", flush=1).write.parquet(f"{path}/segments")
    discard(tokens)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, decoded from the files under ``path``.

    ``start`` counts the ids of all documents before: in the shard from the segments' headers, plus the totals
    of the shards before (one number per shard on the driver).
    """
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{path}/code").first().lengths), dtype=np.uint8)
    segments = spark.read.schema("shard long, segment long, data binary").parquet(f"{path}/segments")
    shared = spark.sparkContext.broadcast(lengths)

    def make():
        code = Code(shared.value)

        def each(c):
            for shard, data in zip(c["shard"], c["data"], strict=True):
                found, at = unpack(bytes(data), code)
                for doc, ids in found:
                    raw = ids.astype("<u4").tobytes()
                    yield shard, doc, at, len(ids), zlib.crc32(raw), *([raw] if with_ids else [])
                    at += len(ids)

        return each

    rows = map_rows(segments.select("shard", "data"), make, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids, flush=1000)
    rows = materialise(rows, "decoded")
    totals = {r.shard: r.n for r in rows.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect()}
    before, offsets = 0, []
    for shard in sorted(totals):
        offsets.append((shard, before))
        before += totals[shard]
    base = spark.createDataFrame(offsets, "shard long, before long")
    out = rows.join(F.broadcast(base), "shard")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (under ``path`` or in the shared folder) and read them back.

    Returns ``doc_id, start, n_tokens`` (with the end id), ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit integers). Null and empty texts have the end id alone; a null id comes first; rows with one id
    follow each other in the order of their ids' bytes; an empty table writes an empty set of files. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path)
