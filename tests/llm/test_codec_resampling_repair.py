"""The sentencepiece codec, importance resampling and conversation repair: awkward rows, none, and brute force."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversation_repair as R
from graphloom.llm import piece_codec as P
from graphloom.llm import queries as Q
from graphloom.llm import resampling as W

from .conftest import rows

MODEL = Q.vocabulary_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.PieceModel(MODEL)


def _library_ids(model, text):
    return struct.pack(f"<{(n := len(ids := [1, *model.library.encode(text or ''), 2]))}I", *ids), n


def test_codec_equals_library(spark, docs, none, model):
    odd = ["a�▁\x00​😀 x\0y 日本語 ", "  a  b ", "\n\n", "▁", "▁▁x", " ", "\0", "x" * 5000, "ab" * 3000, "<s> </s> <0x0A>", "tab\tand\r\nlines \n x"]
    odd += ["".join(random.Random(i).choices("ab .▁é\n日€x'", k=40)) for i in range(200)]
    texts = [(d, t) for d, t, *_ in rows()] + list(enumerate(odd, 1000))
    got = P.piece_codec(spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumn("ids", F.lit("clash")), MODEL).collect()
    want = Counter((d, _library_ids(model, t)[0], (t or "").replace("▁", " ")) for d, t in texts)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert not any(r.n_differ for r in got)
    assert P.piece_codec(docs, MODEL).count() == len(rows()) and P.piece_codec(none, MODEL).count() == 0


def test_agenda_alone_and_beside_others(model):
    """Ties go to the leftmost pair; both forms of the agenda agree with each other and with the library."""
    rng = random.Random(4)
    chunks = [P.MARK + "".join(rng.choices("aeinrst.", k=rng.randint(1, 23))) for _ in range(3000)] + [P.MARK + "a" * k for k in range(1, 23)]
    alone = [struct.pack(f"<{len(i)}I", *i) for i in map(model.agenda, chunks)]
    assert model.agendas(chunks) == alone
    assert model._differing(chunks, alone) == []
    assert model._differing(chunks[:2], [alone[0], alone[0]]) == [chunks[1]]


def test_codec_keeps_the_library_where_it_differs(model):
    fresh = P.PieceModel(MODEL)
    fresh.agendas = lambda chunks: [b"\1\0\0\0"] * len(chunks)
    assert set(fresh.learn({"▁the", "▁a"})) == {"▁the", "▁a"}
    assert fresh.recent["▁the"] == struct.pack("<I", model.symbols["▁the"])


def test_codec_forgets_in_generations(model, monkeypatch):
    monkeypatch.setattr(P, "HOLD", 50)
    fresh = P.PieceModel(MODEL)
    for low in range(0, 400, 40):
        words = {f"▁w{i}" for i in range(low, low + 40)} | {"▁always"}
        fresh.learn(words)
        assert words <= set(fresh.recent) and len(fresh.recent) + len(fresh.older) < 250


def test_codec_query(spark, model):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in Q.op11_piece_codec(spark, path).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        ids, n = _library_ids(model, text)
        assert (got[d].n_tokens, got[d].ids_sha256) == (n, hashlib.sha256(ids).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").replace("▁", " ").encode()).hexdigest()


def _words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def _features(text):
    w = _words(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _resampled(docs, target, percent=5, least=20):
    s, t = Counter(f for _, x in docs for f in _features(x)), Counter(f for x in target for f in _features(x))
    total, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (aim + 10_000)))) for b in range(10_000)]
    out = []
    for d, x in docs:
        f = _features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_words(x))])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_brute(spark, docs, none):
    target = spark.createDataFrame([("over there behind the wall",), (None,), ("",)], "text string").withColumn("bucket", F.lit(1))
    got = W.resample(docs, target, percent=40, least_words=8).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = _resampled([r[:2] for r in rows()], ["over there behind the wall", None, ""], 40, 8)
    assert Counter(map(tuple, got)) == want
    assert W.resample(none, target).count() == 0
    assert W.resample(docs, none).count() == len(rows())


def test_resampling_query(spark):
    path = "/root/testdata/sf0.01"
    got = Counter(map(tuple, Q.op12_resampling(spark, path).collect()))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert got == _resampled(docs, [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()])
    assert sum(r[4] is not None for r in got) == 5 * sum(len(_words(t)) >= 20 for _, t in docs) // 100


def test_automaton_over_slices_blocks_and_long_words(monkeypatch):
    monkeypatch.setattr(W, "LANES", 7)
    texts = ["", None, "Ab1 cd-é,x", "x" * 300 + " y", "é" * 100 + "ß " + "q" * 49, "A B", "a", "-", "no end", "start" + " w" * 50, "K" * 48 + " " + "K" * 47]
    data, offsets = W.text_bytes(pa.array(["skipped", *texts]).slice(1))
    found = [[] for _ in texts]
    for rows_, buckets in W.run_buckets(data, offsets, 3, 10_000):
        for i, b in zip(rows_.tolist(), buckets.tolist(), strict=True):
            found[i].append(b)
    assert [sorted(f) for f in found] == [sorted(_features(t)) for t in texts]
    assert np.array_equal(W.text_bytes(pa.array(["é", None, "a"], pa.large_string()))[1], [0, 2, 2, 3])


def _cheapest(kinds):
    """(audit, cost) by Dijkstra over (cost, audit)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(kinds) and state in (0, 3):
            return audit, cost
        if (at, state) in done:
            continue
        done.add((at, state))
        turned = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", at, turned))
        if at < len(kinds):
            initial, fault = kinds[at] >> 2, kinds[at] & 3
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if fault in (0, 3):
                kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, initial))
                if kept is not None:
                    heapq.heappush(heap, (cost + fault, audit + "K", at + 1, kept))
                heapq.heappush(heap, (cost + 3 + fault, audit + "R", at + 1, turned))


def test_layers_equal_dijkstra_however_rows_are_cut():
    rng = random.Random(3)
    for _ in range(4000):
        n = rng.randint(0, 11)
        kinds = bytes(rng.randrange(4) * 4 + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        cuts = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 3)))), n] if n > 1 else [0, n]
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if n else []
        after, behind = [0 if s in R.ACCEPTING else R.NEVER for s in range(4)], []
        for part in reversed(parts):
            behind.append(after)
            m = R.span_costs(part)
            after = [min(min(m[s][e] + after[e] for e in range(4)), R.NEVER) for s in range(4)]
        state, audit, total = 0, "", 0
        for i, (part, rest) in enumerate(zip(parts, reversed(behind), strict=True)):
            letters, state_after, cost = R.trace(part, rest, range(4))[state]
            audit, state, total = audit + letters, state_after, cost if i == 0 else total
        assert (audit, total) == _cheapest(kinds)


def _repaired(conversation):
    """Of rows (turn, role, text) after damage, in order: the contract's columns by plain steps."""
    seen, kinds, faults = set(), [], Counter()
    for _, role, text in conversation:
        body = text.rstrip("\t\n\x0b\f\r ")
        fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
        seen.add((role, text))
        faults[fault] += 1
        kinds.append(("sua".index(role[0]) if role[:1] and role[0] in "sua" else 3) * 4 + fault)
    turns = [t for t, *_ in conversation if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(conversation, conversation[1:], strict=False))
    audit, cost = _cheapest(bytes(kinds))
    out, state, at = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else conversation[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        state = {"s": 1, "u": 2, "a": 3}[role[0]] if letter == "K" else 3 if state == 2 else 2
        out.append((role if letter == "K" else "user" if state == 2 else "assistant") + ":" + text)
    return gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _ordered(conversation, conv):
    digest = lambda r, t: hashlib.sha256(f"{'null' if conv is None else conv}:{len(r)}:{r}:{t}".encode()).digest()[:16]
    return sorted(conversation, key=lambda x: (x[0] is not None, x[0] or 0, digest(*x[1:])))


def _brute(data, ids):
    by = {i: [] for i in ids}
    for conv, turn, role, text in data:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return Counter((c, *_repaired(_ordered(x, c))) for c, x in by.items())


def _got(spark, data, ids):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    for clash in ("digest", "kind", "n", "k", "audit", "least"):
        df = df.withColumn(clash, F.lit("clash"))
    heads = R.conversation_digests(R.repair_conversations(df, spark.createDataFrame([(i,) for i in ids], "conv_id long")))
    return Counter(tuple(r) for r in heads.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


def test_repair_brute(spark):
    rng = random.Random(9)
    data = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(0, 9)):
            row = (conv, rng.choice([turn, turn, turn, None, 40]), rng.choice(["user", "assistant", "assistant", "user", "system", None, "", "tool", "usr"]), rng.choice(["Yes.", "No!", "cut", None, "", " \n", "So? \t", "long " * 200 + ".", f"own {turn}."]))
            data += [row] * rng.choice([1, 1, 1, 2])
    ids = [None, *range(63)]
    assert _got(spark, data, ids) == _brute(data, ids)
    assert _got(spark, [], [5]) == _brute([], [5])
    assert not _got(spark, [], [])


def test_repair_of_a_conversation_in_many_tasks(spark):
    """One conversation of 3,000 rows among small ones, dealt over 16 ranges."""
    rng = random.Random(2)
    data = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"own {t}.", f"own {t}!", f"two {t}?"])) for t in range(3000)]
    data += [(c, t, "assistant" if t % 2 else "user", f"{t}.") for c in (1, 9) for t in range(5)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert R.spans(R.row_kinds(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).where("conv_id = 7").count() > 8
        assert _got(spark, data, [1, 7, 9]) == _brute(data, [1, 7, 9])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repair_query(spark):
    path = "/root/testdata/sf0.01"
    data, ids = [], set()
    for r in spark.read.parquet(f"{path}/conversations.parquet").collect():
        ids.add(r.conv_id)
        fault = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r.text) if fault == 2 else r.text
        data += [(r.conv_id, r.turn, "user" if fault == 4 else r.role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert Counter(map(tuple, Q.op13_conversation_repair(spark, path).collect())) == _brute(data, ids)


def test_damage_takes_nulls_for_blanks(spark):
    data = [(c, t, None, None) for c in (1, None) for t in (None, 1, 2, 3, 4, 5)]
    got = R.damaged(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    text = lambda v: " " if v is None else str(v)
    assert len(got) == sum({0: 0, 3: 2}.get(zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20, 1) for c, t, *_ in data)
    assert all(r.role in (" ", "user") and r.text in (" ", "") for r in got)
