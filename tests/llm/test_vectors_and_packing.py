"""Vector codes, hard negatives and packing against brute force, and on odd rows."""

import functools
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlark.llm import hard_negatives, packing, vector_codes
from meshlark.llm.queries import op13_packing

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def nearest(entries, query):
    d = ((entries - query) ** 2).sum(axis=1)
    return int(d.argmin()), int(d.min())


def test_orchard_finds_the_nearest_with_ties_to_the_lower_index():
    rng = np.random.default_rng(1)
    for size in (1, 2, 9, 64):
        # few values, so that distances tie and entries repeat
        entries = rng.integers(-3, 4, (size, 4))
        queries = rng.integers(-5, 6, (500, 4))
        index, distance = vector_codes.Orchard(entries).search(queries)
        assert [(int(i), int(d)) for i, d in zip(index, distance)] == [nearest(entries, q) for q in queries]


def coded(rows, parts=16, entries=64, rounds=2):
    """By the definition, one vector after another."""
    kept = [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [[math.floor(256 * c) for c in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = np.array(whole).reshape(len(whole), parts, width)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = cut[first].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        found = [[nearest(books[p], q[p]) for p in range(parts)] for q in cut]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [q[p] for q, f in zip(cut, found) if f[p][0] == e]
                if own:
                    books[p, e] = [int(sum(int(x[w]) for x in own)) // len(own) for w in range(width)]
    return {(k[0], "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for k, f in zip(kept, found)}, books


def odd_vectors(n=150, length=32):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(length)], r.choice([0, 0, 0, 1, 2, None])) for i in range(n)]
    rows += [(1000, None, 1), (1001, [None] * length, 1), (1002, [float("nan")] * length, 2), (1003, [float("inf")] + [0.0] * (length - 1), 2), (1004, [], 1), (1005, [1.0], 1)]
    return rows + [rows[7], (None, rows[8][1], 0), (2000, [0.5] * length, None), (2001, [0.5] * length, None)]


def test_codes_equal_the_definition(spark):
    rows = odd_vectors()
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    want, books = coded([r for r in rows if r[0] != 1005])
    assert {(r.vec_id, r.code, r.error) for r in got} == want
    assert len(got) == 150 + 4
    labels = {r[0]: r[2] for r in rows}
    for label in (0, 1, 2, None):
        own = [r for r in got if labels[r.vec_id] == label]
        assert {r.label_error for r in own} == {sum(r.error for r in own)}
    assert {r.codebooks_sha256 for r in got} == {vector_codes.codebooks_digest(books)}


def test_codes_decode_to_their_entries(spark):
    rows = spark.createDataFrame(odd_vectors(), VECTORS)
    books = vector_codes.train(rows, entries=16)
    for r in vector_codes.decode(vector_codes.encode(rows, books), books).collect():
        assert r.approximation == [x / 256 for p, e in enumerate(r.codes) for x in books[p, e].tolist()]


def test_codes_of_few_uneven_or_huge_vectors(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, [float("nan")], 0)], VECTORS)).collect() == []
    one = vector_codes.compress(spark.createDataFrame([(1, [0.1] * 20, 0)], VECTORS)).first()
    assert (one.code, one.error, one.label_error) == ("00" * 16, 0, 0)  # 20 components fill ten parts of two
    huge = vector_codes.compress(spark.createDataFrame([(1, [1e38] * 16, 0), (2, [-1e38] * 16, 0)], VECTORS)).collect()
    assert [r.error for r in huge] == [0, 0]
    clash = spark.createDataFrame([(1, [0.1] * 16, 0, "x", 5)], VECTORS + ", code string, __label int")
    assert vector_codes.compress(clash).count() == 1


def mined(rows, every, positives=5, negatives=10, low=30, high=90):
    out = set()
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    for i, v, label in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out |= {(i, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)}
    return out


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_negatives_equal_the_definition(spark, block):
    r = random.Random(5)
    # few distinct components: scores tie, and windows share limits
    rows = [(i, [r.choice([-0.01, 0.0, 0.004, 0.01]) for _ in range(8)], r.choice([0, 0, 0, 1, 2])) for i in range(-40, 400)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(6)
    got = hard_negatives.mine(frame, every=20, block=block).collect()
    want = mined([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows], 20)
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert len({x[0] for x in want}) > 5


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 1), (2, [0.5, 0.0], 1), (3, [0.6, 0.0], None), (None, [0.6, 0.0], 1), (4, [0.6, None], 1)]
    rows += [(5, None, 1), (6, [float("nan"), 0.0], 1), (7, [0.5], 1), (8, [0.95, 0.0], 1), (9, [0.29, 0.0], 1), (10, [0.3, 0.0], 2), (11, [0.9, 0.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()
    one = 65536
    # 0.3 and 0.9 of one are 76 and 230 of 256 here, below the lower and within the upper limit
    assert [tuple(x) for x in sorted(got, key=lambda x: x.rank)] == [(0, 1, 1, 11, one, 230 * 256), (0, 1, 2, 2, one, 128 * 256)]
    # of rows with one id the smallest label, then vector, counts
    twice = [*rows, (11, [0.8, 0.0], 1)]
    assert [x.negative_score for x in hard_negatives.mine(spark.createDataFrame(twice, VECTORS)).orderBy("rank").collect()] == [204 * 256, 128 * 256]
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(rows[:2], VECTORS)).count() == 0
    huge = [(0, [1e38] * 2, 0), (1, [1e38] * 2, 0), (2, [1e38, 0.0], 1)]
    most = vector_codes.bound(2)
    assert [(x.positive_score, x.negative_score) for x in hard_negatives.mine(spark.createDataFrame(huge, VECTORS)).collect()] == [(2 * most * most, most * most)]


@functools.cache
def loaded(tokenizer):
    t = Tokenizer.from_str(tokenizer)
    t.encode_special_tokens = True
    return t


def whole(tokenizer, text):
    return loaded(tokenizer).encode(text, add_special_tokens=False).ids


def test_tokens_are_those_of_the_library(tokenizer):
    r = random.Random(7)
    bits = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", "\u00a0", "\u3000 ", "\x1c ", "\x85", "a", "don't", "é", "12", "!?", "<|endoftext|>", "日本", "🙂", "_", "'s", "x" * 60]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = f.read()
    assert packing._ranks(json.loads(tokenizer)) and packing._ranks(json.loads(other)) is None
    for given in (tokenizer, other):
        encode = packing.encoder(given)
        for _ in range(300):
            text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
            assert np.frombuffer(encode(text), "<u4").tolist() == whole(given, text), repr(text)


def test_cuts_leave_little_of_a_share_empty():
    for n in range(1, 3000):
        made = packing.cuts(n)
        assert sum(made) == n and min(made) > 0
        for length in made:
            share = packing.CAPACITY // (packing.CAPACITY // length)
            assert (share - length) * packing.SLACK <= share
        assert len(made) <= n // packing.CAPACITY + 5


def check_packed(rows, capacity=packing.CAPACITY):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return {k: sum(n for _, n in v) for k, v in at.items()}


def test_packing_of_all_documents(spark, tokenizer):
    rows = op13_packing(spark, SF).collect()
    lengths = check_packed(rows)
    docs = {r.doc_id: whole(tokenizer, r.text or "") + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
    assert set(parts) == set(docs)
    for doc, ids in docs.items():
        end = 0
        for r in sorted(parts[doc], key=lambda r: r.start):
            piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (end, len(ids), zlib.crc32(piece))
            end += r.length
        assert end == len(ids)
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in lengths.values())
    assert padded <= 1.005 * sum(lengths.values())


def test_tasks_share_what_they_are_left_with(spark):
    r = random.Random(9)
    lengths = [r.choice([1, 2, 3, 17, 100, 300, 341, 500, 512, 700, 1024]) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "piece long, length long").repartition(40)
    rows = packing.pack(pieces).collect()
    assert sorted((r.piece, r.length) for r in rows) == sorted(enumerate(lengths))
    full = check_packed(rows)
    assert len(full) <= 1.35 * sum(lengths) / 1024  # pieces of 500 and 700 as they are
    assert packing.pack(pieces.where("length = 0")).count() == 0


def test_packing_odd_documents(spark, tokenizer):
    long = "word " * 40_000 + "x" * 30_000
    rows = [(1, None, 5), (1, "", 6), (None, "two words", 7), (4, long, 8), (5, "two words", 9), (5, "two words", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    pieces = packing.tokenize(docs, tokenizer)
    packed = packing.pack(pieces).collect()
    check_packed(packed)
    by = {}
    for r in packed:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(len(v) for k, v in by.items() if k[0] == 1) == [2]
    assert len(by[5, 3]) == 2 and len(by[None, 3]) == 1
    got = b"".join(bytes(r.ids) for r in sorted(packed, key=lambda r: r.start) if r.doc_id == 4)
    assert np.frombuffer(got, "<u4").tolist() == [*whole(tokenizer, long), 0]
    assert packing.pack(packing.tokenize(docs.where("doc_id = 77"), tokenizer)).count() == 0


def test_sequences_hold_their_pieces(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "one two three"), (3, None)], "doc_id long, text string")
    packed = packing.pack(packing.tokenize(docs, tokenizer))
    made = packing.sequences(packed).collect()
    rows = {r.sequence_id: [] for r in packed.collect()}
    for r in packed.collect():
        rows[r.sequence_id].append(r)
    for s in made:
        ids = [x for r in sorted(rows[s.sequence_id], key=lambda r: r.offset) for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert s.input_ids[: len(ids)] == ids and not any(s.input_ids[len(ids) :])
        assert len(s.input_ids) == (len(ids) if len(ids) & (len(ids) - 1) == 0 else 1024)
        assert s.doc_starts == sorted(r.offset for r in rows[s.sequence_id])
