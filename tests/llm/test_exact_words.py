"""Repeats and contamination are decided by words, whatever hashes say."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meshlark.llm import decontaminate, substrings, textwords

from .test_text_operators import contaminated, kept, lower


def thue_morse(bits):
    return "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))


ONE = thue_morse(10)
TWO = ONE.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    head = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{head} {ONE}"), (2, f"{head} {TWO}"), (3, f"{head} {ONE}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
    tests = spark.createDataFrame([("x", ONE)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, tests).collect()} == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_hits_with_weak_hashes(monkeypatch, bits):
    if bits < 64:
        strong = textwords.word_hashes
        monkeypatch.setattr(textwords, "word_hashes", lambda *a: strong(*a) & np.uint64((1 << bits) - 1))
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "cc", "dddddddddd", "é" * 40, "Q"])
    texts = {i: " ".join(word() for _ in range(rng.randrange(60))) for i in range(40)}
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 20])))) for i in range(8)]
    phrases = decontaminate.Phrases([str(i) for i, _ in items], [t for _, t in items], 3)
    shard = list(textwords.words_of(pa.array(list(texts.values())), textwords.FOLDED))
    hit, bounds, owners = decontaminate._hits(shard, phrases)
    want = contaminated(texts, items, 3)
    for i in texts:
        assert int(hit[bounds[i] : bounds[i + 1]].sum()) == want[i][1] and len(owners[i]) == want[i][2]


def test_words_hash_by_their_bytes():
    text = "Ab ab aB " + "x" * 63 + " " + "x" * 64 + " " + "x" * 65 + " " + "x" * 65 + " é é"
    [w] = textwords.words_of(pa.array([text]), textwords.FOLDED)
    said = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)] == said
    groups = Counter(zip(said, w.hashes.tolist()))
    assert len(groups) == len(set(said)) == len(set(w.hashes.tolist()))


def test_links_extend_as_far_as_words_agree():
    words = [b"%d" % i for i in range(100)]
    other = [*words[:20], b"x", *words[21:60], b"y"]
    said = b" ".join(other[: 64 + 13])
    gone, open_ = substrings.extend(words, [{"diagonal": 0, "block": 0, "at": 1 | 1 << 21 | 1 << 54, "said": said}], 13)
    assert gone == [(0, 20), (21, 60)] and open_ == set(range(15, 21)) | set(range(48, 55))


def test_random_texts_of_few_words(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    texts = {}
    for d in range(120):
        words = []
        while len(words) < rng.choice([0, 12, 13, 50, 300]):
            at, size = rng.randrange(400), rng.choice([3, 12, 13, 14, 30, 90])
            words += base[at : at + size] + ([f"u{d}"] if rng.random() < 0.3 else [])
        texts[d] = " ".join(words)
    texts[200] = texts[201] = " ".join(["same"] * 5000)
    texts[202] = "\n".join(["a line that stands here again and again"] * 900)
    for window in (13, 7):
        got = substrings.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window=window).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == kept(texts, window)


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(f"{rng.randrange(10**6)}" for _ in range(400_000))
    texts = {1: long, 2: "start " + long[: len(long) // 2], 3: "z" * 3_000_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == kept(texts)
    item = " ".join(long.split()[5000:5020])
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["n_hit"] for r in found} == {1: 20, 2: 20, 3: 0}
