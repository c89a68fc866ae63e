"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

from meshlark.llm import simhash
from tests.llm.test_text_operators import lower


def shingles(text, size=5):
    words = lower(text or "").split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def kept(texts):
    root, sets = {d: d for d in texts}, {d: shingles(t) for d, t in texts.items()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {top(d) for d in ids}


def edited(r, words, changes):
    words = list(words)
    for i in r.sample(range(len(words)), changes):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def stage(spark, texts):
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    found = [r["doc_id"] for r in out.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_given_documents(spark, texts):
    assert stage(spark, texts) == kept(texts)


def test_edited_copies(spark):
    """Copies on both sides of the threshold, and chains; a radius of 3 bits left most of them."""
    r = random.Random(5)
    texts = {}
    for g in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 200, 400]))]
        for k in range(4):
            texts[4 * g + k] = edited(r, words, k * len(words) // 120)
    assert stage(spark, texts) == kept(texts)


def test_large_family(spark):
    """One family of 700 copies, so that buckets are cut in parts; some are linked to a few others only."""
    r = random.Random(6)
    words = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = {d: edited(r, words, r.choice([1, 2, 3, 4, 9])) for d in range(700)}
    assert stage(spark, texts) == kept(texts)


def test_first_links_come_from_fingerprints(spark, monkeypatch):
    """Copies whose fingerprints differ in at most 3 bits are linked by BK-trees, before any band of min-hashes is looked at."""
    r = random.Random(7)
    texts = {}
    for g in range(20):
        words = [f"w{r.randrange(5000)}" for _ in range(600)]
        texts[2 * g], texts[2 * g + 1] = " ".join(words), edited(r, words, 1)
    prints = {d: simhash.simhash(t) for d, t in texts.items()}
    near = {2 * g for g in range(20) if (prints[2 * g] ^ prints[2 * g + 1]).bit_count() <= 3}
    linked, verified = [], []
    links, check = simhash.links, simhash._verified
    monkeypatch.setattr(simhash, "links", lambda *a: linked.append(links(*a)) or linked[-1])
    monkeypatch.setattr(simhash, "_verified", lambda *a: verified.append(check(*a)) or verified[-1])
    assert stage(spark, texts) == kept(texts)
    assert len(near) > 10 and linked[0].count() >= len({prints[d] ^ prints[d + 1] and d for d in near} - {0})
    assert verified[0].count() == len(near)


def test_components_of_paths_and_stars(spark):
    """A path in bad order, a star whose centre is largest, loops and repeated edges: least nodes, in few rounds."""
    r = random.Random(8)
    names = r.sample(range(1000, 9000), 700)
    edges = [*zip(names, names[1:])] + [(i, 999) for i in range(300, 600)] + [(5, 5), (7, 6), (6, 7), (6, 7)]
    got = {x["node"]: x["label"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(names, min(names)) | dict.fromkeys([999, *range(300, 600)], 300) | {6: 6, 7: 6}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
