"""The pipeline, stage by stage, against brute force."""

import re

import corpus_pipeline
from tests.llm.test_text_operators import PII, SF, contaminated, lower, spans


def similar_groups(texts, shingle=5, similarity=0.8):
    """The smallest id of each document's group, by comparing all pairs of shingle sets."""
    sets = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        size = min(shingle, len(words))
        sets[d] = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    root = {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def test_stages(spark, documents, texts, tmp_path):
    docs, columns = documents, documents.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert len(seen[name]) == docs.count()
    assert set(seen["language_id"]) == {d for d, t in texts.items() if re.search(r"[^\W\d_]{3}", t)}
    group = similar_groups({d: texts[d] for d in seen["language_id"]})
    assert set(seen["near_duplicates"]) == set(group.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, x in contaminated({d: texts[d] for d in group.values()}, items).items() if x[4]}
    assert bad and set(seen["decontamination"]) == set(seen["near_duplicates"]) - bad
    assert set(seen["personal_data"]) == set(seen["decontamination"])
    for d, r in seen["personal_data"].items():
        assert r["n_chars"] == len(r["text"]) and not spans(r["text"], PII)
        if not spans(texts[d], PII):
            assert r["text"] == texts[d]
    mixed = seen["mixture"]
    assert set(mixed) <= set(seen["personal_data"]) and all(0 < r["taken"] <= 2 * r["size"] for r in mixed.values())
    whole = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in seen["personal_data"].values())
    assert abs(sum(r["taken"] for r in mixed.values()) - 1.5 * whole) <= 25


def test_run(spark):
    first, second = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == second


def test_stages_of_odd_and_empty_tables(spark, odd, empty):
    """Every stage takes odd rows and none; all but the last keep the columns, clashing ones too."""
    for docs in (odd, empty):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
