"""Labels of the registered query with its own parameters, rare languages among them."""

import random

from meshlark.llm import language, queries


def test_rare_languages(spark, tmp_path):
    """Seventy languages of five documents each, beside one of six thousand, and one text copied a thousand times."""
    r = random.Random(9)

    def prose(letters, words):
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(words))

    rows, own = [], {}
    for k in range(70):
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(100 * k + i, prose(letters, 80), f"x{k:02d}", "a") for i in range(5)]
        own[100 * k + 9] = f"x{k:02d}"
        rows.append((100 * k + 9, prose(letters, 80), None, "a"))
    common = r.sample("abcdefghijklmnopqrstuvwxyz", 12)
    rows += [(10_000 + i, prose(common, 20), "en", "a") for i in range(6000)]
    rows += [(20_000 + i, prose("abc", 1) and "same words again " * 5, "en", "a") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://h.example/", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x["doc_id"]: x for x in queries.op9_language(spark, str(tmp_path)).collect() if x["doc_id"] is not None}
    assert len(got) == len(rows)
    wrong = {d: (got[d]["lang"], want) for d, want in own.items() if got[d]["lang"] != want or not got[d]["accepted"]}
    assert len(wrong) <= 2, wrong
    assert sum(got[10_000 + i]["lang"] == "en" for i in range(6000)) >= 5900
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {x["doc_id"] for x in language.drop_unidentified(docs).collect()}
    assert len(set(own) & kept) >= 68


def test_given_labels_with_few_rows(spark, documents):
    """Spanish has 17 rows here."""
    languages, _ = language.train(documents.select("text", "lang"))
    assert languages == sorted(x["lang"] for x in documents.where("lang IS NOT NULL").select("lang").distinct().collect())
