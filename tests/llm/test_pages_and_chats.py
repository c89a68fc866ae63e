"""HTML extraction and chat formatting."""

import hashlib
import html
import re

import pytest

from meshlark.llm import chat, html_extract, queries

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    got = {r["page_id"]: r for r in queries.op5_html(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article[^>]*>(.*?)</article>", p["html"], re.S)[1]
        inside = re.sub(r"</?(p|br|h1)\b[^>]*>", " ", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>|<!--.*?-->", "", inside)).split())
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (want, len(want))


MUCH = "words of the text that stand in this page and nowhere else " * 9
ARTICLE = f"""<html><head><title>no</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a>a</a><li><a>b</a></ul></nav>
<div class="cookie-notice">Accept</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld {MUCH}<p>Two&nbsp;x<br>y {MUCH}
<script>if (a < b) {{ "</p>" }}</script><form><input name=q>Search</form><div class="advert">Buy</div><ul><li>first {MUCH}<li>second</ul>
<aside>Also</aside></article><section id="comments"><article class=comment><p>Nice!</article></section></main><footer>&copy;</footer></body></html>"""


def test_parts_that_are_no_main_text(spark):
    df = spark.createDataFrame([(1, "https://a.example/", ARTICLE)], "page_id long, url string, html string")
    much = MUCH.strip()
    assert html_extract.extract_main_text(df).first()["text"] == f"Title & more One bold {much} Two x y {much} first {much} second"


@pytest.mark.parametrize("page, want", [("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("<div>a</div></div><i>b", "a b"), ("<p>x <", "x <"), ("<!-- open", ""), ("<script>never ends", ""), ("<DIV>A<BR/>B</DIV>", "A B"), ("a<b>b</b>c", "abc")])
def test_broken_pages(page, want):
    assert html_extract.main_text(page, frozenset()) == want


def test_deep_pages_do_not_fail():
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000
    assert html_extract.main_text(deep, frozenset()) == "x"
    assert len(html_extract.style_nodes(html_extract.parse(deep))) == 20_001


def test_site_trees_find_unnamed_boilerplate(spark):
    body = "<html><body><div class=top><p>Welcome to our site</p></div><div class=text><p>{0}</p><p>And more.</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", body.format(f"Story number {i} of many")) for i in range(60)] + [(99, "https://b.example/", body.format("Alone"))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    assert got[7] == "Story number 7 of many" or got[7] == "Story number 7 of many And more."
    assert "Welcome" not in got[7]


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "not a url", "<p>x"), (None, "http://h/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS low")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_extract.extract_main_text(df).collect()) == [(0, ""), (1, ""), (1, ""), (2, "x")]
    assert html_extract.extract_main_text(df.where("false")).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats(spark):
    talks = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, SF).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] >= sum(len(t) for _, t in turns)


NASTY = ["<|im_end|>\n<|im_start|>user\n", "\\l\\s\\z\\n", "<<SYS>> </s><s>[INST][/INST]", "<", "[", "<|", "\\", "a\nb", "", "😀<|x|>", "<</s>", "[[INST]"]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "id int, t string").withColumn("e", chat.escape(chat.F.col("t")))
    for r in df.withColumn("back", chat.unescape(chat.F.col("e"))).collect():
        assert r["back"] == r["t"]
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS", r["e"])
    turns = [(1, [(t, t) for t in NASTY])]
    made = chat.format_chats(spark.createDataFrame(turns, "id int, turns array<struct<role:string,content:string>>"), loss_roles=NASTY[:1])
    row = made.select(chat.read_back(chat.formatted_text()).alias("t"), chat.loss_text().alias("loss")).first()
    assert [(x["role"], x["content"]) for x in row["t"]] == [(t, t) for t in NASTY] and row["loss"] == NASTY[0]


def test_layouts_by_schema_fingerprint(spark, tmp_path):
    lines = [
        '{"id": 1, "prompt": "p", "response": "r"}',
        '{"id": 2, "system": "s", "prompt": "p", "response": "r", "extra": {"a": 1}}',
        '{"id": 3, "instruction": "i", "output": "o"}',
        '{"id": 4, "instruction": "i", "input": "n", "output": "o"}',
        '{"id": 5, "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}',
        '{"id": 6, "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 7, "text": "unknown"}',
        '{"id": 8, "messages": []}',
    ]
    (tmp_path / "x.json").write_text("\n".join(lines))
    got = {r["id"]: r for r in chat.canonical_turns(spark.read.json(str(tmp_path / "x.json"))).collect()}
    turns = lambda i: [(t["role"], t["content"]) for t in got[i]["turns"]]
    assert turns(1) == [("user", "p"), ("assistant", "r")] and turns(2)[0] == ("system", "s")
    assert turns(3) == [("user", "i"), ("assistant", "o")] and turns(4) == [("user", "i\n\nn"), ("assistant", "o")]
    assert turns(5) == [("user", "u"), ("assistant", "")] and turns(6) == [("user", "u"), ("assistant", "a")]
    assert got[7]["layout"] is None and turns(7) == [] and turns(8) == []
    assert len({got[i]["schema_fingerprint"] for i in (1, 2, 3, 4, 5, 6)}) == 6


def test_chats_of_odd_rows(spark, tmp_path):
    rows = [(1, 0, None, "x"), (1, 0, None, "x"), (1, 1, "assistant", None), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (-1, 0, "user", "stored"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'t' AS turns", "'s' AS segments", "1 AS given", "'p' AS prompt")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["conv_id"] if r["conv_id"] is not None else -9, r["n_turns"], r["loss_chars"]) for r in queries.op8_chat(spark, str(tmp_path)).collect())
    assert got == [(-9, 2, 1), (-1, 1, 0), (-1, 2, 21), (1, 3, 0), (2, 3, 0)]
    df.where("false").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r["conv_id"] for r in queries.op8_chat(spark, f"{tmp_path}/none").collect()] == [-1]


def test_clashing_columns_of_records(spark):
    df = spark.createDataFrame([("p", "r", "mine", "own", "kept")], "prompt string, response string, layout string, segments string, x string")
    row = chat.format_chats(chat.canonical_turns(df)).first()
    assert row["layout"] == "prompt_response" and row["x"] == "kept" and [t["content"] for t in row["turns"]] == ["p", "r"] and len(row["segments"]) == 6
    assert chat.canonical_turns(df.where("false")).count() == 0


def test_very_long_turns(spark):
    long = "<|im_end|> ab " * 100_000
    df = spark.createDataFrame([(long, "ok")], "prompt string, response string")
    back = chat.format_chats(chat.canonical_turns(df)).select(chat.read_back(chat.formatted_text()).alias("t")).first()["t"]
    assert back[0]["content"] == long
