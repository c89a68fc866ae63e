"""Site trees on hosts with copies, on large hosts and on tables of few values."""

import pytest

from meshlark.llm import html_extract

BODY = "<html><body><div class=top><p>Welcome to our site</p></div><article><h1>{0}</h1><p>{1}</p><table>{2}</table></article></body></html>"
LONG = "every word of a text that goes on for a while " * 8


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("copies", [20, 700])
def test_host_of_copies(spark, copies):
    """Copies of one page are no boilerplate, neither alone nor beside distinct pages."""
    same = BODY.format("Same", LONG, "")
    assert texts(spark, [same] * copies) == [f"Same {LONG.strip()}"] * copies
    others = [BODY.format(f"Title {i}", f"Story {i}", "") for i in range(100)]
    got = texts(spark, [same] * copies + others)
    assert got == [f"Same {LONG.strip()}"] * copies + [f"Title {i} Story {i}" for i in range(100)]


def test_values_of_few_kinds(spark):
    """A yes/no column and recurring headings stay, in one page and over a large host."""
    column = [["yes" if i * 7 % 11 % (k + 2) else "no" for i in range(300)] for k in range(3)]
    rows = lambda cells: "".join(f"<tr><td>{c}</td></tr>" for c in cells)
    assert texts(spark, [BODY.format("One", "page", rows(column[0]))]) == [" ".join(["One page", *column[0]])]
    pages = [BODY.format(f"Part {i % 10}", f"Story {i}", rows(column[i % 3])) for i in range(3000)]
    got = texts(spark, [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages])
    assert got == [" ".join([f"Part {i % 10} Story {i}", *column[i % 3]]) for i in range(3000)]


def test_without_importance_everything_stays(spark):
    """The tree decides: with a threshold of 0 the registered pages keep menus, adverts and footers."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    with_, without = ({r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages, threshold=t).collect()} for t in (0.4, 0.0))
    assert all(len(without[i]) > len(with_[i]) for i in with_)
