"""Names that speak against elements, and names and shapes that don't, on pages of many sites."""

import random

from meshlark.llm import html_extract

NAMES = ['class="ad"', 'class="post cookie-notice"', 'class="site-footer"', 'class="share-buttons"', "id=comments", "id=site-nav", 'role="navigation"']
WRAPPERS = ['class="has-sidebar"', 'class="no-sidebar content"', 'class="layout sidebar-right"', 'class="page-wrapper has-footer"', 'class="widget"', "id=social"]
SLUGS = ["social-impact", "related-work", "menu-planning", "comments-on-method"]
PAGE = '<html><body>{}<article><h1 id="comments">{}</h1>{}</article></div></body></html>'


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"https://h{i}.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]


def test_names_wrappers_slugs_and_formulas(spark):
    rng, pages, want = random.Random(4), [], []
    for _ in range(3):
        for name in NAMES:
            title, one, two, out, within = prose(rng, 5), prose(rng, 60), prose(rng, 50), prose(rng, 4), prose(rng, 4)
            pages.append(PAGE.format(f"<div {name}>{out}</div><div>", title, f"<p>{one}</p><div {name}>{within}</div><p>{two}</p>"))
            want.append(f"{title} {one} {two}")
        for wrapper in WRAPPERS:
            title, one = prose(rng, 5), prose(rng, 80)
            pages.append(PAGE.format(f"<div {wrapper}>", title, f"<p>{one}</p>"))
            want.append(f"{title} {one}")
        for slug in SLUGS:
            title, one, head, two = prose(rng, 5), prose(rng, 60), prose(rng, 3), prose(rng, 60)
            pages.append(PAGE.format("<div>", title, f"<p>{one}</p><section id={slug}><h2>{head}</h2><p>{two}</p></section>"))
            want.append(f"{title} {one} {head} {two}")
        title, one = prose(rng, 5), prose(rng, 60)
        formula = "<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds.</p>"
        pages.append(PAGE.format("<div>", title, f"<p>{one}</p>{formula}"))
        want.append(f"{title} {one} So E=mc2 holds.")
    assert extracted(spark, pages) == want


def test_parts_of_a_site(spark):
    """No element is named article: what repeats goes, what is small beside the text or mostly links goes."""
    rng, pages, want = random.Random(8), [], []
    for i in range(40):
        one, two, near = prose(rng, 70), prose(rng, 60), prose(rng, 3)
        links = "".join(f"<a href=/{k}>{prose(rng, 1)}</a> " for k in range(5))
        pages.append(f"<body><div class=x1>Same words everywhere</div><div class=x2>{links}</div><div class=x3><p>{one}</p><p>{two}</p></div><div class=x4>{near}</div></body>")
        want.append(f"{one} {two}")
    df = spark.createDataFrame([(i, f"https://one.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract_main_text(df).orderBy("page_id").collect()] == want
