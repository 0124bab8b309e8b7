"""Words and links decide inside and outside the main area."""

from polysema.llm import html

LONG = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]


def test_links_without_class_names_in_the_article():
    links = "<ul>" + "".join(f"<li><a href='/{i}'>More news {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<article><h1>Title</h1><p>{LONG[0]}</p><div><a href='/buy'>Buy our new shoes</a></div><p>{LONG[1]} <a>x</a></p>{links}</article>"
    assert html.main_text(page) == f"Title {LONG[0]} {LONG[1]} x"


def test_article_is_only_a_teaser():
    page = "<div><h1>Top</h1></div>" + "".join(f"<div>{t}</div>" for t in LONG) + "<div><a>Next</a> <a>Back</a></div><article><p>A short teaser.</p></article><div>All rights reserved</div>"
    assert html.main_text(page) == " ".join([*LONG, "A short teaser."])
    assert html.main_text(page.replace("<div>a0", '<div class="ad">a0')) == " ".join([*LONG[1:], "A short teaser."])


def test_extract_on_odd_pages(spark):
    """Empty, cut off, repeated, very long and wrongly nested pages, beside columns of clashing names."""
    page = f"<body><article><p>{LONG[0]}</p></div></ul><p>{LONG[1]}</article></p>"
    deep = "<div>" * 20000 + "</ul>" * 20000 + LONG[2]
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>x</p><scri"), (4, "u", page), (4, "u", page), (5, "u", deep), (None, "u", "<p>" + "word " * 50000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html.extract(df).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got if r["page_id"] in (1, 2)] == [(1, "", 0), (2, "", 0)]
    by = {r["page_id"]: r["text"] for r in got}
    assert by[3] == "x" and by[4] == f"{LONG[0]} {LONG[1]}" and by[5] == LONG[2] and by[None] == ("word " * 50000).strip() and len(got) == 7
    assert html.extract(df.limit(0)).count() == 0
