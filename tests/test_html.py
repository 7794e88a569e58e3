"""Truth tables for extraction from markup events."""

from pyspark.sql import functions as F

from newsdigest.config import MESSENGER_MESSAGE_CLASSES, MESSENGER_TEXT_CLASSES
from newsdigest.sources import extract as X


def _events(spark, *pages):
    rows = [(i, p) for i, p in enumerate(pages)]
    return X.parsed(spark.createDataFrame(rows, "page_id long, html string")), F.col("events")


def _one(df, column):
    return [r.x for r in df.select("page_id", column.alias("x")).orderBy("page_id").collect()]


def _rule(e, divs, drops=(), collect_all=False, sub_p=False, ignore_header=False, path=None, attr=None):
    divs, drops = (F.lit([]).cast(X.RULE_DIV) if not ds else F.array(*[F.struct(
        F.lit(t).alias("tag"), F.create_map(*[F.lit(x) for kv in a.items() for x in kv]).cast("map<string,string>").alias("attrs")) for t, a in ds])
        for ds in (divs, drops))
    return X.rule_text(e, divs, drops, F.lit(collect_all), F.lit(sub_p), F.lit(ignore_header), F.lit(path).cast("string"), F.lit(attr).cast("string"))


def test_listing_items_leading_text_and_tail_fallback(spark):
    page = ('<ul><li><a href="/a">Title <b>bold</b> tail</a></li>'
            '<li><a>no href</a> https://x.example.org/t </li>'
            '<li><span>no link</span><i> City </i><time>05.06.2022</time></li></ul>')
    pages = spark.createDataFrame([(7, page, "li", "a"), (8, "<div><p><a href='/z'>Z</a></div>", "p", "a"), (9, None, "li", "a")],
                                  "page_id long, html string, m string, t string")
    items = X.extract_listing(pages, F.col("m"), None, F.col("t"), "a", city_tag="i", date_tag="time")  # selectors per page
    got = {(r.page_id, r.item_no): (r.title, r.text, r.city, r.date_str, r.href, r.href2) for r in items.collect()}
    assert got == {(7, 0): ("Title", "", "", "", "/a", ""),  # leading text only (child element cut)
                   (7, 1): ("no href", "", "", "", "", "https://x.example.org/t"),  # tail text as link
                   (7, 2): ("", "", "City", "05.06.2022", "", ""),  # no link at all
                   (8, 0): ("Z", "", "", "", "/z", "")}


def test_article_rules(spark):
    page = ("<html><body><h1>Head</h1><nav>menu</nav><div class='x'>one</div><div class='x y'>two</div>"
            "<div class='ad'>buy</div><ul><li><p>nested</p></li></ul></body></html>")
    df, e = _events(spark, page)
    assert _one(df, _rule(e, [("div", {"class": "x"})])) == ["Head\none\n"]
    assert _one(df, _rule(e, [("div", {"class": "x"})], collect_all=True, ignore_header=True)) == ["one\ntwo\n"]
    body = _one(df, _rule(e, [("body", {})], drops=[("nav", {}), ("div", {"class": "ad"})], ignore_header=True))[0]
    assert "menu" not in body and "buy" not in body and "one" in body
    # sub-tag walk in tag order; a p inside an li is counted twice (Q20)
    assert _one(df, _rule(e, [("ul", {})], sub_p=True, ignore_header=True)) == ["nested\nnested\n"]
    assert _one(df, _rule(e, [("table", {})], ignore_header=True)) == [""]


def test_attr_from_path(spark):
    df, e = _events(spark, '<div data-url="/a/b">yes</div><div data-url="/c">no</div>')
    assert _one(df, _rule(e, [("div", {})], ignore_header=True, path="/a/b", attr="data-url")) == ["yes\n"]


def test_unclosed_paragraphs_script_string_and_empty_pages(spark):
    page = '<title>X</title><script>var t="</p>";</script><article><h1>T</h1><p><b>A<br><p>B</p><p>C</article>'
    df, e = _events(spark, page, None, "", "<p> </p><p>only")
    assert _one(df, X.generic_text(e)) == ["X\nA\nB\nC", "\n", "\n", "\nonly"]


def test_nested_lists_and_items(spark):
    df, e = _events(spark, "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")
    assert _one(df, F.transform(X.found(e, "li"), lambda x: X.text_of(e, x))) == [["abc", "b", "c", "d"]]


def test_messenger_variants(spark):
    pages = [f'<div class="{c}" data-post="chan/5"><div class="{MESSENGER_TEXT_CLASSES[1]}">hi &amp; bye</div></div>' for c in MESSENGER_MESSAGE_CLASSES]
    df, e = _events(spark, *pages, '<div class="tgme_widget_message js-widget_message" data-post="chan/6"></div>')
    assert _one(df, X.messenger_text(e, F.lit("https://t.me/s/chan/5"))) == ["hi & bye"] * len(pages) + [None]


def test_authors(spark):
    df, e = _events(spark, '<a class="pi_author" href="#">Someone</a><a class="other">x</a>')
    assert _one(df, X.authors(e, "pi_author")) == [["Someone"]]


def test_what_is_inside_is_a_slice():
    import random

    from newsdigest.sources.html import events
    rng = random.Random(6)
    tags = ["p", "div", "li", "ul", "b", "br", "/p", "/div", "/li", "/ul", "/b", "/x"]
    for _ in range(60):
        page = events("".join(rng.choice(["word ", f"<{rng.choice(tags)}>"]) for _ in range(60)))
        for i, e in enumerate(page):
            assert e["at"] == i + 1
            assert page[i + 1:i + 1 + e["size"]] == [x for x in page if x["open"] > e["open"] and x["close"] < e["close"]]


def test_long_pages_take_time_in_proportion(spark):
    """A page of 50,000 items, each with an element that is dropped in the article."""
    import time

    n = 50_000
    items = "".join(f"<li><a href='/x/{i}'>title {i}</a> after <i>no</i></li>" for i in range(n))
    page = f"<html><body><nav><ul>{items}</ul></nav><p>one</p><p>two</p></body></html>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    begun = time.time()
    found = X.extract_listing(df, "li", None, "a", "a").agg(F.count(F.lit(1)).alias("n"), F.max("item_no").alias("last"),
                                                            F.max_by("title", "item_no").alias("title"), F.max_by("href", "item_no").alias("href")).first()
    assert (found["n"], found["last"], found["title"], found["href"]) == (n, n - 1, f"title {n - 1}", f"/x/{n - 1}")
    text = X.parsed(df).select(X.remaining_text(F.col("events"), [("nav", {})]).alias("t")).first()["t"]
    assert text == "onetwo"
    assert time.time() - begun < 90
