"""Extraction from markup events (:mod:`newsdigest.sources.html`): articles by rule (S6-S8, P14, P15, P17,
F12) and listing items (S5, P3, P5).

Every rule is a column expression over a page's array of events, so a page never leaves its row and
nothing shuffles. Routing and filters come before the parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import has_text
from ..functions.urls import path as url_path
from ..operators import domains
from . import html as H

RULE_DIV = "array<struct<tag: string, attrs: map<string, string>>>"
RULES_SCHEMA = (f"netloc string, divs {RULE_DIV}, drop_divs {RULE_DIV}, collect_all boolean, "
                "sub_p boolean, ignore_header boolean, attr_from_path string")
LINE = "\n"


def parsed(pages: DataFrame) -> DataFrame:
    """pages with ``events`` instead of ``html``; other columns ride along. Pages may be heavy, so
    filter before."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"]
    return pages.select(*[c for c in pages.columns if c != "html"], "html").mapInPandas(H.map_events, ", ".join([*kinds, f"events {H.EVENTS}"]))


# --- expressions over events -------------------------------------------------------

def elements(events: Column) -> Column:
    return F.filter(events, lambda e: e["tag"].isNotNull())


def inside(events: Column, outer: Column) -> Column:
    """What is inside an element of ``events``, which are a page's events or a slice of them; null without the element."""
    return F.slice(events, outer["at"] - F.try_element_at(events, F.lit(1))["at"] + 2, outer["size"])


def text_of(events: Column, outer: Column) -> Column:
    """All text inside an element, in order."""
    return F.array_join(F.transform(F.filter(inside(events, outer), lambda e: e["tag"].isNull()), lambda e: e["text"]), "")


def leading_text(events: Column, outer: Column) -> Column:
    """P5: the text of an element before its first child element, stripped; empty without the element."""
    own = inside(events, outer)
    child = F.coalesce(F.array_min(F.transform(elements(own), lambda e: e["open"])), outer["close"])
    pieces = F.transform(F.filter(own, lambda e: e["tag"].isNull() & (e["open"] < child)), lambda e: e["text"])
    return F.coalesce(F.regexp_replace(F.array_join(pieces, ""), r"(?U)^\s+|\s+$", ""), F.lit(""))


def selects(e: Column, tag: Column, attrs: Column) -> Column:
    """An element has the tag, if one is asked for, and all attributes; a class may be one of several."""
    def has(name: Column, value: Column) -> Column:
        own = e["attrs"][name]
        return F.coalesce((own == value) | ((name == "class") & F.array_contains(F.split(own, r"\s+"), value)), F.lit(False))
    return (tag.isNull() | (e["tag"] == tag)) & F.forall(
        F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>"))), lambda a: has(a["key"], a["value"]))


def found(events: Column, tag: Column | str, attrs: Column | None = None) -> Column:
    """Elements that a selector names, in order."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    attrs = F.lit(None).cast("map<string,string>") if attrs is None else attrs
    return F.filter(elements(events), lambda e: selects(e, tag, attrs))


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def without(events: Column, drops: Column) -> Column:
    """Events, blank ones in place of every element that a selector of ``drops`` names and of what is inside, so that
    places stay. The elements' ranges are merged first; what lies between them is copied as slices."""
    def blank(part: Column) -> Column:
        return F.transform(part, lambda e: F.struct(
            e["open"].alias("open"), e["close"].alias("close"), F.lit(None).cast("string").alias("tag"),
            F.lit(None).cast("map<string,string>").alias("attrs"), F.lit("").alias("text"), e["at"].alias("at"), F.lit(0).alias("size")))

    def kept(ranges: Column) -> Column:
        end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(ranges, i)["end"])
        parts = F.transform(ranges, lambda r, i: F.concat(
            F.slice(events, end_before(i) + 1, r["at"] - end_before(i) - 1), blank(F.slice(events, r["at"], r["end"] - r["at"] + 1))))
        last = F.try_element_at(ranges, F.lit(-1))["end"]
        return F.when(F.size(ranges) == 0, events).otherwise(
            F.concat(F.flatten(parts), F.slice(events, last + 1, F.size(events) - last)))

    gone = F.filter(elements(events), lambda e: F.exists(drops, lambda d: selects(e, d["tag"], d["attrs"])))
    none = F.expr("cast(array() as array<struct<at: int, end: int>>)")
    return let(F.aggregate(gone, none, lambda s, e: F.when(
        e["at"] > F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0)),
        F.concat(s, F.array(F.struct(e["at"].alias("at"), (e["at"] + e["size"]).alias("end"))))).otherwise(s)), kept)


# --- articles -----------------------------------------------------------------------

_NO_DIVS = f"cast(array() as {RULE_DIV})"


def rule_text(events: Column, divs: Column, drops: Column, collect_all: Column, sub_p: Column, ignore_header: Column,
              path: Column, attr_from_path: Column) -> Column:
    """One line per selected element. Selectors are the header's h1, unless ignored, and the rule's; each
    gives its first element or all. With ``sub_p`` an element that is no text element itself gives a line
    for each text element inside, by tag, then in order (P15). An attribute of the first selector may be the
    url's path (P17)."""
    none = F.expr(_NO_DIVS)
    own = F.transform(F.coalesce(divs, none), lambda d, i: F.struct(d["tag"].alias("tag"), F.when(
        (i == 0) & attr_from_path.isNotNull() & path.isNotNull(),
        F.map_concat(F.map_filter(F.coalesce(d["attrs"], F.create_map().cast("map<string,string>")), lambda k, _: k != attr_from_path),
                     F.create_map(attr_from_path, path))).otherwise(d["attrs"]).alias("attrs")))
    header = F.expr(f"cast(array(named_struct('tag', 'h1', 'attrs', null)) as {RULE_DIV})")
    selectors = F.concat(F.when(ignore_header, none).otherwise(header), own)
    text_tags = F.array(*[F.lit(t) for t in config.SUBTAG_KEYS])

    def lines(kept: Column) -> Column:
        def of(d: Column) -> Column:
            all_of = found(kept, d["tag"], d["attrs"])
            chosen = F.when(collect_all, all_of).otherwise(F.slice(all_of, 1, 1))
            parts = lambda w: let(inside(kept, w), lambda own: F.flatten(F.transform(text_tags, lambda t: F.transform(
                F.filter(own, lambda e: e["tag"] == t), lambda e: text_of(own, e)))))
            walk = sub_p & ~F.coalesce(F.array_contains(text_tags, d["tag"]), F.lit(False))
            return F.flatten(F.transform(chosen, lambda w: F.when(walk, parts(w)).otherwise(F.array(text_of(kept, w)))))
        return F.transform(F.flatten(F.transform(selectors, of)), lambda t: F.concat(t, F.lit(LINE)))

    return F.array_join(let(without(events, F.coalesce(drops, none)), lines), "")


def messenger_text(events: Column, url: Column) -> Column:
    """The text block of the message that has the url's last two path segments as its key; null without."""
    key = F.substring_index(url, "/", -2)
    block = lambda within, cls: F.filter(elements(within), lambda e: (e["tag"] == "div") & (e["attrs"]["class"] == cls))
    message = F.coalesce(*[first(F.filter(block(events, c), lambda e: e["attrs"]["data-post"] == key)) for c in config.MESSENGER_MESSAGE_CLASSES])
    text = lambda m: F.coalesce(*[first(block(inside(events, m), c)) for c in config.MESSENGER_TEXT_CLASSES])
    return let(let(message, text), lambda t: F.when(t.isNotNull(), text_of(events, t)))


def generic_text(events: Column) -> Column:
    """The title, then a line for each paragraph with text of the article, or body, or page."""
    title = let(first(found(events, "title")), lambda t: F.coalesce(text_of(events, t), F.lit("")))
    main = F.coalesce(first(found(events, "article")), first(found(events, "body")))
    within = let(main, lambda m: F.when(m.isNull(), events).otherwise(inside(events, m)))
    paragraphs = F.filter(let(within, lambda w: F.transform(found(w, "p"), lambda p: text_of(w, p))), has_text)
    return F.concat(title, F.lit(LINE), F.array_join(paragraphs, LINE))


def authors(events: Column, link_class: str) -> Column:
    """texts of author links."""
    links = found(events, "a", F.create_map(F.lit("class"), F.lit(link_class)))
    return F.transform(links, lambda a: text_of(events, a))


def remaining_text(events: Column, drops: list[tuple[str, dict[str, str]]]) -> Column:
    """P14 alone: the body's text without the dropped elements."""
    divs = F.array(*[F.struct(F.lit(t).alias("tag"), F.create_map(*[F.lit(x) for kv in a.items() for x in kv]).cast("map<string,string>").alias("attrs"))
                     for t, a in drops])
    return let(without(events, divs), lambda kept: F.coalesce(let(first(found(kept, "body")), lambda b: text_of(kept, b)), F.lit("")))


def extract_articles(pages: DataFrame, rules: DataFrame, suffixes: DataFrame) -> DataFrame:
    """M6 extraction step: canonical host (J4) and rule (J5/F6) first, then the parse, then the text that
    the host's kind asks for. Returns (page_id, url, canonical, has_rule, text, skipped)."""
    c = domains.canonical_domain(pages.select("page_id", "url", "html"), suffixes, "url", "page_id")
    routed = domains.route_rules(c, rules).select(
        "page_id", "url", "html", "canonical", "has_rule", "divs", "drop_divs", "collect_all", "sub_p", "ignore_header",
        url_path(F.col("url")).alias("path"), "attr_from_path")
    e = F.col("events")
    skipped = (F.col("canonical") == "vk.com") & F.array_contains(authors(e, config.AUTHOR_LINK_CLASS), config.SKIPPED_AUTHOR)
    by_rule = rule_text(e, F.col("divs"), F.col("drop_divs"), F.col("collect_all"), F.col("sub_p"), F.col("ignore_header"),
                        F.col("path"), F.col("attr_from_path"))
    x = parsed(routed).withColumn("skipped", F.coalesce(skipped, F.lit(False)))
    text = (F.when(F.col("canonical") == "t.me", messenger_text(e, F.col("url"))).when(F.col("skipped"), F.lit(None))
            .when(F.col("has_rule"), by_rule).otherwise(generic_text(e)))
    return x.select("page_id", "url", "canonical", "has_rule", text.alias("text"), "skipped")


# --- listings ------------------------------------------------------------------------

def extract_listing(pages: DataFrame, main_tag: str | Column, main_attrs: Column | None, title_tag: str | Column,
                    href_tag: str | Column, text_tag: str | Column | None = None, city_tag: str | Column | None = None,
                    date_tag: str | Column | None = None) -> DataFrame:
    """One row per element that the main selector names: page_id, item_no, title, text, city, date_str,
    href, href2. Selectors are tags or columns of ``pages`` (per-site configuration). A link without href
    gives the text after it as the link (P3)."""
    names = {"main": main_tag, "title": title_tag, "href": href_tag, "text": text_tag, "city": city_tag, "date": date_tag}
    column = lambda t: F.lit(t).cast("string") if t is None or isinstance(t, str) else t
    attrs = F.lit(None).cast("map<string,string>") if main_attrs is None else main_attrs
    own = pages.select("page_id", "html", *[column(t).alias(f"{n}_tag") for n, t in names.items()], attrs.alias("main_attrs"))
    e = F.col("events")
    # an item's own events are few; what follows looks at these only
    per_item = F.transform(found(e, F.col("main_tag"), F.col("main_attrs")), lambda x: inside(e, x))
    items = parsed(own).select("page_id", *[f"{n}_tag" for n in names], F.posexplode(per_item).alias("item_no", "own"))
    e = F.col("own")
    part = lambda n: first(F.filter(e, lambda x: x["tag"] == F.col(f"{n}_tag")))
    lead = lambda n: let(part(n), lambda x: leading_text(e, x))
    items = items.withColumn("link", part("href"))
    href = F.coalesce(F.col("link.attrs")["href"], F.lit(""))
    tail = first(F.filter(e, lambda x: x["tag"].isNull() & (x["open"] == F.col("link.close") + 1)))
    after = F.coalesce(F.regexp_replace(tail["text"], r"(?U)^\s+|\s+$", ""), F.lit(""))
    return items.select("page_id", "item_no", lead("title").alias("title"), lead("text").alias("text"), lead("city").alias("city"),
                        lead("date").alias("date_str"), href.alias("href"), F.when(href == "", after).otherwise("").alias("href2"))


# --- listings by path selectors (S2 + S5) ---------------------------------------------------

#: the selectors of a site's configuration: of its items, and of an item's parts
ITEMS, PARTS = "main_xpath", ("title_xpath", "text_xpath", "city_xpath", "date_xpath", "href_xpath")


def _alternatives(selector: str) -> list[str]:
    """The alternatives of an XPath, which ``|`` parts outside of quotes and brackets."""
    out, depth, quote = [""], 0, None
    for c in selector:
        if quote or c in "'\"":
            quote = None if c == quote else quote or c
        else:
            depth += (c in "[(") - (c in "])")
            if c == "|" and depth == 0:
                out.append("")
                continue
        out[-1] += c
    return [a.strip() for a in out]


def _absolute(selector: str) -> bool:
    kinds = {a.startswith("/") for a in _alternatives(selector)}
    if len(kinds) > 1:
        raise ValueError(f"{selector!r} mixes paths from the page's root with paths from an item")
    return kinds.pop()


def _places(xml: Column, selector: str) -> Column:
    """Places of the elements that an XPath names, in order. A relative path starts at the XML's root element."""
    paths = [a if a.startswith(("/", "(")) else f"/*/{a}" for a in _alternatives(selector)]
    return F.array_sort(F.xpath(xml, F.lit("|".join(f"{a}/@{H.PLACE}" for a in paths))).cast("array<int>"))


def _by_value(value: Column, cases: dict[str, Column], kind: str) -> Column:
    """The case of a column's value; null for other values."""
    out = F.lit(None).cast(kind)
    for v, case in cases.items():
        out = F.when(value == v, case).otherwise(out)
    return out


def listing_by_paths(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """S2 + S5: one row per element that a site's ``main_xpath`` names on the site's pages: site_name, page_id,
    item_no, title, text, city, date_str, href, href2.

    pages: (site_name, page_id, html); sites: (site_name, main_xpath, title_xpath, text_xpath, city_xpath, date_xpath,
    href_xpath), one row a site. Selectors are XPath 1.0 expressions that name elements, read by Spark's own ``xpath`` on the
    page's XML form. A relative selector of a part starts at the item and sees what is inside it; one that begins
    with ``/`` is looked up on the whole page. The first element found gives a part: its text before its first child
    element (P5), or the link's address, for which the text after the link stands in (P3). A part without selector or element is
    empty. A site without ``main_xpath``, a page of no site and a page without html give no rows; a path that is no
    XPath is an error. Paths of an item that begin with ``(`` are not supported. Spark's ``xpath`` asks for literal paths, so
    the distinct selectors of the configuration, not its rows, come to the driver."""
    spark_sites = sites.select("site_name", *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in (ITEMS, *PARTS)])
    known = spark_sites.select(*[F.collect_set(c).alias(c) for c in (ITEMS, *PARTS)]).first()
    mains = sorted(known[ITEMS])
    parts = sorted({s for c in PARTS for s in known[c]})
    if bad := [s for s in parts if any(a.startswith("(") for a in _alternatives(s))]:
        raise ValueError(f"paths of an item cannot begin with a bracket: {bad}")
    on_page, in_item = [s for s in parts if _absolute(s)], [s for s in parts if not _absolute(s)]

    own = (pages.select("site_name", "page_id", "html").filter(F.col("html").isNotNull())
           .join(spark_sites.filter(F.col(ITEMS).isNotNull()), "site_name"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "html"]
    marked = (own.select(*[c for c in own.columns if c != "html"], "html")
              .mapInPandas(H.map_xml, ", ".join([*kinds, f"events {H.EVENTS}", "xml binary", "begins array<int>", "sizes array<int>"])))

    element = "struct<lead: string, href: string, tail: string>"

    def read(events: Column, e: Column) -> Column:
        after = first(F.filter(events, lambda x: x["tag"].isNull() & (x["open"] == e["close"] + 1)))
        return F.struct(leading_text(events, e).alias("lead"), F.coalesce(e["attrs"]["href"], F.lit("")).alias("href"),
                        F.coalesce(F.regexp_replace(after["text"], r"(?U)^\s+|\s+$", ""), F.lit("")).alias("tail"))

    def read_first(events: Column, places: Column) -> Column:
        offset = F.try_element_at(events, F.lit(1))["at"] - 1
        return let(first(places), lambda at: F.when(at.isNotNull(), read(events, F.try_element_at(events, at - offset))))

    def asked(s: str) -> Column:
        return F.coalesce(F.array_contains(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in PARTS]), s), F.lit(False))

    ev, doc = F.col("events"), F.col("xml").cast("string")
    main = _by_value(F.col(ITEMS), {s: _places(doc, s) for s in mains}, "array<int>")
    # an item is its events and its part of the XML; what follows looks at these only
    item = lambda at: F.struct(F.slice(ev, at, F.try_element_at(ev, at)["size"] + 1).alias("own"),
                               F.substring(F.col("xml"), F.col("begins")[at - 1], F.col("sizes")[at - 1]).cast("string").alias("xml"))
    keep = ["site_name", "page_id", *PARTS]
    x = marked.withColumn("mains", main)
    x = x.withColumn("on_page", F.array(*[F.when(asked(s), read_first(ev, _places(doc, s))) for s in on_page]).cast(f"array<{element}>"))
    x = x.select(*keep, "on_page", F.posexplode(F.transform("mains", item)).alias("item_no", "item"))
    x = x.withColumn("in_item", F.array(*[F.when(asked(s), read_first(F.col("item.own"), _places(F.col("item.xml"), s))) for s in in_item])
                     .cast(f"array<{element}>"))
    at = {s: F.col("on_page")[i] for i, s in enumerate(on_page)} | {s: F.col("in_item")[i] for i, s in enumerate(in_item)}
    for c in PARTS:
        x = x.withColumn(f"_{c}", _by_value(F.col(c), at, element))
    lead = lambda c: F.coalesce(F.col(f"_{c}.lead"), F.lit(""))
    href = F.coalesce(F.col("_href_xpath.href"), F.lit(""))
    tail = F.coalesce(F.col("_href_xpath.tail"), F.lit(""))
    return x.select("site_name", "page_id", "item_no", lead("title_xpath").alias("title"), lead("text_xpath").alias("text"),
                    lead("city_xpath").alias("city"), lead("date_xpath").alias("date_str"), href.alias("href"),
                    F.when(href == "", tail).otherwise("").alias("href2"))
