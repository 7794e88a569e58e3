"""Source and extraction queries (S1-S8, S11, S13-S15, P4-P6, P11, P14, P15) with SQL
twins where the semantics are expressible in SQL."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from . import oracle as O
from .config import (LATIN_NEGATION, MESSENGER_MESSAGE_CLASSES, MESSENGER_TEXT_CLASSES, latin_config)
from .functions.urls import netloc, origin, path, resolve_link
from .operators import domains
from .session import read_table
from .sources import extract as X
from .sources import scans as S

CFG = latin_config()
SUFFIXES = [(1, "example.net"), (2, ".example.com"), (3, "example.com"), (4, "example.org")]
AD = {"tag": "div", "attrs": {"class": "ad"}}
RULES = [
    (".example.com", [{"tag": "article", "attrs": {}}], [AD], False, False, False, None),
    ("example.net", [{"tag": "article", "attrs": {}}], [], False, True, True, None),
]


def _t(spark, sf, name):
    return read_table(spark, sf, name, spread_rows=name in ("documents", "pages"))


def _suffixes(spark):
    return spark.createDataFrame(SUFFIXES, "ord int, template string")


def _rules(spark):
    return spark.createDataFrame(RULES, X.RULES_SCHEMA)


# --- SQL helpers for regular markup ----------------------------------------------

def _unescape_sql(x: str) -> str:
    # '&amp' without a semicolon (a truncated title) decodes too, before the full forms
    x = f"regexp_replace({x}, '&amp([^;]|$)', '&\\1', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {O.q(a)}, {O.q(b)})"
    return x


def _strip_sql(x: str) -> str:
    return _unescape_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def _elem_sql(html: str, tag: str) -> str:
    # the element runs to its closing tag, or to the end of the page when unclosed
    return f"split_part(regexp_extract({html}, '(?s)<{tag}(?: [^>]*)?>(.*)', 1), '</{tag}>', 1)"


def _paras_sql(inner: str) -> str:
    """Text of each <p> of a block (a <p> runs to its </p> or to the next <p>)."""
    return (f"list_transform((string_split({inner}, '<p>'))[2:], "
            f"lambda x: {_strip_sql(chr(39).join(['split_part(x, ', '</p>', ', 1)']))})")


def _host_sql() -> str:
    return O.netloc(O.unwrap_archive(O.clean_source_url("url")))


def _canonical_cte() -> str:
    vals = ", ".join(f"({o}, {O.q(t)})" for o, t in SUFFIXES)
    return f"""canon AS (
  SELECT p.page_id, p.url, p.html, coalesce(min_by(s.template, s.ord), p.host) AS canonical
  FROM (SELECT page_id, url, html, {_host_sql()} AS host FROM pages) p
  LEFT JOIN (VALUES {vals}) AS s(ord, template) ON ends_with(p.host, s.template)
  GROUP BY p.page_id, p.url, p.html, p.host)"""


def _generic_sql(html: str) -> str:
    paras = _paras_sql(_elem_sql(html, "article"))
    kept = f"list_filter({paras}, lambda x: regexp_matches(x, '\\S'))"
    return f"{_strip_sql(_elem_sql(html, 'title'))} || chr(10) || array_to_string({kept}, chr(10))"


# --- S5 listing -----------------------------------------------------------------

#: Test pages: a listing item also has a place (the page's language) and a day, and the site's domain decides its selectors.
SELECTORS = {
    "com": {"main_xpath": "//nav//li", "title_xpath": "a", "text_xpath": "//h1", "href_xpath": "a", "city_xpath": "em[1]", "date_xpath": "em[@class='day']"},
    "net": {"main_xpath": "//ul/li[position() > 1]", "title_xpath": ".//a", "text_xpath": "", "href_xpath": "*[1]", "city_xpath": "em[@class='city']", "date_xpath": "em[2]"},
    "org": {"main_xpath": "/html/body/nav/ul/li", "title_xpath": "strong | a", "text_xpath": "", "href_xpath": "descendant::a", "city_xpath": "", "date_xpath": ""},
}
OTHER_DAY = CFG.run_day - dt.timedelta(days=1)


def _listing_pages(spark, sf):
    """pages with ``site_name`` and the items' place and day; the markup of French pages says the day before the run's."""
    p = _t(spark, sf, "pages")
    lang = F.regexp_extract("html", '^<!DOCTYPE html><html lang="([^"]*)"', 1)
    day = F.when(lang == "fr", F.lit(str(OTHER_DAY))).otherwise(F.lit(str(CFG.run_day)))
    more = F.concat(F.lit('</a><em class="city"> '), lang, F.lit(' <b>x</b></em><em class="day">'), day, F.lit("</em> after</li>"))
    return p.select(netloc("url").alias("site_name"), "page_id", "url", lang.alias("lang"), F.replace(F.col("html"), F.lit("</a></li>"), more).alias("html"))


def _page_sites(spark, sf):
    """One configuration row per host of the pages, in order of the host's first page."""
    p = _t(spark, sf, "pages").groupBy(netloc("url").alias("site_name")).agg(F.min("page_id").alias("site_pos"))
    kind = F.substring_index("site_name", ".", -1)
    names = list(SELECTORS["com"])
    pick = lambda n: F.when(kind == "com", SELECTORS["com"][n]).when(kind == "net", SELECTORS["net"][n]).otherwise(SELECTORS["org"][n])
    return p.select("site_pos", "site_name", F.concat(F.lit("urls/"), F.col("site_name"), F.lit(".txt")).alias("url_path"),
                    F.lit(False).alias("rss"), F.lit(False).alias("lower_ssl_security"),
                    F.when(kind == "net", F.lit("ISO-8859-1")).otherwise(F.lit("")).alias("encoding"), *[pick(n).alias(n) for n in names])


def q_src_listing_items(spark, sf):
    pages = _listing_pages(spark, sf)
    items = X.listing_by_paths(pages, _page_sites(spark, sf)).join(pages.select("page_id", "url"), "page_id")
    return items.select("page_id", F.col("item_no").cast("long").alias("item_no"), "title", "text", "city", "date_str",
                        resolve_link(F.col("href2"), F.col("href"), origin(F.col("url"))).alias("href2"))


def listing_sql(html: str = "html", source: str = "pages") -> str:
    """Every item of the pages of ``source``, by its site's selectors: page_id, url, lang, item_no, title, text, city, date_str, href."""
    hrefs = f"regexp_extract_all({html}, '<li><a href=\"([^\"]*)\">', 1)"
    titles = f"regexp_extract_all({html}, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"
    h1 = O.strip_ws(_strip_sql(_elem_sql(html, "h1")))
    lang = f"regexp_extract({html}, '^<!DOCTYPE html><html lang=\"([^\"]*)\"', 1)"
    return f"""SELECT page_id, url, lang, i - CASE WHEN kind = 'net' THEN 1 ELSE 0 END AS item_no,
  {O.strip_ws(_unescape_sql('title'))} AS title, CASE WHEN kind = 'com' THEN h1 ELSE '' END AS text,
  CASE WHEN kind IN ('com', 'net') THEN lang ELSE '' END AS city,
  CASE WHEN kind NOT IN ('com', 'net') THEN '' WHEN lang = 'fr' THEN '{OTHER_DAY}' ELSE '{CFG.run_day}' END AS date_str, {_unescape_sql('href')} AS href
FROM (SELECT page_id, url, {lang} AS lang, {h1} AS h1, string_split({O.netloc('url')}, '.')[-1] AS kind,
             unnest({hrefs}) AS href, unnest({titles}) AS title, unnest(range(0, len({hrefs}))) AS i FROM {source})
WHERE kind <> 'net' OR i > 0"""


def sql_src_listing_items():
    origin_sql = f"{O.scheme('url')} || '://' || {O.netloc('url')}"
    return f"""SELECT page_id, item_no, title, text, city, date_str, {O.resolve_link(chr(39) * 2, 'href', origin_sql)} AS href2
FROM ({listing_sql()})"""


# --- S6 / S8 / P14 / P15 article extraction ---------------------------------------

def _articles(spark, sf):
    return X.extract_articles(_t(spark, sf, "pages"), _rules(spark), _suffixes(spark))


def q_article_text(spark, sf):
    a = _articles(spark, sf)
    return a.select("page_id", "canonical", "has_rule", "text")


def _article_sql_body() -> str:
    h1 = _strip_sql(_elem_sql("html", "h1"))
    art = _elem_sql("html", "article")
    art_no_ad = f"regexp_replace({art}, '(?s)<div class=\"ad\">.*?</div>', '', 'g')"
    com = f"{h1} || chr(10) || {_strip_sql(art_no_ad)} || chr(10)"
    h1s = f"list_transform(regexp_extract_all({art}, '(?s)<h1>(.*?)</h1>', 1), lambda x: {_strip_sql('x')} || chr(10))"
    ps = f"list_transform({_paras_sql(art)}, lambda x: x || chr(10))"
    net = f"array_to_string(list_concat({h1s}, {ps}), '')"
    return f"""WITH {_canonical_cte()}
SELECT page_id, canonical, canonical IN ('.example.com', 'example.net') AS has_rule,
  CASE WHEN canonical = '.example.com' THEN {com}
       WHEN canonical = 'example.net' THEN {net}
       ELSE {_generic_sql('html')} END AS text
FROM canon"""


def sql_article_text():
    return _article_sql_body()


def q_subtag_text(spark, sf):
    """The host is known before the parse, so other hosts' pages are not parsed."""
    pages = domains.canonical_domain(_t(spark, sf, "pages"), _suffixes(spark), "url", "page_id")
    own = pages.filter(F.col("canonical") == "example.net").select("page_id", "url", "html")
    return X.extract_articles(own, _rules(spark), _suffixes(spark)).select("page_id", "text")


def sql_subtag_text():
    return f"SELECT page_id, text FROM ({_article_sql_body()}) WHERE canonical = 'example.net'"


def q_article_text_generic(spark, sf):
    pages = X.parsed(_t(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", X.generic_text(F.col("events")).alias("text"))


def sql_article_text_generic():
    return f"SELECT page_id, {_generic_sql('html')} AS text FROM pages"


def q_drop_subtrees(spark, sf):
    pages = X.parsed(_t(spark, sf, "pages").select("page_id", "html"))
    drops = [("nav", {}), ("footer", {}), ("div", {"class": "ad"})]
    return pages.select("page_id", X.remaining_text(F.col("events"), drops).alias("text"))


def sql_drop_subtrees():
    body = _elem_sql("html", "body")
    x = f"regexp_replace({body}, '(?s)<nav>.*?</nav>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<footer>.*?</footer>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<div class=\"ad\">.*?</div>', '', 'g')"
    return f"SELECT page_id, {_strip_sql(x)} AS text FROM pages"


# --- S7 messenger ------------------------------------------------------------------

def _messenger_pages(spark, sf):
    d = _t(spark, sf, "documents")
    key = F.when(F.col("lang") == "de", (F.col("doc_id") + 1)).otherwise(F.col("doc_id")).cast("string")
    cls = F.when(F.col("lang") == "fr", F.lit(MESSENGER_MESSAGE_CLASSES[1])).otherwise(F.lit(MESSENGER_MESSAGE_CLASSES[0]))
    html = F.concat(F.lit('<html><body><div class="'), cls, F.lit('" data-post="chan/'), key,
                    F.lit(f'"><div class="{MESSENGER_TEXT_CLASSES[0]}">'), S.xml_escape(F.col("text")),
                    F.lit("</div></div></body></html>"))
    return d.select(F.col("doc_id").alias("page_id"),
                    F.concat(F.lit("https://t.me/s/chan/"), F.col("doc_id").cast("string")).alias("url"),
                    html.alias("html"))


def q_messenger_text(spark, sf):
    pages = _messenger_pages(spark, sf)
    rules = spark.createDataFrame([], X.RULES_SCHEMA)
    suffixes = spark.createDataFrame([], "ord int, template string")
    a = X.extract_articles(pages, rules, suffixes)
    return a.select("page_id", "text")


def sql_messenger_text():
    return "SELECT doc_id AS page_id, CASE WHEN lang = 'de' THEN NULL ELSE text END AS text FROM documents"


# --- S4 + P4 feeds ------------------------------------------------------------------

FEED_PAGE = 25


def _feeds(spark, sf):
    """One feed per (source, page of 25 entries), pages being bounded: RSS channels, and Atom for ``src4``."""
    d = _t(spark, sf, "documents")
    parts = F.split(F.col("text"), "\n", 2)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string"))
    body = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.lit(""))
    desc = F.when(F.col("source") == "src3",
                  F.concat(F.lit('<a href="'), url, F.lit('/orig">src</a> '), body)).otherwise(body)
    link = S.xml_escape(F.when(F.col("source") == "src3", F.lit("https://agg.example.org/x")).otherwise(url))
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    title = tag("title", S.xml_escape(F.element_at(parts, 1)))
    rss = tag("item", F.concat(title, tag("link", link), tag("description", S.xml_escape(desc)), tag("pubDate", F.lit("2024-01-15"))))
    atom = tag("entry", F.concat(title, F.lit('<link href="'), link, F.lit('"/>'), tag("summary", S.xml_escape(desc)), tag("updated", F.lit("2024-01-15"))))
    is_atom = F.col("source") == "src4"
    chan = F.when(F.col("source") == "src3", F.lit("https://www.bezformata.example.org/"))\
        .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/")))
    items = d.select("source", (F.col("doc_id") / FEED_PAGE).cast("long").alias("page"), "doc_id",
                     F.when(is_atom, atom).otherwise(rss).alias("item"), chan.alias("chan"))
    feeds = (items.groupBy("source", "page")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))),
                                           lambda s: s["item"]), "").alias("items"),
                  F.first("chan").alias("chan")))
    channel = tag("rss", tag("channel", F.concat(tag("link", F.col("chan")), F.col("items"))))
    feed = tag("feed", F.concat(F.lit('<link href="'), F.col("chan"), F.lit('"/>'), F.col("items")))
    return feeds.select("source", "page", F.when(is_atom, feed).otherwise(channel).alias("xml"))


def q_src_feed_items(spark, sf):
    items = S.feed_items(_feeds(spark, sf))
    return items.select("source", "page", F.col("entry_no").cast("long").alias("entry_no"), "title", "link",
                        "summary", "published")


def sql_src_feed_items():
    url = O.doc_url("source", "doc_id")
    body = O.doc_rest("text")
    return f"""SELECT source, CAST(floor(doc_id / {FEED_PAGE}) AS BIGINT) AS page,
  row_number() OVER (PARTITION BY source, floor(doc_id / {FEED_PAGE}) ORDER BY doc_id) - 1 AS entry_no,
  {O.doc_title('text')} AS title,
  CASE WHEN source = 'src3' THEN {url} || '/orig' ELSE {url} END AS link,
  {O.strip_ws("CASE WHEN source = 'src3' THEN '<a href=\"' || " + url + " || '/orig\">src</a> ' || " + body + " ELSE " + body + " END")} AS summary,
  '2024-01-15' AS published
FROM documents"""


def q_feed_link_override(spark, sf):
    items = S.feed_items(_feeds(spark, sf))
    return items.filter(F.col("source") == "src3").select("page", F.col("entry_no").cast("long").alias("entry_no"),
                                                          "link")


def sql_feed_link_override():
    url = O.doc_url("source", "doc_id")
    return f"""SELECT CAST(floor(doc_id / {FEED_PAGE}) AS BIGINT) AS page,
  row_number() OVER (PARTITION BY floor(doc_id / {FEED_PAGE}) ORDER BY doc_id) - 1 AS entry_no,
  {url} || '/orig' AS link FROM documents WHERE source = 'src3'"""


# --- S1, S3, S13, S2, S11 -----------------------------------------------------------

def _doc_lines(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def _doc_lines_sql() -> str:
    return ("SELECT doc_id, unnest(string_split(text, chr(10))) AS value, "
            "unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents")


def q_src_word_list(spark, sf):
    return S.word_list(_doc_lines(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "word")


def sql_src_word_list():
    return (f"SELECT doc_id, line_no, lower({O.strip_ws('value')}) AS word FROM ({_doc_lines_sql()}) "
            f"WHERE {O.strip_ws('value')} <> ''")


def q_src_stopwords(spark, sf):
    c = _t(spark, sf, "conversations")
    lines = c.select(F.explode(F.split(F.lower("text"), "[ \n]")).alias("value"))
    return S.stop_words(lines, LATIN_NEGATION)


def sql_src_stopwords():
    return (f"SELECT DISTINCT {O.strip_ws('value')} AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ ' || chr(10) || ']')) AS value FROM conversations) "
            f"WHERE {O.strip_ws('value')} <> {O.q(LATIN_NEGATION)}")


def _url_lines(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", F.explode(F.array(
        F.concat(F.lit("  "), F.col("url"), F.lit("\t")), F.lit(""),
        F.concat(F.lit("not a url "), F.col("page_id").cast("string")),
        F.regexp_replace("url", "^https?://", "http://user:pw@"))).alias("value"))


def q_src_url_list(spark, sf):
    return S.url_list(_url_lines(spark, sf)).select("page_id", "url", "base_url")


def sql_src_url_list():
    lines = ("SELECT page_id, unnest(['  ' || url || chr(9), '', 'not a url ' || CAST(page_id AS VARCHAR), "
             "regexp_replace(url, '^https?://', 'http://user:pw@')]) AS value FROM pages")
    u = O.strip_ws("value")
    return (f"SELECT page_id, url, {O.scheme('url')} || '://' || {O.netloc('url')} AS base_url FROM "
            f"(SELECT page_id, {u} AS url FROM ({lines})) WHERE url <> '' AND {O.is_valid_url('url')}")


def site_config(spark, sf):
    """The configuration of all sites: one row per source of the documents, which are feeds, and per host of the pages."""
    feeds = _t(spark, sf, "documents").select("source").distinct().select(
        F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("site_pos"), F.col("source").alias("site_name"),
        F.concat(F.lit("urls/"), F.col("source"), F.lit(".txt")).alias("url_path"), F.lit(True).alias("rss"),
        F.lit(False).alias("lower_ssl_security"), F.lit("").alias("encoding"), *[F.lit("").alias(n) for n in SELECTORS["com"]])
    return feeds.unionByName(_page_sites(spark, sf))


def q_src_site_config(spark, sf):
    return site_config(spark, sf)


def sql_src_site_config():
    names = list(SELECTORS["com"])
    pick = lambda n: f"CASE kind WHEN 'com' THEN {O.q(SELECTORS['com'][n])} WHEN 'net' THEN {O.q(SELECTORS['net'][n])} ELSE {O.q(SELECTORS['org'][n])} END AS {n}"
    return f"""SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS site_pos, source AS site_name,
  'urls/' || source || '.txt' AS url_path, true AS rss, false AS lower_ssl_security, '' AS encoding, {', '.join(f"'' AS {n}" for n in names)}
FROM documents
UNION ALL
SELECT site_pos, site_name, 'urls/' || site_name || '.txt', false, false, CASE kind WHEN 'net' THEN 'ISO-8859-1' ELSE '' END, {', '.join(pick(n) for n in names)}
FROM (SELECT min(page_id) AS site_pos, {O.netloc('url')} AS site_name, string_split({O.netloc('url')}, '.')[-1] AS kind FROM pages GROUP BY 2, 3)"""


RULE_JSON_SCHEMA = "map<string, array<struct<tag: string, attrs: map<string, string>>>>"


def q_rules_load(spark, sf):
    """Rule documents as JSON text (one per page host), parsed with ``from_json``
    and exploded to (netloc, div_no, tag, class)."""
    p = _t(spark, sf, "pages").select(netloc("url").alias("host")).distinct()
    js = F.concat(F.lit('{"'), F.col("host"), F.lit('": [{"tag": "article", "attrs": {}}, '
                                                    '{"tag": "div", "attrs": {"class": "ad"}}]}'))
    m = p.select(F.from_json(js, RULE_JSON_SCHEMA).alias("m"))
    e = m.select(F.explode("m").alias("netloc", "divs"))
    return e.select("netloc", F.posexplode("divs").alias("div_no", "d")).select(
        "netloc", "div_no", F.col("d.tag").alias("tag"), F.col("d.attrs")["class"].alias("class"))


def sql_rules_load():
    return f"""SELECT host AS netloc, unnest([0, 1]) AS div_no, unnest(['article', 'div']) AS tag,
  unnest([NULL, 'ad']) AS class FROM (SELECT DISTINCT {O.netloc('url')} AS host FROM pages)"""


#: Rule documents of the test profile.
DOCUMENTS = {
    "div_map": {".example.com": [["article"]], "example.net": [["article", {}]], "vz.ru": [["article", {"class": "main"}]]},
    "extract_map": {".example.com": [["div", {"class": "ad"}]], "vz.ru": [["nav"], ["h1"]]},
    "collect_all": [], "sub_p": ["example.net"], "ignore_header": ["example.net", "vz.ru", "unknown.example"],
    "endswith": ["example.net", ".example.com", "example.com", "vz.ru"], "lower_ssl_security": ["vz.ru"],
}


def _documents(spark):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in DOCUMENTS.items()], "name string, value string")


def q_rules_documents(spark, sf):
    """The rules of every host of the pages, from the seven rule documents."""
    from .functions.urls import lookup_host
    rules, suffixes = S.load_rules(_documents(spark))
    hosts = _rule_pages(spark, sf).select(lookup_host("url").alias("host"), "url").groupBy("host").agg(F.min("url").alias("url"))
    routed = domains.route_rules(domains.canonical_domain(hosts, suffixes, "url", "host"), rules)
    flat = lambda c: F.array_join(F.transform(c, lambda d: F.concat_ws(" ", d["tag"], F.map_values(d["attrs"]))), ",")
    return routed.select("host", "canonical", "has_rule", flat(F.col("divs")).alias("divs"), flat(F.col("drop_divs")).alias("drops"), "collect_all",
                         "sub_p", "ignore_header", "lower_ssl_security", "attr_from_path")


def sql_rules_documents():
    return f"""WITH h AS (SELECT DISTINCT replace({_host_sql()}, 'example.org', 'vz.ru') AS host FROM pages),
c AS (SELECT host, CASE WHEN ends_with(host, 'example.net') THEN 'example.net' WHEN ends_with(host, '.example.com') THEN '.example.com'
  WHEN ends_with(host, 'example.com') THEN 'example.com' WHEN ends_with(host, 'vz.ru') THEN 'vz.ru' ELSE host END AS canonical FROM h)
SELECT host, canonical, d.divs IS NOT NULL AS has_rule, d.divs, d.drops, d.collect_all, d.sub_p, d.ignore_header, d.lower_ssl_security, d.attr_from_path
FROM c LEFT JOIN (VALUES ('.example.com', 'article', 'div ad', false, false, false, false, NULL),
  ('example.net', 'article', NULL, false, true, true, false, NULL),
  ('vz.ru', 'article main', 'nav,h1', false, false, true, true, 'data-url'))
  AS d(canonical, divs, drops, collect_all, sub_p, ignore_header, lower_ssl_security, attr_from_path) USING (canonical)"""


def _rule_pages(spark, sf):
    """pages whose ``example.org`` hosts are ``vz.ru`` ones; there another article comes before the page's own, which has the
    url's path as an attribute."""
    p = _t(spark, sf, "pages")
    own = F.col("url").contains("example.org")
    html = F.replace(F.col("html"), F.lit("<article>"), F.concat(
        F.lit('<article class="main" data-url="/other">other</article><article class="main" data-url="'), path("url"), F.lit('">')))
    return p.select("page_id", F.replace(F.col("url"), F.lit("example.org"), F.lit("vz.ru")).alias("url"), F.when(own, html).otherwise(F.col("html")).alias("html"))


def q_article_text_documents(spark, sf):
    """S6 with the rules of the rule documents, one of which takes the article that has the url's path."""
    rules, suffixes = S.load_rules(_documents(spark))
    return X.extract_articles(_rule_pages(spark, sf), rules, suffixes).select("page_id", "canonical", "has_rule", "text")


def sql_article_text_documents():
    art = _elem_sql("html", "article")
    no_h1 = f"regexp_replace(regexp_replace({art}, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<h1>.*?</h1>', '', 'g')"
    return f"""SELECT a.page_id, CASE WHEN p.url LIKE '%example.org%' THEN 'vz.ru' ELSE a.canonical END AS canonical,
  a.has_rule OR p.url LIKE '%example.org%' AS has_rule, CASE WHEN p.url LIKE '%example.org%' THEN {_strip_sql(no_h1)} || chr(10) ELSE a.text END AS text
FROM ({_article_sql_body()}) a JOIN pages p USING (page_id)"""


# --- S14, S15 captures ------------------------------------------------------------------

def _captures(spark, sf):
    e = _t(spark, sf, "events")
    status = (F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 301)
              .when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "purchase", 503))
    return e.select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.org/")).alias("url"),
                    F.col("event_id").alias("attempt"), status.alias("status"),
                    F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error"),
                    F.encode(F.col("props"), "UTF-8").alias("body"))


_CAPTURES_SQL = """SELECT 'https://u' || CAST(user_id AS VARCHAR) || '.example.org/' AS url, event_id AS attempt,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 503 END AS status,
  CASE WHEN event_type = 'error' THEN 'timeout' END AS error, props AS body FROM events"""


def q_capture_select_listing(spark, sf):
    c = S.select_listing_capture(_captures(spark, sf))
    return c.select("url", "attempt", "status", F.decode("body", "UTF-8").alias("body"))


def sql_capture_select_listing():
    return f"""WITH c AS ({_CAPTURES_SQL}),
ch AS (SELECT url, coalesce(min(CASE WHEN status = 200 AND error IS NULL THEN attempt END), max(attempt)) AS attempt
       FROM c GROUP BY url)
SELECT c.url, c.attempt, c.status, c.body FROM c JOIN ch USING (url, attempt) WHERE c.error IS NULL"""


def q_capture_select_article(spark, sf):
    c = S.select_article_capture(_captures(spark, sf))
    return c.select("url", "attempt", F.decode("body", "UTF-8").alias("body"))


def sql_capture_select_article():
    return f"""WITH c AS ({_CAPTURES_SQL}),
f AS (SELECT url, min(attempt) AS attempt FROM c WHERE error IS NULL AND status < 400 GROUP BY url)
SELECT u.url, f.attempt, c.body FROM (SELECT DISTINCT url FROM c) u LEFT JOIN f USING (url)
LEFT JOIN c ON c.url = f.url AND c.attempt = f.attempt"""


# --- P11, P6 ----------------------------------------------------------------------------

def q_decode_body(spark, sf):
    """Odd pages come as ISO-8859-1 bytes, which are mostly no UTF-8, the others as UTF-8."""
    p = _t(spark, sf, "pages")
    latin = F.regexp_replace("html", "[^\\x00-\\xFF]", "")
    body = F.when(F.col("page_id") % 2 == 1, F.encode(latin, "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    return p.select("page_id", F.md5(F.encode(S.decode_body(body), "UTF-8")).alias("body_md5"))


def sql_decode_body():
    return """SELECT page_id, md5(CASE WHEN page_id % 2 = 1 THEN regexp_replace(html, '[^\\x{00}-\\x{FF}]', '', 'g') ELSE html END) AS body_md5
FROM pages"""


def q_mojibake_repair(spark, sf):
    """French texts are mojibake; Spanish ones hold a letter that the charset lacks; the others never were
    mojibake, so their letters beyond ASCII are bytes that are no UTF-8."""
    d = _t(spark, sf, "documents")
    text = (F.when(F.col("lang") == "fr", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
            .when(F.col("lang") == "es", F.concat("text", F.lit("\u044f"))).otherwise(F.col("text")))
    return d.select("doc_id", S.repair_mojibake(text, "ISO-8859-1").alias("text"))


def sql_mojibake_repair():
    return """SELECT doc_id, CASE lang WHEN 'es' THEN '' WHEN 'fr' THEN text ELSE regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') END AS text
FROM documents"""


QUERIES = {
    "src_listing_items": (q_src_listing_items, sql_src_listing_items),
    "article_text": (q_article_text, sql_article_text),
    "subtag_text": (q_subtag_text, sql_subtag_text),
    "article_text_generic": (q_article_text_generic, sql_article_text_generic),
    "drop_subtrees": (q_drop_subtrees, sql_drop_subtrees),
    "messenger_text": (q_messenger_text, sql_messenger_text),
    "src_feed_items": (q_src_feed_items, sql_src_feed_items),
    "feed_link_override": (q_feed_link_override, sql_feed_link_override),
    "src_word_list": (q_src_word_list, sql_src_word_list),
    "src_stopwords": (q_src_stopwords, sql_src_stopwords),
    "src_url_list": (q_src_url_list, sql_src_url_list),
    "src_site_config": (q_src_site_config, sql_src_site_config),
    "rules_load": (q_rules_load, sql_rules_load),
    "rules_documents": (q_rules_documents, sql_rules_documents),
    "article_text_documents": (q_article_text_documents, sql_article_text_documents),
    "capture_select_listing": (q_capture_select_listing, sql_capture_select_listing),
    "capture_select_article": (q_capture_select_article, sql_capture_select_article),
    "decode_body": (q_decode_body, sql_decode_body),
    "mojibake_repair": (q_mojibake_repair, sql_mojibake_repair),
}
