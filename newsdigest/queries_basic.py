"""Queries of the URL, filter, routing, ordering and state operators with their SQL
twins (P1, P2, P8-P10, F1, F2, F5-F7, F11-F13, J1-J6, A2, A7, W1, W2, K1, K2, S9, S10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracle as O
from .config import (ARCHIVE_PREFIX, LATIN_COLLECTIVE_WORDS, LATIN_KEYWORDS, REPORT_NOTHING_FOUND,
                     SOURCE_LABEL, latin_config)
from .functions import urls as U
from .functions.text import candidate_text
from .operators import domains, filters, ordering, state
from .operators import lexicon as lexicon_ops
from .session import read_table
from .streaming.stream import stream_dir

CFG = latin_config()
RUN_DATE = CFG.run_day
KEYWORDS = filters.normalise_words(LATIN_KEYWORDS)

# inline configuration rows (suffix templates in list order, rules per host)
SUFFIXES = [(1, "example.net"), (2, ".example.com"), (3, "example.com"), (4, "example.org")]
RULES = [("example.com", "article", "div", True, False, False),
         ("example.net", "article", "nav", False, True, True)]
RULES_SCHEMA = "netloc string, div_tag string, drop_tag string, collect_all boolean, sub_p boolean, ignore_header boolean"


def _t(spark, sf, name):
    return read_table(spark, sf, name)


def _suffixes(spark):
    return spark.createDataFrame(SUFFIXES, "ord int, template string")


def _rules(spark):
    return spark.createDataFrame(RULES, RULES_SCHEMA)


def _values(rows, cols, alias="v") -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        return O.q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


# --- P1 ----------------------------------------------------------------------

def q_url_parts(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", U.netloc("url").alias("netloc"), U.scheme("url").alias("scheme"),
                    U.path("url").alias("path"))


def sql_url_parts():
    return f"SELECT page_id, {O.netloc('url')} AS netloc, {O.scheme('url')} AS scheme, {O.path('url')} AS path FROM pages"


# --- F5 ----------------------------------------------------------------------

def q_url_valid(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", U.is_valid_url(F.col("url")).alias("valid"),
                    U.is_valid_url(F.concat(F.col("url"), F.lit(" x"))).alias("valid_space"),
                    U.is_valid_url(F.regexp_replace("url", "^[a-z]+://", "")).alias("valid_noscheme"))


def sql_url_valid():
    return (f"SELECT page_id, {O.is_valid_url('url')} AS valid, {O.is_valid_url(chr(40) + 'url || ' + O.q(' x') + chr(41))} AS valid_space, "
            f"{O.is_valid_url('regexp_replace(url, ' + O.q('^[a-z]+://') + ', ' + O.q('') + ')')} AS valid_noscheme FROM pages")


# --- P2 / P3 -------------------------------------------------------------------

def _nav_links(p: DataFrame) -> DataFrame:
    return p.select("page_id", "url", F.posexplode(
        F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), 1)).alias("link_no", "href"))


def q_resolve_link(spark, sf):
    links = _nav_links(_t(spark, sf, "pages"))
    return links.select("page_id", F.col("link_no").cast("long").alias("link_no"),
                        U.resolve_link(F.lit(""), F.col("href"), U.origin(F.col("url"))).alias("href2"))


def _nav_links_sql() -> str:
    arr = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)"
    return (f"SELECT page_id, url, unnest({arr}) AS href, unnest(range(0, len({arr}))) AS link_no FROM pages")


def sql_resolve_link():
    origin = f"{O.scheme('url')} || '://' || {O.netloc('url')}"
    return (f"SELECT page_id, link_no, {O.resolve_link(chr(39) * 2, 'href', origin)} AS href2 "
            f"FROM ({_nav_links_sql()})")


# --- P8, P9, P10 ---------------------------------------------------------------

def q_clean_source_url(spark, sf):
    p = _t(spark, sf, "pages")
    labelled = F.concat(F.lit(SOURCE_LABEL + " "), F.col("url"), F.lit("\t"))
    return p.select("page_id", U.clean_source_url(labelled).alias("url"))


def sql_clean_source_url():
    return f"SELECT page_id, {O.clean_source_url(O.q(SOURCE_LABEL + ' ') + ' || url || chr(9)')} AS url FROM pages"


def q_unwrap_archive(spark, sf):
    p = _t(spark, sf, "pages")
    wrapped = F.concat(F.lit(ARCHIVE_PREFIX + "20240115000000/"), F.col("url"))
    return p.select("page_id", U.unwrap_archive(wrapped).alias("unwrapped"),
                    U.lookup_host(wrapped).alias("host"))


def sql_unwrap_archive():
    w = f"({O.q(ARCHIVE_PREFIX + '20240115000000/')} || url)"
    return f"SELECT page_id, {O.unwrap_archive(w)} AS unwrapped, {O.netloc(O.unwrap_archive(O.clean_source_url(w)))} AS host FROM pages"


def q_messenger_link_roundtrip(spark, sf):
    p = _t(spark, sf, "pages")
    tm = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "https://t.me")
    fixed = U.fix_messenger_link(tm)
    return p.select("page_id", fixed.alias("fixed"), U.undo_messenger_link(fixed).alias("undone"),
                    (U.undo_messenger_link(fixed) == tm).alias("roundtrip"),
                    U.fix_messenger_link(F.col("url")).alias("other_host"))


def sql_messenger_link_roundtrip():
    tm = "regexp_replace(url, '^[a-z]+://[^/?#]*', 'https://t.me')"
    fixed = O.fix_messenger(tm)
    return (f"SELECT page_id, {fixed} AS fixed, {O.undo_messenger(fixed)} AS undone, "
            f"({O.undo_messenger(fixed)}) = {tm} AS roundtrip, {O.fix_messenger('url')} AS other_host FROM pages")


# --- J4, J5, F6 ----------------------------------------------------------------

def q_canonical_domain(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url")
    return domains.canonical_domain(p, _suffixes(spark), "url", "page_id").select("page_id", "netloc", "canonical")


def _canonical_sql() -> str:
    host = O.netloc(O.unwrap_archive(O.clean_source_url("url")))
    return f"""SELECT p.page_id, p.host AS netloc, coalesce(min_by(s.template, s.ord), p.host) AS canonical
FROM (SELECT page_id, {host} AS host FROM pages) p
LEFT JOIN {_values(SUFFIXES, ['ord', 'template'], 's')} ON ends_with(p.host, s.template)
GROUP BY p.page_id, p.host"""


def sql_canonical_domain():
    return _canonical_sql()


def q_domain_routing(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url")
    c = domains.canonical_domain(p, _suffixes(spark), "url", "page_id")
    return domains.route_rules(c, _rules(spark)).select(
        "page_id", "canonical", "has_rule", "div_tag", "collect_all", "sub_p", "ignore_header")


def sql_domain_routing():
    cols = ["netloc", "div_tag", "drop_tag", "collect_all", "sub_p", "ignore_header"]
    return f"""SELECT c.page_id, c.canonical, r.netloc IS NOT NULL AS has_rule, r.div_tag, r.collect_all, r.sub_p, r.ignore_header
FROM ({_canonical_sql()}) c LEFT JOIN {_values(RULES, cols, 'r')} ON r.netloc = c.canonical"""


# --- F1, F2, F7, F12, F13 ------------------------------------------------------

def _kw_sql(t: str) -> str:
    if not KEYWORDS:
        return "false"
    return f"(coalesce({t}, '') <> '' AND list_bool_or(list_transform({O.sql_list(KEYWORDS)}, lambda w: contains(lower({t}), w))))"


def q_kw_filter(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", filters.keyword_match(F.col("text"), KEYWORDS).alias("kw_hit"))


def sql_kw_filter():
    return f"SELECT doc_id, coalesce({_kw_sql('text')}, false) AS kw_hit FROM documents"


def _items(d: DataFrame) -> DataFrame:
    parts = F.split(F.col("text"), "\n", 2)
    return d.select("doc_id", F.col("source").alias("site_name"),
                    F.element_at(parts, 1).alias("title"),
                    F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.lit("")).alias("body"))


def _items_sql() -> str:
    return (f"SELECT doc_id, source AS site_name, {O.doc_title('text')} AS title, "
            f"{O.doc_rest('text')} AS body FROM documents")


def _nav_words(spark, sf):
    """A long keyword list derived from the pages: every nav link word of 5+ letters."""
    links = _nav_links(_t(spark, sf, "pages"))
    w = F.lower(F.regexp_replace("href", "^/", ""))
    return links.select(w.alias("word")).filter(F.length("word") >= 5).distinct()


def q_kw_filter_large(spark, sf):
    d = _t(spark, sf, "documents")
    return filters.keyword_counts(d, _nav_words(spark, sf), "text", "doc_id").withColumnRenamed("id", "doc_id")


def sql_kw_filter_large():
    words = ("SELECT DISTINCT lower(regexp_replace(href, '^/', '')) AS word FROM "
             f"({_nav_links_sql()}) WHERE length(lower(regexp_replace(href, '^/', ''))) >= 5")
    return f"""WITH w AS ({words})
SELECT d.doc_id, count(w.word) > 0 AS kw_hit, count(w.word) AS n_words
FROM documents d LEFT JOIN w ON contains(lower(d.text), w.word) AND coalesce(d.text, '') <> ''
GROUP BY d.doc_id"""


def q_kw_filter_title_or_text(spark, sf):
    it = _items(_t(spark, sf, "documents"))
    return filters.keyword_filter(it, KEYWORDS, "title", "body").select("doc_id", "site_name")


def sql_kw_filter_title_or_text():
    return f"SELECT doc_id, site_name FROM ({_items_sql()}) WHERE {_kw_sql('title')} OR {_kw_sql('body')}"


def q_nonblank_text(spark, sf):
    c = _t(spark, sf, "conversations")
    return filters.nonblank_text(c, "text").select("conv_id", "turn")


def sql_nonblank_text():
    return f"SELECT conv_id, turn FROM conversations WHERE {O.has_text('text')}"


def q_strip_boilerplate(spark, sf):
    from .functions.text import strip_boilerplate
    d = _t(spark, sf, "documents")
    return d.select("doc_id", F.length(strip_boilerplate(F.col("text"), CFG.boilerplate)).cast("long").alias("n_chars"))


def sql_strip_boilerplate():
    return f"SELECT doc_id, length({O.strip_boilerplate('text', CFG.boilerplate)}) AS n_chars FROM documents"


def q_candidate_text(spark, sf):
    it = _items(_t(spark, sf, "documents"))
    return it.select("doc_id", candidate_text(F.col("title"), F.col("body")).alias("text"))


def sql_candidate_text():
    return f"SELECT doc_id, {O.candidate_text('title', 'body')} AS text FROM ({_items_sql()})"


def q_text_fallback(spark, sf):
    """P13 on conversations: a user turn's text falls back to the next turn's text when
    blank-stripped to nothing; both empty -> the row is dropped."""
    from .functions.text import text_fallback
    c = _t(spark, sf, "conversations")
    # the next turn of the same conversation: skew-safe in-conversation ranks, then an
    # equi-join on (conversation, rank + 1) instead of a window over a whole conversation
    ranked = ordering.rank_within_group(c, "conv_id", [F.col("turn")], "_rk")
    nxt = ranked.select("conv_id", (F.col("_rk") - 1).alias("_rk"), F.col("text").alias("feed"))
    x = ranked.join(nxt, ["conv_id", "_rk"], "left") \
        .withColumn("article", F.regexp_replace("text", "^\\s+|\\s+$", ""))
    out = x.select("conv_id", "turn", text_fallback(F.col("article"), F.col("feed")).alias("text"))
    return out.filter(F.col("text").isNotNull()).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


def sql_text_fallback():
    return """SELECT conv_id, turn, length(t) AS n_chars FROM (
  SELECT conv_id, turn, coalesce(nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''),
                                 nullif(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS t
  FROM conversations) WHERE t IS NOT NULL"""


AUTHOR = "src7"


def q_drop_by_author(spark, sf):
    d = _t(spark, sf, "documents")
    html = F.concat(F.lit('<div><a class="pi_author" href="#">'), F.col("source"), F.lit("</a></div>"))
    return d.filter(~filters.author_is(html, AUTHOR)).select("doc_id")


def sql_drop_by_author():
    html = "'<div><a class=\"pi_author\" href=\"#\">' || source || '</a></div>'"
    pat = '<a[^>]*class="pi_author"[^>]*>([^<]*)</a>'
    return (f"SELECT doc_id FROM documents WHERE NOT list_contains(regexp_extract_all({html}, {O.q(pat)}, 1), "
            f"{O.q(AUTHOR)})")


def q_collective_flag(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", filters.collective_flag(F.col("text"), LATIN_COLLECTIVE_WORDS).alias("flag"))


def sql_collective_flag():
    return (f"SELECT doc_id, CASE WHEN list_has_any(regexp_split_to_array(lower(text), '\\s+'), "
            f"{O.sql_list(LATIN_COLLECTIVE_WORDS)}) THEN 1 ELSE 0 END AS flag FROM documents")


# --- F11 / J3 / U1 ---------------------------------------------------------------

def _vk_items(d: DataFrame) -> DataFrame:
    """Documents as social posts: French ones repost the next post by id, German ones
    are yesterday's sends (history)."""
    marker = F.concat(F.lit('\nReposted (<a data-post-id="-1_'), (F.col("doc_id") + 1).cast("string"),
                      F.lit('">post</a>)'))
    return d.select(F.col("doc_id").alias("pos"),
                    F.concat(F.lit("https://vk.com/wall-1_"), F.col("doc_id").cast("string")).alias("url"),
                    F.when(F.col("lang") == "fr", F.concat(F.col("text"), marker)).otherwise(F.col("text")).alias("text"),
                    "lang")


def q_drop_reposts(spark, sf):
    items = _vk_items(_t(spark, sf, "documents"))
    hist = items.filter(F.col("lang") == "de").select(
        F.concat(F.lit("https://vk.com/wall-1_"), (F.col("pos") + 1000000).cast("string")).alias("url"))
    hist = hist.unionByName(items.filter(F.col("lang") == "es").select(
        F.concat(F.lit("https://vk.com/wall-1_"), (F.col("pos") + 2).cast("string")).alias("url")))
    return filters.drop_reposts(items.drop("lang"), hist).select("pos", "url")


def sql_drop_reposts():
    items = ("SELECT doc_id AS pos, 'https://vk.com/wall-1_' || CAST(doc_id AS VARCHAR) AS url, "
             "CASE WHEN lang = 'fr' THEN text || chr(10) || 'Reposted (<a data-post-id=\"-1_' || CAST(doc_id + 1 AS VARCHAR) || '\">post</a>)' "
             "ELSE text END AS text, lang FROM documents")
    hist = ("SELECT 'https://vk.com/wall-1_' || CAST(pos + 1000000 AS VARCHAR) AS url FROM items WHERE lang = 'de' "
            "UNION ALL SELECT 'https://vk.com/wall-1_' || CAST(pos + 2 AS VARCHAR) FROM items WHERE lang = 'es'")
    tgt = O.repost_target("c.text")
    return f"""WITH items AS ({items}), hist AS ({hist})
SELECT c.pos, c.url FROM items c
WHERE NOT ({O.netloc('c.url')} = 'vk.com' AND {O.repost_has_marker('c.text')} AND (
  EXISTS (SELECT 1 FROM items d WHERE {O.netloc('d.url')} = 'vk.com' AND d.url = {tgt} AND d.pos <> c.pos)
  OR EXISTS (SELECT 1 FROM hist h WHERE h.url = {tgt})))"""


# --- W1, W2, A7 -------------------------------------------------------------------

def q_domain_counts(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    return ordering.domain_counts(p)


def sql_domain_counts():
    return f"SELECT {O.netloc('url')} AS netloc, count(*) AS n_items, min(page_id) AS first_pos FROM pages GROUP BY 1"


def q_interleave_domains(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    inter = ordering.interleave_domains(p)
    numbered = ordering.global_row_number(inter, ordering.interleave_sort_cols(), "out_pos")
    return numbered.select("out_pos", "pos", "url")


def sql_interleave_domains():
    return f"""WITH h AS (SELECT {O.netloc('url')} AS netloc, count(*) AS cnt, min(page_id) AS fp FROM pages GROUP BY 1),
r AS (SELECT page_id AS pos, url, {O.netloc('url')} AS netloc,
             row_number() OVER (PARTITION BY {O.netloc('url')} ORDER BY page_id) AS rnd FROM pages)
SELECT row_number() OVER (ORDER BY r.rnd, h.cnt DESC, h.fp) AS out_pos, r.pos, r.url
FROM r JOIN h USING (netloc)"""


def q_batch_assign(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    return ordering.batch_assign(p, CFG.batch_size).select("pos", F.col("batch").cast("long").alias("batch"))


def sql_batch_assign():
    return f"""SELECT page_id AS pos,
  ntile(CAST(ceil((SELECT count(*) FROM pages) / {float(CFG.batch_size)}) AS INTEGER)) OVER (ORDER BY page_id) AS batch
FROM pages"""


# --- J1, A2, J2 (state) -------------------------------------------------------------

def _keyed(d: DataFrame, run_no: int) -> DataFrame:
    parts = F.split(F.col("text"), "\n", 2)
    first_word = F.lower(F.regexp_extract(F.element_at(parts, 1), "^\\s*(\\S+)", 1))
    return d.select(F.col("source").alias("site_name"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), first_word).alias("href2"),
                    F.element_at(parts, 1).alias("title"), F.col("doc_id").alias("pos"),
                    F.lit(run_no).alias("run_no"), "lang")


def _keyed_sql(run_no: int) -> str:
    fw = f"lower(regexp_extract({O.doc_title('text')}, '^\\s*(\\S+)', 1))"
    return (f"SELECT source AS site_name, 'https://' || source || '.example.org/' || {fw} AS href2, "
            f"{O.doc_title('text')} AS title, doc_id AS pos, {run_no} AS run_no, lang FROM documents")


def q_new_items(spark, sf):
    d = _t(spark, sf, "documents")
    st = _keyed(d, 1).filter(F.col("lang") != "en")
    return state.new_items(_keyed(d, 2), st).select("site_name", "href2", "pos")


def sql_new_items():
    return f"""WITH st AS ({_keyed_sql(1)}), run AS ({_keyed_sql(2)})
SELECT site_name, href2, pos FROM run r
WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.lang <> 'en' AND s.site_name = r.site_name AND s.href2 = r.href2)"""


def q_state_upsert(spark, sf):
    d = _t(spark, sf, "documents")
    st = _keyed(d, 1).filter(F.col("lang") != "en").drop("lang")
    run = _keyed(d, 2).filter(F.col("lang") == "en").drop("lang")
    return state.upsert(st, run).select("site_name", "href2", "title", "pos", "run_no")


def sql_state_upsert():
    return f"""WITH a AS (SELECT * FROM ({_keyed_sql(1)}) WHERE lang <> 'en'
                UNION ALL SELECT * FROM ({_keyed_sql(2)}) WHERE lang = 'en')
SELECT site_name, href2, arg_max(title, (run_no, pos)) AS title, arg_max(pos, (run_no, pos)) AS pos,
       arg_max(run_no, (run_no, pos)) AS run_no
FROM a GROUP BY site_name, href2"""


def _doc_urls(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"),
                                       F.col("doc_id").cast("string")).alias("url"), "text")


def q_unsent_urls(spark, sf):
    d = _doc_urls(_t(spark, sf, "documents"))
    found = d.select(F.regexp_replace("url", "/[0-9]+$", "/").alias("url"), "text", "doc_id")
    hist = (_t(spark, sf, "labels").filter(F.col("toxic") == 1)
            .join(_t(spark, sf, "documents"), "doc_id")
            .select(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/")).alias("url")))
    return state.unsent(found, hist, "text", "doc_id").select("url", "doc_id")


def sql_unsent_urls():
    return """WITH found AS (SELECT 'https://' || source || '.example.org/' AS url, text, doc_id FROM documents),
hist AS (SELECT 'https://' || d.source || '.example.org/' AS url FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1)
SELECT url, doc_id FROM found WHERE url NOT IN (SELECT url FROM hist)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY text) = 1"""


# --- K1 / J6 / S9 -----------------------------------------------------------------

def _sites(spark, d: DataFrame) -> DataFrame:
    src = d.select("source").distinct().select(
        F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("site_pos"), F.col("source").alias("site_name"))
    extra = spark.createDataFrame([(10_000, "empty_site")], "site_pos int, site_name string")
    return src.unionByName(extra)


def _today_items(d: DataFrame) -> DataFrame:
    it = _items(d)
    kept = filters.keyword_filter(it, KEYWORDS, "title", "body")
    return kept.select("site_name", F.concat(F.lit("https://"), F.col("site_name"), F.lit(".example.org/"),
                                             F.col("doc_id").cast("string")).alias("href2"),
                       F.lit(str(RUN_DATE)).alias("date"), "title")


def q_daily_report(spark, sf):
    d = _t(spark, sf, "documents")
    return state.report_rows(_sites(spark, d), _today_items(d)).select(
        "site_pos", "site_name", "row_no", "href2", "cell_html")


def sql_daily_report():
    items = (f"SELECT site_name, 'https://' || site_name || '.example.org/' || CAST(doc_id AS VARCHAR) AS href2, "
             f"'{RUN_DATE}' AS date, title FROM ({_items_sql()}) WHERE {_kw_sql('title')} OR {_kw_sql('body')}")
    return f"""WITH sites AS (
  SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS site_pos, source AS site_name FROM documents
  UNION ALL SELECT 10000, 'empty_site'),
it AS ({items})
SELECT s.site_pos, s.site_name,
  CASE WHEN it.href2 IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY s.site_name ORDER BY it.href2 NULLS FIRST) END AS row_no,
  it.href2,
  CASE WHEN it.href2 IS NULL THEN {O.q('<th>' + REPORT_NOTHING_FOUND + '</th><th></th></tr>')}
       ELSE printf('<th>%s</th><th>%s</th><th><a href="%s">%s</a></th></tr>', coalesce(it.date, ''), coalesce(it.title, ''), it.href2, it.href2) END AS cell_html
FROM sites s LEFT JOIN it USING (site_name)"""


def q_state_load(spark, sf):
    """The day's report is written by its sink and read back as state."""
    d = _t(spark, sf, "documents")
    path = f"{stream_dir(spark, 'report')}/report"
    state.write_report(state.report_rows(_sites(spark, d), _today_items(d)), _sites(spark, d), path, RUN_DATE)
    return state.read_report(spark, path, RUN_DATE)


def sql_state_load():
    items = (f"SELECT site_name, 'https://' || site_name || '.example.org/' || CAST(doc_id AS VARCHAR) AS href2, "
             f"'{RUN_DATE}' AS date, title FROM ({_items_sql()}) WHERE {_kw_sql('title')} OR {_kw_sql('body')}")
    return f"SELECT site_name, href2, date, title FROM ({items})"


# --- T3 / T4 with a lexicon table ---------------------------------------------------------

def q_lemmatize_join(spark, sf):
    """The lexicon is as large as the data: each word of the conversations that ends in s, without it."""
    words = _t(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), "[ \n]")).alias("form")).distinct()
    lexicon = words.filter(F.col("form").rlike("^[a-z]{3,}s$")).select("form", F.regexp_replace("form", "s$", "").alias("replacement"))
    docs = _t(spark, sf, "documents").select("doc_id", F.split(F.lower("text"), "[ \n]").alias("tokens"))
    found = lexicon_ops.replace_tokens(docs, lexicon, "doc_id")
    return found.select("doc_id", F.md5(F.array_join("tokens", " ")).alias("text_md5"))


def sql_lemmatize_join():
    words = "string_split_regex(lower(text), '[ ' || chr(10) || ']')"
    return f"""WITH lex AS (SELECT DISTINCT form, regexp_replace(form, 's$', '') AS replacement
  FROM (SELECT unnest({words}) AS form FROM conversations) WHERE regexp_full_match(form, '[a-z]{{3,}}s')),
t AS (SELECT doc_id, unnest({words}) AS form, unnest(range(0, len({words}))) AS place FROM documents)
SELECT doc_id, md5(string_agg(coalesce(replacement, form), ' ' ORDER BY place)) AS text_md5 FROM t LEFT JOIN lex USING (form) GROUP BY doc_id"""


# --- K2 / S10 ------------------------------------------------------------------------

def _history(spark, sf) -> DataFrame:
    lab = _t(spark, sf, "labels")
    d = _t(spark, sf, "documents").select("doc_id", "source")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        ((F.col("quality") + F.col("toxic")) / F.lit(2.0)).alias("prob"))


def q_history_write(spark, sf):
    return state.history_lines(_history(spark, sf), RUN_DATE)


def _history_sql() -> str:
    return ("SELECT l.doc_id AS pos, 'https://' || d.source || '.example.org/' || CAST(l.doc_id AS VARCHAR) AS url, "
            "(l.quality + l.toxic) / 2.0 AS prob FROM labels l JOIN documents d USING (doc_id)")


def sql_history_write():
    return f"""SELECT 1 AS part, -prob AS k, pos, CAST(prob AS VARCHAR) || ' ' || url AS line FROM ({_history_sql()})
UNION ALL SELECT 0, NULL, NULL, '{RUN_DATE.strftime('%d/%m/%Y')}'"""


def q_history_reload(spark, sf):
    """today's history as the K2 sink wrote it, another day's beside it."""
    path = f"{stream_dir(spark, 'history')}/history"
    h = _history(spark, sf)
    state.write_history(h, path, RUN_DATE)
    state.write_history(h.filter("prob > 0.5"), path, RUN_DATE - dt.timedelta(days=1))
    return state.read_history(spark, path, RUN_DATE)


def sql_history_reload():
    return f"SELECT url, prob FROM ({_history_sql()})"


def q_history_load(spark, sf):
    """Two history files built from labels: today's (quality = 1 rows) and
    yesterday's (the rest); only today's rows load."""
    h = _history(spark, sf).withColumn("file", F.when(F.col("prob") >= 0.5, "today").otherwise("old"))
    body = h.select("file", F.col("pos").alias("line_no"), F.format_string("%s %s", F.col("prob").cast("string"), F.col("url")).alias("value"))
    yday = RUN_DATE - dt.timedelta(days=1)
    heads = spark.createDataFrame([("today", 0, RUN_DATE.strftime("%d/%m/%Y") + "\n"),
                                   ("old", 0, yday.strftime("%d/%m/%Y"))], "file string, line_no long, value string")
    lines = heads.unionByName(body.withColumn("line_no", F.col("line_no") + 1))
    return state.parse_history(lines, RUN_DATE).select("url", "prob")


def sql_history_load():
    return f"SELECT url, prob FROM ({_history_sql()}) WHERE prob >= 0.5"


QUERIES = {
    "url_parts": (q_url_parts, sql_url_parts),
    "url_valid": (q_url_valid, sql_url_valid),
    "resolve_link": (q_resolve_link, sql_resolve_link),
    "clean_source_url": (q_clean_source_url, sql_clean_source_url),
    "unwrap_archive": (q_unwrap_archive, sql_unwrap_archive),
    "messenger_link_roundtrip": (q_messenger_link_roundtrip, sql_messenger_link_roundtrip),
    "canonical_domain": (q_canonical_domain, sql_canonical_domain),
    "domain_routing": (q_domain_routing, sql_domain_routing),
    "kw_filter": (q_kw_filter, sql_kw_filter),
    "kw_filter_title_or_text": (q_kw_filter_title_or_text, sql_kw_filter_title_or_text),
    "kw_filter_large": (q_kw_filter_large, sql_kw_filter_large),
    "nonblank_text": (q_nonblank_text, sql_nonblank_text),
    "strip_boilerplate": (q_strip_boilerplate, sql_strip_boilerplate),
    "candidate_text": (q_candidate_text, sql_candidate_text),
    "text_fallback": (q_text_fallback, sql_text_fallback),
    "drop_by_author": (q_drop_by_author, sql_drop_by_author),
    "collective_flag": (q_collective_flag, sql_collective_flag),
    "drop_reposts": (q_drop_reposts, sql_drop_reposts),
    "domain_counts": (q_domain_counts, sql_domain_counts),
    "interleave_domains": (q_interleave_domains, sql_interleave_domains),
    "batch_assign": (q_batch_assign, sql_batch_assign),
    "new_items": (q_new_items, sql_new_items),
    "state_upsert": (q_state_upsert, sql_state_upsert),
    "unsent_urls": (q_unsent_urls, sql_unsent_urls),
    "daily_report": (q_daily_report, sql_daily_report),
    "state_load": (q_state_load, sql_state_load),
    "history_write": (q_history_write, sql_history_write),
    "lemmatize_join": (q_lemmatize_join, sql_lemmatize_join),
    "history_reload": (q_history_reload, sql_history_reload),
    "history_load": (q_history_load, sql_history_load),
}
