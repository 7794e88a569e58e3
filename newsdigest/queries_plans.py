"""Composition queries: v1 scorer (M4), article resolution (M6), ingest (M7) and the
Spark ML training path (M3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import oracle as O
from . import queries_dates as QD
from . import queries_digest as QG
from . import queries_sources as QS
from .config import latin_config
from .functions.urls import netloc, origin
from .operators import filters
from .plans import digest as D
from .plans import ingest as I
from .session import ensure_checkpoint_dir, read_table
from .sources import extract as X

CFG = latin_config()
INGEST_KEYWORDS = filters.normalise_words(["The", " ble "])


def _t(spark, sf, name):
    return read_table(spark, sf, name, spread_rows=name in ("documents", "pages"))


# --- M4 -------------------------------------------------------------------------------

def q_score_news_v1(spark, sf):
    out = D.score_news_v1(spark, _t(spark, sf, "documents"), _t(spark, sf, "labels"), CFG)
    return out.select("pos", "url", F.round("prob", 6).alias("prob"))


def sql_score_news_v1():
    chain = QG.chain_sql(raw_terms=True)
    return f"""WITH {chain}
SELECT pos, {O.undo_messenger('url')} AS url, round(prob, 6) AS prob FROM probs
WHERE pos IN (SELECT id FROM vec) AND prob >= {CFG.threshold_v1!r}
QUALIFY row_number() OVER (PARTITION BY url ORDER BY text) = 1"""


# --- M6 -------------------------------------------------------------------------------

def q_resolve_texts(spark, sf):
    pages = _t(spark, sf, "pages")
    feed = pages.select("page_id", F.concat(F.lit("feed "), F.col("url")).alias("feed_text"))
    out = I.resolve_texts(pages, feed, QS._rules(spark), QS._suffixes(spark), CFG.boilerplate)
    return out.select("page_id", "url", "text")


def sql_resolve_texts():
    body = QS._article_sql_body()
    text = O.strip_boilerplate("coalesce(nullif(a.text, ''), nullif('feed ' || p.url, ''))", CFG.boilerplate)
    return f"""SELECT page_id, url, t AS text FROM (
  SELECT a.page_id, p.url, {text} AS t FROM ({body}) a JOIN pages p USING (page_id))
WHERE {O.has_text('t')}"""


# --- M7 -------------------------------------------------------------------------------

def _dates(spark, sf):
    return QD.date_strings(spark, sf).select(F.col("event_id").alias("page_id"), "date_str")


def _sites(spark, sf):
    return (_t(spark, sf, "pages").groupBy(netloc(F.col("url")).alias("site_name"))
            .agg(F.min("page_id").alias("site_pos")))


def q_ingest(spark, sf):
    cfg = CFG
    _, report = I.ingest(_t(spark, sf, "pages"), _dates(spark, sf), _sites(spark, sf), cfg, INGEST_KEYWORDS)
    return report.select("site_pos", "site_name", "row_no", "href2", "cell_html")


def _kw_sql(t: str) -> str:
    return (f"(coalesce({t}, '') <> '' AND list_bool_or(list_transform({O.sql_list(INGEST_KEYWORDS)}, "
            f"lambda w: contains(lower({t}), w))))")


def sql_ingest():
    hrefs = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)"
    titles = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"
    origin_sql = f"{O.scheme('p.url')} || '://' || {O.netloc('p.url')}"
    day = QD.parse_day_sql("n")
    return f"""WITH ds AS (SELECT event_id AS page_id, {QD._norm_sql('date_str')} AS n FROM ({QD.date_strings_sql()})),
li AS (SELECT page_id, url, unnest({hrefs}) AS href, unnest({titles}) AS title,
              unnest(range(0, len({hrefs}))) AS item_no FROM pages),
it AS (
  SELECT {O.netloc('p.url')} AS site_name, {O.resolve_link(chr(39) * 2, 'p.href', origin_sql)} AS href2,
         {O.strip_ws('p.title')} AS title, strftime({day}, '%Y-%m-%d') AS date, row(p.page_id, p.item_no) AS pos
  FROM li p LEFT JOIN (SELECT page_id, coalesce(n, '') AS n FROM ds) d USING (page_id)
  WHERE {day} = DATE '{CFG.run_day}'
    AND ({_kw_sql(O.strip_ws('p.title'))})
),
st AS (SELECT site_name, href2, arg_max(title, pos) AS title, arg_max(date, pos) AS date FROM it GROUP BY 1, 2),
sites AS (SELECT {O.netloc('url')} AS site_name, min(page_id) AS site_pos FROM pages GROUP BY 1)
SELECT s.site_pos, s.site_name,
  CASE WHEN st.href2 IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY s.site_name ORDER BY st.href2 NULLS FIRST) END AS row_no,
  st.href2,
  CASE WHEN st.href2 IS NULL THEN {O.q('<th>Ничего не найдено</th><th></th></tr>')}
       ELSE printf('<th>%s</th><th>%s</th><th><a href="%s">%s</a></th></tr>', coalesce(st.date, ''), coalesce(st.title, ''), st.href2, st.href2) END AS cell_html
FROM sites s LEFT JOIN st USING (site_name)"""


# --- M7 from configuration, URL lists, captures and prior state --------------------------------

def _run_inputs(spark, sf):
    """Stand-ins: the pages' and the feeds' bodies as captures, URL lists with blank and wrong lines, and a state.

    German pages cannot be fetched; the first attempt at French ones is an error page. Hosts of ``net`` send UTF-8 that was read as
    ISO-8859-1 once. The state knows the English documents and the root link ``/The`` of every host."""
    p = QS._listing_pages(spark, sf)
    is_net = F.substring_index("site_name", ".", -1) == "net"
    latin = F.regexp_replace("html", "[^\\x00-\\x7F]", "\u00e9")
    html = F.when(is_net, F.decode(F.encode(latin, "UTF-8"), "ISO-8859-1")).otherwise(F.col("html"))
    attempt = F.col("page_id") * 2
    bad = p.filter(F.col("lang").isin("de", "fr")).select(
        "url", attempt.alias("attempt"), F.lit(503).alias("status"), F.when(F.col("lang") == "de", F.lit("timeout")).alias("error"),
        F.encode(F.lit("<html><nav><ul><li><a href='/down'>The down</a></li></ul></nav></html>"), "UTF-8").alias("body"))
    good = p.filter(F.col("lang") != "de").select("url", (attempt + 1).alias("attempt"), F.lit(200).alias("status"),
                                                  F.lit(None).cast("string").alias("error"), F.encode(html, "UTF-8").alias("body"))
    feeds = QS._feeds(spark, sf)
    feed_url = F.concat(F.lit("https://feeds.example.org/"), F.col("source"), F.lit("/"), F.col("page").cast("string"))
    captures = bad.unionByName(good).unionByName(feeds.select(
        feed_url.alias("url"), F.lit(1).cast("long").alias("attempt"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"),
        F.encode("xml", "UTF-8").alias("body")))
    own = p.select("site_name", F.explode(F.array(F.struct((F.col("page_id") * 3).alias("line_no"), F.concat(F.lit(" "), F.col("url")).alias("value")),
                                                  F.struct((F.col("page_id") * 3 + 1).alias("line_no"), F.lit("  ").alias("value")),
                                                  F.struct((F.col("page_id") * 3 + 2).alias("line_no"), F.lit("no url").alias("value")))).alias("l"))
    lines = own.select("site_name", "l.line_no", "l.value").unionByName(
        feeds.select(F.col("source").alias("site_name"), F.col("page").alias("line_no"), feed_url.alias("value")))
    known = (_t(spark, sf, "documents").filter(F.col("lang") == "en").select(
        F.col("source").alias("site_name"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("href2"))
        .unionByName(p.select("site_name", F.concat(origin(F.col("url")), F.lit("/The")).alias("href2")).distinct()))
    state = known.select("site_name", "href2", F.lit("known").alias("title"), F.lit(str(CFG.run_day)).alias("date"), F.lit("").alias("city"),
                         F.lit(1).alias("run_no"), F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(0).alias("item_no")).alias("pos"))
    return QS.site_config(spark, sf), lines, captures, state


def q_ingest_sites(spark, sf):
    sites, lines, captures, state = _run_inputs(spark, sf)
    _, report = I.ingest_sites(sites, lines, captures, CFG, INGEST_KEYWORDS, state, run_no=2)
    return report.select("site_pos", "site_name", "row_no", "date", "title", "href2", "cell_html")


def sql_ingest_sites():
    origin_sql = f"{O.scheme('url')} || '://' || {O.netloc('url')}"
    net = f"string_split({O.netloc('url')}, '.')[-1] = 'net'"
    seen = QS.listing_sql(source="got")
    return f"""WITH got AS (
  SELECT p.page_id, p.url, CASE WHEN {net.replace('url', 'p.url')} THEN regexp_replace(c.html, '[^\x00-\x7F]', '\u00e9', 'g') ELSE c.html END AS html
  FROM pages p JOIN (SELECT url, arg_min(html, page_id) AS html FROM pages
                     WHERE regexp_extract(html, '^<!DOCTYPE html><html lang="([^"]*)"', 1) <> 'de' GROUP BY url) c ON c.url = p.url
  WHERE {O.is_valid_url('p.url')}),
it AS (
  SELECT {O.netloc('url')} AS site_name,
    CASE WHEN {net} THEN replace(link, '\u00e9', '\u00c3\u00a9') ELSE link END AS href2, title, page_id * 3 AS line_no, item_no
  FROM (SELECT *, {O.resolve_link(chr(39) * 2, 'href', origin_sql)} AS link FROM ({seen}))
  WHERE date_str IN ('', '{CFG.run_day}') AND ({_kw_sql('title')} OR {_kw_sql('text')})
  UNION ALL
  SELECT source, link, title, page, entry_no FROM ({QS.sql_src_feed_items()}) WHERE {_kw_sql('title')} OR {_kw_sql('summary')}),
known AS (
  SELECT source AS site_name, {O.doc_url('source', 'doc_id')} AS href2 FROM documents WHERE lang = 'en'
  UNION SELECT {O.netloc('url')}, {origin_sql} || '/The' FROM pages),
st AS (
  SELECT site_name, href2, 'known' AS title FROM known
  UNION ALL
  SELECT site_name, href2, arg_max(title, row(line_no, item_no)) FROM it ANTI JOIN known USING (site_name, href2) GROUP BY 1, 2),
sites AS (
  SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS site_pos, source AS site_name FROM documents
  UNION ALL SELECT min(page_id), {O.netloc('url')} FROM pages GROUP BY 2)
SELECT s.site_pos, s.site_name,
  CASE WHEN st.href2 IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY s.site_name ORDER BY st.href2 NULLS FIRST) END AS row_no,
  CASE WHEN st.href2 IS NOT NULL THEN '{CFG.run_day}' END AS date, st.title, st.href2,
  CASE WHEN st.href2 IS NULL THEN {O.q('<th>Ничего не найдено</th><th></th></tr>')}
       ELSE printf('<th>%s</th><th>%s</th><th><a href="%s">%s</a></th></tr>', '{CFG.run_day}', st.title, st.href2, st.href2) END AS cell_html
FROM sites s LEFT JOIN st USING (site_name)"""


# --- M8 with articles, dates and history --------------------------------------------------

def _sent(spark, sf):
    """The day's history: URLs of the documents that are labelled toxic."""
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return d.select(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"))


def _resolved_inputs(spark, sf):
    articles = X.extract_articles(_t(spark, sf, "pages"), QS._rules(spark), QS._suffixes(spark)).filter(~F.col("skipped"))
    dates = QD.date_strings(spark, sf).select(F.col("event_id").alias("pos"), "date_str")
    return {"history": _sent(spark, sf), "articles": articles.select(F.col("page_id").alias("pos"), "text"), "dates": dates}


def q_digest_resolved(spark, sf):
    """The digest of items with their articles (page_id = doc_id), the dates that they carry (event_id =
    doc_id) and what was sent before."""
    return D.digest(spark, _t(spark, sf, "documents"), _t(spark, sf, "labels"), CFG, QG.RES, **_resolved_inputs(spark, sf))


def q_score_news_resolved(spark, sf):
    x = _resolved_inputs(spark, sf)
    found, _ = D.score_news_v2(spark, _t(spark, sf, "documents"), _t(spark, sf, "labels"), CFG, QG.RES, known_urls=x["history"], **x)
    return found.select("pos", "url", "prob")


def _resolved_sql():
    sent = f"SELECT {O.doc_url('source', 'doc_id')} AS url FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    article = f"SELECT page_id AS pos, text FROM ({QS._article_sql_body()})"
    day = (f"SELECT event_id AS pos, {QD.parse_day_sql('n')} AS day FROM "
           f"(SELECT event_id, {QD._norm_sql('date_str')} AS n FROM ({QD.date_strings_sql()}))")
    return QG.chain_sql(sent, article=article, day=day), QG.found_sql(sent)


def sql_digest_resolved():
    return QG.digest_sql(*_resolved_sql())


def sql_score_news_resolved():
    chain, found = _resolved_sql()
    return f"WITH {chain},\n{found}\nSELECT pos, url, prob FROM found"


# --- M3 (rows-only) --------------------------------------------------------------------

#: Buckets of the term hash of ``lr_train_score``. Every term counts, however rare and however many there are, and no
#: vocabulary is built; terms whose buckets meet share a weight. The model is as wide as this.
HASH_WIDTH = 1 << 18


def q_lr_train_score(spark, sf):
    """M3: Spark ML (tokens of the whole cleaned text -> counts of ``HASH_WIDTH`` hashed terms -> idf -> logistic
    regression) fitted on the labelled documents, scoring every document. The texts are cleaned once: their counts
    are written to the checkpoint folder, for the fit and for the scores. A null text has no terms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array
    from .functions.text import vector_terms
    terms = vector_terms(D.clean_column(F.col("text"), CFG, QG.RES, head_n=0))
    cleaned = _t(spark, sf, "documents").select("doc_id", F.coalesce(terms, F.expr("cast(array() as array<string>)")).alias("terms"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hashed-terms-{uuid.uuid4().hex}"
    HashingTF(inputCol="terms", outputCol="tf", numFeatures=HASH_WIDTH).transform(cleaned).drop("terms") \
        .write.option("compression", "zstd").parquet(path)
    counts = spark.read.parquet(path)
    train = counts.join(_t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    # each partition sends a gradient as wide as the model in every iteration, so there is one per core at most
    train = train.coalesce(spark.sparkContext.defaultParallelism)
    pipe = Pipeline(stages=[IDF(inputCol="tf", outputCol="features"),
                            LogisticRegression(maxIter=50, regParam=0.01)])
    scored = pipe.fit(train).transform(counts)
    return scored.select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("prob"))


QUERIES = {
    "score_news_v1": (q_score_news_v1, sql_score_news_v1),
    "resolve_texts": (q_resolve_texts, sql_resolve_texts),
    "ingest": (q_ingest, sql_ingest),
    "ingest_sites": (q_ingest_sites, sql_ingest_sites),
    "digest_resolved": (q_digest_resolved, sql_digest_resolved),
    "score_news_resolved": (q_score_news_resolved, sql_score_news_resolved),
    "lr_train_score": (q_lr_train_score, None),
}
