"""The digest (M8, the flagship), the v2 scorer (M5) and their shared stages.

documents -> candidates (P16) -> repost removal (F11) -> domain interleave (W1) ->
messenger link fix (P10) -> today filter (F4) -> boilerplate (P12) -> non-blank (F7)
-> exact distinct, first URL wins (A1) -> clean (T15, head pushed down) -> TF-IDF (M1)
-> logistic score (M2) rounded half-even (P18) -> threshold (F10) -> not yet sent
(J2) -> text-order index -> cosine pairs (J9) -> leader clusters (A5) -> groups (A3,
A4) -> digest lines (K3).

Texts stay behind. Order, distinct texts and duplicates are decided on narrow rows: positions and
128-bit digests of texts. The first paragraphs are fetched once for the distinct rows, to be cleaned, and
whole texts once for the found rows, which are put in text order. Cleaned rows and vectors are
written as Parquet (they feed the fit, the scorer and the pair join); the clustering rounds are the only
driver loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (DIGEST_GROUPS_HEADER, DIGEST_SEPARATOR, DIGEST_SINGLES_HEADER, Config,
                      LATIN_ENTITIES, LATIN_LEMMAS, LATIN_STOPWORDS, latin_config)
from ..functions import text as T
from ..functions.dates import with_day
from ..functions.urls import fix_messenger_link, undo_messenger_link
from ..operators import dedup, filters, ordering, scoring, state
from ..session import cut_to_parquet


@dataclass(frozen=True)
class TextResources:
    """Dictionaries of the cleaning step (stop words, gazetteer, lemmas)."""
    stops: tuple = ()
    entities: tuple = ()
    lemmas: tuple = ()

    def stop_list(self, cfg: Config) -> list[str]:
        # The negation word is never a stop word
        return [w for w in dict.fromkeys(s.strip() for s in self.stops) if w and w != cfg.negation]


def latin_resources() -> TextResources:
    return TextResources(stops=LATIN_STOPWORDS, entities=LATIN_ENTITIES, lemmas=LATIN_LEMMAS)


def clean_column(col, cfg: Config, res: TextResources, head_n: int | None = None):
    return T.clean_text(col, cfg, res.stop_list(cfg), T.entity_map(res.entities, cfg),
                        T.dictionary_map(res.lemmas), head_n=head_n)


def candidates_from_documents(docs: DataFrame, cfg: Config) -> DataFrame:
    """Documents as digest candidates: pos = doc_id, url from source and id, title =
    first line, text = the rest, candidate text = title + newline + text (P16), undated
    (an empty date parses to the run time, so it is today)."""
    parts = F.split(F.col("text"), "\n", 2)
    return docs.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(cfg.run_day).alias("day"),
        T.candidate_text(F.element_at(parts, 1),
                         F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.lit(""))).alias("text"),
    )


def with_articles(cands: DataFrame, articles: DataFrame | None) -> DataFrame:
    """M6 in the scorer: a candidate whose article was resolved (pos, text) is judged by it, the others by
    their own text (P13)."""
    if articles is None:
        return cands
    # read several times below, so it is not extracted again each time
    found = cut_to_parquet(articles.select("pos", F.col("text").alias("article")), "articles")
    return cands.join(found, "pos", "left").withColumn("text", T.text_fallback(F.col("article"), F.col("text"))).drop("article")


def with_days(cands: DataFrame, dates: DataFrame | None, cfg: Config) -> DataFrame:
    """P7 in the scorer: the day of a candidate is that of its date string (pos, date_str); without one it is the run
    day."""
    if dates is None:
        return cands
    x = cands.drop("day").join(dates.select("pos", "date_str"), "pos", "left")
    return with_day(x.withColumn("date_str", F.coalesce("date_str", F.lit(""))), "date_str", "day", cfg).drop("date_str")


def text_digest(text):
    """128 bits of the SHA-256 of a text; null for null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def judged_text(cfg: Config):
    """A candidate's text without boilerplate."""
    return T.strip_boilerplate(F.col("text"), cfg.boilerplate)


def ordered_candidates(cands: DataFrame, known_urls: DataFrame | None) -> DataFrame:
    """F11 then W1: (pos, order), reposts dropped, each other row with its interleave order key. No text is
    sorted or shuffled."""
    kept = cands.select("pos", "url").join(filters.repost_positions(cands, known_urls), "pos", "left_anti")
    return ordering.interleave_domains(kept).select("pos", F.col("order_key").alias("order"))


def distinct_candidates(cands: DataFrame, known_urls: DataFrame | None, cfg: Config) -> DataFrame:
    """The position of the first row, in interleave order, of each of today's distinct texts.

    Texts are told apart by their digests, which are taken at the scan; the buffer is two numbers, so a text that
    repeats in a third of all rows is combined map-side by hashing."""
    text = judged_text(cfg)
    narrow = (filters.today_filter(cands, cfg.run_day)
              .select("pos", F.when(T.has_text(text), text_digest(text)).alias("digest")).filter("digest IS NOT NULL"))
    return (narrow.join(ordered_candidates(cands, known_urls), "pos")
            .groupBy("digest").agg(F.min_by("pos", "order").alias("pos")).select("pos"))


def fetch(rows: DataFrame, cands: DataFrame, **columns) -> DataFrame:
    """rows (pos, ...) with columns that are computed from their candidates before they meet (an inner join: a
    semi join would be moved below the columns, and whole texts shuffled)."""
    return rows.join(cands.select("pos", *[c.alias(name) for name, c in columns.items()]), "pos")


def resolved_texts(cands: DataFrame, known_urls: DataFrame | None, cfg: Config) -> DataFrame:
    """The distinct candidates (pos, url, text) with whole texts and fixed links (P10)."""
    return fetch(distinct_candidates(cands, known_urls, cfg), cands, url=fix_messenger_link(F.col("url")), text=judged_text(cfg))


def scored(cands: DataFrame, known_urls: DataFrame | None, labels: DataFrame, cfg: Config, res: TextResources):
    """Clean and vectorise the distinct candidates, fit the model on the labelled texts and score every text.
    Returns (scored rows (pos, url, digest, prob), vectors (:func:`scoring.packed_vectors`, id=pos)); ``digest`` is that of the cleaned text."""
    lead = T.paragraphs(judged_text(cfg))
    lead = F.array_join(T.head(lead, cfg.head_paragraphs) if cfg.head_paragraphs else lead, "\n")
    distinct = fetch(distinct_candidates(cands, known_urls, cfg), cands, url=fix_messenger_link(F.col("url")), lead=lead)
    cleaned = cut_to_parquet(distinct.select("pos", "url", clean_column(F.col("lead"), cfg, res).alias("cleaned"))
                             .withColumn("digest", text_digest(F.col("cleaned"))), "cleaned")
    # a row per text: what follows moves bags and vectors whole, not a row per term
    bags = cut_to_parquet(scoring.bags(scoring.doc_terms(cleaned, "pos", "cleaned")), "bags")
    terms = scoring.bag_terms(bags)
    weights, b = scoring.fit_linear_model(terms, labels)
    vectors = cut_to_parquet(scoring.packed_vectors(bags, scoring.fit_idf(terms, cleaned.count()), weights), "tfidf")
    probs = scoring.lr_score(cleaned.select(F.col("pos").alias("id"), "url", "digest"), vectors, weights, b)
    return probs.withColumnRenamed("id", "pos"), vectors


def scored_raw(cands: DataFrame, known_urls: DataFrame | None, labels: DataFrame, cfg: Config):
    """Rows (id, url, prob) with a non-zero vector (F8) of the whole raw texts. The vectors themselves are asked for by
    nothing, so terms and scores are counted without them."""
    distinct = resolved_texts(cands, known_urls, cfg)
    rows = cut_to_parquet(distinct.select(F.col("pos").alias("id"), "url", scoring.raw_tokens("text").alias("tokens")), "tokens")
    terms = cut_to_parquet(scoring.token_counts(rows.select("id", "tokens").repartition("id"), "id", "tokens"), "terms")
    weights, b = scoring.fit_linear_model(terms, labels)
    probs = scoring.score_counts(terms, scoring.fit_idf(terms, rows.count()), weights, b)
    return scoring.nonzero_vector(rows.select("id", "url"), terms).join(probs, "id")


#: Characters of a text that it is sorted by where no other text begins with them.
TEXT_HEAD = 32


def in_text_order(found: DataFrame, cands: DataFrame, cfg: Config) -> DataFrame:
    """found (pos, ...) with ``text_no``, the place of its text among the found ones. Found rows meet the first characters
    of their texts, which are sorted by and left; only rows that share them with another row meet whole texts."""
    found = cut_to_parquet(found, "scored")  # read twice
    text = judged_text(cfg)
    head = F.substring(text, 1, TEXT_HEAD)
    rows = cut_to_parquet(fetch(found.select("pos").distinct(), cands, head=head), "heads")
    shared = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("head")
    ties = cut_to_parquet(rows.join(shared, "head", "left_semi").select("pos").distinct(), "ties")
    alone = rows.join(ties, "pos", "left_anti").withColumn("text", F.lit(None).cast("string"))
    tied = fetch(ties, cands, head=head, text=text)
    places = ordering.global_row_number(alone.unionByName(tied), [F.col("head"), F.col("text"), F.col("pos")], "text_no", drop=("head", "text"))
    return found.join(places, "pos")


def score_news_v1(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: Config,
                  history: DataFrame | None = None) -> DataFrame:
    """M4: the first-generation scorer: raw-text TF-IDF (no cleaning), rows with a zero
    vector dropped (F8), raw probability at or above the v1 threshold (F9), not yet sent
    (J2), links shown undone (P10). Returns (pos, url, prob)."""
    cands = candidates_from_documents(docs, cfg)
    probs = scored_raw(cands, history, labels, cfg)
    found = scoring.threshold_v1(probs, cfg.threshold_v1).withColumnRenamed("id", "pos")
    found = state.unsent(in_text_order(found, cands, cfg), history, "text_no")
    return found.select("pos", undo_messenger_link(F.col("url")).alias("url"), "prob")


def score_news_v2(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: Config,
                  res: TextResources, history: DataFrame | None = None,
                  known_urls: DataFrame | None = None, articles: DataFrame | None = None, dates: DataFrame | None = None):
    """M5: found rows (pos, url, digest, prob, text_no) with prob rounded to 3 decimals, at or above
    the v2 threshold, not yet in the history, their texts' order; also returns the vectors."""
    cands = with_days(with_articles(candidates_from_documents(docs, cfg), articles), dates, cfg)
    probs, vectors = scored(cands, known_urls, labels, cfg, res)
    found = (scoring.threshold_v2(probs, cfg.threshold_v2)
             .withColumn("prob", scoring.round_prob("prob")))
    # Not in today's history; a URL is reported once, the first text in text order wins
    # materialised once: the numbering below reads it twice (sample, then sort)
    found = cut_to_parquet(state.unsent(in_text_order(found, cands, cfg), history, "text_no"), "found")
    return found, vectors


def digest_rows(found: DataFrame, vectors: DataFrame, cfg: Config) -> DataFrame:
    """From found rows to digest lines: text-order index, pairs, leaders, groups, lines.
    Returns (line_no, line)."""
    indexed = ordering.global_row_number(found, [F.col("text_no")], "idx")
    leaders = text_order_leaders(indexed, vectors, cfg)
    members = indexed.join(leaders, "idx").select("idx", "leader", "prob", "url")
    groups = dedup.dup_groups(members)
    return digest_lines(members, groups)


def text_order_leaders(indexed: DataFrame, vectors: DataFrame, cfg: Config) -> DataFrame:
    """A5 over the found rows in text order: (idx, leader).

    Rows with equal cleaned text (equal, non-zero vectors) are collapsed to the
    smallest index first: such a row always gets the same leader as that
    representative, so only representatives enter the pair join and the rounds; a hot
    group of copies that survive exact-text dedup costs one representative, not a
    quadratic number of pairs. Zero vectors never match anything and stay singletons
    (or share id -1 with ``zero_vectors_one_group``)."""
    ids = indexed.select(F.col("pos").alias("id"), "idx", "digest")
    nz = ids.join(vectors.select("id"), "id", "left_semi")
    reps = cut_to_parquet(nz.groupBy("digest").agg(F.min("idx").alias("rep"), F.min_by("id", "idx").alias("id")), "reps")
    rep_of = nz.join(reps.drop("id"), "digest").select("idx", "rep")
    # no term holds a space; one string is shuffled in less room than an array of strings
    vec = (vectors.select("id", F.array_join("terms", " ").alias("line"), "raws", "norm").join(reps.select("id", "rep"), "id")
           .select(F.col("rep").alias("id"), F.split("line", " ").alias("terms"), "raws", "norm"))
    rep_leaders = dedup.greedy_leaders(cut_to_parquet(vec, "vectors"), cfg.ksim).withColumnRenamed("id", "rep")
    lead_nz = rep_of.join(rep_leaders, "rep").select("idx", "leader")
    zero = indexed.select("idx").join(rep_of.select("idx"), "idx", "left_anti")
    zero_leader = F.lit(-1).cast("long") if cfg.zero_vectors_one_group else F.col("idx")
    return lead_nz.unionByName(zero.select("idx", zero_leader.alias("leader")))


def digest_lines(members: DataFrame, groups: DataFrame) -> DataFrame:
    """K3: singles header, one ``%.3f url`` line per single group (groups by max prob
    desc, then leader), groups header, a dashed separator before each multi group and
    its member lines (index order), trailing dashes. Emitted even when empty.

    The composite sort key is materialised into a line number with a scalable global
    row number (no single-partition window)."""
    spark = members.sparkSession
    m = members.join(groups, "leader")
    line = F.format_string("%.3f %s", F.col("prob"), undo_messenger_link(F.col("url")))
    body = m.select(F.when(F.col("is_single"), F.lit(1)).otherwise(F.lit(3)).alias("sec"),
                    (-F.col("max_prob")).alias("gk"), F.col("leader").alias("gl"),
                    F.lit(1).alias("sub"), F.col("idx").alias("mk"), line.alias("line"))
    seps = groups.filter(~F.col("is_single")).select(
        F.lit(3).alias("sec"), (-F.col("max_prob")).alias("gk"), F.col("leader").alias("gl"),
        F.lit(0).alias("sub"), F.lit(None).cast("long").alias("mk"), F.lit(DIGEST_SEPARATOR).alias("line"))
    # the three fixed lines come from a JVM range (no Python-side rows to ship)
    sec = F.element_at(F.array(F.lit(0), F.lit(2), F.lit(4)), (F.col("id") + 1).cast("int"))
    text = F.element_at(F.array(F.lit(DIGEST_SINGLES_HEADER), F.lit(DIGEST_GROUPS_HEADER), F.lit(DIGEST_SEPARATOR)),
                        (F.col("id") + 1).cast("int"))
    fixed = spark.range(3).select(
        sec.alias("sec"), F.lit(None).cast("double").alias("gk"), F.lit(None).cast("long").alias("gl"),
        F.lit(0).alias("sub"), F.lit(None).cast("long").alias("mk"), text.alias("line"))
    allrows = body.unionByName(seps).unionByName(fixed)
    numbered = ordering.global_row_number(
        allrows, [F.col("sec"), F.col("gk").asc_nulls_first(), F.col("gl").asc_nulls_first(),
                  F.col("sub"), F.col("mk").asc_nulls_first()], "line_no")
    return numbered.select("line_no", "line")


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: Config | None = None,
           res: TextResources | None = None, history: DataFrame | None = None, articles: DataFrame | None = None,
           dates: DataFrame | None = None) -> DataFrame:
    """M8: the whole digest over a documents table, with the articles that were resolved (pos, text), the date
    strings of the items (pos, date_str) and the day's history (url), where there are any."""
    cfg = cfg or latin_config()
    res = res or latin_resources()
    found, vectors = score_news_v2(spark, docs, labels, cfg, res, history, known_urls=history, articles=articles, dates=dates)
    return digest_rows(found, vectors, cfg)


def write_digest(lines: DataFrame, path: str, run_date) -> None:
    """K3 sink: the digest message as text lines under ``run_date=<day>`` in line order
    (range sort, part files in order), rewriting only that day."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (lines.withColumn("run_date", F.lit(run_date)).orderBy("line_no")
     .select("run_date", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("run_date").text(path))
