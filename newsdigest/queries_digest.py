"""Queries of the scoring and duplicate stages (M1, M2, M5, M8, J9, A1, A3-A6, K3, F8-F10,
T1-T15) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .config import DIGEST_GROUPS_HEADER, DIGEST_SEPARATOR, DIGEST_SINGLES_HEADER, LATIN_NAMES, latin_config
from .functions import text as T
from .operators import dedup, ordering, scoring
from .operators.lexicon import mask_spans
from .plans import digest as D
from .session import cut_to_parquet, read_table
from .streaming.stream import stream_dir

CFG = latin_config()
RES = D.latin_resources()


def _docs(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True)


def _labels(spark, sf):
    return read_table(spark, sf, "labels")


def _stops():
    return RES.stop_list(CFG)


def clean_sql(t: str, head_n=None) -> str:
    return O.clean_text(t, CFG, _stops(), list(RES.entities), list(RES.lemmas), head_n)


# ---------------------------------------------------------------------------
# shared SQL chain: candidates -> distinct texts -> cleaned -> vectors -> scores
# ---------------------------------------------------------------------------

def chain_sql(history: str | None = None, raw_terms: bool = False, article: str = "", day: str = "") -> str:
    """CTEs up to ``probs`` (pos, url, text, prob) and ``vec`` (id, term, df, w).
    ``raw_terms``: the v1 vectoriser input (word runs of the raw text, no cleaning). ``article``
    and ``day``: tables (pos, text) and (pos, day) of resolved articles and item days."""
    text = O.candidate_text(O.doc_title('text'), O.doc_rest('text'))
    cands_sql = f"SELECT doc_id AS pos, {O.doc_url('source', 'doc_id')} AS url, {text} AS text, true AS today FROM documents"
    if article:
        cands_sql = f"""SELECT c.pos, c.url, coalesce(nullif(a.text, ''), c.text) AS text,
         coalesce(d.day, DATE '{CFG.run_day}') = DATE '{CFG.run_day}' AS today
  FROM ({cands_sql}) c LEFT JOIN ({article}) a ON a.pos = c.pos LEFT JOIN ({day}) d ON d.pos = c.pos"""
    raw_terms_sql = "regexp_extract_all(cleaned, '[\\p{L}\\p{N}_]{2,}')"
    hist_exists = ""
    if history:
        hist_exists = f" OR EXISTS (SELECT 1 FROM ({history}) h WHERE h.url = {O.repost_target('c.text')})"
    return f"""
cands AS ({cands_sql}),
kept AS (
  SELECT c.* FROM cands c
  WHERE NOT ({O.netloc('c.url')} = 'vk.com' AND {O.repost_has_marker('c.text')} AND (
      EXISTS (SELECT 1 FROM cands d WHERE {O.netloc('d.url')} = 'vk.com'
              AND d.url = {O.repost_target('c.text')} AND d.pos <> c.pos){hist_exists}))
),
hosts AS (SELECT {O.netloc('url')} AS h, count(*) AS cnt, min(pos) AS fp FROM kept GROUP BY 1),
ordered AS (
  SELECT k.pos, {O.fix_messenger('k.url')} AS url,
         {O.strip_boilerplate('k.text', CFG.boilerplate)} AS text,
         row_number() OVER (PARTITION BY {O.netloc('k.url')} ORDER BY k.pos) AS rnd, h.cnt, h.fp, k.today
  FROM kept k JOIN hosts h ON h.h = {O.netloc('k.url')}
),
dist AS (
  SELECT text, first(url ORDER BY rnd, cnt DESC, fp) AS url, first(pos ORDER BY rnd, cnt DESC, fp) AS pos
  FROM ordered WHERE today AND {O.has_text('text')} GROUP BY text
),
cleaned AS (SELECT pos, url, text, {"lower(text)" if raw_terms else clean_sql('text')} AS cleaned FROM dist),
terms AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT pos AS id, unnest({raw_terms_sql if raw_terms else O.vector_terms('cleaned')}) AS term FROM cleaned)
  GROUP BY id, term
),
ndocs AS (SELECT count(*) AS n FROM cleaned),
idf AS (
  SELECT term, count(*) AS df, ln((max(ndocs.n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf
  FROM terms, ndocs GROUP BY term
),
vec AS (
  SELECT id, term, df, (tf * idf) / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w
  FROM terms JOIN idf USING (term)
),
lab AS (SELECT doc_id AS id, quality AS y FROM labels),
ncls AS (SELECT sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n0 FROM lab),
wts AS (
  SELECT t.term, ln((t.c1 + 1.0) / (ncls.n1 + 2.0)) - ln((t.c0 + 1.0) / (ncls.n0 + 2.0)) AS weight
  FROM (SELECT term, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS c0
        FROM terms JOIN lab USING (id) GROUP BY term) t, ncls
),
dots AS (SELECT id, sum(w * weight) AS dot FROM vec JOIN wts USING (term) GROUP BY id),
probs AS (
  SELECT c.pos, c.url, c.text,
         1.0 / (1.0 + exp(-(ln((ncls.n1 + 1.0) / (ncls.n0 + 1.0)) + coalesce(d.dot, 0.0)))) AS prob
  FROM cleaned c LEFT JOIN dots d ON d.id = c.pos, ncls
)"""


def found_sql(history: str = "") -> str:
    unsent = f" AND url NOT IN (SELECT url FROM ({history}))" if history else ""
    return f"""
found0 AS (
  SELECT pos, url, text, round_even(prob, 3) AS prob FROM probs
  WHERE round_even(prob, 3) >= {CFG.threshold_v2!r}{unsent}
),
found AS (
  SELECT * FROM found0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY text, pos) = 1
)"""


def leaders_sql() -> str:
    """idx (text order), pairs, recursive greedy leaders, members."""
    return f"""
idx AS (SELECT pos, url, text, prob, row_number() OVER (ORDER BY text) AS idx FROM found),
v2 AS (SELECT i.idx AS id, v.term, v.w FROM vec v JOIN idx i ON v.id = i.pos),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM v2 a JOIN v2 b ON a.term = b.term AND a.id < b.id
  GROUP BY a.id, b.id HAVING sum(a.w * b.w) > {CFG.ksim!r}
),
pnodes AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs),
nn AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM pnodes),
rec AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::BIGINT[] AS leaders
  UNION ALL
  SELECT r.k + 1, n.id,
         coalesce((SELECT min(p.a) FROM pairs p WHERE p.b = n.id AND list_contains(r.leaders, p.a)), n.id),
         CASE WHEN (SELECT min(p.a) FROM pairs p WHERE p.b = n.id AND list_contains(r.leaders, p.a)) IS NULL
              THEN list_append(r.leaders, n.id) ELSE r.leaders END
  FROM rec r JOIN nn n ON n.k = r.k + 1
),
members AS (
  SELECT i.idx, coalesce(r.leader, i.idx) AS leader, i.prob, i.url
  FROM idx i LEFT JOIN (SELECT id, leader FROM rec WHERE id IS NOT NULL) r ON r.id = i.idx
),
groups AS (
  SELECT leader, max(prob) AS max_prob, count(*) AS n_members, count(*) = 1 AS is_single
  FROM members GROUP BY leader
)"""


def digest_sql(chain: str = "", found: str = "") -> str:
    return f"""WITH RECURSIVE {chain or chain_sql()},
{found or found_sql()},
{leaders_sql()},
lines AS (
  SELECT CASE WHEN g.is_single THEN 1 ELSE 3 END AS sec, -g.max_prob AS gk, g.leader AS gl, 1 AS sub,
         m.idx AS mk, printf('%.3f %s', m.prob, {O.undo_messenger('m.url')}) AS line
  FROM members m JOIN groups g USING (leader)
  UNION ALL
  SELECT 3, -max_prob, leader, 0, NULL, {O.q(DIGEST_SEPARATOR)} FROM groups WHERE NOT is_single
  UNION ALL SELECT 0, NULL, NULL, 0, NULL, {O.q(DIGEST_SINGLES_HEADER)}
  UNION ALL SELECT 2, NULL, NULL, 0, NULL, {O.q(DIGEST_GROUPS_HEADER)}
  UNION ALL SELECT 4, NULL, NULL, 0, NULL, {O.q(DIGEST_SEPARATOR)}
)
SELECT row_number() OVER (ORDER BY sec, gk NULLS FIRST, gl NULLS FIRST, sub, mk NULLS FIRST) AS line_no, line
FROM lines"""


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def q_digest(spark: SparkSession, sf: str) -> DataFrame:
    return D.digest(spark, _docs(spark, sf), _labels(spark, sf), CFG, RES)


def _found_and_vectors(spark, sf):
    return D.score_news_v2(spark, _docs(spark, sf), _labels(spark, sf), CFG, RES)


def q_score_news_v2(spark, sf):
    found, _ = _found_and_vectors(spark, sf)
    return found.select("pos", "url", F.col("prob"))


def sql_score_news_v2():
    return f"WITH {chain_sql()},\n{found_sql()}\nSELECT pos, url, prob FROM found"


def _leaders(spark, sf):
    """(pos, idx, leader, prob) of the found rows (computed once per query)."""
    found, vectors = _found_and_vectors(spark, sf)
    indexed = ordering.global_row_number(found, [F.col("text_no")], "idx")
    lead = D.text_order_leaders(indexed, vectors, CFG)
    return lead.join(indexed.select("idx", "pos", "prob"), "idx")


def q_leader_clusters(spark, sf):
    return _leaders(spark, sf).select("pos", "idx", "leader")


def sql_leader_clusters():
    return f"""WITH RECURSIVE {chain_sql()},
{found_sql()},
{leaders_sql()}
SELECT i.pos, m.idx, m.leader FROM members m JOIN idx i USING (idx)"""


def q_dup_groups(spark, sf):
    lc = _leaders(spark, sf)
    g = dedup.dup_groups(lc.select("idx", "leader", "prob"))
    return g.join(lc.select(F.col("idx").alias("leader"), F.col("pos").alias("leader_pos")), "leader") \
        .select("leader_pos", "max_prob", "n_members", "is_single")


def sql_dup_groups():
    return f"""WITH RECURSIVE {chain_sql()},
{found_sql()},
{leaders_sql()}
SELECT i.pos AS leader_pos, g.max_prob, g.n_members, g.is_single FROM groups g JOIN idx i ON i.idx = g.leader"""


def q_dup_split(spark, sf):
    """A4: each duplicate group goes to the singles or the groups section."""
    g = q_dup_groups(spark, sf)
    return g.select("leader_pos", F.when(F.col("is_single"), F.lit("single")).otherwise(F.lit("multi")).alias("section"))


def sql_dup_split():
    return f"""SELECT leader_pos, CASE WHEN is_single THEN 'single' ELSE 'multi' END AS section FROM ({sql_dup_groups()})"""


def q_dup_stats(spark, sf):
    return dedup.dup_stats(_leaders(spark, sf))


def sql_dup_stats():
    return f"""WITH RECURSIVE {chain_sql()},
{found_sql()},
{leaders_sql()}
SELECT count(*) AS n_texts, count(DISTINCT leader) AS n_unique, count(*) - count(DISTINCT leader) AS n_duplicates
FROM members"""


def q_cosine_pairs(spark, sf):
    """J9 over all distinct documents (not only found ones): (pos_a, pos_b, cos)."""
    cands = D.candidates_from_documents(_docs(spark, sf), CFG)
    _, vectors = D.scored(cands, None, _labels(spark, sf), CFG, RES)
    pairs = dedup.cosine_pairs(vectors, CFG.ksim)
    return pairs.select(F.col("a").alias("pos_a"), F.col("b").alias("pos_b"), F.round("cos", 6).alias("cos"))


def sql_cosine_pairs():
    return f"""WITH {chain_sql()}
SELECT a.id AS pos_a, b.id AS pos_b, round(sum(a.w * b.w), 6) AS cos
FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id
GROUP BY a.id, b.id HAVING sum(a.w * b.w) > {CFG.ksim!r}"""


def _scored(spark, sf):
    cands = D.candidates_from_documents(_docs(spark, sf), CFG)
    return D.scored(cands, None, _labels(spark, sf), CFG, RES)


def q_lr_score(spark, sf):
    probs, _ = _scored(spark, sf)
    return probs.select("pos", "url", F.round("prob", 6).alias("prob"))


def sql_lr_score():
    return f"WITH {chain_sql()}\nSELECT pos, url, round(prob, 6) AS prob FROM probs"


def _scored_raw(spark, sf):
    """The first scorer's rows with a non-zero vector: terms of the whole raw texts."""
    cands = D.candidates_from_documents(_docs(spark, sf), CFG)
    return D.scored_raw(cands, None, _labels(spark, sf), CFG)


def q_lr_threshold_v1(spark, sf):
    probs = _scored_raw(spark, sf)
    return scoring.threshold_v1(probs, CFG.threshold_v1).select(F.col("id").alias("pos"), "url", F.round("prob", 6).alias("prob"))


def sql_lr_threshold_v1():
    return f"""WITH {chain_sql(raw_terms=True)}
SELECT pos, url, round(prob, 6) AS prob FROM probs
WHERE pos IN (SELECT id FROM vec) AND prob >= {CFG.threshold_v1!r}"""


def q_lr_score_stored(spark, sf):
    """A model fitted on English texts is stored, loaded and scores all texts; terms that it has not seen
    are dropped."""
    docs = _docs(spark, sf)
    english = docs.filter(F.col("lang") == "en")
    terms = cut_to_parquet(scoring.doc_terms_raw(english, "doc_id", "text"), "terms")
    path = f"{stream_dir(spark, 'model')}/model"
    scoring.save_linear_model(scoring.fit_idf(terms, english.count()), *scoring.fit_linear_model(terms, _labels(spark, sf)), path)
    idf, weights, b = scoring.load_linear_model(spark, path)
    scored = scoring.score_counts(scoring.doc_terms_raw(docs, "doc_id", "text"), idf, weights, b)
    none = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-b)))  # a text without a known term has a zero vector
    probs = docs.select(F.col("doc_id").alias("id")).join(scored, "id", "left").withColumn("prob", F.coalesce("prob", none))
    return probs.select(F.col("id").alias("doc_id"), F.round("prob", 6).alias("prob"))


def sql_lr_score_stored():
    return r"""WITH t AS (
  SELECT id, lang, term, count(*) AS tf FROM (
    SELECT doc_id AS id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'),
idf AS (SELECT term, ln((max(n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM t, n WHERE lang = 'en' GROUP BY term),
c AS (SELECT sum(quality) AS n1, sum(1 - quality) AS n0 FROM labels),
wt AS (
  SELECT term, ln((sum(quality) + 1.0::DOUBLE) / (max(n1) + 2.0::DOUBLE)) - ln((sum(1 - quality) + 1.0::DOUBLE) / (max(n0) + 2.0::DOUBLE)) AS weight
  FROM t JOIN labels ON id = doc_id, c WHERE lang = 'en' GROUP BY term),
raw AS (SELECT id, term, tf * idf AS r FROM t JOIN idf USING (term)),
vec AS (SELECT id, term, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM raw),
dots AS (SELECT id, sum(w * weight) AS dot FROM vec JOIN wt USING (term) GROUP BY id)
SELECT doc_id, round(1 / (1 + exp(-(ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE)) + coalesce(dot, 0)))), 6) AS prob
FROM documents CROSS JOIN c LEFT JOIN dots ON id = doc_id"""


def q_lr_threshold_v2(spark, sf):
    probs, _ = _scored(spark, sf)
    return scoring.threshold_v2(probs, CFG.threshold_v2).select(
        "pos", "url", scoring.round_prob("prob").alias("prob"))


def sql_lr_threshold_v2():
    return f"""WITH {chain_sql()}
SELECT pos, url, round_even(prob, 3) AS prob FROM probs WHERE round_even(prob, 3) >= {CFG.threshold_v2!r}"""


def q_nonzero_vector(spark, sf):
    probs = _scored_raw(spark, sf)
    return probs.select(F.col("id").alias("pos"), "url")


def sql_nonzero_vector():
    return f"WITH {chain_sql(raw_terms=True)}\nSELECT pos, url FROM probs WHERE pos IN (SELECT id FROM vec)"


def q_tfidf(spark, sf):
    _, vectors = _scored(spark, sf)
    return scoring.unpacked(vectors).select(F.col("id").alias("pos"), "term", "df", F.round("w", 6).alias("w"))


def sql_tfidf():
    return f"WITH {chain_sql()}\nSELECT id AS pos, term, df, round(w, 6) AS w FROM vec"


def q_distinct_texts(spark, sf):
    cands = D.candidates_from_documents(_docs(spark, sf), CFG)
    distinct = D.resolved_texts(cands, None, CFG)
    return distinct.select("pos", "url", F.length("text").cast("long").alias("n_chars"))


def sql_distinct_texts():
    return f"WITH {chain_sql()}\nSELECT pos, url, length(text) AS n_chars FROM dist"


def q_digest_lines(spark, sf):
    return q_digest(spark, sf).select("line_no", "line")


# ---------------------------------------------------------------------------
# text steps over documents.text
# ---------------------------------------------------------------------------

def _doc_select(spark, sf, expr, name):
    return _docs(spark, sf).select("doc_id", expr.alias(name))


def q_paragraphs(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_no", "paragraph")) \
        .select("doc_id", F.col("para_no").cast("long").alias("para_no"),
                F.length("paragraph").cast("long").alias("n_chars"))


def sql_paragraphs():
    return f"""SELECT doc_id, para_no - 1 AS para_no, length(paragraph) AS n_chars FROM (
  SELECT doc_id, unnest({O.paragraphs('text')}) AS paragraph,
         unnest(range(1, len({O.paragraphs('text')}) + 1)) AS para_no FROM documents)"""


def q_head_paragraphs(spark, sf):
    return _doc_select(spark, sf, T.head_text(F.col("text"), CFG.head_paragraphs), "head")


def sql_head_paragraphs():
    return f"SELECT doc_id, array_to_string({O.head(O.paragraphs('text'), CFG.head_paragraphs)}, ' ') AS head FROM documents"


def q_sentences(spark, sf):
    d = _docs(spark, sf)
    s = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.sentences(p)))
    return d.select("doc_id", F.size(s).cast("long").alias("n_sentences"),
                    F.array_join(F.transform(s, lambda x: F.length(x).cast("string")), ",").alias("lengths"))


def sql_sentences():
    s = f"flatten(list_transform({O.paragraphs('text')}, lambda p: {O.sentences('p')}))"
    return (f"SELECT doc_id, len({s}) AS n_sentences, "
            f"array_to_string(list_transform({s}, lambda x: CAST(length(x) AS VARCHAR)), ',') AS lengths FROM documents")


def q_clean_text(spark, sf):
    """T15 over whole texts."""
    return _doc_select(spark, sf, D.clean_column(F.col("text"), CFG, RES, head_n=0), "cleaned")


def sql_clean_text():
    return f"SELECT doc_id, {clean_sql('text', 0)} AS cleaned FROM documents"


def q_clean_text_head(spark, sf):
    """T14 before T15: the first paragraphs, as the second scorer reads them."""
    return _doc_select(spark, sf, D.clean_column(F.col("text"), CFG, RES), "cleaned")


def sql_clean_text_head():
    return f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents"


def _sentence_step(spark, sf, fn):
    """Apply a per-sentence step to every sentence of every document, joined by ' | '."""
    d = _docs(spark, sf)
    s = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.sentences(p)))
    return d.select("doc_id", F.array_join(F.transform(s, fn), " | ").alias("out"))


def _sentence_step_sql(fn_sql) -> str:
    s = f"flatten(list_transform({O.paragraphs('text')}, lambda p: {O.sentences('p')}))"
    return f"SELECT doc_id, array_to_string(list_transform({s}, lambda x: {fn_sql('x')}), ' | ') AS out FROM documents"


def q_mask_quoted(spark, sf):
    return _sentence_step(spark, sf, lambda x: T.mask_quoted(x, CFG))


def sql_mask_quoted():
    return _sentence_step_sql(lambda x: f"regexp_replace({x}, {O.q(O.QUOTED_WORD)}, ' {CFG.placeholders['ORG']} ', 'g')")


def q_mask_numbers(spark, sf):
    return _sentence_step(spark, sf, lambda x: T.mask_numbers(x, CFG))


def sql_mask_numbers():
    return _sentence_step_sql(lambda x: f"regexp_replace({x}, '[0-9]+', ' {CFG.placeholders['NUM']} ', 'g')")


def q_alphabet_filter(spark, sf):
    return _sentence_step(spark, sf, lambda x: T.alphabet_filter(F.lower(x), CFG))


def sql_alphabet_filter():
    return _sentence_step_sql(lambda x: f"regexp_replace(lower({x}), '[^{CFG.alphabet}_ ]', ' ', 'g')")


def _toks(x):
    return F.filter(T.tokens(T.alphabet_filter(F.lower(x), CFG)), lambda t: t != F.lit("_"))


def _toks_sql(x):
    return (f"list_filter(regexp_split_to_array(trim(regexp_replace(lower({x}), '[^{CFG.alphabet}_ ]', ' ', 'g')), ' +'), "
            f"lambda t: t <> '' AND t <> '_')")


def q_remove_stopwords(spark, sf):
    return _sentence_step(spark, sf, lambda x: F.array_join(T.remove_stopwords(_toks(x), _stops()), " "))


def sql_remove_stopwords():
    return _sentence_step_sql(
        lambda x: f"array_to_string(list_filter({_toks_sql(x)}, lambda t: NOT list_contains({O.sql_list(_stops())}, t)), ' ')")


def q_token_length(spark, sf):
    return _sentence_step(spark, sf, lambda x: F.array_join(T.length_filter(_toks(x), CFG), " "))


def sql_token_length():
    return _sentence_step_sql(
        lambda x: f"array_to_string(list_filter({_toks_sql(x)}, lambda t: length(t) > 2 OR t = {O.q(CFG.negation)}), ' ')")


def q_mask_entities(spark, sf):
    em = T.entity_map(RES.entities, CFG)
    return _sentence_step(spark, sf, lambda x: F.array_join(T.lookup_tokens(_toks(x), em, None), " "))


def sql_mask_entities():
    ent = [(k, CFG.placeholders[v]) for k, v in RES.entities]
    return _sentence_step_sql(
        lambda x: f"array_to_string(list_transform({_toks_sql(x)}, lambda t: {O._case_map('t', ent, 't')}), ' ')")


def q_mask_entity_spans(spark, sf):
    """T3 with names of several tokens, a row for each sentence."""
    s = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.sentences(p)))
    rows = _docs(spark, sf).select("doc_id", F.posexplode(s).alias("sentence_no", "s"))
    rows = rows.select(F.struct("doc_id", "sentence_no").alias("id"), _toks(F.col("s")).alias("tokens"))
    names = spark.createDataFrame([(k, CFG.placeholders[v]) for k, v in LATIN_NAMES], "surface string, replacement string")
    return mask_spans(rows, names).select("id.doc_id", "id.sentence_no", F.array_join("tokens", " ").alias("out"))


def sql_mask_entity_spans():
    s = f"flatten(list_transform({O.paragraphs('text')}, lambda p: {O.sentences('p')}))"
    names = ", ".join(f"({O.q(k)}, {len(k.split())}, {O.q(CFG.placeholders[v])})" for k, v in LATIN_NAMES)
    return f"""WITH RECURSIVE names(surface, n, replacement) AS (VALUES {names}),
s AS (SELECT doc_id, {s} AS s FROM documents),
w AS (SELECT doc_id, i - 1 AS sentence_no, {_toks_sql('s[i]')} AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
t AS (SELECT doc_id, sentence_no, w, unnest(range(1, len(w) + 1)) AS p FROM w),
h AS (SELECT doc_id, sentence_no, p, max(n) AS n, arg_max(replacement, n) AS replacement
      FROM t JOIN names ON p + n - 1 <= len(w) AND array_to_string(w[p:p + n - 1], ' ') = surface GROUP BY ALL),
nxt AS (SELECT a.doc_id, a.sentence_no, a.p, a.n, a.replacement, min(b.p) AS q
        FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND a.sentence_no = b.sentence_no AND b.p >= a.p + a.n GROUP BY ALL),
c AS (SELECT nxt.* FROM nxt JOIN (SELECT doc_id, sentence_no, min(p) AS p FROM h GROUP BY ALL) USING (doc_id, sentence_no, p)
      UNION ALL SELECT nxt.* FROM c JOIN nxt ON nxt.doc_id = c.doc_id AND nxt.sentence_no = c.sentence_no AND nxt.p = c.q),
m AS (SELECT doc_id, sentence_no, unnest(range(p, p + n)) AS p, replacement FROM c)
SELECT w.doc_id, w.sentence_no::INTEGER AS sentence_no, coalesce(o.out, '') AS out
FROM w LEFT JOIN (SELECT t.doc_id, t.sentence_no, string_agg(coalesce(m.replacement, t.w[t.p]), ' ' ORDER BY t.p) AS out
                  FROM t LEFT JOIN m USING (doc_id, sentence_no, p) GROUP BY ALL) o USING (doc_id, sentence_no)"""


def q_lemmatize_dict(spark, sf):
    lm = T.dictionary_map(RES.lemmas)
    return _sentence_step(spark, sf, lambda x: F.array_join(T.lookup_tokens(_toks(x), None, lm), " "))


def sql_lemmatize_dict():
    return _sentence_step_sql(
        lambda x: f"array_to_string(list_transform({_toks_sql(x)}, lambda t: {O._case_map('t', list(RES.lemmas), 't')}), ' ')")


def q_negation_bigram(spark, sf):
    return _sentence_step(spark, sf, lambda x: T.negation_bigram(F.array_join(_toks(x), " "), CFG))


def sql_negation_bigram():
    neg = CFG.negation
    return _sentence_step_sql(
        lambda x: f"regexp_replace(array_to_string({_toks_sql(x)}, ' '), '(^| ){neg} ([^ ]+)', '\\1{neg}_\\2', 'g')")


def q_collapse_placeholders(spark, sf):
    return _sentence_step(spark, sf, lambda x: T.squash_spaces(
        T.collapse_placeholders(F.array_join(_toks(T.mask_numbers(x, CFG)), " "), CFG)))


def sql_collapse_placeholders():
    ph = CFG.placeholders

    def f(x):
        masked = f"regexp_replace({x}, '[0-9]+', ' {ph['NUM']} ', 'g')"
        j = f"array_to_string({_toks_sql(masked)}, ' ')"
        for k in ("ORG", "PER", "LOC", "NUM"):
            j = f"regexp_replace({j} || ' ', '({ph[k]} )+', '{ph[k]} ', 'g')"
        return f"regexp_replace(trim({j}), ' +', ' ', 'g')"
    return _sentence_step_sql(f)


def q_mask_lexicon(spark, sf):
    return _sentence_step(spark, sf, lambda x: T.mask_lexicon(F.lower(x), CFG))


def sql_mask_lexicon():
    return _sentence_step_sql(lambda x: O.mask_lexicon(f"lower({x})", CFG))


QUERIES = {
    "digest": (q_digest, digest_sql),
    "digest_lines": (q_digest_lines, digest_sql),
    "score_news_v2": (q_score_news_v2, sql_score_news_v2),
    "leader_clusters": (q_leader_clusters, sql_leader_clusters),
    "dup_groups": (q_dup_groups, sql_dup_groups),
    "dup_split": (q_dup_split, sql_dup_split),
    "dup_stats": (q_dup_stats, sql_dup_stats),
    "cosine_pairs": (q_cosine_pairs, sql_cosine_pairs),
    "lr_score": (q_lr_score, sql_lr_score),
    "lr_score_stored": (q_lr_score_stored, sql_lr_score_stored),
    "lr_threshold_v1": (q_lr_threshold_v1, sql_lr_threshold_v1),
    "lr_threshold_v2": (q_lr_threshold_v2, sql_lr_threshold_v2),
    "nonzero_vector": (q_nonzero_vector, sql_nonzero_vector),
    "tfidf": (q_tfidf, sql_tfidf),
    "distinct_texts": (q_distinct_texts, sql_distinct_texts),
    "paragraphs": (q_paragraphs, sql_paragraphs),
    "head_paragraphs": (q_head_paragraphs, sql_head_paragraphs),
    "sentences": (q_sentences, sql_sentences),
    "clean_text": (q_clean_text, sql_clean_text),
    "clean_text_head": (q_clean_text_head, sql_clean_text_head),
    "mask_quoted": (q_mask_quoted, sql_mask_quoted),
    "mask_numbers": (q_mask_numbers, sql_mask_numbers),
    "alphabet_filter": (q_alphabet_filter, sql_alphabet_filter),
    "remove_stopwords": (q_remove_stopwords, sql_remove_stopwords),
    "token_length": (q_token_length, sql_token_length),
    "mask_entities": (q_mask_entities, sql_mask_entities),
    "mask_entity_spans": (q_mask_entity_spans, sql_mask_entity_spans),
    "lemmatize_dict": (q_lemmatize_dict, sql_lemmatize_dict),
    "negation_bigram": (q_negation_bigram, sql_negation_bigram),
    "collapse_placeholders": (q_collapse_placeholders, sql_collapse_placeholders),
    "mask_lexicon": (q_mask_lexicon, sql_mask_lexicon),
}
