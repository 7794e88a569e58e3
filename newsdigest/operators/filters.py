"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AUTHOR_LINK_CLASS, REPOST_HOST, REPOST_WALL_PREFIX, SKIPPED_AUTHOR
from ..functions.text import has_text
from ..functions.urls import netloc, strip_ws
from ..session import cut_to_parquet

REPOST_MARKER = "Reposted ("
REPOST_MARKER_RE = "Reposted \\("
REPOST_ID_RE = 'data-post-id="([^"]*)"'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_words(words: Iterable[str]) -> list[str]:
    """S1 + Q5 for an in-memory list: strip, drop blanks, lower case (the text side is
    lowered too, so a word with capitals can match)."""
    out = []
    for w in words:
        w = (w or "").strip().lower()
        if w and w not in out:
            out.append(w)
    return out


def _quote(w: str) -> str:
    """A literal inside a Java regex."""
    return "\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def keyword_match(text, words: list[str]) -> Column:
    """lower-cased substring of any keyword; null or '' -> False. A short list is one
    alternation of quoted literals: the text is lowered and scanned once per row, even
    when a filter pushed below a projection inlines the expression. Long lists go
    through :func:`keyword_counts` (joins)."""
    if not words:
        return F.lit(False)
    pattern = "|".join(_quote(w) for w in words)
    hit = F.lower(_c(text)).rlike(pattern)
    return F.coalesce(hit, F.lit(False)) & (F.coalesce(_c(text), F.lit("")) != F.lit(""))


def keyword_filter(df: DataFrame, words: list[str], title_col: str = "title", text_col: str = "text",
                   enabled: bool = True) -> DataFrame:
    """title or text matches a keyword, when keyword filtering is on."""
    if not enabled:
        return df
    return df.filter(keyword_match(title_col, words) | keyword_match(text_col, words))


#: Characters of the grams that keywords and tokens are joined by.
GRAM = 3


def _grams(df: DataFrame, text_col: str, sizes) -> DataFrame:
    """(text, gram): the distinct runs of so many characters of each text."""
    def runs(n):
        # a run that would go beyond the end is null
        all_runs = F.transform("chars", lambda _, i: F.concat(*[F.get(F.col("chars"), i + k) for k in range(n)]))
        return F.filter(all_runs, lambda g: g.isNotNull())
    # a text's characters are a column of their own, not split again for each of them
    chars = df.select(text_col, F.split(text_col, "").alias("chars"))
    return chars.select(text_col, F.explode(F.array_distinct(F.concat(*[runs(n) for n in sizes]))).alias("gram"))


def _held_pieces(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, piece): the tokens that hold a piece. Of each piece the gram that the fewest tokens have leads to its
    tokens; a piece with a gram that none has is in no token. A piece of fewer than ``GRAM`` characters is its own
    gram. Only the tokens' grams that a piece has are kept, and written once: an exploded column's size is
    unknown to the planner, a written table's is not, so nothing large is broadcast by mistake."""
    short = F.length("piece") < GRAM
    own = _grams(pieces.filter(~short), "piece", [GRAM]).unionByName(pieces.filter(short).select("piece", F.col("piece").alias("gram")))
    own = cut_to_parquet(own, "keyword-grams")
    grams = cut_to_parquet(_grams(vocabulary, "token", range(1, GRAM + 1)).join(own.select("gram").distinct(), "gram", "left_semi"), "grams")
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    least = own.join(held, "gram", "left").groupBy("piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    rarest = least.filter("m.n > 0").select(F.col("m.gram").alias("gram"), "piece")
    return grams.join(rarest, "gram").filter(F.contains(F.col("token"), F.col("piece"))).select("token", "piece")


def keyword_counts(df: DataFrame, words_df: DataFrame, text_col: str = "text", id_col: str = "id",
                   word_col: str = "word") -> DataFrame:
    """F1 with a keyword list of any size: (id, kw_hit, n_words) where ``n_words`` counts the distinct keywords
    contained in the lowered text; null and empty texts contain none. Rows that repeat, share an id or have none get their own
    counts.

    A keyword without white space is in a text if it is in one of its tokens, so it is looked for in the
    distinct tokens of all texts: tokens and keywords meet by the keyword's rarest gram. Of a keyword with
    white space the longest piece is looked for, and the texts that have it are searched. All of it is joins
    and grouped counts; neither list nor texts pass through the driver or Python."""
    pieces = F.transform(F.split("word", "\\s+"), lambda p: F.struct(F.length(p).alias("n"), p.alias("piece")))
    words = (words_df.select(F.lower(strip_ws(F.col(word_col))).alias("word")).filter("word <> ''").distinct()
             .withColumn("piece", F.array_max(pieces)["piece"]))
    words = cut_to_parquet(words, "keywords")
    rows = df.select(_c(id_col).alias("id"), F.xxhash64(_c(text_col)).alias("tag"), F.lower(_c(text_col)).alias("low"))
    tokens = rows.select("id", "tag", F.explode(F.array_distinct(F.split("low", "\\s+"))).alias("token")).filter("token <> ''")
    vocabulary = cut_to_parquet(tokens.select("token").distinct(), "vocabulary")
    hits = _held_pieces(words.select("piece").distinct(), vocabulary).join(words, "piece").select("token", "word", "piece")
    hits = cut_to_parquet(hits, "hits")  # tokens of texts are shuffled only if these are too many to broadcast
    found = tokens.join(hits, "token").groupBy("id", "tag", "word").agg((F.first("piece") == F.col("word")).alias("whole"))
    found = cut_to_parquet(found, "found-words")
    phrases = found.filter("NOT whole").select(F.col("id").alias("of"), F.col("tag").alias("of_tag"), "word")
    of_row = F.col("id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag"))
    inside = phrases.join(rows.distinct(), of_row).filter(F.contains(F.col("low"), F.col("word"))).select("id", "tag", "word")
    counts = (found.filter("whole").select("id", "tag", "word").unionByName(inside)
              .groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n")))
    counts = counts.select(F.col("id").alias("of"), F.col("tag").alias("of_tag"), "n")
    n_words = F.coalesce("n", F.lit(0).cast("long"))
    return (rows.join(counts, of_row, "left")
            .select("id", (n_words > 0).alias("kw_hit"), n_words.alias("n_words")))


def today_filter(df: DataFrame, run_day, day_col: str = "day") -> DataFrame:
    """The item's calendar day equals the run day."""
    return df.filter(_c(day_col) == F.lit(run_day))


def nonblank_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """drop null and white-space-only texts."""
    return df.filter(has_text(text_col))


def drop_reposts(items: DataFrame, known_urls: DataFrame | None, pos_col: str = "pos",
                 url_col: str = "url", text_col: str = "text") -> DataFrame:
    """A row on the social host whose text (newlines as spaces) has the
    repost marker is dropped when the reposted post's wall URL is the URL of another row
    on that host, or is already in the history. Left semi/anti joins only: the reposted
    URL is an equi-join key, the own-row exclusion a residual condition."""
    hits = repost_positions(items, known_urls, pos_col, url_col, text_col)
    return items.join(hits, pos_col, "left_anti")


def repost_positions(items: DataFrame, known_urls: DataFrame | None, pos_col: str = "pos",
                     url_col: str = "url", text_col: str = "text") -> DataFrame:
    """The positions of the rows that :func:`drop_reposts` drops."""
    host_rows = items.filter(netloc(_c(url_col)) == F.lit(REPOST_HOST))
    # The marker pattern is '.*Reposted \(.*data-post-id="(.*?)".*' on the text with
    # newlines as spaces: the captured id is the last data-post-id="..." after the first
    # 'Reposted ('. It is evaluated as split + extract-all: linear in the text, where the
    # backtracking pattern is quadratic on long texts without a marker.
    flat = F.replace(_c(text_col), F.lit("\n"), F.lit(" "))
    after = F.element_at(F.split(flat, REPOST_MARKER_RE, 2), 2)
    ids = F.regexp_extract_all(after, F.lit(REPOST_ID_RE), 1)
    reposts = (host_rows.withColumn("_ids", ids)
               .filter(F.contains(flat, F.lit(REPOST_MARKER)) & (F.size("_ids") > 0))
               .select(_c(pos_col).alias("_rpos"),
                       F.concat(F.lit(REPOST_WALL_PREFIX), F.element_at("_ids", -1)).alias("_target")))
    targets = host_rows.select(_c(pos_col).alias("_tpos"), _c(url_col).alias("_turl"))
    hit_run = reposts.join(targets, (F.col("_target") == F.col("_turl")) & (F.col("_rpos") != F.col("_tpos")),
                           "left_semi")
    hits = hit_run.select("_rpos")
    if known_urls is not None:
        hit_hist = reposts.join(known_urls.select(F.col("url").alias("_hurl")),
                                F.col("_target") == F.col("_hurl"), "left_semi")
        hits = hits.union(hit_hist.select("_rpos"))
    return hits.withColumnRenamed("_rpos", pos_col)


def author_is(html, author: str = SKIPPED_AUTHOR) -> Column:
    """the page has an author link (class ``pi_author``) whose text equals ``author``."""
    pat = f'<a[^>]*class="{AUTHOR_LINK_CLASS}"[^>]*>([^<]*)</a>'
    authors = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(pat), 1)
    return F.exists(authors, lambda a: a == F.lit(author))


def collective_flag(text, words: Iterable[str], plural_lexicon: Iterable[str] = ()) -> Column:
    """1 when a white-space token of the lowered text is a collective word or
    a plural noun of the lexicon, else 0."""
    vocab = list(words) + [w for w in plural_lexicon if w not in words]
    toks = F.split(F.lower(_c(text)), "\\s+")
    return F.when(F.arrays_overlap(toks, F.array(*[F.lit(w) for w in vocab])), 1).otherwise(0)
