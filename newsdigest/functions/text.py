"""Text normalisation as Spark column expressions.

Every step is a built-in expression (string functions, regexes and higher-order
array functions), so the whole cleaning of a document runs inside one stage with no
shuffle and no Python. Dictionaries (lemmas, entities) are map literals
(:func:`dictionary_map`), sized for gazetteers and lemma lists of up to a few thousand
entries; a full morphology dictionary would need an exploded-token join instead.

Cleaning of one text (the order of the monitored job):

1. paragraphs: split on newline, keep those with a non-space character (T1);
2. keep the first ``head`` paragraphs (T14, pushed below cleaning: no rule crosses a
   newline, so slicing first gives the same tokens);
3. sentences: split after ``.``, ``!`` or ``?`` followed by white space (T2);
4. per sentence: lower case, quoted single word -> ORG placeholder (T5, applied
   before tokenising), digits -> number placeholder (T6), alphabet filter (T7),
   drop lone underscores (T8), entity and lemma dictionaries (T3, T4), stop words (T9),
   length filter keeping the negation word (T10), collapse placeholder runs (T11),
   negation bigrams (T12);
5. a paragraph line is every cleaned sentence followed by ``' . '``; number and
   calendar words are masked on the line in a single pass each (T13) and runs collapsed;
6. the cleaned text is the lines joined by a space, white space normalised.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

# T5: a single word between guillemets or double quotes (letters, digits, underscore)
QUOTED_WORD = '«[\\p{L}\\p{N}_]+»|"[\\p{L}\\p{N}_]+"'
SENTENCE_END = "([.!?])\\s+"
_SENT_MARK = "\u0001"


#: a character that is no white space, Unicode blanks included
NOT_BLANK = "(?U)\\S"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def paragraphs(text) -> Column:
    """Non-blank paragraphs, in order."""
    return F.filter(F.split(_c(text), "\n"), lambda p: p.rlike(NOT_BLANK))


def head(paras, n: int = 4) -> Column:
    """The first ``n`` paragraphs."""
    return F.slice(_c(paras), 1, n)


def head_text(text, n: int = 4) -> Column:
    """T14 on raw text: first ``n`` non-blank paragraphs joined by a space."""
    return F.array_join(head(paragraphs(text), n), " ")


def sentences(paragraph) -> Column:
    """Sentences of one paragraph; the end mark stays with its sentence."""
    marked = F.regexp_replace(_c(paragraph), SENTENCE_END, "$1" + _SENT_MARK)
    return F.filter(F.split(marked, _SENT_MARK), lambda s: s.rlike(NOT_BLANK))


def mask_quoted(s, cfg: Config) -> Column:
    """T5: quoted single word -> ORG placeholder (before tokenising, see README)."""
    return F.regexp_replace(_c(s), QUOTED_WORD, f" {cfg.placeholders['ORG']} ")


def mask_numbers(s, cfg: Config) -> Column:
    """Runs of ASCII digits -> number placeholder."""
    return F.regexp_replace(_c(s), "[0-9]+", f" {cfg.placeholders['NUM']} ")


def alphabet_filter(s, cfg: Config) -> Column:
    """Everything outside the alphabet, underscore and space becomes a space."""
    return F.regexp_replace(_c(s), f"[^{cfg.alphabet}_ ]", " ")


def tokens(s) -> Column:
    """Split on spaces, dropping empty tokens."""
    return F.filter(F.split(F.trim(_c(s)), " +"), lambda t: t != F.lit(""))


def dictionary_map(pairs: Mapping[str, str] | Iterable[tuple[str, str]] | None) -> Column | None:
    """A small dictionary as a map literal (None when empty)."""
    if not pairs:
        return None
    items = list(pairs.items()) if isinstance(pairs, Mapping) else list(pairs)
    if not items:
        return None
    keys = F.array(*[F.lit(k) for k, _ in items])
    vals = F.array(*[F.lit(v) for _, v in items])
    return F.map_from_arrays(keys, vals)


def entity_map(entities: Iterable[tuple[str, str]] | None, cfg: Config) -> Column | None:
    """Gazetteer (surface, type) -> (surface, placeholder)."""
    if not entities:
        return None
    return dictionary_map([(s, cfg.placeholders[t]) for s, t in entities])


def lookup_tokens(toks, entities: Column | None, lemmas: Column | None) -> Column:
    """T3 + T4: entity placeholder if the token is in the gazetteer, else its lemma,
    else the token itself."""
    def one(t):
        opts = []
        if entities is not None:
            opts.append(F.element_at(entities, t))
        if lemmas is not None:
            opts.append(F.element_at(lemmas, t))
        opts.append(t)
        return F.coalesce(*opts) if len(opts) > 1 else t
    if entities is None and lemmas is None:
        return _c(toks)
    return F.transform(_c(toks), one)


def remove_stopwords(toks, stops: Iterable[str]) -> Column:
    """Drop stop words, keeping duplicates and order (not ``array_except``)."""
    stops = [w for w in stops]
    if not stops:
        return _c(toks)
    arr = F.array(*[F.lit(w) for w in stops])
    return F.filter(_c(toks), lambda t: ~F.array_contains(arr, t))


def length_filter(toks, cfg: Config) -> Column:
    """Keep tokens longer than two characters, and the negation word."""
    return F.filter(_c(toks), lambda t: (F.length(t) > 2) | (t == F.lit(cfg.negation)))


def collapse_placeholders(s, cfg: Config, kinds=("ORG", "PER", "LOC", "NUM")) -> Column:
    """A run of one placeholder becomes one (text padded with a space each time)."""
    out = _c(s)
    for k in kinds:
        ph = cfg.placeholders[k]
        out = F.regexp_replace(F.concat(out, F.lit(" ")), f"({ph} )+", f"{ph} ")
    return out


def negation_bigram(s, cfg: Config) -> Column:
    """``neg w`` -> ``neg_w`` left to right, non-overlapping; a trailing
    negation word stays. ``s`` is a space-joined token string."""
    neg = cfg.negation
    return F.regexp_replace(_c(s), f"(^| ){neg} ([^ ]+)", f"$1{neg}_$2")


def squash_spaces(s) -> Column:
    return F.regexp_replace(F.trim(_c(s)), " +", " ")


def clean_sentence(s, cfg: Config, stops: Iterable[str] = (), entities: Column | None = None,
                   lemmas: Column | None = None) -> Column:
    """T3-T12 on one sentence; returns the cleaned, single-spaced sentence."""
    x = F.lower(_c(s))
    x = mask_quoted(x, cfg)
    x = mask_numbers(x, cfg)
    x = alphabet_filter(x, cfg)
    toks = F.filter(tokens(x), lambda t: t != F.lit("_"))
    toks = lookup_tokens(toks, entities, lemmas)
    toks = remove_stopwords(toks, stops)
    toks = length_filter(toks, cfg)
    joined = F.array_join(toks, " ")
    joined = collapse_placeholders(joined, cfg)
    joined = negation_bigram(joined, cfg)
    return squash_spaces(joined)


def mask_lexicon(line, cfg: Config) -> Column:
    """Single-pass ``' w '`` replacement for number words then calendar words,
    then collapse their runs."""
    out = _c(line)
    num, dat = cfg.placeholders["NUM"], cfg.placeholders["DAT"]
    for w in cfg.number_words:
        out = F.replace(out, F.lit(f" {w} "), F.lit(f" {num} "))
    for w in cfg.date_words:
        out = F.replace(out, F.lit(f" {w} "), F.lit(f" {dat} "))
    out = F.regexp_replace(F.concat(out, F.lit(" ")), f"({num} )+", f"{num} ")
    out = F.regexp_replace(F.concat(out, F.lit(" ")), f"({dat} )+", f"{dat} ")
    return out


def clean_paragraph(p, cfg: Config, stops=(), entities=None, lemmas=None) -> Column:
    """One cleaned line: each sentence cleaned and closed by ``' . '``, then T13."""
    line = F.array_join(
        F.transform(sentences(p), lambda s: F.concat(clean_sentence(s, cfg, stops, entities, lemmas),
                                                     F.lit(" . "))),
        "")
    return mask_lexicon(line, cfg)


def clean_text(text, cfg: Config, stops=(), entities=None, lemmas=None,
               head_n: int | None = None) -> Column:
    """The whole cleaning of a text; ``head_n`` paragraphs (default cfg.head_paragraphs,
    0 = all)."""
    n = cfg.head_paragraphs if head_n is None else head_n
    paras = paragraphs(text)
    if n:
        paras = head(paras, n)
    lines = F.transform(paras, lambda p: clean_paragraph(p, cfg, stops, entities, lemmas))
    return squash_spaces(F.array_join(lines, " "))


def vector_terms(cleaned) -> Column:
    """Terms a TF-IDF vectoriser sees in a cleaned text: every token of two or more
    characters (the sentence marks are dropped)."""
    return F.filter(F.split(_c(cleaned), " "), lambda t: F.length(t) >= 2)


# --- P12, P13, P16 ---------------------------------------------------------

def strip_boilerplate(text, phrases: Iterable[str]) -> Column:
    """Remove fixed sentences (plain, all occurrences)."""
    out = _c(text)
    for ph in phrases:
        out = F.replace(out, F.lit(ph), F.lit(""))
    return out


def text_fallback(article, feed) -> Column:
    """The extracted article text, else the feed text (null when both empty)."""
    return F.coalesce(F.nullif(_c(article), F.lit("")), F.nullif(_c(feed), F.lit("")))


def candidate_text(title, text) -> Column:
    """Title, newline, text (nulls as empty strings)."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit("\n"), F.coalesce(_c(text), F.lit("")))


def has_text(text) -> Column:
    """not null and not only white space."""
    return _c(text).isNotNull() & _c(text).rlike(NOT_BLANK)
