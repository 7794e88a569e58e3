"""SQL twins (DuckDB dialect) of the Spark operators, generated from the same
configuration so both sides use the same word lists and parameters.

These strings are the independent check: they share no code path with the Spark
implementation, only the parameters.
"""

from __future__ import annotations

from .config import MESSENGER_FIX, MESSENGER_HOST, REPOST_PATTERN, REPOST_WALL_PREFIX, SOURCE_LABEL, Config


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


NL = "chr(10)"


# --- URL expressions --------------------------------------------------------

def netloc(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract(coalesce({u}, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


def path(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


VALID_URL = ("^(?i)(https?|ftp)://([^\\s:@/?#]+(:[^\\s@/?#]*)?@)?"
             "(([\\p{L}0-9]([\\p{L}0-9-]*[\\p{L}0-9])?\\.)+[\\p{L}]{2,}|[0-9]{1,3}(\\.[0-9]{1,3}){3}|localhost)"
             "(:[0-9]{1,5})?([/?#][^\\s]*)?$")


def is_valid_url(u: str) -> str:
    return f"coalesce(regexp_matches({u}, {q(VALID_URL)}), false)"


def strip_ws(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def clean_source_url(u: str) -> str:
    return strip_ws(f"replace({u}, {q(SOURCE_LABEL)}, '')")


def unwrap_archive(u: str) -> str:
    return f"regexp_replace({u}, '^https://web\\.archive\\.org/web/([0-9]+[a-z_]*/)?', '')"


def fix_messenger(u: str) -> str:
    a, b = MESSENGER_FIX
    return f"CASE WHEN {netloc(u)} = {q(MESSENGER_HOST)} THEN replace({u}, {q(a)}, {q(b)}) ELSE {u} END"


def undo_messenger(u: str) -> str:
    a, b = MESSENGER_FIX
    return f"CASE WHEN {netloc(u)} = {q(MESSENGER_HOST)} THEN replace({u}, {q(b)}, {q(a)}) ELSE {u} END"


def resolve_link(href2: str, href: str, base: str) -> str:
    return (f"CASE WHEN coalesce({href2}, '') <> '' THEN {href2} "
            f"WHEN contains(coalesce({href}, ''), 'http') THEN {href} "
            f"ELSE coalesce({base}, '') || coalesce({href}, '') END")


# --- text cleaning ------------------------------------------------------------

QUOTED_WORD = '«[\\p{L}\\p{N}_]+»|"[\\p{L}\\p{N}_]+"'


def paragraphs(t: str) -> str:
    return f"list_filter(string_split({t}, {NL}), lambda p: regexp_matches(p, '\\S'))"


def head(paras: str, n: int) -> str:
    return f"list_slice({paras}, 1, {n})" if n else paras


def sentences(p: str) -> str:
    return (f"list_filter(string_split(regexp_replace({p}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: regexp_matches(s, '\\S'))")


def _case_map(var: str, pairs, default: str) -> str:
    if not pairs:
        return default
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"CASE {var} {whens} ELSE {default} END"


def clean_sentence(s: str, cfg: Config, stops, entities, lemmas) -> str:
    ph = cfg.placeholders
    x = f"lower({s})"
    x = f"regexp_replace({x}, {q(QUOTED_WORD)}, {q(' ' + ph['ORG'] + ' ')}, 'g')"
    x = f"regexp_replace({x}, '[0-9]+', {q(' ' + ph['NUM'] + ' ')}, 'g')"
    x = f"regexp_replace({x}, {q('[^' + cfg.alphabet + '_ ]')}, ' ', 'g')"
    toks = f"list_filter(regexp_split_to_array(trim({x}), ' +'), lambda t: t <> '' AND t <> '_')"
    if entities or lemmas:
        ent = [(k, ph[v]) for k, v in entities]
        inner = _case_map("t", list(lemmas), "t")
        toks = f"list_transform({toks}, lambda t: {_case_map('t', ent, inner)})"
    if stops:
        toks = f"list_filter({toks}, lambda t: NOT list_contains({sql_list(stops)}, t))"
    toks = f"list_filter({toks}, lambda t: length(t) > 2 OR t = {q(cfg.negation)})"
    j = f"array_to_string({toks}, ' ')"
    for k in ("ORG", "PER", "LOC", "NUM"):
        j = f"regexp_replace({j} || ' ', {q('(' + ph[k] + ' )+')}, {q(ph[k] + ' ')}, 'g')"
    neg = cfg.negation
    j = f"regexp_replace({j}, {q('(^| )' + neg + ' ([^ ]+)')}, {q(chr(92) + '1' + neg + '_' + chr(92) + '2')}, 'g')"
    return f"regexp_replace(trim({j}), ' +', ' ', 'g')"


def mask_lexicon(line: str, cfg: Config) -> str:
    num, dat = cfg.placeholders["NUM"], cfg.placeholders["DAT"]
    x = line
    for w in cfg.number_words:
        x = f"replace({x}, {q(' ' + w + ' ')}, {q(' ' + num + ' ')})"
    for w in cfg.date_words:
        x = f"replace({x}, {q(' ' + w + ' ')}, {q(' ' + dat + ' ')})"
    x = f"regexp_replace({x} || ' ', {q('(' + num + ' )+')}, {q(num + ' ')}, 'g')"
    x = f"regexp_replace({x} || ' ', {q('(' + dat + ' )+')}, {q(dat + ' ')}, 'g')"
    return x


def clean_paragraph(p: str, cfg: Config, stops, entities, lemmas) -> str:
    line = (f"array_to_string(list_transform({sentences(p)}, "
            f"lambda s: {clean_sentence('s', cfg, stops, entities, lemmas)} || ' . '), '')")
    return mask_lexicon(line, cfg)


def clean_text(t: str, cfg: Config, stops, entities, lemmas, head_n: int | None = None) -> str:
    n = cfg.head_paragraphs if head_n is None else head_n
    paras = head(paragraphs(t), n)
    lines = f"list_transform({paras}, lambda p: {clean_paragraph('p', cfg, stops, entities, lemmas)})"
    return f"regexp_replace(trim(array_to_string({lines}, ' ')), ' +', ' ', 'g')"


def vector_terms(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda t: length(t) >= 2)"


def strip_boilerplate(t: str, phrases) -> str:
    x = t
    for ph in phrases:
        x = f"replace({x}, {q(ph)}, '')"
    return x


def has_text(t: str) -> str:
    return f"({t} IS NOT NULL AND regexp_matches({t}, '\\S'))"


def candidate_text(title: str, text: str) -> str:
    return f"coalesce({title}, '') || {NL} || coalesce({text}, '')"


def doc_title(t: str) -> str:
    return f"split_part({t}, {NL}, 1)"


def doc_rest(t: str) -> str:
    return f"CASE WHEN strpos({t}, {NL}) > 0 THEN substr({t}, strpos({t}, {NL}) + 1) ELSE '' END"


def doc_url(source: str, doc_id: str) -> str:
    return f"'https://' || {source} || '.example.org/' || CAST({doc_id} AS VARCHAR)"


def repost_target(text: str) -> str:
    pat = REPOST_PATTERN
    flat = f"replace({text}, {NL}, ' ')"
    return f"{q(REPOST_WALL_PREFIX)} || regexp_extract({flat}, {q(pat)}, 1)"


def repost_has_marker(text: str) -> str:
    return f"regexp_matches(replace({text}, {NL}, ' '), {q(REPOST_PATTERN)})"
