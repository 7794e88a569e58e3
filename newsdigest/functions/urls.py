"""URL expressions (P1, P2, P8-P10, F5) as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MESSENGER_FIX, MESSENGER_HOST, SOURCE_LABEL

# scheme "://" authority: the authority runs to the first '/', '?' or '#'
_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*)://"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
# an absolute http(s)/ftp URL: optional user info, a dotted host, IPv4 or localhost,
# optional port, then path/query/fragment without white space
VALID_URL = ("^(?i)(https?|ftp)://([^\\s:@/?#]+(:[^\\s@/?#]*)?@)?"
             "(([\\p{L}0-9]([\\p{L}0-9-]*[\\p{L}0-9])?\\.)+[\\p{L}]{2,}|[0-9]{1,3}(\\.[0-9]{1,3}){3}|localhost)"
             "(:[0-9]{1,5})?([/?#][^\\s]*)?$")
ARCHIVE_RE = "^https://web\\.archive\\.org/web/([0-9]+[a-z_]*/)?"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def netloc(url) -> Column:
    """The authority of ``scheme://authority/...``; '' when there is none."""
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), _AUTHORITY, 1)


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(_c(url), F.lit("")), _SCHEME, 1))


def path(url) -> Column:
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), _PATH, 1)


def origin(url) -> Column:
    """``scheme://netloc`` of a URL (the base for relative links)."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def is_valid_url(url) -> Column:
    """absolute http(s)/ftp URL with a plausible host and no white space."""
    return F.coalesce(_c(url).rlike(VALID_URL), F.lit(False))


def resolve_link(href2, href, base_url) -> Column:
    """Keep ``href2``; else ``href`` when it contains 'http' anywhere; else
    ``base_url`` followed by ``href`` (plain concatenation)."""
    h2 = F.coalesce(_c(href2), F.lit(""))
    h = F.coalesce(_c(href), F.lit(""))
    b = F.coalesce(_c(base_url), F.lit(""))
    return (F.when(h2 != F.lit(""), h2)
            .when(h.contains("http"), h)
            .otherwise(F.concat(b, h)))


def strip_ws(s) -> Column:
    """Python-style strip of leading/trailing white space (``F.trim`` strips spaces only)."""
    return F.regexp_replace(_c(s), "(?U)^\\s+|\\s+$", "")


def clean_source_url(url) -> Column:
    """Drop the source label, strip white space."""
    return strip_ws(F.replace(_c(url), F.lit(SOURCE_LABEL), F.lit("")))


def unwrap_archive(url) -> Column:
    """Remove the web-archive prefix and its timestamp segment."""
    return F.regexp_replace(_c(url), ARCHIVE_RE, "")


def lookup_host(url) -> Column:
    """Host used for rule lookup: label stripped, archive unwrapped, authority."""
    return netloc(unwrap_archive(clean_source_url(url)))


def fix_messenger_link(url) -> Column:
    """P10: public-preview rewrite, only on the messenger host (not idempotent)."""
    a, b = MESSENGER_FIX
    return F.when(netloc(url) == F.lit(MESSENGER_HOST), F.replace(_c(url), F.lit(a), F.lit(b))) \
        .otherwise(_c(url))


def undo_messenger_link(url) -> Column:
    a, b = MESSENGER_FIX
    return F.when(netloc(url) == F.lit(MESSENGER_HOST), F.replace(_c(url), F.lit(b), F.lit(a))) \
        .otherwise(_c(url))
