"""Text scalar functions as Spark Columns.

All are built-in expressions, so they stay inside whole-stage codegen.
Python's ``\\s``/``\\w`` are Unicode-aware; Java's are not unless ``(?U)`` is set,
so every pattern that mirrors a Python ``re`` pattern carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.constants import ENGLISH_STOP_WORDS, PREVIEW_CHARS

WS = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (Spark ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalize_text(x) -> Column:
    """H1: lower, CRLF->LF, collapse whitespace runs to one space, strip; null -> ''."""
    s = F.lower(F.coalesce(_c(x), F.lit("")))
    return strip(F.regexp_replace(s, WS, " "))


def normalize_body(x) -> Column:
    """H2: as H1 without lower-casing."""
    return strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), WS, " "))


def sha256_hex(x) -> Column:
    """H3: SHA-256 hex of the UTF-8 bytes."""
    return F.sha2(_c(x), 256)


def short_id(*vals) -> Column:
    """H4: SHA-256 over each value followed by NUL, first 16 hex digits; null -> ''."""
    parts = []
    for v in vals:
        parts += [F.coalesce(_c(v), F.lit("")), F.lit("\u0000")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def extract_body(x) -> Column:
    """H5: text after the first blank line (LF LF), else the whole text; stripped."""
    return strip(F.element_at(F.split(_c(x), "\n\n", 2), -1))


def clean_newlines(x) -> Column:
    """Universal newlines: CRLF and lone CR become LF."""
    return F.regexp_replace(_c(x), "\r\n?", "\n")


def decode_utf8_ignore(content) -> Column:
    """Bytes -> text, dropping bytes that are not valid UTF-8 (errors='ignore')."""
    s = F.expr(f"make_valid_utf8(cast({content} as string))") if isinstance(content, str) else \
        F.make_valid_utf8(content.cast("string"))
    return clean_newlines(F.regexp_replace(s, "�", ""))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?"


def _entity_map() -> Column:
    """Named entities of HTML 5 (a constant map), keyed as written: ``&name;`` or, for the old ones, ``&name``."""
    from html.entities import html5

    return F.create_map(*[F.lit(x) for name, ch in html5.items() for x in ("&" + name, ch)])


def html_unescape(x) -> Column:
    """Character references decoded once: decimal, hexadecimal and all named ones; unknown ones stay as they are."""
    s = F.coalesce(_c(x), F.lit(""))
    named = _entity_map()

    def decode(e: Column) -> Column:
        digits = F.regexp_extract(e, "([0-9a-fA-F]+);?$", 1)
        number = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        usable = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(usable, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(F.startswith(e, F.lit("&#")), char).otherwise(F.coalesce(F.try_element_at(named, e), e))

    found = F.regexp_extract_all(s, F.lit(_ENTITY), F.lit(0))
    gaps = F.split(s, _ENTITY, -1)
    pairs = F.zip_with(gaps, found, lambda g, e: F.concat(g, F.when(e.isNull(), F.lit("")).otherwise(decode(e))))
    return F.when(F.contains(s, F.lit("&")), F.array_join(pairs, "")).otherwise(s)


def html_to_text(x, crude: bool = False) -> Column:
    """H6: drop comments, script/style with content and tags, decode entities, collapse spaces.

    ``crude=True`` is the fallback behaviour: tags become spaces, then strip.
    """
    s = F.coalesce(_c(x), F.lit(""))
    if crude:
        return strip(F.regexp_replace(s, r"<[^>]+>", " "))
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return strip(F.regexp_replace(html_unescape(s), WS, " "))


# URL rules --------------------------------------------------------------------

URL_PATTERN = r"(?iU)https?://[^\s)>\]" + "\"'" + r"]+"
URL_TRAILING = r"[).,>\]}" + "\"'" + r"]+$"
RULE_URL_PATTERN = r"(?U)https?://\S+"
IP_HOST_PATTERN = r"(?i)^https?://([^/?#]*@)?([0-9]{1,3}\.){3}[0-9]{1,3}(:[^/?#]*)?([/?#]|$)"


def extract_urls(x) -> Column:
    """H7: case-insensitive URL scan, trailing ``).,>]}"'`` stripped; [] for null/''."""
    raw = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(URL_PATTERN), 0)
    return F.transform(raw, lambda u: F.regexp_replace(u, URL_TRAILING, ""))


def rule_urls(x) -> Column:
    """H8: the rule classifier's URL scan: case-sensitive scheme, up to whitespace."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(RULE_URL_PATTERN), 0)


def url_host_is_ip(u) -> Column:
    """H9: host is a dotted quad (userinfo and port ignored)."""
    return _c(u).rlike(IP_HOST_PATTERN)


def any_ip_url(urls) -> Column:
    return F.exists(_c(urls), url_host_is_ip)


def any_punycode_url(urls) -> Column:
    """H10"""
    return F.exists(_c(urls), lambda u: F.contains(u, F.lit("xn--")))


def distinct_urls(*url_arrays) -> Column:
    """Distinct union of URL lists, sorted for a deterministic order."""
    acc = url_arrays[0]
    for a in url_arrays[1:]:
        acc = F.array_union(acc, a)
    return F.array_sort(F.array_distinct(acc))


def preview(x, n: int = PREVIEW_CHARS) -> Column:
    """First n code points."""
    return F.substring(F.coalesce(_c(x), F.lit("")), 1, n)


# Tokenisers (H23, H24) ----------------------------------------------------------

WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def word_tokens(x, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """H23 unigrams: lower-case runs of >= 2 word characters, stop words removed."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(WORD_TOKEN), 0)
    if stop_words:
        # a long literal IN list becomes a hash-set lookup (InSet)
        toks = F.filter(toks, lambda t: ~t.isin(*stop_words))
    return toks


def word_ngrams(tokens, n_min: int = 1, n_max: int = 2) -> Column:
    """1..n-grams over the stop-filtered token list, joined by a space.

    n-grams are built by zipping shifted slices, so the token array is
    evaluated a fixed number of times per row (a lambda that indexes into an
    array *expression* would re-evaluate it once per element).
    """
    toks = _c(tokens)
    out = None
    for n in range(n_min, n_max + 1):
        if n == 1:
            grams = toks
        else:
            grams = shifted_ngrams(toks, n, " ")
        out = grams if out is None else F.concat(out, grams)
    return out


def char_prepare(x) -> Column:
    """Char analyzer pre-processing: lower-case, runs of 2+ whitespace -> one space."""
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)\s\s+", " ")


def code_points(text) -> Column:
    """The text as an array of code points (one regex pass, linear)."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("(?s)."), 0)


def shifted_ngrams(items, n: int, sep: str) -> Column:
    """All windows of n consecutive items, joined by ``sep`` (linear: zipped shifted slices)."""
    arr = _c(items)
    shifted = [F.slice(arr, k + 1, F.greatest(F.size(arr) - k, F.lit(0))) for k in range(n)]
    z = F.arrays_zip(*[x.alias(f"g{k}") for k, x in enumerate(shifted)])
    full = F.filter(z, lambda e: e[f"g{n - 1}"].isNotNull())
    return F.transform(full, lambda e: F.concat_ws(sep, *[e[f"g{k}"] for k in range(n)]))


def char_ngrams(chars, lo: int, hi: int) -> Column:
    """All character n-grams, lo <= n <= hi, from a code-point array column.

    Positional ``substring`` on UTF-8 text costs O(position), which makes
    n-gram extraction quadratic; windows over the code-point array are linear.
    """
    out = None
    for n in range(lo, hi + 1):
        g = shifted_ngrams(chars, n, "")
        out = g if out is None else F.concat(out, g)
    return out
