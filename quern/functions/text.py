"""Scalar functions on text, as column expressions inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a challenge page says.
BLOCK_HINTS = ("unusual traffic", "verify you are human", "are you a robot", "our systems have detected", "recaptcha", "solve the challenge")
BLOCK_SCAN_CHARS = 200_000


def normalize_query(query: Column) -> Column:
    """Key of a query: lower case, white space of any kind collapsed and trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(query), r"(?U)\s+", " "))


def same_query(a: Column, b: Column) -> Column:
    return normalize_query(a) == normalize_query(b)


def blank(text: Column) -> Column:
    """True for null, empty and white space alone."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")) == ""


def content_hash(text: Column, clean_html: Column) -> Column:
    """SHA-256 in hex of the text, else of the cleaned HTML, else the empty string."""
    content = F.coalesce(F.nullif(text, F.lit("")), F.nullif(clean_html, F.lit("")))
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def level_of(message: Column) -> Column:
    """Level of a log message by the marker that it holds; case matters."""
    return F.when(message.contains("ERROR"), "error").when(message.contains("WARNING"), "warn").when(message.contains("NOTE"), "notice").otherwise("info")


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes in UTF-8 that ends on a code point."""
    raw = F.encode(text, "UTF-8")
    # a code point that was cut leaves its first bytes at the end; those are looked at in hex
    cut = F.hex(F.substring(raw, 1, limit))
    whole = F.regexp_replace(cut, r"((C|D).|E.(..)?|F.(..){0,2})$", "")
    hex_whole = F.when(F.length(F.regexp_extract(cut, r"(E.[89AB].[89AB].|(C|D).[89AB].|F.[89AB].[89AB].[89AB].)$", 0)) > 0, cut).otherwise(whole)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.unhex(hex_whole), "UTF-8"))


def preview(text: Column, limit: int = 60) -> Column:
    """The first ``limit`` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def collapse_whitespace(text: Column) -> Column:
    """Lines with their white space collapsed, at most one empty line between two others, none at the ends."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def json_array_span(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; empty where there is none."""
    return F.regexp_extract(text, r"(?s)\[.*\]", 0)


def extracted_facts(answer: Column) -> Column:
    """array<struct<text, volatility>> of a model's answer; null where the span is no such JSON."""
    return F.from_json(json_array_span(answer), "array<struct<text: string, volatility: string>>")


def result_count(results: Column) -> Column:
    """Number of entries of a stored JSON list; 0 for broken or missing JSON."""
    return F.coalesce(F.json_array_length(results), F.lit(0))


def looks_blocked(landed_url: Column, html: Column) -> Column:
    """Whether a landed page is a challenge: by its URL, or by a hint in the first part of its body."""
    url = F.lower(F.coalesce(landed_url, F.lit("")))
    body = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, BLOCK_SCAN_CHARS))
    hinted = F.lit(False)
    for hint in BLOCK_HINTS:
        hinted = hinted | body.contains(hint)
    return url.contains("/sorry/") | url.contains("captcha") | hinted


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (F.trim(kind) == "") | kind.contains("text/html") | kind.contains("xhtml")


def needs_render(text: Column, html: Column, least_bytes: int) -> Column:
    """Whether a page should be fetched again with a browser: thin text, or the mount of a script application."""
    mount = F.coalesce(html, F.lit("")).rlike(r"""(?i)<div[^>]+id=["'](root|app|__next)["'][^>]*>\s*</div>""")
    return (F.octet_length(F.coalesce(text, F.lit(""))) < least_bytes) | mount


def magnitude(n: Column) -> Column:
    """Number of characters for display: 999, 1.2k, 3.4M."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M")))


def shown_duration(ms: Column) -> Column:
    """Duration for display: 850 ms, 1.5 s, 2m 5s; null stays null."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s")))
        .when(ms.isNotNull(), F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )


def middle_truncated(text: Column, limit: int = 40) -> Column:
    """Both ends of a long text around an ellipsis."""
    left, right = (limit - 1) - (limit - 1) // 2, (limit - 1) // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(left)), F.lit("…"), F.right(text, F.lit(right)))).otherwise(text)


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    """Rate of a model call; null where it took no time."""
    return F.round(tokens / F.nullif(ms / 1000, F.lit(0.0)), 1)
