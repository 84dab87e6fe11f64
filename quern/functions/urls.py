"""URL functions, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parameters in which search engines carry the real destination, in order.
WRAPPER_PARAMETERS = ("uddg", "url", "u", "q", "target")
QUERY_PARAMETERS = ("q", "p", "query")
SHARED_SKIP_LABELS = ("gstatic", "googleusercontent", "googleapis", "googlesyndication", "googleadservices", "doubleclick")
#: Result page, count parameter, infrastructure labels and hosts of each engine.
ENGINES = {
    "google": ("https://www.google.com/search?q=", "num", ("google", *SHARED_SKIP_LABELS), ("google.com",)),
    "bing": ("https://www.bing.com/search?q=", "count", ("bing", "microsofttranslator", *SHARED_SKIP_LABELS), ("go.microsoft.com", "login.live.com", "msn.com", "onenote.com")),
    "duckduckgo": ("https://duckduckgo.com/?q=", "", ("duckduckgo", "duck", *SHARED_SKIP_LABELS), ("spreadprivacy.com", "apps.apple.com")),
}


def part(url: Column, what: str) -> Column:
    """A part of a URL; null for what is no URL."""
    return F.try_parse_url(url, F.lit(what))


def domain_of(url: Column) -> Column:
    """Host in lower case, empty where there is none."""
    return F.coalesce(F.lower(part(url, "HOST")), F.lit(""))


def is_http(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def looks_like_url(text: Column) -> Column:
    trimmed = F.trim(text)
    return is_http(trimmed) & (domain_of(trimmed) != "")


def parameter(url: Column, name: str) -> Column:
    """Decoded value of a query parameter; null where it is missing, empty or can't be decoded."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def decoded_target(value: Column) -> Column:
    """Destination inside a base64url click wrapper with the prefix ``a1``; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(value, "^a1", ""), "=+$", "")
    text = F.try_to_binary(F.translate(bare, "-_", "+/"), F.lit("base64")).cast("string")
    return F.when(is_http(text), text)


def unwrap_once(url: Column) -> Column:
    found = []
    for name in WRAPPER_PARAMETERS:
        value = parameter(url, name)
        found.append(F.when(is_http(value), value))
        if name == "u":
            found.append(decoded_target(value))
    return F.coalesce(*found, url)


def unwrap(url: Column, depth: int = 3) -> Column:
    """The destination behind up to ``depth`` wrappers."""
    for _ in range(depth):
        # a lambda binds the value: written out, every round would repeat the one before eleven times
        url = F.transform(F.array(url), unwrap_once)[0]
    return url


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def dedupe_key(url: Column) -> Column:
    """Host, path without the slash at its end, and query: the same for variants of one address."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    host_path = F.regexp_replace(F.concat(domain_of(url), path), "/$", "")
    return F.concat(host_path, F.lit("?"), F.coalesce(part(url, "QUERY"), F.lit("")))


def skipped_host(host: Column, labels: Sequence[str], hosts: Sequence[str]) -> Column:
    """Whether a host is one of ``hosts``, below one of them, or has one of ``labels``."""
    out = F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels])) if labels else F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def landed_query(url: Column) -> Column:
    """The query in the address that an engine landed on; empty where there is none."""
    return F.coalesce(*[parameter(url, p) for p in QUERY_PARAMETERS], F.lit(""))


def search_url(engine: Column, term: Column, results: int = 0) -> Column:
    """Result page of a term on a known engine; null for other engines."""
    out = F.lit(None).cast("string")
    for name, (base, count, _, _) in ENGINES.items():
        url = F.concat(F.lit(base), F.url_encode(term), F.lit(f"&{count}={results}" if results > 0 and count else ""))
        out = F.when(engine == name, url).otherwise(out)
    return out


def destinations(rows: DataFrame, engine: str) -> DataFrame:
    """(id, url, position): what the raw ``links`` of each row lead to.

    Links are unwrapped; those that are not http(s) or lead to the engine itself are left out, and so are
    later variants of an address. Positions count from 1 in the order of the links.
    """
    _, _, labels, hosts = ENGINES[engine]
    links = rows.select("id", F.posexplode("links").alias("p", "raw")).select("id", "p", unwrap(F.col("raw")).alias("url"))
    host = domain_of(F.col("url"))
    real = links.where(is_http(F.col("url")) & (host != "") & ~skipped_host(host, labels, hosts))
    first = real.groupBy("id", dedupe_key(F.col("url")).alias("key")).agg(F.min(F.struct("p", "url")).alias("m"))
    order = Window.partitionBy("id").orderBy("m.p")  # the links of one page
    return first.select("id", without_fragment(F.col("m.url")).alias("url"), F.row_number().over(order).alias("position"))


def resolve(base: str | None, reference: str | None) -> str:
    """Absolute http(s) address of a reference, else the empty string."""
    try:
        url = urljoin(base or "", (reference or "").strip())
        return url if urlsplit(url).scheme in ("http", "https") and urlsplit(url).netloc else ""
    except ValueError:
        return ""


@F.pandas_udf(StringType())
def resolve_reference(base: pd.Series, reference: pd.Series) -> pd.Series:
    """:func:`resolve` over columns; no built-in function joins relative addresses."""
    return pd.Series([resolve(b, r) for b, r in zip(base, reference)])
