"""Golden values of scalar functions."""

from __future__ import annotations

import base64
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern import config
from quern.config import Tiers
from quern.functions import options, text, tiers, urls
from quern.functions.html import clean_page, cleaned, collapse

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def value(spark):
    """Value of an expression over one row of named strings."""

    def of(expression, **columns):
        names = list(columns) or ["x"]
        df = spark.createDataFrame([tuple(columns.values()) or (None,)], ", ".join(f"{n} string" for n in names))
        return df.select(expression.alias("v")).first().v

    return of


@pytest.mark.parametrize(("query", "key"), [("  Hello   World  ", "hello world"), ("A\tb\n C", "a b c"), ("a b", "a b"), ("", ""), (None, None)])
def test_normalize_query(value, query, key):
    assert value(text.normalize_query(F.col("q")), q=query) == key


def test_content_hash(value):
    h = lambda t, c: value(text.content_hash(F.col("t"), F.col("c")), t=t, c=c)
    assert h("a", "b") == h("a", None) != h(None, "b") and h("", "b") == h(None, "b") and h(None, None) == h("", "") == ""


@pytest.mark.parametrize("sample", ["é" * 30, "a" * 5 + "日本語" * 9, "😀" * 12, "plain text " * 4, "", "a"])
@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7, 10, 21])
def test_truncate_bytes(value, sample, limit):
    assert value(text.truncate_bytes(F.col("t"), limit), t=sample) == sample.encode()[:limit].decode(errors="ignore")


def test_collapse(value):
    messy = "\n\n  Hello   world  \n\n\n\n   Next    line \n\n"
    assert value(text.collapse_whitespace(F.col("t")), t=messy) == collapse(messy) == "Hello world\n\nNext line"


def test_json(value):
    assert value(text.json_array_span(F.col("t")), t='so [{"a": 1}] it is') == '[{"a": 1}]'
    assert value(text.json_array_span(F.col("t")), t="none") == ""
    assert value(text.result_count(F.col("t")), t='["a", {"b": 1}]') == 2
    assert value(text.result_count(F.col("t")), t="broken") == value(text.result_count(F.col("t")), t=None) == 0
    facts = value(text.extracted_facts(F.col("t")), t='x [{"text": "a", "volatility": "stable"}] y')
    assert [(f.text, f.volatility) for f in facts] == [("a", "stable")]


@pytest.mark.parametrize(("message", "level"), [("ERROR: WARNING", "error"), ("a WARNING", "warn"), ("NOTE", "notice"), ("error", "info")])
def test_level(value, message, level):
    assert value(text.level_of(F.col("m")), m=message) == level


def test_blocked_and_html(value):
    blocked = lambda u, h=None: value(text.looks_blocked(F.col("u"), F.col("h")), u=u, h=h)
    assert blocked("https://e.invalid/sorry/x") and blocked("https://e.invalid/CAPTCHA") and blocked("", "<p>Are you a Robot</p>") and not blocked(None, "fine")
    assert [value(text.is_html(F.col("c")), c=c) for c in ("", None, "text/html; charset=x", "application/xhtml+xml", "application/pdf", "image/png")] == [True, True, True, True, False, False]
    assert value(text.needs_render(F.col("t"), F.col("h"), 5), t="long enough", h='<div id="root"></div>')


def test_display(value):
    assert value(text.preview(F.lit("abcdef"), 3)) == "abc…" and value(text.middle_truncated(F.lit("abcdefghij"), 5)) == "ab…ij"
    assert [value(text.magnitude(F.lit(n))) for n in (999, 1200, 3_400_000)] == ["999", "1.2k", "3.4M"]
    assert [value(text.shown_duration(F.lit(n))) for n in (850, 1500, 125_000)] == ["850 ms", "1.5 s", "2m 5s"]
    assert value(text.tokens_per_second(F.lit(10), F.lit(0))) is None


def test_urls(value):
    link = lambda u: value(urls.unwrap(F.col("u")), u=u)
    coded = base64.urlsafe_b64encode(b"https://d.example/x?y=1").decode().rstrip("=")
    assert link(f"https://b.invalid/ck/a?u=a1{coded}") == "https://d.example/x?y=1"
    assert link("https://e.invalid/l/?uddg=https%3A%2F%2Fa.example%2Fp") == "https://a.example/p"
    assert link("https://a.example/p?x=1") == "https://a.example/p?x=1" and link("not a url") == "not a url"
    key = lambda u: value(urls.dedupe_key(F.col("u")), u=u)
    assert key("http://A.example:80/x/") == key("https://a.example/x#f") != key("https://a.example/x?q=1")
    assert value(urls.domain_of(F.col("u")), u="https://A.Example/x") == "a.example" and value(urls.domain_of(F.col("u")), u="a b") == ""
    assert [value(urls.looks_like_url(F.col("u")), u=u) for u in (" https://a.example ", "a.example", "ftp://a.example")] == [True, False, False]
    assert value(urls.landed_query(F.col("u")), u="https://e.invalid/s?p=go+web&x=1") == "go web"
    assert value(urls.search_url(F.lit("google"), F.lit("go test"), 20)).endswith("search?q=go+test&num=20")
    assert value(urls.search_url(F.lit("duckduckgo"), F.lit("a"), 20)).endswith("?q=a") and value(urls.search_url(F.lit("none"), F.lit("a"))) is None
    skip = lambda h: value(urls.skipped_host(F.col("h"), ("google",), ("msn.example",)), h=h)
    assert [skip(h) for h in ("policies.google.com", "msn.example", "a.msn.example", "notmsn.example")] == [True, True, True, False]


@pytest.mark.parametrize(("reference", "absolute"), [("/img/a.png", "https://e.example/img/a.png"), ("b.png", "https://e.example/blog/b.png"), ("//cdn.example/c", "https://cdn.example/c"), ("data:x", ""), (None, "https://e.example/blog/post.html")])
def test_resolve(reference, absolute):
    assert urls.resolve("https://e.example/blog/post.html", reference) == absolute


def test_tiers(value):
    t = Tiers()
    rise = lambda tier, hits: value(tiers.promoted(F.lit(tier), F.lit(hits), t))
    assert [rise(*x) for x in (("short", 2), ("short", 3), ("long", 99), ("permanent", 0))] == ["short", "long", "long", "permanent"]
    ends = lambda tier: value(F.unix_seconds(tiers.expiry(F.lit(NOW), F.lit(tier), t)) - int(NOW.timestamp()))
    assert [ends(x) for x in ("short", "long", "permanent", "odd", None)] == [864_000, 3_888_000, None, 864_000, 864_000]
    norm = lambda a, b: value(tiers.normalized_tier(F.lit(a), F.lit(b)))
    assert [norm(*x) for x in (("", "short"), ("", "long"), ("bogus", "long"), ("permanent", "short"), ("b", "c"), ("LONG", "short"))] == ["short", "long", "long", "permanent", "short", "long"]
    assert [value(tiers.remembered_tier(F.lit(x))) for x in ("off", "long", "", None)] == [None, "long", "short", "short"]
    assert [value(tiers.volatility_hours(F.lit(x))) for x in (" Volatile", "stable", None)] == [24, 0, 0]


def test_fresh(value):
    day = timedelta(days=1)
    f = lambda e, g, a=None: value(tiers.fresh(F.lit(NOW), F.lit(e).cast("timestamp"), F.lit(g).cast("timestamp"), a))
    assert [f(NOW - day, NOW), f(NOW + day, NOW), f(NOW + day, NOW - 2 * day, day), f(None, None), f(NOW, NOW), f(None, None, day)] == [False, True, False, True, True, True]


def test_options():
    assert options.result_counts("google=20, ddg=5") == {"google": 20, "duckduckgo": 5} and options.engine_set("none") == set() and options.engine_set("google,ddg") == {"google", "duckduckgo"}
    for bad in ("google", "google=x"):
        with pytest.raises(ValueError):
            options.result_counts(bad)
    with pytest.raises(ValueError):
        options.engines_by_names("altavista")
    assert [options.clamp_page(*x) for x in ((0, 0), (500, 1), (501, -1), (None, None))] == [(50, 0), (500, 1), (50, 0), (50, 0)]
    assert [options.clamp_k(k) for k in (None, 0, 1, 10_000)] == [10, 10, 1, 100] and options.clamp_projection(0, 0) == 1 and options.clamp_projection(5, 3) == 3
    with pytest.raises(ValueError):
        options.required(url=" ")


def test_config(tmp_path):
    file = tmp_path / "a.toml"
    file.write_text('[tiers]\nshort_ttl = "1h30m"\n[memory]\ntop_k = 3\n')
    settings = config.load(file)
    assert settings.tiers.short_ttl == timedelta(minutes=90) and settings.memory.top_k == 3 and settings.tiers.long_ttl == timedelta(hours=1080)
    file.write_text("[tiers]\nwrong = 1\n")
    with pytest.raises(KeyError):
        config.load(file)
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.toml")
    assert config.load(default=tmp_path / "none.toml") == config.Settings()


def test_html(spark):
    page = clean_page(
        """<html><head><title> A &amp; B </title><style>x</style></head><body><nav>menu</nav><h1>Head</h1><p>One<p>Two <b>bold</b><!-- no -->
<img src="/a.png" width="20px" alt="x"><img data-src="//c.example/b.png"><img src="data:q"><img src="/a.png"><script>bad()</script><ul><li>i<li>j</ul></body></html>""",
        "https://e.example/p/",
    )
    assert page.title == "A & B" and page.text.split("\n") == ["Head", "", "One", "", "Two bold", "", "i", "", "j"]
    assert [i["url"] for i in page.images] == ["https://e.example/a.png", "https://c.example/b.png"] and page.images[0]["width"] == 20
    assert "menu" not in page.clean_html and "bad" not in page.clean_html and page.clean_html.count("<p>") == page.clean_html.count("</p>") == 2
    assert clean_page(None).text == clean_page("").text == "" and clean_page("<title>t").title == "t" and clean_page("no tags").text == "no tags"
    df = spark.createDataFrame([("1", None, "u", 5), ("2", "<p>a", None, 5), (None, "<p>b", "u", 5)], "id string, raw_html string, url string, text int")
    assert sorted((r.id or "", r.text) for r in cleaned(df).collect()) == [("", "b"), ("2", "a")]
