"""Fetching pages: a data source over an injected transport, validators, robots rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.urls import domain_of

ROBOTS_BYTES = 512 * 1024


@dataclass
class Response:
    status: int
    body: str = ""
    headers: Mapping[str, str] | None = None

    def header(self, name: str) -> str | None:
        """A header by name, in any case."""
        return {k.lower(): v for k, v in (self.headers or {}).items()}.get(name.lower())


Transport = Callable[[str, Mapping[str, str]], Response]
_FETCHED = "url string, status int, body string, etag string, last_modified string, retry_after string, allowed boolean, error string"


def robots_rules(response: Response | None) -> RobotFileParser:
    """Rules of a robots.txt answer: none for 4xx and unreachable hosts, nothing allowed for 5xx."""
    rules = RobotFileParser()
    if response is None or 400 <= response.status < 500:
        rules.allow_all = True
    elif response.status >= 500:
        rules.disallow_all = True
    else:
        rules.parse(response.body.encode()[:ROBOTS_BYTES].decode(errors="ignore").splitlines())
    rules.modified()
    return rules


def allowed(rules: RobotFileParser, url: str, agent: str) -> bool:
    parts = urlsplit(url)
    return rules.can_fetch(agent, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def crawl(urls: DataFrame, transport: Transport, agent: str = "*", most_bytes: int = 5 * 1024 * 1024, most_urls: int | None = None) -> DataFrame:
    """Fetch (url, etag, last_modified) host by host: one host in one task, many hosts at once.

    Rows without a host are left out. The cap on addresses comes before they are grouped. Validators are sent
    along, so a page that did not change answers 304 without a body; robots.txt is asked once for each host.
    """
    chosen = urls.select("url", "etag", "last_modified", domain_of(F.col("url")).alias("host")).where("host <> ''")
    if most_urls is not None:
        chosen = chosen.orderBy("url").limit(most_urls)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules: dict[str, RobotFileParser] = {}
        for part in parts:
            out = []
            for r in part.itertuples():
                origin = "{0.scheme}://{0.netloc}".format(urlsplit(r.url))
                if origin not in rules:
                    try:
                        rules[origin] = robots_rules(transport(f"{origin}/robots.txt", {}))
                    except OSError:
                        rules[origin] = robots_rules(None)
                if not allowed(rules[origin], r.url, agent):
                    out.append((r.url, None, None, None, None, None, False, "robots disallowed"))
                    continue
                validators = {k: v for k, v in (("If-None-Match", r.etag), ("If-Modified-Since", r.last_modified)) if v}
                try:
                    answer = transport(r.url, validators)
                    body = answer.body.encode()[:most_bytes].decode(errors="ignore")
                    out.append((r.url, answer.status, body, answer.header("etag"), answer.header("last-modified"), answer.header("retry-after"), True, None))
                except OSError as e:
                    out.append((r.url, None, None, None, None, None, True, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FETCHED.split(", ")])

    return chosen.repartition("host").mapInPandas(run, _FETCHED)


class PageSource(DataSource):
    """``spark.read.format("quern_pages")`` over a folder of saved pages: one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "quern_pages"

    def schema(self) -> str:
        return "url string, html string, byte_size bigint"

    def reader(self, schema: object) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.base = options["path"], options.get("base", "https://pages.invalid/")

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(name) for name in sorted(os.listdir(self.path)) if name.endswith((".html", ".htm"))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, int]]:
        with open(f"{self.path}/{partition.value}", encoding="utf-8", errors="replace") as f:
            html = f.read()
        yield self.base + partition.value, html, len(html.encode())
