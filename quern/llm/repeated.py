"""Problem 5: lines repeated across the documents of one source, by bitmaps.

The documents of a source are numbered within chunks of a bounded size. Each variant of a line has one
compressed bitmap of documents for each chunk (a list of places, of runs, or plain bits, whichever is
shortest); the bitmaps of variants that normalise to the same line are united and their exact cardinalities
decide. The bitmaps that are kept tell each document, by its place, which lines go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut, if_small, newest

#: Documents of a source are spread over chunks of about this size; a bitmap has 32 768 bits.
CHUNK_DOCUMENTS, BITMAP_BITS = 16_384, 32_768
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.2
#: Sites or lines that are broadcast at most (some 40 bytes each), and the parts of a site that meet beyond that.
BROADCAST_ROWS, SALTS = 200_000, 32
_PLACES, _RUNS, _BITS = 0, 1, 2


def normalised(line: Column) -> Column:
    """Lower case, no U+0020 at the ends, runs of U+0020 as one."""
    return F.trim(F.regexp_replace(F.lower(line), " +", " "))


def sites(urls: DataFrame) -> DataFrame:
    """(url, site): the domain in lower case of each registered url; blank domains are no site."""
    named = urls.where("url is not null and trim(domain) <> ''").select("url", F.lower("domain").alias("site"))
    return named.groupBy("url").agg(F.min("site").alias("site"))


def packed(places: np.ndarray) -> bytes:
    """A compressed bitmap of ascending distinct places below BITMAP_BITS: a mark, then places, runs or bits."""
    breaks = np.flatnonzero(np.diff(places) != 1)
    starts, ends = places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]
    if min(len(places), 2 * len(starts)) * 2 >= BITMAP_BITS // 8:
        bits = np.zeros(BITMAP_BITS, np.uint8)
        bits[places] = 1
        return bytes([_BITS]) + np.packbits(bits, bitorder="little").tobytes()
    if 2 * len(starts) < len(places):
        return bytes([_RUNS]) + np.column_stack([starts, ends]).astype("<u2").tobytes()
    return bytes([_PLACES]) + places.astype("<u2").tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    """The places of a compressed bitmap."""
    kind, body = bitmap[0], bitmap[1:]
    if kind == _BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    numbers = np.frombuffer(body, "<u2").astype(np.int64)
    if kind == _PLACES:
        return numbers
    starts, ends = numbers[0::2], numbers[1::2]
    lengths = ends - starts + 1
    return np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def united(bitmaps: list[bytes]) -> bytes:
    """The union of compressed bitmaps."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    return packed(np.unique(np.concatenate([unpacked(b) for b in bitmaps])))


def numbered(documents: DataFrame) -> DataFrame:
    """Adds site_documents, chunk and ordinal (0.. within site and chunk) to (site, id, ...).

    The number of chunks follows the size of the site, so that no window or bitmap sees a whole large site.
    """
    sizes = documents.groupBy("site").agg(F.count("*").alias("site_documents"))
    if (small := if_small(sizes, BROADCAST_ROWS)) is not sizes:
        sized = documents.join(small, "site")
    else:  # a site may hold a large part of all documents
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        sized = documents.withColumn("salt", salt).join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["site", "salt"]).drop("salt")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("site_documents") / CHUNK_DOCUMENTS))
    placed = sized.withColumn("part", F.pmod(F.xxhash64("id"), chunks))
    number = F.row_number().over(Window.partitionBy("site", "part").orderBy("id")) - 1
    # a part that came out larger than a bitmap goes on in a further chunk
    return placed.withColumn("number", number).withColumn("chunk", F.col("part") + chunks * F.floor(F.col("number") / BITMAP_BITS)).withColumn("ordinal", (F.col("number") % BITMAP_BITS).cast("int")).drop("number")


def line_hashes(pages: DataFrame, id_column: str = "id", text_column: str = "text_content", order_column: str = "updated_at") -> DataFrame:
    """(id, url, lines) of the newest row of each page with text; lines are hashes, so no text is shuffled."""
    blank = F.xxhash64(F.lit(""))
    hashed = F.transform(
        F.split(text_column, "\n", -1),
        lambda line, i: F.struct(i.cast("int").alias("line_no"), F.xxhash64(normalised(line)).alias("line"), F.xxhash64(line).alias("variant")),
    )
    lines = F.when(F.col(text_column) != "", F.filter(hashed, lambda x: x["line"] != blank))
    rows = pages.select(F.col(id_column).cast("string").alias("id"), F.col(order_column).alias("__order"), "url", lines.alias("lines"))
    return newest(rows, "id", "__order", "url", "lines").where("lines is not null")


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """(site, line, chunk, bitmap, documents): the united bitmap of the variants of each line, and its cardinality.

    ``lines`` has site, line, chunk, variant and ordinal. A group streams through in order; what is held of it
    are its distinct places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
            site, line, chunk, variant, ordinal = rows
            group = np.flatnonzero(np.concatenate([[True], (site[1:] != site[:-1]) | (line[1:] != line[:-1]) | (chunk[1:] != chunk[:-1])]))
            ends = np.append(group[1:], len(site))
            cuts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
            bitmaps = []
            for s, e in zip(group.tolist(), ends.tolist()):
                inner = cuts[np.searchsorted(cuts, s, "right") : np.searchsorted(cuts, e)]
                bitmaps.append(united([packed(part) for part in np.split(ordinal[s:e], inner - s)]))
            counts = [len(unpacked(b)) for b in bitmaps]
            return pa.RecordBatch.from_arrays([pa.array(site[group]), pa.array(line[group]), pa.array(chunk[group]), pa.array(bitmaps, pa.binary()), pa.array(counts, pa.int32())], names=["site", "line", "chunk", "bitmap", "documents"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(5)]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            new = np.concatenate([[True], np.logical_or.reduce([r[1:] != r[:-1] for r in rows])])  # a page may hold a line twice
            rows = [r[new] for r in rows]
            site, line, chunk = rows[:3]
            open_ = np.flatnonzero((site != site[-1]) | (line != line[-1]) | (chunk != chunk[-1]))
            end = int(open_[-1]) + 1 if len(open_) else 0
            held = [r[end:] for r in rows]
            if end:
                yield emit([r[:end] for r in rows])
        if held is not None:
            yield emit(held)

    order = ("site", "line", "chunk", "variant", "ordinal")
    placed = lines.select(*order).repartition("site", "line", "chunk").sortWithinPartitions(*order)
    return placed.mapInArrow(run, "site bigint, line bigint, chunk bigint, bitmap binary, documents int")


def looked_up(bitmaps: DataFrame) -> DataFrame:
    """(site, chunk, ordinal, gone): for each document that a bitmap holds, the lines of these bitmaps with their numbers of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [unpacked(b) for b in batch.column(4).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(p) for p in places])
            where = pa.array(np.concatenate(places).astype(np.int32) if places else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in (0, 1)), where, *(batch.column(i).take(pa.array(rows)) for i in (2, 3))], names=["site", "chunk", "ordinal", "line", "documents"])

    each = bitmaps.select("site", "chunk", "line", "documents", "bitmap").mapInArrow(run, "site bigint, chunk bigint, ordinal int, line bigint, documents bigint")
    return each.groupBy("site", "chunk", "ordinal").agg(F.map_from_entries(F.collect_list(F.struct("line", "documents"))).alias("gone"))  # at most the lines of one page


def repeated_lines(pages: DataFrame, urls: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, line_no, documents): lines found in at least ``least_documents`` pages and ``least_share`` of the site's pages.

    ``pages`` has id, url, text_content and updated_at, ``urls`` url and domain. Pages that are not
    registered, whose domain is blank or whose text is null or empty do not count; neither do empty lines. A
    line that a page holds twice counts once but is reported at both places. Null ids form one page; other
    columns are not read.
    """
    located = cut(line_hashes(pages).join(sites(urls), "url").select(F.xxhash64("site").alias("site"), "id", "lines"))  # hashed once
    kept = cut(numbered(located))
    enough = lambda n, d: (n >= least_documents) & (n >= least_share * d)
    lines = kept.select("site", "site_documents", "part", "chunk", "ordinal", F.explode("lines").alias("l")).select("site", "site_documents", "part", "chunk", "ordinal", "l.line", "l.variant")
    # a line that does not even occur often enough needs no bitmap
    often = lines.groupBy("site", "line").agg(F.count("*").alias("n"), F.first("site_documents").alias("site_documents")).where(enough(F.col("n"), F.col("site_documents")))
    often = cut(often.select("site", "line", "site_documents"))
    if often.count() <= BROADCAST_ROWS:
        candidates = lines.join(F.broadcast(often.select("site", "line")), ["site", "line"], "left_semi")
    else:  # a line may be in a large part of all pages: the parts of its site meet separately
        parts = F.greatest(F.lit(1), F.ceil(F.col("site_documents") / CHUNK_DOCUMENTS))
        candidates = lines.join(often.select("site", "line", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")), ["site", "line", "part"], "left_semi")
    bitmaps = cut(line_bitmaps(candidates))
    exact = bitmaps.groupBy("site", "line").agg(F.sum("documents").alias("documents")).join(often, ["site", "line"])
    repeated = exact.where(enough(F.col("documents"), F.col("site_documents"))).select("site", "line", "documents")
    marked = bitmaps.drop("documents").join(if_small(repeated, BROADCAST_ROWS), ["site", "line"])
    found = kept.select("site", "chunk", "ordinal", "id", "lines").join(looked_up(marked), ["site", "chunk", "ordinal"])
    gone = found.select("id", "gone", F.explode("lines").alias("l")).select("id", F.col("l.line_no").alias("line_no"), F.element_at("gone", F.col("l.line")).alias("documents"))
    return gone.where("documents is not null")


def without_lines(pages: DataFrame, found: DataFrame, id_column: str = "id", text_column: str = "text_content", order_column: str = "updated_at") -> DataFrame:
    """(id, text): each page's newest text without the lines of ``found``; null texts stay null."""
    current = newest(pages.select(F.col(id_column).cast("string").alias("id"), F.col(order_column).alias("__order"), F.col(text_column).alias("__text")), "id", "__order", "__text")
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("__gone"))  # at most the lines of one page
    kept = F.filter(F.split("__text", "\n", -1), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    return current.join(gone, "id", "left").select("id", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("text"))
