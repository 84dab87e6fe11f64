"""Near-duplicates, neighbours, repeated lines and mixing against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, neighbours, repeated, signatures

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def shingles(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold, least=1):
    sets = {i: s for i, t in rows.items() if t and len(s := shingles(t, k)) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def copies(rng, n, words, edits):
    """Texts in families of edited copies."""
    out = {}
    for i in range(n):
        base = out[f"{rng.randrange(i):03}"] if i and rng.random() < 0.6 else " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(20, 60)))
        parts = base.split()
        for _ in range(rng.randrange(edits)):
            parts[rng.randrange(len(parts))] = f"w{rng.randrange(words)}"
        out[f"{i:03}"] = " ".join(parts)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_pairs_equal_brute_force(spark, monkeypatch, small):
    if small:  # so small that groups are split into several trees
        monkeypatch.setattr(signatures, "TREE_RECORDS", 12)
        monkeypatch.setattr(signatures, "SMALL_GROUP", 3)
        monkeypatch.setattr(signatures, "CLASS_PART", 2)
    rng = random.Random(5)
    pages, facts = copies(rng, 150, 400, 9), copies(rng, 150, 40, 12)
    pages |= {"900": None, "901": "", "902": pages["003"], "903": pages["003"]}
    df = lambda rows: spark.createDataFrame([(i, t, NOW) for i, t in rows.items()], "id string, text string, order timestamp")
    specs = [(signatures.Collection("p", 3, 0.6, 15), df(pages)), (signatures.Collection("f", 1, 0.7), df(facts))]
    rows = signatures.similar_pairs(specs).collect()
    got = {(r.table_name, r.id_a, r.id_b) for r in rows}
    want = {("p", *x) for x in brute(pages, 3, 0.6, 15)} | {("f", *x) for x in brute(facts, 1, 0.7)}
    assert got == want and len(rows) == len(got) and len(want) > 100
    groups = signatures.similar_groups(specs).collect()
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for t, a, b in want:
        x, y = find((t, a)), find((t, b))
        parent[max(x, y)] = min(x, y)
    assert {(r.table_name, r.id, r.group_id) for r in groups} == {(t, i, find((t, i))[1]) for t, i in parent}
    degree = Counter((t, i) for t, a, b in want for i in (a, b))
    assert {(r.table_name, r.id): r.links for r in groups} == dict(degree)


def test_newest_row_of_a_record_counts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([("1", one, NOW), ("1", two, NOW + timedelta(days=1)), ("2", one, NOW), ("3", two, NOW), (None, two, NOW)], "id string, text string, order timestamp")
    assert [(r.id_a, r.id_b) for r in signatures.similar_pairs([(signatures.Collection("p", 1, 0.7), df)]).collect()] == [("1", "3")]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(6)
    families = [rng.choice(2**40, 60, replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([rng.choice(f, rng.integers(35, 60), replace=False), rng.choice(2**40, 5)])) for f in families for _ in range(9)]
    ends = np.cumsum([0] + [len(s) for s in sets])
    bits = signatures.bitmaps(np.concatenate(sets), ends)
    found = {(min(a, b), max(a, b)) for x, y in signatures.SignatureTree(np.diff(ends), bits, np.full(len(sets), 0.6)).pairs(most=200) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_tree_prunes_whole_nodes():
    rng = np.random.default_rng(7)
    n = 4000  # a route of 800 tokens, at each of which a few records meet
    group = np.sort(rng.integers(0, 800, n))
    sets = [rng.choice(2**40, rng.integers(20, 60)) for _ in range(n)]
    for i in range(0, n - 1, 50):
        if group[i] == group[i + 1]:
            sets[i + 1] = sets[i]
    ends = np.cumsum([0] + [len(s) for s in sets])
    tree = signatures.SignatureTree(np.diff(ends), signatures.bitmaps(np.concatenate(sets), ends), np.full(n, 0.7), group)
    left = sum(len(a) for a, _ in tree.pairs())
    assert len(tree.levels) >= 5 and left >= 50
    assert tree.tested.sum() < n * 20 and left < 0.1 * sum(c * (c - 1) / 2 for c in np.bincount(group))


def test_a_token_of_very_many_sets():
    """Ten thousand sets that share one token: sizes and bitmaps leave few of the 50 million pairs."""
    rng = np.random.default_rng(8)
    sets = [np.concatenate([[1], rng.integers(2, 2**40, rng.integers(20, 200))]) for _ in range(10_000)]
    ends = np.cumsum([0] + [len(s) for s in sets])
    tree = signatures.SignatureTree(np.diff(ends), signatures.bitmaps(np.concatenate(sets), ends), np.full(len(sets), 0.7))
    assert sum(len(a) for a, _ in tree.pairs()) < 1000 and tree.tested.sum() < 25_000_000


def test_very_many_copies_are_one_class(spark):
    text, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(19))
    df = spark.range(30_000).selectExpr("cast(id as string) id", f"if(id = 7, '{other}', '{text}') text").withColumn("order", F.lit(NOW))
    rows = signatures.similar_groups([(signatures.Collection("p", 1, 0.7), df)])
    assert {tuple(r) for r in rows.groupBy("group_id", "links").count().collect()} == {("0", 29_999, 30_000)}


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 2**48, 1000))
    assert (signatures.unpacked(signatures.packed(x)) == x).all() and len(signatures.packed(x)) == 6000 and len(signatures.unpacked(b"")) == 0


@pytest.mark.parametrize("block", [4096, 40, 11])
def test_neighbours_equal_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(15, 16))
    x = (centres[rng.integers(0, 15, 240)] + 0.3 * rng.normal(size=(240, 16))).astype(np.float32)
    x[7] = x[8] = x[9] * 2  # ties
    kinds = ["memory" if i % 4 else "search" for i in range(240)]
    df = spark.createDataFrame([(kinds[i], f"{i:03}", x[i].tolist()) for i in range(240)], "owner_kind string, id string, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, 5).collect():
        got[r.owner_kind, r.id].append((-r.similarity, r.neighbour))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in range(240):
        want = sorted((-round(float(u[i] @ u[j]), 6), f"{j:03}") for j in range(240) if j != i and kinds[j] == kinds[i])[:5]
        assert [n for _, n in sorted(got[kinds[i], f"{i:03}"])] == [n for _, n in want]
    pairs = neighbours.neighbour_pairs(neighbours.nearest(df, 5)).collect()
    assert len(pairs) == len(set(pairs)) and all(r.id_a < r.id_b for r in pairs)


def test_a_third_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[:300] = x[0]
    df = spark.createDataFrame([("m", f"{i:04}", v.tolist()) for i, v in enumerate(x)], "owner_kind string, id string, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, 5).collect():
        got[r.id].append(r.neighbour)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 900
    assert sorted(got["0007"]) == ["0000", "0001", "0002", "0003", "0004"] and sorted(got["0002"]) == ["0000", "0001", "0003", "0004", "0005"]


def test_few_vectors(spark):
    df = spark.createDataFrame([("m", "a", [1.0, 0.0]), ("m", "b", [0.0, 1.0]), ("s", "c", [1.0, 0.0])], "owner_kind string, id string, embedding array<float>")
    assert sorted((r.id, r.neighbour) for r in neighbours.nearest(df, 5).collect()) == [("a", "b"), ("b", "a")]


def test_repeated_lines_equal_counting(spark, monkeypatch):
    monkeypatch.setattr(repeated, "CHUNK_DOCUMENTS", 7)
    rng = random.Random(9)
    pages, urls = [], []
    for i in range(60):
        site = ["Big.example", "small.example", " "][0 if i < 40 else 1 if i < 55 else 2]
        lines = [rng.choice(["Share  this", " share this ", "SHARE THIS", ""]), f"only {i}", rng.choice(["Legal", "other"]), ""]
        pages.append((f"{i:02}", f"u{i}", None if i == 3 else "\n".join(lines + (["Legal"] if i % 9 == 0 else [])), NOW))
        urls += [(f"u{i}", site)] * (1 + i % 2)
    found = repeated.repeated_lines(spark.createDataFrame(pages + pages[:9], "id string, url string, text_content string, updated_at timestamp"), spark.createDataFrame(urls, "url string, domain string"))
    norm = lambda s: re.sub(" +", " ", s.lower()).strip(" ")
    docs, where = defaultdict(set), []
    for id_, url, text, _ in pages:
        site = dict(urls)[url].lower()
        for n, line in enumerate(text.split("\n")) if text is not None and site.strip() else ():
            if norm(line):
                docs[site, norm(line)].add(id_)
                where.append((site, norm(line), id_, n))
    size = Counter({s: len({i for (t, _), ids in docs.items() if t == s for i in ids}) for s in {x[0] for x in docs}})
    want = {(i, n) for s, line, i, n in where if len(docs[s, line]) >= 5 and len(docs[s, line]) >= 0.2 * size[s]}
    rows = found.collect()
    assert {(r.id, r.line_no) for r in rows} == want and len(rows) == len(want) > 50


@pytest.mark.parametrize("places", [[0], [5, 9, 32_767], list(range(100, 9000)), list(range(0, 32_768, 3)), [1, 2, 3, 4, 5, 6, 9]])
def test_bitmaps_are_compressed_and_exact(places):
    bitmap = repeated.packed(np.array(places))
    assert repeated.unpacked(bitmap).tolist() == places and len(bitmap) <= min(4097, 1 + 2 * len(places))
    other = np.arange(0, 32_768, 7)
    assert repeated.unpacked(repeated.united([bitmap, repeated.packed(other), bitmap])).tolist() == sorted(set(places) | set(other.tolist()))


def test_the_lookup_decides(spark, monkeypatch):
    pages = spark.createDataFrame([(f"{i}", f"u{i}", f"same\nonly {i}", NOW) for i in range(8)], "id string, url string, text_content string, updated_at timestamp")
    urls = spark.createDataFrame([(f"u{i}", "a.example") for i in range(8)], "url string, domain string")
    assert {(r.id, r.line_no) for r in repeated.repeated_lines(pages, urls).collect()} == {(f"{i}", 0) for i in range(8)}
    whole = repeated.looked_up
    monkeypatch.setattr(repeated, "looked_up", lambda bitmaps: whole(bitmaps).where("ordinal < 3"))
    assert repeated.repeated_lines(pages, urls).count() == 3


def test_salted_sites_and_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(f"{i}", f"u{i}", f"same\nonly {i}\nSAME", NOW) for i in range(50)], "id string, url string, text_content string, updated_at timestamp")
    urls = spark.createDataFrame([(f"u{i}", "a.example" if i < 40 else "b.example") for i in range(50)], "url string, domain string")
    monkeypatch.setattr(repeated, "CHUNK_DOCUMENTS", 6)
    want = {tuple(r) for r in repeated.repeated_lines(pages, urls).collect()}
    monkeypatch.setattr(repeated, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in repeated.repeated_lines(pages, urls).collect()} == want and len(want) == 100


def test_repeated_rows_and_null_ids_are_counted_once_each(spark):
    from quern.llm import tokens

    rows = [(1, "one two", "a"), (1, "one two", "a"), (None, "three", "b"), (None, None, None)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", carried=("source",)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 2), (1, "a", 2), (None, "b", 1), (None, None, 0)], key=str)


def test_mix_meets_targets(spark):
    rng = random.Random(10)
    rows = [(i, "big" if i % 10 else "tiny", rng.randrange(1, 200)) for i in range(2000)] + [(9000, None, 5), (9001, "unknown", 5), (9002, "big", 0), (9003, "big", None)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.7, 1), ("tiny", 0.3, 2), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets)
    got = mixed.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and 0 <= got[0].position and got[-1].position <= 1
    assert len({(r.doc_id, r["copy"]) for r in got}) == len(got) and max(Counter(r.doc_id for r in got).values()) <= 2
    shares = {r.source: r for r in mixing.shares(mixed, sized, targets).collect()}
    assert shares["big"].reached_share == pytest.approx(0.7, abs=0.002) and shares["absent"].uses == 0
    tiny = sum(n for _, s, n in rows if s == "tiny")
    assert shares["tiny"].tokens == 2 * tiny and shares["tiny"].max_uses == 2  # runs out below its share
    # the curriculum: a source with the smaller share comes later on average
    mean = lambda s: np.mean([r.position for r in got if r.source == s])
    assert mean("tiny") > mean("big")
    flat = mixing.mix(sized, targets, schedule=mixing.piecewise_schedule(spark, {"big": [(0, 1.0), (0.5, 1.0), (1, 0.0)], "tiny": [(0, 0.0), (1, 1.0)]})).collect()
    assert all(0 <= r.position <= 1 for r in flat) and len(flat) == len(got)
    first = sum(r.n_tokens for r in flat if r.source == "big" and r.position < 0.5) / sum(r.n_tokens for r in flat if r.source == "big")
    assert first == pytest.approx(2 / 3, abs=0.02)
