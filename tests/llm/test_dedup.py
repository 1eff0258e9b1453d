"""Exact and near deduplication, repeated passages: against brute force, with edge cases."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfield.llm import exact_dedup, near_dedup, phrase_dedup
from tarnfield.llm.graph import connected_components

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "no id here at all"), (None, None), (4, "one two")]


def frame(spark, data, schema="doc_id bigint, text string"):
    return spark.createDataFrame(data, schema)


def corpus(seed=1, n=60):
    """Random texts with exact copies, edited copies and shared passages."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(1, 120))] for _ in range(n // 3)]
    shared = [r.choice(words) for _ in range(30)]
    out = []
    for k in range(n):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.3:
            at = r.randrange(len(text) + 1)
            text[at:at] = shared[r.randrange(10) :]
        out.append((k, r.choice([" ", "\n", "  "]).join(text)))
    return out


def test_exact_groups_against_brute_force(spark):
    data = corpus()
    out = {r.doc_id: r for r in exact_dedup.DigestIndex(spark, buckets=4).add(frame(spark, data)).collect()}
    groups = {}
    for i, t in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), []).append(i)
    assert len(out) == len(data)
    for text, ids in groups.items():
        for i in ids:
            assert (out[i].keep_id, out[i].group_size, out[i].kept) == (min(ids), len(ids), i == min(ids))
            assert bytes(out[i].digest).hex() == hashlib.sha256(text.encode()).hexdigest()


def test_index_outlives_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.add(frame(spark, [(1, "a  b"), (2, "a\nb"), (3, "c")]))
    assert first.where("kept").count() == 2
    again = {r.doc_id: r for r in exact_dedup.DigestIndex(spark, index.table, 4).add(frame(spark, [(7, "a b"), (8, "d"), (9, "d")])).collect()}
    assert (again[7].keep_id, again[7].kept) == (1, False)
    assert (again[8].kept, again[9].keep_id, again[9].group_size) == (True, 8, 2)
    assert index.read().count() == 3
    assert "bucket" in spark.sql(f"DESCRIBE EXTENDED {index.table}").toPandas().to_string().lower()


def test_index_by_path_outlives_the_catalog(spark, tmp_path):
    first = exact_dedup.DigestIndex(spark, buckets=4, path=f"file://{tmp_path}/index")
    first.add(frame(spark, [(1, "a b"), (2, "c")]))
    spark.sql(f"DROP TABLE {first.table}")  # as when the session ends; the files stay
    again = exact_dedup.DigestIndex(spark, buckets=4, path=f"file://{tmp_path}/index")
    assert [(r.doc_id, r.keep_id, r.kept) for r in sorted(again.add(frame(spark, [(7, "a  b"), (8, "d")])).collect())] == [(7, 1, False), (8, 8, True)]
    assert again.read().count() == 3
    again.drop()
    assert not spark.catalog.tableExists(again.table) and not (tmp_path / "index" / "4-buckets").exists()


def test_exact_edge_cases(spark):
    before = {t.name for t in spark.catalog.listTables()}
    index = exact_dedup.DigestIndex(spark, buckets=2)
    out = index.add(frame(spark, EDGES).withColumn("digest", F.lit("clash")).withColumn("extra", F.lit(1)))
    index.drop()
    # a null text is the empty one; rows without an id stay where their group has none, and keep no other
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 4, 3, True), (4, 4, 3, True), (5, 4, 3, False), (None, None, 1, True), (None, 1, 3, False)], key=repr)
    assert out.columns == ["doc_id", "extra", "digest", "keep_id", "group_size", "kept"]
    kept = exact_dedup.deduplicate(frame(spark, EDGES).withColumns({"digest": F.lit("own"), "_ID": F.lit(3)}))
    assert kept.columns == ["doc_id", "text", "digest", "_ID"] and {r.digest for r in kept.collect()} == {"own"}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([EDGES[0], EDGES[2], EDGES[3], EDGES[3], EDGES[5]], key=repr)
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == before  # temporary indexes are gone


def test_heavy_group_is_whole(spark):
    data = [(k, "the same text" if k % 3 else f"text {k}") for k in range(9000)]
    out = exact_dedup.DigestIndex(spark, buckets=2).add(frame(spark, data))
    assert out.count() == 9000 and out.where("group_size = 6000").count() == 6000 and out.where("kept").count() == 3001


def brute_components(data, width=5, percent=85):
    sets = {}
    for i, t in data:
        w = tuple((t or "").lower().split())
        sets[i] = {w[k : k + width] for k in range(len(w) - width + 1)} if len(w) >= width else ({w} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [85, 50])
def test_near_components_against_brute_force(spark, percent):
    data = corpus(3, 120)
    out = near_dedup.near_duplicates(frame(spark, data), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(data, percent=percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_bands_follow_the_threshold():
    for percent in range(30, 101):
        rows, bands = near_dedup.bands_for(percent)
        assert rows * bands <= near_dedup.VALUES and (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS
    with pytest.raises(ValueError, match="too low"):
        near_dedup.bands_for(5)


def variants(n, seed=5, most=6):
    """Edited copies of one text, of which not all are linked."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    for k in range(n):
        t = list(base)
        for _ in range(r.randint(0, most)):
            t[r.randrange(len(t))] = f"x{r.randrange(40)}"
        yield k, " ".join(t)


@pytest.mark.parametrize("nodes", [8, 1024])
def test_near_group_of_many_variants(spark, monkeypatch, nodes):
    """In blocks of a few rows, too: what one block leaves open is found by visits to the others."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    data = list(variants(120))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(frame(spark, data)).collect()}
    assert got == brute_components(data)


def test_blocks_hand_on_forests():
    data = list(variants(80))
    rows = [(0, k, k, False, t) for k, t in data]
    found = near_dedup._block_links(5, 85)(iter([pa.RecordBatch.from_pylist([dict(zip("kncvt", r, strict=True)) for r in rows])]))
    links = [x for b in found for x in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True)]
    components = {c for _, c in brute_components(data).values()}
    assert len(links) == len(data) - len(components) and all(u > v for u, v in links)


def test_near_edge_cases(spark):
    data = [*EDGES, (10, "x " * 60_000), (11, "x " * 60_000)]
    out = near_dedup.near_duplicates(frame(spark, data).withColumn("n_shingles", F.lit(7)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect() if r.doc_id is not None}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (10, 1, 10), (11, 1, 10)}
    assert out.count() == len(data)
    kept = near_dedup.keep_representatives(frame(spark, data))
    assert kept.columns == ["doc_id", "text"] and kept.where("doc_id is null").count() == 2 and kept.where("doc_id in (5, 11)").count() == 0
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert out == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_passages(data, window=13):
    words = {k: (t or "").encode().split() for k, (_, t) in enumerate(data)}
    first = {}
    for k, w in words.items():
        if data[k][0] is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(first.get(key, data[k][0]), data[k][0])
    out = []
    for k, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if data[k][0] is not None and first[tuple(w[a : a + window])] < data[k][0]:
                gone[a : a + window] = [True] * window
        out.append((data[k][0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "group"), [(1, 16_384), (2, 1), (3, 3)])
def test_passages_against_brute_force(spark, rows, monkeypatch, seed, group):
    monkeypatch.setattr(phrase_dedup, "GROUP", group)  # no anchor is dealt out, all with two segments are, some are
    data = corpus(seed, 90)
    clash = frame(spark, data).withColumns({"_id": F.lit(1), "_TEXT": F.lit("x"), "_print": F.lit(2)})
    out = phrase_dedup.remove_repeated_passages(clash)
    assert out.columns == ["doc_id", "_id", "_TEXT", "_print", "n_words", "n_removed", "kept_text"]
    assert rows(out.drop("_id", "_TEXT", "_print")) == brute_passages(data)


def test_shard_joins_windows_into_passages():
    texts = [b"a b c d e f g", b"x b c d e f y", b"b c d"]
    shard = phrase_dedup._Shard([(t, bytes([k]), k, k, 1, 0) for k, t in enumerate(texts)], 3)
    n = {w: k for k, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"x", b"y"])}
    assert shard.passages() == {tuple(n[w] for w in p.split()): 0 for p in (b"b c d e f", b"b c d")}
    assert dict(shard.locate()) == {b"\x01": [(1, 5, 0)], b"\x02": [(0, 3, 0)]}


def test_passages_edge_cases(spark, rows):
    long = " ".join(f"v{k % 977}" for k in range(50_000))
    same = " ".join(f"t{k}" for k in range(20))
    ties = "a a a a a a a a a a a a a a a a a"
    data = [*EDGES, (20, long), (21, f"begin {long} end"), (22, same), (22, same), (23, ties), (24, f"b {ties} c"), (25, same + " é—x"), (26, None), (None, same), (None, same)]
    assert rows(phrase_dedup.remove_repeated_passages(frame(spark, data).withColumn("n_words", F.lit(0)))) == brute_passages(data)
    assert phrase_dedup.remove_repeated_passages(frame(spark, [])).count() == 0


def test_long_words_are_hashed_whole(spark):
    """Words that differ by exchanged blocks of 4,096 bytes are different words, for near copies and for passages."""
    r = random.Random(8)
    a, b = ("".join(r.choice("abcdefghij") for _ in range(4096)) for _ in range(2))
    near = near_dedup.near_duplicates(frame(spark, [(1, a + b), (2, b + a), (3, a + b)])).collect()
    assert sorted((x.doc_id, x.component_id) for x in near) == [(1, 1), (2, 2), (3, 1)]
    same = " ".join(f"w{k}" for k in range(12))
    data = frame(spark, [(1, f"{same} {a + b}"), (2, f"{same} {b + a}"), (3, f"x {same} {a + b}")])
    assert sorted((x.doc_id, x.n_removed) for x in phrase_dedup.remove_repeated_passages(data).collect()) == [(1, 0), (2, 0), (3, 13)]
