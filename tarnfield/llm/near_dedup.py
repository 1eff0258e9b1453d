"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so half the
permutations serve a signature. Bands of values form buckets; links are confirmed on full shingle sets.

No bucket is expanded into its pairs. Documents with equal sets are one node.

1. Every node is compared with the smallest node of each of its buckets; components of the confirmed links follow.
2. Buckets that still hold several components are dealt out in blocks of bounded size. In a block, nodes of different
   components are compared on their full sets, and components merge as links are found, so that a block hands on a
   spanning forest of its links: fewer rows than it has nodes.
3. In buckets of several blocks that still hold several components, the nodes outside the bucket's largest component
   visit the other blocks. This compares all that is left: nothing within a bucket is estimated or cut off.

Only banding can lose a link: see ``bands_for``.

Edge cases: null, empty and blank texts have no shingles and stand alone; with fewer words than ``width`` the whole
sequence is the one shingle; rows that repeat an id are one document, linked by any of its texts; rows without
an id are not linked unless their set is another's; an empty table gives an empty result; very long texts are hashed
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import join_groups, stage, text_or_empty, unstage
from tarnfield.llm.graph import connected_components
from tarnfield.llm.words import portions, shingle_hashes, words_of

MISS = 1e-6  #: a pair just at the threshold shares no band with at most this probability
VALUES = 128  #: most signature values
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000  #: of one block of a bucket
UNITE_ROUNDS = 3  #: links of a block are sought from so many nodes first, before components are told apart


def bands_for(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands of which at most VALUES values give a miss probability of MISS.

    A pair of similarity t shares a given band with probability t ** rows, and none of them with
    (1 - t ** rows) ** bands. The values of a band come from different permutations.
    """
    fits = []
    for rows in range(1, 20):
        bands = int(np.ceil(np.log(MISS) / np.log1p(-min((percent / 100) ** rows, 1 - 1e-9))))
        bands += bands % 2  # half of them are of minima, half of maxima
        if rows * bands <= VALUES:
            fits.append((rows, bands))
    if not fits:
        raise ValueError(f"a similarity of {percent} % is too low for {VALUES} signature values")
    return fits[-1]


def _signatures(width: int, rows: int, bands: int):
    permutations = rows * bands // 2
    rng = np.random.default_rng(7)
    factors = (rng.integers(0, 2**32, permutations, dtype=np.uint32) | np.uint32(1))[:, None]
    shifts = rng.integers(0, 2**32, permutations, dtype=np.uint32)[:, None]

    def sign(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        words = words_of(texts)
        out: tuple[list, ...] = ([], [], [])
        for first, last in zip(words.bounds, words.bounds[1:], strict=False):
            s = np.unique(shingle_hashes(words.hashes[first:last], width))
            if not len(s):
                for to, x in zip(out, (0, None, None), strict=True):
                    to.append(x)
                continue
            x = (s >> np.uint64(32)).astype(np.uint32)
            low, high = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
            for at in range(0, len(x), 4096):
                p = x[at : at + 4096] * factors + shifts
                low, high = np.minimum(low, p.min(1)), np.maximum(high, p.max(1))
            values = np.concatenate([low, high]).reshape(bands, rows)
            out[0].append(len(s))
            out[1].append(xxhash.xxh3_128_digest(s.tobytes()))
            out[2].append([xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) - 2**63 for k, r in enumerate(values)])
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["id", "n_shingles", "digest", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in portions(b, 1):
                yield sign(part, [t.lower() for t in texts])

    return run

def _shingles(text: bytes, width: int) -> set:
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, theirs = None, set()
        for b in batches:
            u, v = (b.column(k).to_pylist() for k in (0, 1))
            x, y = (b.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            keep = []
            for k in range(len(u)):
                if v[k] != last:
                    last, theirs = v[k], _shingles(y[k], width)
                own = _shingles(x[k], width)
                both = len(own & theirs)
                keep.append(100 * both >= percent * (len(own) + len(theirs) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (u, v) whose full shingle sets reach the threshold."""
    own = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("x")).hint("merge"), "u")
    both = own.join(texts.select(F.col("id").alias("v"), F.col("text").alias("y")).hint("merge"), "v")
    return both.select("u", "v", "x", "y").mapInArrow(_confirm(width, percent), "u bigint, v bigint")


class _Block:
    """Nodes of a bucket, or a part of one: their sets as numbers, and components that merge as links are found."""

    def __init__(self, nodes: list[int], comps: list[int], texts: list[bytes], width: int, percent: int):
        self.nodes, self.percent = np.array(nodes, np.int64), percent
        self.comps = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
        sets: list[np.ndarray] = []
        low = 0
        while low < len(texts):  # words of a few texts at a time
            high, size = low, 0
            while high < len(texts) and (high == low or size < 1_000_000):
                size += len(texts[high])
                high += 1
            words = words_of([t.lower() for t in texts[low:high]])
            sets += [np.unique(shingle_hashes(words.hashes[a:z], width)) for a, z in zip(words.bounds, words.bounds[1:], strict=False)]
            low = high
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.held = np.zeros(int(self.flat.max()) + 1, bool)
        self.links: list[tuple[int, int]] = []

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link node ``i`` with each component of ``others`` of which a node reaches the threshold."""
        others = others[self.comps[others] != self.comps[i]]
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[100 * small >= self.percent * large]
        if not len(others):
            return
        own = self.flat[self.at[i] : self.at[i] + self.sizes[i]]
        self.held[own] = True
        sizes = self.sizes[others]
        if 3 * len(others) > len(self.nodes):  # cheaper to look through all
            both = np.add.reduceat(self.held[self.flat], self.at, dtype=np.int64)[others]
        else:
            begins = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) + np.repeat(self.at[others] - begins, sizes)
            both = np.add.reduceat(self.held[self.flat[place]], begins, dtype=np.int64)
        self.held[own] = False
        for j in others[100 * both >= self.percent * (sizes + self.sizes[i] - both)]:
            if self.comps[j] != self.comps[i]:
                self.links.append((int(self.nodes[i]), int(self.nodes[j])))
                self.comps[self.comps == self.comps[j]] = self.comps[i]


def _block_links(width: int, percent: int):
    """A spanning forest of the links between different components in each block: (u, v), fewer than nodes."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        block = _Block([r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows], width, percent)
        every, visits = np.arange(len(rows)), np.array([r[3] for r in rows], bool)
        if visits.any():
            own = every[~visits]
            for i in every[visits]:
                block.compare(i, own)
            return block.links
        for i in every[:UNITE_ROUNDS]:
            block.compare(i, every)
        # nodes of the largest component are met from the other side
        outside = every[block.comps != np.bincount(block.comps).argmax()]
        for i in outside:
            block.compare(i, every)
        return block.links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        found: list[tuple[int, int]] = []
        for b in batches:
            columns = [b.column(k) for k in range(b.num_columns)]
            for r in zip(*(c.to_pylist() for c in columns[:4]), columns[4].cast(pa.binary()).to_pylist(), strict=True):
                if r[0] != key:
                    found += links(rows) if len(rows) > 1 else []
                    key, rows = r[0], []
                rows.append(r)
            yield _edges(found)
            found = []
        yield _edges(links(rows) if len(rows) > 1 else [])

    return run


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(x) for x in links], pa.int64()), pa.array([min(x) for x in links], pa.int64())], ["u", "v"])


def _dealt(rows: DataFrame, key: Column, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The forests of the blocks that ``key`` tells apart. ``rows``: node, comp, visits and what ``key`` needs."""
    rows = rows.select(key.alias("key"), "node", "comp", "visits").join(texts.withColumnRenamed("id", "node").hint("merge"), "node")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_block_links(width, percent), "u bigint, v bigint")


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """``members`` with their component, of the buckets that hold several; each with the bucket's number of blocks and largest component."""
    at = members.join(components.withColumnRenamed("component", "_c"), "node", "left").withColumn("comp", F.coalesce("_c", "node")).drop("_c")
    parts = at.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_NODES), F.ceil(F.sum("s") / BLOCK_SHINGLES)).cast("int")
    mixed = parts.groupBy("band").agg(F.count(F.lit(1)).alias("_comps"), F.sum("n").alias("_n"), blocks.alias("blocks"), F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    # the hub of a bucket of two has been compared with the other
    return at.join(mixed.where("_comps > 1 and _n > 2").select("band", "blocks", "largest"), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _rest_of_links(members: DataFrame, texts: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of all links: those of ``links``, and those found inside buckets that these leave with several components."""
    first = stage(connected_components(links), "components")
    inside = stage(_dealt(_mixed(members, first).withColumn("visits", F.lit(False)), F.xxhash64("band", "block"), texts, width, percent), "block-links")
    if inside.isEmpty():
        return first
    links = links.unionByName(inside)
    second = stage(connected_components(links), "components")
    wide = stage(_mixed(members, second).where("blocks > 1"), "wide-buckets")
    if wide.isEmpty():
        return second
    # those outside the largest component visit every block but their own, in groups that fit a task
    outside = F.col("comp") != F.col("largest")
    groups = wide.groupBy("band").agg(F.greatest(F.ceil(F.count_if(outside) / BLOCK_NODES), F.ceil(F.sum(F.when(outside, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int").alias("groups"))
    wide = wide.join(groups, "band").withColumn("group", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int"))
    at_home = wide.withColumns({"visits": F.lit(False), "group": F.explode(F.sequence(F.lit(0), F.col("groups") - 1))})
    away = wide.where(outside).withColumns({"visits": F.lit(True), "_to": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    away = away.where("_to <> block").withColumn("block", F.col("_to")).select(at_home.columns)
    across = stage(_dealt(at_home.unionByName(away), F.xxhash64("band", "block", "group"), texts, width, percent), "block-links")
    return second if across.isEmpty() else stage(connected_components(links.unionByName(across)), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """All documents with n_shingles, component_id (smallest id reachable by links) and kept.

    Two documents are linked if their sets of ``width``-word shingles, A-Z lower-cased, have a Jaccard similarity of
    ``percent`` / 100 or more.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    signed = stage(plain.mapInArrow(_signatures(width, *bands_for(percent)), "id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "signatures")
    sets = stage(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size")), "shingle-sets")
    total = signed.count()
    nodes = signed.where("digest is not null").join(sets.select(F.col("node").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "node")
    members = stage(nodes.select("node", "n_shingles", F.explode("bands").alias("band")), "bands")
    hubs = members.groupBy("band").agg(F.min(F.struct("node", "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub.*").withColumnsRenamed({"node": "v", "n_shingles": "_m"})
    shared = stage(members.join(hubs, "band"), "shared-buckets")  # a bucket of one node links nothing
    unstage(members)
    fits = f"u > v and 100 * least(n_shingles, _m) >= {percent} * greatest(n_shingles, _m)"
    pairs = stage(shared.withColumnRenamed("node", "u").where(fits).select("u", "v").distinct(), "hub-pairs")
    texts = stage(plain.join(shared.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi"), "shared-texts")
    links = stage(_confirmed(pairs, texts, width, percent), "links")
    classes = _rest_of_links(shared.select("node", "n_shingles", "band"), texts, links, width, percent)
    labelled = stage(sets.join(classes, "node", "left").select("digest", "size", F.coalesce("component", "node").alias("component_id")), "classes")
    unstage(shared, pairs, texts, links, sets)
    out = join_groups(signed.select("id", "n_shingles", "digest"), labelled, "digest", "size", total)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document stays: one of each group of near-duplicates, the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).where("not kept").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
