"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts are neighbours. Splitters that cut this order into shards of
near equal bytes are found by probing: each round counts, in every partition, the exact bytes and rows below candidate
keys, and narrows the bracket of each splitter. Only then does the data move, in one exchange.

A splitter is first sought between hash values, which keeps a group of equal texts in one shard; only where a group is
too large to meet the tolerance do probes go on among the ids inside it.

Edge cases: a null text weighs ``overhead`` bytes only; a null id sorts first; an empty table gives an empty result; fewer rows than shards
leave shards empty; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnfield.llm.common import free_names, stage, text_or_empty, unstage

LOW, HIGH = -(2**63), 2**63 - 1
PART_BYTES = 64_000_000  #: of a part of a shard, which one task sorts
SMALL = 100_000  #: parts whose places go out by broadcast; more are joined by a shuffle
INTERNAL = {"_id", "_hash", "_shard", "_part", "_splits", "_first", "_before", "_split", "_at"}


def _histogram(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with (hash, id) below each probe. Moves one row per task and probe."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids = (np.array([p[i] for p in probes], np.int64) for i in (0, 1))
        held = np.zeros((2, len(probes) + 1), np.int64)
        for b in batches:
            h, i, size = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = np.searchsorted(hashes, h, "left")
            right = np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(at != right):  # rows whose hash is a probe's: compare ids
                at[k] += np.searchsorted(ids[at[k] : right[k]], i[k], "right")
            # np.add.at keeps whole numbers; bincount's weights would be floats
            np.add.at(held[0], at, size)
            held[1] += np.bincount(at, minlength=len(probes) + 1)
        slots = np.flatnonzero(held[1])
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held[0][slots]), pa.array(held[1][slots])], ["slot", "n_bytes", "n_rows"])

    counted = keys.mapInArrow(count, "slot bigint, n_bytes bigint, n_rows bigint").groupBy("slot").agg(F.sum("n_bytes"), F.sum("n_rows")).collect()
    below = np.zeros((2, len(probes) + 1), np.int64)
    for slot, size, n in counted:  # len(probes) + 1 rows
        below[:, slot] = size, n
    return tuple(np.cumsum(below, axis=1)[:, :-1])


def _spread(low: int, high: int, n: int) -> list[int]:
    """Up to n values strictly between low and high, evenly spaced."""
    return sorted({low + (high - low) * k // (n + 1) for k in range(1, n + 1)} - {low, high})


def find_splitters(keys: DataFrame, parts: int, strict_every: int = 1, tolerance: float = 0.005, probes: int = 63) -> tuple[list[tuple[int, int]], list[int]]:
    """(splitters, rows below each) that cut ``keys`` (hash, id, size) into ``parts`` of near equal size.

    Every ``strict_every``-th splitter must come within ``tolerance`` of a strict part's size, or be the nearest cut
    between two rows; those between them may be off by a quarter of a part.
    """
    total, first, last = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    ids = lambda low, high: _spread(max(low, first - 1), min(high, last + 1), probes)
    goals = [total * k // parts for k in range(1, parts)]
    slack = [total / parts * strict_every * tolerance if k % strict_every == 0 else total / parts / 4 for k in range(1, parts)]
    # bracket of each goal: keys low and high with bytes and rows below each
    low = [(LOW, LOW, 0, 0)] * len(goals)
    high = [(HIGH, HIGH, total, None)] * len(goals)
    done: list[tuple | None] = [None] * len(goals)
    while not all(done):
        asked: dict[int, list[tuple[int, int]]] = {}
        for k, end in enumerate(done):
            if end:
                continue
            a, b = low[k], high[k]
            if b[0] - a[0] > 1:
                asked[k] = [(h, LOW) for h in _spread(a[0], b[0], probes)]
            elif b[0] - a[0] == 1 and b[1] == LOW:  # the rows of one hash: go on among their ids
                asked[k] = [(a[0], i) for i in ids(a[1], HIGH)]
            else:
                asked[k] = [(a[0], i) for i in ids(a[1], b[1])]
        points = sorted({p for ps in asked.values() for p in ps} | {(HIGH, HIGH)})
        sizes, rows = _histogram(keys, points)
        known = [(h, i, int(s), int(n)) for (h, i), s, n in zip(points, sizes, rows, strict=True)]
        for k in asked:
            goal, a, b = goals[k], low[k], high[k]
            inside = [p for p in known if a[:2] < p[:2] < b[:2]]
            a = max([a, *(p for p in inside if p[2] <= goal)], key=lambda p: p[:2])
            b = min([b, *(p for p in inside if p[2] > goal)], key=lambda p: p[:2])
            b = b if b[3] is not None else (*b[:3], known[-1][3])
            low[k], high[k] = a, b
            best = min((a, b), key=lambda p: abs(p[2] - goal))
            # all that is left to ask lies among the ids of one hash, and there are no ids between
            narrow = b[0] - a[0] <= 1 and not ids(a[1], b[1] if b[0] == a[0] else HIGH)
            if abs(best[2] - goal) <= slack[k] or narrow or b[3] - a[3] <= 1:
                done[k] = best
    return [p[:2] for p in done], [p[3] for p in done]


def _within(shard: Column, cuts: list[tuple[int, int]], parts: list[int]) -> Column:
    """Number of a row's part in its shard: even stretches of the shard's hashes, or of its ids where it holds but one hash."""
    ends = [(LOW, LOW), *cuts, (HIGH, HIGH)]
    spans = [(0, a[0], z[0]) if z[0] > a[0] else (1, a[1], z[1]) for a, z in zip(ends, ends[1:], strict=False)]
    of = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), shard)
    value = F.when(of(k for k, _, _ in spans) == 0, F.col("_hash")).otherwise(F.col("_id")).cast("double")
    low, width = of(a for _, a, _ in spans), of(float(z) - float(a) + 1.0 for _, a, z in spans)
    return F.least(of(parts) - 1, F.floor((value - low) / width * of(parts))).cast("int")


def _layout(keys: DataFrame, shards: int, tolerance: float) -> tuple[Column, Column, DataFrame, int]:
    """The shard and part of a row, as columns; where each part lies (shard, part, splits, first partition, rows before); partitions of a shard."""
    cuts, _ = find_splitters(keys, shards, 1, tolerance)
    key = F.struct(F.col("_hash").alias("h"), F.col("_id").alias("i"))
    literal = F.array(*[F.struct(F.lit(h).cast("bigint").alias("h"), F.lit(i).cast("bigint").alias("i")) for h, i in cuts])
    shard = F.size(F.filter(literal, lambda cut: cut <= key)) if cuts else F.lit(0)
    keys = keys.withColumnsRenamed({"hash": "_hash", "id": "_id"}).withColumn("_shard", shard)
    held = {r._shard: r.n for r in keys.groupBy("_shard").agg(F.sum("size").alias("n")).collect()}  # one row a shard
    part = _within(shard, cuts, [max(1, -(-held.get(k, 0) // PART_BYTES)) for k in range(shards)])
    keys = keys.withColumn("_part", part)
    # a text that fills a part by itself is split by a hash of its ids
    sizes = keys.groupBy("_shard", "_part").agg(F.sum("size").alias("n"))
    sizes = sizes.withColumn("_splits", F.when(F.col("n") > 2 * PART_BYTES, F.ceil(F.col("n") / PART_BYTES)).otherwise(F.lit(1)).cast("int"))
    order = W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stage(sizes.select("_shard", "_part", "_splits", F.coalesce(F.sum("_splits").over(order), F.lit(0)).cast("int").alias("_first")), "shard-parts")
    small = sizes.count() <= SMALL
    split = keys.join(F.broadcast(sizes) if small else sizes, ["_shard", "_part"]).groupBy("_shard", "_part", _split().alias("_split")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("_shard").orderBy("_part", "_split").rowsBetween(W.unboundedPreceding, -1)
    before = split.select("_shard", "_part", F.struct("_split", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n")).alias("x")).groupBy("_shard", "_part").agg(F.map_from_entries(F.collect_list("x")).alias("_before"))
    layout = stage(sizes.join(before, ["_shard", "_part"]), "shard-layout")
    most = layout.agg(F.max(F.col("_first") + F.col("_splits"))).first()[0] or 1
    return shard, part, F.broadcast(layout) if small else layout, most


def _split() -> Column:
    return F.pmod(F.xxhash64("_id"), F.col("_splits")).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = 0.005) -> DataFrame:
    """All rows and columns of ``docs`` with size, shard and slot (0, 1, ... in each shard).

    A shard is dealt out in parts of about PART_BYTES, one partition each, sorted by (hash, id); the parts go to their
    partitions by number, in the one exchange. A row's slot is its place in the partition after the rows of the parts before.
    """
    docs = docs.drop(*({"size", "shard", "slot"} & set(docs.columns)))
    given = [c for c in docs.columns if c.lower() in INTERNAL]
    own = dict(zip(given, free_names(docs, *(f"_own{c}" for c in given)), strict=True))
    docs, id_col, text_col = docs.withColumnsRenamed(own), own.get(id_col, id_col), own.get(text_col, text_col)
    text = text_or_empty(text_col)
    keyed = docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOW + 1)), "_hash": F.xxhash64(text), "size": F.octet_length(text).cast("bigint") + overhead})
    keys = stage(keyed.select(F.col("_hash").alias("hash"), F.col("_id").alias("id"), "size"), "shard-keys")
    shard, part, layout, most = _layout(keys, shards, tolerance)
    unstage(keys)
    placed = keyed.withColumn("_shard", shard).withColumn("_part", part).join(layout, ["_shard", "_part"])
    placed = placed.withColumn("_split", _split()).withColumns({"_at": F.col("_shard") * most + F.col("_first") + F.col("_split"), "_before": F.col("_before")[F.col("_split")]})
    placed = placed.drop("_part", "_splits", "_first", "_split").repartitionById(shards * most, "_at").sortWithinPartitions("_hash", "_id")
    # the low 33 bits count the rows of a partition
    slot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    placed = placed.withColumns({"slot": slot, "shard": F.col("_shard").cast("int")}).drop("_hash", "_id", "_shard", "_before", "_at")
    return placed.select(*docs.columns, "size", "shard", "slot").withColumnsRenamed({v: k for k, v in own.items()})
