"""Best-fit packing planned on the histogram of lengths.

Documents' ids, ended by ``end_id``, stay whole up to ``max_length``; a longer document is cut into pieces of ``max_length``
after a first one that takes the rest. Best-fit decreasing then packs the *counts* of pieces by length: a plan is a list of
bin patterns with how often each occurs, and its size depends on ``max_length`` alone. Pieces take the planned slots of
their length by their rank among the pieces of that length.

A piece knows its number among those of its task and length, and a table of tasks and lengths gives what lies before, so
that no task sees all pieces of a length, however common it is. Each length splits at most three groups of bins, and a
bin holds few different lengths: for 1,024 the plan has under 140,000 runs at any number of documents.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty
result; of other columns only the id is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnfield.llm.common import stage, text_or_empty
from tarnfield.llm.tokens import byte_ids
from tarnfield.llm.words import portions

#: Up to so many rows (tasks times lengths) go out by broadcast; more are joined by a shuffle.
SMALL = 200_000
#: Bytes of text that are encoded together.
TEXTS_AT_ONCE = 4_000_000
RUNS = ("length", "rank", "bins", "each", "sequence", "offset")


def fit_counts(counts: Mapping[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing of ``counts`` (length -> how many) into bins of ``size``: (number of bins, [(length, items in each)]).

    Bins with equal contents are one group. Items of a length fill, group by group, the bins with the least room that still
    takes one; what fits nowhere opens new bins.
    """
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # room left -> groups

    def put(room: int, bins: int, held: list[tuple[int, int]]) -> None:
        if bins:
            groups.setdefault(room, []).append((bins, held))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in groups if r >= length), default=None)
            bins, held = (-(-left // (size // length)), []) if room is None else groups[room].pop()
            if room is not None and not groups[room]:
                del groups[room]
            room = size if room is None else room
            each = min(room // length, left)
            full = min(bins, left // each)
            put(room - each * length, full, [*held, (length, each)])
            left -= full * each
            if full < bins and left:  # fewer items than one more of these bins has room for
                put(room - left * length, 1, [*held, (length, left)])
                full, left = full + 1, 0
            if held:
                put(room, bins - full, held)
    return [x for room in sorted(groups) for x in groups[room]]


def plan_runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """The plan as runs sorted by (length, rank): the pieces of a length from ``rank`` on go, ``each`` to a bin, to ``bins`` bins from ``sequence`` on, at ``offset``."""
    ranks: Counter[int] = Counter()
    runs, sequence = [], 0
    for bins, held in patterns:
        offset = 0
        for length, each in held:
            runs.append((length, ranks[length], bins, each, sequence, offset))
            ranks[length] += bins * each
            offset += length * each
        sequence += bins
    return np.array(sorted(runs), np.int64).reshape(-1, len(RUNS))


def take_slots(runs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    first = np.searchsorted(runs[:, 0], np.arange(runs[-1, 0] + 2))  # where a length's runs begin
    base = np.maximum.accumulate(runs[:, 1])[-1] + runs[-1, 2] * runs[-1, 3] + np.max(runs[:, 2] * runs[:, 3])
    if (int(runs[-1, 0]) + 1) * int(base) < 2**62:  # one search over (length, rank)
        at = np.searchsorted(runs[:, 0] * base + runs[:, 1], lengths * base + ranks, "right") - 1
    else:
        at = np.array([first[n] + np.searchsorted(runs[first[n] : first[n + 1], 1], r, "right") - 1 for n, r in zip(lengths, ranks, strict=True)], np.int64)
    into = ranks - runs[at, 1]
    return runs[at, 4] + into // runs[at, 3], runs[at, 5] + into % runs[at, 3] * lengths


def _pieces(path: str, end_id: int, max_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, task = byte_ids(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        made: Counter[int] = Counter()
        for b in batches:
            for part, texts in portions(b, 1, TEXTS_AT_ONCE):
                out = ([], [], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    starts = [0, *range(n % max_length or max_length, n, max_length)]
                    for k, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        length = stop - start
                        for to, x in zip(out, (doc, k, start, length, ids[4 * start : 4 * stop], made[length]), strict=True):
                            to.append(x)
                        made[length] += 1
                kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)), pa.array([task] * len(out[0]), pa.int32())], ["id", "piece", "start", "length", "ids", "_nth", "_task"])

    return run


def _placed(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = take_slots(runs, b.column("length").to_numpy(), b.column("_rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, max_length: int = 1024) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, little-endian unsigned 32 bit), sequence_id, offset.

    ``max_length`` is at most 65,536. The driver receives how many pieces there are of each length, and plans on that.
    """
    if not 0 < max_length <= 65_536:
        raise ValueError(f"max_length must be from 1 to 65536, not {max_length}")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    pieces = stage(texts.mapInArrow(_pieces(tokenizer_path, end_id, max_length), f"id {kind}, piece int, start bigint, length bigint, ids binary, _nth bigint, _task int"), "fit-pieces")
    counts = stage(pieces.groupBy("_task", "length").agg((F.max("_nth") + 1).alias("n")), "fit-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_task", "length", before.alias("_before"))
    if counts.count() <= SMALL:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["_task", "length"]).select("id", "piece", "start", "length", "ids", (F.col("_before") + F.col("_nth")).alias("_rank"))
    schema = T.StructType([*ranked.drop("_rank").schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placed(plan_runs(fit_counts(histogram, max_length))), schema).withColumnRenamed("id", id_col)
