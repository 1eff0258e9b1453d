"""Packing by power-of-two decomposition.

Each document's ids, ended by ``end_id``, are cut into pieces of ``max_length`` and, for the rest, one piece for each
binary digit of its length, longest first. Every piece is a training sequence of its own: no sequence crosses
documents, none is padded. Sequences of equal length get neighbouring numbers (buckets, longest first).

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty
result; of other columns only the id is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnfield.llm.common import stage, text_or_empty
from tarnfield.llm.tokens import UnitIds
from tarnfield.llm.words import portions

#: Up to so many rows (tasks times lengths) go out by broadcast; more are joined by a shuffle.
SMALL = 200_000
#: Bytes of text whose words are looked up together.
TEXTS_AT_ONCE = 4_000_000


def piece_lengths(n: int, max_length: int) -> list[int]:
    """``n`` as whole ``max_length`` pieces and falling powers of two."""
    return [max_length] * (n // max_length) + [1 << k for k in range(max_length.bit_length() - 2, -1, -1) if n % max_length >> k & 1]


def _pieces(path: str, end_id: int, max_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, task = UnitIds(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        made: Counter[int] = Counter()
        for b in batches:
            for part, texts in portions(b, 1, TEXTS_AT_ONCE):
                out = ([], [], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, max_length):
                        for to, x in zip(out, (doc, start, length, ids[4 * start : 4 * (start + length)], n, made[length]), strict=True):
                            to.append(x)
                        made[length] += 1
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), *(pa.array(out[k], pa.int64()) for k in (1, 2)), pa.array(out[3], pa.binary()), *(pa.array(out[k], pa.int64()) for k in (4, 5)), pa.array([task] * len(out[0]), pa.int32())], ["id", "start", "length", "ids", "doc_tokens", "_nth", "_task"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_length: int = 2048) -> DataFrame:
    """One row per sequence: id, start, length, ids (binary, little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    ``max_length`` is a power of two. sequence_id is gapless from 0: a piece knows its number among those of its task and
    length, and a table of tasks and lengths gives what lies before them.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError(f"max_length must be a power of two, not {max_length}")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, _nth bigint, _task int"
    pieces = stage(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, max_length), schema), "pieces")
    counts = stage(pieces.groupBy("_task", "length").agg(F.max("_nth").alias("n")), "piece-counts")
    # longer pieces first, as many lengths as max_length has binary digits; within a length by task
    base, bases = 0, {}
    for r in sorted(counts.groupBy("length").agg(F.sum(F.col("n") + 1).alias("n")).collect(), key=lambda r: -r.length):
        bases[r.length], base = base, base + r.n
    start = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair])[F.col("length")] if bases else F.lit(0)
    before = F.coalesce(F.sum(F.col("n") + 1).over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_task", "length", (before + start).alias("_before"))
    if counts.count() <= SMALL:
        starts = F.broadcast(starts)
    placed = pieces.join(starts, ["_task", "length"])
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", (F.col("_before") + F.col("_nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
