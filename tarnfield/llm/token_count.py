"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A huge text is cut into chunks that overlap; each chunk is encoded with offsets, in a task of its own. Two neighbours
are spliced at a position of their overlap at which both start a token and which is proven stable: an ASCII space after
a non-space, where every encoding has a boundary. Where an overlap has none, the text is cut again with wider chunks
and overlaps, in the end as one chunk. For a vocabulary of which that isn't known (``cuts_spaces``) texts are encoded whole.

Edge cases: null and empty texts have 0 tokens; repeated rows are counted each; other columns are carried through, and
those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnfield.llm.common import free_names, stage, text_or_empty
from tarnfield.llm.tokens import UnitCounts, cuts_spaces, load
from tarnfield.llm.words import portions

CANDIDATES = 8  #: stable positions that a chunk reports for each side
CHUNKS = "row bigint, chunk int, start bigint, first boolean, last boolean, piece string"
SPLICES = "row bigint, chunk int, last boolean, total bigint, heads array<bigint>, head_counts array<bigint>, tails array<bigint>, tail_counts array<bigint>"


def _count_short(path: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnitCounts(path)
        for b in batches:
            for part, texts in portions(b, text_at):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(b.num_columns) if k != text_at), pa.array(counter.count(texts), pa.int64())], [*(n for k, n in enumerate(b.schema.names) if k != text_at), "n_tokens"])

    return run


def _chunked(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(count):
                    last = k == count - 1
                    piece = text[k * chunk :] if last else text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict({"row": [row], "chunk": pa.array([k], pa.int32()), "start": [k * chunk], "first": [k == 0], "last": [last], "piece": [piece]})

    return run


def _stable(text: str, low: int, high: int, starts: dict[int, int]) -> list[int]:
    """Up to CANDIDATES positions in [low, high) with a space after a non-space at which a token starts."""
    found = []
    for p in range(max(1, low), min(high, len(text))):
        if text[p] in " \t\n\r\x0b\x0c" and not text[p - 1].isspace() and p in starts:
            found.append(p)
            if len(found) == CANDIDATES:
                break
    return found


def _encode_chunks(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            for x in b.to_pylist():
                begins = [a for a, _ in tokenizer.encode(x["piece"], add_special_tokens=False).offsets]
                starts: dict[int, int] = {}
                for k, p in enumerate(begins):  # the bytes of one character share its offset: the first counts
                    starts.setdefault(p, k)
                # low + 1: whether the first character of the overlap follows a non-space, only one side can see
                heads = [] if x["first"] else _stable(x["piece"], 1, overlap, starts)
                tails = [] if x["last"] else _stable(x["piece"], chunk + 1, chunk + overlap, starts)
                yield pa.RecordBatch.from_pylist(
                    [{"row": x["row"], "chunk": x["chunk"], "last": x["last"], "total": len(begins), "heads": [x["start"] + p for p in heads], "head_counts": [starts[p] for p in heads], "tails": [x["start"] + p for p in tails], "tail_counts": [starts[p] for p in tails]}],
                    schema=pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("total", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("heads", "head_counts", "tails", "tail_counts"))]),
                )

    return run


def resynchronised_counts(texts: DataFrame, tokenizer_path: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """(row, n_tokens) for ``texts`` (row bigint, text string), each encoded in overlapping chunks of ``chunk`` characters.

    ``chunk`` and ``overlap`` grow eightfold for the texts with an overlap that holds no common stable boundary.
    """
    done: DataFrame | None = None
    while True:
        chunks = texts.select("row", "text").mapInArrow(_chunked(chunk, overlap), CHUNKS).repartition("row", "chunk")
        encoded = chunks.mapInArrow(_encode_chunks(tokenizer_path, chunk, overlap), SPLICES)
        order = W.partitionBy("row").orderBy("chunk")
        ahead = encoded.withColumns({"next_heads": F.lead("heads").over(order), "next_counts": F.lead("head_counts").over(order)})
        at = F.get(F.array_intersect("tails", "next_heads"), F.lit(0))
        ahead = ahead.withColumn("at", at).withColumns({
            "upto": F.when(F.col("last"), F.col("total")).otherwise(F.get("tail_counts", (F.array_position("tails", F.col("at")) - 1).cast("int"))),
            "skip": F.when(F.col("last"), F.lit(0)).otherwise(F.get("next_counts", (F.array_position("next_heads", F.col("at")) - 1).cast("int"))),
        })
        sums = stage(ahead.groupBy("row").agg(F.sum(F.col("upto") - F.col("skip")).alias("n_tokens"), F.count_if(F.col("upto").isNull()).alias("failed")), "token-splices")
        good = sums.where("failed = 0").select("row", "n_tokens")
        done = good if done is None else done.unionByName(good)
        if sums.where("failed > 0").isEmpty():
            return done
        texts = texts.join(sums.where("failed > 0").select("row"), "row", "left_semi")
        chunk, overlap = chunk * 8, overlap * 8


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, huge: int = 32_768, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """All rows of ``docs`` without the text, with n_bytes, n_tokens and over_limit. Texts of over ``huge`` characters go by chunks."""
    docs = docs.drop(*({"n_bytes", "n_tokens", "over_limit"} & set(docs.columns)))
    docs = docs.withColumn(text_col, text_or_empty(text_col)).withColumn("n_bytes", F.octet_length(text_col).cast("bigint"))
    carried = [c for c in docs.columns if c != text_col]
    chunks = cuts_spaces(load(tokenizer_path))
    # no text of over ``huge`` characters has fewer bytes
    short = docs.where((F.col("n_bytes") <= huge) | (F.length(text_col) <= huge)) if chunks else docs
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("n_tokens", T.LongType())])
    counted = short.mapInArrow(_count_short(tokenizer_path, docs.columns.index(text_col)), schema)
    if chunks:
        (row,) = free_names(docs, "_row")
        long = stage(docs.where((F.col("n_bytes") > huge) & (F.length(text_col) > huge)).withColumn(row, F.monotonically_increasing_id()), "huge-texts")
        if not long.isEmpty():
            sums = resynchronised_counts(long.select(F.col(row).alias("row"), F.col(text_col).alias("text")), tokenizer_path, chunk, overlap)
            counted = counted.unionByName(long.join(sums.withColumnRenamed("row", row), row).select(*carried, "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
