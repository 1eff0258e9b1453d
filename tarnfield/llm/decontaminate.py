"""Benchmark decontamination by pigeonhole edit matching.

An item within ``k`` edits of a stretch of a document, cut into ``k + 1`` pieces, has a piece that occurs there exactly.
All pieces form one automaton; each document is streamed through it once, and each hit is verified with Myers'
bit-parallel distance on the stretch around it.

Texts and items are compared lower-cased with white space runs as one space. Edge cases: null and empty items match
nothing; items under ``min_chars`` characters allow no edit and match whole words only; equal items, and items that share
an id, are all reported;
null and empty texts match nothing; rows that repeat an id are judged each; very long texts are streamed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import stage, text_or_empty

#: Bytes of items that go to the tasks at once; a larger benchmark takes several passes over the documents.
ITEM_BYTES = 16_000_000

Item = tuple[int, str, int]  #: (id, normalised text, edit budget)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float, min_chars: int) -> int:
    return int(length * error_rate) if length >= min_chars else 0


def pieces(text: str, count: int) -> list[tuple[int, str]]:
    """(offset, piece): ``text`` in ``count`` near equal pieces."""
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [(a, text[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best stretch of ``text`` within ``limit`` edits of ``pattern``, the first of equals, else None."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    up, down, score = full, 0, m
    best: tuple[int, int] | None = None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = score, end
    return best


def piece_automaton(items: tuple[Item, ...]) -> ahocorasick.Automaton:
    """The pieces of all items, with the items and offsets that they stand for."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text, errors) in enumerate(items):
        for offset, piece in pieces(text, errors + 1):
            places.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, at in places.items():
        automaton.add_word(piece, (len(piece), at))
    automaton.make_automaton()
    return automaton


def find_items(text: str, items: tuple[Item, ...], automaton: ahocorasick.Automaton) -> dict[int, tuple[int, int]]:
    """Position in ``items`` -> (distance, end in the normalised text) of its best stretch; ``automaton``: their pieces."""
    if not items:
        return {}
    text = normalised(text)
    found: dict[int, tuple[int, int]] = {}
    tried: dict[tuple[int, int], int] = {}  # (item, start // step) -> start: starts in one bucket lie near enough to each other
    for end, (length, places) in automaton.iter(text):
        for k, offset in places:
            _, item, errors = items[k]
            start = end + 1 - length - offset  # where the item would begin
            near = errors // 2
            at = start // (near + 1)
            if k in found and found[k][0] == 0 or any(abs(start - s) <= near for s in map(tried.get, ((k, at - 1), (k, at), (k, at + 1))) if s is not None):
                continue
            tried[k, at] = start
            if not errors:
                whole = (start <= 0 or text[start - 1] == " ") and (end + 1 >= len(text) or text[end + 1] == " ")
                got = (0, end + 1) if whole else None
            else:  # hits up to errors // 2 off this start count as tried, so look that much further
                low = max(0, start - errors - errors // 2)
                got = myers(item, text[low : start + len(item) + errors + errors // 2], errors)
                got = got and (got[0], low + got[1])
            if got and (k not in found or got < found[k]):
                found[k] = got
    return found


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, error_rate: float, min_chars: int) -> tuple[int, Iterator[tuple[Item, ...]]]:
    """Number of blocks and the blocks: items of about ITEM_BYTES, which fit a task. The driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = size // ITEM_BYTES + 1

    def blocks() -> Iterator[tuple[Item, ...]]:
        for k in range(count):
            part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
            texts = sorted(((r.id, normalised(r.text)) for r in part.collect()), key=lambda x: (x[1], x[0] is not None, x[0] or 0))
            yield tuple((i, t, budget(len(t), error_rate, min_chars)) for i, t in texts if t)

    return count, blocks()


def _hits(items: tuple[Item, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = piece_automaton(items)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (distance, end) in find_items(text, items, automaton).items():
                    for to, x in zip(out, (doc, items[k][0], distance, len(items[k][1]), end), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "item", "distance", "item_chars", "end_char"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.06, min_chars: int = 24) -> DataFrame:
    """One row per document and benchmark item found in it: both ids, the edit distance, the item's length, where it ends."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    out, (count, blocks) = None, item_blocks(benchmark, item_col, item_text_col, error_rate, min_chars)
    for items in blocks:
        part = plain.mapInArrow(_hits(items), "doc bigint, item bigint, distance bigint, item_chars bigint, end_char bigint")
        if count > 1:  # written, so that the block can go
            part = stage(part, "benchmark-hits")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def _clean(items: tuple[Item, ...], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = piece_automaton(items)
        for b in batches:
            yield b.filter(pa.array([not find_items(t or "", items, automaton) for t in b.column(text_at).to_pylist()], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.06, min_chars: int = 24) -> DataFrame:
    """The documents in which no item is found. Nothing is shuffled."""
    count, blocks = item_blocks(benchmark, item_col, item_text_col, error_rate, min_chars)
    for k, items in enumerate(blocks, 1):
        docs = docs.mapInArrow(_clean(items, docs.columns.index(text_col)), docs.schema)
        if k < count:
            docs = stage(docs, "decontaminated")
    return docs
