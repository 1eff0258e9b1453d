"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it also starts in a
document with a smaller id. All windows are judged on the input.

1. Each window has an anchor, the smallest hash among its ``anchor`` word phrases; equal windows have equal anchors.
   Anchors that occur in a single document rule their windows out; about a fifth of the words start an anchor.
2. In the documents that are left, each stretch of windows with one recurring anchor is a segment. Equal segments are
   aggregated to the smallest and largest document before anything is gathered.
3. Segments are sharded by anchor, several anchors to a shard. A shard confirms the windows that occur in two documents
   or more, joins neighbouring ones with the same first document into passages, compiles these into one automaton over
   words, and streams all its segments through it, which locates every occurrence of every passage.
   An anchor of more than GROUP different segments is dealt out: a window belongs to one part of it, given by its hash,
   and a segment goes to the parts that its windows belong to.
4. Each occurrence whose first document is an earlier one marks its words; the marked words are cut from the text.

Occurrences are matched on the words themselves; hashes route and confirm.

Edge cases: null and empty texts have no words; texts of fewer than ``window`` words keep all; a passage repeated only
inside one document stays; of rows that repeat an id none is earlier than the other, and rows without an id are neither
earlier nor later than any; an empty table gives an empty result; other columns are carried through, those named like
the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.llm.common import free_names, stage, text_or_empty, unstage
from tarnfield.llm.words import portions, shingle_hashes, words_of

SHARD_BYTES = 200_000  #: text of whole anchor groups from which a shard's automaton is compiled
GROUP = 16_384  #: different segments of an anchor that one task takes


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window of a document's word hashes."""
    phrases = shingle_hashes(hashes, anchor)
    n = len(hashes) - window + 1
    least = phrases[:n]
    for k in range(1, window - anchor + 1):
        least = np.minimum(least, phrases[k : k + n])
    return least.view(np.int64)


def _document_anchors(window: int, anchor: int):
    """(id, print, anchors): the different anchors of each document, without the documents that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in portions(b, 2):
                words = words_of(texts)
                found = [np.unique(_anchors(words.hashes[low:high], window, anchor)) if high - low >= window else np.zeros(0, np.int64) for low, high in zip(words.bounds, words.bounds[1:], strict=False)]
                counts = np.array([len(f) for f in found])
                row = pa.array(np.flatnonzero(counts))
                offsets = np.append(0, np.cumsum(counts[counts > 0]))
                anchors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), anchors], ["id", "print", "anchors"])

    return run


def _segments(window: int, anchor: int):
    """(anchor, id, print, start, segment, key) for each stretch of windows with one recurring anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in portions(b, 2):
                words = words_of(texts)
                rows, at, first, last = [], [], [], []
                for k, wanted in enumerate(part.column(3)):
                    low, high = words.bounds[k : k + 2]
                    own = _anchors(words.hashes[low:high], window, anchor)
                    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    ends = np.append(begins[1:], len(own))
                    hit = np.isin(own[begins], wanted.values.to_numpy())
                    begins, ends = begins[hit], ends[hit]
                    rows.append(np.full(len(begins), k))
                    at.append(np.column_stack([own[begins], begins]))
                    first.append(words.starts[low + begins])
                    last.append(words.ends[low + ends + window - 2])
                row, own = pa.array(np.concatenate(rows)), np.concatenate(at)
                stretches = [words.buffer[x:y] for x, y in zip(np.concatenate(first).tolist(), np.concatenate(last).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[:, 0].copy()), part.column(0).take(row), part.column(1).take(row), pa.array(own[:, 1].copy()),
                    pa.array(stretches, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) for x in stretches], pa.binary()),
                ], ["anchor", "id", "print", "start", "segment", "key"])

    return run


def _windows(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of all words in a row, the segment each starts in, whether it ends in it, bounds of the segments."""
    words = words_of(segments)
    hashes = shingle_hashes(words.hashes, window)
    owner = np.repeat(np.arange(len(segments)), np.diff(words.bounds))[: len(hashes)]
    return hashes, owner, np.arange(len(hashes)) + window <= words.bounds[owner + 1], words.bounds


class _Shard:
    """Segments of whole anchor groups: (segment, key, first, last document, parts of its anchor, part)."""

    def __init__(self, rows: list[tuple], window: int):
        self.rows, self.window = rows, window
        numbers: dict[bytes, int] = {}
        self.texts = [tuple([numbers.setdefault(w, len(numbers)) for w in r[0].split()]) for r in rows]

    def passages(self) -> dict[tuple, int]:
        """Runs of windows that occur in two documents or more and have the same first document -> that document."""
        windows, owner, inside, bounds = _windows([r[0] for r in self.rows], self.window)
        first, last, parts, part = (np.array([r[k] for r in self.rows])[owner] for k in (2, 3, 4, 5))
        if (parts > 1).any():
            inside &= (windows % parts.astype(np.uint64)).astype(np.int64) == part
        where = np.flatnonzero(inside)
        order = where[np.argsort(windows[where], kind="stable")]
        begins = np.flatnonzero(np.append(True, np.diff(windows[order]) != 0)) if len(order) else order
        low, high = np.minimum.reduceat(first[order], begins), np.maximum.reduceat(last[order], begins)
        of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        lowest, recurs = np.zeros(len(windows) + 1, np.int64), np.zeros(len(windows) + 1, bool)
        lowest[order], recurs[order] = low[of], (low < high)[of]
        starts = recurs.copy()
        starts[1:-1] &= ~(recurs[:-2] & (lowest[:-2] == lowest[1:-1]) & (owner[:-1] == owner[1:]))
        begin = np.flatnonzero(starts)
        end = np.flatnonzero(starts | ~recurs)  # a run ends before the next one, or where windows do not recur
        end = end[np.searchsorted(end, begin, "right")]
        own = owner[begin]
        return {self.texts[o][a:z]: f for o, a, z, f in zip(own.tolist(), (begin - bounds[own]).tolist(), (end - bounds[own] + self.window - 1).tolist(), lowest[begin].tolist(), strict=True)}

    def locate(self) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
        """(key, [(place of the first word, words, first document)]) of the segments that later documents hold, with the longest occurrences."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for passage, first in self.passages().items():
            automaton.add_word(passage, (len(passage), first))
        if not len(automaton):
            return
        automaton.make_automaton()
        for words, row in zip(self.texts, self.rows, strict=True):
            found: list[tuple[int, int, int]] = []
            top = -1  # the last word of what is found
            for last, (n, first) in automaton.iter(words):
                at = last - n + 1
                if first >= row[3] or (last == top and at >= found[-1][0]):
                    continue
                while found and found[-1][0] >= at:
                    found.pop()
                found.append((at, n, first))
                top = last
            if found:
                yield row[1], found


def _locate(window: int):
    """(key, places, words, firsts) of each segment in which passages with an earlier first document were located."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def located() -> pa.RecordBatch:
            found = list(_Shard(rows, window).locate()) if rows else []
            keys, runs = [f[0] for f in found], [f[1] for f in found]
            offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
            each = [x for r in runs for x in r]
            columns = [pa.ListArray.from_arrays(offsets, pa.array([x[k] for x in each], pa.int64())) for k in range(3)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *columns], ["key", "places", "words", "firsts"])

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for group, *row in zip(*columns, strict=True):
                if group != last and size >= SHARD_BYTES:
                    yield located()
                    size = 0
                last = group
                rows.append(tuple(row))
                size += len(row[0])
        yield located()

    return run


def _cut(window: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            texts, places, sizes = (b.column(carried + k) for k in range(3))
            bounds, places, sizes = places.offsets.to_numpy(), places.values.to_numpy(), sizes.values.to_numpy()
            for k, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                words = text.split()
                removed, low, high = 0, bounds[k], bounds[k + 1]
                n_words.append(len(words))
                if high > low:
                    change = np.bincount(places[low:high], minlength=len(words) + 1)
                    change -= np.bincount(places[low:high] + sizes[low:high], minlength=len(words) + 1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                n_removed.append(removed)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(carried)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*b.schema.names[:carried], "n_words", "n_removed", "kept_text"])

    return run


def _spread(window: int):
    """Segments of large groups, once for each part of their anchor that a window of theirs belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                windows, owner, inside, _ = _windows(b.column(1).to_pylist(), window)
                part = windows % b.column(5).to_numpy().astype(np.uint64)[owner]
                pairs = np.unique(np.column_stack([owner, part.astype(np.int64)])[inside], axis=0)
                row = pa.array(pairs[:, 0].copy())
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns), pa.array(pairs[:, 1].astype(np.int32))], [*b.schema.names, "part"])

    return run


def _shards(segments: DataFrame, window: int) -> DataFrame:
    """The different ``segments`` with their first and last document, with whole anchors or parts of them side by side."""
    schema = "anchor bigint, segment binary, key binary, first bigint, last bigint, parts int"
    each = stage(segments.groupBy("anchor", "segment", "key").agg(F.min("id").alias("first"), F.max("id").alias("last")), "different-segments")
    large = stage(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("anchor", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")), "large-anchors")
    whole = each.withColumns({"parts": F.lit(1), "part": F.lit(0)})
    if not large.isEmpty():
        apart = each.join(large, "anchor").select("anchor", "segment", "key", "first", "last", "parts").mapInArrow(_spread(window), f"{schema}, part int")
        whole = whole.join(large, "anchor", "left_anti").unionByName(apart)
    dealt = whole.select(F.xxhash64("anchor", "part").alias("shard"), "segment", "key", "first", "last", "parts", "part")
    return dealt.repartition("shard").sortWithinPartitions("shard")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, anchor: int = 6) -> DataFrame:
    """All rows of ``docs`` without the text, with n_words, n_removed and kept_text (the words left, joined by a space)."""
    docs = docs.drop(*({"n_words", "n_removed", "kept_text"} & set(docs.columns)))
    carried = [c for c in docs.columns if c != text_col]
    text = text_or_empty(text_col)
    # the fingerprint tells apart rows that share an id
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    plain = plain.where("id is not null")
    anchors = stage(plain.mapInArrow(_document_anchors(window, anchor), "id bigint, print bigint, anchors array<bigint>"), "anchors")
    each = anchors.select("id", "print", F.explode("anchors").alias("anchor"))
    recurring = stage(each.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("anchor"), "recurring-anchors")
    wanted = stage(each.join(recurring.hint("merge"), "anchor").groupBy("id", "print").agg(F.collect_set("anchor").alias("wanted")), "anchored-documents")
    unstage(anchors, recurring)
    segments = plain.join(wanted.hint("merge"), ["id", "print"]).select("id", "print", "text", "wanted")
    segments = stage(segments.mapInArrow(_segments(window, anchor), "anchor bigint, id bigint, print bigint, start bigint, segment binary, key binary"), "segments")
    unstage(wanted)
    located = stage(_shards(segments, window).mapInArrow(_locate(window), "key binary, places array<bigint>, words array<bigint>, firsts array<bigint>"), "located")
    # of each occurrence, the places in the document; those that no earlier document holds go
    hits = segments.select("id", "print", "start", "key").join(located.hint("merge"), "key")
    earlier = F.filter(F.sequence(F.lit(0), F.size("firsts") - 1), lambda k: F.get("firsts", k) < F.col("id"))
    hits = hits.withColumn("_at", earlier).where(F.size("_at") > 0)
    hits = hits.select("id", "print", F.transform("_at", lambda k: F.get("places", k) + F.col("start")).alias("places"), F.transform("_at", lambda k: F.get("words", k)).alias("words"))
    hits = hits.groupBy("id", "print").agg(F.collect_list(F.struct("places", "words")).alias("_hits"))
    hits = stage(hits.select("id", "print", F.flatten("_hits.places").alias("_places"), F.flatten("_hits.words").alias("_words")), "passage-hits")
    unstage(segments, located)
    own_id, own_print, own_text = free_names(docs, "_id", "_print", "_text")
    full = docs.withColumns({own_id: F.col(id_col).cast("bigint"), own_text: text, own_print: F.xxhash64(text)})
    places, words = free_names(full, "_places", "_words")
    hits = hits.select(F.col("id").alias(own_id), F.col("print").alias(own_print), F.col("_places").alias(places), F.col("_words").alias(words))
    full = full.join(hits.hint("merge"), [own_id, own_print], "left")
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return full.select(*carried, own_text, places, words).mapInArrow(_cut(window, len(carried)), schema)
