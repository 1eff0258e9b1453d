"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of the linked id pairs.

A text is encoded by a byte-level vocabulary (A, of a space and the text) and by a sentencepiece model (B, which adds the
space). Anchors are places where both vocabularies start a token that begins with white space, so that the tokens before
them end together; they cut a document into windows of a few ids. Where both vocabularies are known never to form a token
across a change from a non-space to a space (``cuts_spaces``, ``cuts_pieces``), the windows are cut in the text: what a window
encodes and aligns to is remembered by its bytes, up to a bound, and only new windows are encoded, many as one text. Any
other text (other vocabularies, white space beyond ASCII) is encoded whole, cut at the anchors among its tokens, and its
windows are remembered by their ids. Windows beyond the bounds are aligned anew.

Places where tokens of both end cut the ids into groups, and the last tokens of a group are linked: no token is empty, so
each shared end has one link. Of a linked pair, the bytes of one token end with those of the other. Hence there are no
more different pairs than bytes in both vocabularies, at any size of the corpus, and their table may be broadcast.

Edge cases: texts that are null, empty, or that a vocabulary does not give back byte for byte have no tokens; repeated
rows are aligned and counted each; an empty table gives an empty result; of other columns only the id is kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import stage, text_or_empty, unstage
from tarnfield.llm.tokens import PIECE_UNIT, RARE, WIDE_SPACE, byte_ids, byte_tokens, cuts_pieces, load_pieces, piece_tokens
from tarnfield.llm.words import portions

#: Windows that a Python worker remembers by their ids, and the ids of the longest of them; the same by their bytes.
MEMORY, MEMORY_IDS = 20_000, 24
UNITS, UNIT_BYTES = 100_000, 32
#: New windows of a text that are encoded as one, after a word that begins them.
UNITS_AT_ONCE, BEFORE = 2000, b"x"
#: Windows that are looked up at a time, and bytes of text that are encoded together.
WINDOWS_AT_ONCE, TEXTS_AT_ONCE = 100_000, 300_000


class Vocabulary:
    """Bytes, lengths and space marks of the tokens of a vocabulary by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])


class Aligner:
    """Aligns the ids of A and B; windows that were met are remembered by their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Vocabulary(byte_tokens(a_path)), Vocabulary(piece_tokens(b_path))
        encoder = byte_ids(a_path, as_text=True)
        self.encode_a, self.pieces, self.a_whole = encoder.encode, load_pieces(b_path), encoder.fast is not None  # every byte is a token there
        self.texts = [b"%d%b" % (k, sign) for v, last in ((self.a, b"|"), (self.b, b";")) for k in range(len(v.tokens)) for sign in (b",", last)]
        self.seen: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
        ((a, b),) = self.encode([BEFORE])
        self.before = len(a), len(b)
        self.units: dict[bytes, tuple[int, int, bytes, bytes] | None] | None = {} if len(a) and self.a_whole and cuts_pieces(b_path) else None

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both of each text; none where a vocabulary does not give back a space and the text."""
        spaced = [b" " + t if t else b"" for t in texts]
        out = []
        for text, a, b in zip(spaced, self.encode_a(spaced), self.pieces.encode([t.decode() for t in texts], num_threads=1), strict=True):
            whole = text and self._joined(self.b, b) == text and (self.a_whole or self._joined(self.a, array("I", a)) == text)
            out.append((np.frombuffer(a, "<u4"), np.array(b, "<u4")) if whole else (np.zeros(0, "<u4"), np.zeros(0, "<u4")))
        return out

    @staticmethod
    def _joined(vocabulary: Vocabulary, ids: Iterable[int]) -> bytes:
        return b"".join(map(vocabulary.tokens.__getitem__, ids))

    def _align(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """(groups as text, pairs) of windows that end at those places among the ids of A and B over the same bytes."""
        _, x, y = np.intersect1d(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), assume_unique=True, return_indices=True)  # last tokens of groups
        pairs = (a[x].astype(np.uint64) * np.uint64(len(self.b.tokens)) + b[y]).tobytes()
        # the ids as text, a group's of A before its of B, each with the sign that follows it
        of_a, of_b = (np.repeat(np.arange(len(x)), np.diff(last, prepend=-1)) for last in (x, y))
        signs_a, signs_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        signs_a[x], signs_b[y] = 1, 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, y[:-1] + 1)[of_a]] = 2 * a + signs_a
        codes[np.arange(len(b)) + (x + 1)[of_b]] = 2 * (len(self.a.tokens) + b.astype(np.int64)) + signs_b
        parts = list(map(self.texts.__getitem__, codes.tolist()))
        low = from_pair = 0
        for high, to_pair in zip((ends_a + ends_b).tolist(), (8 * np.searchsorted(x, ends_a)).tolist(), strict=True):
            yield b"".join(parts[low:high])[:-1], pairs[from_pair:to_pair]
            low, from_pair = high, to_pair

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin among the ids of A and of B, and where the last ones end."""
        if not len(a):
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        start_a, start_b = (np.cumsum(v.lengths[ids]) - v.lengths[ids] for v, ids in ((self.a, a), (self.b, b)))
        mark_a, mark_b = np.flatnonzero(self.a.spaced[a]), np.flatnonzero(self.b.spaced[b])
        _, x, y = np.intersect1d(start_a[mark_a], start_b[mark_b], assume_unique=True, return_indices=True)
        return np.append(mark_a[x], len(a)), np.append(mark_b[y], len(b))

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        """(groups as text, pairs) of a document: its windows one after the other."""
        at_a, at_b = self.windows(a, b)
        raw_a, raw_b, seen = a.tobytes(), b.tobytes(), self.seen
        groups, pairs = [], []
        for low in range(0, len(at_a) - 1, WINDOWS_AT_ONCE):
            ends_a, ends_b = ((4 * x[low : low + WINDOWS_AT_ONCE + 1]).tolist() for x in (at_a, at_b))
            keys = list(zip([raw_a[x:y] for x, y in zip(ends_a, ends_a[1:], strict=False)], [raw_b[x:y] for x, y in zip(ends_b, ends_b[1:], strict=False)], strict=True))
            found = list(map(seen.get, keys))
            if None in found:
                fresh = list(dict.fromkeys(key for key, window in zip(keys, found, strict=True) if window is None))
                ids = (np.frombuffer(b"".join([k[side] for k in fresh]), "<u4") for side in (0, 1))
                ends = (np.cumsum([len(k[side]) // 4 for k in fresh]) for side in (0, 1))
                new = dict(zip(fresh, self._align(*ids, *ends), strict=True))
                found = [window or new[key] for key, window in zip(keys, found, strict=True)]
                for key, window in new.items():
                    if len(seen) < MEMORY and len(key[0]) + len(key[1]) <= 4 * MEMORY_IDS:
                        seen[key] = window
            groups.append(b";".join([w[0] for w in found]))
            pairs.append(b"".join([w[1] for w in found]))
        return b";".join(groups), b"".join(pairs)


    def _beside(self, units: list[bytes]) -> list[tuple[int, int, bytes, bytes] | None]:
        """(ids of A, ids of B, groups as text, pairs) of units that are cut apart wherever they stand beside each other; None for one that is not given back."""
        ((a, b),) = self.encode([BEFORE + b"".join(units)])
        if not len(a):
            return [x for u in units for x in self._beside([u])] if len(units) > 1 else [None]
        a, b = a[self.before[0] :], b[self.before[1] :]
        ends = np.cumsum([len(u) for u in units])
        ends_a, ends_b = (np.searchsorted(np.cumsum(v.lengths[ids]), ends, "right") for v, ids in ((self.a, a), (self.b, b)))
        groups, pairs = zip(*self._align(a, b, ends_a, ends_b), strict=True)
        return list(zip(*(np.diff(x, prepend=0).tolist() for x in (ends_a, ends_b)), groups, pairs, strict=True))

    def _find(self, units: list[bytes]) -> list[tuple[int, int, bytes, bytes] | None]:
        """``_beside`` of any units: those that end in white space or that B does not give back stand alone, those of rare characters among themselves."""
        kinds, every = {}, b"".join(units)
        odd, rare = ("\u2581".encode() in every), RARE.search(every)
        for k, u in enumerate(units):
            kinds.setdefault(2 if u[-1] <= 32 or (odd and "\u2581".encode() in u) else 1 if rare and RARE.search(u) else 0, []).append(k)
        out: list = [None] * len(units)
        for kind, own in kinds.items():
            most = 1 if kind == 2 else UNITS_AT_ONCE
            for low in range(0, len(own), most):
                some = own[low : low + most]
                for k, x in zip(some, self._beside([units[k] for k in some]), strict=True):
                    out[k] = x
        return out

    def documents(self, texts: list[bytes]) -> list[tuple[int, int, bytes, bytes]]:
        """(ids of A, ids of B, groups as text, pairs) of each text; none where a vocabulary does not give back a space and the text."""
        cut = [PIECE_UNIT.findall(b" " + t) if t and self.units is not None and not WIDE_SPACE.search(t) else None for t in texts]
        known = {} if self.units is None else self.units
        room = UNITS - len(known)
        new = list(set(chain.from_iterable(filter(None, cut))).difference(known))
        known.update(zip(new, self._find(new), strict=True))
        whole = iter(self.encode([t for t, units in zip(texts, cut, strict=True) if units is None]))
        out = []
        for units in cut:
            if units is None:
                a, b = next(whole)
                out.append((len(a), len(b), *self.align(a, b)))
                continue
            found = list(map(known.__getitem__, units))
            if None in found:
                out.append((0, 0, b"", b""))
                continue
            n_a, n_b, groups, pairs = zip(*found, strict=True)
            out.append((sum(n_a), sum(n_b), b";".join(groups), b"".join(pairs)))
        for u in new:  # what is met first stays
            if room > 0 and len(u) <= UNIT_BYTES:
                room -= 1
            else:
                del known[u]
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for all tasks of a Python worker."""
    return Aligner(a_path, b_path)


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part, texts in portions(batch, 1, TEXTS_AT_ONCE):
                n_a, n_b, groups, pairs = zip(*own.documents(texts), strict=True)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([len(p) // 8 for p in pairs], pa.int64()), pa.array(groups, pa.binary()), pa.array(pairs, pa.binary()),
                ], ["id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3`` as UTF-8) and pairs (binary: a * size of B + b of each link, unsigned 64 bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(_align(a_path, b_path), f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups binary, pairs binary").withColumnRenamed("id", id_col)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pairs of a task with their counts."""
    pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        for raw in _portions(b.column(0)):
            new, n = np.unique(raw, return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "n"])


def _portions(column: pa.Array) -> Iterator[np.ndarray]:
    """The pairs of a batch, about a million at a time."""
    held, size = [], 0
    for x in column:
        held.append(x.as_buffer())
        size += held[-1].size
        if size >= 8_000_000:
            yield np.concatenate([np.frombuffer(h, np.uint64) for h in held])
            held, size = [], 0
    if held:
        yield np.concatenate([np.frombuffer(h, np.uint64) for h in held])


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(a, b, n, best): how many links of all documents hold the pair, and whether no other id of A has more with this id of B."""
    counted = aligned.select("pairs").mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = counted.select((F.col("pair") / b_size).cast("bigint").alias("a"), (F.col("pair") % b_size).alias("b"), "n")
    most = pairs.groupBy("b").agg(F.max("n").alias("_most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def _score(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("pairs"):
                at = np.searchsorted(pairs, np.frombuffer(x.as_buffer(), np.uint64))
                out.append((len(at), int(best[at].sum()), int(counts[at].sum())))
            rest = [k for k, n in enumerate(b.schema.names) if n != "pairs"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], [*(b.schema.names[k] for k in rest), "n_links", "n_best", "count_sum"])

    return run


def score_links(aligned: DataFrame, counts: DataFrame, b_size: int) -> DataFrame:
    """``aligned`` with n_links, n_best (links of a best pair) and count_sum in place of ``pairs``. The table of pairs, bounded by the vocabularies, goes to all tasks."""
    table = counts.select((F.col("a") * b_size + F.col("b")).alias("pair"), "n", "best").toArrow().sort_by("pair")
    pairs, n, best = table["pair"].to_numpy().astype(np.uint64), table["n"].to_numpy(), table["best"].to_numpy()
    shared = aligned.sparkSession.sparkContext.broadcast((pairs, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(*shared.value)(batches)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs")
    return aligned.mapInArrow(run, f"{kept}, n_links bigint, n_best bigint, count_sum bigint")


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256 (empty without tokens), n_links, n_best, count_sum of each document."""
    aligned = align_documents(docs, a_path, b_path, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    staged = stage(aligned.select(id_col, "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs"), "aligned")
    b_size = load_pieces(b_path).get_piece_size()
    counts = stage(pair_counts(staged, b_size), "pair-counts")
    out = score_links(staged, counts, b_size)
    unstage(counts)
    return out
