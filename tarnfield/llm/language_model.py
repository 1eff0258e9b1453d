"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Symbols are the HEAD most frequent tokens and classes that share all other tokens: one for each form and each doubling
of the token's count (a corpus of twice the size has more of them), and one of each form for tokens outside the KNOWN
most frequent. Two symbols of context, each turned by a matrix of its place, predict the next:
s(w | a, b) = q_w . (r_a A + r_b B) + bias_w.

Training documents are dealt by a hash into ROUNDS rounds and, in each, into shards of SHARD_TOKENS tokens or more (at
most MAX_SHARDS shards). In a round each shard trains a copy of the model in the order of the hashes, with noise words
shared by a batch; the copies are averaged by the tokens they saw, and the next round starts from the average. Every
training document is read once, and nothing depends on how the input is partitioned.

As s is a sum of a term of ``a`` and one of ``b``, the sums over all symbols, for all pairs of contexts at once, are one
product of two matrices of exponentials: the probabilities are normalised exactly. A token of a class has the
probability of its class times its smoothed share of the class.

Counts of the KNOWN most frequent tokens go out with the tasks (a table of bounded length); all others are joined by a shuffle.

Edge cases: a null text counts as empty, one end token; rows that repeat an id are scored each; tokens never seen in
training get the share of one unseen token; without training documents all shares are those of unseen tokens; an empty
table gives an empty result; very long texts are read whole; other columns are carried through, those named like the
results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.llm.common import free_names, fresh_path, stage, text_or_empty
from tarnfield.llm.words import portions

END = b"\n"  #: the end token; no word holds a line feed
HEAD = 2048  #: tokens that are symbols of their own
KNOWN = 131_072  #: tokens whose counts every task holds, if they are of KNOWN_BYTES at most
KNOWN_BYTES = 64
WIDTH = 16
BATCH = 2048
CHUNK = 32_768  #: positions that are shuffled together before they are cut into batches
NOISE = 64
ROUNDS = 4
SHARD_TOKENS = 500_000  #: least tokens of a shard in a round
MAX_SHARDS = 4096
SLOTS = 16  #: parts of a model that are averaged apart
FLUSH = 300_000  #: different tokens after which a task hands on its counts
SCORE_AT_ONCE = 200_000  #: positions
LN10 = np.log(10)
REST = "array<struct<token: binary, shape: int, n: bigint>>"


def shape(token: bytes) -> int:
    """Class of a token outside the head: plain or not ASCII; ends in a letter or digit, a stop, another sign, or beyond ASCII."""
    last = token[-1]
    return 4 * (not token.isascii()) + (3 if last >= 128 else 0 if token[-1:].isalnum() else 1 if last in b".,;:!?" else 2)


SHAPES = 8


def _tokens(text: bytes | None) -> list[bytes]:
    tokens = (text or b"").lower().split()
    tokens.append(END)
    return tokens


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(map(shape, seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["token", "shape", "c"])

    for b in batches:
        for text in b.column(0).cast(pa.binary()).to_pylist():
            seen.update(_tokens(text))
            if len(seen) >= FLUSH:
                yield flush()
                seen.clear()
    yield flush()


@dataclass
class Vocabulary:
    """What tasks need of the counts. Symbols: the head's tokens, classes of known tokens, one rare class of each form."""

    tokens: list[bytes]  #: known tokens, the head first
    counts: np.ndarray  #: of each
    total: int
    distinct: int
    sums: dict[int, tuple[int, int]]  #: form -> (training tokens, different tokens) of it
    head: int = field(init=False)
    symbols: np.ndarray = field(init=False)  #: of each known token
    in_class: np.ndarray = field(init=False)  #: log10 share of each known token in its symbol
    weights: np.ndarray = field(init=False)  #: training tokens of each symbol
    rare_below: np.ndarray = field(init=False)  #: of each form, what counts of rare tokens are divided by

    def __post_init__(self) -> None:
        self.head = min(HEAD, len(self.tokens))
        forms = np.array([shape(t) for t in self.tokens], np.int64)
        tail = np.arange(len(self.tokens)) >= self.head
        octaves = np.array([int(c).bit_length() for c in self.counts], np.int64)
        kinds, of = np.unique(octaves[tail] * SHAPES + forms[tail], return_inverse=True)
        self.symbols = np.arange(len(self.tokens))
        self.symbols[tail] = self.head + of
        weight = np.bincount(of, self.counts[tail], len(kinds))
        types = np.bincount(of, minlength=len(kinds))
        self.in_class = np.zeros(len(self.tokens))
        self.in_class[tail] = np.log10((self.counts[tail] + 0.5) / (weight + 0.5 * types)[of])
        rare = np.array([self.sums.get(k, (0, 0)) for k in range(SHAPES)], float)
        rare[:, 0] -= np.bincount(forms, self.counts, SHAPES)
        rare[:, 1] -= np.bincount(forms, self.counts > 0, SHAPES)
        self.rare_below = rare[:, 0] + 0.5 * (rare[:, 1] + 1)
        self.weights = np.concatenate([self.counts[: self.head], weight, rare[:, 0]]).astype(float)

    @property
    def end(self) -> int:
        return self.tokens.index(END)

    @property
    def rare(self) -> int:
        """The first of the rare classes."""
        return len(self.weights) - SHAPES

    @property
    def below(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def count_tokens(texts: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(token, shape, c) over all ``texts`` (one column), and the vocabulary."""
    counts = stage(texts.mapInArrow(_count, "token binary, shape int, c bigint").groupBy("token", "shape").agg(F.sum("c").alias("c")), "token-counts")
    top = counts.where(F.octet_length("token") <= KNOWN_BYTES).orderBy(F.desc("c"), "token").limit(KNOWN).toArrow()
    known = dict(zip(top.column("token").to_pylist(), top.column("c").to_pylist(), strict=True))
    ends = known.pop(END, None)  # the end is always a symbol, the first
    if ends is None:
        ends = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    sums = {r.shape: (r.c, r.n) for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    total, distinct = (sum(x[i] for x in sums.values()) for i in (0, 1))
    return counts, Vocabulary([END, *known], np.array([ends, *known.values()], np.int64), total, distinct, sums)


@dataclass
class Model:
    """Embeddings of contexts R and of targets Q (symbols, WIDTH), matrices A and B of the two places, biases."""

    R: np.ndarray
    Q: np.ndarray
    A: np.ndarray
    B: np.ndarray
    bias: np.ndarray
    _order: tuple[str, ...] = field(default=("R", "Q", "A", "B", "bias"), repr=False)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self._order])

    def put(self, flat: np.ndarray) -> Model:
        at, parts = 0, []
        for k in self._order:
            old = getattr(self, k)
            parts.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return Model(*parts)


def fresh(weights: np.ndarray, seed: int = 11) -> Model:
    """Small random embeddings; the biases are the log shares, at which the scores are those of single tokens."""
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
    share = (weights + 0.5) / (weights + 0.5).sum()
    return Model(small(len(weights), WIDTH), small(len(weights), WIDTH), np.eye(WIDTH, dtype=np.float32), 0.5 * np.eye(WIDTH, dtype=np.float32), np.log(share).astype(np.float32))


def contexts(symbols: np.ndarray, end: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One and two symbols back from each; END stands before a text. ``ends``: where texts end (their END)."""
    one = np.append(end, symbols[:-1])
    two = np.append(end, one[:-1])
    first = np.append(0, ends[:-1] + 1)
    two[first] = end
    second = first + 1
    two[second[second < len(two)]] = end
    return one, two


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(index, rows[:, k], n) for k in range(rows.shape[1])]).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation by Adagrad over documents' symbols, in the order in which they are given."""

    def __init__(self, model: Model, squares: Model, weights: np.ndarray, end: int, rate: float = 0.1, seed: int = 3):
        self.m, self.squares, self.end, self.rate, self.rng, self.seen = model, squares, end, rate, np.random.default_rng(seed), 0
        share = (weights + 0.5) / (weights + 0.5).sum()
        self.cumulative, self.noise_log = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.held: list[np.ndarray] = []
        self.size = 0

    def take(self, symbols: np.ndarray) -> None:
        self.held.append(symbols)
        self.size += len(symbols)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        w, ends = np.concatenate(self.held), np.cumsum([len(h) for h in self.held]) - 1
        a, b = contexts(w, self.end, ends)
        order = self.rng.permutation(len(w))
        size = max(64, min(BATCH, len(w) // 16))  # a short rest makes as many steps
        for at in range(0, len(w), size):
            pick = order[at : at + size]
            self.step(w[pick], a[pick], b[pick])
        self.held, self.size = [], 0

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        m, n = self.m, len(self.m.bias)
        ra, rb, q = m.R[a], m.R[b], m.Q[w]
        p = ra @ m.A + rb @ m.B
        drawn = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(0, n - 1)
        # odds that a word came from the corpus: its score against NOISE times its share
        good = 1 / (1 + np.exp((p * q).sum(1) + m.bias[w] - self.noise_log[w]))
        bad = -1 / (1 + np.exp(-(p @ m.Q[drawn].T + m.bias[drawn] - self.noise_log[drawn])))
        dp = good[:, None] * q + bad @ m.Q[drawn]
        dq = _scatter(w, good[:, None] * p, n)
        np.add.at(dq, drawn, bad.T @ p)
        dbias = np.bincount(w, good, n).astype(np.float32)
        np.add.at(dbias, drawn, bad.sum(0))
        dr = _scatter(np.concatenate([a, b]), np.concatenate([dp @ m.A.T, dp @ m.B.T]), n)
        for k, g in (("R", dr), ("Q", dq), ("A", ra.T @ dp), ("B", rb.T @ dp), ("bias", dbias)):
            g = g / np.float32(len(w))
            squares = getattr(self.squares, k)
            squares += g * g
            getattr(m, k).__iadd__(np.float32(self.rate) * g / np.sqrt(squares))
        self.seen += len(w)


def _learn(start: np.ndarray, weights: np.ndarray, end: int):
    """``start``: the model and the squares of its gradients, as one vector. Rows: shard, key, symbols, in order."""

    def trained(trainer: Trainer, shard: int) -> pa.RecordBatch:
        trainer.flush()
        parts = np.array_split(np.concatenate([trainer.m.flat(), trainer.squares.flat()]).astype(np.float64) * trainer.seen, SLOTS)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS), pa.int32()), pa.array([shard] * SLOTS, pa.int32()), pa.array([trainer.seen] * SLOTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slot", "shard", "seen", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape_of = fresh(weights)
        trainer, at = None, None
        for b in batches:
            for shard, symbols in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != at:
                    if trainer:
                        yield trained(trainer, at)
                    at, trainer = shard, Trainer(*(shape_of.put(half) for half in np.split(start, 2)), weights, end, seed=shard)
                trainer.take(np.frombuffer(symbols, "<u2").astype(np.int64))
        if trainer:
            yield trained(trainer, at)

    return run


def _add(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")  # sums of floats: always in the same order
    total = np.zeros(len(table.column("part")[0].as_py()) // 8)
    for x in table.column("part"):
        total += np.frombuffer(x.as_py(), np.float64)
    return pa.table({"slot": table.column("slot").slice(0, 1), "shard": pa.array([table.column("shard")[0].as_py() % 64], pa.int32()), "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})


def train(symbols: DataFrame, vocabulary: Vocabulary) -> Model:
    """Train on all rows of ``symbols`` (key bigint, symbols binary), each once."""
    schema = "slot int, shard int, seen bigint, part binary"
    model = fresh(vocabulary.weights)
    state = np.concatenate([model.flat(), np.full(model.flat().size, 1e-3)])
    shards = max(1, min(MAX_SHARDS, vocabulary.total // (ROUNDS * SHARD_TOKENS)))
    dealt = symbols.withColumns({"shard": F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)).cast("int"), "round": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(ROUNDS))})
    for k in range(ROUNDS):
        rows = dealt.where(F.col("round") == k).select("shard", "key", "symbols").repartition("shard").sortWithinPartitions("shard", "key", "symbols")
        copies = rows.mapInArrow(_learn(state.astype(np.float32), vocabulary.weights, vocabulary.end), schema)
        sums = copies.groupBy("slot", F.col("shard") % 64).applyInArrow(lambda t: _add(t), schema).groupBy("slot").applyInArrow(lambda t: _add(t), schema)
        got = sorted(sums.collect(), key=lambda r: r.slot)  # one model
        if got:
            state = np.concatenate([np.frombuffer(r.part, np.float64) / r.seen for r in got])
    return model.put(np.split(state, 2)[0])


@lru_cache(maxsize=1)
def _tables(key: str, flat: bytes, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score terms of the nearer context and of the farther one (with the bias), and the log of the sum over all symbols."""
    m = fresh(np.ones(symbols)).put(np.frombuffer(flat, np.float32))
    one, two = m.R @ m.A @ m.Q.T, m.R @ m.B @ m.Q.T + m.bias
    high_one, high_two = one.max(1, keepdims=True), two.max(1, keepdims=True)
    norm = np.log(np.exp(one - high_one) @ np.exp(two - high_two).T) + high_one + high_two.T
    return one, two, norm


def log_probabilities(tables: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of each symbol after its contexts."""
    one, two, norm = tables
    return one[a, w] + two[b, w] - norm[a, b]


def _encode(vocabulary: Vocabulary, carried: int):
    """Symbols and the base score of each text, as far as the known tokens go; the rest of its tokens are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        index = {t: k for k, t in enumerate(vocabulary.tokens)}
        base, seen = np.log10((vocabulary.counts + 0.5) / vocabulary.below), vocabulary.counts > 0
        for batch in batches:
            for part, texts in portions(batch, carried):
                tokens = [_tokens(t) for t in texts]
                sizes = np.array([len(ts) for ts in tokens])
                starts = np.cumsum(sizes) - sizes
                flat = list(chain.from_iterable(tokens))
                at = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
                known = at >= 0
                symbols = vocabulary.symbols[at]
                sums = [np.add.reduceat(np.where(known, x[at], 0), starts) for x in (seen.astype(np.int64), base, vocabulary.in_class)]
                rest: list[Counter[bytes]] = [Counter() for _ in texts]
                for j, k in zip((missing := np.flatnonzero(~known)).tolist(), np.searchsorted(starts, missing, "right").tolist(), strict=True):
                    rest[k - 1][flat[j]] += 1
                    symbols[j] = vocabulary.rare + shape(flat[j])
                symbols, ends = symbols.astype("<u2"), (starts + sizes).tolist()
                each = [(t, shape(t), n) for c in rest for t, n in c.items()]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(c) for c in rest])), pa.int32()),
                    pa.StructArray.from_arrays([pa.array([e[0] for e in each], pa.binary()), pa.array([e[1] for e in each], pa.int32()), pa.array([e[2] for e in each], pa.int64())], ["token", "shape", "n"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(carried)), part.column(carried + 1), part.column(carried + 2), pa.array(row + np.arange(len(texts))), pa.array(sizes), *map(pa.array, sums), lists, pa.array([symbols[x:y].tobytes() for x, y in zip(starts.tolist(), ends, strict=True)], pa.binary())],
                    names=[*(part.schema.names[k] for k in (*range(carried), carried + 1, carried + 2)), "row", "n_tokens", "n_known", "base", "in_class", "rest", "symbols"],
                )
                row += len(texts)

    return run


def _score(model: Model, end: int, key: str, carried: int):
    """Adds the model's log10 probability of the symbols (the last column) to the shares within classes before it."""
    flat = model.flat().astype(np.float32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, flat, len(model.bias))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = batch.column(batch.num_columns - 2).to_numpy().copy()
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) // 2 <= SCORE_AT_ONCE):
                    size += len(texts[high]) // 2
                    high += 1
                w = np.frombuffer(b"".join(texts[low:high]), "<u2")
                ends = np.cumsum([len(t) // 2 for t in texts[low:high]]) - 1
                a, b = contexts(w, end, ends)
                logs = np.empty(len(w), np.float32)
                for at in range(0, len(w), SCORE_AT_ONCE):
                    here = slice(at, at + SCORE_AT_ONCE)
                    logs[here] = log_probabilities(tables, w[here], a[here], b[here])
                scores[low:high] += np.add.reduceat(logs.astype(np.float64), np.append(0, ends[:-1] + 1)) / LN10
                low = high
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(scores)], [*batch.schema.names[:-2], "score"])

    return run


def score(docs: DataFrame, trainable: Column, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    The counts and the model come from the rows that ``trainable`` admits.
    """
    docs = docs.drop(*({"n_tokens", "n_known", "train_tokens", "base_score", "score"} & set(docs.columns)))
    carried = [c for c in docs.columns if c != text_col]
    hashed = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.VariantType) else F.to_json(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema]
    counts, vocabulary = count_tokens(docs.where(trainable).select(text_or_empty(text_col).alias("text")))
    text, key, train_row, row, base, in_class, rest, symbols, n = free_names(docs, "_text", "_key", "_train", "_row", "_base", "_in_class", "_rest", "_symbols", "_n")
    given = docs.withColumns({text: text_or_empty(text_col), key: F.xxhash64(*hashed), train_row: F.coalesce(trainable, F.lit(False))}).select(*carried, text, key, train_row)
    made = f"{key} bigint, {train_row} boolean, {row} bigint, n_tokens bigint, n_known bigint, {base} double, {in_class} double, {rest} {REST}, {symbols} binary"
    schema = T.StructType([*(docs.schema[c] for c in carried), *T.StructType.fromDDL(made).fields])
    encoded = stage(given.mapInArrow(_encode(vocabulary, len(carried)), schema), "encoded-documents")
    model = train(encoded.where(train_row).select(F.col(key).alias("key"), F.col(symbols).alias("symbols")), vocabulary)
    scored = encoded.select(*carried, row, "n_tokens", "n_known", base, in_class, symbols)
    schema = T.StructType([*(docs.schema[c] for c in carried), *T.StructType.fromDDL(f"{row} bigint, n_tokens bigint, n_known bigint, {base} double, score double").fields])
    scored = scored.mapInArrow(_score(model, vocabulary.end, fresh_path(docs.sparkSession, "model"), len(carried)), schema)
    # the rarer tokens: their counts come by a join, their sums go back to the documents
    others = encoded.select(row, F.explode(rest).alias("r")).select(row, "r.*")
    others = others.join(counts.select("token", "c").hint("merge"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare_below = F.array(*[F.lit(float(x)) for x in vocabulary.rare_below])
    share = lambda total: F.col("n") * F.log10((F.col("c") + 0.5) / total)
    others = others.groupBy(row).agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias(n), F.sum(share(F.lit(vocabulary.below))).alias(f"{base}_more"), F.sum(share(F.get(rare_below, F.col("shape")))).alias(f"{in_class}_more"))
    out = scored.join(others, row, "left")
    more = lambda c, d, name: (F.col(c) + F.coalesce(d, F.lit(0))).alias(name)
    return out.select(*carried, "n_tokens", more("n_known", n, "n_known"), F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), more(base, f"{base}_more", "base_score"), more("score", f"{in_class}_more", "score"))
