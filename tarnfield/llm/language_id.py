"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on the whole texts of a bounded sample of labelled
documents. It labels every byte position of every whole text; a document's probabilities are the mean of those of its
positions. Texts are read in spans of SPAN bytes, each from a zero state in both directions, so a very long text costs
no more memory.

Beside the languages there is a class for noise, learned from sampled texts whose characters are shuffled and from random
characters. It never is the prediction, but ``noise`` tells its probability, by which a filter can reject texts that are
in none of the languages.

Edge cases: null texts and texts without a letter are ``und`` with score and noise 0; rows that repeat an id are judged
each; without a labelled document all are ``und``; other columns are carried through, those named like the results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnfield.llm.common import free_names, text_or_empty

UNKNOWN = "und"
SAMPLE_DOCS = 1000  #: labelled documents on which the network is fitted
LEAST_DOCS = 100  #: the sample is filled up to so many of each language, or all that it has
SAMPLE_TEXT_BYTES = 1_000_000  #: longer labelled texts are not drawn into the sample, as the driver holds it
SAMPLE_BYTES = 16_000_000  #: of all texts of the sample: beyond it, fewer whole documents are drawn
TRAIN_BYTES = 6_000_000  #: the sample is read again until about so much has been, MAX_EPOCHS times at most
MAX_EPOCHS = 30
SPAN = 64  #: bytes that are read from a zero state
WIDTH = 8  #: states of each direction
SPANS_AT_ONCE = 512
BYTES_AT_ONCE = 2_000_000
ONE_SPACE = bytes(32 if 9 <= k <= 13 else k for k in range(256))  #: white space is read as a space


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    #: For each direction: inputs by byte (256, 3 WIDTH), reset and update weights (WIDTH, 2 WIDTH), candidate weights.
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray  #: (2 WIDTH, languages and noise)
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    x /= x.sum(axis, keepdims=True)
    return x


def _read(x: np.ndarray, inputs: np.ndarray, gates: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, ...]:
    """States before each step, gates, candidates and states of spans x (steps, spans), for training."""
    steps, n = x.shape
    d = len(candidate)
    h = np.zeros((steps + 1, n, d), np.float32)
    rz, c = np.empty((steps, n, 2 * d), np.float32), np.empty((steps, n, d), np.float32)
    for t in range(steps):
        g = inputs[x[t]]
        rz[t] = _sigmoid(h[t] @ gates + g[:, : 2 * d])
        c[t] = np.tanh((h[t] * rz[t, :, :d]) @ candidate + g[:, 2 * d :])
        h[t + 1] = h[t] + rz[t, :, d:] * (c[t] - h[t])
    return h, rz, c


def _back(x, weights, h, rz, c, dh_out) -> list[np.ndarray]:
    """Gradients of one direction's weights, given those of its states."""
    inputs, gates, candidate = weights
    steps, n = x.shape
    d = len(candidate)
    grads = [np.zeros_like(w) for w in weights]
    dg = np.empty((steps, n, 3 * d), np.float32)
    dh = np.zeros((n, d), np.float32)
    for t in range(steps - 1, -1, -1):
        dh += dh_out[t]
        r, z = rz[t, :, :d], rz[t, :, d:]
        da = dh * z * (1 - c[t] ** 2)
        drh = da @ candidate.T
        dr, dz = drh * h[t] * r * (1 - r), dh * (c[t] - h[t]) * z * (1 - z)
        drz = np.concatenate([dr, dz], 1)
        grads[2] += (h[t] * r).T @ da
        grads[1] += h[t].T @ drz
        dg[t] = np.concatenate([drz, da], 1)
        dh = dh * (1 - z) + drh * r + drz @ gates.T
    onehot = (x.reshape(-1, 1) == np.arange(256)).astype(np.float32)
    grads[0] = onehot.T @ dg.reshape(-1, 3 * d)
    return grads


def spans_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the spans, bytes in use of each, text of each); the rest of a text's last span is filled with 0."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.zeros(len(owner) * SPAN, np.uint8)
    starts = (np.cumsum(counts) - counts) * SPAN
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    flat[at] = np.frombuffer(b"".join(texts).translate(ONE_SPACE), np.uint8)
    used = np.full(len(owner), SPAN, np.int64)
    ends = np.cumsum(counts) - 1
    used[ends[counts > 0]] = (sizes - (counts - 1) * SPAN)[counts > 0]
    return flat.reshape(-1, SPAN), used, owner


def noise_of(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Every third text with its characters in random order, and of every ninth so many random characters."""
    shuffled = ["".join(rng.permutation(list(t.decode()))) for t in texts[::3]]
    drawn = [rng.integers(33, 127, len(t), dtype=np.uint8).tobytes() for t in texts[::9]]
    return [*(t.encode() for t in shuffled), *drawn]


def train(texts: list[bytes], labels: list[str], batch: int = 48, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit a network: Adam on the cross entropy of every position, all classes weighted alike."""
    names = sorted(set(labels))
    languages = tuple(names)
    rng = np.random.default_rng(seed)
    noise = noise_of(texts, rng)
    texts, labels, names = [*texts, *noise], [*labels, *[UNKNOWN] * len(noise)], [*names, UNKNOWN]
    epochs = max(1, min(MAX_EPOCHS, TRAIN_BYTES // max(1, sum(map(len, texts)))))
    new = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    params = [w for _ in range(2) for w in (new(256, 3 * WIDTH, scale=0.3), new(WIDTH, 2 * WIDTH, scale=0.3), new(WIDTH, WIDTH, scale=0.3))]
    params += [new(2 * WIDTH, len(names), scale=0.3), np.zeros(len(names), np.float32)]
    spans, used, owner = spans_of(texts)
    # the noise comes last, also if a language has the name of the unknown
    y = np.array([len(languages) if k >= len(texts) - len(noise) else languages.index(x) for k, x in enumerate(labels)])[owner]
    share = np.bincount(y, minlength=len(names)) / max(1, len(y))
    weight = (1 / np.maximum(share, 1e-9) / len(names)).astype(np.float32)
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(spans))
        for low in range(0, len(order), batch):
            pick = order[low : low + batch]
            x, target = spans[pick].T, y[pick]
            live = (np.arange(SPAN)[:, None] < used[pick]).astype(np.float32)
            f = _read(x, *params[:3])
            b = _read(x[::-1], *params[3:6])
            states = np.concatenate([f[0][1:], b[0][1:][::-1]], 2)
            dl = _softmax(states @ params[6] + params[7], 2)
            dl[:, np.arange(len(pick)), target] -= 1
            dl *= (live * weight[target] / max(1, live.sum()))[:, :, None]
            dh = dl @ params[6].T
            grads = [*_back(x, params[:3], *f, dh[:, :, :WIDTH]), *_back(x[::-1], params[3:6], *b, dh[::-1, :, WIDTH:])]
            grads += [states.reshape(-1, 2 * WIDTH).T @ dl.reshape(-1, len(names)), dl.sum((0, 1))]
            step += 1
            now = rate * (1 - (epoch + low / len(order)) / epochs)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(languages, tuple(params[:3]), tuple(params[3:6]), params[6], params[7])


def _states(x: np.ndarray, weights: tuple[np.ndarray, ...], out: np.ndarray, backward: bool) -> None:
    """All states of spans x (steps, spans) into out (steps, WIDTH, spans); columns are spans."""
    inputs, gates, candidate = (np.ascontiguousarray(w.T) for w in weights)
    d = len(candidate)
    h = np.zeros((d, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1) if backward else range(len(x)):
        g = inputs.take(x[t], 1)
        rz = gates @ h
        rz += g[: 2 * d]
        rz *= 0.5
        np.tanh(rz, rz)
        rz *= 0.5
        rz += 0.5
        c = candidate @ (h * rz[:d])
        c += g[2 * d :]
        np.tanh(c, c)
        c -= h
        c *= rz[d:]
        h = np.add(h, c, out[t])


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over its positions of the label probabilities of each text (texts, languages and noise); zeros for an empty text."""
    spans, used, owner = spans_of(texts)
    total = np.zeros((len(texts), len(net.languages) + 1))
    w_f, w_b = (np.ascontiguousarray(w.T) for w in (net.out[:WIDTH], net.out[WIDTH:]))
    for low in range(0, len(spans), SPANS_AT_ONCE):
        x = np.ascontiguousarray(spans[low : low + SPANS_AT_ONCE].T)
        f, b = np.empty((2, SPAN, WIDTH, x.shape[1]), np.float32)
        _states(x, net.forward, f, False)
        _states(x, net.backward, b, True)
        logits = w_f @ f
        logits += w_b @ b
        logits += net.bias[:, None]
        np.exp(logits, logits)
        live = np.arange(SPAN)[:, None] < used[low : low + SPANS_AT_ONCE]
        logits *= (live / logits.sum(1))[:, None]
        np.add.at(total, owner[low : low + SPANS_AT_ONCE], logits.sum(0).T)
    sizes = np.array([max(1, len(t)) for t in texts])
    return total / sizes[:, None]


def _within(rows: list, most: int) -> list:
    """The first of ``rows`` whose sizes sum up to ``most`` bytes; one at least."""
    total = 0
    for k, r in enumerate(rows):
        total += r.size
        if total > most and k:
            return rows[:k]
    return rows


def fit(docs: DataFrame, trainable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """Train on the SAMPLE_DOCS documents with the smallest hash of their id and, of each language, on the LEAST_DOCS with the smallest; fewer where their texts exceed SAMPLE_BYTES."""
    key = F.xxhash64(F.col(id_col), F.lit(1))
    usable = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.octet_length(text_col) <= SAMPLE_TEXT_BYTES))
    usable = usable.select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return None
    # a first cut by the hash, so that tasks send about twice the sample in all, however many they are
    total = sum(r.n for r in sizes)
    shares = [(r.lang, max(2 * SAMPLE_DOCS / total, 2 * LEAST_DOCS / r.n)) for r in sizes]
    limits = docs.sparkSession.createDataFrame([(lang, min(2**63 - 1, int(-(2**63) + 2**64 * share))) for lang, share in shares], "lang string, _limit bigint")
    cut = usable.join(F.broadcast(limits), "lang").where("key <= _limit").select("key", "text", "lang")
    cut = cut.withColumn("size", F.octet_length("text"))
    rows = _within(cut.select("key", "size").orderBy("key", "size").limit(SAMPLE_DOCS).collect(), SAMPLE_BYTES)
    picked = cut.where(F.col("key") <= rows[-1].key)
    if len(rows) < total:
        nth = F.row_number().over(W.partitionBy("lang").orderBy("key", "size"))
        rest = cut.where(F.col("key") > rows[-1].key)
        least = cut.select("key", "lang", "size").withColumn("_nth", nth).where((F.col("_nth") <= LEAST_DOCS) & (F.col("key") > rows[-1].key)).collect()
        by_lang = {lang: _within(sorted((r for r in least if r.lang == lang), key=lambda r: r.key), SAMPLE_BYTES // len(sizes)) for lang in {r.lang for r in least}}
        lasts = docs.sparkSession.createDataFrame([(lang, own[-1].key) for lang, own in by_lang.items()], "lang string, _last bigint")
        picked = picked.unionByName(rest.join(F.broadcast(lasts), "lang").where("key <= _last").select(picked.columns))
    rows = sorted(picked.select("key", "text", "lang").collect(), key=lambda r: (r.key, r.text))
    return train([r.text.encode() for r in rows], [r.lang for r in rows])


def _label(net: Network, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(net.languages, object)
        for b in batches:
            texts = b.column(text_at).cast(pa.binary()).to_pylist()
            langs, scores, noise = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high] or b"") <= BYTES_AT_ONCE):
                    size += len(texts[high] or b"")
                    high += 1
                p = probabilities(net, [t or b"" for t in texts[low:high]])
                known = np.array([bool(t) for t in texts[low:high]])
                noise[low:high][known] = np.clip(p[:, -1], 0, 1)[known]
                p = p[:, :-1]
                langs[low:high][known] = names[p.argmax(1)][known]
                scores[low:high][known] = np.clip(p.max(1), 0, 1)[known]
                low = high
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns) if k != text_at), pa.array(langs, pa.string()), pa.array(scores), pa.array(noise)], [*(n for k, n in enumerate(b.schema.names) if k != text_at), "lang_pred", "score", "noise"])

    return run


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and noise."""
    docs = docs.drop(*({"lang_pred", "score", "noise"} & set(docs.columns)))
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "noise": F.lit(0.0)})
    # a text without a letter is not read; whole texts go in as they are
    (lettered,) = free_names(docs, "_lettered")
    seen = docs.withColumn(lettered, F.when(text_or_empty(text_col).rlike(r"\p{L}"), F.col(text_col)))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("noise", T.DoubleType())])
    return seen.mapInArrow(_label(net, len(docs.columns)), schema)
