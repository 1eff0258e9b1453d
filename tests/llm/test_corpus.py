"""Token counts, sharding, language-model scores, packing and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tarnfield.llm import language_model, packing, sharding, token_count, tokens  # noqa: E402
from tarnfield.llm.common import crc32_of_id  # noqa: E402
from tarnfield.llm.tokens import UnitCounts, UnitIds, load  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a  b\t\tc ", "it's we'll 12345 ...", "a<|endoftext|>b <|endoftext|>", "x\u00a0y \u2003z\u2028 w", "naïve café ﬁ Σας İstanbul", "🙂🙂 🇫🇷 e\u0301\u0323", "\x1c\x1d a\x85b", "don't  'S <|startoftext|>", "word " * 50 + " ", "  lead", "a\r\nb\x0bc\x0c d", "漢字 かな 한글", "\u3000全角\u3000空白"]


def docs_of(spark, texts, schema="doc_id bigint, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def test_units_equal_the_library():
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "B", "é", " ", "\n", "1", ".", "'s", "\u00a0", "<|endoftext|>", "字", "\t", "\u2009", "\x1f"]) for _ in range(r.randint(0, 80))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    assert UnitCounts(BYTES).count(raw) == [len(load(BYTES).encode(t, add_special_tokens=False)) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in UnitIds(PIECES).encode(raw)] == [load(PIECES).encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_encoded_whole(spark):
    """Units are cut only where the vocabulary is known to have a boundary."""
    r = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(r.choice(["a", "B", "é", " ", "\n", "1", "字"]) for _ in range(60)) for _ in range(50)]
    raw = [t.encode() for t in texts]
    assert UnitCounts(BYTES).units and not UnitCounts(PIECES).units and UnitIds(PIECES).words and not UnitIds(BYTES).words
    assert UnitCounts(PIECES).count(raw) == [len(load(PIECES).encode(t, add_special_tokens=False)) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in UnitIds(BYTES).encode(raw)] == [load(BYTES).encode(t, add_special_tokens=False).ids for t in texts]
    long = [" ".join(texts) * 3, "x"]
    out = token_count.count_tokens(docs_of(spark, long).withColumn("_row", F.lit("mine")), PIECES, huge=100).collect()
    assert {x.doc_id: (x.n_tokens, x._row) for x in out} == {k: (len(load(PIECES).encode(t, add_special_tokens=False)), "mine") for k, t in enumerate(long)}


def test_memory_is_bounded_in_bytes(monkeypatch):
    seen = tokens.Memory()
    monkeypatch.setattr(tokens, "MEMORY", 3)
    find = lambda new: [len(u) for u in new]
    for units in ([b"a", b"bb"], [b"c" * 100, b"a"], [b"d", b"e", b"bb"]):
        assert {u: seen.recall(units, find)[u] for u in units} == {u: len(u) for u in units}
    assert len(seen) == 3 and max(map(len, seen)) == 2


def test_token_counts_by_chunks(spark):
    r = random.Random(2)
    texts = [*ODD, None, " ".join(r.choice(["the", "naïve", "foo-bar", "12", "\n", "  ", "字"]) for _ in range(3000)), "x" * 2500, "ab " * 900, ("y" * 900 + " ") * 4, " " * 3000]
    out = token_count.count_tokens(docs_of(spark, texts).withColumn("n_bytes", F.lit("clash")), BYTES, limit=100, huge=600, chunk=200, overlap=16).collect()
    for x in out:
        t = texts[x.doc_id] or ""
        n = len(load(BYTES).encode(t, add_special_tokens=False))
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len(t.encode()), n, n > 100)
    assert len(out) == len(texts)
    assert token_count.count_tokens(docs_of(spark, ["a"]).limit(0), BYTES).count() == 0


def test_shards_are_even_and_gapless(spark):
    r = random.Random(3)
    texts = ["same " * 40 if k % 3 == 0 else "t" * r.randint(0, 900) + str(k % 50) for k in range(1200)] + [None, ""]
    out = sharding.shard_by_bytes(docs_of(spark, texts).withColumn("slot", F.lit("clash")), shards=7).toPandas()
    assert len(out) == len(texts) and (out["size"] == [len((t or "").encode()) + 8 for t in out.text]).all()
    total = out.groupby("shard")["size"].sum()
    assert set(total.index) == set(range(7)) and total.max() - total.min() <= 2 * 910
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    spread = out.assign(text=out.text.fillna("")).groupby("text").shard.nunique()
    assert (spread.drop("same " * 40) > 1).sum() <= 6


def test_parts_and_large_texts_are_split(spark, monkeypatch):
    """Shards of several parts, a text that fills parts by itself and columns with internal names: the same shards, gapless slots."""
    r = random.Random(5)
    texts = ["same " * 40 if k % 3 == 0 else "t" * r.randint(0, 300) + str(k) for k in range(1500)]
    docs = docs_of(spark, texts)
    plain = {x.doc_id: x.shard for x in sharding.shard_by_bytes(docs, shards=5).collect()}
    monkeypatch.setattr(sharding, "PART_BYTES", 6000)
    out = sharding.shard_by_bytes(docs.withColumns({"_hash": F.lit("mine"), "_AT": F.lit(7)}), shards=5)
    assert out.columns == ["doc_id", "text", "_hash", "_AT", "size", "shard", "slot"]
    got = out.toPandas()
    assert dict(zip(got.doc_id, got.shard, strict=True)) == plain and set(got._hash) == {"mine"}
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    parts = sharding.shard_by_bytes(docs, shards=5).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("size").alias("n")).collect()
    assert len(parts) > 20 and max(x.n for x in parts) < 4 * 6000


def test_splitters_against_sorting(spark):
    """Probing finds cuts of the sorted rows, each as near its goal as the tolerance asks or as rows allow."""
    r = random.Random(6)
    rows = sorted((r.choice([5, r.randrange(-(2**62), 2**62)]), k, r.randint(8, 500)) for k in range(900))
    cuts, below = sharding.find_splitters(spark.createDataFrame(rows, "hash bigint, id bigint, size bigint"), 9)
    total, largest = sum(x[2] for x in rows), max(x[2] for x in rows)
    for k, (cut, n) in enumerate(zip(cuts, below, strict=True), 1):
        under = [x for x in rows if x[:2] < cut]
        assert len(under) == n and abs(sum(x[2] for x in under) - total * k // 9) <= max(largest, total / 9 * 0.005)


def test_shard_edge_cases(spark):
    few = sharding.shard_by_bytes(spark.createDataFrame([(1, "a"), (None, None), (1, "a"), (1, "a")], "doc_id bigint, text string"), shards=5)
    assert few.count() == 4 and {r.shard for r in few.collect()} <= set(range(5))
    assert sharding.shard_by_bytes(docs_of(spark, ["a"]).limit(0), shards=3).count() == 0


def test_piece_lengths():
    for n in (1, 2, 1023, 2047, 2048, 2049, 5000):
        got = packing.piece_lengths(n, 2048)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)


def test_packing_round_trip(spark):
    texts = [*ODD, None, "the quick brown fox " * 300, "the quick brown fox " * 300]
    out = packing.pack(docs_of(spark, texts).repartition(3), PIECES, max_length=64).toPandas()
    assert sorted(out.sequence_id) == list(range(len(out))) and (out.offset == 0).all() and (out.ids.map(len) == 4 * out.length).all()
    assert out.sort_values("sequence_id").length.is_monotonic_decreasing
    for doc, g in out.sort_values("start").groupby("doc_id"):
        ids = np.frombuffer(b"".join(g.ids), "<u4").tolist()
        assert ids == [*load(PIECES).encode(texts[doc] or "", add_special_tokens=False).ids, 1] and (g.doc_tokens == len(ids)).all()
        assert list(g.start) == list(np.cumsum(g.length) - g.length)
    assert packing.pack(docs_of(spark, ["a"]).limit(0), PIECES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, ["a"]), PIECES, max_length=100)


def lm_texts(n=300, seed=6):
    """Two languages of a few words each: the words before tell a lot of the next."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"{'ab'[k % 2]}{j}" for j in range(30)]
        out.append(" ".join(r.choice(words) for _ in range(40)) + (f" rare{k}." if k % 7 == 0 else ""))
    return [*out, None, "", "Never Seen", "A1 a1"]


def test_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 50)
    monkeypatch.setattr(language_model, "KNOWN", 70)
    texts = lm_texts()
    docs = docs_of(spark, texts).withColumn("held_out", crc32_of_id("doc_id") % 5 == 1).withColumn("score", F.lit("clash"))
    out = language_model.score(docs, ~F.col("held_out")).toPandas().sort_values("doc_id").reset_index(drop=True)
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    c = Counter(w for k, ws in enumerate(tokens) if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    total, types = sum(c.values()), len(c)
    for k, ws in enumerate(tokens):
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        assert (out.n_tokens[k], out.n_known[k], out.train_tokens[k]) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert abs(out.base_score[k] - base) < 1e-6 and out.score[k] < 0
    held = out[out.held_out & (out.doc_id < 300)]
    assert held.score.sum() > held.base_score.sum()


def test_probabilities_are_normalised():
    model = language_model.fresh(np.arange(1.0, 31.0))
    tables = language_model._tables("test", model.flat().astype(np.float32).tobytes(), 30)
    w = np.arange(30)
    for a, b in ((0, 0), (3, 17), (29, 5)):
        assert abs(np.exp(language_model.log_probabilities(tables, w, np.full(30, a), np.full(30, b))).sum() - 1) < 1e-4


def test_vocabulary_shares_sum_to_one():
    """Tokens share their symbol's probability; a rare class leaves the share of one unseen token."""
    counts = {b"the": 50, b"of": 31, b"a.": 9, b"b.": 8, b"xy": 8, b"zz": 2, "é".encode(): 1}
    forms = Counter(language_model.shape(t) for t in counts)
    rare = Counter({language_model.shape(b"q"): 5})  # five more tokens, each once, that are not known
    sums = {k: (sum(c for t, c in counts.items() if language_model.shape(t) == k) + rare[k], forms[k] + rare[k]) for k in {*forms, *rare}}
    end = language_model.shape(language_model.END)
    sums[end] = (sums.get(end, (0, 0))[0] + 20, sums.get(end, (0, 0))[1] + 1)
    v = language_model.Vocabulary([language_model.END, *counts], np.array([20, *counts.values()]), sum(c for c, _ in sums.values()), sum(n for _, n in sums.values()), sums)
    assert v.weights.sum() == v.total and len(v.weights) == v.rare + language_model.SHAPES
    for head in (3, 100):
        v.head = head
    shares = Counter()
    for s, x in zip(v.symbols, v.in_class, strict=True):
        shares[s] += 10**x
    assert all(abs(x - 1) < 1e-9 for x in shares.values())
    k = language_model.shape(b"q")
    assert abs(5 * 1.5 / v.rare_below[k] + 0.5 / v.rare_below[k] - 1) < 1e-9


def brute_lm(text, v, model):
    """Log10 probability by the definition, a softmax over all symbols for each token."""
    index = {t: k for k, t in enumerate(v.tokens)}
    symbols = [int(v.symbols[index[t]]) if t in index else v.rare + language_model.shape(t) for t in [*text.lower().encode().split(), language_model.END]]
    one = two = v.end
    total = 0.0
    for s, t in zip(symbols, [*text.lower().encode().split(), language_model.END], strict=True):
        logits = (model.R[one] @ model.A + model.R[two] @ model.B) @ model.Q.T + model.bias
        total += (logits[s] - np.log(np.exp(logits).sum())) / np.log(10) + (v.in_class[index[t]] if t in index else np.log10(0.5 / v.rare_below[language_model.shape(t)]))
        one, two = s, one
    return total


def test_score_does_not_depend_on_partitions(spark, monkeypatch):
    """The same score for 1 and 64 input partitions, in any order; equal to the definition; better than the base on held-out texts."""
    for name, value in (("HEAD", 60), ("KNOWN", 200), ("SHARD_TOKENS", 400), ("BATCH", 256), ("CHUNK", 1024)):
        monkeypatch.setattr(language_model, name, value)
    kept = []
    fitted = language_model.train
    monkeypatch.setattr(language_model, "train", lambda s, v: kept.append((v, fitted(s, v))) or kept[-1][1])
    docs = docs_of(spark, [*lm_texts(), "zebra never seen " * 3]).withColumn("held_out", crc32_of_id("doc_id") % 5 == 1)
    got = []
    for parts in (1, 64):
        rows = language_model.score(docs.orderBy(F.rand(parts)).repartition(parts), ~F.col("held_out")).collect()
        got.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows})
    assert kept[0][0].total >= 2 * language_model.ROUNDS * 400
    for k, x in got[0].items():
        assert x[:2] == got[1][k][:2] and x[2:] == pytest.approx(got[1][k][2:], rel=1e-6)
    vocabulary, model = kept[0]
    k = len(lm_texts())
    if zlib.crc32(str(k).encode()) % 5 == 1:
        assert got[0][k][3] == pytest.approx(brute_lm("zebra never seen " * 3, vocabulary, model), rel=1e-4)
    for k, text in enumerate(lm_texts()[:20]):
        if all(t in vocabulary.tokens for t in (text or "").lower().encode().split()):
            assert got[0][k][3] == pytest.approx(brute_lm(text or "", vocabulary, model), rel=1e-4)


def test_very_long_texts_are_scored_and_packed_whole(spark):
    long = " ".join(f"w{k % 700}" for k in range(60_000))
    docs = docs_of(spark, [long, "w1 w2 w3", None])
    scored = {r.doc_id: r for r in language_model.score(docs, F.lit(True)).collect()}
    assert (scored[0].n_tokens, scored[0].n_known, scored[0].train_tokens) == (60_001, 60_001, 60_006) and math.isfinite(scored[0].score)
    c = Counter([*long.split(), "w1", "w2", "w3", *[None] * 3])
    base = sum(math.log10((c[w] + 0.5) / (60_006 + 0.5 * (len(c) + 1))) for w in [*long.split(), None])
    assert scored[0].base_score == pytest.approx(base)
    out = packing.pack(docs, PIECES).where("doc_id = 0").orderBy("start").collect()
    ids = [x for r in out for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    assert ids == [*load(PIECES).encode(long, add_special_tokens=False).ids, 1] and [r.length for r in out] == packing.piece_lengths(len(ids), 2048)


def test_contexts_do_not_cross_texts():
    one, two = language_model.contexts(np.array([5, 6, 9, 9, 7, 9]), 9, np.array([2, 3, 5]))
    assert one.tolist() == [9, 5, 6, 9, 9, 7] and two.tolist() == [9, 9, 5, 9, 9, 9]


def test_empty_corpus_is_scored(spark):
    assert language_model.score(docs_of(spark, ["a"]).limit(0), F.lit(True)).count() == 0
    only = language_model.score(docs_of(spark, ["a b", None]), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(only, key=lambda r: r.doc_id)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in only)


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(9)
    words = {"en": "the and of with house water people think road green".split(), "fr": "le la et avec maison été où garçon château fenêtre".split()}
    docs = []
    for k in range(120):
        lang = "en" if k % 2 else "fr"
        docs.append((k, " ".join(r.choice(words[lang]) + str(r.randrange(300)) for _ in range(60)), lang, "s", 1))
    docs += [(200, docs[3][1], "en", "s", 1), (201, docs[3][1].replace(" ", "\n"), "en", "s", 1), (202, docs[5][1] + " more", "en", "s", 1), (203, "1234 5678", "en", "s", 1), (204, None, None, None, None)]
    item = "what is the answer to this benchmark question about houses"
    docs += [(205, docs[7][1] + " " + item + " " + docs[9][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == columns
            kept.append({x.doc_id for x in now.collect()})
    gone = [set(range(120)) | {200, 201, 202, 203, 204, 205}, *kept]
    assert [a - b for a, b in zip(gone, kept, strict=False)] == [{203, 204}, {200, 201}, {202}, {205}]
    assert {x.doc_id for x in now.collect()} == kept[-1]
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_language_stage_rejects_noise(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 2]  # nothing to learn from
    r = random.Random(4)
    words = "der und mit haus wässer straße größe nicht".split()
    text = lambda: " ".join(r.choice(words) for _ in range(80))
    rows = [(k, text(), "de") for k in range(300)] + [(1000 + k, "".join(r.sample(t, len(t))), None) for k in range(20) for t in [text()]]
    kept = {x.doc_id for x in corpus_pipeline.known_language(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "").collect()}
    assert kept == set(range(300))
