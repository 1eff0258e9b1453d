"""Decontamination, URL filter, language ID."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.llm import common, decontaminate, language_id, url_filter
from tarnfield.llm.queries import URL_RULES


def edit_distance(a, b):
    """Least distance of ``a`` from any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_myers_against_dynamic_programming():
    r = random.Random(4)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 60))) + a[r.randrange(len(a)) :] + "".join(r.choice("abc") for _ in range(20))
        limit, best = r.randint(0, 20), edit_distance(a, b)
        got = decontaminate.myers(a, b, limit)
        assert (got and got[0]) == (best if best <= limit and b else None)


def mutate(text, n, r):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        t[k : k + 1] = r.choice([[], ["z"], [t[k], "q"]])
    return "".join(t)


def test_items_within_budget_are_found(spark):
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(300)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(15, 40)))) for k in range(12)]
    docs, expected = [], set()
    for d in range(80):
        text = " ".join(r.choice(words) for _ in range(60))
        if d % 2:
            k, item = r.choice(items)
            text = text + " " + mutate(item, int(len(item) * 0.06) // 2 if d % 4 == 1 else 0, r) + "\n" + text
            expected.add((d, k))
        docs.append((d, text.upper() if d % 5 == 0 else text))
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(x.doc_id, x.item_id): x.distance for x in out.collect()}
    brute = {}
    for d, t in docs:
        for k, i in items:
            limit = decontaminate.budget(len(decontaminate.normalised(i)), 0.06, 24)
            if (best := edit_distance(decontaminate.normalised(i), decontaminate.normalised(t))) <= limit:
                brute[d, k] = best
    assert set(got) == set(brute) >= expected and all(got[x] >= brute[x] for x in got)


def test_decontaminate_edge_cases(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a much longer item of a benchmark"), (4, "a much longer item of a benchmark")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "it is short.", 3), (4, "it is short indeed", 4), (5, "x A much\nlonger  item of a benchmarc " + "y " * 50_000, 5), (None, "clean", 6)], "doc_id bigint, text string, item_id int")
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(r.item_id for r in clean.collect()) == [1, 2, 3, 6]
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(4, 3, 0), (5, 4, 1), (5, 4, 1)]  # the item that is there twice is told twice
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 6


def test_items_that_share_an_id(spark):
    items = spark.createDataFrame([(1, "first text of the item number one"), (1, "second text of the same item here")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so first text of the item number one so second text of the same item here"), (2, "only second text of the same item here")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.item_chars) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1, 33), (1, 1, 33), (2, 1, 33)]


def test_one_piece_repeated_through_a_long_text():
    """Hits of a piece without the rest of its item are tried once per place, in linear time."""
    item = "abcdefghij " * 2 + "the end of it all is never reached"
    items = ((1, item, 3),)
    assert decontaminate.find_items(item[: len(item) // 4] * 20_000, items, decontaminate.piece_automaton(items)) == {}


def test_large_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    items = spark.createDataFrame([(k, f"benchmark item number {k} with some words in it") for k in range(20)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"so benchmark item number {k} with some words in it so") for k in range(15, 20)] + [(99, "nothing")], "doc_id bigint, text string")
    out = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).where("distance = 0").collect()}
    assert out == {(k, k) for k in range(15, 20)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [99]


URLS = [
    (1, "https://Sub.Example.COM/en/1", "sub.example.com", "/en/1", "com/en/", "block"),
    (2, "https://sub.example.com/en/71?x=/", "sub.example.com", "/en/71", "example.com/en/7", "allow"),
    (3, "http://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"),
    (4, "http://b.example.net/de/80#t", "b.example.net", "/de/80", "example.net/de/8", "block"),
    (5, "http://notexample.net/de/80", "notexample.net", "/de/80", "net/de/", "allow"),
    (6, "x://org", "org", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "http://q.org?a=/es/", "q.org", "", None, "allow"),
    (10, "a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u, *_ in URLS], "page_id bigint, url string, host string")
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES).collect())
    assert out == [(i, *rest) for i, _, *rest in URLS]
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_templates_reject_by_purity(spark):
    """A host's variable branch of which nearly all labelled pages are blocked is rejected as a whole; wide nodes become wildcards."""
    rules = [("block", f"spam.org/ads/item{k}") for k in range(10, 60)]
    pages = [(k, f"http://spam.org/ads/item{k}/view") for k in range(10, 99)] + [(k, f"http://spam.org/docs/page-{k}") for k in range(100, 130)] + [(k, f"http://wiki.org/{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}/x") for k in range(200, 280)]
    out = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), rules).collect()}
    assert all(out[k].verdict == "block" and out[k].template == "/ads/*/view" for k in range(10, 99))
    # one labelled branch, however many urls it has, does not reject its siblings
    assert all(out[k].verdict == "allow" and out[k].template == "/docs/*" and abs(out[k].purity - 2 / 3) < 1e-9 for k in range(100, 130))
    kept = url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), [*rules, *(("allow", f"spam.org/docs/page-{k}") for k in range(100, 120))]).collect()
    assert all(r.verdict == "allow" for r in kept if 100 <= r.page_id < 130)  # labels of its own count for more
    assert all(out[k].template == "/*/x" for k in range(200, 280))


def test_templates_follow_the_labels(spark):
    """Sections with labels of their own stay apart in wide nodes at every depth; long paths are no common template."""
    two = lambda k: chr(97 + k % 26) + chr(97 + k // 26)
    pages = [(k, f"http://a.com/en/{k}") for k in range(40)]  # blocked by rule
    pages += [(100 + k, f"http://a.com/{two(k)}/{k}") for k in range(100)]  # many other sections, no label
    pages += [(300 + k, f"http://b.net/w/x/y/bad/{two(k)}/view") for k in range(60)]
    pages += [(400 + k, f"http://b.net/w/x/y/good/{two(k)}/view") for k in range(60)]
    pages += [(500 + k, f"http://b.net/w/x/y/{two(k)}{k}/z") for k in range(40)] + [(600, "http://b.net/w/x/y/bad/new/view")]
    pages += [(700 + k, f"http://c.org/{k}") for k in range(40)] + [(800 + k, f"http://c.org/{two(k)}") for k in range(40)]
    rules = [("block", "a.com/en/")] + [("block", f"b.net/w/x/y/bad/{two(k)}") for k in range(50)] + [("allow", f"b.net/w/x/y/good/{two(k)}") for k in range(50)]
    rules += [("block", f"c.org/{k}") for k in range(1, 10)]
    out = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), rules).collect()}
    assert len(out) == len(pages)
    assert all(out[k].verdict == "block" and out[k].template == "/en/*" for k in range(40))
    # no label of their own: what one blocked branch of the host says
    assert all(out[k].template == "/*/*" and out[k].verdict == "allow" and abs(out[k].purity - 2 / 3) < 1e-9 for k in range(100, 200))
    assert all(out[k].verdict == "block" and out[k].template == "/w/x/y/bad/*/view" for k in [*range(300, 360), 600])
    assert all(out[k].verdict == "allow" and out[k].template == "/w/x/y/good/*/view" for k in range(400, 460))
    assert all(out[k].verdict == "allow" and out[k].template == "/w/x/y/*/z" for k in range(500, 540))
    assert out[700].template == "/#" and out[700].verdict == "block"
    assert all(out[k].template == "/*" and out[k].verdict == "allow" for k in range(800, 840))


def test_estimates_come_from_branches_above(spark):
    """What labelled branches say reaches their siblings, each once; alike branches merge at every level."""
    two = lambda k: chr(97 + k % 26) + chr(97 + k // 26)
    pages = [(k, f"http://h.org/a/x/{two(k)}/{k}") for k in range(40)]  # all blocked
    pages += [(100 + k, f"http://h.org/a/y/{two(k)}") for k in range(5)]  # no label
    pages += [(200 + k, f"http://h.org/b/z/{k}") for k in range(40)]  # all allowed
    pages += [(300 + k, f"http://h.org/b/w/{two(k)}") for k in range(5)]  # no label
    pages += [(400 + k, f"http://h.org/c/{k}") for k in range(5)]  # no label
    pages += [(500 + k, f"http://m.org/s{'xyz'[k % 3]}/p/{two(k // 3)}") for k in range(60)]  # three sections alike
    rules = [("block", "h.org/a/x/"), ("allow", "h.org/b/z/")] + [("block", f"m.org/s{'xyz'[k % 3]}/p/{two(k // 3)}") for k in range(30)]
    out = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), rules).collect()}
    host = (1 + 0 + 2 * 0.5) / (2 + 2)
    a, b = (1 + 2 * host) / 3, 2 * host / 3
    for first, template, purity, verdict in ((100, "/a/y", a, "allow"), (300, "/b/w", b, "allow")):
        assert all(out[first + k].template == f"{template}/{two(k)}" and abs(out[first + k].purity - purity) < 1e-9 and out[first + k].verdict == verdict for k in range(5))
    assert all(out[400 + k].template == "/c/*" and abs(out[400 + k].purity - host) < 1e-9 and out[400 + k].verdict == "allow" for k in range(5))
    assert {out[500 + k].template.split("/")[1] for k in range(60)} == {"~"}


def test_repeated_urls_and_a_large_host(spark, monkeypatch):
    """Repeated urls count as often as they occur; nothing depends on how large keys are looked up."""
    pages = [(k, f"http://one.net/p/{k % 40}") for k in range(400)] + [(1000 + k, f"http://h{k}.net/q/{k}") for k in range(60)]
    rules = [("block", "one.net/p/1"), ("block", "net/q/1")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    get = lambda: sorted((r.page_id, r.template, r.purity, r.verdict) for r in url_filter.filter_urls(frame, rules).collect())
    plain = get()
    monkeypatch.setattr(common, "LIGHT", 3)
    assert get() == plain
    labelled = 11 * 10  # /p/1 and /p/10 to /p/19, ten times each
    given = (1 + 2 * (1 + 2 * 0.5) / 3) / 3
    assert next(x for x in plain if x[0] == 0)[2] == pytest.approx((labelled + 2 * given) / (labelled + 2))


def test_several_branches_reject_one_without_labels(spark):
    """Three sections whose labels agree reject a fourth without any; two do not."""
    for blocked, verdict in ((2, "allow"), (3, "block")):
        pages = [(k, f"http://q.org/s{'uvw'[k % blocked]}/{k}") for k in range(60)] + [(100 + k, f"http://q.org/sx/{k}") for k in range(5)]
        rules = [("block", f"q.org/s{x}/") for x in "uvw"[:blocked]]
        out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), rules).where("page_id >= 100").collect()
        assert {r.verdict for r in out} == {verdict}


WORDS = {"en": "the and of with house water people think", "fr": "le la et avec maison été où garçon", "de": "der und mit haus wässer straße größe nicht"}


def sample(n, seed):
    r = random.Random(seed)
    return [(k, lang, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(4, 60)))) for k in range(n) for lang in [r.choice(list(WORDS))]]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    weights = [rng.normal(size=s).astype(np.float64) * 0.5 for s in ((256, 3 * language_id.WIDTH), (language_id.WIDTH, 2 * language_id.WIDTH), (language_id.WIDTH, language_id.WIDTH))]
    x = rng.integers(0, 256, (7, 3)).astype(np.uint8)
    up = rng.normal(size=(7, 3, language_id.WIDTH))
    loss = lambda: float((language_id._read(x, *weights)[0][1:].astype(float) * up).sum())
    grads = language_id._back(x, weights, *language_id._read(x, *weights), up.astype(np.float32))
    for w, g in zip(weights, grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape) if w.shape[0] != 256 else (x[0, 0], rng.integers(0, w.shape[1]))
            old, h = w[at], 1e-2
            w[at] = old + h
            high = loss()
            w[at] = old - h
            low = loss()
            w[at] = old
            assert abs((high - low) / (2 * h) - g[at]) < 2e-2


def test_language_accuracy_and_edge_cases(spark):
    data = sample(400, 1)
    docs = spark.createDataFrame([(k, t, lang) for k, lang, t in data], "doc_id bigint, text string, lang string")
    net = language_id.fit(docs, F.col("doc_id") < 300)
    out = language_id.identify(docs.drop("lang"), net).collect()
    truth = {k: lang for k, lang, _ in data}
    held = [r for r in out if r.doc_id >= 300]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    odd = [(1, None), (2, ""), (3, "123 — 456"), (4, "le garçon " * 30_000), (5, "ü"), (None, "the water and the people")]
    got = language_id.identify(spark.createDataFrame(odd, "doc_id bigint, text string").withColumn("score", F.lit("clash")), net).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == "fr" and got[4].lang_pred in WORDS and all(0 <= r.score <= 1 for r in got) and got[0].score == 0
    assert language_id.identify(docs.limit(0), net).count() == 0
    assert language_id.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_rare_languages_are_learned(spark, monkeypatch):
    """A language with few labelled documents is in the sample, whatever the number of others."""
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 100)
    monkeypatch.setattr(language_id, "LEAST_DOCS", 60)
    samples = []
    fitted = language_id.train
    monkeypatch.setattr(language_id, "train", lambda texts, labels: samples.append(labels) or fitted(texts, labels))
    r = random.Random(6)
    word = {"en": WORDS["en"].split(), "xx": "qzu kvok zzyk wqo xuqz kwyz".split()}
    data = [(k, " ".join(r.choice(word[lang]) for _ in range(30)), lang) for k in range(4000) for lang in ["xx" if k % 100 == 7 else "en"]]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    net = language_id.fit(docs, F.col("doc_id") < 3900)
    assert samples[0].count("xx") == 39 and 61 <= samples[0].count("en") <= 100
    held = language_id.identify(docs.where("doc_id >= 3900"), net).collect()
    assert all(x.lang_pred == x.lang for x in held)


def brute_probabilities(net, text):
    """Position by position in plain loops: a GRU in each direction over spans of SPAN bytes, softmax, mean."""
    sig = lambda x: 1 / (1 + np.exp(-x))

    def read(span, weights):
        inputs, gates, candidate = (w.astype(float) for w in weights)
        d, h, out = len(candidate), np.zeros(len(candidate)), []
        for x in span:
            r, z = sig(h @ gates[:, :d] + inputs[x, :d]), sig(h @ gates[:, d:] + inputs[x, d : 2 * d])
            h = (1 - z) * h + z * np.tanh((r * h) @ candidate + inputs[x, 2 * d :])
            out.append(h)
        return out

    total = np.zeros(len(net.languages) + 1)
    text = text.translate(language_id.ONE_SPACE)
    for at in range(0, len(text), language_id.SPAN):
        span = text[at : at + language_id.SPAN]
        padded = span + bytes(language_id.SPAN - len(span))
        for f, b in list(zip(read(padded, net.forward), read(padded[::-1], net.backward)[::-1], strict=True))[: len(span)]:
            logits = np.exp(np.concatenate([f, b]) @ net.out + net.bias)
            total += logits / logits.sum()
    return total / len(text)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Whole texts are drawn until the bytes are used up, and each language has its share."""
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 20_000)
    drawn = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels: drawn.append((texts, labels)))
    rows = [(k, "word " * 600, "en") for k in range(300)] + [(1000 + k, "mot " * 50, "fr") for k in range(9)]
    language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    texts, labels = drawn[0]
    assert sum(map(len, texts)) <= 2 * 20_000 and set(labels) == {"en", "fr"} and {len(t) for t in texts} == {3000, 200}


def test_cost_of_a_document_does_not_follow_the_items(spark):
    """The automaton of 100,000 items is built once a task."""
    items = tuple((k, f"item number {k} of a very long list", 0) for k in range(100_000))
    automaton = decontaminate.piece_automaton(items)
    began = time.perf_counter()
    for k in range(2000):
        decontaminate.find_items(f"text {k} without any", items, automaton)
    assert time.perf_counter() - began < 1


def test_probabilities_against_plain_loops():
    data = sample(60, 3)
    net = language_id.train([t.encode() for _, _, t in data], [lang for _, lang, _ in data])
    texts = [t.encode() for _, _, t in data[:8]] + ["größe 東京".encode(), b"x", b"\x00\xff" * 70, b"a\nb\tc"]
    got = language_id.probabilities(net, texts)
    assert np.allclose(got, [brute_probabilities(net, t) for t in texts], atol=1e-4) and np.allclose(got.sum(1), 1, atol=1e-5)


def test_noise_is_told_from_languages(spark):
    data = sample(400, 1)
    docs = spark.createDataFrame([(k, t, lang) for k, lang, t in data], "doc_id bigint, text string, lang string")
    net = language_id.fit(docs, F.lit(True))
    r = random.Random(2)
    junk = [(k, "".join(r.sample(t, len(t)))) for k, _, t in sample(40, 5) if len(t) > 80] + [(900, "".join(chr(r.randint(33, 126)) for _ in range(400)) + "a")]
    assert all(x.noise > 0.5 for x in language_id.identify(spark.createDataFrame(junk, "doc_id bigint, text string"), net).collect())
    clean = spark.createDataFrame([(k, t) for k, _, t in sample(100, 7)], "doc_id bigint, text string")
    assert all(x.noise < 0.5 and 0 <= x.score <= 1 for x in language_id.identify(clean, net).collect())


def test_spans_cover_every_byte():
    texts = [b"", b"a" * 64, b"b" * 65, b"", b"c"]
    spans, used, owner = language_id.spans_of(texts)
    assert used.sum() == 130 and list(owner) == [1, 2, 2, 4]
    assert b"".join(bytes(s[:u]) for s, u in zip(spans, used, strict=True)) == b"".join(texts)
