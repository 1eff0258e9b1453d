"""Token alignment, best-fit packing and conversation repair, each against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tarnfield.llm import align_tokens, conversations, fit_packing, queries  # noqa: E402
from tarnfield.llm.tokens import byte_ids, byte_tokens, merge_ranks, piece_tokens  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n a  b\t\tc ", "it's we'll 12345 ...", "a<|endoftext|>b <|endoftext|>", "x y  z  w", "naïve café ﬁ Σας", "🙂🙂 🇫🇷 é", "\x1c\x1d a\x85b", "<s> </s> ▁ a▁b", "word " * 50, "  lead", "a\r\nb\x0bc\x0c d", "漢字 かな 한글", "\0 \0", "“quoted” – dash…"]
MIX = ["a", "B", "é", " ", "\n", "1", ".", "'s", " ", "<|endoftext|>", "字", "\t", "▁", "the", "  ", "\0"]


def mixed(n, seed, most=60):
    r = random.Random(seed)
    return [*ODD, *("".join(r.choice(MIX) for _ in range(r.randint(0, most))) for _ in range(n))]


def test_whole_text_ids_equal_the_library():
    plain, marked = Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    texts = mixed(1500, 1) + ["The qu-ick brown fox, isn't it? 12 34!! naïve"] * 2
    raw = [t.encode() for t in texts]
    assert merge_ranks(marked)
    for as_text, library in ((False, marked), (True, plain)):
        assert [np.frombuffer(x, "<u4").tolist() for x in byte_ids(BYTES, as_text).encode(raw)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# op11 -----------------------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    """n_a, n_b, groups, links of each text by comparing all end offsets."""
    a_of, b_of = byte_tokens(BYTES), piece_tokens(PIECES)
    tokenizer, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer.encode_special_tokens = True
    out = []
    for t in texts:
        want = b" " + (t or "").encode()
        a, b = tokenizer.encode(want.decode(), add_special_tokens=False).ids, pieces.encode(t or "")
        if not t or b"".join(a_of[x] for x in a) != want or b"".join(b_of[x] for x in b) != want:
            out.append(([], [], "", []))
            continue
        ends_a, ends_b = (np.cumsum([len(v[x]) for x in ids]).tolist() for v, ids in ((a_of, a), (b_of, b)))
        shared, groups, links = sorted(set(ends_a) & set(ends_b)), [], []
        low_a = low_b = 0
        for e in shared:
            i, j = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(f"{','.join(map(str, a[low_a:i]))}|{','.join(map(str, b[low_b:j]))}")
            links.append((a[i - 1], b[j - 1]))
            low_a, low_b = i, j
        out.append((a, b, ";".join(groups), links))
    return out


def test_token_alignment(spark, monkeypatch):
    monkeypatch.setattr(align_tokens, "WINDOWS_AT_ONCE", 7)
    texts = [*mixed(250, 2), None, "the same words", "the same words", " ".join(f"w{k}" for k in range(3000))]
    got = {r.doc_id: r for r in align_tokens.link_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("pairs", F.lit(1)).repartition(5), BYTES, PIECES).collect()}
    want = brute_alignment(texts)
    counts = Counter(x for *_, links in want for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert sorted(got) == list(range(len(texts))) and any(not a for a, *_ in want) and sum(map(len, (w[3] for w in want))) > 3000
    for k, (a, b, groups, links) in enumerate(want):
        row = (len(a), len(b), len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if a else "")
        assert (got[k].n_a, got[k].n_b, got[k].n_groups, got[k].n_links, got[k].n_best, got[k].count_sum, got[k].groups_sha256) == row


def test_windows_split_at_verified_anchors():
    own = align_tokens.Aligner(BYTES, PIECES)
    ((a, b),) = own.encode([b"one two, three-four  five"])
    at_a, at_b = own.windows(a, b)
    for x, y, u, v in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False):
        left, right = (b"".join(t.tokens[i] for i in ids) for t, ids in ((own.a, a[x:y]), (own.b, b[u:v])))
        assert left == right and left.startswith(b" ")
    assert len(at_a) > 3
    first = own.align(a, b)
    met = len(own.seen)
    assert own.align(a, b) == first and len(own.seen) == met > 0  # the second time from memory


def test_recurring_words_are_encoded_once(monkeypatch):
    own, r = align_tokens.Aligner(BYTES, PIECES), random.Random(5)
    words = ["".join(r.choice("abcdeé\n\r") for _ in range(9)) + "z" for _ in range(300)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(100)]
    encode, met = own.encode, []
    monkeypatch.setattr(own, "encode", lambda raw: met.extend(raw) or encode(raw))
    monkeypatch.setattr(align_tokens, "aligner", lambda *_: own)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([t.encode() for t in texts], pa.binary())], ["id", "text"])
    (out,) = align_tokens._align(BYTES, PIECES)(iter([batch]))
    assert [(x, y, g.decode()) for x, y, g in zip(*(out.column(k).to_pylist() for k in (1, 2, 4)), strict=True)] == [(len(a), len(b), g) for a, b, g, _ in brute_alignment(texts)]
    assert sum(map(len, met)) < sum(map(len, texts)) / 10


@pytest.mark.parametrize("bound", [0, 40])
def test_windows_cut_in_texts_equal_whole_ones(monkeypatch, bound):
    monkeypatch.setattr(align_tokens, "UNITS", bound)
    monkeypatch.setattr(align_tokens, "UNITS_AT_ONCE", 5)
    own, texts = align_tokens.Aligner(BYTES, PIECES), mixed(1500, 3) + ["a\r\n b\r c\r", ">\r\n\r {\r}", "\n x\n", "x \n ", "\r", "end\n\n"]
    assert own.units is not None
    for low in range(0, len(texts), 50):
        some = texts[low : low + 50]
        got = [(x, y, g.decode(), np.frombuffer(p, "<u8").tolist()) for x, y, g, p in own.documents([t.encode() for t in some])]
        assert got == [(len(a), len(b), g, [x * len(own.b.tokens) + y for x, y in links]) for a, b, g, links in brute_alignment(some)]
        assert len(own.units) <= bound


def test_linked_bytes_end_alike(spark):
    """What bounds the broadcast table of pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    aligned = align_tokens.align_documents(docs, BYTES, PIECES)
    a_of, b_of = byte_tokens(BYTES), piece_tokens(PIECES)
    pairs = align_tokens.pair_counts(aligned, len(b_of)).collect()
    assert pairs and all(a_of[r.a].endswith(b_of[r.b]) or b_of[r.b].endswith(a_of[r.a]) for r in pairs)


def test_alignment_of_an_empty_table(spark):
    out = align_tokens.link_statistics(spark.createDataFrame([], "doc_id bigint, text string"), BYTES, PIECES)
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]


# op12 -----------------------------------------------------------------------------------------------------------------


def brute_bins(lengths, size):
    """Best-fit decreasing over single items."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(size - x)
    return len(rooms)


def test_plan_equals_best_fit_of_items():
    r = random.Random(3)
    for _ in range(300):
        size = r.choice([1, 5, 16, 64, 100])
        items = [r.randint(1, size) if r.random() < 0.7 else r.choice([1, size, size // 2 + 1]) for _ in range(r.randint(1, 120))]
        patterns = fit_packing.fit_counts(Counter(items), size)
        held = Counter()
        for bins, contents in patterns:
            held.update({length: bins * each for length, each in contents})
        assert held == Counter(items) and sum(bins for bins, _ in patterns) == brute_bins(items, size)
        runs, ranks, nth = fit_packing.plan_runs(patterns), [], Counter()
        for x in items:
            ranks.append(nth[x])
            nth[x] += 1
        check_bins(zip(items, *(x.tolist() for x in fit_packing.take_slots(runs, np.array(items), np.array(ranks))), strict=True), size)


def check_bins(pieces, size):
    bins = defaultdict(list)
    for length, sequence, offset in pieces:
        bins[sequence].append((offset, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_best_fit_packing(spark):
    r = random.Random(4)
    texts = [*mixed(120, 5), None, None, "", *(" ".join(r.choice(["the", "naïve", "foo"]) for _ in range(n)) for n in (15, 16, 17, 31, 32, 33, 200)), *["same text of a group"] * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("piece", F.lit("mine")).repartition(6)
    rows = fit_packing.pack_best_fit(docs, BYTES, max_length=16).collect()
    tokenizer, pieces = Tokenizer.from_file(BYTES), defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append(x)
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[k], key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own))) and [i for x in own for i in np.frombuffer(x.ids, "<u4").tolist()] == ids
        assert [x.start for x in own] == np.cumsum([0, *(x.length for x in own)]).tolist()[:-1] and all(x.length == 16 for x in own[1:]) and (len(ids) > 16 or len(own) == 1)
    bins = check_bins(((x.length, x.sequence_id, x.offset) for x in rows), 16)
    assert bins == brute_bins([x.length for x in rows], 16)


def test_best_fit_packing_of_the_given_table(spark):
    rows = queries.op12_best_fit_packing(spark, SF).collect()
    bins = check_bins(((x.length, x.sequence_id, x.offset) for x in rows), 1024)
    assert bins <= -(-sum(x.length for x in rows) // 1024) + 1  # no plan has two fewer
    assert fit_packing.pack_best_fit(spark.createDataFrame([], "doc_id bigint, text string"), BYTES).count() == 0
    with pytest.raises(ValueError, match="65536"):
        fit_packing.pack_best_fit(spark.createDataFrame([], "doc_id bigint, text string"), BYTES, max_length=0)


# op13 -----------------------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """One conversation's result from its damaged (turn, role, text) in order: all cheapest edit strings by state."""
    seen, blank, duplicate, truncated = set(), 0, 0, 0
    best = {"": (0, "", ())}  # state: "", s, u, a -> cost, audit, lines

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def follow(state):
        return "a" if state == "u" else "u"

    def inserts(table):
        for _ in range(2):
            for state, (cost, audit, lines) in list(table.items()):
                to = follow(state)
                better(table, to, (cost + 2, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[to])))

    for _, role, text in rows:
        body = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
        inserts(best)
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            w, first = int(fault == "truncated"), role[:1]
            if (first == "s" and state == "") or (first == "u" and state != "u") or (first == "a" and state == "u"):
                better(after, first, (cost + w, audit + "K", (*lines, f"{role}:{text}")))
            to = follow(state)
            better(after, to, (cost + 2 + w, audit + "R", (*lines, f"{'user' if to == 'u' else 'assistant'}:{text}")))
        best = after
    inserts(best)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    turns = {t for t, *_ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    """(conv, turn, role, text) rows with the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, *rest in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])):
        groups[conv].append(tuple(rest))
    return groups


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows):
    return {r.conv_id: tuple(r[c] for c in RESULT) for r in rows}


@pytest.mark.parametrize("bits", [12, 1])
def test_conversation_repair(spark, tmp_path, monkeypatch, bits):
    """Random conversations with nulls, ties, odd roles and repeats; chunks of two messages make fix-up passes necessary."""
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    r = random.Random(bits)
    texts = ["Hi.", "Yes!", "cut off", "", " \n", "Why?", None, "More. \t", "x" * 100 + ".", "y. z"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "sage", ""]
    rows = [(c if c else None, r.choice([k, k, k, None, k - 1]), r.choice(roles), r.choice(texts) if r.random() < 0.7 else f"t{k}.") for c in range(60) for k in range(r.randint(1, 14))]
    rows += [(77, 5, "user", "Same."), (77, 5, "user", "Same."), (77, 6, "assistant", "A.")] + [(78, k, "user", "Same.") for k in range(40)] + [(79, k, "assistant", "") for k in range(9)]
    rows += [(80, k, "user" if k % 2 else "assistant", f"n{k}.") for k in range(301)] + [(81, None, "user", "a.")]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n", F.lit("extra")).repartition(5).write.parquet(str(tmp_path / "t/conversations.parquet"))
    got = repaired(queries.op13_conversation_repair(spark, str(tmp_path / "t")).collect())
    groups = by_conversation(damaged(rows))
    assert set(got) == {c for c, *_ in rows}
    for conv, result in got.items():
        assert result == brute_repair(groups.get(conv, [])), conv
    if bits != 1:
        return
    # the operator's own messages are of the asked form
    done = conversations.repair(conversations.damage(spark.read.parquet(str(tmp_path / "t/conversations.parquet"))))
    kept = defaultdict(str)
    for m in sorted(done.messages.where("edit != 'D'").collect(), key=lambda m: (m.position, m.step)):
        kept[m.conv_id] += m.role[:1]
    assert kept and all(re.fullmatch("s?(ua)+", x) for x in kept.values())


def test_conversation_repair_of_the_given_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = by_conversation(damaged(rows))
    assert repaired(queries.op13_conversation_repair(spark, SF).collect()) == {c: brute_repair(groups.get(c, [])) for c in {x[0] for x in rows}}


def test_conversation_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_conversation_repair(spark, str(tmp_path)).count() == 0


def test_reruns_end_where_vectors_meet():
    r = random.Random(9)
    for _ in range(300):
        symbols = "".join(r.choice("uasoUASO") for _ in range(r.randint(1, 30)))
        old, new = (tuple(x - min(v) for x in v) for v in ([r.randint(0, 5) for _ in range(4)] for _ in range(2)))
        was = conversations.run_back(symbols, old)
        assert conversations.run_back(symbols, new, old, was) == conversations.run_back(symbols, new)
