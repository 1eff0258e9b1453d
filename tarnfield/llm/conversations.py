"""Least-cost repair of conversations to ``(s?(ua)+)?`` by rank-convergence parallel Viterbi.

The messages of a conversation, in order of turn, are kept, given another role (cost 2) or deleted (3, required for blank
and repeated ones), and empty messages of user or assistant may be inserted (2); a truncated message that stays costs 1.
Of the cheapest repairs the one whose audit, the initials of its edits in order, is ASCII-least is made.

Messages are put in order by range partitions and cut into chunks of at most CHUNK neighbours of one conversation, so that
a conversation of any size is spread over tasks. The costs of what follows are a vector over four states (nothing yet, after
s, after u, after a). Each chunk starts from a speculative vector; fix-up passes rerun chunks whose vector differs from the
one its successor gives by more than a constant, and a rerun ends where old and new vectors differ by a constant. With the
backward costs so stitched, chunks are traced forwards, again from a speculative state that fix-up passes mend. The number
of passes is one more than the longest run of chunks through which a difference is carried: usually two.

Edge cases: null roles and texts are one space, null turns come first, null ids are one conversation; messages of one turn
are ordered by role and text (their first 64 characters, then the whole); equal messages of a turn are one row with a count;
an empty table gives an empty result; columns other than the four are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnfield.llm.common import crc32_of_id, stage, unstage

#: Most messages of a chunk, as a power of two.
CHUNK_BITS = 12
WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
NEXT = (2, 2, 3, 2)  #: the state after the one message that may be inserted
ROLE_OF = ("", "", "u", "a")
FINAL = (0, 4, 2, 0)  #: what the inserts after the last message cost
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: Symbols of a message: its role's initial (o: another), in capitals if truncated; digits where it has to go.
FORCED = {"u": "1", "a": "2", "s": "3", "o": "4"}
IS_FORCED = frozenset(FORCED.values())

Vector = tuple[int, ...]


def _options(after: Vector, symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, its cost and that of what follows, the state then) of a message from a state, in ASCII order."""
    role, cut = symbol.lower(), int(symbol.isupper())
    out = [("D", 3 + after[state], state)]
    if state in KEEP[role]:
        out.append(("K", cut + after[KEEP[role][state]], KEEP[role][state]))
    return [*out, ("R", 2 + cut + after[NEXT[state]], NEXT[state])]


@lru_cache(maxsize=100_000)
def _costs(after: Vector, symbol: str) -> Vector:
    """Costs before a message, inserts among them, from those after it."""
    own = [min(cost for _, cost, _ in _options(after, symbol, s)) for s in range(4)]
    return tuple(min(own[s], 2 + own[NEXT[s]], 4 + own[NEXT[NEXT[s]]]) for s in range(4))


@lru_cache(maxsize=100_000)
def before(after: Vector, symbol: str) -> Vector:
    """``_costs`` less their minimum: vectors that differ by a constant are equal so."""
    costs = _costs(after, symbol)
    return tuple(c - min(costs) for c in costs)


@lru_cache(maxsize=100_000)
def _edit(after: Vector, symbol: str, state: int) -> tuple[str, str, int]:
    """(edits, roles they give, state then) of one message: the ASCII-least of the cheapest."""
    costs, edits, roles = _costs(after, symbol), "", ""
    while True:
        found = {e: s for e, cost, s in _options(after, symbol, state) if cost == costs[state]}
        if "D" not in found and 2 + costs[NEXT[state]] == costs[state]:
            state = NEXT[state]
            edits, roles = edits + "I", roles + ROLE_OF[state]
            continue
        edit = min(found)
        state = found[edit]
        return edits + edit, roles + (ROLE_OF[state] if edit == "R" else "-"), state


def run_back(symbols: str, end: Vector, old: Vector | None = None, was: Vector | None = None) -> Vector:
    """The vector before a chunk from that after it. ``old`` gave ``was``: where both ways meet, the rest is known."""
    for symbol in reversed(symbols):
        if old == end:
            return was
        end = before(end, symbol)
        old = before(old, symbol) if old else None
    return end


def trace(symbols: str, end: Vector, state: int) -> list[tuple[str, str, int]]:
    """(edits, roles, state then) of each message of a chunk, from the state before it and the vector after it."""
    after = [end]
    for symbol in reversed(symbols):
        after.append(after[-1] if symbol in IS_FORCED else before(after[-1], symbol))
    out = []
    for symbol, vector in zip(symbols, reversed(after[:-1]), strict=True):
        out.append(("D", "-", state) if symbol in IS_FORCED else _edit(vector, symbol, state))
        state = out[-1][2]
    return out


def _vector(text: str) -> Vector:
    return tuple(map(int, text.split(",")))


def _text(vector: Vector) -> str:
    return ",".join(map(str, vector))


def _rerun_back(x: dict) -> str:
    known = (_vector(x["old"]), _vector(x["made"])) if x["old"] else (None, None)
    return _text(run_back(x["symbols"], _vector(x["given"]), *known))


def _rerun_on(x: dict) -> str:
    return str(trace(x["symbols"], _vector(x["context"]), int(x["given"]))[-1][2])


STATE = "chunk bigint, neighbour bigint, symbols string, context string, given string, made string"


def _runs(rerun: Callable[[dict], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            columns = {n: b.column(n) for n in ("chunk", "neighbour", "symbols", "context", "given")}
            yield pa.RecordBatch.from_pydict(columns | {"made": pa.array([rerun(x) for x in rows], pa.string())})

    return run


def settle(chunks: DataFrame, rerun: Callable[[dict], str], name: str) -> DataFrame:
    """Fix-up passes until each chunk was ``given`` what its ``neighbour`` has ``made``. A pass runs the chunks that change alone."""
    state = stage(chunks.withColumns({"made": F.lit(None).cast("string"), "old": F.lit(None).cast("string")}).mapInArrow(_runs(rerun), STATE), name)
    while True:
        wanted = state.select(F.col("chunk").alias("neighbour"), F.col("made").alias("_wanted"))
        stale = state.join(wanted, "neighbour").where(F.col("given") != F.col("_wanted"))
        redo = stale.select("chunk", "neighbour", "symbols", "context", F.col("_wanted").alias("given"), "made", F.col("given").alias("old"))
        changed = stage(redo.mapInArrow(_runs(rerun), STATE), f"{name}-pass")
        if changed.isEmpty():
            unstage(changed)
            return state
        merged = stage(state.join(changed.select("chunk"), "chunk", "left_anti").unionByName(changed), name)
        unstage(state, changed)
        state = merged


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.to_pylist():
            edits = trace(x["symbols"], _vector(x["given_end"]), int(x["given_start"]))
            state, tail = edits[-1][2], ""
            while x["is_last"] and state not in (0, 3):
                state = NEXT[state]
                tail += ROLE_OF[state]
            last, illegal = x["class_before"], []
            for symbol in x["symbols"].lower().translate(str.maketrans("1234", "uaso")):
                illegal.append(int(last is not None and last + symbol not in ("su", "ua", "au")))
                last = symbol
            n = len(edits)
            yield pa.RecordBatch.from_pydict({
                "_at": pa.array(range(x["chunk"], x["chunk"] + n), pa.int64()), "edits": [e for e, _, _ in edits], "roles": [r for _, r, _ in edits],
                "tail": [""] * (n - 1) + [tail], "illegal": pa.array(illegal, pa.int64()),
            })


@dataclass
class Repair:
    """Tables of a repair."""

    messages: DataFrame  #: conv_id, position, step, edit, times, role, text: a row an edit, in order of position and step; role and text null where deleted
    summary: DataFrame  #: conv_id, gaps, blank, duplicate, truncated, illegal, cost of each conversation


def _placed(messages: DataFrame, ids: tuple[str, str, str, str]) -> DataFrame:
    """Different messages with their count n, fault, symbol and place ``_at``; neighbours of a conversation have neighbouring places."""
    conv, turn, role, text = ids
    own = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    key = F.unhex(F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256))
    own = own.withColumn("_key", key)
    # a message that recurs in a third of all turns: its rows are split by the skew-join of adaptive plans
    firsts = own.groupBy("_key").agg(F.min(F.struct("turn"))["turn"].alias("_first"))
    own = own.join(firsts.hint("merge"), "_key").drop("_key")
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(F.length(ended) == 0, "blank").when(~F.col("turn").eqNullSafe(F.col("_first")), "duplicate").when(~F.right(ended, F.lit(1)).isin(*ENDS), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    forced = F.translate(kind, "".join(FORCED), "".join(FORCED.values()))
    own = own.withColumn("fault", fault).drop("_first")
    own = own.withColumn("symbol", F.when(F.col("fault").isin("blank", "duplicate"), forced).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind))
    order = ["conv_id", "turn", "_role", "_text"]
    own = own.withColumns({"_role": F.substring("role", 1, 64), "_text": F.substring("text", 1, 64)})
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartitionByRange(parts, *order).sortWithinPartitions(*order, "role", "text").drop("_role", "_text")
    return own.withColumn("_at", F.monotonically_increasing_id())


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of each conversation of ``messages``."""
    placed = stage(_placed(messages, (conv, turn, role, text)), "messages")
    block = F.shiftright("_at", CHUNK_BITS)
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "symbol"))), lambda x: x["symbol"]), "")  # of 2 ** CHUNK_BITS rows at most
    chunks = stage(placed.groupBy("conv_id", block.alias("_block")).agg(F.min("_at").alias("chunk"), symbols.alias("symbols")), "chunks")
    # neighbours, from a narrow row for each chunk of a conversation
    choice = F.translate("symbols", "".join(IS_FORCED), "")
    plain = F.translate(F.lower("symbols"), "1234", "uaso")
    narrow = chunks.select("conv_id", "chunk", F.when(F.length(choice) > 0, F.col("chunk")).alias("_own"), F.right(plain, F.lit(1)).alias("_last"))
    on, back = W.partitionBy("conv_id").orderBy("chunk"), W.partitionBy("conv_id").orderBy(F.desc("chunk"))
    linked = narrow.select(
        "chunk", F.last("_own", True).over(on.rowsBetween(W.unboundedPreceding, -1)).alias("_prev"), F.last("_own", True).over(back.rowsBetween(W.unboundedPreceding, -1)).alias("_next"),
        F.lag("_last").over(on).alias("class_before"), F.lead("chunk").over(on).isNull().alias("is_last"),
    )
    linked = stage(chunks.join(linked, "chunk").withColumn("choice", choice), "linked-chunks")
    joined = linked.where((F.length("choice") > 0) & (F.col("_prev").isNotNull() | ~F.col("is_last")))
    ends = settle(joined.select("chunk", F.col("_next").alias("neighbour"), F.col("choice").alias("symbols"), F.lit("").alias("context"), F.lit(_text(FINAL)).alias("given")), _rerun_back, "end-costs")
    vectors = ends.select("chunk", F.col("given").alias("context"))
    starts = joined.join(vectors, "chunk").select("chunk", F.col("_prev").alias("neighbour"), F.col("choice").alias("symbols"), "context", F.when(F.col("_prev").isNull(), "0").otherwise("3").alias("given"))
    starts = settle(starts, _rerun_on, "start-states")
    # chunks of forced deletions alone hand on the state before them
    states = starts.select(F.col("chunk").alias("_prev"), F.col("made").alias("given_start"))
    told = linked.join(vectors.withColumnRenamed("context", "given_end"), "chunk", "left").join(states, "_prev", "left")
    told = told.select("chunk", "symbols", "class_before", "is_last", F.coalesce("given_end", F.lit(_text(FINAL))).alias("given_end"), F.coalesce("given_start", F.lit("0")).alias("given_start"))
    edits = stage(told.mapInArrow(_traced, "_at bigint, edits string, roles string, tail string, illegal bigint"), "edits")
    unstage(chunks, linked, ends, starts)

    whole = placed.join(edits, "_at")
    edit_cost = F.length(F.translate("edits", "KD", "")) * 2 + 3 * F.endswith("edits", F.lit("D")).cast("int") + 2 * F.length("tail") + 3 * (F.col("n") - 1)
    kept_cut = ((F.col("fault") == "truncated") & ~F.endswith("edits", F.lit("D"))).cast("int")
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    is_fault = lambda f: F.coalesce(F.col("fault") == f, F.lit(False))
    sums = whole.groupBy("conv_id").agg(
        count(F.when(is_fault("blank"), F.col("n"))).alias("blank"), count(F.when(is_fault("duplicate"), F.col("n")).when(~is_fault("blank"), F.col("n") - 1)).alias("duplicate"),
        count(F.when(is_fault("truncated"), 1)).alias("truncated"), count(F.col("illegal") + F.col("n") - 1).alias("illegal"), count(edit_cost + F.coalesce(kept_cut, F.lit(0))).alias("cost"),
    )
    turns = placed.groupBy("conv_id", "turn").agg(F.count(F.lit(1)))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    same = gaps.withColumnRenamed("conv_id", "_id")
    summary = sums.join(same, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    name = lambda r: F.when(r == "u", "user").otherwise("assistant")
    step = lambda edit, times, role, text: F.struct(edit.alias("edit"), times.alias("times"), role.alias("role"), text.alias("text"))
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("string")

    def made(i):
        edit, to = F.substring(F.col("edits"), i, F.lit(1)), F.substring(F.col("roles"), i, F.lit(1))
        return step(edit, one, F.when(edit == "K", F.col("role")).when(edit != "D", name(to)), F.when(edit == "I", F.lit("")).when(edit != "D", F.col("text")))

    copies = F.when(F.col("n") > 1, F.array(step(F.lit("D"), F.col("n") - 1, none, none))).otherwise(F.array().cast("array<struct<edit:string,times:bigint,role:string,text:string>>"))
    tail = F.transform(F.filter(F.split("tail", ""), lambda r: r != ""), lambda r: step(F.lit("I"), one, name(r), F.lit("")))
    steps = F.concat(F.transform(F.sequence(F.lit(1), F.length("edits")), made), copies, tail)
    rows = whole.select("conv_id", F.col("_at").alias("position"), F.posexplode(steps).alias("step", "_made")).select("conv_id", "position", "step", "_made.*")
    return Repair(rows, summary)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams messages in order; holds one conversation's audit and the state of its hash."""
    conv, audit, digest, lines = None, [], hashlib.sha256(), 0
    begun = False

    def out():
        return {"conv_id": [conv], "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]}

    for b in batches:
        done = {"conv_id": [], "audit": [], "repaired_sha256": []}
        for x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "edit", "times", "role", "text")), strict=True):
            if begun and x[0] != conv:
                for k, v in out().items():
                    done[k] += v
                audit, digest, lines = [], hashlib.sha256(), 0
            conv, begun = x[0], True
            audit.append(x[1] * x[2])
            if x[1] != "D":
                digest.update((("\n" if lines else "") + f"{x[3]}:{x[4]}").encode())
                lines += 1
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(done["conv_id"], b.schema.field("conv_id").type), "audit": pa.array(done["audit"], pa.string()), "repaired_sha256": pa.array(done["repaired_sha256"], pa.string())})
        kind = b.schema.field("conv_id").type
    if begun:
        last = out()
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(last["conv_id"], kind), "audit": pa.array(last["audit"], pa.string()), "repaired_sha256": pa.array(last["repaired_sha256"], pa.string())})


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256 of its ``role:text`` lines). A hash is one stream by nature: each conversation passes a task in order, unbuffered."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    # the id in its own column, so that no task sorts or compares texts
    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "position", "step").select("conv_id", "edit", "times", "role", "text")
    return ordered.mapInArrow(_digests, f"conv_id {kind}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` after the damage that crc32 of ``conv_id:turn`` (null: a space) modulo 20 does."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = crc32_of_id(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return rows.drop("_copy")
