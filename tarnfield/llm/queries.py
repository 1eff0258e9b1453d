"""Registered queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import align_tokens, conversations, decontaminate, exact_dedup, fit_packing, language_id, language_model, near_dedup, packing, phrase_dedup, sharding, token_count, url_filter
from tarnfield.llm.common import crc32_of_id, text_or_empty

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    crc = F.crc32(F.encode(text_or_empty("text"), "UTF-8"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    judged = index.add(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    index.drop()
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = phrase_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc32_of_id("doc_id") % 5 == 0, F.lit(False)))
    net = language_id.fit(docs, ~F.col("held_out"))
    # only the text goes into the prediction
    return language_id.identify(docs.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(crc32_of_id("doc_id") % 5 == 1, F.lit(False)))
    return language_model.score(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.link_statistics(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = fit_packing.pack_best_fit(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = conversations.repair(conversations.damage(rows))
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    same = F.col("_id").eqNullSafe(F.col("conv_id"))
    out = every.join(done.summary, same, "left").drop("conv_id").join(conversations.digests(done.messages), same, "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_token_counts, op4_url_filter, op5_sharding, op6_exact_dedup, op7_phrase_dedup, op8_language_id, op9_lm_score, op10_packing, op11_token_alignment, op12_best_fit_packing, op13_conversation_repair)}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_DIFFER = "({m} > 0 AND {om} > {m} AND abs(CAST({b} AS DOUBLE) / nullif({m}, 0) - CAST({ob} - {b} AS DOUBLE) / nullif({om} - {m}, 0)) > CAST(1.96 AS DOUBLE) * sqrt(CAST({ob} AS DOUBLE) / nullif({om}, 0) * (1 - CAST({ob} AS DOUBLE) / nullif({om}, 0)) * (CAST(1 AS DOUBLE) / nullif({m}, 0) + CAST(1 AS DOUBLE) / nullif({om} - {m}, 0))))"


def _tree_level(k: int) -> str:
    """SQL of one level of the path-template tree: kids, what becomes of them, and the paths one segment further down."""
    rate, share = _DIFFER.format(b="b", m="m", ob="ab", om="am"), _DIFFER.format(b="l", m="n", ob="al", om="an")
    return f"""
k{k} AS (SELECT host, node, est, segs[{k + 1}] AS seg, count(*) AS n, count(*) FILTER (n_block + n_allow > 0) AS l, sum(n_block) AS b, sum(n_block + n_allow) AS m FROM t{k} WHERE open GROUP BY ALL),
w{k} AS (SELECT *, count(*) OVER w AS kids, sum(n) OVER w AS an, sum(l) OVER w AS al, sum(b) OVER w AS ab, sum(m) OVER w AS am FROM k{k} WINDOW w AS (PARTITION BY host, node)),
g{k} AS (SELECT *, CASE WHEN kids <= 30 THEN seg WHEN NOT (n >= 3 AND ({rate} OR {share})) THEN '*' WHEN seg = '*' THEN '#' ELSE seg END AS gen FROM w{k}),
b{k} AS (SELECT *, (coalesce(sum(CASE WHEN m > 0 THEN CAST(b AS DOUBLE) / m END) OVER w, 0) + 2 * est) / (count(*) FILTER (m > 0) OVER w + 2) AS given FROM (SELECT host, node, est, gen, ab, am, sum(b) AS b, sum(m) AS m FROM g{k} GROUP BY ALL) WINDOW w AS (PARTITION BY host, node)),
f{k} AS (SELECT *, CASE WHEN m > 0 AND am > m AND NOT {rate} THEN '~' ELSE gen END AS fin FROM b{k}),
e{k} AS (SELECT *, (sum(b) OVER w + 2 * given) / (sum(m) OVER w + 2) AS fest FROM f{k} WINDOW w AS (PARTITION BY host, node, fin)),
j{k} AS (SELECT t.*, g.an, e.fin, e.fest, e.given, t.node || '/' || array_to_string(segs[{k + 1}:], '/') AS leaf FROM t{k} t JOIN g{k} g ON t.host = g.host AND t.node = g.node AND segs[{k + 1}] = g.seg JOIN e{k} e ON e.host = g.host AND e.node = g.node AND e.gen = g.gen WHERE t.open),
t{k + 1} AS (SELECT host, path, n_block, n_allow, segs, node || '/' || fin AS node, CASE WHEN len(segs) > {k + 1} THEN given ELSE fest END AS est, len(segs) > {k + 1} AS open FROM j{k} WHERE an > 30
  UNION ALL SELECT host, path, n_block, n_allow, segs, leaf, (sum(n_block) OVER w + 2 * given) / (sum(n_block + n_allow) OVER w + 2), false FROM j{k} WHERE an <= 30 WINDOW w AS (PARTITION BY host, leaf)),"""


def _repair_sql() -> str:
    """SQL of conversation repair: crc32 bit by bit, then the best prefix for each state (e, s, u, a), message by message."""
    crc = "xor(list_reduce(list_transform(range(1, length(at_text) + 1), lambda i: CAST(ascii(substr(at_text, i, 1)) AS BIGINT)), lambda c, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, j: xor(x >> 1, (x & 1) * 3988292384::BIGINT), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def step(state: str, edit: str, cost: str, line: str | None, when: str = "true") -> str:
        more = f" || chr(10) || {line}" if line else ""
        return f"{{'c': {state}.c + {cost} + CASE WHEN {when} THEN 0 ELSE 1000000 END, 'a': {state}.a || '{edit}', 'l': {state}.l{more}}}"

    insert_u = "least(u, " + ", ".join(step(x, "I", "2", "'user:'") for x in "esa") + ")"
    insert_a = f"least(a, {step('u1', 'I', '2', repr('assistant:'))})"
    keep = lambda state, initial: step(state, "K", "w", "role || ':' || text", f"free AND initial = '{initial}'")
    rerole = lambda state, role: step(state, "R", "2 + w", f"'{role}:' || text", "free")
    drop = lambda state: step(state, "D", "3", None)
    none = "{'c': 1000000, 'a': '', 'l': ''}"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS at_text FROM conversations),
b AS (SELECT *, {crc} % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM b WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {white}) AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM o),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, {{'c': 0, 'a': '', 'l': ''}} AS e, {none} AS s, {none} AS u, {none} AS a FROM f
UNION ALL SELECT conv_id, place + 1, {drop("e")}, least({drop("s")}, {keep("e", "s")}), least({drop("u1")}, {", ".join(keep(x, "u") for x in ("e", "s", "a1"))}, {", ".join(rerole(x, "user") for x in ("e", "s", "a1"))}), least({drop("a1")}, {keep("u1", "a")}, {rerole("u1", "assistant")})
FROM (SELECT *, {insert_a} AS a1 FROM (SELECT v.*, {insert_u} AS u1, f.role, f.text, f.initial, CAST(f.fault = 'truncated' AS INT) AS w, f.fault NOT IN ('blank', 'duplicate') AS free FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.place = v.place + 1))),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS place FROM f GROUP BY conv_id),
z AS (SELECT conv_id, place, least(e, {insert_a}) AS best FROM (SELECT *, {insert_u} AS u1 FROM v)),
m AS (SELECT n.*, best FROM n JOIN z ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND n.place = z.place)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN m ON i.conv_id IS NOT DISTINCT FROM m.conv_id"""


_RULE_SQL = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for _, r in sorted(URL_RULES, key=lambda x: -len(x[1])) for h, _, p in [r.partition("/")]) + " END"
_VERDICT_SQL = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in URL_RULES) + " END"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
    "op4_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {_VERDICT_SQL} AS own FROM (SELECT *, {_RULE_SQL} AS rule FROM h)),
c AS (SELECT host, path, count(*) FILTER (own = 'block') AS n_block, count(*) FILTER (own = 'allow') AS n_allow FROM j GROUP BY host, path),
s0 AS (SELECT host, path, n_block, n_allow, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS segs FROM c),
t0 AS (SELECT s0.*, '' AS node, CASE WHEN len(segs) > 0 THEN CAST(0.5 AS DOUBLE) ELSE (sum(n_block) OVER w + 2 * CAST(0.5 AS DOUBLE)) / (sum(n_block + n_allow) OVER w + 2) END AS est, len(segs) > 0 AS open FROM s0 WINDOW w AS (PARTITION BY host, len(segs) > 0)),
{_tree_level(0)}{_tree_level(1)}{_tree_level(2)}{_tree_level(3)}
tree AS ({" UNION ALL ".join(f"SELECT * FROM t{k} WHERE NOT open" for k in range(5))})
SELECT page_id, j.host, j.path, rule, coalesce(own, CASE WHEN est >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, node AS template, round(est, 6) AS purity
FROM j LEFT JOIN tree ON j.host = tree.host AND j.path = tree.path""",
    "op6_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op7_phrase_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w WHERE len(ws) > 12)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS at FROM p JOIN f ON p.s = f.s WHERE first < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w),
k AS (SELECT x.doc_id, count(g.at) AS n, string_agg(word, ' ' ORDER BY x.at) FILTER (g.at IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.at = g.at GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op13_conversation_repair": _repair_sql(),
}
