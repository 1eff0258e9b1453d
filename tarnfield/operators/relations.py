"""Relations between tables: coverage, candidates, new keys, symbols, combinations and reachability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnfield.staging import fresh_name, shared_folder, staged

#: Rows of a table that may go out by broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, with a broadcast hint if it has no more than SMALL rows; this reads so many rows at most."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def coverage_gap(left: DataFrame, right: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """One row: n_missing, different left keys that the right table lacks, and the first few of them."""
    gap = left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")
    some = gap.orderBy(key).limit(samples).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("samples"))
    return gap.agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(F.broadcast(some))


def cooldown_candidates(pool: DataFrame, history: DataFrame, keys: Sequence[str], used_at: str, now: str, minutes: int, per: Sequence[str] = (), n: int | None = None, order: str | None = None) -> DataFrame:
    """Candidates whose key was not used within ``minutes`` of ``now``; unreadable times do not count. Then the first ``n`` per ``per`` in pool order."""
    since = F.to_timestamp(F.lit(now)) - F.make_dt_interval(mins=F.lit(minutes))
    when = F.try_to_timestamp(F.col(used_at)) if dict(history.dtypes)[used_at] == "string" else F.col(used_at).cast("timestamp")
    recent = history.where(when > since).select(*keys).distinct()
    free = pool.join(recent, list(keys), "left_anti")
    if n is None:
        return free
    return free.withColumn("_nth", F.row_number().over(W.partitionBy(*per).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")


def new_keys(results: DataFrame, stored: DataFrame, seeded: DataFrame, key: str, search: str, order: Sequence[str]) -> DataFrame:
    """Per search: results and new keys, those neither stored nor seeded; a key counts for the first search that found it."""
    fresh = results.where(F.col(key).isNotNull()).join(stored.select(key).distinct(), key, "left_anti").join(seeded.select(key).distinct(), key, "left_anti")
    first = fresh.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_nth = 1").groupBy(search).agg(F.count(F.lit(1)).alias("n_new"))
    return results.groupBy(search).agg(F.count(F.lit(1)).alias("n_results")).join(first, search, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))


def resolve_symbols(symbols: DataFrame, names: DataFrame, c: str, name: str, key: str, everywhere: str = "global") -> DataFrame:
    """(c, resolved): digits as they are, ``everywhere`` as null, else the id of the name, case ignored; unknown names go."""
    text = F.lower(F.trim(F.col(c).cast("string")))
    ids = names.groupBy(F.lower(F.trim(F.col(name))).alias("_name")).agg(F.min(key).cast("bigint").alias("_id"))
    joined = symbols.withColumn("_text", text).join(ids, F.col("_text") == F.col("_name"), "left")
    digits = F.col("_text").rlike("^[0-9]+$")
    out = joined.where(digits | (F.col("_text") == everywhere) | F.col("_id").isNotNull())
    return out.select(c, F.when(digits, F.col("_text").try_cast("bigint")).when(F.col("_text") == everywhere, F.lit(None)).otherwise(F.col("_id")).alias("resolved"))


def pairwise_segments(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every row of tables of ranges alone and with every row of each other table (the product is the result); missing columns are null."""
    names = list(tables)
    parts = [tables[n] for n in names]
    for i, a in enumerate(names):
        parts += [tables[a].crossJoin(small(tables[b])) for b in names[i + 1 :]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _bucketed(df: DataFrame, by: str, buckets: int, name: str) -> str:
    """A new external table of the session's catalog with ``df``, bucketed by a column; its files are in the shared folder."""
    made = fresh_name(name)
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).format("parquet")  # hashes like the buckets: a file each
    writer.option("path", f"{shared_folder(df.sparkSession)}/{made}").saveAsTable(made)
    return made


def frontier_round(by_group: DataFrame, by_member: DataFrame, frontier: DataFrame, reached: DataFrame, member: str, group: str) -> DataFrame:
    """Groups that share a member with ``frontier`` and are not ``reached``. Both tables of edges are read by their buckets: the frontier and its members alone are shuffled."""
    members = by_group.join(frontier, group, "left_semi").select(member).distinct()
    return by_member.join(members, member, "left_semi").select(group).distinct().join(reached, group, "left_anti")


def expand_frontier(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, member: str = "member", group: str = "group", buckets: int | None = None) -> DataFrame:
    """(group, round): groups reached from ``seeds`` over shared members, with the round that reached them (seeds 0).

    Rounds go on until one finds no new group, or for ``rounds`` of them; they run at once. The different edges are written
    twice, bucketed by group and by member, and what is reached is appended to a third table, bucketed by group. Choose
    ``buckets`` so that a bucket fits a task; it defaults to the number of shuffle partitions. Null members connect nothing.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    by_group = _bucketed(edges, group, buckets, "edges_by_group")
    by_member = _bucketed(spark.table(by_group), member, buckets, "edges_by_member")
    frontier = staged(seeds.select(group).distinct().withColumn("round", F.lit(0)), "frontier")
    kind = dict(frontier.dtypes)[group]
    reached, k = _bucketed(frontier, group, buckets, "reached"), 0
    found = spark.table(reached)
    while rounds is None or k < rounds:
        k += 1
        new = frontier_round(spark.table(by_group), spark.table(by_member), frontier.select(group), spark.table(reached).select(group), member, group)
        frontier = staged(new.select(F.col(group).cast(kind).alias(group), F.lit(k).alias("round")), "frontier")
        if frontier.isEmpty():
            break
        frontier.repartition(buckets, group).write.bucketBy(buckets, group).format("parquet").mode("append").saveAsTable(reached)
    found = spark.read.schema(found.schema).parquet(f"{shared_folder(spark)}/{reached}")
    for table in (by_group, by_member, reached):  # the files stay in the shared folder
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return found
