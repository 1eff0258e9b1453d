"""Documents, tables, relations, presets, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tarnfield import functions as fn
from tarnfield.operators import features, relations, select
from tarnfield.plans import datasets, schemas
from tarnfield.sources import documents as io
from tarnfield.sources import tables as tio
from tarnfield.streaming import state


def write(folder, files):
    folder.mkdir(parents=True)
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture
def raw(tmp_path):
    clan = {"tag": "#C1", "name": "one", "clanLevel": 5, "warWins": 6, "warLosses": 3, "warTies": 1, "isFamilyFriendly": True, "warLeague": {"name": "Gold", "id": 7}, "location": {"id": 32, "name": "X"}}
    write(tmp_path / "clans", {"#C1": clan, "bad": "{invalid json", "list": [1], "empty": {"tag": ""}})
    member = lambda t, r, n: {"tag": t, "role": r, "trophies": n, "clanRank": n % 10, "league": {"id": 1, "name": "L"}, "donations": n}
    write(tmp_path / "members", {"#C1": {"items": [member("#P1", "leader", 100), member("#P2", "member", 200), member("#P1", "again", 1)]}, "#C2": {"items": []}})
    troop = [{"name": "A", "level": 8, "maxLevel": 10, "village": "home"}, {"name": "A", "level": 1, "maxLevel": 10, "village": "home"}, {"name": "B", "level": 1, "maxLevel": 0, "village": "home"}]
    write(tmp_path / "players", {"#P1": {"tag": "#P1", "trophies": 100, "bestTrophies": 200, "donations": 9, "donationsReceived": 0, "troops": troop, "heroes": ["odd", {"name": "H"}], "achievements": [{"name": "x", "value": 3, "target": 2}], "clan": {"tag": "#C1", "clanLevel": 5}}, "#P3": {"tag": "#P3", "trophies": "text"}})
    return tmp_path


def test_scans(spark, rows, raw):
    good, bad = io.read_documents(spark, str(raw / "clans"))
    assert rows(good, "key_from_file") == [("#C1",), ("empty",)]
    assert rows(bad, "key_from_file", "reason") == [("bad", "corrupt"), ("list", "not an object")]
    texts = spark.createDataFrame([('[{"a":1},2,{"a":3}]',), ('{"a":4}',), ("{",)], "value string")
    many, corrupt = io.parse_documents(texts, lenient=True)
    assert rows(io.flatten(many, {"a": ("$.a", "bigint")})) == [(1,), (3,), (4,)] and corrupt.count() == 1
    shapes = spark.createDataFrame([("i", '{"items":[{"tag":"1"}]}'), ("o", '{"tag":"2"}'), ("e", '{"items":[]}'), ("x", "{}")], "key_from_file string, value string")
    docs, rejected = io.parse_documents(shapes)
    items = io.member_items(docs)
    assert rows(items.where("item is not null").select("key_from_file", io.get("item", "$.tag", "string").alias("t"))) == [("i", "1"), ("o", "2")]
    assert rows(io.file_counters(docs, rejected, items)) == [("corrupt", 0), ("empty", 2), ("read", 4), ("valid", 4)]


def test_tables_from_documents(spark, rows, raw, tmp_path):
    tables, gaps = datasets.build_tables(spark, str(raw), str(tmp_path / "out"))
    assert set(tables) == {"clans", "clan_members", "players", "player_troops", "player_heroes", "player_hero_equipment", "player_spells", "player_achievements"}
    assert [len(tables[t].columns) for t in ("clans", "clan_members", "players", "player_troops", "player_achievements")] == [21, 17, 18, 5, 6]
    c = tables["clans"].first()
    assert tables["clans"].count() == 1 and (c.clan_level, c.location_name, c.war_league, c.capital_league, c.is_family_friendly) == (5, "X", '{"id": 7, "name": "Gold"}', None, True)
    assert rows(tables["clan_members"], "clan_tag", "player_tag", "role") == [("#C1", "#P1", "leader"), ("#C1", "#P2", "member")]
    assert rows(tables["player_troops"], "troop_name", "level") == [("A", 8), ("B", 1)] and tables["player_heroes"].count() == 0 and tables["player_spells"].count() == 0
    assert rows(tables["players"], "player_tag", "trophies") == [("#P1", 100), ("#P3", None)]
    assert rows(gaps["players"].select("n_missing", F.array_join("samples", ","))) == [(1, "#P2")] and gaps["clans"].first().n_missing == 0
    tables, _ = datasets.build_tables(spark, str(raw), str(tmp_path / "out"))  # a rebuild replaces all files
    assert tables["players"].count() == 2
    features = {r.player_tag: r for r in datasets.player_features(tables).collect()}
    p = features["#P1"]
    assert (p.troop_count, p.troop_mean_level, p.troop_mean_completion_ratio, p.donation_ratio, p.progression_ratio_trophies, p.achievement_completion_ratio) == (2.0, 4.5, 0.8, 0.0, 0.5, 1.5)
    assert len(datasets.player_features(tables).columns) == 33 and features["#P3"].troop_count == 0.0


def test_datasets(spark, rows, raw, tmp_path):
    t, _ = datasets.build_tables(spark, str(raw), str(tmp_path / "out"))
    players = datasets.player_features(t)
    role = datasets.role_dataset(t, players)
    assert rows(role, "player_tag", "trophies_diff_from_clan_mean", "war_stars", "clan_level", "role") == [("#P1", -50.0, 0.0, 5, "leader"), ("#P2", 50.0, None, 5, "member")]
    assert len(role.columns) == 66 and role.columns[-1] == "role" and "clan_rank" not in role.columns
    rank = datasets.rank_datasets(t, players)
    assert len(rank["with_trophies"].columns) == 87 and len(rank["without_trophies"].columns) == 79
    assert rank["with_trophies"].count() == 1 and "role" not in rank["with_trophies"].columns and not any(c.startswith("trophies") for c in rank["without_trophies"].columns)
    war = datasets.war_dataset(t, players)
    w = war.first()
    assert (w.member_count, w.war_success_rate, w.std_trophies, w.war_frequency) == (2, 0.6, 0.0, "unknown") and "war_wins" not in war.columns and len(war.columns) == 51
    assert datasets.war_dataset(t, players, 11).count() == 0
    with pytest.raises(tio.ContractError):
        datasets.war_dataset(t, players.unionByName(players))
    rates = spark.createDataFrame([(f"#{k}", k / 10, 1.0) for k in range(10)], "clan_tag string, war_success_rate double, win_rate double")
    classed, counts = datasets.class_dataset(rates, 0.4, 0.6)
    assert sorted(r.performance_class for r in classed.collect()) == ["high"] * 4 + ["low"] * 4 + ["medium"] * 2 and classed.columns == ["clan_tag", "performance_class"]
    with pytest.raises(tio.ContractError):
        datasets.class_dataset(rates.unionByName(rates))
    matrix, report = datasets.clustering_dataset(players)
    assert matrix.columns == ["player_tag", *schemas.CLUSTER_FEATURES] and len(matrix.columns) == 31 and report.first().n_rows == 2


def test_contracts_and_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(tio.ContractError):
        tio.require_unique(df, ["k"])
    with pytest.raises(tio.ContractError):
        tio.require_columns(df, ["k", "none"])
    tio.write_tables({"t": df.limit(0), "u": df}, str(tmp_path))
    assert tio.read_table(spark, f"{tmp_path}/t.parquet", ["v"]).count() == 0
    with pytest.raises(tio.ContractError):
        tio.read_table(spark, f"{tmp_path}/u.parquet", keys=["k"])
    assert rows(tio.append_new(df, spark.createDataFrame([("a",)], "v string"), ["v"])) == [(1, "b")]
    (tmp_path / "log.json").write_text(json.dumps([{"location_id": "3", "filters": {"minMembers": 5, "x": None}, "used_at": "2026-01-01T00:00:00", "results": 2, "new_clans": 1}]))
    log = tio.read_history(spark, f"{tmp_path}/log.json", {"minMembers": "min_members"})
    assert rows(log.select(fn.map_fingerprint("filters").alias("f"))) == [("min_members=5",)]
    tio.append_history(log, f"{tmp_path}/new")
    tio.write_report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(" P1 ", "", None, "#C9__x"), ("#P2", None, "#F", "y"), ("", "#N", None, "z"), (None, None, None, None)], "t string, nested string, flat string, file string")
    out = df.select(fn.normalize_tag("t"), fn.fallback_key("nested", "flat", "file"), fn.composite_key("t", "flat")).collect()
    assert [tuple(r) for r in out] == [("#P1", "#C9", " P1 |None"), ("#P2", "#F", "#P2|#F"), (None, "#N", "|None"), (None, None, None)]


def test_relations(spark, rows):
    pool = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "loc int, f string").withColumn("o", F.col("f"))
    used = spark.createDataFrame([(1, "a", "2026-01-01T12:00:00+00:00"), (1, "b", "2025-12-01T00:00:00"), (2, "a", "no time")], "loc int, f string, used_at string")
    free = relations.cooldown_candidates(pool, used, ["loc", "f"], "used_at", "2026-01-01T13:00:00", 120, ["loc"], 1, "o")
    assert rows(free, "loc", "f") == [(1, "b"), (2, "a")]
    found = spark.createDataFrame([("s1", "k1", 1), ("s1", "k2", 2), ("s2", "k2", 3), ("s2", "k3", 4), ("s3", "old", 5), ("s3", None, 6)], "s string, k string, o int")
    assert rows(relations.new_keys(found, spark.createDataFrame([("old",)], "k string"), spark.createDataFrame([("k3",)], "k string"), "k", "s", ["o"])) == [("s1", 2, 2), ("s2", 2, 0), ("s3", 2, 0)]
    names = spark.createDataFrame([("France", 7)], "n string, id bigint")
    assert rows(relations.resolve_symbols(spark.createDataFrame([("12",), ("GLOBAL",), (" france ",), ("nowhere",)], "x string"), names, "x", "n", "id")) == [(" france ", 7), ("12", 12), ("GLOBAL", None)]
    one = lambda c, n: spark.range(n).select(F.col("id").alias(c))
    assert relations.pairwise_segments({"m": one("m", 5), "l": one("l", 4), "p": one("p", 6)}).count() == 89
    edges = spark.createDataFrame([("g1", "a"), ("g2", "a"), ("g2", "b"), ("g3", "b"), ("g4", "z")], "`group` string, member string")
    assert rows(relations.expand_frontier(edges, spark.createDataFrame([("g1",)], "`group` string"), 5)) == [("g1", 0), ("g2", 1), ("g3", 2)]


def test_frontier_runs_to_its_end(spark, rows):
    """A chain longer than any guess of rounds, a ring, a null group: each with the breadth-first round of plain Python."""
    pairs = [(k, f"m{k + j}") for k in range(9) for j in (0, 1)] + [(20, "x"), (21, "x"), (21, "y"), (20, "y"), (None, "m0"), (3, None), (30, None)]
    reached, frontier = {0: 0}, {0}
    while frontier:
        members = {m for g, m in pairs if g in frontier and m}
        frontier = {g for g, m in pairs if m in members and g is not None} - set(reached)
        reached |= dict.fromkeys(frontier, max(reached.values()) + 1)
    assert max(reached.values()) == 8
    edges = spark.createDataFrame(pairs, "`group` int, member string")
    seeds = spark.createDataFrame([(0,)], "`group` int")
    assert rows(relations.expand_frontier(edges, seeds)) == sorted(reached.items(), key=repr)
    assert rows(relations.expand_frontier(edges, seeds, 2)) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_frontier_query_equals_sql(spark, rows):
    import duckdb

    from tarnfield import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = rows(queries.QUERIES["expand_frontier_to_end"](spark, sf))
    assert found and found == sorted(db.sql(queries.ORACLE_SQL["expand_frontier_to_end"]).fetchall(), key=repr)


def test_stream_state_equals_batch(spark, rows, tmp_path):
    lines = spark.createDataFrame([(f"#{k % 5}", k % 9, k % 4) for k in range(100)], "k string, level bigint, max_level bigint")
    lines.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(state.state_writer("k", "level", "max_level", f"{tmp_path}/state")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    from tarnfield.operators.features import child_aggregate

    whole = rows(child_aggregate(lines, "k", "x", "level", "max_level"))
    assert rows(state.read_features(spark, f"{tmp_path}/state", "k", "x")) == whole
    state.compact(spark, f"{tmp_path}/state", f"{tmp_path}/small", "k")
    assert rows(state.read_features(spark, f"{tmp_path}/small", "k", "x")) == whole


def test_canonical_json(spark):
    values = [{"b": [1, {"y": None, "x": 'é "q", a: b \\ 😀'}], "a": {"d": True, "c": "x,y:z"}, "n": -3}, {}, [1, "a, b", []], None]
    df = spark.createDataFrame([(k, json.dumps(v) if v is not None else None) for k, v in enumerate(values)], "k int, v string")
    got = {r.k: r.j for r in df.select("k", fn.canonical_json(F.parse_json("v")).alias("j")).collect()}
    assert got == {k: json.dumps(v, sort_keys=True) if v is not None else None for k, v in enumerate(values)}


def test_written_datasets(spark, rows, raw, tmp_path):
    t, _ = datasets.build_tables(spark, str(raw), str(tmp_path / "out"))
    made = datasets.build_datasets(t, str(tmp_path / "sets"), 0.4, 0.7)
    assert set(made) == {"player_features", "role_classification", "clan_rank_with_trophies", "clan_rank_without_trophies", "proxy_audit", "war_performance", "performance_classification", "player_clustering"}
    assert {n: len(made[n].columns) for n in ("player_features", "role_classification", "war_performance", "player_clustering")} == {"player_features": 33, "role_classification": 66, "war_performance": 51, "player_clustering": 31}
    assert spark.read.parquet(str(tmp_path / "sets" / "role_classification.parquet")).count() == made["role_classification"].count() == 2


def test_checks_of_datasets(spark, rows):
    with pytest.raises(tio.ContractError, match="clan_rank"):
        select.require_absent(spark.createDataFrame([(1, 2)], "a int, clan_rank int"), ["clan_rank", "role"])
    rates = spark.createDataFrame([(0.5,), (2.0,), (None,)], "r double")
    with pytest.warns(UserWarning, match="2 rows"):
        assert features.require_rates(rates, "r").count() == 1
    with pytest.raises(tio.ContractError, match="no row"):
        features.require_rates(rates.where("r > 1"), "r")
    left, right = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3, 4)], "k int, x int, y int")
    assert select.join_suffixed(left, right, ["k"], "_player").columns == ["k", "x", "x_player", "y"]
    found = select.column_difference(left, right.unionByName(right.withColumn("y", F.lit(None).cast("int"))))
    assert rows(found) == [("y", "right", 1)]


def test_canonical_json_of_long_and_deep_values(spark):
    """Strings of a million characters and a hundred nested levels: no stack and no entry for each character."""
    deep = 1
    for _ in range(100):
        deep = {"k": [deep, "a,b:c"]}
    values = ["x" * 1_000_000, {"b": 1, "a": "é, " * 100_000}, deep, {"c": ["é", "日本🙂", None, True, 1.5], "a": 'x, y: "q" \\ z'}, [], {}, "", "\x7f\x80", 'a\\"b,c:d']
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string").select("k", fn.canonical_json(F.parse_json("t")).alias("j"))
    assert {r.k: r.j for r in df.collect()} == {k: json.dumps(v, sort_keys=True) for k, v in enumerate(values)}


def test_frontier_rounds_shuffle_no_edges(spark):
    """In a round, both tables of edges are read by their buckets; what is shuffled is the frontier and what follows from it."""
    edges = spark.range(2000).select((F.col("id") % 50).alias("group"), (F.col("id") % 333).alias("member"))
    names = [relations._bucketed(edges, c, 4, "edges_test") for c in ("group", "member", "group")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = relations.frontier_round(spark.table(names[0]), spark.table(names[1]), spark.range(1).select(F.col("id").alias("group")), spark.table(names[2]).select("group"), "member", "group")
        plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [k for k, line in enumerate(plan) if "Exchange" in line]
    assert len(exchanges) == 3  # the frontier, its members, the groups that hold them
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for k, line in enumerate(plan):
        if "Scan parquet" in line:
            at, above = k, None
            while above is None:  # the nearest join or exchange among its ancestors
                at = next(x for x in range(at - 1, -1, -1) if depth[x] < depth[at])
                above = plan[at] if "Join" in plan[at] or "Exchange" in plan[at] else None
            assert "Bucketed: true" in line and "Join" in above
