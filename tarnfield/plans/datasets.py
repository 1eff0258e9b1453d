"""The domain pipelines: raw documents to tables, tables to features, features to five datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions import between, canonical_json, normalize_tag, safe_ratio
from tarnfield.operators import clean, features, select, stats
from tarnfield.operators.relations import coverage_gap
from tarnfield.plans import schemas as S
from tarnfield.sources import documents as io
from tarnfield.sources import tables as tables_io
from tarnfield.staging import staged

Tables = Mapping[str, DataFrame]


def normalised_tables(clans: DataFrame, members: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """Eight tables from parsed documents (key_from_file, v); of rows with one key the first by file name and position stays."""
    flat = io.flatten(clans.withColumns({f"_{t}": io.get("v", p, "variant") for t, p in S.CLAN_TEXTS.items()}), S.CLANS, ("key_from_file", *[f"_{t}" for t in S.CLAN_TEXTS]))
    flat = flat.withColumns({t: canonical_json(f"_{t}") for t in S.CLAN_TEXTS})
    out = {"clans": clean.keep_first(clean.valid_keys(flat, "clan_tag"), ["clan_tag"], ["key_from_file"])}
    items = io.member_items(members).where(F.col("item").isNotNull())
    rows = io.flatten(items, S.MEMBERS, ("key_from_file", "pos"), "item").withColumn("clan_tag", normalize_tag("key_from_file"))
    out["clan_members"] = clean.keep_first(clean.valid_keys(rows, "clan_tag", "player_tag"), ["clan_tag", "player_tag"], ["key_from_file", "pos"])
    people = io.flatten(players, S.PLAYERS, ("key_from_file", "v"))
    people = clean.keep_first(clean.valid_keys(people, "player_tag"), ["player_tag"], ["key_from_file"])
    out["players"] = people
    for name, (path, column) in S.PROGRESSION.items():
        child = io.explode_objects(people, path, {column: ("$.name", "string"), "level": ("$.level", "bigint"), "max_level": ("$.maxLevel", "bigint"), "village": ("$.village", "string")}, ("player_tag",))
        out[name] = clean.keep_first(child, ["player_tag", column, "village"], ["pos"]).drop("pos")
    awards = io.explode_objects(people, "$.achievements", S.ACHIEVEMENTS, ("player_tag",))
    out["player_achievements"] = clean.keep_first(awards, ["player_tag", "achievement_name", "village"], ["pos"]).drop("pos")
    out["clans"] = tables_io.align(out["clans"], S.schema_of(S.CLANS, texts=tuple(S.CLAN_TEXTS)))
    out["clan_members"] = tables_io.align(out["clan_members"], S.schema_of(S.MEMBERS, "clan_tag"))
    out["players"] = tables_io.align(out["players"], S.schema_of(S.PLAYERS))
    return out


def build_tables(spark: SparkSession, raw: str, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Read raw/{clans,members,players}, write the tables; (tables, coverage gaps of members against players and clans)."""
    parts = [io.read_documents(spark, f"{raw}/clans")[0], io.read_documents(spark, f"{raw}/members", lenient=False)[0], io.read_documents(spark, f"{raw}/players")[0]]
    tables_io.write_tables(normalised_tables(*parts), folder)
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("clans", "clan_members", "players", *S.PROGRESSION, "player_achievements")}
    gaps = {"players": coverage_gap(tables["clan_members"], tables["players"], "player_tag"), "clans": coverage_gap(tables["clan_members"], tables["clans"], "clan_tag")}
    return tables, gaps


def player_features(t: Tables, null_level: str = "zero") -> DataFrame:
    """One row per player: base columns, derived ratios, progression aggregates; gaps are 0."""
    base = t["players"].select("player_tag", *S.PLAYER_BASE)
    derived = {
        "donation_balance": F.col("donations") - F.col("donations_received"), "donation_ratio": safe_ratio("donations", "donations_received"), "combat_activity_total": F.col("attack_wins") + F.col("defense_wins"),
        "progression_ratio_trophies": safe_ratio("trophies", "best_trophies"), "builder_progression_ratio": safe_ratio("builder_base_trophies", "best_builder_base_trophies"),
    }
    parts = [features.child_aggregate(t[name], "player_tag", prefix, "level", "max_level", null_level) for name, prefix in S.PREFIXES.items()]
    parts.append(features.child_aggregate(t["player_achievements"], "player_tag", "achievement", None, None, value=("value", "target")))
    return features.entity_features(base, "player_tag", parts, derived)


def _first_by_all(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of several, the first by all other columns, so that it is always the same."""
    return clean.keep_first(df, keys, [c for c in df.columns if c not in keys] or keys)


def role_dataset(t: Tables, players: DataFrame) -> DataFrame:
    """A row per (clan, player): relative features, clan context, player features, target ``role``. Members without a profile stay."""
    ids = ["clan_tag", "player_tag"]
    members = _first_by_all(t["clan_members"], ids)
    joined = members.select(*ids, "trophies", "exp_level", "town_hall_level", "capital_contributions", "donations", "donations_received").join(players.select("player_tag", "war_stars", "attack_wins", "defense_wins"), "player_tag", "left")
    joined = clean.clean_infinite(joined, ["war_stars", "attack_wins", "defense_wins"])
    relative = features.group_relative(joined, "clan_tag", S.ROLE_RELATIVE, S.ROLE_PERCENTILES, name="clan").drop(*S.ROLE_RELATIVE)
    context = select.whitelist(t["clans"], ["clan_tag", *S.CLAN_CONTEXT])
    out = select.join_suffixed(select.join_keep_left(relative, context, ["clan_tag"]), players, ["player_tag"], "_player")
    roles = t["clan_members"].select(*ids, "role").distinct()
    return out.select(*ids, *[c for c in out.columns if c not in ids]).join(roles, ids, "left")


def rank_datasets(t: Tables, players: DataFrame) -> dict[str, DataFrame]:
    """Two leakage-controlled variants with target ``clan_rank``, with and without trophies; and the audit they rest on."""
    ids = ["clan_tag", "player_tag"]
    # written once for the audit and both variants; clans stay together from their ranks to their context, so that the wide rows are shuffled once
    joined = staged(select.join_keep_left(t["clan_members"], players, ["player_tag"], "inner").withColumn("_row", F.monotonically_increasing_id()), "ranked-members")
    audit = stats.proxy_audit(joined, "clan_tag", "clan_rank", S.PROXY_VARIABLES, S.RANK_BANNED)
    direct = [r.feature for r in audit.where("classification in ('EXCLUDE', 'TOO_DIRECT')").collect()]
    relative = features.group_relative(joined, "clan_tag", S.RANK_RELATIVE, S.RANK_RELATIVE, emit_means=True, name="clan", row="_row").drop("_row")
    full = select.join_keep_left(relative, select.whitelist(t["clans"], ["clan_tag", *S.CLAN_CONTEXT]), ["clan_tag"])
    out = {"audit": audit}
    for name, banned in (("with_trophies", [b for b in (*S.RANK_BANNED, *direct) if b != "trophies"]), ("without_trophies", [*S.RANK_BANNED, *direct, *S.TROPHY_BANNED])):
        kept = select.ban(full.drop(*ids), banned).columns
        select.require_absent(full.select(*kept), ["clan_rank", "previous_clan_rank", "role"])
        out[name] = full.select(*ids, *kept, "clan_rank")
    return out


def war_dataset(t: Tables, players: DataFrame, minimum: int = 5) -> DataFrame:
    """A row per clan with a history of ``minimum`` wars: context, composition of its members, target ``war_success_rate``."""
    tables_io.require_unique(players, ["player_tag"])
    valid = features.rate_target(t["clans"], "war_wins", ["war_wins", "war_losses", "war_ties"], minimum, "war_success_rate")
    valid = _first_by_all(valid, ["clan_tag"])
    bridge = t["clan_members"].select("clan_tag", "player_tag").distinct().join(valid.select("clan_tag"), "clan_tag", "left_semi")
    profiles = bridge.join(players, "player_tag", "left")
    shares = {"th18_percentage": F.col("town_hall_level") >= 18, "th17_plus_percentage": F.col("town_hall_level") >= 17}
    teams = features.group_composition(profiles, "clan_tag", S.WAR_STATS, S.WAR_MEANS, shares, S.WAR_SUMS)
    teams = teams.withColumns({
        "donation_balance": F.col("sum_donations") - F.col("sum_donations_received"), "donation_ratio": safe_ratio("sum_donations", "sum_donations_received"),
        "donation_rate": safe_ratio("sum_donations", "member_count"), "capital_contribution_rate": safe_ratio("sum_clan_capital_contributions", "member_count"),
    })
    context = select.whitelist(valid, ["clan_tag", *S.WAR_CONTEXT])
    target = valid.select("clan_tag", "war_success_rate")
    return clean.typed_fill(context.join(teams, "clan_tag", "left").join(target, "clan_tag", "left"), ["clan_tag", "war_success_rate"])


def class_dataset(war: DataFrame, low: float | None = None, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(dataset with ``performance_class``, numbers kept and dropped). Thresholds default to the target's terciles."""
    war = staged(war, "war")  # a row per clan, made once for the checks, the terciles and the result
    tables_io.require_unique(war, ["clan_tag"])
    _, counts = features.valid_rates(war, "war_success_rate")
    valid = features.require_rates(war, "war_success_rate")
    if low is None or high is None:
        low, high = select.cutoffs(valid, "war_success_rate")
    if not 0 <= low < high <= 1:
        raise ValueError(f"thresholds must satisfy 0 <= low < high <= 1, not {low} and {high}")
    classed = valid.withColumn("performance_class", between("war_success_rate", low, high))
    return select.drop_present(classed, S.WAR_LEAKS), counts


def clustering_dataset(players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(player_tag and whitelisted numeric columns, median-imputed; the selection report)."""
    return select.clustering_matrix(select.key_column(players, "player_tag"), "player_tag", S.CLUSTER_FEATURES, *S.CLUSTER_EXCLUDED)


def build_datasets(t: Tables, folder: str, low: float | None = None, high: float | None = None) -> dict[str, DataFrame]:
    """Make the player features and the five datasets from stored tables and write each as Parquet; what was written. ``low`` and ``high`` as in ``class_dataset``."""
    players = player_features(t)
    tables_io.write_tables({"player_features": players}, folder)
    spark = players.sparkSession
    players = spark.read.parquet(f"{folder}/player_features.parquet")
    ranks, war = rank_datasets(t, players), war_dataset(t, players)
    tables_io.write_tables({"war_performance": war}, folder)
    war = spark.read.parquet(f"{folder}/war_performance.parquet")
    made = {
        "role_classification": role_dataset(t, players), "clan_rank_with_trophies": ranks["with_trophies"], "clan_rank_without_trophies": ranks["without_trophies"],
        "proxy_audit": ranks["audit"], "performance_classification": class_dataset(war, low, high)[0], "player_clustering": clustering_dataset(players)[0],
    }
    tables_io.write_tables(made, folder)
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("player_features", "war_performance", *made)}
