"""Stored tables and the paths of their columns in the raw documents, and the columns of the datasets.

Everything down to ``schema_of`` is a fixed value: names, paths and limits that results must have.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: column -> (path in the document, type)
CLANS = {
    "clan_tag": ("$.tag", "string"),
    "name": ("$.name", "string"),
    "description": ("$.description", "string"),
    "clan_level": ("$.clanLevel", "bigint"),
    "clan_points": ("$.clanPoints", "bigint"),
    "clan_builder_base_points": ("$.clanBuilderBasePoints", "bigint"),
    "clan_capital_points": ("$.clanCapitalPoints", "bigint"),
    "members": ("$.members", "bigint"),
    "required_trophies": ("$.requiredTrophies", "bigint"),
    "war_frequency": ("$.warFrequency", "string"),
    "war_win_streak": ("$.warWinStreak", "bigint"),
    "war_wins": ("$.warWins", "bigint"),
    "war_ties": ("$.warTies", "bigint"),
    "war_losses": ("$.warLosses", "bigint"),
    "war_log_public": ("$.warLogPublic", "boolean"),
    "location_id": ("$.location.id", "bigint"),
    "location_name": ("$.location.name", "string"),
    "type": ("$.type", "string"),
    "is_family_friendly": ("$.isFamilyFriendly", "boolean"),
}

#: Nested objects that are kept as canonical text; they stand before the location.
CLAN_TEXTS = {
    "war_league": "$.warLeague",
    "capital_league": "$.capitalLeague",
}

MEMBERS = {
    "player_tag": ("$.tag", "string"),
    "name": ("$.name", "string"),
    "role": ("$.role", "string"),
    "town_hall_level": ("$.townHallLevel", "bigint"),
    "exp_level": ("$.expLevel", "bigint"),
    "league_id": ("$.league.id", "bigint"),
    "league_name": ("$.league.name", "string"),
    "league_tier_id": ("$.leagueTier.id", "bigint"),
    "league_tier_name": ("$.leagueTier.name", "string"),
    "trophies": ("$.trophies", "bigint"),
    "builder_base_trophies": ("$.builderBaseTrophies", "bigint"),
    "clan_rank": ("$.clanRank", "bigint"),
    "previous_clan_rank": ("$.previousClanRank", "bigint"),
    "donations": ("$.donations", "bigint"),
    "donations_received": ("$.donationsReceived", "bigint"),
    "capital_contributions": ("$.clanCapitalContributions", "bigint"),
}

PLAYERS = {
    "player_tag": ("$.tag", "string"),
    "name": ("$.name", "string"),
    "town_hall_level": ("$.townHallLevel", "bigint"),
    "exp_level": ("$.expLevel", "bigint"),
    "trophies": ("$.trophies", "bigint"),
    "best_trophies": ("$.bestTrophies", "bigint"),
    "war_stars": ("$.warStars", "bigint"),
    "attack_wins": ("$.attackWins", "bigint"),
    "defense_wins": ("$.defenseWins", "bigint"),
    "builder_hall_level": ("$.builderHallLevel", "bigint"),
    "builder_base_trophies": ("$.builderBaseTrophies", "bigint"),
    "best_builder_base_trophies": ("$.bestBuilderBaseTrophies", "bigint"),
    "donations": ("$.donations", "bigint"),
    "donations_received": ("$.donationsReceived", "bigint"),
    "clan_capital_contributions": ("$.clanCapitalContributions", "bigint"),
    "clan_tag": ("$.clan.tag", "string"),
    "clan_name": ("$.clan.name", "string"),
    "clan_level": ("$.clan.clanLevel", "bigint"),
}

#: table -> (path of its list, name of its name column)
PROGRESSION = {
    "player_troops": ("$.troops", "troop_name"),
    "player_heroes": ("$.heroes", "hero_name"),
    "player_hero_equipment": ("$.heroEquipment", "equipment_name"),
    "player_spells": ("$.spells", "spell_name"),
}

ACHIEVEMENTS = {
    "achievement_name": ("$.name", "string"),
    "stars": ("$.stars", "bigint"),
    "value": ("$.value", "bigint"),
    "target": ("$.target", "bigint"),
    "village": ("$.village", "string"),
}

#: table -> prefix of its aggregates
PREFIXES = {
    "player_troops": "troop",
    "player_heroes": "hero",
    "player_spells": "spell",
    "player_hero_equipment": "equipment",
}

# fixed values: columns of the features and datasets
PLAYER_BASE = [
    "town_hall_level",
    "exp_level",
    "trophies",
    "best_trophies",
    "war_stars",
    "attack_wins",
    "defense_wins",
    "builder_hall_level",
    "builder_base_trophies",
    "best_builder_base_trophies",
    "donations",
    "donations_received",
    "clan_capital_contributions",
]

ROLE_RELATIVE = [
    "trophies",
    "exp_level",
    "town_hall_level",
    "war_stars",
    "capital_contributions",
    "donations",
    "donations_received",
    "attack_wins",
    "defense_wins",
]

ROLE_PERCENTILES = [
    "trophies",
    "exp_level",
    "war_stars",
]

CLAN_CONTEXT = [
    "clan_level",
    "clan_points",
    "clan_capital_points",
    "members",
    "required_trophies",
    "war_frequency",
    "war_league",
    "capital_league",
    "type",
    "is_family_friendly",
]

RANK_RELATIVE = [
    "trophies",
    "exp_level",
    "town_hall_level",
    "donations",
    "donations_received",
    "capital_contributions",
    "war_stars",
    "attack_wins",
    "defense_wins",
]

RANK_BANNED = [
    "clan_rank",
    "previous_clan_rank",
    "role",
]

TROPHY_BANNED = [
    "trophies",
    "trophies_diff_from_clan_mean",
    "trophies_ratio_to_clan_mean",
    "trophies_clan_pct",
    "best_trophies",
    "progression_ratio_trophies",
    "clan_mean_trophies",
    "required_trophies",
]

PROXY_VARIABLES = [
    "trophies",
    "town_hall_level",
    "exp_level",
    "war_stars",
    "attack_wins",
    "defense_wins",
    "donations",
    "donations_received",
    "capital_contributions",
    "builder_base_trophies",
]

WAR_CONTEXT = [
    "clan_level",
    "clan_points",
    "clan_capital_points",
    "members",
    "required_trophies",
    "war_frequency",
    "war_league",
    "capital_league",
    "type",
    "is_family_friendly",
    "location_id",
    "location_name",
]

WAR_STATS = [
    "town_hall_level",
    "exp_level",
    "trophies",
    "donations",
    "donations_received",
    "clan_capital_contributions",
]

WAR_MEANS = [
    "troop_mean_level",
    "troop_mean_completion_ratio",
    "hero_mean_level",
    "hero_mean_completion_ratio",
    "spell_mean_level",
    "spell_mean_completion_ratio",
    "equipment_mean_level",
    "equipment_mean_completion_ratio",
    "achievement_completion_ratio",
]

WAR_SUMS = [
    "donations",
    "donations_received",
    "clan_capital_contributions",
]

WAR_LEAKS = [
    "war_wins",
    "war_losses",
    "war_ties",
    "war_win_streak",
    "war_points",
    "war_total",
    "war_success_rate",
    "win_rate",
    "loss_rate",
    "tie_rate",
]

#: Lower edges and labels of the bins of war totals.
WAR_BINS = (
    [0, 1, 2, 3, 4, 5, 10, 20, 50, 100],
    ["0", "1", "2", "3", "4", "5-9", "10-19", "20-49", "50-99", "100+"],
)

CLUSTER_FEATURES = [
    "town_hall_level",
    "builder_hall_level",
    "exp_level",
    "trophies",
    "best_trophies",
    "war_stars",
    "attack_wins",
    "defense_wins",
    "donations",
    "donations_received",
    "clan_capital_contributions",
    "troop_count",
    "troop_mean_level",
    "troop_mean_completion_ratio",
    "hero_count",
    "hero_mean_level",
    "hero_mean_completion_ratio",
    "spell_count",
    "spell_mean_level",
    "spell_mean_completion_ratio",
    "equipment_count",
    "equipment_mean_level",
    "equipment_mean_completion_ratio",
    "achievement_count",
    "achievement_completion_ratio",
    "donation_balance",
    "donation_ratio",
    "combat_activity_total",
    "progression_ratio_trophies",
    "builder_progression_ratio",
]

#: Names, and parts of names, of columns that are no features.
CLUSTER_EXCLUDED = (
    [
        "player_tag",
        "clan_tag",
        "role",
        "clan_rank",
        "previous_clan_rank",
        "war_success_rate",
        "war_win_rate",
        "performance_class",
    ],
    [
        "target",
        "label",
        "prediction",
        "cluster",
        "clan_rank",
        "role",
    ],
)


def schema_of(fields: dict[str, tuple[str, str]], first: str = "", texts: tuple[str, ...] = ()) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
    out = [T.StructField(first, T.StringType())] if first else []
    out += [T.StructField(n, kinds[k]) for n, (_, k) in fields.items()]
    at = next((i for i, f in enumerate(out) if f.name == "location_id"), len(out))
    return T.StructType(out[:at] + [T.StructField(t, T.StringType()) for t in texts] + out[at:])
