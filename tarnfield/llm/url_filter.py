"""URL filtering by a path-template tree, in DataFrame expressions only.

Per host, the segments of a path form a tree, which is built from the root down, a level a round.

1. Segments that contain a digit become wildcards. Below a node with more than ``max_children`` different segments, a
   segment stays if it has at least ``support`` different paths and its labels set it apart from its siblings: its block
   rate, or the share of its paths that have a label, differs from that of all others by a two-proportion test. The
   other segments of that node become one wildcard (that of segments with a digit, if it stays, is then ``#``).
2. At every level, branches with labels whose block rate does not differ from that of their siblings are merged into
   one branch, ``~``, which is then descended as one.
3. The estimate of a branch is its smoothed labelled purity, (blocked + K * given) / (labelled + K). What a node gives its
   branches counts labelled *branches*, not urls: the mean purity of those that have labels, smoothed alike, (sum of
   purities + K * given) / (labelled branches + K), from 0.5 above a host down. Labels inside one branch, however many,
   are one piece of evidence about its siblings: it takes several branches that agree to reject one without labels.
4. A template is rejected if its estimate reaches ``purity``.

A node of no more than ``max_children`` paths is not generalised: its paths are templates at once, which keeps the
rounds to places where many paths share a long prefix. The labels are the urls that the given rules decide; a rule's
verdict always stands, the template's verdict serves all other urls.

Edge cases: a null url or one without ``://`` has an empty host and path and no rule, and the verdict of the empty host;
repeated urls count as often as they occur; an empty table gives an empty result. Large hosts and branches are looked up
by broadcast (``join_groups``), all others by salted sort-merge joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnfield.llm.common import join_groups, lower_ascii, stage, unstage

Rule = tuple[str, str]  #: (verdict, host + path)
PARENT_WEIGHT = 2.0  #: K: the labelled urls, or branches, that what is given from above counts for


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and ``/ ? #``, A-Z lower-cased; path up to ``? #``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for verdict, rule in ordered:
        own, start = _split_rule(rule)
        fits.append((((host == own) | host.endswith("." + own)) & path.startswith(start), verdict, rule))
    pick = lambda k: reduce(lambda rest, f: F.when(f[0], F.lit(f[k])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(2), pick(1)


def _differ(own_b: Column, own_m: Column, all_b: Column, all_m: Column, z: float) -> Column:
    """Whether own_b of own_m differs from the rest of all_b of all_m by a two-proportion test; false where a side is empty."""
    rest_b, rest_m, pool = all_b - own_b, all_m - own_m, all_b / all_m
    spread = F.sqrt(pool * (1 - pool) * (1 / own_m + 1 / rest_m))
    return F.when((own_m > 0) & (rest_m > 0), F.abs(own_b / own_m - rest_b / rest_m) > z * spread).otherwise(F.lit(False))


def _estimate(b: str, m: str, parent: str | Column) -> Column:
    parent = F.col(parent) if isinstance(parent, str) else parent
    return (F.col(b) + PARENT_WEIGHT * parent) / (F.col(m) + PARENT_WEIGHT)


def _branches(kids: DataFrame, total: int, max_children: int, support: int, z: float) -> DataFrame:
    """Of each kid of a node (node, what the node was given, _seg, counts): the branch ``_seg`` goes to, its estimate, what the node gives, and the node's paths."""
    sums = [F.sum(c).alias(f"_all{c}") for c in ("_n", "_l", "_b", "_m")]
    nodes = kids.groupBy("_node").agg(F.count(F.lit(1)).alias("_kids"), *sums)
    at = join_groups(kids, nodes, "_node", "_kids", total)
    apart = _differ(F.col("_b"), F.col("_m"), F.col("_all_b"), F.col("_all_m"), z) | _differ(F.col("_l"), F.col("_n"), F.col("_all_l"), F.col("_all_n"), z)
    general = F.when(F.col("_kids") <= max_children, F.col("_seg")).when(~((F.col("_n") >= support) & apart), F.lit("*")).when(F.col("_seg") == "*", F.lit("#")).otherwise(F.col("_seg"))
    at = stage(at.withColumn("_branch", F.concat("_node", F.lit("/"), general)), "url-branches")
    # branches alike are merged
    branches = at.groupBy("_branch").agg(F.any_value("_node").alias("_node"), F.any_value("_above").alias("_above"), F.any_value("_all_b").alias("_all_b"), F.any_value("_all_m").alias("_all_m"), F.sum("_b").alias("_b"), F.sum("_m").alias("_m"), F.count(F.lit(1)).alias("_of"))
    alike = (F.col("_m") > 0) & (F.col("_all_m") > F.col("_m")) & ~_differ(F.col("_b"), F.col("_m"), F.col("_all_b"), F.col("_all_m"), z)
    branches = branches.withColumn("_final", F.when(alike, F.concat("_node", F.lit("/~"))).otherwise(F.col("_branch")))
    given = branches.groupBy("_node").agg(F.count(F.lit(1)).alias("_wide"), F.coalesce(F.sum(F.when(F.col("_m") > 0, F.col("_b") / F.col("_m"))), F.lit(0.0)).alias("_rates"), F.count_if(F.col("_m") > 0).alias("_rated"), F.any_value("_above").alias("_from"))
    given = given.select("_node", "_wide", _estimate("_rates", "_rated", "_from").alias("_given"))
    branches = stage(join_groups(branches, given, "_node", "_wide", total), "url-branches")
    merged = branches.groupBy("_final").agg(F.sum("_b").alias("_fb"), F.sum("_m").alias("_fm"), F.any_value("_given").alias("_given"), F.count(F.lit(1)).alias("_ff")).withColumn("_estimate", _estimate("_fb", "_fm", "_given"))
    finals = join_groups(branches.select("_branch", "_final", "_of"), merged.select("_final", "_ff", "_estimate", "_given"), "_final", "_ff", total)
    return stage(join_groups(at.select("_branch", "_kid", "_n", "_all_n"), finals, "_branch", "_of", total).select("_kid", "_n", "_all_n", "_final", "_estimate", "_given"), "url-kids")


def _templates(urls: DataFrame, max_children: int, support: int, z: float) -> DataFrame:
    """``urls`` with the template of each path and its estimate. A template is kept with its host before it, as hosts hold no ``/``.

    While a path is open, ``purity`` is what its node was given.
    """
    labelled = F.col("n_block") + F.col("n_allow")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    total = urls.count()
    urls = urls.withColumn("_segs", segments)
    bare = F.size("_segs") == 0  # paths of the host itself
    hosts = urls.groupBy("host").agg(F.coalesce(F.sum(F.when(bare, F.col("n_block"))), F.lit(0)).alias("_b"), F.coalesce(F.sum(F.when(bare, labelled)), F.lit(0)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    hosts = hosts.select("host", "_n", _estimate("_b", "_m", F.lit(0.5)).alias("_own"))
    tree = join_groups(urls, hosts, "host", "_n", total).withColumns({"_node": F.col("host"), "_open": ~bare, "purity": F.when(bare, F.col("_own")).otherwise(F.lit(0.5))})
    tree = stage(tree.drop("_n", "_own"), "url-tree")
    columns, done, level = tree.columns, tree.where(~F.col("_open")), 0
    while not (tree := tree.where("_open")).isEmpty():
        tree = tree.withColumn("_seg", F.get("_segs", F.lit(level))).withColumn("_kid", F.concat("_node", F.lit("/"), "_seg"))
        counts = [F.count(F.lit(1)).alias("_n"), F.count_if(labelled > 0).alias("_l"), F.sum("n_block").alias("_b"), F.sum(labelled).alias("_m")]
        kids = stage(tree.groupBy("_kid").agg(F.any_value("_node").alias("_node"), F.any_value("_seg").alias("_seg"), F.any_value("purity").alias("_above"), *counts), "url-nodes")
        tree = stage(join_groups(tree, _branches(kids, total, max_children, support, z), "_kid", "_n", total), "url-tree")
        unstage(kids)
        left = F.size("_segs") - level
        rest = F.array_join(F.transform(F.slice("_segs", F.lit(level + 1), left), lambda s: F.concat(F.lit("/"), s)), "")
        leaf = W.partitionBy("_node")  # no more than max_children rows
        small = tree.where(F.col("_all_n") <= max_children).withColumns({"_node": F.concat("_node", rest), "_open": F.lit(False)})
        small = small.withColumns({"_b": F.sum("n_block").over(leaf), "_m": F.sum(labelled).over(leaf)}).withColumn("purity", _estimate("_b", "_m", "_given"))
        tree = tree.where(F.col("_all_n") > max_children).withColumns({"_node": F.col("_final"), "purity": F.when(left > 1, F.col("_given")).otherwise(F.col("_estimate")), "_open": left > 1}).select(columns)
        done, level = done.unionByName(small.select(columns)).unionByName(tree.where(~F.col("_open"))), level + 1
    return done.withColumn("template", F.col("_node").substr(F.length("host") + 1, F.length("_node"))).drop("_segs", "_open", "_node")


def template_verdicts(urls: DataFrame, max_children: int = 30, support: int = 3, z: float = 1.96, purity: float = 0.8) -> DataFrame:
    """Template, purity (its estimate) and verdict of each (host, path). ``urls``: host, path, n_block, n_allow, one row per (host, path)."""
    judged = _templates(urls, max_children, support, z)
    return judged.withColumn("verdict", F.when(F.col("purity") >= purity, "block").otherwise("allow")).select("host", "path", "template", "purity", "verdict")


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", **tree) -> DataFrame:
    """All rows of ``pages`` with host, path, rule, template, purity and verdict."""
    pages = pages.drop(*({"host", "path", "rule", "template", "purity", "verdict", "_rule_verdict"} & set(pages.columns)))
    host, path = url_parts(url_col)
    judged = pages.withColumns({"host": host, "path": path})
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_rule_verdict": verdict})
    counts = judged.groupBy("host", "path").agg(F.count_if(F.col("_rule_verdict") == "block").alias("n_block"), F.count_if(F.col("_rule_verdict") == "allow").alias("n_allow"), F.count(F.lit(1)).alias("_size"))
    counts = stage(counts, "url-counts")
    learnt = template_verdicts(counts.drop("_size"), **tree).withColumnsRenamed({"host": "_t_host", "path": "_t_path"})
    # a url may be that of a third of all rows: its key is salted
    sizes = counts.groupBy().agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    learnt = learnt.join(counts.select(F.col("host").alias("_t_host"), F.col("path").alias("_t_path"), "_size"), ["_t_host", "_t_path"]).select(F.struct(F.col("_t_host").alias("host"), F.col("_t_path").alias("path")).alias("_url"), "_size", "template", "purity", "verdict")
    out = join_groups(judged.withColumn("_url", F.struct("host", "path")), learnt, "_url", "_size", sizes).drop("_url", "_size")
    return out.withColumn("verdict", F.coalesce("_rule_verdict", "verdict")).drop("_rule_verdict")
