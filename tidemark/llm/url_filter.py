"""URL verdicts from rules and from a tree of path templates per host, in DataFrame operations only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread_lookup
from tidemark.session import cut_lineage

# (host, path start, verdict): the rules of the query contract
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MOST_RULES = 500  # rules become one expression; a longer list belongs into a joined table

_VARIABLE = r"^([0-9]+|[0-9a-fA-F-]{8,}|.*[0-9]{4,}.*|.{40,})$"  # numbers, digests, dated or long slugs


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = None
    for at, start, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name = F.when(fits, at + start) if name is None else name.when(fits, at + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _differs(hits: str, of: str, z: float) -> Column:
    """A branch's share of ``hits`` in ``of`` against that of its siblings: a two-proportion test."""
    a, n = F.col(hits), F.col(of)
    b, m = F.col(f"all_{hits}") - a, F.col(f"all_{of}") - n
    p, q, pool = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1), (a + b + 0.5) / (n + m + 1)
    return F.pow(p - q, 2) > z * z * pool * (1 - pool) * (1 / (n + 1) + 1 / (m + 1))


def path_templates(paths: DataFrame, depth: int | None = None, min_support: int = 5, z: float = 2.0) -> DataFrame:
    """Template of each (host, path) row of ``paths`` (host, path, n, labelled, blocked).

    Level by level under each host: a variable segment becomes ``*``. A literal branch stays one only if it
    has ``min_support`` pages and its blocked share or its share of pages that end here differs from its
    siblings'; the others merge into ``*``. Levels run until no path has a further segment, and paths under a
    parent with fewer pages than ``min_support`` take all their ``*`` at once; with ``depth``, what lies below
    it is one ``**``.
    """
    rows = cut_lineage(paths.withColumn("segs", F.array_remove(F.split("path", "/"), "")).withColumn("tpl", F.lit("")))
    sums = ("n", "labelled", "blocked", "leaf")
    ended, level = [], 0
    while (depth is None or level < depth) and (rows.agg(F.max(F.size("segs"))).first()[0] or 0) > level:
        seg = F.get("segs", F.lit(level))
        rows = rows.withColumn("leaf", F.when(F.size("segs") == level + 1, F.col("n")).otherwise(0)).withColumn(
            "shape", F.when(seg.rlike(_VARIABLE), F.lit("*")).otherwise(seg))
        going = rows.where("shape is not null")
        ended.append(rows.where("shape is null").drop("leaf", "shape"))
        branches = going.groupBy("host", "tpl", "shape").agg(*[F.sum(c).alias(c) for c in sums])
        parents = branches.groupBy("host", "tpl").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
        joined = spread_lookup(branches, ["host", "tpl"], parents, "shape")
        own = (F.col("shape") != "*") & (F.col("n") >= min_support) & (_differs("blocked", "labelled", z) | _differs("leaf", "n", z))
        named = joined.select("host", "tpl", "shape", (F.col("all_n") < min_support).alias("few"), F.concat(
            "tpl", F.lit("/"), F.when(own, F.col("shape")).otherwise(F.lit("*"))).alias("grown"))
        going = spread_lookup(going, ["host", "tpl", "shape"], named, "path").drop("tpl", "leaf", "shape").withColumnRenamed("grown", "tpl")
        going = cut_lineage(going)
        level += 1
        few, rows = going.where("few").drop("few"), going.where("not few").drop("few")
        more = (F.size("segs") if depth is None else F.least(F.size("segs"), F.lit(depth))) - level
        ended.append(few.withColumn("tpl", F.concat("tpl", F.repeat(F.lit("/*"), more))))
        if len(ended) > 30:  # a long plan is cut now and then
            ended = [cut_lineage(reduce(DataFrame.unionByName, ended))]
    rows = reduce(DataFrame.unionByName, ended, rows)
    if depth is not None:
        rows = rows.withColumn("tpl", F.when(F.size("segs") > depth, F.concat("tpl", F.lit("/**"))).otherwise(F.col("tpl")))
    return cut_lineage(rows.drop("segs"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.8, prior: float = 5.0, depth: int | None = None,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every url: that of its longest rule, else that of its path template.

    Pages with a rule label their template. A template's blocked share is smoothed by its host's, that by
    the share of all labelled pages, each with ``prior`` pages of weight; from ``threshold`` on the template
    is rejected. Returns page_id, host, path, rule, verdict, template, blocked_share, one row per row.
    A null url or one without ``://`` has empty host and path, no rule, and the verdict of their template.
    Repeated rows count as often as they come; extra columns are not read; no rows give no rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
                        F.monotonically_increasing_id().alias("row"))
    name, verdict = _ruled(F.col("host"), F.col("path"), rules)
    base = cut_lineage(base.withColumn("rule", name).withColumn("says", verdict))
    paths = base.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("says").alias("labelled"), F.count_if(F.col("says") == "block").alias("blocked"))
    rows = path_templates(paths, depth)
    tpls = rows.groupBy("host", "tpl").agg(*[F.sum(c).alias(c) for c in ("labelled", "blocked")])
    hosts = tpls.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    both = base.agg(F.count("says"), F.count_if(F.col("says") == "block")).first()
    overall = (both[1] + 1) / (both[0] + 2)
    host_share = (F.col("host_blocked") + prior * overall) / (F.col("host_labelled") + prior)
    share = (F.col("blocked") + prior * host_share) / (F.col("labelled") + prior)
    judged = spread_lookup(tpls, ["host"], hosts, "tpl").select("host", "tpl", share.alias("blocked_share"))
    by_path = spread_lookup(rows.select("host", "path", "tpl"), ["host", "tpl"], judged, "path")
    out = spread_lookup(base, ["host", "path"], by_path, "row")
    method = F.when(F.col("blocked_share") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"),
                      F.col("tpl").alias("template"), "blocked_share")
