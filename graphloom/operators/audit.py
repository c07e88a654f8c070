"""Scoring of edges against an oracle: classes, precision, recall, thresholds and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: Column | None = None) -> Column:
    return F.when(whole == 0, F.lit(0.0) if empty is None else empty).otherwise(part / whole)


def classify(edges: DataFrame, oracle: DataFrame) -> DataFrame:
    """``edges`` (file, line, target, tier) with ``class``: tp, fp:no-site, fp:external (all of the site's records are) or
    fp:wrong-target. The site's records are folded before the join, so it never multiplies edges."""
    sites = oracle.groupBy("file", "line").agg(F.bool_and("external").alias("_external"), F.lit(True).alias("_site"))
    hits = oracle.filter("not external").select("file", "line", "target").distinct().withColumn("_hit", F.lit(True))
    rows = edges.join(sites, ["file", "line"], "left").join(hits, ["file", "line", "target"], "left")
    kind = F.when(F.col("_hit"), F.lit("tp")).when(F.col("_site").isNull(), F.lit("fp:no-site")).when(F.col("_external"), F.lit("fp:external")).otherwise(F.lit("fp:wrong-target"))
    return rows.withColumn("class", kind).drop("_external", "_site", "_hit")


def by_tier(classified: DataFrame) -> DataFrame:
    """(tier, edges, tp, precision): precision is 0 where nothing was judged."""
    rows = classified.groupBy(F.coalesce("tier", F.lit("precise")).alias("tier")).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("class") == "tp").alias("tp"))
    return rows.withColumn("precision", ratio(F.col("tp"), F.col("edges")))


def recall(edges: DataFrame, oracle: DataFrame, group: str | None = None) -> DataFrame:
    """Records that are not external, and how many precise edges, then ext, then all tiers find."""
    found = edges.groupBy("file", "line", "target").agg(F.max(F.col("tier").isNull().cast("int")).alias("_p"), F.max((F.col("tier") == "ext").cast("int")).alias("_e"), F.lit(1).alias("_a"))
    rows = oracle.filter("not external").join(found, ["file", "line", "target"], "left")
    keys = [group] if group else []
    has = lambda c: F.coalesce(c, F.lit(0))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sites"), F.sum(has(F.col("_p"))).alias("precise"), F.sum(F.greatest(has(F.col("_p")), has(F.col("_e")))).alias("with_ext"), F.sum(has(F.col("_a"))).alias("all_tiers"))
    return out.withColumn("recall", ratio(F.col("all_tiers"), F.col("sites")))


def silent(edges: DataFrame, oracle: DataFrame) -> DataFrame:
    """Sites whose every record is external: silent without an edge, leak with one."""
    sites = oracle.groupBy("file", "line").agg(F.bool_and("external").alias("_x")).filter("_x").drop("_x")
    rows = sites.join(edges.select("file", "line").distinct().withColumn("_e", F.lit(True)), ["file", "line"], "left")
    return rows.agg(F.count_if(F.col("_e").isNull()).alias("silent_correct"), F.count_if(F.col("_e")).alias("leaks"))


def assertions(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, verdict): a missing metric is a violation, and a failed minimum hides the maximum."""
    rows = thresholds.join(metrics, "metric", "left")
    kind = F.when(F.col("value").isNull(), F.lit("missing")).when(F.col("value") < F.col("min"), F.lit("below min")).when(F.col("value") > F.col("max"), F.lit("above max")).otherwise(F.lit("ok"))
    return rows.select("metric", kind.alias("verdict"))


def verdicts(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case, passed, reasons): for each case what was missing, forbidden or unexpected, reasons joined in order."""
    e, o = expected.select("case", "identity", "state"), observed.select("case", "identity").distinct().withColumn("_seen", F.lit(True))
    both = e.join(o, ["case", "identity"], "full")
    why = F.when((F.col("state") == "present") & F.col("_seen").isNull(), F.concat(F.lit("missing "), F.col("identity").cast("string")))
    why = why.when((F.col("state") == "absent") & F.col("_seen"), F.concat(F.lit("forbidden "), F.col("identity").cast("string")))
    reasons = both.withColumn("why", why).groupBy("case").agg(F.array_sort(F.collect_list("why")).alias("r"))
    return reasons.select("case", (F.size("r") == 0).alias("passed"), F.array_join("r", "; ").alias("reasons"))
