"""What tokenizing a set of sources changes, and rankings of sources by it.

A system leaves scope if every origin above it is tokenized; a tokenized source itself stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.operators.reach import joined
from scopeflow.settings import TIER_HIGH


MOST_LABELS = 1000  # scenarios that are compared at once


def fates(estate, chosen: DataFrame) -> DataFrame:
    """(label, id, stays, fed, tokenized) for each labelled set of ``chosen`` (label, id) and each system in scope."""
    facts = estate.facts.where("in_scope").select("id", "origin_count", "is_origin")
    picked = chosen.select("label", "id").distinct()
    hit = estate.above.join(picked.withColumnRenamed("id", "origin"), "origin").groupBy("label", "id").agg(F.count("*").alias("gone"))
    labels = [r.label for r in picked.select("label").distinct().limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} scenarios at once")
    rows = facts.withColumn("label", F.explode(F.array(*map(F.lit, labels)).cast("array<string>")))
    rows = rows.join(hit, ["label", "id"], "left").join(picked.withColumn("tokenized", F.lit(True)), ["label", "id"], "left").fillna(0, ["gone"]).fillna(False, ["tokenized"])
    stays = F.col("tokenized") | (F.col("gone") < F.col("origin_count"))
    return rows.select("label", "id", stays.alias("stays"), (F.col("gone") > 0).alias("fed"), "tokenized")


def impact(estate, chosen: DataFrame) -> DataFrame:
    """One row per label: scope, feeds, edges and risk before and after."""
    w = estate.settings.weights.sensitivity
    f = estate.facts.select("id", "risk", "tier", "always_cde", "detokenizes", "out_degree")
    rows = fates(estate, chosen).join(f, "id")
    lower = F.col("tokenized") & (F.col("tier") > TIER_HIGH) & ~F.col("always_cde")
    after = F.when(lower, F.bround(F.col("risk") - 100 * w * (F.col("tier") - TIER_HIGH) / 4, 2)).otherwise(F.col("risk"))
    feed = F.col("fed") & ~F.col("tokenized")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = rows.groupBy("label").agg(
        F.count("*").alias("scope_before"),
        n(F.col("stays")).alias("scope_after"),
        n(~F.col("stays")).alias("nodes_descoped"),
        n(feed).alias("feeds_removed"),
        n(feed & F.col("stays")).alias("parent_reduction"),
        n(lower).alias("sources_downgraded"),
        n(F.col("tokenized") & ~lower).alias("sources_retained"),
        n(F.col("stays") & F.col("detokenizes") & ~F.col("tokenized")).alias("retained_detok"),
        F.sum("out_degree").alias("pan_edges_before"),
        F.sum(F.when(F.col("stays"), F.col("out_degree")).otherwise(0)).alias("pan_edges_after"),
        F.sum("risk").alias("rb"),
        F.sum(F.when(F.col("stays"), after).otherwise(0.0)).alias("ra"),
        joined(F.collect_set(F.when(~F.col("stays"), F.col("id")))).alias("descoped"),
    )
    pct = lambda a, b: F.when(b == 0, 0.0).otherwise(F.bround(100 * a / b, 1))
    return out.select(
        *[c for c in out.columns if c not in ("rb", "ra", "descoped")],
        F.bround("rb", 1).alias("risk_before"),
        F.bround("ra", 1).alias("risk_after"),
        pct(F.col("rb") - F.col("ra"), F.col("rb")).alias("risk_reduction_pct"),
        pct(F.col("nodes_descoped"), F.col("scope_before")).alias("surface_reduction_pct"),
        "descoped",
    )


def heavy_hitters(estate, k: int = 10) -> DataFrame:
    rows = estate.facts.where("is_source").select(F.col("id").alias("system"), F.col("reach").alias("downstream_reach"), F.col("solo").alias("solo_descope"), "out_degree", "risk", F.bround("b_norm", 4).alias("betweenness"), F.col("is_origin").alias("is_true_source"))
    return rows.orderBy(F.desc("downstream_reach"), F.desc("solo_descope"), F.desc("risk"), "system").limit(k)


def top_intervention(estate, k: int = 10) -> DataFrame:
    """The origin among the widest distributors that frees most alone; all of them where none is an origin."""
    ties = heavy_hitters(estate, k).orderBy(F.desc("is_true_source"), F.desc("solo_descope"), F.desc("downstream_reach"), "system")
    return ties.select("system", "solo_descope", "downstream_reach", "is_true_source").limit(1)


def exposure(estate) -> DataFrame:
    """Each origin's reach, what it frees alone, and what loses its feed."""
    rows = estate.facts.where("is_origin").select("id", F.col("reach").alias("downstream_reach"), F.col("solo").alias("solo_descope"), "risk")
    single = estate.facts.where("origin_count = 1").select("id")
    names = estate.above.where("origin <> id").join(single, "id", "left_semi").groupBy("origin").agg(F.array_join(F.slice(F.sort_array(F.collect_set("id")), 1, 50), ",").alias("solo_systems"))
    out = rows.join(names.withColumnRenamed("origin", "id"), "id", "left")
    return out.select(F.col("id").alias("system"), "downstream_reach", "solo_descope", F.col("downstream_reach").alias("feeds_removed"), (F.col("downstream_reach") - F.col("solo_descope")).alias("parent_reduction"), "risk", F.coalesce("solo_systems", F.lit("")).alias("solo_systems"))


def origin_ranks(estate) -> DataFrame:
    """(origin, rank from 1) by reach, then id; counts origins, so one task ranks them."""
    rows = estate.facts.where("is_origin").select(F.col("id").alias("origin"), "reach")
    return rows.select("origin", F.row_number().over(Window.orderBy(F.desc("reach"), "origin")).cast("long").alias("rank"))


def saturation(estate, points: int = 12) -> DataFrame:
    """How many systems are free once the first k origins by reach are tokenized: a system is when the last of its origins is."""
    ranks = estate.spark.createDataFrame([(i,) for i in range(points + 1)], "i int")
    n = estate.origins.agg(F.count("*").alias("n"))
    ks = ranks.crossJoin(F.broadcast(n)).select(F.when(F.col("i") == points, F.col("n")).otherwise(F.bround(F.col("i") * F.col("n") / points)).cast("long").alias("k"), "n").distinct()
    free = estate.facts.where("in_scope and not is_origin").select("id")
    last = estate.above.join(free, "id", "left_semi").join(origin_ranks(estate), "origin").groupBy("id").agg(F.max("rank").alias("at")).groupBy("at").agg(F.count("*").alias("m"))
    got = last.join(F.broadcast(ks.select("k")), F.col("at") <= F.col("k")).groupBy("k").agg(F.sum("m").alias("fully_descoped"))  # points + 1 rows
    return ks.join(got, "k", "left").select("k", F.bround(100 * F.col("k") / F.greatest("n", F.lit(1)), 1).alias("pct_sources"), F.coalesce("fully_descoped", F.lit(0)).alias("fully_descoped"))


def labelled(estate, sets: dict[str, list[str]]) -> DataFrame:
    rows = [(label, i) for label, ids in sets.items() for i in ids]
    return estate.spark.createDataFrame(rows, "label string, id string")


def block_comparison(estate, greedy: list[str], k: int = 3) -> DataFrame:
    """Impact of the first greedy picks, the widest origins, and the sources of highest betweenness."""
    reach = estate.facts.where("is_origin").orderBy(F.desc("reach"), "id").limit(k).select(F.lit("reach_top").alias("label"), "id")
    between = estate.facts.where("is_source").orderBy(F.desc("b_norm"), "id").limit(k).select(F.lit("betweenness_top").alias("label"), "id")
    rows = labelled(estate, {"greedy": greedy[:k]}) if greedy else reach.limit(0)
    return impact(estate, rows.unionAll(reach).unionAll(between))
