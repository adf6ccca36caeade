"""Shape of the flow: condensation, concentration, islands, choke points, and robustness of the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.operators import reach as rc
from scopeflow.settings import WEIGHTINGS


def dag_nodes(estate) -> DataFrame:
    """One row per cycle cluster or single system: members, size, is_cycle (also for a self-loop), whether any carries, highest tier."""
    loops = estate.flat.where("src = dst").select(F.col("src").alias("id"), F.lit(1).alias("loop"))
    rows = estate.components.join(estate.nodes.select("id", "carries_pan", "tier"), "id").join(loops, "id", "left")
    return rows.groupBy("scc").agg(
        rc.joined(F.collect_list("id")).alias("members"),
        F.count("*").alias("size"),
        ((F.count("*") > 1) | (F.count("loop") > 0)).alias("is_cycle"),
        F.max("carries_pan").alias("carries_pan"),
        F.max("tier").alias("tier"),
    )


def dag_edges(estate) -> DataFrame:
    c = estate.components
    e = estate.flat.join(c.select(F.col("id").alias("src"), F.col("scc").alias("from_scc")), "src").join(c.select(F.col("id").alias("dst"), F.col("scc").alias("to_scc")), "dst")
    return e.where("from_scc <> to_scc").groupBy("from_scc", "to_scc").agg(F.count("*").alias("weight"))


def cycles(estate) -> DataFrame:
    """Members and inner edges of every cycle cluster."""
    c = estate.components
    inner = estate.flat.join(c.select(F.col("id").alias("src"), "scc"), "src").join(c.select(F.col("id").alias("dst"), F.col("scc").alias("to_scc")), "dst").where("scc = to_scc")
    edges = inner.groupBy("scc").agg(rc.joined(F.collect_list(F.concat("src", F.lit(">"), "dst"))).alias("inner_edges"))
    return dag_nodes(estate).where("is_cycle").join(edges, "scc").select("scc", "members", "size", "inner_edges")


def concentration(estate) -> DataFrame:
    """(n, gini, hhi, top5_share) of downstream reach within scope."""
    rows = estate.facts.where("in_scope").select("reach")
    # Systems of one reach hold consecutive ranks, so a row for each reach is enough; values that differ are few, as their sum is no more than all reach.
    h = rows.groupBy("reach").agg(F.count("*").alias("c"))
    h = h.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("reach").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.col("c") * F.col("before") + F.expr("c * (c + 1) div 2")
    a = h.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("c") * F.col("reach")).alias("total"), F.sum(ranks * F.col("reach")).alias("weighted"), F.sum(F.col("c") * F.col("reach").cast("double") * F.col("reach")).alias("squares"))
    a = a.crossJoin(F.broadcast(rows.orderBy(F.desc("reach")).limit(5).agg(F.sum("reach").alias("top"))))  # one row each
    n, total = F.col("n"), F.col("total")
    return a.select(
        "n",
        F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.bround(2 * F.col("weighted") / (n * total) - (n + 1) / n, 3)).alias("gini"),
        F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.bround(F.col("squares") / (total.cast("double") * total), 4)).alias("hhi"),
        F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.bround(100 * F.col("top") / total, 1)).alias("top5_share"),
    )


def islands(estate) -> DataFrame:
    """(island, systems) of the flow within scope."""
    return rc.weak_components(estate.scope, estate.scope_edges).groupBy("island").agg(F.count("*").alias("systems"))


def depth(estate) -> int:
    """Edges of the longest path within scope, cycle clusters taken as one."""
    c = rc.cycle_labels(estate.scope_edges)
    e = estate.scope_edges
    for end in ("src", "dst"):
        e = e.join(c.select(F.col("id").alias(end), F.col("scc").alias("s")), end, "left").withColumn(end, F.coalesce("s", end)).drop("s")
    return rc.longest_path(e.where("src <> dst").distinct())


def choke_points(estate) -> DataFrame:
    """(system, branch_size, downstream_reach, risk, is_true_source): articulation points of the flow in scope, and what hangs below each."""
    points = rc.articulation_points(estate.scope_edges)
    below = rc.closure(estate.scope_edges, points).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("branch_size"))
    rows = points.join(below, "id", "left").join(estate.facts.select("id", "reach", "risk", "source_flag"), "id")
    return rows.select(F.col("id").alias("system"), F.coalesce("branch_size", F.lit(0)).alias("branch_size"), F.col("reach").alias("downstream_reach"), "risk", (F.col("source_flag") > 0).alias("is_true_source"))


def metrics(estate) -> DataFrame:
    """One row on the flow within scope: concentration of reach, the longest path, islands, choke points (the twelve widest, and how many), its size, and
    the least rank correlation of the risk ranking under other weightings."""
    points = rc.articulation_points(estate.scope_edges).join(estate.facts.select("id", "reach"), "id")
    order = F.array_sort(F.collect_list(F.struct((-F.col("reach")).alias("far"), "id")))
    choke = points.agg(F.array_join(F.slice(F.transform(order, lambda x: x["id"]), 1, 12), ",").alias("choke_points"), F.count("*").alias("choke_point_count"))
    others = weight_sensitivity(estate).where(F.col("scenario") != next(iter(WEIGHTINGS))).agg(F.min("rho").alias("least_rho"))
    parts = (islands(estate).agg(F.count("*").alias("pan_islands")), choke, estate.scope_edges.agg(F.count("*").alias("edges")), others)
    out = concentration(estate).withColumn("propagation_depth", F.lit(depth(estate)))
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def ranks_by_weighting(estate) -> DataFrame:
    """(scenario, id, rank) of every system that holds card data, under each weighting."""
    f = estate.facts.where("is_source").select("id", F.bround(F.col("tier") / 4, 4).alias("f1"), F.bround("reach_norm", 4).alias("f2"), F.bround("b_norm", 4).alias("f3"), F.col("source_flag").alias("f4"))
    w = F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.lit(x).alias(f"w{i + 1}") for i, x in enumerate(ws)]) for name, ws in WEIGHTINGS.items()]))
    r = f.withColumn("w", w).select("w.scenario", "id", F.bround(sum((F.col(f"w.w{i}") * F.col(f"f{i}") for i in (2, 3, 4)), F.col("w.w1") * F.col("f1")), 10).alias("risk"))
    return r.select("scenario", "id", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("risk"), "id")).cast("long").alias("rank"))


def weight_sensitivity(estate) -> DataFrame:
    """Per weighting: rank correlation with the base, and how many of the base's first five stay."""
    r = ranks_by_weighting(estate)
    base = r.where(F.col("scenario") == next(iter(WEIGHTINGS))).select("id", F.col("rank").alias("base"))
    m = F.count("*")
    rho = F.when(m < 2, 1.0).otherwise(F.bround(1 - 6 * F.sum((F.col("rank") - F.col("base")) * (F.col("rank") - F.col("base"))) / (m * (m * m - 1)), 3))
    return r.join(base, "id").groupBy("scenario").agg(
        rho.alias("rho"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col("base") <= 5), 1).otherwise(0)).alias("top5_overlap"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "id")))), lambda t: t["id"]), ",").alias("top5"),
        m.alias("universe"),
    )


def weight_tracked(estate, k: int = 8) -> DataFrame:
    """The base ranking's first systems, and their best and worst rank."""
    r = ranks_by_weighting(estate)
    base = F.max(F.when(F.col("scenario") == next(iter(WEIGHTINGS)), F.col("rank")))
    return r.groupBy(F.col("id").alias("system")).agg(base.alias("base_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank")).where(F.col("base_rank") <= k)
