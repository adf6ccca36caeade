"""What is known of each system: scope, origins, reach, exclusivity, scores. One row per system, computed once per estate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.functions.text import any_of
from scopeflow.operators import reach as rc
from scopeflow.settings import Settings


def with_missing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and a profile of false and empty for ids that only edges name."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(nodes, "id", "left_anti")
    fill = {"boolean": F.lit(False), "string": F.lit(""), "int": F.lit(0)}
    return nodes.unionByName(ids.select("id", *[fill[t].alias(c) for c, t in nodes.dtypes if c != "id"]))


def true_origins(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id): sources with no other source upstream outside their own cycle, and all that always stay in scope among the sources."""
    s = nodes.where("carries_pan or observed").select("id")
    up = pairs.where("src <> dst").select("src", "dst").join(s.withColumnRenamed("id", "src"), "src", "left_semi").join(s.withColumnRenamed("id", "dst"), "dst", "left_semi")
    back = up.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    fed = up.join(back, ["src", "dst"], "left_anti").select(F.col("dst").alias("id")).distinct()
    always = nodes.where("(full_track or pin or detokenizes) and (carries_pan or observed)").select("id")
    return s.join(fed, "id", "left_anti").union(always).distinct()


def reached(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): starts and all that they reach."""
    down = pairs.join(starts.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return starts.select("id").unionAll(down).distinct()


def ancestry(pairs: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, id): origins above each system, an origin above itself too."""
    down = pairs.where("src <> dst").join(origins.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("id"))
    return down.unionAll(origins.select(F.col("id").alias("origin"), "id"))


def risk_of(settings: Settings) -> Column:
    w = settings.weights
    return w.sensitivity * F.col("tier") / 4 + w.reach * F.col("reach_norm") + w.betweenness * F.col("b_norm") + w.source * F.col("source_flag")


def scores(nodes: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """(id, reach, out_degree, in_degree, b_norm, reach_norm, source_flag, risk)."""
    down = rc.reach_counts(edges)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    rows = nodes.select("id", "tier", any_of(F.col("carries_pan"), F.col("observed")).alias("holds"))
    for part in (down, out, into, rc.betweenness(nodes, edges, settings.exact_up_to, settings.pivots)):
        rows = rows.join(part, "id", "left")
    rows = rows.fillna(0)
    top = rows.agg(F.greatest(F.max("reach"), F.lit(1)).alias("top_reach"), F.greatest(F.max("b"), F.lit(1e-9)).alias("top_b"))
    rows = rows.crossJoin(F.broadcast(top))  # one row
    rows = rows.withColumns({"reach_norm": F.col("reach") / F.col("top_reach"), "b_norm": F.col("b") / F.col("top_b"), "source_flag": F.when((F.col("in_degree") == 0) & F.col("holds"), 1.0).otherwise(0.0)})
    return rows.withColumn("risk", F.bround(100 * risk_of(settings), 2)).select("id", "reach", "out_degree", "in_degree", "b_norm", "reach_norm", "source_flag", "risk")


def confirmed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): reached over metadata edges alone from carriers that were not seen in logs as well."""
    seeds = nodes.where("carries_pan and not observed").select("id")
    return reached(rc.closure(edges.where("provenance = 'metadata'"), seeds), seeds)


def facts(nodes: DataFrame, edges: DataFrame, flat: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """The table of all systems. ``edges`` are the rows, ``flat`` the distinct pairs, ``pairs`` their closure from the sources."""
    origins = true_origins(nodes, pairs)
    sources = nodes.where("carries_pan or observed").select("id")
    above = ancestry(pairs, origins)
    counts = above.groupBy("id").agg(F.count("*").alias("origin_count"))
    only = above.join(counts.where("origin_count = 1"), "id", "left_semi").where("origin <> id").groupBy(F.col("origin").alias("id")).agg(F.count("*").alias("solo"))
    out = nodes.join(scores(nodes, flat, settings), "id")
    for name, part in (("is_origin", origins), ("in_scope", reached(pairs, sources)), ("confirmed", confirmed(nodes, edges))):
        out = out.join(part.withColumn(name, F.lit(True)), "id", "left")
    out = out.join(counts, "id", "left").join(only, "id", "left").fillna(0, ["origin_count", "solo"]).fillna(False, ["is_origin", "in_scope", "confirmed"])
    out = out.withColumns({
        "is_source": any_of(F.col("carries_pan"), F.col("observed")),
        "always_cde": any_of(F.col("full_track"), F.col("pin"), F.col("detokenizes")),
        "hidden": F.col("observed") & ~F.col("pci_flag"),
        "confirmed": F.col("confirmed") & F.col("in_scope"),
        "solo": F.when(F.col("is_origin"), F.col("solo")).otherwise(0).cast("long"),
    })
    into_scope = flat.join(out.where("in_scope").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("touches", F.lit(True))
    out = out.join(into_scope, "id", "left").fillna(False, ["touches"])
    return out.withColumn("category", F.when(F.col("in_scope"), "cde").when(F.col("touches"), "connected").otherwise("out"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank (from 1) in an order that ends with id. Takes aggregates or one row per system: all rows meet in one task."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.col("id"))).cast("long"))
