"""What an explorer shows: graph payload, filters, neighbourhoods, waves, fates, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.operators import impact as im
from scopeflow.operators import reach as rc


def viz_nodes(estate) -> DataFrame:
    f = estate.facts
    return f.select("id", "app_name", "tier", "carries_pan", "in_scope", F.when(F.col("in_scope"), F.when(F.col("confirmed"), "confirmed").otherwise("inferred")).otherwise("").alias("basis"), "category", "hidden", "is_origin", "reach", "risk")


def viz_edges(estate) -> DataFrame:
    """One edge per pair: metadata before inferred, all its datasets, how often, and its first signal by name."""
    return estate.edges.groupBy("src", "dst").agg(
        F.when(F.max(F.col("provenance") == "metadata"), "metadata").otherwise("inferred").alias("provenance"),
        rc.joined(F.collect_set("source_dataset")).alias("datasets"),
        F.count("*").alias("count"),
        F.coalesce(F.min(F.nullif("signal", F.lit(""))), F.lit("")).alias("signal"),
    )


def _around(estate, chosen: DataFrame, whole: Column | None = None) -> DataFrame:
    e = estate.flat.join(chosen.select(F.col("id").alias("src")), "src", "left_semi")
    return chosen.select("id").union(e.select("dst")).distinct()


def filter_pan(estate) -> DataFrame:
    """Systems on an edge whose source carries, originates or hides card data."""
    keep = estate.facts.where("carries_pan or is_origin or hidden").select("id")
    e = estate.flat.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def filter_heavy(estate) -> DataFrame:
    return _around(estate, im.heavy_hitters(estate).select(F.col("system").alias("id")))


def search(estate, text: str = "", lob: str = "", reaching: bool = False) -> DataFrame:
    rows = estate.facts.where(F.lower("id").contains(text.lower()) | F.lower("app_name").contains(text.lower()))
    rows = rows.where(F.col("line_of_business") == lob) if lob else rows
    rows = rows.where("reach > 0") if reaching else rows
    return rows.select("id", "app_name", "line_of_business", "reach")


def widest(estate) -> str | None:
    first = estate.facts.where("is_source").orderBy(F.desc("reach"), "id").select("id").first()
    return first.id if first else None


def below(estate, root: str, up: bool = False) -> DataFrame:
    """(id, hops) of all that one system reaches, or that reaches it."""
    e = estate.flat if not up else estate.flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = estate.spark.createDataFrame([(root,)], "id string")
    return rc.closure(e, start).where(F.col("dst") != root).select(F.col("dst").alias("id"), "hops")


def hop_rings(estate, root: str) -> DataFrame:
    """Systems by distance below one source."""
    return below(estate, root).groupBy("hops").agg(F.count("*").alias("systems"))


def blast_radius(estate, root: str) -> DataFrame:
    """Systems in scope below one source, and whether it alone reaches them."""
    down = below(estate, root)
    f = estate.facts.where("in_scope").select("id", "origin_count")
    return down.join(f, "id").select("id", "hops", F.when(F.col("origin_count") == 1, "solo").otherwise("feed").alias("kind"))


def trace_lineage(estate, target: str, most: int = 5) -> DataFrame:
    """A shortest path to ``target`` from each of the ``most`` least source ids that reach it, each step to the least id that keeps it shortest."""
    into = below(estate, target, up=True)
    sources = into.join(estate.facts.where("is_source").select("id"), "id").orderBy("id").limit(most)
    walks = sources.select(F.col("id").alias("source"), F.col("id").alias("at"), "hops", F.col("id").alias("path"))
    done = walks.where("hops < 0")
    far = sources.agg(F.max("hops")).first()[0] or 0
    near = into.unionAll(estate.spark.createDataFrame([(target, 0)], "id string, hops int")).groupBy("id").agg(F.min("hops").alias("left"))
    for _ in range(far):
        step = walks.where("hops > 0").join(estate.flat.withColumnRenamed("src", "at"), "at").join(near.withColumnRenamed("id", "dst"), "dst").where("left = hops - 1")
        best = step.groupBy("source", "hops", "path").agg(F.min("dst").alias("dst"))
        done = done.unionAll(walks.where("hops = 0"))
        walks = best.select("source", F.col("dst").alias("at"), (F.col("hops") - 1).alias("hops"), F.concat("path", F.lit(">"), "dst").alias("path"))
    return done.unionAll(walks.where("hops = 0")).select("source", "path")


def lineage_walk(estate, target: str, per_node: int = 3, depth: int = 7, most: int = 5) -> DataFrame:
    """Up to ``most`` upward paths: up to ``per_node`` providers at each system (the least ids), to a true source or ``depth`` steps."""
    stop = estate.facts.select(F.col("id").alias("at"), "is_origin")
    up = estate.flat.where("src <> dst").select(F.col("dst").alias("at"), "src", F.row_number().over(Window.partitionBy("dst").orderBy("src")).alias("n")).where(F.col("n") <= per_node)
    walks = estate.spark.createDataFrame([(target, [target])], "at string, path array<string>")
    done = None
    for step in range(depth + 1):
        here = walks.join(stop, "at")
        ends = here.where("is_origin" if step < depth else "true").select("path")
        done = ends if done is None else done.unionAll(ends)
        walks = here.where("not is_origin").join(up, "at").where(~F.array_contains("path", F.col("src"))).select(F.col("src").alias("at"), F.concat("path", F.array("src")).alias("path"))
    return done.select(F.array_join("path", "<").alias("path"), (F.size("path") - 1).cast("long").alias("steps")).orderBy("steps", "path").limit(most)


def fate_grid(estate, chosen: list[str]) -> DataFrame:
    """Per system in scope: source (tokenized), freed, or kept."""
    rows = im.fates(estate, im.labelled(estate, {"plan": chosen}))
    return rows.select("id", F.when(F.col("tokenized"), "source").when(F.col("stays"), "kept").otherwise("freed").alias("fate"))


def migration_waves(estate, plan: list[str]) -> DataFrame:
    """Wave 1: planned sources in plan order; 3: systems that always stay; 2: all else in scope, by risk."""
    order = estate.spark.createDataFrame([(s, i) for i, s in enumerate(plan)], "id string, at int")
    rows = estate.facts.where("in_scope").join(order, "id", "left")
    wave = F.when(F.col("at").isNotNull(), 1).when(F.col("always_cde"), 3).otherwise(2)
    w = Window.partitionBy("wave").orderBy(F.col("at").asc_nulls_last(), F.desc("risk"), "id")
    return rows.withColumn("wave", wave).select("id", "wave", F.row_number().over(w).cast("long").alias("position"))


def priority_quadrant(estate, labelled: int = 9) -> DataFrame:
    """Systems by betweenness and risk; a label for those that stand out, the best of them only."""
    f = estate.facts.where("carries_pan or hidden or reach > 0").select("id", F.bround("b_norm", 4).alias("b"), "risk", "reach")
    top = f.agg(F.max("b").alias("top_b"), F.max("risk").alias("top_r"))
    far = estate.facts.where("is_source").orderBy(F.desc("reach"), "id").limit(8).select("id", F.lit(True).alias("far"))
    rows = f.crossJoin(F.broadcast(top)).join(far, "id", "left")
    out = rows.withColumn("stands_out", (F.col("b") > 0.18 * F.col("top_b")) | (F.col("risk") > 0.8 * F.col("top_r")) | F.coalesce("far", F.lit(False)))
    score = F.when(F.col("stands_out"), F.bround(F.col("b") + F.col("risk") / F.col("top_r"), 8))
    place = F.row_number().over(Window.orderBy(score.desc_nulls_last(), "id"))
    return out.withColumn("place", place).select("id", F.col("b").alias("betweenness"), "risk", (F.col("stands_out") & (F.col("place") <= labelled)).alias("labelled"))


def saturation_flag(estate) -> DataFrame:
    """Whether at least 3 of the ten widest origins feed nearly as much as the widest, and that half of scope."""
    top = estate.facts.where("is_origin").orderBy(F.desc("reach"), "id").limit(10).select("reach")
    most = top.agg(F.max("reach").alias("most"))
    scope = estate.scope.agg(F.count("*").alias("scope"))
    rows = top.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(scope))
    near = F.count_if(F.col("reach") >= F.col("most") - F.greatest(F.lit(2.0), 0.02 * F.col("most")))
    return rows.agg(near.alias("near_top"), F.max("most").alias("most"), F.max("scope").alias("scope")).select("near_top", "most", "scope", ((F.col("near_top") >= 3) & (F.col("most") >= 0.5 * F.col("scope"))).alias("saturated"))


def why_in_scope(estate) -> DataFrame:
    """Each system in scope: its origins, and its providers in scope."""
    up = estate.scope_edges.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(rc.joined(F.collect_set("src")).alias("providers"))
    o = estate.above.where("origin <> id").groupBy("id").agg(rc.joined(F.collect_set("origin")).alias("origins"))
    return estate.facts.where("in_scope").select("id", "is_source").join(o, "id", "left").join(up, "id", "left").fillna("", ["origins", "providers"])
