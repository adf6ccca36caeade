"""Requirement families, economics, owners, flows between owners, onboarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.functions.text import any_of
from scopeflow.operators import impact as im
from scopeflow.operators import reach as rc
from scopeflow.settings import TIER_CRITICAL, TIER_HIGH, TIER_NONE, Cost

NO_OWNER = "(not recorded in BAM)"
# Families of requirements in order, with what triggers each.
FAMILY_LABELS = {
    "req3": "Protect stored account data",
    "req4": "Protect cardholder data during transmission",
    "req3_sad": "Sensitive authentication data must not be retained",
    "req7_8": "Restrict and authenticate access",
    "req10": "Log and monitor access",
    "req11": "Test security regularly",
}


def families(category: Column, col=F.col) -> Column:
    inside = category != "out"
    when = {
        "req3": col("pan_store"),
        "req4": any_of(col("pan_process"), col("detokenizes")),
        "req3_sad": any_of(col("full_track"), col("pin")),
        "req7_8": F.lit(True),
        "req10": any_of(col("pan_in_logs"), col("observed"), col("carries_pan")),
        "req11": F.lit(True),
    }
    return F.filter(F.array(*[F.when(inside & c, F.lit(k)) for k, c in when.items()]), lambda x: x.isNotNull())


def hidden(estate) -> DataFrame:
    """Systems seen with card data in logs that the inventory calls out of scope."""
    rows = estate.facts.where("hidden")
    own = families(F.lit("cde"), lambda c: F.lit(True) if c in ("carries_pan", "pan_in_logs") else F.col(c))
    return rows.select(F.col("id").alias("system"), F.col("app_name").alias("name"), F.col("reach").alias("downstream_reach"), "stated_source", F.coalesce(F.nullif("finding", F.lit("")), F.lit("True PAN in logs")).alias("finding"), F.array_join(own, ",").alias("requirements"))


def economics(estate, saturation: DataFrame) -> DataFrame:
    c: Cost = estate.settings.cost
    cats = estate.facts.agg(F.count_if(F.col("category") == "cde").alias("now"), F.count_if(F.col("category") == "connected").alias("connected"))
    rows = cats.crossJoin(F.broadcast(saturation.agg(F.max("fully_descoped").alias("most"))))  # one row each
    rows = rows.withColumn("floor", F.greatest(F.lit(0), F.col("now") - F.col("most")))
    days = lambda n: F.col(n) * c.days_per_cde + F.col("connected") * c.days_per_connected
    cost = lambda n: F.bround(days(n) * c.day_rate)
    posture = lambda n: F.when(F.col(n) > c.roc_threshold, "ROC").otherwise("SAQ-D")
    return rows.select(
        F.col("now").alias("in_scope_now"),
        F.col("floor").alias("achievable_floor"),
        (F.col("now") - F.col("floor")).alias("removable"),
        posture("now").alias("posture_now"),
        posture("floor").alias("posture_floor"),
        F.bround(days("now"), 1).alias("days_now"),
        F.bround(days("floor"), 1).alias("days_floor"),
        cost("now").alias("cost_now"),
        cost("floor").alias("cost_floor"),
        (cost("now") - cost("floor")).alias("cost_saving"),
    )


def _owner() -> Column:
    return F.coalesce(F.nullif(F.trim("line_of_business"), F.lit("")), F.lit(NO_OWNER)).alias("line_of_business")


def ownership(estate) -> DataFrame:
    flagged = lambda c: F.count_if(F.col(c))
    rows = estate.facts.withColumn("owner", _owner())
    return rows.groupBy(F.col("owner").alias("line_of_business")).agg(
        F.count("*").alias("systems"),
        flagged("in_scope").alias("in_scope"),
        flagged("hidden").alias("hidden_pci"),
        flagged("carries_pan").alias("carries_pan"),
        F.array_join(F.slice(F.sort_array(F.collect_list(F.when(F.col("hidden"), F.col("id")))), 1, 8), ",").alias("hidden_sample"),
        F.array_join(F.slice(F.sort_array(F.collect_set(F.nullif("business_group", F.lit("")))), 1, 3), ",").alias("business_groups"),
    )


def sankey_links(estate, top: int = 8) -> DataFrame:
    """Origins (the widest by name, the others as one), relays, consumers: distinct systems in scope on each link."""
    group = im.origin_ranks(estate).select("origin", F.when(F.col("rank") <= top, F.concat(F.lit("src:"), "origin")).otherwise("src:other").alias("source"))
    forwards = estate.scope_edges.select(F.col("src").alias("id")).distinct().withColumn("relay", F.lit(True))
    down = estate.above.where("origin <> id").join(group, "origin").join(forwards, "id", "left")
    links = down.groupBy("source", F.when(F.col("relay"), "relays").otherwise("consumers").alias("target")).agg(F.countDistinct("id").alias("value"))
    relays = forwards.agg(F.count("*").alias("value")).where("value > 0").select(F.lit("relays").alias("source"), F.lit("consumers").alias("target"), "value")
    return links.unionAll(relays)


def sankey_nodes(estate, top: int = 8) -> DataFrame:
    r = im.origin_ranks(estate)
    named = r.where(F.col("rank") <= top).select(F.concat(F.lit("src:"), "origin").alias("id"), F.col("origin").alias("label"), F.lit(0).alias("band"))
    others = r.where(F.col("rank") > top).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("src:other").alias("id"), F.concat("n", F.lit(" other sources")).alias("label"), F.lit(0).alias("band"))
    fixed = estate.spark.createDataFrame([("relays", "relays (carry & forward PAN)", 1), ("consumers", "terminal consumers", 2)], "id string, label string, band int")
    return named.unionAll(others).unionAll(fixed)


def lob_flow(estate) -> DataFrame:
    """Edges between owners whose source is in scope, with the sources that make them."""
    n = estate.facts.select("id", "in_scope", _owner())
    e = estate.flat.join(n.select(F.col("id").alias("src"), F.col("line_of_business").alias("from_lob"), "in_scope"), "src").where("in_scope")
    e = e.join(n.select(F.col("id").alias("dst"), F.col("line_of_business").alias("to_lob")), "dst").where("from_lob <> to_lob")
    return e.groupBy("from_lob", "to_lob").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


def onboarding(estate, app: str, providers: list[str], consumers: list[str] | None = None, **flags: bool) -> DataFrame:
    """One row on a system that is not there yet: category, tier, origins above it, what it would pull into scope."""
    named = lambda ids: sorted({str(x).strip().upper() for x in ids or [] if str(x).strip()})
    f, spark = estate.facts, estate.spark
    way = [(x, "p") for x in named(providers)] + [(x, "c") for x in named(consumers)]
    given = spark.createDataFrame(way, "id string, way string").join(f.select("id", "in_scope"), "id", "left")
    prov = given.where("way = 'p' and in_scope is not null").select("id")
    above = rc.closure(estate.flat.select(F.col("dst").alias("src"), F.col("src").alias("dst")), prov).select(F.col("dst").alias("id")).union(prov).distinct()
    roots = above.join(f.where("is_origin").select("id", "always_cde"), "id")
    always = any(flags.get(k) for k in ("detokenizes", "full_track", "pin"))
    own = bool(flags.get("pan")) or always
    pulled = given.where("way = 'c' and not in_scope").select("id")
    pulled = rc.closure(estate.flat, pulled).select(F.col("dst").alias("id")).union(pulled).distinct().join(f.where("not in_scope").select("id"), "id", "left_semi")
    ids = lambda c: rc.joined(F.collect_set(c))
    out = given.agg(
        ids(F.when((F.col("way") == "p") & F.col("in_scope"), F.col("id"))).alias("pan_providers"),
        ids(F.when((F.col("way") == "p") & F.col("in_scope").isNotNull(), F.col("id"))).alias("providers_resolved"),
        ids(F.when((F.col("way") == "c") & F.col("in_scope").isNotNull(), F.col("id"))).alias("consumers_resolved"),
        ids(F.when((F.col("way") == "p") & F.col("in_scope").isNull(), F.col("id"))).alias("unknown_providers"),
        ids(F.when((F.col("way") == "c") & F.col("in_scope").isNull(), F.col("id"))).alias("unknown_consumers"),
        F.coalesce(F.max(F.col("in_scope") & (F.col("way") == "p")), F.lit(False)).alias("receives_clear_pan"),
        F.coalesce(F.max(F.col("in_scope") & (F.col("way") == "c")), F.lit(False)).alias("feeds_scope"),
    )
    out = out.crossJoin(F.broadcast(roots.agg(ids("id").alias("origins_reaching"), F.count("*").alias("n_origins"), ids(F.when(F.col("always_cde"), F.col("id"))).alias("blocking"))))
    out = out.crossJoin(F.broadcast(pulled.agg(F.count("*").alias("n_pulled"), F.array_join(F.slice(F.sort_array(F.collect_set("id")), 1, 20), ",").alias("pulled"))))
    holds = F.col("receives_clear_pan") | own
    category = F.when(holds, "cde").when(F.col("feeds_scope"), "connected").otherwise("out")
    profile = {"carries_pan": holds, "detokenizes": F.lit(bool(flags.get("detokenizes"))), "full_track": F.lit(bool(flags.get("full_track"))), "pin": F.lit(bool(flags.get("pin"))), "pan_store": F.lit(bool(flags.get("pan")))}
    verdict = (
        F.when(F.lit(always), "permanent: it holds data that tokenization upstream cannot remove")
        .when(F.lit(own), "enters scope as a new source of card data")
        .when(F.col("receives_clear_pan"), F.concat(F.lit("in scope because it is fed by "), F.col("pan_providers")))
        .when(category == "connected", "holds no card data but touches systems in scope")
        .otherwise("out of scope as designed")
    )
    return out.select(
        F.lit((app or "").strip().upper() or "NEW-APP").alias("app_id"),
        category.alias("category"),
        F.when(holds, TIER_CRITICAL).otherwise(TIER_HIGH if flags.get("crn_only") else TIER_NONE).alias("tier"),
        "receives_clear_pan", "pan_providers", "providers_resolved", "consumers_resolved", "unknown_providers", "unknown_consumers", "origins_reaching", "n_origins", "blocking",
        ((category == "cde") & ~F.lit(own) & (F.col("n_origins") > 0) & (F.col("blocking") == "")).alias("can_fully_descope"),
        F.lit(always).alias("permanent_cde"),
        F.lit(bool(flags.get("crn_only"))).alias("crn_only"),
        F.when(holds, F.col("n_pulled")).otherwise(0).cast("long").alias("scope_expansion"),
        F.when(holds, F.col("pulled")).otherwise("").alias("expansion_sample"),
        F.array_join(families(category, lambda c: profile.get(c, F.lit(False))), ",").alias("requirements"),
        verdict.alias("verdict"),
    )


def onboarding_scenarios(estate) -> DataFrame:
    """Four systems that could come: one fed by the widest source, one that originates card data for a system out of scope, one that reads tokens only, one
    that detokenizes. Those that need a system which isn't there are left out."""
    f = estate.facts
    top = [r.id for r in f.where("is_source").orderBy(F.desc("reach"), F.desc("solo"), F.desc("risk"), "id").limit(1).collect()]
    out = [r.id for r in f.where("not in_scope and not carries_pan and not hidden").orderBy("id").limit(1).collect()]
    rows = [onboarding(estate, "NEW-CONS", top)] if top else []
    rows += [onboarding(estate, "NEW-ORIG", [], out, pan=True)] if out else []
    rows += [onboarding(estate, "NEW-CRN", [], top, crn_only=True), onboarding(estate, "NEW-DETOK", top, detokenizes=True)]
    both = rows[0]
    for row in rows[1:]:
        both = both.unionAll(row)
    return both


def category_sheet(estate) -> DataFrame:
    """(place, name, systems): the three categories, then each family of requirements by its label, the most frequent first."""
    names = {"cde": "In scope (CDE)", "connected": "Connected-to (also in scope)", "out": "Out of scope"}
    kinds = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(k).alias("category"), F.lit(v).alias("name")) for i, (k, v) in enumerate(names.items())]))
    known = estate.spark.range(1).select(kinds.alias("x")).select("x.*").join(estate.facts.groupBy("category").agg(F.count("*").alias("m")), "category", "left")
    known = known.select("place", "name", F.coalesce("m", F.lit(0)).alias("systems"))
    tallies = estate.facts.select(F.explode(families(F.col("category"))).alias("family")).groupBy("family").agg(F.count("*").alias("systems"))
    label = F.coalesce(*[F.when(F.col("family") == k, v) for k, v in FAMILY_LABELS.items()], F.col("family"))
    place = F.row_number().over(Window.orderBy(F.desc("systems"), "family")) + len(names)  # six families
    return known.unionAll(tallies.select(place.alias("place"), label.alias("name"), "systems"))


def pan_reconciliation(estate) -> DataFrame:
    """Declared against observed holders of card data."""
    n = F.count_if
    return estate.facts.agg(n("carries_pan").alias("declared"), n("observed").alias("observed"), n("hidden").alias("hidden"), n(F.col("carries_pan") & F.col("observed")).alias("overlap"), n("is_source").alias("either"))


def totals(estate) -> DataFrame:
    n = F.count_if
    return estate.facts.agg(F.count("*").alias("systems"), n("in_scope").alias("in_scope"), n("confirmed").alias("confirmed"), n(F.col("in_scope") & ~F.col("confirmed")).alias("inferred_only"), n("hidden").alias("hidden"), n("carries_pan").alias("carriers"), n("is_origin").alias("origins"), n(F.col("carries_pan") | F.col("is_origin")).alias("pan_systems"))


def lob_report(estate) -> DataFrame:
    n = F.count_if
    return estate.facts.withColumn("lob", _owner()).groupBy("lob").agg(F.count("*").alias("systems"), n("in_scope").alias("in_scope"), n("hidden").alias("hidden"), n("carries_pan").alias("carriers"), n("is_origin").alias("sources"), F.max("risk").alias("max_risk"))


def exposure_map(estate) -> DataFrame:
    return estate.facts.where("in_scope").withColumn("lob", _owner()).groupBy("lob").agg(F.sum(1 + F.col("reach")).alias("weight"), F.count("*").alias("systems"))


def scope_rollup(estate) -> DataFrame:
    """Systems and mean risk by owner and category, with subtotals."""
    rows = estate.facts.withColumn("lob", _owner()).rollup("lob", "category").agg(F.count("*").alias("systems"), F.bround(F.avg("risk"), 4).alias("mean_risk"), F.grouping_id().cast("long").alias("level"))
    return rows.select(F.coalesce("lob", F.lit("*")).alias("lob"), F.coalesce("category", F.lit("*")).alias("category"), "systems", "mean_risk", "level")
