"""An estate: its systems and the flows between them, from CSV roles, from the star schema, or made up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopeflow.functions import text as tx
from scopeflow.settings import TIER_CRITICAL, TIER_HIGH, TIER_NONE, TIER_OBSERVED
from scopeflow.sources import roles
from scopeflow.storage import written

FLAGS = ("in_bam", "pci_flag", "carries_pan", "detokenizes", "pan_store", "pan_process", "crn_only", "full_track", "pin", "pan_in_logs", "feeds_splunk", "observed")
TEXTS = ("data_classification", "app_name", "line_of_business", "business_group", "tech_area", "finding", "stated_source")
# Survey answers that name no system.
NON_SYSTEMS = ("user entry", "credit bureaus", "written in documents", "user input", "manual entry")
EDGE_COLUMNS = ("src", "dst", "provenance", "source_dataset", "environment", "rel_type", "signal")


def _tier(df: DataFrame) -> DataFrame:
    tier = F.when(F.col("carries_pan"), TIER_CRITICAL).when(F.col("pci_flag"), TIER_HIGH).otherwise(TIER_NONE)
    return df.withColumn("tier", F.greatest(tier, F.when(F.col("observed"), TIER_OBSERVED).otherwise(TIER_NONE)))


def systems(df: DataFrame) -> DataFrame:
    """Rows with id and any of FLAGS and TEXTS, completed with false and empty, and the sensitivity tier."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in df.columns else F.lit(False).alias(c) for c in FLAGS]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in TEXTS]
    return _tier(df.select("id", *flags, *texts))


def star_estate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(systems, edges) projected from the star schema: suppliers, and flows from all line items."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k = F.col("s_suppkey")
    carries = (k % 11 == 0) & (k % 7 != 0)
    detok = carries & (k % 44 == 0)
    in_bam = k % 7 != 0
    org = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table("supplier").join(org, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("S"), k).alias("id"),
        in_bam.alias("in_bam"),
        (in_bam & (k % 5 != 0)).alias("pci_flag"),
        carries.alias("carries_pan"),
        detok.alias("detokenizes"),
        (carries & (k % 2 == 0)).alias("pan_store"),
        (carries & (k % 2 == 1)).alias("pan_process"),
        (in_bam & ~carries & (k % 17 == 0)).alias("crn_only"),
        (carries & (k % 3 == 0)).alias("pan_in_logs"),
        (in_bam & (k % 4 == 0)).alias("feeds_splunk"),
        (k % 13 == 4).alias("observed"),
        F.col("s_name").alias("app_name"),
        F.when(in_bam, F.col("n_name")).otherwise("").alias("line_of_business"),
        F.when(in_bam, F.col("r_name")).otherwise("").alias("business_group"),
        F.when(k % 13 == 4, "True PAN").otherwise("").alias("finding"),
    )
    return systems(rows), _star_edges(table("lineitem"), table("supplier"), table("nation"))


def _star_edges(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Flows among suppliers, by how often they follow each other in orders; all line items are counted.

    Recorded, low key to high: each supplier's strongest direct neighbour of no lower key (DS1), and the next two where the supplier is among the
    neighbour's own two strongest (DS2). Recorded, high to low: of each region of the world the pair that most often stands so (DS3);
    these make cycles. Inferred: pairs two items apart that are each other's strongest. Ties go to the least key.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    after = [F.struct(F.lit(gap).alias("gap"), F.lead("l_suppkey", gap).over(order).alias("b")) for gap in (1, 2)]
    items = lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_linestatus") == "O").alias("open"), F.array(*after).alias("after"))
    pairs = items.select("a", "open", F.inline("after")).where("b is not null and (gap = 1 or a <> b)")
    pairs = pairs.groupBy("gap", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("back"), F.count_if("open").alias("open"))
    pairs = written(pairs, "pairs")
    near, apart = pairs.where("gap = 1"), pairs.where("gap = 2")

    rank = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.desc("n"), other))
    forth = near.withColumns({"up": rank("lo", "hi"), "down": rank("hi", "lo")}).where("up = 1 or (up <= 3 and down <= 2)")
    forth = forth.select("lo", "hi", "n", "open", F.when(F.col("up") == 1, "DS1").otherwise("DS2").alias("source_dataset"))
    regions = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("hi"), "n_regionkey")
    turned = near.where("back > 0").join(regions, "hi").groupBy("n_regionkey").agg(F.max(F.struct("back", (-F.col("hi")).alias("hi"), (-F.col("lo")).alias("lo"), "n", "open")).alias("x"))
    turned = turned.select((-F.col("x.hi")).alias("lo"), (-F.col("x.lo")).alias("hi"), "x.n", "x.open", F.lit("DS3").alias("source_dataset"))
    recorded = forth.unionByName(turned).select(
        F.concat(F.lit("S"), "lo").alias("src"),
        F.concat(F.lit("S"), "hi").alias("dst"),
        F.lit("metadata").alias("provenance"),
        "source_dataset",
        F.when(2 * F.col("open") >= F.col("n"), "Production").otherwise("DISASTER RECOVERY/BCP").alias("environment"),
        F.lit("Depends on").alias("rel_type"),
        F.lit("").alias("signal"),
    )
    first = lambda own, other: apart.groupBy(own).agg((-F.max(F.struct("n", (-F.col(other)).alias("x")))["x"]).alias(other))
    inferred = first("lo", "hi").join(first("hi", "lo"), ["lo", "hi"]).select(
        F.concat(F.lit("S"), "lo").alias("src"), F.concat(F.lit("S"), "hi").alias("dst"), F.lit("inferred").alias("provenance"), F.lit("DS5").alias("source_dataset"), F.lit("").alias("environment"), F.lit("").alias("rel_type"), F.lit("DS5_survey_upstream").alias("signal")
    )
    return recorded.unionByName(inferred)


def made_up_estate(spark: SparkSession, n: int, n_sources: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Sources fan out to 15 to 60 systems each, relays have two forward edges, and four edges run back. Every draw is a hash of the seed."""

    def draw(*parts: object) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), *[p if isinstance(p, F.Column) else F.lit(p) for p in parts]), F.lit(1 << 30))

    i = F.col("id")
    nodes = spark.range(n).select(F.concat(F.lit("N"), i).alias("id"), (i < n_sources).alias("carries_pan"), (i < n_sources).alias("pci_flag"), F.lit(True).alias("in_bam"))
    fan = spark.range(n_sources).withColumn("j", F.explode(F.sequence(F.lit(1), (15 + draw("fan", i) % 46).cast("int"))))
    fan = fan.select(i.alias("a"), (n_sources + draw("to", i, F.col("j")) % max(1, n - n_sources)).alias("b"))
    relays = spark.range(n_sources, max(n_sources, n - 1)).withColumn("j", F.explode(F.array(F.lit(1), F.lit(2))))
    relays = relays.select(i.alias("a"), (i + 1 + draw("on", i, F.col("j")) % (n - 1 - i)).alias("b"))
    back = spark.range(4).select((n // 2 + draw("from", i) % max(1, n - n // 2)).alias("a"), (n_sources + draw("back", i) % max(1, n // 2 - n_sources)).alias("b"))
    edges = fan.unionAll(relays).unionAll(back).select(F.concat(F.lit("N"), "a").alias("src"), F.concat(F.lit("N"), "b").alias("dst"))
    extra = {"provenance": F.lit("metadata"), "source_dataset": F.lit("DS1"), "environment": F.lit("Production"), "rel_type": F.lit(""), "signal": F.lit("")}
    return systems(nodes), edges.withColumns(extra)


def csv_estate(found: dict[str, DataFrame], data_flow_edges: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(systems, edges, unresolved signals) from ingested roles (see ``roles.ingest``)."""
    spark = found["quality"].sparkSession

    def col(df: DataFrame, name: str) -> F.Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit("")

    rows = found.get("edges")
    if rows is None:
        edges = spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE_COLUMNS))
    else:
        provider, consumer = tx.extract_id(col(rows, "child app id")), tx.extract_id(col(rows, "parent app id"))
        src, dst = (provider, consumer) if data_flow_edges else (consumer, provider)
        env = F.coalesce(F.nullif(col(rows, "consuming app environment"), F.lit("")), F.nullif(col(rows, "providing app environment"), F.lit("")), F.lit(""))
        edges = rows.select(src.alias("src"), dst.alias("dst"), F.lit("metadata").alias("provenance"), F.col("_source_dataset").alias("source_dataset"), env.alias("environment"), col(rows, "type").alias("rel_type"), F.lit("").alias("signal")).where("src is not null and dst is not null")

    empty = spark.createDataFrame([], "id string")
    bam = _inventory(found["DS4"], col) if "DS4" in found else empty
    known = bam.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()

    signals = []
    if "DS5" in found:
        s = found["DS5"]
        up = next((c for c in s.columns if c.startswith(roles.SURVEY_UPSTREAM)), "")
        down = next((c for c in s.columns if c.startswith(roles.SURVEY_DOWNSTREAM)), "")
        app = tx.extract_id(col(s, roles.SURVEY_KEY))
        signals.append(s.select(app.alias("app"), col(s, up).alias("token"), F.lit("up").alias("way"), F.lit("DS5_survey_upstream").alias("signal")))
        signals.append(s.select(app.alias("app"), col(s, down).alias("token"), F.lit("down").alias("way"), F.lit("DS5_survey_downstream").alias("signal")))
    logs = None
    if "DS6" in found:
        d = found["DS6"]
        logs = d.select(tx.extract_id(col(d, "appid")).alias("id"), col(d, roles.LOG_KEYS[1]).alias("finding"), col(d, "stated upstream source").alias("stated_source")).where("id is not null")
        signals.append(logs.select(F.col("id").alias("app"), F.col("stated_source").alias("token"), F.lit("up").alias("way"), F.lit("DS6_splunk_stated_source").alias("signal")))
    unresolved = spark.createDataFrame([], "token string, reason string, signal string")
    for part in signals:
        own = part.where("app is not null and token <> ''").withColumn("named", tx.extract_id(F.col("token")))
        own = own.join(known.select(F.col("id").alias("named"), F.lit(True).alias("found")), "named", "left")
        nobody = (F.col("way") == "up") & F.lower(F.trim("token")).isin(*NON_SYSTEMS)
        reason = F.when(nobody, "non-system origin category").when(F.col("found").isNull(), F.when(F.col("way") == "up", "unresolved to known system").otherwise("unresolved downstream"))
        own = own.withColumn("reason", reason)
        src, dst = F.when(F.col("way") == "up", F.col("named")).otherwise(F.col("app")), F.when(F.col("way") == "up", F.col("app")).otherwise(F.col("named"))
        resolved = own.where("reason is null").select(src.alias("src"), dst.alias("dst"), F.lit("inferred").alias("provenance"), F.substring("signal", 1, 3).alias("source_dataset"), F.lit("").alias("environment"), F.lit("").alias("rel_type"), "signal")
        edges, unresolved = edges.unionByName(resolved), unresolved.unionByName(own.where("reason is not null").select("token", "reason", "signal"))
    apps = [part.where("app is not null").select(F.col("app").alias("id")) for part in signals]
    ids = known  # apps of signals are systems too, but never targets of later signals
    for part in apps:
        ids = ids.union(part)
    nodes = ids.distinct().join(bam, "id", "left")
    if logs is not None:
        seen = logs.groupBy("id").agg(F.max(F.lower("finding").contains("true pan")).alias("observed"), F.max_by("finding", F.lower("finding").contains("true pan").cast("int")).alias("finding"), F.max("stated_source").alias("stated_source"))
        nodes = nodes.join(seen, "id", "left")
    return systems(nodes), edges, unresolved


def _inventory(d: DataFrame, col) -> DataFrame:
    """Profiles of inventoried systems; of several rows of one id the last in file order counts."""
    yes = lambda name: tx.is_yes(col(d, name))
    pan = "pci_primaryaccountnumber_{}"
    crn = "pci_tokenizedprimaryaccountnumber_{}"
    both = ("processtransmit", "store")
    track = tx.any_of(*[yes(f"pci_fulltrackdata_{k}") for k in both])
    pin = tx.any_of(*[yes(f"pci_personalidentificationnumber_{k}") for k in both])
    carries = tx.any_of(*[yes(pan.format(k)) for k in both], yes("pci_doesassetdetokenizepan"), track, pin)
    out = d.withColumn("_at", F.monotonically_increasing_id()).select(
        tx.extract_id(col(d, roles.INVENTORY_KEY)).alias("id"),
        "_at",
        F.lit(True).alias("in_bam"),
        yes("pci").alias("pci_flag"),
        carries.alias("carries_pan"),
        yes("pci_doesassetdetokenizepan").alias("detokenizes"),
        yes(pan.format("store")).alias("pan_store"),
        yes(pan.format("processtransmit")).alias("pan_process"),
        (~carries & tx.any_of(*[yes(crn.format(k)) for k in both])).alias("crn_only"),
        track.alias("full_track"),
        pin.alias("pin"),
        yes("pci_doespanincleartextlogfiles").alias("pan_in_logs"),
        yes("feeds_splunk").alias("feeds_splunk"),
        *[col(d, c).alias(c) for c in ("data_classification", "line_of_business", "business_group", "tech_area")],
        col(d, "application_name").alias("app_name"),
    )
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))
    return out.where("id is not null").withColumn("_n", last).where("_n = 1").drop("_n", "_at")
