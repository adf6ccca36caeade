"""An estate with its shared tables: written once, used by all operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeflow.operators import facts as fc
from scopeflow.operators import reach as rc
from scopeflow.settings import Settings
from scopeflow.sources import estate as src
from scopeflow.sources import roles
from scopeflow.storage import written


class Estate:
    def __init__(self, nodes: DataFrame, edges: DataFrame, settings: Settings | None = None, unresolved: DataFrame | None = None, quality: DataFrame | None = None):
        self.spark = nodes.sparkSession
        self.settings = settings or Settings.of(self.spark)
        self.edges = written(edges, "edges")
        self.nodes = written(fc.with_missing(nodes, self.edges), "nodes")
        self.unresolved, self.quality = unresolved, quality

    _known: dict[tuple[str, str, str], Estate] = {}

    @classmethod
    def of_star(cls, spark: SparkSession, sf_dir: str) -> Estate:
        """The estate projected from the star schema. It is kept for the application while the files stay the same and its tables are there."""
        files = [spark.read.parquet(f"{sf_dir}/{t}.parquet").inputFiles() for t in ("supplier", "nation", "region", "lineitem")]
        key = (spark.sparkContext.applicationId, sf_dir, repr(files))
        if key not in cls._known:
            cls._known[key] = cls(*src.star_estate(spark, sf_dir))
        return cls._known[key]

    @classmethod
    def of_csv(cls, spark: SparkSession, files: dict[str, str]) -> Estate:
        found = roles.ingest(spark, files)
        settings = Settings.of(spark)
        nodes, edges, unresolved = src.csv_estate(found, settings.data_flow_edges)
        return cls(nodes, edges, settings, unresolved, found["quality"])

    @cached_property
    def flat(self) -> DataFrame:
        return written(self.edges.select("src", "dst").distinct(), "flat")

    @cached_property
    def pairs(self) -> DataFrame:
        """The whole closure, for questions on any system. Its size can be the square of the estate's; the other tables don't need it."""
        return written(rc.closure(self.flat), "pairs")

    @cached_property
    def source_pairs(self) -> DataFrame:
        """The closure from the sources of card data: the table behind scope, origins, and plans."""
        return written(rc.closure(self.flat, self.nodes.where("carries_pan or observed")), "source_pairs")

    @cached_property
    def facts(self) -> DataFrame:
        return written(fc.facts(self.nodes, self.edges, self.flat, self.source_pairs, self.settings), "facts")

    @cached_property
    def origins(self) -> DataFrame:
        return self.facts.where("is_origin").select("id")

    @cached_property
    def scope(self) -> DataFrame:
        return self.facts.where("in_scope").select("id")

    @cached_property
    def above(self) -> DataFrame:
        """(origin, id) for all systems in scope."""
        return written(fc.ancestry(self.source_pairs, self.origins), "above")

    @cached_property
    def components(self) -> DataFrame:
        """(id, scc) of every system: the least id of its cycle cluster, or its own."""
        return written(self.nodes.select("id").join(rc.cycle_labels(self.flat), "id", "left").select("id", F.coalesce("scc", "id").alias("scc")), "scc")

    @cached_property
    def scope_edges(self) -> DataFrame:
        ids = self.scope
        e = self.flat.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return written(e.select("src", "dst"), "scope_edges")

    @cached_property
    def atoms(self) -> DataFrame:
        """(origins, size, weight): systems that can leave scope, by the set of origins that must all go first."""
        free = self.facts.where("in_scope and not is_origin and not always_cde").select("id")
        sets = self.above.join(free, "id", "left_semi").groupBy("id").agg(F.count("*").alias("size"), rc.joined(F.collect_set("origin")).alias("origins"))
        return written(sets.groupBy("origins", "size").agg(F.count("*").alias("weight")), "atoms")
