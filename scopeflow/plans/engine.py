"""The engine's face: load, analyse, ask; and the run with an audit trail and a human gate."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeflow.functions import text as tx
from scopeflow.operators import impact as im
from scopeflow.operators import narrate as na
from scopeflow.operators import planner as pl
from scopeflow.operators import reach as rc
from scopeflow.operators import rollup as ru
from scopeflow.operators import structure as st
from scopeflow.operators import views as vw
from scopeflow.plans.estate import Estate
from scopeflow.sinks.pdf import write_pdf
from scopeflow.sinks.xlsx import write_xlsx


TOTALS = ("systems", "in_scope", "confirmed", "inferred_only", "hidden", "carriers", "origins", "pan_systems")
STAGES = [
    ("ingest", "reads the tables by role and masks card numbers"),
    ("validate", "fails on any card number that got through"),
    ("graph", "builds the flows and their closure from the sources"),
    ("dag", "condenses cycles"),
    ("score", "works out what is known of each system"),
    ("analyze", "picks the levers"),
    ("gate", "waits for a person"),
    ("report", "writes up the numbers"),
]


class Engine:
    """Every question as a DataFrame over one estate."""

    def __init__(self, estate: Estate):
        self.estate = estate
        self._plan: pl.Instance | None = None

    @classmethod
    def from_csv(cls, spark: SparkSession, files: dict[str, str]) -> Engine:
        return cls(Estate.of_csv(spark, files))

    @property
    def instance(self) -> pl.Instance:
        self._plan = self._plan or pl.instance(self.estate)
        return self._plan

    def graph(self) -> dict[str, DataFrame]:
        return {"nodes": vw.viz_nodes(self.estate), "edges": vw.viz_edges(self.estate), "dag_nodes": st.dag_nodes(self.estate), "dag_edges": st.dag_edges(self.estate)}

    def heavy_hitters(self, k: int = 10) -> DataFrame:
        return im.heavy_hitters(self.estate, k)

    def impact(self, systems: list[str]) -> DataFrame:
        return im.impact(self.estate, im.labelled(self.estate, {"asked": systems}))

    what_if = impact

    def plan(self) -> DataFrame:
        return pl.tokenization_plan(self.estate, self.instance)

    def curve(self, steps: int = 25) -> DataFrame:
        return pl.cumulative_curve(self.estate, self.instance, steps)

    def frontier(self, k_max: int = 10) -> DataFrame:
        return pl.frontier(self.estate, self.instance, k_max)

    def min_cut(self, k: int = 6) -> DataFrame:
        targets = self.estate.facts.where("in_scope and not is_origin").orderBy(F.desc("reach"), "id").limit(k).select("id")
        return rc.min_cuts(self.estate.flat, self.estate.origins, targets)

    def onboard(self, app: str, providers: list[str], consumers: list[str] | None = None, **flags: bool) -> DataFrame:
        return ru.onboarding(self.estate, app, providers, consumers, **flags)

    def structure(self) -> DataFrame:
        return st.metrics(self.estate)

    def headline(self) -> DataFrame:
        return ru.totals(self.estate)

    def what_ifs(self, sets: dict[str, list[str]]) -> DataFrame:
        """The impact of several named sets at once."""
        return im.impact(self.estate, im.labelled(self.estate, sets))

    def enriched_plan(self) -> dict[str, DataFrame]:
        """The plan with all that a decision on it asks for."""
        e = self.estate
        steps = [r[1] for r in pl.plan_rows(e, self.instance)]
        return {
            "plan": self.plan(),
            "source_exposure": im.exposure(e).orderBy(F.desc("solo_descope"), F.desc("feeds_removed"), "system").limit(15),
            "saturation_curve": im.saturation(e, 12),
            "block_comparison": im.block_comparison(e, steps),
            "optimization": pl.optimization(e, self.instance),
            "floor": ru.economics(e, im.saturation(e)).select("in_scope_now", "achievable_floor", "removable"),
        }

    def scenarios(self) -> DataFrame:
        return ru.onboarding_scenarios(self.estate)

    def scope_rationale(self) -> str:
        return na.scope_rationale(self.estate)

    def agents(self) -> DataFrame:
        """The stages of a run in order, and what each does."""
        return self.estate.spark.createDataFrame(STAGES, "stage string, does string")

    def explanation(self) -> str:
        return na.explanation(self.estate).first().explanation

    def memo(self) -> str:
        return na.memo(self.estate, self.instance)

    def ask(self, question: str) -> str:
        return na.answer(self.estate, question)

    def suggested(self) -> list[str]:
        return na.suggested_questions(self.estate)

    def sheets(self) -> dict[str, DataFrame]:
        """The report's tables by name."""
        e = self.estate
        exposure = im.exposure(e)
        n = F.broadcast(e.scope.agg(F.count("*").alias("scope")))
        return {
            "summary": ru.totals(e),
            "systems": vw.viz_nodes(e).orderBy(F.desc("risk"), "id"),
            "heavy_hitters": self.heavy_hitters(),
            "hidden_evidence": ru.hidden(e),
            "hidden": e.facts.where("hidden").select("id"),
            "ownership": ru.ownership(e),
            "tokenization_plan": self.curve(),
            "source_exposure": exposure.orderBy(F.desc("solo_descope"), F.desc("feeds_removed"), "system").limit(50).crossJoin(n).withColumn("pct_of_scope", F.bround(100 * F.col("downstream_reach") / F.col("scope"), 1)),
            "optimization": pl.optimization(e, self.instance),
            "optimization_milestones": pl.milestones(self.frontier()),
            "segmentation_min_cut": self.min_cut(),
            "economics": ru.economics(e, im.saturation(e)),
            "scope_categories": ru.category_sheet(e),
            "segmentation": st.choke_points(e),
        }

    def write_sheets(self, path: str, fmt: str = "csv") -> None:
        for name, df in self.sheets().items():
            writer = df.write.mode("overwrite")
            (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")

    def write_workbook(self, path: str) -> None:
        """All sheets, with notes and the dashboard's numbers, as one workbook."""
        spark = self.estate.spark
        notes = spark.createDataFrame([(line,) for line in (self.explanation(), self.scope_rationale(), self.memo())], "notes string")
        head = ru.totals(self.estate).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, TOTALS)), F.array(*[F.col(c) for c in TOTALS]))).alias("metric", "value"))
        board = head.unionAll(self.heavy_hitters().select("system", "downstream_reach")).unionAll(im.saturation(self.estate).select(F.format_string("freed by the first %d origins", "k"), "fully_descoped"))
        write_xlsx(path, {"dashboard": board, **self.sheets(), "notes": notes})

    def write_report(self, path: str) -> None:
        """The executive report as PDF."""
        write_pdf(path, self.markdown())

    def snapshot(self) -> DataFrame:
        """One JSON row per system: the payload of an explorer."""
        return vw.viz_nodes(self.estate).select(F.to_json(F.struct("*")).alias("json"))

    def markdown(self) -> str:
        """The report as text: what the numbers say, then the tables that a decision needs."""
        e = self.estate
        tables = {
            "Totals": ru.totals(e),
            "Structure": self.structure(),
            "Widest distributors": self.heavy_hitters(),
            "Plan": self.plan().orderBy("step"),
            "Saturation": im.saturation(e).orderBy("k"),
            "Cost": ru.economics(e, im.saturation(e)),
            "Next actions": pl.next_actions(e, self.instance).orderBy("place"),
            "Owners": ru.ownership(e).orderBy(F.desc("in_scope"), "line_of_business").limit(12),
        }
        out = ["# Scope of sensitive data", "", self.explanation(), "", self.scope_rationale(), "", self.memo()]
        for name, df in tables.items():
            rows = [df.columns, ["-"] * len(df.columns), *([str(v) for v in r] for r in df.collect())]
            out += ["", f"## {name}", "", *("| " + " | ".join(r) + " |" for r in rows)]
        return "\n".join(out)


@dataclass
class Run:
    """A run as a state machine: ingest, validate, graph, score, analyse, then a gate that a person passes, revises or stops."""

    spark: SparkSession
    load: Callable[[SparkSession], Estate]
    levers: int = 3
    state: str = "start"
    audit: list[dict] = field(default_factory=list)
    engine: Engine | None = None
    picks: list[str] = field(default_factory=list)

    def _stage(self, name: str, work: Callable[[], object]) -> object:
        began = time.perf_counter()
        got = work()
        self.audit.append({"stage": name, "ms": round(1000 * (time.perf_counter() - began), 1)})
        self.state = name
        return got

    def start(self) -> str:
        """Runs up to the gate; a leak ends the run."""
        estate = self._stage("ingest", lambda: self.load(self.spark))
        try:
            self._stage("validate", lambda: tx.raise_if_leaked(tx.scan_for_leaks(estate.nodes, "id")))
        except tx.PanLeakError as e:
            self.audit.append({"stage": "aborted", "ms": 0.0, "why": str(e)})
            self.state = "aborted"
            return self.state
        self.engine = Engine(estate)
        self._stage("graph", lambda: estate.source_pairs)
        self._stage("dag", lambda: estate.components)
        self._stage("score", lambda: estate.facts)
        return self._analyze()

    def _analyze(self) -> str:
        self.picks = self._stage("analyze", lambda: pl.levers(self.engine.estate, self.engine.instance, self.levers))
        self.state = "gate"
        return self.state

    def resume(self, decision: str, feedback: str = "") -> str:
        """``abort`` ends; ``revise`` takes a number of levers from the feedback and comes back to the gate; all else reports."""
        if self.state != "gate":
            raise RuntimeError(f"the run is at {self.state}, not at the gate")
        if decision == "abort":
            self.state = "aborted"
        elif decision == "revise":
            number = re.search(r"\d+", feedback)
            self.levers = int(number[0]) if number else self.levers
            return self._analyze()
        else:
            self._stage("report", lambda: self.engine.explanation())
            self.state = "done"
        return self.state

    def audit_frame(self) -> DataFrame:
        rows = self.spark.createDataFrame([(a["stage"], float(a["ms"])) for a in self.audit], "stage string, ms double")
        total = rows.agg(F.sum("ms").alias("total"))
        return rows.groupBy("stage").agg(F.sum("ms").alias("ms")).crossJoin(F.broadcast(total)).select("stage", "ms", F.bround(100 * F.col("ms") / F.greatest("total", F.lit(1e-9)), 1).alias("share"))
