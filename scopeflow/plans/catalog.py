"""Every query of the flow engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeflow.functions import text as tx
from scopeflow.operators import facts as fc
from scopeflow.operators import impact as im
from scopeflow.operators import narrate as na
from scopeflow.operators import planner as pl
from scopeflow.operators import reach as rc
from scopeflow.operators import rollup as ru
from scopeflow.operators import structure as st
from scopeflow.operators import views as vw
from scopeflow.plans.engine import Engine, Run
from scopeflow.plans.estate import Estate
from scopeflow.plans.oracles import FULL, GRAPH
from scopeflow.sources import estate as src
from scopeflow.sources import roles
from scopeflow.storage import shared_dir
from scopeflow.streaming import signals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_tables(name: str, make: Query, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def on_estate(name: str, make: Callable[[Estate], DataFrame], sql: str | None = None, base: str = FULL) -> None:
    """``sql`` goes on from the estate's common table expressions: a select, or more of those after a comma."""
    on_tables(name, lambda spark, sf_dir: make(Estate.of_star(spark, sf_dir)), sql and base + ("" if sql.startswith(",") else "\n") + sql)


def _instance(e: Estate) -> pl.Instance:
    return pl.instance(e)


# ---- text and sources ----------------------------------------------------------------------------------------------------------

_CSV = "doc_id, lower(trim(lang)) as lang, trim(source) as source"


def _role_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kinds = F.element_at(F.array(*map(F.lit, ROLE_NAMES)), (F.col("doc_id") % len(ROLE_NAMES) + 1).cast("int"))
    return docs.select("doc_id", kinds.alias("file"))


#: File names that try every rule.
ROLE_NAMES = ("DS1_flows.csv", "records10.csv", "pci_to_pci.csv", "downstream_survey.csv", "x_upstream.csv", "BAM_REPORT.csv", "end state.csv", "pan_in_logs.csv", "DS6.csv", "other.csv")
_FILES = "(select doc_id, case doc_id % 10 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(ROLE_NAMES)) + " end as file from documents) x"


_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: case when (len(d) - i) % 2 = 1 then (2 * cast(d[i:i] as int)) // 10 + (2 * cast(d[i:i] as int)) % 10 else cast(d[i:i] as int) end)) % 10 = 0"
#: Runs of 13 to 19 digits with at most one separator between two: chains of digit groups, walked from group to group; each run is the longest
#: whole number of groups that fits, and one whose check digit is right is masked, with a separator that ends its chain.
_DIGITS = "'[0-9](?:[ -]?[0-9])*[ -]?'"
CARDS = f"""with recursive doc as (select doc_id, text, regexp_extract_all(text, {_DIGITS}) as chains, string_split_regex(text, {_DIGITS}) as pieces from documents),
chain as (select doc_id, nth, chains[nth] as c, string_split(regexp_replace(rtrim(chains[nth], ' -'), '[ -]', ' ', 'g'), ' ') as g, regexp_extract_all(chains[nth], '[ -]') as s from (select doc_id, chains, unnest(range(1, len(chains) + 1)) as nth from doc)),
walk as (select doc_id, nth, g, s, cast(1 as bigint) as j, '' as done, []::varchar[] as hits from chain where len(regexp_replace(c, '[^0-9]', '', 'g')) >= 13
  union all (select doc_id, nth, g, s, greatest(m, j) + 1, done || case when good then d[1:6] || repeat('x', len(d) - 10) || right(d, 4) || case when m < len(g) then s[m] else '' end
      else array_to_string(list_transform(range(j, greatest(m, j) + 1), lambda x: g[x] || coalesce(s[x], '')), '') end, case when good then list_append(hits, d[1:6] || repeat('x', len(d) - 10) || right(d, 4)) else hits end
    from (select *, m > 0 and {_LUHN} as good from (select *, array_to_string(g[j:m], '') as d from (select *, coalesce(list_max(list_filter(range(j, len(g) + 1), lambda x: len(array_to_string(g[j:x], '')) between 13 and 19)), 0) as m from walk where j <= len(g)))))),
chain_out as (select doc_id, nth, done, hits from walk where j > len(g)),
parts as (select doc_id, unnest(range(1, len(pieces) + 1)) as nth, pieces from doc),
cleaned as (select doc_id, any_value(text) as text, case when any_value(text) is not null then string_agg(parts.pieces[parts.nth] || coalesce(chain_out.done, chain.c, ''), '' order by parts.nth) end as clean
  from doc left join parts using (doc_id) left join chain using (doc_id, nth) left join chain_out using (doc_id, nth) group by doc_id)"""


def _csv_of(spark: SparkSession, sf_dir: str) -> str:
    """The suppliers as a CSV file with a header to normalise, quotes and line breaks in cells."""
    path = shared_dir(spark, "csv")
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(k.cast("string").alias(" S_Key "), F.concat(F.lit("  "), "s_name", F.lit(' "q"\nnext, line ')).alias("S_NAME"))
    rows.coalesce(1).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.norm_headers(roles.read_csv(spark, _csv_of(spark, sf_dir)))


on_tables("scan_csv", lambda s, d: scan_csv(s, d).select("s_key", "s_name"), "select cast(s_suppkey as varchar) as s_key, trim(s_name) || ' \"q\"' || chr(10) || 'next, line' as s_name from supplier")
on_tables("norm_headers", lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(scan_csv(s, d).columns)], "place int, header string"), "select * from (values (0, 's_key'), (1, 's_name')) v(place, header)")
on_tables("detect_role_header", lambda s, d: s.createDataFrame([("a", roles.role_by_header([" Parent App ID", "CHILD APP ID"])), ("b", roles.role_by_header(["appid", roles.LOG_KEYS[1]])), ("c", roles.role_by_header(["x"]))], "case string, role string"), "select * from (values ('a', 'DS1'), ('b', 'DS6'), ('c', 'UNKNOWN')) v(\"case\", role)")
on_tables("detect_role", lambda s, d: _role_names(s, d).withColumn("role", roles.role_by_name(F.col("file"))), f"""select doc_id, file, case when contains(lower(file), 'ds1') or contains(lower(file), 'pci_to_pci') or contains(lower(file), 'pci to pci') then 'DS1'
 when contains(lower(file), 'ds2') or contains(lower(file), 'downstream') then 'DS2' when contains(lower(file), 'ds3') or contains(lower(file), 'upstream') then 'DS3'
 when contains(lower(file), 'ds4') or contains(lower(file), 'bam_report') or contains(lower(file), 'cardholder') then 'DS4'
 when contains(lower(file), 'ds5') or contains(lower(file), 'survey') or contains(lower(file), 'cde_end_state') or contains(lower(file), 'end state') then 'DS5'
 when contains(lower(file), 'ds6') or contains(lower(file), 'splunk') or contains(lower(file), 'pan_in') then 'DS6' end as role from {_FILES}""")
on_tables("detect_role_ui", lambda s, d: _role_names(s, d).withColumn("role", roles.role_by_ui_name(F.col("file"))), f"select doc_id, file, case when regexp_matches(file, '(?i)ds[ _-]?[1-6]') then 'DS' || regexp_extract(file, '(?i)ds[ _-]?([1-6])', 1) end as role from {_FILES}")
on_tables("luhn_check", lambda s, d: _table(s, d, "orders").select("o_orderkey", F.format_string("4%015d", F.col("o_orderkey") * 7919).alias("d")).select("o_orderkey", "d", tx.luhn_ok(F.col("d")).alias("valid")), f"select o_orderkey, d, {_LUHN} as valid from (select o_orderkey, '4' || lpad(cast(o_orderkey * 7919 as varchar), 15, '0') as d from orders)")
on_tables("mask_pan", lambda s, d: _table(s, d, "orders").select("o_orderkey", tx.mask_pan(F.concat(F.lit("41-11 "), F.col("o_orderkey") * 104729)).alias("masked")), """select o_orderkey, case when len(d) < 10 then repeat('x', len(d)) else d[1:6] || repeat('x', len(d) - 10) || right(d, 4) end as masked
 from (select o_orderkey, '4111' || cast(o_orderkey * 104729 as varchar) as d from orders)""")
on_tables("sanitize_text", lambda s, d: _table(s, d, "documents").select("doc_id", tx.sanitize_text(F.col("text")).alias("text")), CARDS + " select doc_id, clean as text from cleaned")
on_tables("extract_id", lambda s, d: _table(s, d, "supplier").select("s_suppkey", tx.extract_id(F.concat(F.lit(" "), F.upper(F.substring("s_name", 1, 2)), F.col("s_suppkey"), F.lit(" - x"))).alias("id")), "select s_suppkey, nullif(regexp_extract(upper(s_name[1:2]) || s_suppkey || ' - x', '^([0-9A-Z]{2,6})\\b', 1), '') as id from supplier")
on_tables("is_yes", lambda s, d: _table(s, d, "orders").select("o_orderkey", tx.is_yes(F.element_at(F.array(F.lit(" Yes"), F.lit("N"), F.lit("TRUE"), F.lit(""), F.lit(None), F.lit("1 ")), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("yes")), "select o_orderkey, o_orderkey % 6 in (0, 2, 5) as yes from orders")
on_tables("mask_all_cells", lambda s, d: tx.mask_all_cells(_table(s, d, "documents").select("doc_id", "text", "lang")).select("doc_id", "masked_cells"), CARDS + " select doc_id, cast(coalesce(clean <> text, false) as int) as masked_cells from cleaned")
on_tables("leak_scan", lambda s, d: tx.scan_for_leaks(_table(s, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id"), CARDS + " select doc_id, 'text' as \"column\", unnest(hits) as masked, substring(clean, 1, 60) as context from chain_out join cleaned using (doc_id)")
on_tables("leak_docs", lambda s, d: tx.scan_for_leaks(_table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id").distinct(), f"""select distinct doc_id from (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '(^|[^0-9])((?:[0-9][ -]?){{13,19}})([^0-9]|$)', 2)), '[^0-9]', '', 'g') as d from documents) where len(d) between 13 and 19 and {_LUHN}""")
on_tables("leak_gate", lambda s, d: tx.scan_for_leaks(tx.mask_all_cells(_table(s, d, "documents").select("doc_id", "text")).drop("masked_cells"), "doc_id"), "select doc_id, '' as \"column\", '' as masked, '' as context from documents where false")
on_tables("token_estimate", lambda s, d: _table(s, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens")), "select doc_id, cast(length(coalesce(text, '')) // 4 as bigint) as tokens from documents")
on_tables("chat_ids", lambda s, d: na.chat_ids(_table(s, d, "orders").select("o_orderkey", F.concat(F.lit("why is s"), F.col("o_orderkey") % 50, F.lit(" in scope, and S7?")).alias("q")), Estate.of_star(s, d).nodes, "o_orderkey", "q"), "select * from (select distinct o_orderkey as question, unnest(['S' || (o_orderkey % 50), 'S7']) as system from orders) where system in (select 'S' || s_suppkey from supplier)")
on_tables("ext_leak_windows", lambda s, d: signals.leak_windows(_table(s, d, "events")), "select date_trunc('day', ts) as window_start, 'S' || (user_id % 100) as system, count(*) as signals from (select distinct event_id, ts, user_id from events) group by 1, 2")


def _made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = src.made_up_estate(spark, 500, 8)
    return edges.groupBy("src").agg(F.count("*").alias("edges"))


on_tables("synth_estate", _made_up)

# ---- graph ---------------------------------------------------------------------------------------------------------------------

on_estate("scan_union_edges", lambda e: e.edges.groupBy("source_dataset", "environment").agg(F.count("*").alias("edges")), "select source_dataset, environment, count(*) as edges from er group by 1, 2", GRAPH)
on_estate("ingest_quality", lambda e: e.edges.groupBy("provenance").agg(F.count("*").alias("rows"), F.countDistinct("src", "dst").alias("distinct_pairs")), "select provenance, count(*) as rows, count(distinct src || '>' || dst) as distinct_pairs from er group by 1", GRAPH)
on_estate("graph_nodes", lambda e: e.nodes.select("id", "in_bam", "pci_flag", "carries_pan", "detokenizes", "crn_only", "observed", "tier", "line_of_business"), "select id, in_bam, pci_flag, carries_pan, detokenizes, crn_only, observed, cast(tier as int) as tier, coalesce(line_of_business, '') as line_of_business from n", GRAPH)
on_estate("graph_edges", lambda e: e.edges, "select src, dst, provenance, source_dataset, environment, rel_type, signal from er", GRAPH)
on_estate("flatten_edges", lambda e: e.flat, "select * from e", GRAPH)
on_estate("graph_stats", lambda e: e.nodes.agg(F.count("*").alias("nodes"), F.count_if("in_bam").alias("bam_nodes"), F.count_if(F.col("carries_pan") | F.col("observed")).alias("pan_source_nodes")).crossJoin(F.broadcast(e.edges.agg(F.count_if(F.col("provenance") == "metadata").alias("metadata_edges"), F.count_if(F.col("provenance") == "inferred").alias("inferred_edges"), F.countDistinct("src", "dst").alias("deduped_edges"), F.countDistinct(F.when(F.col("src") == F.col("dst"), F.col("src"))).alias("self_loops")))),
          "select (select count(*) from n) as nodes, (select count(*) from n where in_bam) as bam_nodes, (select count(*) from s) as pan_source_nodes, (select count(*) from er where provenance = 'metadata') as metadata_edges, (select count(*) from er where provenance = 'inferred') as inferred_edges, (select count(*) from e) as deduped_edges, (select count(*) from e where src = dst) as self_loops", GRAPH)


def _signals(e: Estate) -> DataFrame:
    """Survey answers made of the systems: some name a system, some a category, some nothing that is known."""
    k = F.col("id").substr(2, 20).cast("long")
    token = F.when(k % 5 == 0, "User Entry").when(k % 5 == 1, F.concat(F.lit("S"), k + 7, F.lit(" - feed"))).otherwise(F.concat(F.lit("S"), k % 9 + 1))
    rows = e.nodes.select(F.col("id").alias(roles.SURVEY_KEY), token.alias(roles.SURVEY_UPSTREAM + " (x)"), F.lit("").alias(roles.SURVEY_DOWNSTREAM))
    known = e.nodes.select(F.col("id").alias(roles.INVENTORY_KEY), F.lit("YES").alias("pci"))
    quality = e.spark.createDataFrame([(1,)], "n int")
    return src.csv_estate({"DS4": known, "DS5": rows, "quality": quality})


_TOKENS = ", t as (select id, case when k % 5 = 0 then 'User Entry' when k % 5 = 1 then 'S' || (k + 7) || ' - feed' else 'S' || (k % 9 + 1) end as token, case when k % 5 = 1 then 'S' || (k + 7) else 'S' || (k % 9 + 1) end as named, k from n)"
on_estate("resolve_signals", lambda e: _signals(e)[1].select("src", "dst", "signal"), _TOKENS + " select named as src, id as dst, 'DS5_survey_upstream' as signal from t where k % 5 <> 0 and named in (select id from n)", GRAPH)
on_estate("unresolved_signals", lambda e: _signals(e)[2], _TOKENS + " select token, case when k % 5 = 0 then 'non-system origin category' else 'unresolved to known system' end as reason, 'DS5_survey_upstream' as signal from t where k % 5 = 0 or named not in (select id from n)", GRAPH)
on_estate("closure", lambda e: e.pairs, """, lv as (select src, dst, 1 as hops from e union select lv.src, e.dst, lv.hops + 1 from lv join e on lv.dst = e.src where lv.hops < (select count(*) from n))
select src, dst, cast(min(hops) as int) as hops from lv group by src, dst""", GRAPH)
on_estate("closure_by_joins", lambda e: rc.closure(e.flat, e.nodes.where("observed"), limit=0), """, lv as (select src, dst, 1 as hops from e where src in (select id from n where observed) union select lv.src, e.dst, lv.hops + 1 from lv join e on lv.dst = e.src where lv.hops < (select count(*) from n))
select src, dst, cast(min(hops) as int) as hops from lv group by src, dst""", GRAPH)
on_estate("reach_by_joins", lambda e: rc.reach_counts(e.flat, limit=0), "select * from reach", GRAPH)
on_estate("scc_by_joins", lambda e: rc.cycle_labels(e.flat, limit=0), "select id, scc from scc where id in (select src from c where src = dst)", GRAPH)
on_estate("downstream_reach", lambda e: e.facts.select("id", "reach"), "select id, coalesce(reach, 0) as reach from n left join reach using (id)", GRAPH)
on_estate("ancestors", lambda e: e.pairs.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ancestors")), "select dst as id, count(*) as ancestors from cc group by dst", GRAPH)
on_estate("scc", lambda e: e.components, "select id, scc from scc", GRAPH)
on_estate("dag_nodes", st.dag_nodes, "select scc, string_agg(id, ',' order by id) as members, count(*) as size, count(*) > 1 or bool_or(id in (select src from e where src = dst)) as is_cycle, bool_or(carries_pan) as carries_pan, cast(max(tier) as int) as tier from scc join n using (id) group by scc", GRAPH)
on_estate("dag_edges", st.dag_edges, "select a.scc as from_scc, b.scc as to_scc, count(*) as weight from e join scc a on a.id = e.src join scc b on b.id = e.dst where a.scc <> b.scc group by 1, 2", GRAPH)
on_estate("cycles", st.cycles, ", ie as (select a.scc, string_agg(src || '>' || dst, ',' order by src || '>' || dst) as inner_edges from e join scc a on a.id = e.src join scc b on b.id = e.dst where a.scc = b.scc group by 1) select scc, string_agg(id, ',' order by id) as members, count(*) as size, any_value(inner_edges) as inner_edges from scc join ie using (scc) group by scc", GRAPH)
on_estate("pci_scope", lambda e: e.scope, "select id from scope", GRAPH)
on_estate("true_origins", lambda e: e.origins, "select id from o", GRAPH)
on_estate("origin_reach_count", lambda e: e.facts.where("origin_count > 0").select("id", "origin_count"), "select id, origin_count from oc", GRAPH)
on_estate("scope_split", lambda e: e.facts.where("in_scope").select("id", F.when(F.col("confirmed"), "confirmed").otherwise("inferred").alias("basis")), "select id, case when id in (select id from conf) then 'confirmed' else 'inferred' end as basis from scope", GRAPH)
on_estate("always_cde", lambda e: e.facts.where("always_cde").select("id"), "select id from n where detokenizes", GRAPH)
on_estate("betweenness", lambda e: rc.betweenness(e.nodes, e.flat).select("id", F.bround("b", 6).alias("b")), "select id, round_even(coalesce(b, 0)::double, 6) as b from n left join bt using (id)")
on_estate("betweenness_by_joins", lambda e: rc.betweenness(e.nodes, e.flat, limit=0).select("id", F.bround("b", 6).alias("b")), "select id, round_even(coalesce(b, 0)::double, 6) as b from n left join bt using (id)")
_ISLANDS = """, isl as (select id, id as island from scope union select isl.id, case when se2.src = isl.island then se2.dst else se2.src end from isl join (select src, dst from e where src in (select id from scope) and dst in (select id from scope)) se2 on se2.src = isl.island or se2.dst = isl.island)"""
on_estate("pan_islands", st.islands, _ISLANDS + """
select island, count(*) as systems from (select id, min(island) as island from isl group by id) group by island""", GRAPH)
_CUTS = """, ue as (select src a, dst b from e where src <> dst and src in (select id from scope) and dst in (select id from scope) union select dst, src from e where src <> dst and src in (select id from scope) and dst in (select id from scope)),
ap as (select v.id as x, u.a as u, u.a as w from (select distinct a as id from ue) v join (select distinct a from ue) u on u.a <> v.id union select ap.x, ap.u, ue.b from ap join ue on ue.a = ap.w where ue.b <> ap.x),
ap_points as (select distinct p.a as id from ue p join ue q on p.a = q.a and p.b < q.b where not exists (select 1 from ap where ap.x = p.a and ap.u = p.b and ap.w = q.b))"""
on_estate("articulation_points", lambda e: rc.articulation_points(e.scope_edges), _CUTS + " select id from ap_points", GRAPH)
_DEPTH = """, ce as (select distinct a.scc as src, b.scc as dst from e join scc a on a.id = e.src join scc b on b.id = e.dst where a.scc <> b.scc and e.src in (select id from scope) and e.dst in (select id from scope)),
lp as (select src, dst, 1 as d from ce union select lp.src, ce.dst, lp.d + 1 from lp join ce on lp.dst = ce.src)"""
on_estate("propagation_depth", lambda e: e.spark.createDataFrame([(st.depth(e),)], "depth int"), _DEPTH + " select cast(coalesce(max(d), 0) as int) as depth from lp", GRAPH)
on_estate("min_cut", lambda e: Engine(e).min_cut())
on_estate("min_cut_value", lambda e: rc.min_cuts(e.flat, e.origins, e.facts.where("in_scope and not is_origin and in_degree = 1").select("id")).select("target", "cut_size"), "select dst as target, cast(1 as bigint) as cut_size from idg join e on e.dst = idg.id where in_degree = 1 and dst in (select id from scope) and dst not in (select id from o) and src <> dst", GRAPH)
_TOP = "(select id from f where is_source order by reach desc, id limit 1)"
on_estate("trace_lineage", lambda e: vw.trace_lineage(e, "S98"), """, bk as (select src as node, 1 as d from e where dst = 'S98' union select e.src, bk.d + 1 from bk join e on e.dst = bk.node where bk.d < (select count(*) from n)),
dist as (select node, min(d) as d from bk where node <> 'S98' group by node union all select 'S98', 0),
onward as (select dist.node, min(e.dst) as dst from dist join e on e.src = dist.node join dist b on b.node = e.dst and b.d = dist.d - 1 group by dist.node),
wk as (select node as source, node, node as path from (select node from dist join s on s.id = dist.node where d > 0 order by node limit 5) union all select wk.source, onward.dst, wk.path || '>' || onward.dst from wk join onward on onward.node = wk.node)
select source, path from wk where node = 'S98'""", GRAPH)
on_estate("lineage_walk", lambda e: vw.lineage_walk(e, "S98"), """, up as (select dst as top, src from (select *, row_number() over (partition by dst order by src) as k from e where src <> dst) where k <= 3),
w as (select 'S98' as head, ['S98'] as path, 0 as steps union all select up.src, list_append(path, up.src), steps + 1 from w join up on up.top = w.head where steps < 7 and not list_contains(path, up.src) and w.head not in (select id from o))
select array_to_string(path, '<') as path, cast(steps as bigint) as steps from w where head in (select id from o) or steps = 7 order by steps, path limit 5""", GRAPH)
on_estate("ego_graph", lambda e: rc.ego(e.flat, "S98", 2), """, g as (select 'S98' as id, 0 as hop union select case when e.src = g.id then e.dst else e.src end, hop + 1 from g join e on e.src = g.id or e.dst = g.id where hop < 2)
select id, cast(min(hop) as int) as hop from g group by id""", GRAPH)
on_estate("hop_rings", lambda e: vw.hop_rings(e, vw.widest(e)), f""", ring as (select id as dst, 0 as hops from {_TOP} union select e.dst, hops + 1 from ring join e on e.src = ring.dst where hops < (select count(*) from n))
select cast(hops as int) as hops, count(*) as systems from (select dst, min(hops) as hops from ring group by dst) where hops > 0 group by hops""")
on_estate("setop_union_scope", lambda e: fc.reached(e.source_pairs, e.nodes.where("carries_pan or observed")), "select id from scope", GRAPH)
on_estate("setop_intersect_confirmed", lambda e: fc.confirmed(e.nodes, e.edges).intersect(e.scope), "select id from conf intersect select id from scope", GRAPH)
on_estate("setop_except_inferred", lambda e: e.scope.exceptAll(fc.confirmed(e.nodes, e.edges).intersect(e.scope)), "select id from scope except select id from conf", GRAPH)

# ---- scores and structure ------------------------------------------------------------------------------------------------------

on_estate("risk_scores", lambda e: e.facts.select("id", "risk", "tier", F.col("reach").alias("downstream_reach"), F.bround("b_norm", 4).alias("betweenness"), (F.col("source_flag") > 0).alias("is_true_source"), F.col("is_source").alias("carries_pan"), F.bround("reach_norm", 4).alias("reach_norm")), "select id, risk, cast(tier as int) as tier, reach as downstream_reach, round_even(b_norm::double, 4) as betweenness, source_flag > 0 as is_true_source, is_source as carries_pan, round_even(reach_norm::double, 4) as reach_norm from f")
_CONC = """, r as (select reach, row_number() over (order by reach, id) as i, row_number() over (order by reach desc, id) as t from f where in_scope),
cn as (select count(*) as n, round_even((2 * sum(i * reach) / (count(*) * sum(reach)) - (count(*) + 1) / count(*))::double, 3) as gini, round_even((sum(reach * reach) / (sum(reach)::double * sum(reach)))::double, 4) as hhi, round_even((100 * sum(reach) filter (where t <= 5) / sum(reach))::double, 1) as top5_share from r)"""
on_estate("reach_gini", lambda e: st.concentration(e).select("gini"), _CONC + " select gini from cn")
on_estate("reach_hhi", lambda e: st.concentration(e).select("hhi"), _CONC + " select hhi from cn")
on_estate("top5_share", lambda e: st.concentration(e).select("top5_share"), _CONC + " select top5_share from cn")
_W = """, wt(scenario, w1, w2, w3, w4) as (values ('Base (0.40/0.30/0.20/0.10)', 0.40::double, 0.30::double, 0.20::double, 0.10::double), ('Equal', 0.25, 0.25, 0.25, 0.25), ('Sensitivity-heavy', 0.55, 0.20, 0.15, 0.10),
  ('Reach-heavy', 0.20, 0.55, 0.15, 0.10), ('Betweenness-heavy', 0.20, 0.20, 0.50, 0.10), ('Source-heavy', 0.25, 0.25, 0.20, 0.30)),
rk as (select scenario, id, row_number() over (partition by scenario order by round_even((w1 * round_even((tier / 4)::double, 4) + w2 * round_even(reach_norm::double, 4) + w3 * round_even(b_norm::double, 4) + w4 * source_flag)::double, 10) desc, id) as rank from f, wt where is_source),
bs as (select id, rank as base from rk where scenario like 'Base%')"""
on_estate("weight_sensitivity", st.weight_sensitivity, _W + " select scenario, case when count(*) < 2 then 1.0::double else round_even((1 - 6 * sum((rank - base) * (rank - base)) / (count(*) * (count(*) * count(*) - 1)))::double, 3) end as rho, cast(count(*) filter (where rank <= 5 and base <= 5) as bigint) as top5_overlap, string_agg(id, ',' order by rank) filter (where rank <= 5) as top5, count(*) as universe from rk join bs using (id) group by scenario")
on_estate("structure_metrics", st.metrics, _CONC + _W + _ISLANDS + _DEPTH + _CUTS + """, ck as (select f.id, reach from ap_points join f using (id)),
ws as (select scenario, case when count(*) < 2 then 1.0::double else round_even((1 - 6 * sum((rank - base) * (rank - base)) / (count(*) * (count(*) * count(*) - 1)))::double, 3) end as rho from rk join bs using (id) where scenario not like 'Base%' group by scenario)
select cn.*, (select cast(coalesce(max(d), 0) as int) from lp) as propagation_depth, (select count(distinct island) from (select id, min(island) as island from isl group by id)) as pan_islands,
  (select coalesce(array_to_string(list(id order by reach desc, id)[1:12], ','), '') from ck) as choke_points, (select count(*) from ck) as choke_point_count, (select count(*) from se) as edges, (select min(rho) from ws) as least_rho from cn""")
on_estate("weight_tracked", st.weight_tracked, _W + " select id as system, any_value(base) as base_rank, min(rank) as min_rank, max(rank) as max_rank from rk join bs using (id) where base <= 8 group by id")

# ---- impact and plans ----------------------------------------------------------------------------------------------------------

_HH = "select id as system, reach as downstream_reach, case when is_origin then solo else 0 end as solo_descope, out_degree, risk, round_even(b_norm::double, 4) as betweenness, is_origin as is_true_source from f where is_source order by reach desc, case when is_origin then solo else 0 end desc, risk desc, id limit 10"
on_estate("heavy_hitters", im.heavy_hitters, _HH)
on_estate("top_intervention", im.top_intervention, f" select system, solo_descope, downstream_reach, is_true_source from ({_HH}) order by is_true_source desc, solo_descope desc, downstream_reach desc, system limit 1")


def _asked(e: Estate) -> DataFrame:
    """Three what-ifs: the widest origin, the three widest, and all of them."""
    r = im.origin_ranks(e)
    pick = lambda label, k: r.where(F.col("rank") <= k).select(F.lit(label).alias("label"), F.col("origin").alias("id"))
    return pick("first", 1).unionAll(pick("three", 3)).unionAll(pick("all", 1 << 40))


_RANKED = ", orank as (select id, row_number() over (order by reach desc, id) as rank from f where is_origin)"
_STAYS = """, gone as (select label, above.id, count(*) as gone from above join ch on ch.id = above.origin group by 1, 2),
ft as (select l.label, f.*, ch.id is not null as tokenized, coalesce(gone, 0) as gone, ch.id is not null or coalesce(gone, 0) < origin_count as stays
  from (select distinct label from ch) l cross join f left join ch on ch.label = l.label and ch.id = f.id left join gone on gone.label = l.label and gone.id = f.id where in_scope),
lo as (select *, tokenized and tier > 3 and not detokenizes as lower, case when tokenized and tier > 3 and not detokenizes then round_even((risk - 100 * 0.4 * (tier - 3) / 4)::double, 2) else risk end as risk2 from ft)"""
_FATE = _RANKED + ", ch as (select label, id from orank join (values ('first', 1), ('three', 3), ('all', 1000000)) v(label, m) on rank <= m)" + _STAYS
_SUMS = """ select label, count(*) as scope_before, count(*) filter (where stays) as scope_after, count(*) filter (where not stays) as nodes_descoped,
 count(*) filter (where gone > 0 and not tokenized) as feeds_removed, count(*) filter (where gone > 0 and not tokenized and stays) as parent_reduction,
 count(*) filter (where lower) as sources_downgraded, count(*) filter (where tokenized and not lower) as sources_retained, count(*) filter (where stays and detokenizes and not tokenized) as retained_detok,
 cast(sum(out_degree) as bigint) as pan_edges_before, cast(coalesce(sum(out_degree) filter (where stays), 0) as bigint) as pan_edges_after, round_even(sum(risk)::double, 1) as risk_before, round_even(sum(risk2) filter (where stays)::double, 1) as risk_after,
 round_even((100 * (sum(risk) - sum(risk2) filter (where stays)) / sum(risk))::double, 1) as risk_reduction_pct, round_even((100 * count(*) filter (where not stays) / count(*))::double, 1) as surface_reduction_pct"""
on_estate("clean_stream_impact", lambda e: im.impact(e, _asked(e)).drop("descoped"), _FATE + _SUMS + " from lo group by label")
on_estate("what_if", lambda e: im.impact(e, _asked(e)).select("label", "nodes_descoped", "descoped"), _FATE + " select label, count(*) filter (where not stays) as nodes_descoped, coalesce(string_agg(id, ',' order by id) filter (where not stays), '') as descoped from ft group by label")
on_estate("scope_after", lambda e: im.fates(e, _asked(e)).where("stays").select("label", "id"), _FATE + " select label, id from ft where stays")
on_estate("source_exposure", im.exposure, ", sn as (select origin as id, array_to_string(list_sort(list(id))[1:50], ',') as names from above where origin <> id and id in (select id from oc where origin_count = 1) group by 1) select id as system, reach as downstream_reach, solo as solo_descope, reach as feeds_removed, reach - solo as parent_reduction, risk, coalesce(names, '') as solo_systems from f left join sn using (id) where is_origin")


def _greedy(steps: int, rule: str = "true", then: str = "") -> str:
    """``gr``: the greedy picks one by one (step 0 has none), by most systems freed, then by rank of reach. ``rule`` says from which state and which candidates
    to go on, ``then`` which picks count."""
    return f"""{_RANKED}, freeable as (select id, list_sort(list(origin)) as origins from above where id in (select id from scope) and id not in (select id from o) group by id),
atom as (select origins, count(*) as w from freeable where len(origins) <= 25 group by origins), tot as (select count(*) as total from freeable),
gr as (select 0 as step, []::varchar[] as chosen, cast(0 as bigint) as freed, cast(0 as bigint) as gain union all
  (select step + 1, list_append(chosen, id), cast(got as bigint), cast(got - freed as bigint) from (
    select gr.step, gr.chosen, gr.freed, c.id, coalesce(sum(a.w), 0) as got, row_number() over (partition by gr.step order by coalesce(sum(a.w), 0) desc, c.rank) as place
    from gr join orank c on not list_contains(gr.chosen, c.id) cross join tot left join atom a on list_has_all(list_append(gr.chosen, c.id), a.origins)
    where gr.step < {steps} and {rule} group by gr.step, gr.chosen, gr.freed, c.id, c.rank) where place = 1 {then}))"""


_PLAN = _greedy(8, "c.rank <= 25 and (total = 0 or gr.freed / total < 0.8)", "and got > freed")
_LEVERS = _greedy(3, "c.rank <= 25 and (total = 0 or gr.freed < total)", "and got > freed") + """, pk as (select step as place, chosen[step] as id from gr where step > 0),
lev as (select * from (select place, id from pk union all select row_number() over (order by reach desc, solo desc, id) + (select count(*) from pk), id from f where is_origin and id not in (select id from pk)) where place <= 3)"""
_CURVE = _greedy(25) + """, fd as (select g.step, count(distinct cc.dst) as m from gr g join cc on list_contains(g.chosen, cc.src) join scope on scope.id = cc.dst group by g.step)
select cast(gr.step as bigint) as k, chosen[gr.step] as last_source, gain as marginal_descoped, freed as cumulative_descoped, coalesce(m, 0) as cumulative_feeds_removed from gr left join fd using (step) where gr.step > 0"""
_SETS = """, ch as (select 'greedy' as label, id from {greedy} union all select 'reach_top', id from (select id from f where is_origin order by reach desc, id limit 3)
  union all select 'betweenness_top', id from (select id from f where is_source order by b_norm desc, id limit 3))"""
on_estate("recommended_levers", lambda e: e.spark.createDataFrame([(i + 1, s) for i, s in enumerate(pl.levers(e, _instance(e)))], "place int, system string"), _LEVERS + " select cast(place as int) as place, id as system from lev")
on_estate("block_comparison", lambda e: im.block_comparison(e, pl.levers(e, _instance(e))).drop("descoped"), _LEVERS + _SETS.format(greedy="lev") + _STAYS + _SUMS + " from lo group by label")
on_estate("cumulative_curve", lambda e: pl.cumulative_curve(e, _instance(e)), _CURVE)
_SATURATION = """{ranked}, la as (select above.id, max(rank) as last from above join orank on orank.id = above.origin where above.id not in (select id from o) group by 1),
ks as (select distinct cast(case when i = 12 then m else round_even((i * m / 12)::double, 0) end as bigint) as k, m from range(13) r(i), (select count(*) as m from o)),
sat as (select k, round_even((100 * k / greatest(m, 1))::double, 1) as pct_sources, (select count(*) from la where last <= k) as fully_descoped from ks)"""
on_estate("saturation_curve", im.saturation, _SATURATION.format(ranked=_RANKED) + " select * from sat")
on_estate("tokenization_plan", lambda e: pl.tokenization_plan(e, _instance(e)), _PLAN + """ select cast(step as bigint) as step, chosen[step] as tokenize, gain as marginal_descoped, freed as cumulative_descoped, (select count(*) from scope) - freed as scope_after,
  round_even((100 * freed / greatest(1, total))::double, 1) as pct_of_descopable, solo as solo_descope from gr cross join tot join f on f.id = chosen[step] where step > 0""")
on_estate("coverage_atoms", lambda e: e.atoms.select("origins", "weight"), ", sets as (select id, string_agg(origin, ',' order by origin) as origins from above where id in (select id from scope) and id not in (select id from o) group by id) select origins, count(*) as weight from sets group by origins", GRAPH)
on_estate("descope_frontier", lambda e: pl.frontier(e, _instance(e)))
on_estate("frontier_milestones", lambda e: pl.milestones(pl.frontier(e, _instance(e))))

# ---- rollups -------------------------------------------------------------------------------------------------------------------

on_estate("hidden_scope", ru.hidden, "select id as system, app_name as name, reach as downstream_reach, '' as stated_source, 'True PAN' as finding, concat_ws(',', case when pan_store then 'req3' end, case when pan_process or detokenizes then 'req4' end, 'req7_8,req10,req11') as requirements from f where hidden")
on_estate("hidden_counts", lambda e: e.facts.agg(F.count_if("hidden").alias("hidden"), F.count_if(F.col("hidden") & (F.col("reach") > 0)).alias("propagating"), F.count_if("carries_pan").alias("declared")), "select count(*) filter (where hidden) as hidden, count(*) filter (where hidden and reach > 0) as propagating, count(*) filter (where carries_pan) as declared from f")
on_estate("scope_categories", lambda e: e.facts.select("id", "category"), "select id, category from f")
on_estate("family_counts", lambda e: e.facts.select(F.explode(ru.families(F.col("category"))).alias("family")).groupBy("family").agg(F.count("*").alias("systems")), "select family, count(*) as systems from fam group by family")
on_estate("requirement_families", lambda e: e.facts.select("id", "category", F.array_join(ru.families(F.col("category")), ",").alias("families")), ", fl as (select id, string_agg(family, ',' order by list_position(['req3', 'req4', 'req3_sad', 'req7_8', 'req10', 'req11'], family)) as families from fam group by id) select id, category, coalesce(families, '') as families from f left join fl using (id)")
on_estate("scope_economics", lambda e: ru.economics(e, im.saturation(e)), """, x as (select count(*) filter (where category = 'cde') as now, count(*) filter (where category = 'connected') as con, count(*) filter (where in_scope and is_origin) as flo from f)
select now as in_scope_now, flo as achievable_floor, now - flo as removable, case when now > 1000 then 'ROC' else 'SAQ-D' end as posture_now, case when flo > 1000 then 'ROC' else 'SAQ-D' end as posture_floor, round_even((now * 0.5 + con * 0.15)::double, 1) as days_now, round_even((flo * 0.5 + con * 0.15)::double, 1) as days_floor,
 round_even((2500 * (now * 0.5 + con * 0.15))::double, 0) as cost_now, round_even((2500 * (flo * 0.5 + con * 0.15))::double, 0) as cost_floor, round_even((2500 * (now * 0.5 + con * 0.15))::double, 0) - round_even((2500 * (flo * 0.5 + con * 0.15))::double, 0) as cost_saving from x""")
on_estate("ownership_rollup", ru.ownership, "select lob as line_of_business, count(*) as systems, count(*) filter (where in_scope) as in_scope, count(*) filter (where hidden) as hidden_pci, count(*) filter (where carries_pan) as carries_pan, coalesce(array_to_string(list_sort(list(id) filter (where hidden))[1:8], ','), '') as hidden_sample, coalesce(array_to_string(list_sort(list(distinct business_group) filter (where business_group <> ''))[1:3], ','), '') as business_groups from f group by lob")
on_estate("ownership_coverage", lambda e: e.facts.agg(F.count_if(F.trim("line_of_business") != "").alias("with_lob"), F.count_if(F.trim("line_of_business") == "").alias("without_lob"), F.countDistinct(F.nullif(F.trim("line_of_business"), F.lit(""))).alias("lobs")), "select count(*) filter (where line_of_business <> '') as with_lob, count(*) filter (where line_of_business = '') as without_lob, count(distinct nullif(line_of_business, '')) as lobs from f")
_CHOKE = _CUTS + """, br as (select src, dst from se where src in (select id from ap_points) union select br.src, se.dst from br join se on se.src = br.dst),
cp as (select f.id as system, (select count(*) from br where br.src = f.id and br.dst <> f.id) as branch_size, reach as downstream_reach, risk, source_flag > 0 as is_true_source from ap_points join f using (id))"""
on_estate("segmentation_candidates", lambda e: st.choke_points(e).orderBy(F.desc("branch_size"), F.desc("downstream_reach"), "system").limit(10), _CHOKE + " select * from cp order by branch_size desc, downstream_reach desc, system limit 10")
on_estate("sankey_links", ru.sankey_links, """, orank as (select id, row_number() over (order by reach desc, id) as rank from f where is_origin),
gr as (select id, case when rank <= 8 then 'src:' || id else 'src:other' end as source from orank), fw as (select distinct src as id from se)
select source, case when above.id in (select id from fw) then 'relays' else 'consumers' end as target, count(distinct above.id) as value from above join gr on gr.id = above.origin where above.origin <> above.id group by 1, 2
union all select 'relays', 'consumers', count(*) from fw having count(*) > 0""")
on_estate("sankey_nodes", ru.sankey_nodes, ", orank as (select id, row_number() over (order by reach desc, id) as rank from f where is_origin) select 'src:' || id as id, id as label, 0 as band from orank where rank <= 8 union all select 'src:other', count(*) || ' other sources', 0 from orank where rank > 8 having count(*) > 0 union all select * from (values ('relays', 'relays (carry & forward PAN)', 1), ('consumers', 'terminal consumers', 2)) v")
on_estate("onboarding", lambda e: ru.onboarding(e, "new1", ["S98", "s44", "GHOST"], ["S7", "S3"]), """, asked(id, way) as (values ('S98', 'p'), ('S44', 'p'), ('GHOST', 'p'), ('S7', 'c'), ('S3', 'c')),
gv as (select asked.*, n.id is not null as known, asked.id in (select id from scope) as inside from asked left join n using (id)),
roots as (select distinct above.origin, n.detokenizes from gv join above on above.id = gv.id join n on n.id = above.origin where way = 'p' and known),
pulled as (select distinct x.id from (select id from gv where way = 'c' and known and not inside union select c.dst from gv join c on c.src = gv.id where way = 'c' and known and not inside) x where x.id not in (select id from scope)),
a as (select coalesce(string_agg(id, ',' order by id) filter (where way = 'p' and inside), '') as pan_providers, coalesce(string_agg(id, ',' order by id) filter (where way = 'p' and known), '') as providers_resolved,
  coalesce(string_agg(id, ',' order by id) filter (where way = 'c' and known), '') as consumers_resolved, coalesce(string_agg(id, ',' order by id) filter (where way = 'p' and not known), '') as unknown_providers,
  coalesce(string_agg(id, ',' order by id) filter (where way = 'c' and not known), '') as unknown_consumers, bool_or(inside and way = 'p') as receives_clear_pan, bool_or(inside and way = 'c') as feeds from gv),
b as (select coalesce(string_agg(origin, ',' order by origin), '') as origins_reaching, count(*) as n_origins, coalesce(string_agg(origin, ',' order by origin) filter (where detokenizes), '') as blocking from roots),
p as (select count(*) as m, coalesce(array_to_string(list_sort(list(id))[1:20], ','), '') as ids from pulled)
select 'NEW1' as app_id, case when receives_clear_pan then 'cde' when feeds then 'connected' else 'out' end as category, case when receives_clear_pan then 4 else 0 end as tier, receives_clear_pan, pan_providers, providers_resolved, consumers_resolved,
  unknown_providers, unknown_consumers, origins_reaching, n_origins, blocking, receives_clear_pan and n_origins > 0 and blocking = '' as can_fully_descope, false as permanent_cde, false as crn_only,
  case when receives_clear_pan then m else 0 end as scope_expansion, case when receives_clear_pan then ids else '' end as expansion_sample,
  case when receives_clear_pan then 'req7_8,req10,req11' when feeds then 'req7_8,req11' else '' end as requirements,
  case when receives_clear_pan then 'in scope because it is fed by ' || pan_providers when feeds then 'holds no card data but touches systems in scope' else 'out of scope as designed' end as verdict from a, b, p""", GRAPH)
on_estate("onboarding_scenarios", lambda e: ru.onboarding_scenarios(e).select("app_id", "category", "receives_clear_pan", "permanent_cde"), """select * from (select 'NEW-CONS' as app_id, case when count(*) > 0 then 'cde' end as category, true as receives_clear_pan, false as permanent_cde from s having count(*) > 0
  union all select 'NEW-ORIG', 'cde', false, false from n where id not in (select id from scope) having count(*) > 0
  union all select 'NEW-CRN', case when count(*) > 0 then 'connected' else 'out' end, false, false from s union all select 'NEW-DETOK', 'cde', count(*) > 0, true from s)""", GRAPH)
on_estate("onboarding_origins", lambda e: ru.onboarding(e, "new1", ["S98"]).select("category", "origins_reaching", "n_origins"), "select case when 'S98' in (select id from scope) then 'cde' else 'out' end as category, coalesce(string_agg(origin, ',' order by origin), '') as origins_reaching, count(*) as n_origins from (select origin from above where id = 'S98')", GRAPH)
on_estate("onboarding_multihop", lambda e: e.above.where("id = 'S98' and origin <> id").select("origin").join(e.flat.where("dst = 'S98'").select(F.col("src").alias("origin")), "origin", "left_anti"), "select origin from above where id = 'S98' and origin <> id and origin not in (select src from e where dst = 'S98')", GRAPH)
on_estate("lob_flow", ru.lob_flow, "select a.lob as from_lob, b.lob as to_lob, count(*) as edges, count(distinct e.src) as sources from e join f a on a.id = e.src and a.in_scope join f b on b.id = e.dst where a.lob <> b.lob group by 1, 2")
on_estate("lob_report", ru.lob_report, "select lob, count(*) as systems, count(*) filter (where in_scope) as in_scope, count(*) filter (where hidden) as hidden, count(*) filter (where carries_pan) as carriers, count(*) filter (where is_origin) as sources, max(risk) as max_risk from f group by lob")
on_estate("estate_totals", ru.totals, "select count(*) as systems, count(*) filter (where in_scope) as in_scope, count(*) filter (where confirmed) as confirmed, count(*) filter (where in_scope and not confirmed) as inferred_only, count(*) filter (where hidden) as hidden, count(*) filter (where carries_pan) as carriers, count(*) filter (where is_origin) as origins, count(*) filter (where carries_pan or is_origin) as pan_systems from f")
on_estate("graph_composition", lambda e: ru.totals(e).select("systems", "pan_systems", "hidden", "in_scope"), "select count(*) as systems, count(*) filter (where carries_pan or is_origin) as pan_systems, count(*) filter (where hidden) as hidden, count(*) filter (where in_scope) as in_scope from f")
on_estate("pan_reconciliation", ru.pan_reconciliation, "select count(*) filter (where carries_pan) as declared, count(*) filter (where observed) as observed, count(*) filter (where hidden) as hidden, count(*) filter (where carries_pan and observed) as overlap, count(*) filter (where is_source) as either from f")
on_estate("exposure_map", ru.exposure_map, "select lob, cast(sum(1 + reach) as bigint) as weight, count(*) as systems from f where in_scope group by lob")
on_estate("scope_rollup", ru.scope_rollup, "select coalesce(lob, '*') as lob, coalesce(category, '*') as category, count(*) as systems, round_even(avg(risk)::double, 4) as mean_risk, cast(grouping(lob, category) as bigint) as level from f group by rollup (lob, category)")

# ---- views ---------------------------------------------------------------------------------------------------------------------

on_estate("viz_nodes", vw.viz_nodes, "select id, app_name, cast(tier as int) as tier, carries_pan, in_scope, case when in_scope then case when confirmed then 'confirmed' else 'inferred' end else '' end as basis, category, hidden, is_origin, reach, risk from f")
on_estate("viz_edges", vw.viz_edges, "select src, dst, case when bool_or(provenance = 'metadata') then 'metadata' else 'inferred' end as provenance, string_agg(distinct source_dataset, ',' order by source_dataset) as datasets, count(*) as count, coalesce(min(nullif(signal, '')), '') as signal from er group by src, dst", GRAPH)
on_estate("filter_pan_view", vw.filter_pan, "select src as id from e join f on f.id = e.src where carries_pan or is_origin or hidden union select dst from e join f on f.id = e.src where carries_pan or is_origin or hidden")
on_estate("filter_heavy_view", vw.filter_heavy, f", hh as ({_HH}) select system as id from hh union select dst from e join hh on e.src = hh.system")
on_estate("search_systems", lambda e: vw.search(e, "s1", reaching=True), "select id, app_name, line_of_business, reach from f where (contains(lower(id), 's1') or contains(lower(app_name), 's1')) and reach > 0")
on_estate("blast_radius", lambda e: vw.blast_radius(e, vw.widest(e)), f""", ring as (select id as dst, 0 as hops from {_TOP} union select e.dst, hops + 1 from ring join e on e.src = ring.dst where hops < (select count(*) from n))
select dst as id, cast(min(hops) as int) as hops, case when any_value(origin_count) = 1 then 'solo' else 'feed' end as kind from ring join f on f.id = ring.dst where in_scope and dst not in (select id from lv where false) group by dst having min(hops) > 0""".replace(" and dst not in (select id from lv where false)", ""))
on_estate("fate_grid", lambda e: im.fates(e, _asked(e)).where("label = 'three'").select("id", F.when(F.col("tokenized"), "source").when(F.col("stays"), "kept").otherwise("freed").alias("fate")), _FATE + " select id, case when tokenized then 'source' when stays then 'kept' else 'freed' end as fate from ft where label = 'three'")
on_estate("migration_waves", lambda e: vw.migration_waves(e, [r.origin for r in im.origin_ranks(e).orderBy("rank").limit(3).collect()]), """, orank as (select id, row_number() over (order by reach desc, id) as rank from f where is_origin),
w as (select f.id, risk, rank, case when rank is not null then 1 when detokenizes then 3 else 2 end as wave from f left join (select * from orank where rank <= 3) x using (id) where in_scope)
select id, cast(wave as int) as wave, row_number() over (partition by wave order by rank nulls last, risk desc, id) as position from w""")
on_estate("priority_quadrant", vw.priority_quadrant, """, q as (select id, round_even(b_norm::double, 4) as b, risk, id in (select id from f where is_source order by reach desc, id limit 8) as far from f where carries_pan or hidden or reach > 0),
q2 as (select *, b > 0.18 * max(b) over () or risk > 0.8 * max(risk) over () or far as so, round_even((b + risk / max(risk) over ())::double, 8) as sc from q)
select id, b as betweenness, risk, so and row_number() over (order by case when so then sc end desc nulls last, id) <= 9 as labelled from q2""")
on_estate("saturation_flag", vw.saturation_flag, """, t as (select reach from f where is_origin order by reach desc, id limit 10), m as (select max(reach) as most from t), k as (select count(*) as near_top from t, m where reach >= most - greatest(2.0, 0.02 * most))
select near_top, most, (select count(*) from scope) as scope, near_top >= 3 and most >= 0.5 * (select count(*) from scope) as saturated from k, m""")
on_estate("scope_waterfall", lambda e: e.facts.agg(F.count_if("in_scope").alias("before"), F.count_if(F.col("in_scope") & ~F.col("is_origin")).alias("descopable"), F.count_if(F.col("in_scope") & F.col("is_origin")).alias("floor"), F.count_if(F.col("in_scope") & F.col("always_cde") & ~F.col("is_origin")).alias("always_cde")), "select count(*) filter (where in_scope) as before, count(*) filter (where in_scope and not is_origin) as descopable, count(*) filter (where in_scope and is_origin) as floor, count(*) filter (where in_scope and detokenizes and not is_origin) as always_cde from f")
on_estate("why_in_scope", vw.why_in_scope, """, wo as (select id, string_agg(origin, ',' order by origin) as origins from above where origin <> id group by id), wp as (select dst as id, string_agg(src, ',' order by src) as providers from se where src <> dst group by dst)
select f.id, is_source, coalesce(origins, '') as origins, coalesce(providers, '') as providers from f left join wo using (id) left join wp using (id) where in_scope""")
on_estate("next_actions", lambda e: pl.next_actions(e, _instance(e)), _PLAN + ", ch as (select 'plan' as label, chosen[step] as id from gr where step between 1 and 3)" + _STAYS + """, nm as (select string_agg(chosen[step], ',' order by step) as systems, count(*) as m from gr where step between 1 and 3)
select 1 as place, 'tokenize' as action, nm.systems, cast(sum(reach) as bigint) as amount from nm, f where f.id in (select id from ch) group by nm.systems
union all select 2, 'freed', any_value(nm.systems), count(*) filter (where not stays) from lo, nm having count(*) > 0 union all select 3, 'feeds_removed', any_value(nm.systems), count(*) filter (where gone > 0 and not tokenized) from lo, nm having count(*) > 0
union all select 4, 'hidden', '', count(*) from f where hidden having count(*) > 0 union all select 5, 'start_with', id, reach from (select id, reach from f where hidden order by reach desc, id limit 1)""")
on_estate("input_fidelity", lambda e: e.edges.agg(F.count_if(F.col("provenance") == "metadata").alias("metadata_rows"), F.count_if(F.col("provenance") == "inferred").alias("signal_rows")), "select count(*) filter (where provenance = 'metadata') as metadata_rows, count(*) filter (where provenance = 'inferred') as signal_rows from er", GRAPH)
on_estate("explanation", na.explanation, "select count(*) filter (where in_scope) || ' of ' || count(*) || ' systems are in scope: ' || count(*) filter (where confirmed) || ' on recorded flows, ' || count(*) filter (where in_scope and not confirmed) || ' by inference. ' || count(*) filter (where hidden) || ' systems hold card data unknown to the inventory. ' || count(*) filter (where is_origin) || ' origins feed all of it.' as explanation from f")
on_estate("memo_facts", lambda e: na.memo_facts(e, _instance(e)), _PLAN + _SATURATION.format(ranked="") + ", first3 as (select chosen[step] as id from gr where step between 1 and 3)" + _SETS.format(greedy="first3") + _STAYS + """, last as (select max(freed) as freed from gr),
known(section, item, value) as (select 'scope', 'in_scope', (select count(*) from scope) union all select 'scope', 'descopable', total from tot union all select 'scope', 'after', (select count(*) from scope) - freed from last
  union all select 'scope', 'declared_pan', count(*) from f where carries_pan union all select 'scope', 'actual_pan', count(*) from f where carries_pan or is_origin union all select 'scope', 'hidden', count(*) from f where hidden
  union all select 'sources', 'true_sources', count(*) from f where is_origin union all select 'greedy_plan', lpad(cast(step as varchar), 2, '0') || ' ' || chosen[step], freed from gr where step > 0
  union all select 'saturation_curve', cast(k as varchar), fully_descoped from sat union all select 'block_comparison', label, count(*) filter (where not stays) from lo group by label)
select section, item, cast(value as varchar) as value from known union all select 'top_sources', id, concat_ws('/', reach, solo, reach - solo) from (select * from f where is_origin order by solo desc, reach desc, id limit 15)""")
on_estate("curve_cliff", lambda e: na.curve_cliff(im.saturation(e)), _SATURATION.format(ranked=_RANKED) + """, step as (select lag(k) over w as pre_k, lag(fully_descoped) over w as pre_descoped, k as post_k, fully_descoped as post_descoped, fully_descoped - lag(fully_descoped) over w as delta, max(fully_descoped) over () as max_descoped from sat window w as (order by k))
select * from step where delta > 0 order by delta desc, post_k limit 1""")
on_estate("answer_intents", lambda e: e.spark.createDataFrame([(q, a, ",".join(on)) for q in ("hello", "how many systems are in scope", "widest distributors?", "hidden systems?", "what if we tokenize S44", "why is S98 in scope", "xyz") for a, on in (na.grounded_answer(e, q),)], "question string, answer string, grounded_on string"))
on_estate("scope_rationale", lambda e: e.spark.createDataFrame([(na.scope_rationale(e),)], "rationale string"), "select count(*) filter (where category = 'cde') || ' systems hold card data, or a flow of it reaches them; ' || count(*) filter (where category = 'connected') || ' hold none but feed one that does; ' || count(*) filter (where category = 'out') || ' are on no such path. Each placement follows from a path in the recorded and inferred flows.' as rationale from f")
_VIZ = "select id, app_name, cast(tier as int) as tier, carries_pan, in_scope, case when in_scope then case when confirmed then 'confirmed' else 'inferred' end else '' end as basis, category, hidden, is_origin, reach, risk from f"
on_estate("sink_json", lambda e: Engine(e).snapshot(), f"""select '{{"id":"' || id || '","app_name":"' || app_name || '","tier":' || tier || ',"carries_pan":' || carries_pan || ',"in_scope":' || in_scope || ',"basis":"' || basis || '","category":"' || category || '","hidden":' || hidden || ',"is_origin":' || is_origin || ',"reach":' || reach || ',"risk":' || risk || '}}' as json from ({_VIZ})""")
on_estate("ext_scope_drift", lambda e: signals.scope_drift(fc.confirmed(e.nodes, e.edges), e.scope), "select id, case when id in (select id from scope) then 'entered' else 'left' end as change from (select id from scope union select id from conf) where (id in (select id from scope)) <> (id in (select id from conf))", GRAPH)


def audit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(spark, lambda s: Estate.of_star(s, sf_dir))
    run.start()
    run.resume("approve")
    return run.audit_frame()


on_tables("audit_share", audit_share)
for _name in ("summary", "systems", "heavy_hitters", "hidden_evidence", "hidden", "ownership", "tokenization_plan", "source_exposure", "optimization", "optimization_milestones", "segmentation_min_cut", "economics", "scope_categories", "segmentation"):
    on_estate(f"sheet_{_name}", lambda e, name=_name: Engine(e).sheets()[name])
for _sheet, _same in (("summary", "estate_totals"), ("systems", "viz_nodes"), ("heavy_hitters", "heavy_hitters"), ("hidden_evidence", "hidden_scope"), ("ownership", "ownership_rollup"), ("economics", "scope_economics"), ("tokenization_plan", "cumulative_curve")):
    ORACLES[f"sheet_{_sheet}"] = ORACLES[_same]
ORACLES["sheet_hidden"] = FULL + " select id from f where hidden"
ORACLES["sheet_segmentation"] = FULL + _CHOKE + " select * from cp"
ORACLES["sheet_source_exposure"] = ORACLES["source_exposure"].replace(" select id as system", ", ex as (select id as system") + """), sc as (select count(*) as scope from scope)
select ex.*, scope, round_even((100 * downstream_reach / scope)::double, 1) as pct_of_scope from ex, sc order by solo_descope desc, feeds_removed desc, system limit 50"""
ORACLES["sheet_scope_categories"] = FULL + """, labels(family, label) as (values ('req3', 'Protect stored account data'), ('req4', 'Protect cardholder data during transmission'), ('req3_sad', 'Sensitive authentication data must not be retained'),
  ('req7_8', 'Restrict and authenticate access'), ('req10', 'Log and monitor access'), ('req11', 'Test security regularly')), kinds(place, category, name) as (values (1, 'cde', 'In scope (CDE)'), (2, 'connected', 'Connected-to (also in scope)'), (3, 'out', 'Out of scope')),
tally as (select family, count(*) as m from fam group by family)
select place, name, (select count(*) from f where f.category = kinds.category) as systems from kinds union all select cast(3 + row_number() over (order by m desc, family) as int), label, m from tally join labels using (family)"""
