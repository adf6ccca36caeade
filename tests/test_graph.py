import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from scopeflow.operators import impact as im
from scopeflow.operators import narrate as na
from scopeflow.operators import planner as pl
from scopeflow.operators import reach as rc
from scopeflow.operators import rollup as ru
from scopeflow.operators import structure as st
from scopeflow.plans.engine import Engine, Run
from scopeflow.plans.estate import Estate
from scopeflow.sources import estate as src


def estate(spark, edges, carries=(), track=(), crn=(), alone=()):
    ids = sorted({x for e in edges for x in e} | set(alone))
    nodes = spark.createDataFrame([(i, True, i in carries, i in carries, i in track, i in crn) for i in ids], "id string, in_bam boolean, pci_flag boolean, carries_pan boolean, full_track boolean, crn_only boolean")
    rows = spark.createDataFrame([(a, b, "metadata", "DS1", "", "", "") for a, b in edges], ", ".join(f"{c} string" for c in src.EDGE_COLUMNS))
    return Estate(src.systems(nodes), rows)


def ids(df):
    return {r[0] for r in df.collect()}


def brute_closure(edges):
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
    out = {}
    for s in down:
        level, hops = {s}, 0
        while level:
            hops += 1
            level = {w for u in level for w in down.get(u, ()) if (s, w) not in out}
            out.update({(s, w): hops for w in level})
    return out


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    edges = sorted({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(26)})
    return edges, spark.createDataFrame(edges, "src string, dst string")


def test_closure_both_ways(spark, graph):
    edges, df = graph
    want = brute_closure(edges)
    for limit in (rc.LOCAL_EDGES, 0):
        assert {(r.src, r.dst): r.hops for r in rc.closure(df, limit=limit).collect()} == want


def test_betweenness_both_ways(spark, graph):
    edges, df = graph
    nodes = spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e})], "id string")
    one, two = ({r.id: round(r.b, 9) for r in rc.betweenness(nodes, df, limit=limit).collect()} for limit in (rc.LOCAL_EDGES, 0))
    assert one == two and max(one.values()) > 0


def test_betweenness_counts_all_starts(spark):
    """Of 701 nodes: 350 give to a hub, which gives to 350."""
    edges = spark.createDataFrame([(f"a{i}", "hub") for i in range(350)] + [("hub", f"z{i}") for i in range(350)], "src string, dst string")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    got = {r.id: r.b for r in rc.betweenness(nodes, edges).collect()}
    assert len(got) == 701 and got.pop("hub") == 350 * 350 and not any(got.values())
    assert 0 < rc.betweenness(nodes, edges, exact_up_to=600).where("id = 'hub'").first().b < 350 * 350


def test_cycle_and_self_loop(spark):
    e = estate(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")])
    rows = {r.members: (r.size, r.is_cycle) for r in st.dag_nodes(e).collect()}
    assert rows == {"a,b,c": (3, True), "d": (1, False), "x": (1, True)}
    assert [tuple(r) for r in st.dag_edges(e).collect()] == [("a", "d", 1)]


def test_pair(spark):
    e = estate(spark, [("BBP", "AAP")], carries={"BBP"})
    top = e.facts.where("id = 'BBP'").first()
    assert top.source_flag == 1 and top.reach == 1 and top.is_origin
    assert e.facts.where("risk < 0 or risk > 100").count() == 0
    hit = im.impact(e, im.labelled(e, {"t": ["BBP"]})).first()
    assert (hit.scope_before, hit.scope_after, hit.descoped, hit.sources_downgraded) == (2, 1, "AAP", 1)


def test_track_never_leaves(spark):
    e = estate(spark, [("SRC", "TRK"), ("SRC", "PLN")], carries={"SRC", "TRK"}, track={"TRK"})
    hit = im.impact(e, im.labelled(e, {"t": ["SRC"]})).first()
    assert hit.descoped == "PLN"
    families = {r.id: r.f for r in e.facts.select("id", F.array_join(ru.families(F.col("category")), ",").alias("f")).collect()}
    assert "req3_sad" in families["TRK"] and "req3_sad" not in families["PLN"]


def test_chain(spark):
    e = estate(spark, [("SRC", "RLY"), ("RLY", "LEAF")], carries={"SRC", "RLY", "LEAF"})
    assert ids(e.origins) == {"SRC"} and ids(e.scope) == {"SRC", "RLY", "LEAF"}
    assert pl.instance(e).total == 2
    assert st.depth(e) == 2


def test_onboarding(spark):
    e = estate(spark, [("SRC", "RLY"), ("RLY", "LEAF"), ("ISLE2", "OUT2")], carries={"SRC", "RLY", "LEAF"}, alone={"ISLE"})
    row = ru.onboarding(e, "new", ["rly", "GHOST9"], ["ISLE2"]).first()
    assert (row.category, row.origins_reaching, row.unknown_providers, row.can_fully_descope, row.scope_expansion) == ("cde", "SRC", "GHOST9", True, 2)
    assert ru.onboarding(e, "new", ["ISLE"]).first().category == "out"
    assert ru.onboarding(e, "new", ["ISLE"], ["LEAF"]).first().category == "connected"
    assert ru.onboarding(e, "new", ["ISLE"], detokenizes=True).first().permanent_cde


@pytest.mark.parametrize("seed", range(12))
def test_plans_against_all_sets(seed):
    r = random.Random(seed)
    sources = [f"s{i}" for i in range(7)]
    atoms = tuple((frozenset(r.sample(sources, r.randrange(1, 4))), r.randrange(1, 9)) for _ in range(8))
    inst = pl.Instance(tuple(sorted(atoms, key=lambda a: -a[1])), tuple(sources))
    curve = [0] + [f for _, _, f in pl.greedy(inst, 7)]
    for k in range(8):
        want = max(inst.freed(frozenset(s for s, on in zip(sources, bits) if on)) for bits in product((0, 1), repeat=7) if sum(bits) <= k)
        got, chosen, certified, upper = pl.best_sets(inst, k)
        assert (got, certified, upper) == (want, True, want) and inst.freed(frozenset(chosen)) == want and len(chosen) <= k
        assert got >= curve[min(k, len(curve) - 1)]


def test_many_overlapping_atoms_are_certified():
    """252 sets of 70 origins, as the star estate has them: a bound by the summed weight of all sets that still fit prunes next to nothing."""
    r = random.Random(11)
    sources = [f"s{i:02d}" for i in range(70)]
    atoms = {frozenset([s]): max(1, 40 // (i + 1)) for i, s in enumerate(sources[:36])}
    while len(atoms) < 252:
        atoms.setdefault(frozenset(r.sample(sources, r.randrange(2, 9))), r.randrange(1, 8))
    inst = pl.Instance(tuple(sorted(atoms.items(), key=lambda a: (-a[1], sorted(a[0])))), tuple(sources))
    curve = [0] + [f for _, _, f in pl.greedy(inst, 10)]
    for k in range(11):
        got, chosen, certified, upper = pl.best_sets(inst, k, 20_000)
        assert certified and curve[k] <= got == upper == inst.freed(frozenset(chosen)) and len(chosen) <= k


def test_a_search_beyond_its_budget_says_so():
    r = random.Random(4)
    sources = [f"s{i:02d}" for i in range(24)]
    atoms = {frozenset(r.sample(sources, 3)): 1 for _ in range(160)}
    inst = pl.Instance(tuple(atoms.items()), tuple(sources))
    want = pl.best_sets(inst, 7)
    got, chosen, certified, upper = pl.best_sets(inst, 7, 5)
    assert want[2] and not certified and got == inst.freed(frozenset(chosen)) <= want[0] <= upper


def test_cuts_count_all_sources(spark):
    """Of many sources, also those far down the list hold a target."""
    edges = [(f"s{i:04d}", "t") for i in range(300)] + [("t", "u"), ("s0000", "u"), ("s0000", "s0000")]
    df = spark.createDataFrame(edges, "src string, dst string")
    sources = spark.createDataFrame([(f"s{i:04d}",) for i in range(300)] + [("alone",)], "id string")
    targets = spark.createDataFrame([("t",), ("u",), ("s0001",)], "id string")
    assert {r.target: r.cut_size for r in rc.min_cuts(df, sources, targets).collect()} == {"t": 300, "u": 2}


def test_cliff_and_concentration(spark):
    curve = lambda *p: spark.createDataFrame(list(p), "k long, fully_descoped long")
    assert tuple(na.curve_cliff(curve((6, 9), (0, 0), (4, 2), (2, 0), (8, 16))).first()) == (4, 2, 6, 9, 7, 16)
    assert na.curve_cliff(curve((0, 3), (2, 3), (4, 1))).count() == na.curve_cliff(curve((0, 3))).count() == na.curve_cliff(curve()).count() == 0
    e = estate(spark, [("a", "b"), ("b", "c"), ("a", "d")], carries={"a"})
    assert tuple(st.concentration(e).first()) == (4, round(2 * (3 * 1 + 4 * 3) / (4 * 4) - 5 / 4, 3), round(10 / 16, 4), 100.0)


@pytest.fixture(scope="module")
def star(spark):
    return Estate.of_star(spark, "/root/testdata/sf0.01")


def test_solo_is_what_one_source_frees(star):
    rows = im.exposure(star).where("solo_descope > 0").collect()
    assert rows
    for r in rows[:2]:
        assert im.impact(star, im.labelled(star, {"t": [r.system]})).first().nodes_descoped == r.solo_descope <= r.downstream_reach


def test_one_number_of_descopable_systems(star):
    inst = pl.instance(star)
    most = im.saturation(star).agg(F.max("fully_descoped")).first()[0]
    econ = ru.economics(star, im.saturation(star)).first()
    assert inst.total == most == econ.removable == 42


def test_rollups_add_up(star):
    total = ru.totals(star).first()
    own = ru.ownership(star).agg(F.sum("systems").alias("systems"), F.sum("in_scope").alias("in_scope"), F.sum("hidden_pci").alias("hidden")).first()
    assert (own.systems, own.in_scope, own.hidden) == (total.systems, total.in_scope, total.hidden)
    assert total.confirmed + total.inferred_only == total.in_scope == 53
    links = ru.sankey_links(star).collect()
    names = ids(ru.sankey_nodes(star).select("id"))
    assert all(r.value > 0 and r.source in names and r.target in names for r in links)


def test_run_waits_at_the_gate(spark, star):
    run = Run(spark, lambda s: star)
    assert run.start() == "gate" and len(run.picks) == 3
    assert run.resume("revise", "use 2 please") == "gate" and len(run.picks) == 2
    assert run.resume("approve") == "done"
    assert {"ingest", "validate", "graph", "dag", "score", "analyze", "report"} <= {a["stage"] for a in run.audit}
    leaky = star.nodes.withColumn("app_name", F.lit("4111111111111111"))
    assert Run(spark, lambda s: Estate(leaky, star.edges)).start() == "aborted"


def test_answers_carry_the_numbers(star):
    e = Engine(star)
    assert "53 of 100" in e.ask("how many systems are in scope?")
    assert "3 hidden" in e.ask("hidden systems?")
    assert "53 systems" in e.memo()
