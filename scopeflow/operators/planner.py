"""Which sources to tokenize. Plans work on atoms: sets of origins that must all go, with the number of systems that then leave scope.

A plan of k picks can complete no atom of more than k origins, so only atoms of up to k come to the driver, and only within MAX_ATOMS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.operators.impact import impact, origin_ranks

MAX_ATOMS = 200_000
POOL = 25  # the widest origins that a plan picks from
BOUND_STEPS = 60  # per branch
SURE = 1 - 1e-6  # what a bound must be above the best so far: frees are whole numbers, the bounds are floats


@dataclass(frozen=True)
class Instance:
    atoms: tuple[tuple[frozenset[str], int], ...]
    by_reach: tuple[str, ...]
    descopable: int | None = None  # all systems that can leave, where atoms are not all

    @property
    def total(self) -> int:
        return sum(w for _, w in self.atoms) if self.descopable is None else self.descopable

    def freed(self, chosen: frozenset[str]) -> int:
        return sum(w for a, w in self.atoms if a <= chosen)


def instance(estate, picks: int = 25) -> Instance:
    """What plans of up to ``picks`` sources need."""
    rows = estate.atoms.where(F.col("size") <= picks).orderBy(F.desc("weight"), "origins").limit(MAX_ATOMS + 1).collect()
    if len(rows) > MAX_ATOMS:
        raise ValueError(f"more than {MAX_ATOMS} distinct sets of origins: plan for one island at a time")
    # Origins in no atom gain nothing, so only the first of those can be picked, one for each pick at most.
    ranks = origin_ranks(estate)
    named = estate.atoms.where(F.col("size") <= picks).select(F.explode(F.split("origins", ",")).alias("origin")).distinct()
    order = ranks.where(F.col("rank") <= max(picks, POOL)).union(ranks.join(named, "origin", "left_semi")).distinct().orderBy("rank").collect()
    return Instance(tuple((frozenset(r.origins.split(",")), r.weight) for r in rows), tuple(r.origin for r in order), estate.atoms.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])


def greedy(inst: Instance, steps: int, pool: int | None = None, strict: bool = False, enough: float | None = None) -> list[tuple[str, int, int]]:
    """(pick, gain, freed so far): each time the candidate of most gain, the first by reach on ties. ``strict`` stops at no gain,
    ``enough`` once that share of all systems that can leave is free.
    """
    candidates = list(inst.by_reach[:pool])
    left = {a: set(a) for a, _ in inst.atoms}
    picks, freed = [], 0
    while candidates and len(picks) < steps:
        gains = dict.fromkeys(candidates, 0)
        for a, w in inst.atoms:
            rest = left[a]
            if len(rest) == 1:
                last = next(iter(rest))
                if last in gains:
                    gains[last] += w
        best = max(candidates, key=lambda s: gains[s])  # the first of equals
        if strict and not gains[best]:
            break
        candidates.remove(best)
        freed += gains[best]
        for rest in left.values():
            rest.discard(best)
        picks.append((best, gains[best], freed))
        if enough is not None and inst.total and freed / inst.total >= enough:
            break
    return picks


def cumulative_curve(estate, inst: Instance, steps: int = 25) -> DataFrame:
    """The greedy curve over all origins, with the number of systems that have lost a feed by each step."""
    picks = greedy(inst, steps)
    if not picks:
        return estate.spark.createDataFrame([], "k long, last_source string, marginal_descoped long, cumulative_descoped long, cumulative_feeds_removed long")
    rows = estate.spark.createDataFrame([(i + 1, *p) for i, p in enumerate(picks)], "k long, last_source string, marginal_descoped long, cumulative_descoped long")
    down = estate.source_pairs.where("src <> dst").join(rows.select(F.col("last_source").alias("src"), "k"), "src").join(estate.scope.withColumnRenamed("id", "dst"), "dst", "left_semi")
    first = down.groupBy("dst").agg(F.min("k").alias("at")).groupBy("at").agg(F.count("*").alias("m"))
    fed = rows.join(first, F.col("at") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("cumulative_feeds_removed"))
    return rows.join(fed, "k")


def plan_rows(estate, inst: Instance, target: float = 0.8, steps: int = 8, pool: int = POOL) -> list[tuple]:
    """(step, system, gain, freed so far, scope after, percent of what can be freed) of the greedy plan."""
    picks = greedy(inst, steps, pool, strict=True, enough=target)
    before = estate.scope.count()
    return [(i + 1, s, gain, freed, before - freed, round(100 * freed / max(1, inst.total), 1)) for i, (s, gain, freed) in enumerate(picks)]


def tokenization_plan(estate, inst: Instance, target: float = 0.8, steps: int = 8, pool: int = POOL) -> DataFrame:
    rows = plan_rows(estate, inst, target, steps, pool)
    plan = estate.spark.createDataFrame(rows, "step long, tokenize string, marginal_descoped long, cumulative_descoped long, scope_after long, pct_of_descopable double")
    return plan.join(estate.facts.select(F.col("id").alias("tokenize"), F.col("solo").alias("solo_descope")), "tokenize", "left")


def levers(estate, inst: Instance, n: int = 3) -> list[str]:
    """The first greedy picks, filled up with the sources of most feeds."""
    picks = [s for s, _, _ in greedy(inst, max(1, n), POOL, strict=True, enough=1.0)]
    if len(picks) < n:
        more = estate.facts.where("is_origin").orderBy(F.desc("reach"), F.desc("solo"), "id").limit(n + len(picks)).select("id").collect()
        picks += [r.id for r in more if r.id not in picks]
    return picks[:n]


@dataclass(frozen=True)
class _Branch:
    """What is left to decide once some origins are in and some are out: for each origin that an open atom still asks for, one entry."""

    got: float
    chosen: tuple[int, ...]
    room: int
    atom: np.ndarray  # of each entry, ascending
    origin: np.ndarray
    share: np.ndarray  # of the atom's weight that this origin holds; an atom's shares sum to its weight

    def decided(self, weights: np.ndarray, come: np.ndarray, go: np.ndarray) -> _Branch:
        """With ``come`` in and ``go`` out: atoms that are complete count, those that cannot be any more are gone, the others share what the chosen held."""
        n, room, chosen = len(weights), self.room - len(come), np.isin(self.origin, come)
        dead = np.bincount(self.atom[np.isin(self.origin, go)], minlength=n) > 0
        live = (np.bincount(self.atom, minlength=n) > 0) & ~dead
        left = np.bincount(self.atom[~chosen], minlength=n)
        keep = (live & (left <= room))[self.atom] & ~chosen
        atom, share = self.atom[keep], self.share[keep]
        more = (weights - np.bincount(atom, share, n)) / np.maximum(left, 1)
        return _Branch(self.got + weights[live & (left == 0)].sum(), (*self.chosen, *come.tolist()), room, atom, self.origin[keep], share + more[atom])


def _balanced(weights: np.ndarray, atom: np.ndarray, place: np.ndarray, share: np.ndarray, n: int, room: int, enough: float) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(bound, what each of ``n`` origins holds, shares, steps): no ``room`` origins free more than the ``room`` that hold most.

    Whatever the shares, that is a bound, as a set holds all that it frees. Each step moves a part of each atom's weight to those of its origins that hold least,
    which lowers the bound; it ends below ``enough``.
    """
    starts = np.flatnonzero(np.diff(atom, prepend=-1))
    sizes = np.diff(starts, append=len(atom))
    whole = weights[atom]
    bound, held, best = np.inf, None, share
    for step in range(BOUND_STEPS):
        now = np.bincount(place, share, n)
        top = np.partition(now, n - room)[n - room :].sum() if room < n else now.sum()
        if top < bound:
            bound, held, best = top, now, share
        if bound < enough:
            break
        least = now[place] == np.repeat(np.minimum.reduceat(now[place], starts), sizes)
        to = np.where(least, whole / np.repeat(np.add.reduceat(least.astype(np.int64), starts), sizes), 0.0)
        share = share + (2 / (step + 3)) * (to - share)
    return bound, held, best, step + 1


def best_sets(inst: Instance, k: int, budget: int = 2_000_000) -> tuple[int, list[str], bool, int]:
    """(freed, sources, certified, upper bound) of the best set of up to k sources: depth-first over origins, the one that holds most of the atoms' weight
    first (see ``_balanced``). A branch ends where its bound does not beat the best so far; origins without which, or with which, the bound would not
    are decided at once. Past ``budget`` steps of bounds the result is not certified.
    """
    start = frozenset(s for s, _, _ in greedy(inst, k))
    names = sorted({x for a, _ in inst.atoms for x in a})
    at = {x: i for i, x in enumerate(names)}
    atoms = [(sorted(map(at.get, a)), w) for a, w in inst.atoms if len(a) <= k]
    best, best_set, seen, cut = inst.freed(start), None, 0, False
    upper = best
    weights = np.array([w for _, w in atoms], np.float64)
    sizes = np.array([len(a) for a, _ in atoms], np.int64)
    entries = np.array([x for a, _ in atoms for x in a], np.int64)
    none = np.zeros(0, np.int64)
    whole = _Branch(0.0, (), k, np.repeat(np.arange(len(atoms)), sizes), entries, np.repeat(weights / sizes, sizes))
    stack = [(np.inf, whole)]
    while stack:
        bound, here = stack.pop()
        if bound < best + SURE:
            continue
        if seen > budget:
            cut, upper = True, max(upper, int(bound + 1 - SURE))
            continue
        while len(here.atom):
            ids, place = np.unique(here.origin, return_inverse=True)
            if here.room >= len(ids):
                here = here.decided(weights, ids, none)
                break
            need = best + SURE - here.got
            held_most, held, share, steps = _balanced(weights, here.atom, place, here.share, len(ids), here.room, need)
            here, seen = replace(here, share=share), seen + steps
            bound = here.got + held_most
            if held_most < need:
                break
            order = np.argsort(-held, kind="stable")
            top = np.zeros(len(ids), bool)
            top[order[: here.room]] = True
            come = ids[top & (held_most - held + held[order[here.room]] < need)]
            go = ids[~top & (held_most + held - held[order[here.room - 1]] < need)]
            if not len(come) and not len(go):
                one = ids[order[:1]]
                stack += [(bound, here.decided(weights, none, one)), (bound, here.decided(weights, one, none))]
                break
            here = here.decided(weights, come, go)
        if here.got > best:
            best, best_set = int(here.got), here.chosen
    return best, sorted(start if best_set is None else (names[i] for i in best_set)), not cut, max(best, upper)


def frontier(estate, inst: Instance, k_max: int = 10) -> DataFrame:
    """(k, optimal, greedy, gap, certified, upper_bound, pct) for budgets 0 to k_max, a task for each."""
    curve = [0] + [f for _, _, f in greedy(inst, k_max)]
    shared = estate.spark.sparkContext.broadcast(inst)  # within MAX_ATOMS
    base = [(k, curve[min(k, len(curve) - 1)]) for k in range(min(k_max, len(inst.by_reach)) + 1)]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, g in zip(frame["k"], frame["greedy"]):
                value, sources, certified, upper = best_sets(shared.value, int(k))
                yield pd.DataFrame({"k": [k], "optimal": [value], "greedy": [g], "gap": [value - g], "certified": [certified], "upper_bound": [upper], "sources": [",".join(sources)], "pct": [round(100 * value / max(1, shared.value.total), 1)]})

    rows = estate.spark.createDataFrame(base, "k long, greedy long").repartition(len(base), "k")
    return rows.mapInPandas(solve, "k long, optimal long, greedy long, gap long, certified boolean, upper_bound long, sources string, pct double")


def optimization(estate, inst: Instance, k_max: int = 10) -> DataFrame:
    """The frontier, and on each row how it was solved, the largest gap to greedy, and greedy's share of the optimum where greedy stops gaining."""
    rows = frontier(estate, inst, k_max)
    stop = len(greedy(inst, k_max, strict=True))
    share = F.max(F.when(F.col("k") == stop, F.when(F.col("optimal") > 0, F.bround(100 * F.col("greedy") / F.col("optimal"), 1)).otherwise(100.0)))
    whole = Window.partitionBy(F.lit(0))  # k_max + 1 rows; a join with their totals would solve them twice
    method = F.when(F.min("certified").over(whole), "branch and bound, certified").otherwise("branch and bound, not certified")
    return rows.withColumns({"method": method, "max_greedy_gap": F.max("gap").over(whole), "greedy_efficiency_pct": F.coalesce(share.over(whole), F.lit(100.0))})


def next_actions(estate, inst: Instance) -> DataFrame:
    """(place, action, systems, amount): tokenize the plan's first three (their summed reach, what they free and what they leave with fewer feeds), then look
    into the hidden systems (the first of them and how far it reaches)."""
    steps = plan_rows(estate, inst)[:3]
    names = [r[1] for r in steps]
    chosen = estate.spark.createDataFrame([("plan", s) for s in names], "label string, id string")
    hit = impact(estate, chosen).select(F.explode(F.array(F.struct(F.lit(2).alias("place"), F.lit("freed").alias("action"), F.col("nodes_descoped").alias("amount")), F.struct(F.lit(3).alias("place"), F.lit("feeds_removed").alias("action"), F.col("feeds_removed").alias("amount")))).alias("x"))
    hit = hit.select("x.place", "x.action", F.lit(",".join(names)).alias("systems"), "x.amount")
    reach = estate.facts.where(F.col("id").isin(names)).agg(F.sum("reach").alias("amount")).where("amount is not null")
    reach = reach.select(F.lit(1).alias("place"), F.lit("tokenize").alias("action"), F.lit(",".join(names)).alias("systems"), "amount")
    hidden = estate.facts.where("hidden")
    missed = hidden.agg(F.count("*").alias("amount")).where("amount > 0").select(F.lit(4).alias("place"), F.lit("hidden").alias("action"), F.lit("").alias("systems"), "amount")
    worst = hidden.orderBy(F.desc("reach"), "id").limit(1).select(F.lit(5).alias("place"), F.lit("start_with").alias("action"), F.col("id").alias("systems"), F.col("reach").alias("amount"))
    return reach.unionAll(hit).unionAll(missed).unionAll(worst)


def milestones(curve: DataFrame) -> DataFrame:
    """The least budget that frees 25, 50, 75 and all percent."""
    wanted = curve.sparkSession.createDataFrame([(25,), (50,), (75,), (100,)], "milestone int")
    return wanted.join(F.broadcast(curve.select("k", "pct")), F.col("pct") >= F.col("milestone"), "left").groupBy("milestone").agg(F.min("k").alias("k"))
