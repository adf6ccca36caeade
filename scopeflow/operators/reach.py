"""Recursive operators on edges (src, dst): closure, components, longest path, betweenness, articulation points, minimum cuts.

Graphs of up to LOCAL_EDGES edges are broadcast as adjacency lists and searched from each start in parallel; larger ones are searched by
joins level by level. Both ways give the same rows.
"""

from __future__ import annotations

import weakref
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeflow.storage import written

#: Edges of a graph that may be broadcast (about 16 bytes each as they travel).
LOCAL_EDGES = 1_000_000
CUT_EVERY = 4  # rounds of a loop after which its table is written
COPIES = 16  # starts that a search follows side by side
_GRAPHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


class Graph:
    """Distinct edges as arrays: the successors of node i are ``to[first[i] : first[i + 1]]``, in order; ids are in order too."""

    def __init__(self, src: list[str], dst: list[str]):
        self.ids, both = np.unique(np.array([*src, *dst], dtype=object), return_inverse=True)
        n = len(self.ids)
        edges = np.unique(both[: len(src)].astype(np.int64) * n + both[len(src) :])
        self.to = edges % max(1, n)
        self.first = np.searchsorted(edges, np.arange(n + 1) * n)

    def __len__(self) -> int:
        return len(self.ids)

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(self.ids, pa.string())

    def numbers(self, ids: list[str]) -> np.ndarray:
        """The nodes of those ``ids`` that are in the graph."""
        wanted = np.array(ids, dtype=object)
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self) - 1) if len(self) else np.zeros(0, np.int64)
        return at[self.ids[at] == wanted] if len(self) else at

    def steps(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of all edges out of ``level``: places in COPIES copies of the nodes, one after another."""
        node = level % len(self)
        out = self.first[node + 1] - self.first[node]
        total = np.cumsum(out)
        at = np.repeat(self.first[node] - (total - out), out) + np.arange(int(total[-1]) if len(total) else 0)
        return np.repeat(level, out), self.to[at] + np.repeat(level - node, out)

    @cached_property
    def successors(self) -> dict[str, list[str]]:
        cuts = self.first.tolist()
        names, to = self.ids.tolist(), self.ids[self.to].tolist()
        return {names[i]: to[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b}

    @cached_property
    def components(self) -> list[list[str]]:
        """Cycle clusters and single nodes, each after all that it leads to."""
        return strong_components(self.successors)


def adjacency(edges: DataFrame, limit: int = LOCAL_EDGES):
    """A broadcast of the graph, or None where it has more than ``limit`` edges. One is kept for each table of edges."""
    if edges not in _GRAPHS:
        rows = edges.select("src", "dst").limit(LOCAL_EDGES + 1).toArrow()
        known = None
        if rows.num_rows <= LOCAL_EDGES:
            graph = Graph(rows["src"].to_pylist(), rows["dst"].to_pylist())
            known = (edges.sparkSession.sparkContext.broadcast(graph), len(graph.to))
        _GRAPHS[edges] = known
    known = _GRAPHS[edges]
    return None if known is None or known[1] > limit else known[0]


def _batches(frames: Iterator[pa.RecordBatch], graph: Graph) -> Iterator[np.ndarray]:
    for batch in frames:
        starts = graph.numbers(batch.column(0).to_pylist())
        for a in range(0, len(starts), COPIES):
            yield starts[a : a + COPIES]


def closure(edges: DataFrame, seeds: DataFrame | None = None, limit: int = LOCAL_EDGES) -> DataFrame:
    """(src, dst, hops): all that each node (or each of ``seeds.id``) reaches over one edge or more, and how soon. A node reaches itself over a cycle only."""
    local = adjacency(edges, limit)
    edges = edges.select("src", "dst").distinct()
    if local is not None:
        starts = edges.select(F.col("src").alias("id")).distinct() if seeds is None else seeds.select("id").distinct()

        def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = local.value
            for own in _batches(frames, graph):
                seen = np.zeros(len(own) * len(graph), bool)
                level, hops = np.arange(len(own)) * len(graph) + own, 0
                while len(level):
                    hops += 1
                    _, to = graph.steps(level)
                    level = np.unique(to[~seen[to]])
                    seen[level] = True
                    if len(level):
                        copy = level // len(graph)
                        yield pa.RecordBatch.from_arrays([graph.names.take(pa.array(own[copy])), graph.names.take(pa.array(level % len(graph))), pa.array(np.full(len(level), hops, np.int32))], ["src", "dst", "hops"])

        return starts.repartition("id").mapInArrow(search, "src string, dst string, hops int")
    frontier = edges if seeds is None else edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    seen = frontier = written(frontier.withColumn("hops", F.lit(1)), "closure")
    hops = 1
    while True:
        hops += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        frontier = written(step.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)), "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
        if hops % CUT_EVERY == 0:
            seen = written(seen, "closure")


BLOCK = 4096  # targets that one task tracks as bits of a number


def reach_counts(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """(id, reach): how many other nodes each node reaches; nodes that reach none are left out. No pair is made: nodes are taken against the flow,
    and each one's set is the union of its successors' sets, as bits; a task for each block of targets.
    """
    local = adjacency(edges, limit)
    if local is None:
        return closure(edges, limit=limit).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reach"))
    n = len(local.value)
    blocks = edges.sparkSession.range(0, max(1, -(-n // BLOCK)), 1, max(1, -(-n // BLOCK)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, order = local.value.successors, local.value.components
        number = {v: i for i, v in enumerate(local.value.ids.tolist())}
        for frame in frames:
            for block in frame["id"]:
                low, bits = int(block) * BLOCK, {}
                found: dict[str, int] = {}
                for group in order:  # successors come first
                    own = 0
                    for u in group:
                        for v in graph.get(u, ()):
                            own |= bits.get(v, 0)
                            if low <= number[v] < low + BLOCK:
                                own |= 1 << (number[v] - low)
                    for u in group:
                        bits[u] = own
                        at = number[u] - low
                        m = own.bit_count() - (0 <= at < BLOCK and own >> at & 1)
                        if m:
                            found[u] = m
                yield pd.DataFrame({"id": pd.Series(list(found), dtype="object"), "reach": pd.array(list(found.values()), "int64")})

    return blocks.mapInPandas(count, "id string, reach long").groupBy("id").agg(F.sum("reach").alias("reach"))


def strong_components(graph: dict[str, list[str]]) -> list[list[str]]:
    """Cycle clusters and single nodes, each after all that it leads to. Depth-first with an explicit stack."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on_hold: set[str] = set()
    out: list[list[str]] = []
    for root in sorted(graph):
        if root in index:
            continue
        work = [(root, iter(graph.get(root, ())))]
        index[root] = low[root] = len(index)
        held.append(root)
        on_hold.add(root)
        while work:
            u, rest = work[-1]
            for v in rest:
                if v not in index:
                    index[v] = low[v] = len(index)
                    held.append(v)
                    on_hold.add(v)
                    work.append((v, iter(graph.get(v, ()))))
                    break
                if v in on_hold:
                    low[u] = min(low[u], index[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    group = []
                    while not group or group[-1] != u:
                        group.append(held.pop())
                        on_hold.discard(group[-1])
                    out.append(group)
    return out


def cycle_labels(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """(id, scc): the least id of each node's cycle cluster; nodes on no cycle are left out."""
    local = adjacency(edges, limit)
    if local is None:
        return same_component(closure(edges, limit=limit))

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = local.value.successors
        for _ in frames:
            rows = [(v, min(group)) for group in local.value.components for v in group if len(group) > 1 or v in graph.get(v, ())]
            yield pd.DataFrame(rows, columns=["id", "scc"], dtype="object")

    return edges.sparkSession.range(1).coalesce(1).mapInPandas(label, "id string, scc string")


def same_component(pairs: DataFrame) -> DataFrame:
    """(id, scc) from a closure: the least id with which each node is on a cycle; nodes on none are left out."""
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return pairs.select("src", "dst").join(back, ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("scc"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, island) over undirected edges: the least id reachable. Labels move to the least of the neighbourhood and then to their own label's label."""
    links = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    now = written(nodes.select("id", F.col("id").alias("island")), "islands")
    while True:
        near = links.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("island").alias("near"))
        then = now.join(near, "id", "left").select("id", F.least("island", "near").alias("island"), F.col("island").alias("was"))
        jump = then.select(F.col("id").alias("island"), F.col("island").alias("further"))
        then = written(then.join(jump, "island", "left").select("id", F.least("island", "further").alias("island"), "was"), "islands")
        if then.where("island <> was").isEmpty():
            return then.select("id", "island")
        now = then.select("id", "island")


def longest_path(edges: DataFrame) -> int:
    """Edges of the longest path of an acyclic graph: how often the ends of ever longer walks still have an edge."""
    steps, ends = 0, edges.select(F.col("dst").alias("at")).distinct()
    while not ends.isEmpty():
        steps += 1
        ends = edges.join(ends.withColumnRenamed("at", "src"), "src", "left_semi").select(F.col("dst").alias("at")).distinct()
        ends = written(ends, "depth")
    return steps


def betweenness(nodes: DataFrame, edges: DataFrame, exact_up_to: int | None = None, pivots: int = 400, limit: int = LOCAL_EDGES) -> DataFrame:
    """(id, b): shortest-path betweenness, summed over all starts. If ``exact_up_to`` is given, an estimate beyond that many nodes: over the ``pivots`` of least hashed id."""
    n = nodes.count()
    starts = nodes.select("id") if exact_up_to is None or n <= exact_up_to else nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(pivots)
    if n <= 2:
        return nodes.select("id", F.lit(0.0).alias("b"))
    local = adjacency(edges, limit)
    if local is None:
        parts = _brandes_by_joins(starts, edges.select("src", "dst").where("src <> dst").distinct())
    else:
        parts = starts.repartition("id").mapInArrow(_brandes(local), "id string, b double")
    return nodes.select("id").join(parts.groupBy("id").agg(F.sum("b").alias("b")), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("b"))


def _brandes(local):
    """Path counts level by level, then shares back, for COPIES starts at a time: the same node in another copy is another place."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = local.value
        n = len(graph)
        total = np.zeros(n)
        for own in _batches(frames, graph):
            far, paths, share = np.full(len(own) * n, -1, np.int32), np.zeros(len(own) * n), np.zeros(len(own) * n)
            level = starts = np.arange(len(own)) * n + own
            far[level], paths[level] = 0, 1.0
            hops, steps = 0, []
            while len(level):
                hops += 1
                u, v = graph.steps(level)
                level = np.unique(v[far[v] < 0])
                far[level] = hops
                next_ = far[v] == hops  # an edge back, or to the node itself, is on no shortest path
                u, v = u[next_], v[next_]
                np.add.at(paths, v, paths[u])
                steps.append((u, v))
            for u, v in reversed(steps):
                np.add.at(share, u, paths[u] / paths[v] * (1 + share[v]))
            share[starts] = 0
            total += share.reshape(len(own), n).sum(0)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([graph.names.take(pa.array(some)), pa.array(total[some])], ["id", "b"])

    return run


def _brandes_by_joins(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by levels: path counts forwards, shares backwards, for all starts at once."""
    level = written(starts.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "brandes")
    levels, seen = [level], level.select("s", "v")
    while True:
        step = level.join(edges.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["s", "v"], "left_anti"), "brandes")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionAll(level.select("s", "v"))
    share, out = levels[-1].withColumn("share", F.lit(0.0)), None
    for upper in reversed(levels[:-1]):
        part = share.where("s <> v").select(F.col("v").alias("id"), F.col("share").alias("b"))
        out = part if out is None else out.unionAll(part)
        lower = share.select("s", F.col("v").alias("dst"), F.col("paths").alias("lower_paths"), F.col("share").alias("lower_share"))
        got = upper.join(edges.withColumnRenamed("src", "v"), "v").join(lower, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("lower_paths") * (1 + F.col("lower_share"))).alias("share"))
        share = written(upper.join(got, ["s", "v"], "left").fillna(0.0, ["share"]), "brandes")
    return out if out is not None else starts.select("id", F.lit(0.0).alias("b"))


def _in_one_task(edges: DataFrame, what: str, run, schema: str) -> DataFrame:
    local = adjacency(edges)
    if local is None:
        raise ValueError(f"{what} takes at most {LOCAL_EDGES} edges: give it a part of the graph, such as one island")
    return edges.sparkSession.range(1).coalesce(1).mapInPandas(lambda frames: run(local.value.successors), schema)


def articulation_points(edges: DataFrame) -> DataFrame:
    """(id): nodes whose removal parts their component of the undirected graph. One depth-first search; at most LOCAL_EDGES edges."""

    def run(graph: dict[str, list[str]]) -> Iterator[pd.DataFrame]:
        near: dict[str, set[str]] = {}
        for u, vs in graph.items():
            for v in vs:
                if u != v:
                    near.setdefault(u, set()).add(v)
                    near.setdefault(v, set()).add(u)
        found, seen = set(), {}
        for root in sorted(near):
            if root in seen:
                continue
            seen[root] = low_root = len(seen)
            low, children = {root: low_root}, 0
            stack = [(root, None, iter(sorted(near[root])))]
            while stack:
                u, parent, rest = stack[-1]
                v = next(rest, None)
                if v is None:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[u])
                        if parent == root:
                            children += 1
                        elif low[u] >= seen[parent]:
                            found.add(parent)
                elif v not in seen:
                    seen[v] = low[v] = len(seen)
                    stack.append((v, u, iter(sorted(near[v]))))
                elif v != parent:
                    low[u] = min(low[u], seen[v])
            if children > 1:
                found.add(root)
        yield pd.DataFrame({"id": sorted(found)}, dtype="object")

    return _in_one_task(edges, "the search for articulation points", run, "id string")


def min_cuts(edges: DataFrame, sources: DataFrame, targets: DataFrame, shown: int = 12) -> DataFrame:
    """(target, cut_size, cut_edges): the fewest edges whose removal parts each target from all sources, and the first ``shown`` of them on
    the sources' side. A target that is a source can't be parted and is left out. Targets run in parallel.
    """
    local = adjacency(edges)
    if local is None:
        raise ValueError(f"minimum cuts take at most {LOCAL_EDGES} edges: give them a part of the graph")
    # Sources without an edge cut nothing; the others are no more than edges.
    roots = sorted(r.id for r in sources.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_semi").distinct().collect())
    targets = targets.select("id").join(sources.select("id"), "id", "left_anti")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = {u: [v for v in vs if v != u] for u, vs in local.value.successors.items()}
        for frame in frames:
            for target in frame["id"]:
                flow: dict[str, dict[str, int]] = {}
                for u, vs in graph.items():
                    for v in vs:
                        flow.setdefault(u, {})[v] = flow.setdefault(u, {}).get(v, 0) + 1
                        flow.setdefault(v, {}).setdefault(u, 0)
                size = 0
                while True:
                    came: dict[str, str | None] = dict.fromkeys(roots)
                    queue = deque(roots)
                    while queue and target not in came:
                        u = queue.popleft()
                        for v, room in flow.get(u, {}).items():
                            if room > 0 and v not in came:
                                came[v] = u
                                queue.append(v)
                    if target not in came:
                        break
                    v = target
                    while came[v] is not None:
                        u = came[v]
                        flow[u][v] -= 1
                        flow[v][u] += 1
                        v = u
                    size += 1
                edges_cut = sorted(f"{u}->{v}" for u, vs in graph.items() if u in came for v in vs if v not in came)
                yield pd.DataFrame({"target": [target], "cut_size": pd.array([size], "int64"), "cut_edges": [",".join(edges_cut[:shown])]})

    return targets.select("id").repartition("id").mapInPandas(cut, "target string, cut_size long, cut_edges string")


def ego(edges: DataFrame, root: str, hops: int, way: str = "both") -> DataFrame:
    """(id, hop) of the nodes within ``hops`` of ``root``, downstream, upstream, or either way at each step."""
    e = edges.select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"down": e, "up": back, "both": e.unionAll(back)}[way].distinct()
    seen = edges.sparkSession.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        near = steps.join(seen.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(hop).alias("hop"))
        seen = seen.unionAll(near).groupBy("id").agg(F.min("hop").alias("hop"))
    return seen


def joined(c: Column) -> Column:
    """A set of ids as one comma-joined text in order."""
    return F.array_join(F.sort_array(c), ",")
