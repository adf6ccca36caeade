"""URL rules: a trie over reversed host labels and, below each host, over path segments.

``judge_urls`` adds host, path, rule and verdict to every row. A rule fits its host and all subdomains if the path starts with
the rule's path; of all that fit, the one with most host labels and then the longest path wins, allow before block on a tie of
the same text. Null url or one without ``://``: empty host and path, no rule, the default verdict. Repeated rows are judged
alike, rows keep all their columns (an input column named like a result column is replaced), long urls are judged whole, an empty table
stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


#: A rule list up to this many characters is broadcast as a trie; a longer one is joined (``judge_by_join``).
TRIE_CHARS = 8 << 20
_RULES = 0


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nodes are dicts of reversed labels; at key 0 a node has the path trie of the rules for exactly that host.

    A path trie's nodes are dicts of whole segments; at key 0 are the (partial last segment, rule) that end there, longest first.
    """
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_RULES, {})
        *whole, partial = rule.path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault(_RULES, []).append((partial, rule))
    _sort(root)
    return root


def _sort(node: dict) -> None:
    for k, v in node.items():
        if isinstance(v, list):
            v.sort(key=lambda x: (-len(x[0]), x[1].verdict != "allow", x[0]))
        else:
            _sort(v)


def longest(trie: dict, host: str, path: str) -> Rule | None:
    levels, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if _RULES in node:
            levels.append(node[_RULES])
    segments = path.split("/")
    for paths in reversed(levels):
        best = None
        for i, segment in enumerate(segments):
            for partial, rule in paths.get(_RULES, ()):
                if segment.startswith(partial):
                    best = rule
                    break
            paths = paths.get(segment)
            if paths is None or i == len(segments) - 1:
                break
        if best:
            return best
    return None


def judge_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict (see the module). The trie is broadcast only while the rule list is within TRIE_CHARS."""
    names = ("host", "path", "rule", "verdict")
    kept = [c for c in df.columns if c not in names]
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url_col}`").alias("__url"))
    base = base.withColumn("__x", F.transform(F.array(F.col("__url")), lambda url: F.struct(*_named(url))).getItem(0))
    base = base.withColumn("host", F.col("__x.host")).withColumn("path", F.col("__x.path")).drop("__x", "__url")
    if sum(len(r.text) for r in rules) > TRIE_CHARS:
        return judge_by_join(base, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))
    verdict = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    @F.arrow_udf(verdict)
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found: dict = {}
        rule, verdicts = [], []
        for key in zip(hosts.to_pylist(), paths.to_pylist()):
            best = found[key] if key in found else found.setdefault(key, longest(trie.value, *key))
            rule.append(best.text if best else None)
            verdicts.append(best.verdict if best else default)
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdicts, pa.string())], ["rule", "verdict"])

    out = base.withColumn("__v", judged("host", "path"))
    return out.withColumn("rule", F.col("__v.rule")).withColumn("verdict", F.col("__v.verdict")).drop("__v")


def _named(url: F.Column) -> list[F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [host.alias("host"), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1).alias("path")]


def judge_by_join(df: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """The same verdicts for a rule list of any size: each host's suffixes are joined to the rules' hosts, and the best of a row is kept."""
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    pairs = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = pairs.withColumn("r_host", F.explode(suffix)).join(r, "r_host").where(F.expr("startswith(path, r_path)"))
    order = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), F.col("r_verdict") == "allow")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("__v"))
    out = df.join(best, ["host", "path"], "left")
    out = out.withColumn("rule", F.col("__v.rule")).withColumn("verdict", F.coalesce("__v.verdict", F.lit(default))).drop("__v")
    return out.select(*df.columns, "rule", "verdict")
