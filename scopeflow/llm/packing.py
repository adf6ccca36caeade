"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` tokens: full pieces, and a rest. Pieces go, longest first, into bins of that
capacity; a bin holds no two pieces of one source or of one duplicate cluster: the component of near copies that op3 finds (links of a
Jaccard similarity of 0.75 on five-word shingles, and chains of them), and for texts without words that of equal texts. Bins are ordered by their residual room and carry two
bitmaps, of their sources and of their clusters. For each piece the search starts at the least residual that has room and goes on to the
next one until a bin without conflict is found: the tightest compatible bin. Otherwise a new bin is opened.

Packing is done in shards of about SHARD_PIECES pieces, to which pieces are dealt by a hash of document, place and, for rows that are
repeated, chunk of CHUNK of them: so a source, a cluster or a row with a third of all rows spreads over all shards. Only ids and lengths are shuffled,
never text. Results don't depend on how the input is partitioned. Empty documents (and null texts) have no tokens and get no bin: one row with
a null bin. Null sources and null clusters conflict with nothing. Repeated rows are packed as often as they come. Ties of length go by doc_id,
piece, source and cluster; very long texts become many pieces; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeflow.llm import neardup
from scopeflow.llm.storage import kept, scratch, written
from scopeflow.llm.tokens import encoder_of

SHARD_PIECES = 4096
CHUNK = 64  # equal rows that go to one shard together


class Bins:
    """Open bins of one shard by residual. A set bit of ``levels`` says that some bin has that residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = 0
        self.at: dict[int, list[int]] = {}  # residual -> bins, in the order in which they came there
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []
        #: For each residual, bits that all of its bins have: a level whose bins all conflict is passed over at once.
        self.all_sources: dict[int, int] = {}
        self.all_clusters: dict[int, int] = {}

    def _put(self, residual: int, b: int) -> None:
        row = self.at.setdefault(residual, [])
        self.all_sources[residual] = self.all_sources[residual] & self.sources[b] if row else self.sources[b]
        self.all_clusters[residual] = self.all_clusters[residual] & self.clusters[b] if row else self.clusters[b]
        row.append(b)
        self.levels |= 1 << residual

    def _take(self, residual: int, place: int) -> int:
        row = self.at[residual]
        b = row.pop(place)
        if not row:
            self.levels &= ~(1 << residual)
        return b

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; ``source`` and ``cluster`` are bitmaps of one bit or none."""
        ahead = self.levels >> length
        residual = length
        found = -1
        while ahead and found < 0:
            step = (ahead & -ahead).bit_length() - 1
            residual += step
            ahead >>= step
            if not (self.all_sources[residual] & source or self.all_clusters[residual] & cluster):
                for place, b in enumerate(self.at[residual]):
                    if not (self.sources[b] & source or self.clusters[b] & cluster):
                        found = self._take(residual, place)
                        break
            ahead >>= 1
            residual += found < 0
        if found < 0:
            found, residual = len(self.used), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        offset = self.used[found]
        self.used[found] += length
        self.sources[found] |= source
        self.clusters[found] |= cluster
        self._put(residual - length, found)
        return found, offset


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), in the given order."""
    bins, bits = Bins(capacity), {}

    def bit(kind: str, value: object) -> int:
        return 0 if value is None else 1 << bits.setdefault(kind, {}).setdefault(value, len(bits[kind]) if kind in bits else 0)

    return [bins.place(length, bit("s", source), bit("c", cluster)) for length, source, cluster in pieces]


def clustered_lengths(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, source, cluster, n_tokens of each row.

    Near copies are found by doc_id; rows without one go by a hash of their text there, above all usual ids. Equal texts are the same cluster
    whatever their ids are.
    """
    rows = documents.select("doc_id", "text", "source")
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = rows.select(F.col("doc_id").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), "text", "source")
    named = named.withColumn("copy", F.when(F.coalesce("text", F.lit("")) != "", F.md5("text")))
    with scratch(documents.sparkSession):
        docs = written(neardup.sketches(named, ("own_id", "source", "copy"), lambda: encoder_of(path).count), "sketches")
        cluster = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.col("copy"))
        return kept(neardup.with_components(docs, named).select(F.col("own_id").alias("doc_id"), "source", cluster.alias("cluster"), "n_tokens"), "lengths")


def pack_documents(lengths: DataFrame, n_rows: int, capacity: int = 2048, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster") -> DataFrame:
    """One row per piece: doc_id, piece, start (in the document's tokens), length, bin_id, bin_start.

    ``n_rows`` (the number of documents, or an estimate) sets the number of shards only.
    """
    n_shards = max(1, round(n_rows / SHARD_PIECES))
    rows = lengths.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"), F.col(length_col).cast("long").alias("n"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n") - 1) / capacity).cast("int")))))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")))
    # Equal rows are counted first and sent on in chunks, each to a shard of its own.
    equal = pieces.groupBy("doc_id", "source", "cluster", "piece", "start", "length").agg(F.count("*").alias("m"))
    equal = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK))))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "length", "piece", "chunk"), F.lit(n_shards)).cast("int")
    times = F.least(F.lit(CHUNK), F.col("m") - CHUNK * F.col("chunk")).cast("int")
    pieces = equal.select(shard.alias("shard"), "doc_id", "source", "cluster", "piece", "start", "length", times.alias("times"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table["times"].to_numpy())))
        n = table.num_rows - int(np.count_nonzero(table["length"].to_numpy() == 0))  # empty ones come last and get no bin
        placed = pack(list(zip(*(table[c].slice(0, n).to_pylist() for c in ("length", "source", "cluster")))), capacity)
        first = table["shard"][0].as_py() << 32
        bins = [pa.array([first + b for b, _ in placed] + [None] * (table.num_rows - n), pa.int64()), pa.array([at for _, at in placed] + [None] * (table.num_rows - n), pa.int64())]
        return pa.table([*(table[c] for c in ("doc_id", "piece", "start", "length")), *bins], names=["doc_id", "piece", "start", "length", "bin_id", "bin_start"])

    id_type = lengths.schema[id_col].dataType.simpleString()
    return pieces.groupBy("shard").applyInArrow(packed, f"doc_id {id_type}, piece int, start long, length long, bin_id long, bin_start long")
