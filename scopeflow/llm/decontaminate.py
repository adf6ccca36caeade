"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact weighted similarity.

Words are lower-cased A-Z. An item of m >= 5 words has m - 4 five-word shingles; a document's windows of as many consecutive
shingles (its only window is the whole document where that is shorter) are compared with it. Fingerprints have 128 bits. The index keeps
them as BLOCKS columns of 32 bits: if two differ in at most RADIUS bits, in some column they differ in no more than its share (``LIMITS``,
which with one added to each sum to RADIUS + 1), so every item within the radius is found, while of unrelated pairs 2 % agree so well.
Candidates are then verified by the multiset Jaccard similarity of their shingles, at least 0.75; at just that similarity, fingerprints differ
in 22 bits on average. Only windows that hold some shingle of an item of their size are fingerprinted; all others have similarity 0.

A benchmark of up to INDEX_SHINGLES shingles is broadcast as one index (of at most 40 bytes a shingle) and the documents are scanned
once; nothing is shuffled. A larger one is joined: documents and items that share one of the item's rarest shingles, of which one must be in
common, become pairs, and each pair is judged by the same index of one item.

Items of fewer than five words, null or empty ones have no shingles and match nothing; null documents count as empty. Ties go to the
least item_id. Repeated rows are judged alike; repeated items count once. Long texts are judged whole, STRIDE windows at a time. An empty table on either side
gives a defined result (nothing, or all documents kept). Only the id and text columns are read; ``drop_contaminated`` returns all columns,
whatever their names, and ``mark_contamination`` refuses a table that has one of the names that it adds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeflow.llm import textkit as tk
from scopeflow.llm.storage import bounded_batches, unused, written

SHINGLE, THRESHOLD = 5, 0.75
BITS, BLOCKS, RADIUS = 128, 4, 36
#: Bits in which a column may differ: one of them must, for two fingerprints within the radius.
LIMITS = np.array([(RADIUS + 1 + k) // BLOCKS - 1 for k in range(BLOCKS)], np.uint8)
#: Shingles of all items that are broadcast; more are joined.
INDEX_SHINGLES = 1 << 20
#: Windows that are fingerprinted at a time, and items that they are compared with at a time.
STRIDE, WIDTH = 4096, 1024


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of each shingle."""
    two = np.stack([tk.mix64(hashes + np.uint64(1)), tk.mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93))], 1)
    return np.unpackbits(two.view(np.uint8).reshape(len(hashes), 16), axis=1).astype(np.int8) * 2 - 1


def fingerprint_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash (16 bytes) of every window of ``size`` shingles, or of the whole where there are fewer."""
    sums = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(_signs(hashes), axis=0, dtype=np.int32, out=sums[1:])
    size = min(size, len(hashes))
    return np.packbits(sums[size:] - sums[:-size or None][: len(sums) - size] > 0, axis=1)


def shingle_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the consecutive five-word shingles of each text, none for fewer words."""
    out = []
    for a, b, data, offsets in tk.slices(pa.array(texts, pa.large_string())):
        h, row, counts = _batch(data, offsets)
        first = np.searchsorted(row, np.arange(b - a + 1))
        out += [h[i:j] if n >= SHINGLE else h[:0] for i, j, n in zip(first[:-1], first[1:], counts)]
    return out


def _batch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = tk.lowered(data)
    words = tk.words_of(low, offsets)
    h, row, _ = tk.shingles(words, tk.range_hashes(low, words.start, words.end), SHINGLE)
    return h, row, np.diff(words.first)


@dataclass
class Sized:
    """Items of one number of shingles: their fingerprints as columns of 32 bits, and their shingles."""

    ids: np.ndarray
    prints: np.ndarray
    shingles: np.ndarray  # a row for each item

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all pairs within RADIUS, by blocks of items, then window, then item."""
        windows = prints.view(np.uint32)
        for at in range(0, len(self.ids), WIDTH):
            own = self.prints[at : at + WIDTH].view(np.uint32)
            hit = np.zeros((len(windows), len(own)), bool)
            for block in range(BLOCKS):
                hit |= np.bitwise_count(windows[:, block, None] ^ own[None, :, block]) <= LIMITS[block]
            w, k = np.nonzero(hit)
            close = np.bitwise_count(windows[w] ^ own[k]).sum(1, dtype=np.int64) <= RADIUS
            yield from zip(w[close].tolist(), (k[close] + at).tolist())

    @cached_property
    def counts(self) -> dict[int, Counter]:
        return {}

    def count(self, k: int) -> Counter:
        if k not in self.counts:
            self.counts[k] = Counter(self.shingles[k].tolist())
        return self.counts[k]


@dataclass
class Index:
    shingles: np.ndarray  # all items' shingles, sorted
    sizes: np.ndarray  # the sizes of the items that hold each, one after another
    first: np.ndarray  # where those of each shingle begin
    by_size: dict[int, Sized]

    @classmethod
    def build(cls, items: list[tuple[int, str | None]]) -> Index:
        groups: dict[int, list] = {}
        for (item, _), h in zip(items, shingle_hashes([t for _, t in items])):
            if len(h):
                groups.setdefault(len(h), []).append((item, h))
        by_size = {n: Sized(np.array([i for i, _ in g], np.int64), np.concatenate([fingerprint_windows(h, n) for _, h in g]), np.stack([h for _, h in g])) for n, g in groups.items()}
        held = [np.zeros((2, 0), np.uint64)]
        for n, group in by_size.items():
            own = np.unique(group.shingles)
            held.append(np.stack([own, np.full(len(own), n, np.uint64)]))
        pairs = np.concatenate(held, axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        own, first = np.unique(pairs[0], return_index=True)
        return cls(own, pairs[1].astype(np.int64), np.append(first, pairs.shape[1]), by_size)

    @cached_property
    def bloom(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(self.shingles & np.uint64(len(out) - 1)).astype(np.int64)] = True
        return out

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``h`` shingles of items are, and which."""
        at = np.flatnonzero(self.bloom[(h & np.uint64(self.bloom.size - 1)).astype(np.int64)])
        if not len(at) or not len(self.shingles):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.shingles, h[at]), len(self.shingles) - 1)
        same = self.shingles[k] == h[at]
        return at[same], k[same]

    def matches(self, h: np.ndarray, at: np.ndarray, which: np.ndarray) -> dict[int, float]:
        """The best similarity with each item that some window of the document (shingles ``h``) is similar enough to."""
        places: dict[int, list[int]] = {}
        for p, k in zip(at.tolist(), which.tolist()):
            for size in self.sizes[self.first[k] : self.first[k + 1]].tolist():
                places.setdefault(size, []).append(p)
        found: dict[int, float] = {}
        for size, own in places.items():
            group, last = self.by_size[size], max(0, len(h) - size)
            starts = np.zeros(last + 2, np.int64)
            own_at = np.array(own)
            np.add.at(starts, np.minimum(np.maximum(own_at - size + 1, 0), last), 1)
            np.add.at(starts, np.minimum(own_at, last) + 1, -1)
            wanted = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
            for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1):
                for a in range(int(run[0]), int(run[-1]) + 1, STRIDE):
                    b = min(a + STRIDE, int(run[-1]) + 1)
                    prints = fingerprint_windows(h[a : b - 1 + size], size)
                    for w, k in group.candidates(prints):
                        value = _similarity(Counter(h[a + w : a + w + size].tolist()), group.count(k))
                        item = int(group.ids[k])
                        if value >= THRESHOLD and value > found.get(item, 0):
                            found[item] = value
        return found


def _similarity(a: Counter, b: Counter) -> float:
    least = (a & b).total()
    return least / (a.total() + b.total() - least)


def _found(index: Index, batch: pa.RecordBatch) -> Iterator[tuple[int, dict[int, float]]]:
    """(row, its matches) of the rows that have any."""
    for a, b, data, offsets in tk.slices(batch.column("text")):
        h, row, counts = _batch(data, offsets)
        at, which = index.places(h)
        if not len(at):
            continue
        first = np.searchsorted(row, np.arange(b - a + 1))
        cuts = np.searchsorted(at, first)
        for i in np.flatnonzero((np.diff(cuts) > 0) & (counts >= SHINGLE)).tolist():
            part = slice(cuts[i], cuts[i + 1])
            found = index.matches(h[first[i] : first[i + 1]], at[part] - first[i], which[part])
            if found:
                yield a + i, found


# ---- a benchmark of any size ----------------------------------------------------------------------------------------------------


def _prefixes(items: DataFrame) -> DataFrame:
    """(shingle, item_id): of each item its rarest shingles among items, as many (counted as often as they stand) as a quarter of it and one more.

    A similarity of 0.75 leaves out at most a quarter of the item, so one of these is in the document.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, h in zip(batch.column("item_id").to_pylist(), shingle_hashes(batch.column("text").to_pylist())):
                own, times = np.unique(h, return_counts=True)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([len(h)] * n, pa.int64()), pa.array(own.view(np.int64)), pa.array(times, pa.int64())], ["item_id", "n", "shingle", "times"])

    rows = items.mapInArrow(tk.tidied(spread), "item_id long, n long, shingle long, times long")
    rows = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("m")), "shingle")
    # An item is one row of the benchmark, so its shingles fit a task.
    own = rows.groupBy("item_id", "n").agg(F.sort_array(F.collect_list(F.struct("m", "shingle", "times"))).alias("own"))
    before = F.aggregate(F.slice("own", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda sum, x: sum + x["times"])
    return own.select("item_id", "n", "own", F.posexplode("own").alias("pos", "x")).where(4 * before <= F.col("n")).select("x.shingle", "item_id")


def _by_join(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n_items, item_id, similarity) of the texts that hold an item, by a 128-bit key of the text."""
    named = documents.mapInArrow(tk.tidied(_with_key), "key binary, text string")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h in zip(batch.column("key").to_pylist(), shingle_hashes(batch.column("text").to_pylist())):
                own = np.unique(h)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.binary()), pa.array(own.view(np.int64))], ["key", "shingle"])

    prefixes = written(_prefixes(items), "prefixes")
    pairs = written(named.mapInArrow(tk.tidied(spread), "key binary, shingle long").join(prefixes, "shingle").select("key", "item_id").distinct(), "pairs")
    texts = named.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = pairs.join(texts, "key").join(items.withColumnRenamed("text", "item"), "item_id")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (item, text) in enumerate(zip(batch.column("item_id").to_pylist(), batch.column("item").to_pylist())):
                rows += [(batch.column("key")[i].as_py(), *found) for _, own in _found(Index.build([(item, text)]), batch.slice(i, 1)) for found in own.items()]
            key, item, value = list(zip(*rows)) or ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(item, pa.int64()), pa.array(value, pa.float64())], ["key", "item_id", "similarity"])

    found = both.mapInArrow(tk.tidied(judged), "key binary, item_id long, similarity double").groupBy("key", "item_id").agg(F.max("similarity").alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "item_id")).alias("best")
    return found.groupBy("key").agg(F.count("*").alias("n_items"), best).select("key", "n_items", F.col("best.item_id").alias("item_id"), (-F.col("best.far")).alias("similarity"))


def _keys(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([blake2b((t or "").encode(), digest_size=16).digest() for t in batch.column("text").to_pylist()], pa.binary())


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_keys(batch), batch.column("text")], ["key", "text"])


STATE = ("n_items", "item_id", "similarity")


def _marked(documents: DataFrame, benchmark: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """All rows and columns, and for each row how many items it contains, the most similar one and that similarity (else 0, null, 0)."""
    bounded_batches(documents.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    spark = documents.sparkSession

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in shingle_hashes(batch.column("text").to_pylist())], pa.int64())], ["n"])

    total = items.select("text").mapInArrow(tk.tidied(sizes), "n long").agg(F.sum("n")).first()[0] or 0
    if total > INDEX_SHINGLES:
        key = unused(documents.columns, "key")
        schema = documents.select("*", F.lit(b"").alias(key)).schema

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, _keys(batch)], [*batch.schema.names, key])

        found = written(_by_join(documents.select("text"), items), "contaminated").toDF(key, *names)
        out = documents.mapInArrow(tk.tidied(keyed), schema).join(found, key, "left").drop(key)
        return out.withColumns({names[0]: F.coalesce(names[0], F.lit(0).cast("long")), names[2]: F.coalesce(names[2], F.lit(0.0))})
    index = spark.sparkContext.broadcast(Index.build(sorted((r.item_id, r.text) for r in items.collect())))
    schema = documents.select("*", F.lit(0).cast("long").alias(names[0]), F.lit(None).cast("long").alias(names[1]), F.lit(0.0).alias(names[2])).schema

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, item, similarity = [0] * batch.num_rows, [None] * batch.num_rows, [0.0] * batch.num_rows
            for i, found in _found(index.value, batch):
                best = min(found, key=lambda k: (-found[k], k))
                n[i], item[i], similarity[i] = len(found), best, found[best]
            state = (pa.array(n, pa.int64()), pa.array(item, pa.int64()), pa.array(similarity, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *state], names=[*batch.schema.names, *names])

    return documents.mapInArrow(tk.tidied(mark), schema)


def mark_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows and columns with n_items, item_id and similarity, which may not be among the columns."""
    clash = {c.lower() for c in documents.columns} & set(STATE)
    if clash:
        raise ValueError(f"documents have columns {sorted(clash)} already")
    return _marked(documents, benchmark, STATE)


def judge_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_items, item_id, similarity, kept (contains no item)."""
    rows = _marked(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, STATE)
    return rows.select("doc_id", *STATE, (F.col("n_items") == 0).alias("kept"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that contain no item, with all their columns."""
    names = tuple(unused(documents.columns, f"contamination_{c}") for c in STATE)
    return _marked(documents, benchmark, names).where(F.col(names[0]) == 0).select(*[F.col(f"`{c}`") for c in documents.columns])
