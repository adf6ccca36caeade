"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

Documents are sets of distinct five-word shingles (lower-cased A-Z); two are linked if 100 * |A & B| >= 75 * |A | B|. A document of
fewer words is its whole sequence; without words it has no set and no links. Null text counts as empty. Rows of one doc_id are one
document: whatever their texts, they share all their links and one component. Rows with a null doc_id belong to the component of their
set; they link nothing. Texts are taken whole, a long one by itself; ties go to the least doc_id. An empty table gives an empty result.
Only doc_id and text are read, so other columns may have any names; ``drop_near_copies`` returns them all.

Signatures: one permutation sigma scatters shingles over a universe of D places, a second one, pi, is read at place sigma(x) + k for
coordinate k (shifted circularly), and the least value over the set is coordinate k. Since sigma(x), sigma(x) + 1, ... are adjacent,
a shingle's values for all coordinates are one contiguous run of pi.

Work follows links, not pairs: equal sets form a class that is represented once; in each bucket of a band, members are compared with
the bucket's hub. Buckets that still hold several components are then settled by comparing all pairs of them, if they have FEW members; in
larger ones members are compared with another hub, drawn by hash, and those of buckets with several components even so are joined on their
rarest shingles, which finds every link that is left between components. So a large group of copies costs as many comparisons as it has
members, and no link between components of a bucket is missed. Buckets that hold more than a share of all rows are split by a salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeflow.llm import textkit as tk
from scopeflow.llm.graph import components
from scopeflow.llm.storage import bounded_batches, kept, scratch, unused, written

SHINGLE = 5
#: At a similarity of 0.75, a band of 5 agrees with chance 0.237; that none of 48 does, 2.3e-6.
BANDS, BAND_ROWS = 48, 5
UNIVERSE = 1 << 22
#: Rows of a bucket beyond which it is split, and the most buckets that are.
HOT, HOT_BUCKETS = 256, 100_000
FEW = 8  # members of a bucket up to which all of its pairs are compared
MARKS = 1 << 20  # hash values by which rows are sifted before they are shuffled
GATHER = 1024  # shingles that are looked up at a time
TOGETHER, TOGETHER_SHINGLES = 256, 1 << 17  # sets that are signed together, and the shingles in them beyond which no further one is
DENSE = 64  # sets of fewer shingles are signed one by one
BLOCK = 64  # places of the universe with one entry in an index of small values
EXPECTED = 5  # a coordinate's small values in a set, on average, at least
_PI: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SMALL: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def circulant_windows(width: int, seed: int = 20240229) -> np.ndarray:
    """Row s holds pi(s), pi(s + 1), ..., pi(s + width - 1), circularly: a view on one permutation of the universe."""
    if width not in _PI:
        pi = np.random.Generator(np.random.PCG64(seed)).permutation(UNIVERSE).astype(np.uint32)
        pi = np.concatenate([pi, pi[: width - 1]])
        _PI[width] = pi, np.lib.stride_tricks.sliding_window_view(pi, width)
    return _PI[width][1]


def _circular(width: int) -> np.ndarray:
    """pi, and its first values again: what the windows are a view on."""
    circulant_windows(width)
    return _PI[width][0]


def signature(sets: np.ndarray, width: int = BANDS * BAND_ROWS) -> np.ndarray:
    """The coordinates of one non-empty set of shingle hashes."""
    windows = circulant_windows(width)
    places = _places(sets)
    least = np.full(width, UNIVERSE, np.uint32)
    for at in range(0, len(places), GATHER):
        np.minimum(least, windows[places[at : at + GATHER]].min(axis=0), out=least)
    return least


def _places(sets: np.ndarray) -> np.ndarray:
    """sigma of shingle hashes."""
    return (tk.mix64(sets + np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)


def _small(width: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where pi is below UNIVERSE >> level, pi there, how many of them lie before each BLOCK)."""
    if (width, level) not in _SMALL:
        pi = _circular(width)
        at = np.flatnonzero(pi < UNIVERSE >> level)
        _SMALL[width, level] = at.astype(np.int32), pi[at], np.searchsorted(at, np.arange(0, len(pi) + BLOCK, BLOCK)).astype(np.int32)
    return _SMALL[width, level]


def signatures(sets: list[np.ndarray], width: int = BANDS * BAND_ROWS) -> np.ndarray:
    """``signature`` of each of the sets.

    The least of n values of pi is about UNIVERSE / n. So only places where pi is so small are looked at, by an index of them: a few for each coordinate,
    however many shingles there are. A coordinate that meets none of them is read in full.
    """
    out = np.empty((len(sets), width), np.uint32)
    sizes = np.array([len(x) for x in sets], np.int64)
    levels = np.log2(np.maximum(sizes, 1) / EXPECTED).astype(np.int64)
    for i in np.flatnonzero(sizes < DENSE).tolist():
        out[i] = signature(sets[i], width)
    for level in np.unique(levels[sizes >= DENSE]).tolist():
        which = np.flatnonzero((sizes >= DENSE) & (levels == level))
        at, value, before = _small(width, min(level, UNIVERSE.bit_length() - 1))
        places = _places(np.concatenate([sets[i] for i in which.tolist()]))
        ends = np.cumsum(sizes[which])
        # Whole blocks are taken, so coordinates from -BLOCK to width + BLOCK come out.
        span = width + 2 * BLOCK
        least = np.full((len(which), span), UNIVERSE, np.uint32)
        low = before[places // BLOCK]
        many = before[(places + (width - 1)) // BLOCK + 1] - low
        base = np.repeat(np.arange(len(which)) * span + BLOCK, sizes[which]) - places
        one = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        np.minimum.at(least.ravel(), np.repeat(base, many) + at[one], value[one])
        least = least[:, BLOCK : BLOCK + width]
        for i, k in zip(*(x.tolist() for x in np.nonzero(least == UNIVERSE))):
            least[i, k] = _circular(width)[places[ends[i] - sizes[which[i]] : ends[i]] + k].min()
        out[which] = least
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a signature, or of each of several; different bands apart."""
    rows = sig.reshape(*sig.shape[:-1], BANDS, BAND_ROWS).astype(np.uint64)
    h = tk.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(BAND_ROWS):
        h = tk.mix64(h + rows[..., j])
    return h


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of the batch."""
    for a, b, data, offsets in tk.slices(batch.column("text")):
        low = tk.lowered(data)
        words = tk.words_of(low, offsets)
        h, row, _ = tk.shingles(words, tk.range_hashes(low, words.start, words.end), size)
        first = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            own = np.sort(h[first[i] : first[i + 1]])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield a + i, own[new]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(documents: DataFrame, also: tuple[str, ...] = (), count: Callable[[], Callable[[pa.Array], np.ndarray]] | None = None) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, and its band keys; and the columns ``also`` as they are. ``count`` makes, on a worker, a function
    from texts to a number each, which is added as n_tokens, so that texts are read once."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = count() if count else None
        for batch in batches:
            n = batch.num_rows
            sizes, key1, key2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands, sets, rows, held, lengths = [np.zeros(0, np.uint64)], [], [], 0, np.zeros(n + 1, np.int32)
            for i, own in shingle_sets(batch):
                sizes[i] = len(own)
                if len(own):
                    sets.append(own)
                    rows.append(i)
                    held += len(own)
                if sets and (len(sets) == TOGETHER or held >= TOGETHER_SHINGLES or i + 1 == n):
                    flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
                    key1[rows] = np.add.reduceat(tk.mix64(flat), first)
                    key2[rows] = np.add.reduceat(tk.mix64(flat ^ np.uint64(0x94D049BB133111EB)), first)
                    bands.append(band_keys(signatures(sets)).ravel())
                    lengths[np.array(rows) + 1] = BANDS
                    sets, rows, held = [], [], 0
            cells = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(_signed(np.concatenate(bands))))
            more = {"n_tokens": pa.array(counted(batch.column("text")))} if counted else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(_signed(key1)), pa.array(_signed(key2)), cells, *more.values(), *(batch.column(c) for c in also)], ["doc_id", "n_shingles", "key1", "key2", "bands", *more, *also])

    schema = ", ".join(["doc_id long, n_shingles long, key1 long, key2 long, bands array<long>", *(["n_tokens long"] if count else []), *(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in also)])
    bounded_batches(documents.sparkSession)
    return documents.select("doc_id", "text", *(c for c in also if c != "text")).mapInArrow(tk.tidied(sketch), schema)


def full_sets(documents: DataFrame) -> DataFrame:
    """doc_id, the whole set of shingle hashes, and a key of it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            rows, cells, size = [], [], 0
            for i, own in shingle_sets(batch):
                rows.append(i)
                cells.append(own)
                size += len(own)
                if size > 1 << 18:
                    yield _set_batch(ids, rows, cells)
                    rows, cells, size = [], [], 0
            if rows:
                yield _set_batch(ids, rows, cells)

    return documents.select("doc_id", "text").mapInArrow(tk.tidied(sets), "doc_id long, own array<long>, key long")


def _set_batch(ids: pa.Array, rows: list[int], cells: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(np.concatenate(cells))))
    keys = np.array([tk.mix64(c).sum(dtype=np.uint64) for c in cells], np.uint64)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), lists, pa.array(_signed(keys))], ["doc_id", "own", "key"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("own").alias("own_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("own_a", "own_b")))
    return both.where("100 * common >= 75 * (size(own_a) + size(own_b) - common)").select("a", "b")


def _sized(pairs: DataFrame) -> DataFrame:
    """Sets of a similarity of 0.75 differ in size by no more than that."""
    return pairs.where("a <> b and 100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(members: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): pairs of a bucket's members of different components."""
    one = members.select("bucket", F.col("rep").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"))
    two = members.select("bucket", F.col("rep").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"))
    return one.join(two, "bucket").where("a < b and c_a <> c_b").select("a", "b", "n_a", "n_b")


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): pairs of members of different components that may be linked, without bounds on either side.

    Shingles are put in one order: those that only one component has, then the rarest. A link takes |A & B| >= 3 / 7 * (|A| + |B|), so at the first
    shingle in common, both sides must still have as many before them; that shingle is among the first |A| / 7 + 1 of the smaller set and the first
    |B| / 4 + 1 of the larger. What only one component has is never in common, and a member with too little besides is left out at
    once. Members that share a template of less than 6 / 7 of each, however many, meet on nothing. No link is lost.
    """
    ids = members.select(F.col("rep").alias("doc_id"), "component").distinct()
    rows = sets.join(ids, "doc_id").select("doc_id", "key", "component", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    seen = rows.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    # What only one component has stands before the others, but only its number is needed.
    seen = seen.where("low <> high").select("shingle", F.col("m").alias("weight"))
    own = rows.join(seen, "shingle").groupBy("doc_id", "key", "component", "n").agg(F.sort_array(F.collect_list(F.struct("weight", "shingle"))).alias("own"))
    own = own.where(4 * F.size("own") >= 3 * F.col("n")).withColumn("alone", F.col("n") - F.size("own"))
    first = F.posexplode(F.slice("own", F.lit(1), F.floor(F.col("n") / 4).cast("int") + 1 - F.col("alone"))).alias("place", "x")
    first = own.select("doc_id", "component", "n", "alone", first).withColumn("pos", F.col("alone") + F.col("place"))
    first = written(first.select("doc_id", "component", "n", "pos", F.col("x.shingle").alias("shingle")), "prefix")
    one = first.where("7 * pos <= n").select("shingle", F.col("doc_id").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"), (F.col("n") - F.col("pos")).alias("left_a"))
    two = first.select("shingle", F.col("doc_id").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"), (F.col("n") - F.col("pos")).alias("left_b"))
    return one.join(two, "shingle").where("c_a <> c_b and n_a <= n_b and 7 * least(left_a, left_b) >= 3 * (n_a + n_b)").select("a", "b", "n_a", "n_b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id)."""
    with scratch(documents.sparkSession):
        out = with_components(written(sketches(documents), "sketches"), documents).select("doc_id", "n_shingles", "component_id")
        return kept(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near_duplicates")


def _split(rows: DataFrame, n_rows: int) -> DataFrame:
    """(bucket, salt, rep, n, hub, salts) of the ``rows`` (bucket, rep, n) in buckets of several: the hub is the bucket's least.

    Buckets of more than HOT rows, and of more than their share of all, are dealt out by a salt; of those there are at most HOT_BUCKETS, which is
    what is broadcast.
    """
    hot_at = max(HOT, n_rows // HOT_BUCKETS)
    buckets = rows.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    buckets = written(buckets.select("bucket", "hub", F.ceil(F.col("m") / hot_at).cast("int").alias("salts")), "buckets")
    hot = F.broadcast(buckets.where("salts > 1").select("bucket", F.col("salts").alias("many")))
    salt = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("many")), F.lit(0)).cast("int")
    dealt = rows.join(hot, "bucket", "left").select("bucket", salt.alias("salt"), "rep", "n")
    return dealt.join(_for_salts(buckets), ["bucket", "salt"])


def _for_salts(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _of_one_document(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids of several rows, links between the classes of texts that share an id)."""
    key = F.struct("key1", "key2", "n_shingles")
    key = F.when(F.col("n_shingles") > 0, key)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m"), F.min(key).alias("low"), F.max(key).alias("high"))
    ids = written(ids.where("m > 1"), "repeated")
    several = docs.where("n_shingles > 0").join(ids.where("low <> high").select("doc_id"), "doc_id", "left_semi").select("doc_id", "key1", "key2", "n_shingles").distinct()
    several = several.join(classes.select("key1", "key2", "n_shingles", "rep"), ["key1", "key2", "n_shingles"])
    return ids.select("doc_id"), several.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct()


def _of_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` that have (left_semi) or lack (left_anti) one of ``ids`` under ``key``. Only rows whose hash modulo MARKS some id has are shuffled: the marks
    are broadcast, of which there are MARKS at most."""
    name, mark = unused(rows.columns, "mark"), F.pmod(F.xxhash64(key), F.lit(MARKS))
    marks = F.broadcast(ids.select(mark.alias(name)).distinct())
    maybe = rows.join(marks, mark == F.col(name), "left_semi").join(ids, key, how)
    return maybe if how == "left_semi" else rows.join(marks, mark == F.col(name), "left_anti").unionByName(maybe)


def with_components(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """The (written) sketches of ``documents`` with component_id instead of the bands."""
    classes = docs.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = written(classes.where("rep is not null"), "classes")
    repeated, same = _of_one_document(docs, classes)

    rows = classes.select(F.explode("bands").alias("bucket"), "rep", F.col("n_shingles").alias("n"))
    members = written(_split(rows, BANDS * classes.count()), "members")
    texts = _of_ids(documents.select("doc_id", "text"), members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if repeated.isEmpty():
        sets = full_sets(texts)
    else:  # a node that has several texts has several sets, each once
        again = full_sets(texts.join(repeated, "doc_id", "left_semi"))
        sets = full_sets(texts.join(repeated, "doc_id", "left_anti")).unionAll(again.dropDuplicates(["doc_id", "key"]))
    sets = written(sets, "sets")

    first = written(_sized(members.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"))), "pairs")
    links = written(_linked(first, sets).unionAll(same), "links")
    found = components(links)

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with theirs and another hub, drawn by hash."""
        own = members.select("bucket", "salt", "salts", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        own = written(own, "labelled")
        hubs = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("salts").alias("salts"), F.count("*").alias("m"), F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep", "n", "component")).alias("hub"))
        return own.drop("salts").join(_for_salts(hubs.where("low <> high")).select("bucket", "salt", "hub", "m"), ["bucket", "salt"])

    now = written(mixed(found), "mixed")
    second = now.where(F.col("m") > FEW).where("component <> hub.component").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"))
    second = second.unionAll(_within(now.where(F.col("m").between(3, FEW))))  # of two, one is the first hub
    second = written(_sized(second).join(first, ["a", "b"], "left_anti"), "pairs")
    more = written(_linked(second, sets), "links")
    links = links.unionAll(more)
    if not more.isEmpty():
        found = components(links)
        now = written(mixed(found), "mixed")
    rest = written(_sized(_rest(now.where(F.col("m") > FEW), sets)).join(first.unionAll(second), ["a", "b"], "left_anti"), "pairs")
    more = written(_linked(rest, sets), "links")
    if not more.isEmpty():
        found = components(links.unionAll(more))

    labels = found.withColumnRenamed("node", "rep")
    classes = classes.select("key1", "key2", "n_shingles", "rep").join(labels, "rep", "left").select("key1", "key2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = docs.drop("bands").join(classes, ["key1", "key2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
    if repeated.isEmpty():
        return out
    least = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
    return out.join(least, "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each component of near copies, with the columns of ``documents``: of least doc_id (null last), ties by a hash of the row.

    Rows, not ids, are linked here, so repeated rows, rows without an id and two texts of one id are all told apart; rows are numbered in a written
    table. Rows without words all stay.
    """
    spark, row = documents.sparkSession, unused(documents.columns, "row")
    rows = written(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    hashed = [c for c, kind in documents.dtypes if "map<" not in kind]
    with scratch(spark):
        ids = rows.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").alias("own_id"), F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias("tie"))
        found = with_components(written(sketches(ids, ("own_id", "tie")), "sketches"), ids)
        first = F.min(F.struct(F.col("own_id").isNull().alias("absent"), "own_id", "tie", F.col("doc_id").alias("row")))
        found = written(found.select("doc_id", "component_id", "own_id", "tie"), "found")
        stay = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("doc_id"))
        gone = kept(found.select("doc_id").join(stay, "doc_id", "left_anti").select(F.col("doc_id").alias(row)), "gone")
    return _of_ids(rows, gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
