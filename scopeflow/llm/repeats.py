"""Suffix-array dedup of repeated byte strings.

Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id is removed; strings overlap, never
cross documents, and are judged on the input. Texts are UTF-8 bytes; null counts as empty. Rows of one doc_id are one document here:
none is smaller than the other, so both stay. A null doc_id is neither smaller nor greater: nothing is removed there, and nothing
because of it. An empty table gives no rows.

How it runs. Windows (strings of LENGTH bytes) that share their minimizer, the least of their GRAM-byte grams by hash, make a segment;
equal windows have equal minimizers, so all copies of a window meet at its minimizer. (1) Documents are packed into blocks, written once,
bucketed by block so that later passes join small things to them without moving text. (2) Each block sends hashes of its minimizers to
buckets, as many as the text asks for; those seen in two documents are hot, and their places go back as bitmaps. (3) Each block sends its hot
segments, equal ones once, with the least doc_id; a bucket is judged at once. Segments of minimizers that are in OFTEN blocks or more have
buckets of their own and are merged first: those of a bucket and a group of blocks (about the square root of all blocks), then what is
left of a bucket; so a string that is in every block meets in no task more often than that.
Segments are equal if their bytes are. Where different segments share a minimizer, their windows are sorted as suffixes of the bucket's text
(``suffixes``: one suffix bucket at a time, long ties by difference-cover ranks) and each class of equal windows yields its least doc_id. (4)
Verdicts per window go back to the groups and the blocks, which cut their texts. A task holds one bucket at a time.

A group of copies, however large, sends each of its segments once per block. Long texts are blocks of their own. Only doc_id and text are read,
so other columns may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeflow.llm import textkit as tk
from scopeflow.llm.storage import bounded_batches, kept, parallelism, remove, scratch, shared_dir, written
from scopeflow.llm.suffixes import sort_suffixes

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # grams of a window, and so the most windows of a segment: fits a 32-bit mask
BLOCK_BYTES = 3 << 20
SORT_BYTES = 1 << 20  # text that is sorted at a time
BUCKET_BYTES = 32 << 20  # input text to a bucket
OFTEN = 64  # blocks from which on a minimizer is merged in two steps
MOST_FILES = 20_000  # buckets of the table of blocks: Spark allows 100,000
_BASE = 0xC2B2AE3D27D4EB4F
_LOW = np.uint64(0xFFFFFFFF)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: 16 and 4 by doubling."""
    h = data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    size, four = 1, None
    while size < 16:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
        four = h if size == 4 else four
    return tk.mix64(h[: len(data) - GRAM + 1] * np.uint64(pow(_BASE, 4, 1 << 64)) + four[16 : 16 + len(data) - GRAM + 1])


@dataclass
class Segments:
    """Maximal runs of windows of one document with the same minimizer place."""

    row: np.ndarray  # of the document in its block
    start: np.ndarray  # of the first window
    count: np.ndarray  # of windows
    gram: np.ndarray  # hash of the minimizer
    offset: np.ndarray  # of the minimizer from start


def segments_of(data: np.ndarray, offsets: np.ndarray, usable: np.ndarray) -> Segments:
    """Of the rows that are ``usable``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Segments(none, none, none, np.zeros(0, np.uint64), none)
    grams = _gram_hashes(data)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        key = np.minimum(key[:-step], key[step:])
    place = (np.minimum(key[: len(data) - LENGTH + 1], key[SPAN - 16 :][: len(data) - LENGTH + 1]) & _LOW).astype(np.int64)
    del key
    sizes = np.diff(offsets)
    fits = np.zeros(len(place) + 1, np.int32)
    rows = np.flatnonzero((sizes >= LENGTH) & usable)
    np.add.at(fits, offsets[rows], 1)
    np.add.at(fits, offsets[rows + 1] - LENGTH + 1, -1)
    inside = np.cumsum(fits[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    # No window starts in the last LENGTH - 1 bytes of a document, so runs of different documents never touch.
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(inside & np.r_[~inside[1:] | begins[1:], True]) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Segments(row, start, stops - start, grams[place[start]], place[start] - start)


def _blocks(documents: DataFrame) -> DataFrame:
    """(block, ids, null_ids, ends, data): documents of about BLOCK_BYTES together, one at least."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[bytes] = []
        ends: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
            nulls = np.array([i is None for i in ids], np.uint8).tobytes()
            cells = [own, nulls, np.array(ends, "<i8").tobytes(), b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], ["block", "ids", "null_ids", "ends", "data"])

        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column("text")):
                own = batch.column("doc_id").slice(a, b - a).to_pylist()
                for i, doc_id in enumerate(own):
                    ids.append(doc_id)
                    parts.append(data[offsets[i] : offsets[i + 1]].tobytes())
                    size += len(parts[-1])
                    ends.append(size)
                    if size >= BLOCK_BYTES:
                        yield flush()
                        ids, parts, ends, size, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.tidied(packed), "block long, ids binary, null_ids binary, ends binary, data binary")


@dataclass
class Block:
    ids: np.ndarray
    null: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    segments: Segments

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        null = cell("null_ids", np.uint8).astype(bool)
        offsets = np.concatenate([[0], cell("ends", "<i8")]).astype(np.int64)
        data = cell("data", np.uint8)
        return cls(cell("ids", "<i8").astype(np.int64), null, offsets, data, segments_of(data, offsets, ~null))

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers by bucket, then hash; whether each is in several documents; and each segment's place among them."""
        s = self.segments
        order = np.lexsort((self.ids[s.row], s.gram, s.gram % np.uint64(buckets)))
        gram, doc = s.gram[order], self.ids[s.row[order]]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        which = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), bool)
        several[which[1:][~new[1:] & (doc[1:] != doc[:-1])]] = True
        place = np.empty(len(gram), np.int64)
        place[order] = which
        return gram[new], several, place


def _cut(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among values sorted by bucket."""
    return np.searchsorted(values % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))


def _send_grams(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gram, several, _ = Block.read(batch, i).grams(buckets)
                # 39 bits of the hash besides those that chose the bucket, and one for several documents: 5 bytes each
                short = (((gram // np.uint64(buckets)) & np.uint64((1 << 39) - 1)) << np.uint64(1)) | several
                cells = short.view(np.uint8).reshape(-1, 8)[:, :5]
                cuts = _cut(gram, buckets)
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(full), pa.int64()), pa.array([cells[cuts[b] : cuts[b + 1]].tobytes() for b in full.tolist()], pa.binary())],
                    ["bucket", "block", "grams"],
                )

    return send


def _gathered(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("bucket",)) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each bucket of a partition that is sorted by it, one bucket at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            key = tuple(int(c[a]) for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _find_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and bucket, bits for each minimizer that it sent: seen in several documents or blocks, and in OFTEN blocks."""
    for (bucket,), rows in _gathered(batches):
        cells = [np.frombuffer(c, np.uint8).reshape(-1, 5) for c in rows["grams"].to_pylist()]
        wide = np.zeros((sum(map(len, cells)), 8), np.uint8)
        wide[:, :5] = np.concatenate(cells)
        value = wide.view("<u8").ravel()
        gram = value >> np.uint64(1)
        _, which, times = np.unique(gram, return_inverse=True, return_counts=True)
        times = times[which]
        hot = (value & np.uint64(1)).astype(bool) | (times > 1)
        at = np.cumsum([0, *map(len, cells)])
        bits, often = ([np.packbits(flag[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])] for flag in (hot, times >= OFTEN))
        yield pa.RecordBatch.from_arrays([rows["block"].combine_chunks(), pa.array([bucket] * len(bits), pa.int32()), pa.array(bits, pa.binary()), pa.array(often, pa.binary())], ["block", "bucket", "bits", "often"])


@dataclass
class Hot:
    """The hot segments of a block; equal ones have one representative, of the least doc_id, and representatives are sorted by bucket: those of
    frequent minimizers come in a second row of buckets after all others."""

    which: np.ndarray  # segments that are hot
    same: np.ndarray  # the representative (its place among them) of each
    rep: np.ndarray  # representatives, as segments
    cuts: np.ndarray  # where each bucket's begin


def _hot(block: Block, buckets: int, bitmaps: list[dict]) -> Hot:
    gram, _, place = block.grams(buckets)
    hot, often = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
    cuts = _cut(gram, buckets)
    for row in bitmaps:
        a, b = cuts[row["bucket"]], cuts[row["bucket"] + 1]
        for flag, name in ((hot, "bits"), (often, "often")):
            flag[a:b] = np.unpackbits(np.frombuffer(row[name], np.uint8))[: b - a].astype(bool)
    s = block.segments
    which = np.flatnonzero(hot[place])
    size = s.count[which] + LENGTH - 1
    same, first = tk.equal_classes(block.data, s.start[which], size, block.ids[s.row[which]])
    bucket = s.gram[which[first]] % np.uint64(buckets) + np.uint64(buckets) * often[place[which[first]]]
    order = np.argsort(bucket, kind="stable")
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order))
    return Hot(which, nth[same], which[first[order]], _cut_by(bucket[order], 2 * buckets))


def _cut_by(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)


def _send_segments(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bitmaps = batch.column("bitmaps")[i].as_py()
                if not bitmaps:
                    continue
                block = Block.read(batch, i)
                s, hot = block.segments, _hot(block, buckets, bitmaps)
                size = s.count[hot.rep] + LENGTH - 1
                text = block.data[_ranges(s.start[hot.rep], size)]
                ends = np.concatenate([[0], np.cumsum(size)])
                docs, counts, offsets = block.ids[s.row[hot.rep]], s.count[hot.rep].astype(np.uint8), s.offset[hot.rep].astype(np.uint8)
                full = np.flatnonzero(np.diff(hot.cuts)).tolist()
                cells = [[], [], [], []]
                for b in full:
                    x, y = hot.cuts[b], hot.cuts[b + 1]
                    for cell, value in zip(cells, (docs[x:y], counts[x:y], offsets[x:y], text[ends[x] : ends[y]])):
                        cell.append(value.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], ["bucket", "block", "docs", "counts", "offsets", "text"])

    return send


@dataclass
class Sent:
    """Segments of several rows (docs, counts, offsets, text), one after another."""

    docs: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    n: list[int]  # of each row

    @classmethod
    def read(cls, rows: pa.Table) -> Sent:
        cells = {c: rows[c].to_pylist() for c in ("docs", "counts", "offsets", "text")}
        joined = {c: np.frombuffer(b"".join(v), "<i8" if c == "docs" else np.uint8) for c, v in cells.items()}
        return cls(joined["docs"], joined["counts"].astype(np.int64), joined["offsets"].astype(np.int64), joined["text"], [len(c) for c in cells["counts"]])

    @property
    def size(self) -> np.ndarray:
        return self.counts + LENGTH - 1

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


MERGED = ("docs", "counts", "offsets", "text", "blocks", "sizes", "same", "own")
FIRST = "block long, bucket int, part long, masks binary, " + ", ".join(f"{c} binary" for c in MERGED)


def _first(buckets: int):
    """A bucket is judged; of a frequent one's group of blocks, equal segments are merged: which each block's are goes along."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, part), rows in _gathered(batches, ("bucket", "part")):
            sent = Sent.read(rows)
            if bucket < buckets:
                masks = _masks(sent)
                columns = {"block": rows["block"].combine_chunks(), "masks": pa.array(masks, pa.binary())}
            else:
                start, size = sent.start, sent.size
                same, least = tk.equal_classes(sent.data, start, size, sent.docs)
                cells = (sent.docs[least].astype("<i8"), sent.counts[least].astype(np.uint8), sent.offsets[least].astype(np.uint8), sent.data[_ranges(start[least], size[least])])
                cells += (rows["block"].to_numpy().astype("<i8"), np.array(sent.n, "<i8"), same.astype("<i4"), sent.docs)
                columns = {name: pa.array([cell.tobytes()], pa.binary()) for name, cell in zip(MERGED, cells)}
            n = len(next(iter(columns.values())))
            columns |= {"bucket": pa.array([bucket] * n, pa.int32()), "part": pa.array([part] * n, pa.int64())}
            columns = {c: columns.get(c, pa.nulls(n, pa.int64() if c == "block" else pa.binary())) for c in ("block", "bucket", "part", "masks", *MERGED)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return first


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of merged segments back to the blocks: a copy in a greater document than the least has all its windows there too."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
            same = cell("same", "<i4")
            masks = np.where(cell("own", "<i8") > cell("docs", "<i8")[same], np.uint32(0xFFFFFFFF), cell("masks", "<u4")[same])
            blocks, cuts = cell("blocks", "<i8"), np.concatenate([[0], np.cumsum(cell("sizes", "<i8"))])
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([batch.column("bucket")[i].as_py()] * len(blocks), pa.int32()), pa.array([masks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["block", "bucket", "masks"])


def least_docs(docs: np.ndarray, counts: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For every window of every segment of a bucket, in turn, the least doc_id in which the window starts."""
    size = counts + LENGTH - 1
    start = np.cumsum(size) - size
    same, first = tk.equal_classes(data, start, size, docs)
    least = docs[first]
    # The distinct segments; windows of those that share their minimizer with a different segment are sorted.
    d_start, d_count = start[first], counts[first]
    gram = tk.range_hashes(data, d_start + offsets[first], d_start + offsets[first] + GRAM)
    _, which, often = np.unique(gram, return_inverse=True, return_counts=True)
    mixed = often[which] > 1
    at = np.cumsum(d_count) - d_count
    windows = np.repeat(least, d_count)
    # Equal windows have one minimizer, so the text of any whole minimizers can be sorted by itself: SORT_BYTES or one minimizer at a time.
    own = np.flatnonzero(mixed)[np.argsort(which[mixed], kind="stable")]
    ends = np.cumsum(d_count[own] + LENGTH - 1)
    last = np.flatnonzero(np.r_[which[own][1:] != which[own][:-1], True]) if len(own) else own
    a = done = 0
    while a < len(own):
        b = int(last[min(np.searchsorted(ends[last], done + SORT_BYTES), len(last) - 1)]) + 1
        part = own[a:b]
        size = d_count[part] + LENGTH - 1
        places = _ranges(np.cumsum(size) - size, d_count[part])
        order, classes = sort_suffixes(data[_ranges(d_start[part], size)], places, LENGTH)
        best = np.full(int(classes[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, classes, np.repeat(least[part], d_count[part])[order])
        of = np.empty(len(places), np.int64)
        of[order] = classes
        windows[_ranges(at[part], d_count[part])] = best[of]
        a, done = b, int(ends[b - 1])
    return windows[_ranges(at[same], counts)]


def _masks(sent: Sent) -> list[bytes]:
    """For each row, a 32-bit mask for each of its segments: its windows that start in a smaller document too."""
    least = least_docs(sent.docs, sent.counts, sent.offsets, sent.data)
    at = np.cumsum(sent.counts) - sent.counts
    nth = np.arange(len(least)) - np.repeat(at, sent.counts)
    bits = np.where(least < np.repeat(sent.docs, sent.counts), np.uint32(1) << nth.astype(np.uint32), np.uint32(0))
    masks = np.bitwise_or.reduceat(bits, at).astype("<u4")
    cuts = np.cumsum([0, *sent.n])
    return [masks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The masks of each group of a frequent bucket."""
    for (bucket,), rows in _gathered(batches):
        masks = _masks(Sent.read(rows))
        yield pa.RecordBatch.from_arrays([rows["part"].combine_chunks(), pa.array([bucket] * len(masks), pa.int32()), pa.array(masks, pa.binary())], ["part", "bucket", "masks"])


def removed_bytes(block: Block, hot: Hot | None, masks: list[dict]) -> np.ndarray:
    """Which bytes of the block go."""
    if hot is None or not len(hot.which):
        return np.zeros(len(block.data), bool)
    s = block.segments
    mask = np.zeros(len(hot.rep), np.uint32)
    for row in masks:
        mask[hot.cuts[row["bucket"]] : hot.cuts[row["bucket"] + 1]] = np.frombuffer(row["masks"], "<u4")
    own = mask[hot.same]
    # A copy in a greater document than its representative's starts there too.
    greater = block.ids[s.row[hot.which]] > block.ids[s.row[hot.rep[hot.same]]]
    own = np.where(greater, _LOW.astype(np.uint32), own)
    count = s.count[hot.which]
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    flagged = (np.repeat(own, count) >> nth.astype(np.uint32)) & 1 == 1
    at = _ranges(s.start[hot.which], count)[flagged]
    cover = np.zeros(len(block.data) + 1, np.int32)
    cover[at] += 1  # places are distinct: each window is in one segment
    cover[at + LENGTH] -= 1
    return np.cumsum(cover[:-1]) > 0


def _cut_texts(buckets: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(batch, i)
                bitmaps, masks = batch.column("bitmaps")[i].as_py(), batch.column("masks")[i].as_py() or []
                gone = removed_bytes(block, _hot(block, buckets, bitmaps) if bitmaps else None, masks)
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = block.offsets[:-1][block.offsets[:-1] < len(gone)]
                begins[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(begins)])
                a, b = block.offsets[:-1], block.offsets[1:]
                digests = [sha256(block.data[x:y][~gone[x:y]]).hexdigest() for x, y in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64(), mask=block.null), pa.array(b - a), pa.array(total[b] - total[a]), pa.array(spans[b] - spans[a]), pa.array(digests)], names)

    return cut


def remove_repeats(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay)."""
    bounded_batches(documents.sparkSession)
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parallelism(spark), -(-total // BUCKET_BYTES))
    groups = max(1, math.isqrt(total // BLOCK_BYTES))
    path, name = shared_dir(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    _blocks(documents).write.bucketBy(min(buckets, MOST_FILES), "block").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(buckets, *by).sortWithinPartitions(*by)

    try:
        with scratch(spark):
            blocks = spark.table(name)
            grams = blocks.mapInArrow(tk.tidied(_send_grams(buckets)), "bucket int, block long, grams binary")
            hot = written(dealt(grams, "bucket").mapInArrow(tk.tidied(_find_hot), "block long, bucket int, bits binary, often binary"), "hot")
            bitmaps = hot.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "often")).alias("bitmaps"))
            marked = blocks.join(bitmaps, "block", "left")
            sent = marked.mapInArrow(tk.tidied(_send_segments(buckets)), "bucket int, block long, docs binary, counts binary, offsets binary, text binary")
            group = F.when(F.col("bucket") >= buckets, F.pmod(F.xxhash64("block"), F.lit(groups))).otherwise(-1)
            first = written(dealt(sent.withColumn("part", group), "bucket", "part").mapInArrow(tk.tidied(_first(buckets)), FIRST), "first")
            merged = first.where("masks is null").drop("block", "masks")
            judged = dealt(merged.select("bucket", "part", "docs", "counts", "offsets", "text"), "bucket").mapInArrow(tk.tidied(_judge), "part long, bucket int, masks binary")
            back = merged.select("bucket", "part", "docs", "blocks", "sizes", "same", "own").join(judged, ["bucket", "part"])
            second = written(back.mapInArrow(tk.tidied(_spread), "block long, bucket int, masks binary"), "masks")
            masks = first.where("masks is not null").select("block", "bucket", "masks").unionAll(second)
            masks = masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks"))
            out = marked.join(masks, "block", "left").mapInArrow(tk.tidied(_cut_texts(buckets)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
            return kept(out, "repeats")
    finally:
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)
