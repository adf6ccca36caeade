"""Token ids, token counts and the binary file format.

Both public tokenizers merge within pre-tokens only, so a text's ids are those of its pre-tokens in turn. Texts of plain Latin
letters are cut here (``pieces``) and each distinct pre-token is merged by the library's model; any other text (a code point from U+0180
on, or what may be a special token's string) is given to the library whole. Either way the ids are the library's.
Null text counts as empty; texts of any length are encoded whole, about SLICE_BYTES of short ones or one long one at a time; repeated
rows are encoded alike; an empty table gives an empty result, and files without shards. Other columns are not read, whatever their
names are. Files order rows of one doc_id by a hash of the text, then the text.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.llm import merges, pieces
from scopeflow.llm import textkit as tk
from scopeflow.llm.storage import bounded_batches, parallelism, written

#: Entries of a generation of a worker's memory of pre-tokens.
MEMORY = 150_000
#: Text whose distinct pre-tokens are looked up at a time.
LOOK_UP_BYTES = 2 << 20


class Memory(dict):
    """Values that ``find`` gives for keys, kept while they were used in this generation or the one before: so frequent ones stay, and no more
    than 2 * MEMORY are held, and what one batch adds."""

    def __init__(self, find: Callable[[bytes], object]):
        super().__init__()
        self.find, self.before = find, {}

    def many(self, keys: list[bytes]) -> list:
        if len(self) >= MEMORY:
            self.before = dict(self)
            self.clear()
        out = list(map(self.get, keys))
        find, before = self.find, self.before.get
        for i, value in enumerate(out):
            if value is None:
                key = keys[i]
                value = before(key)
                out[i] = self[key] = find(key) if value is None else value
        return out


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_STAND_INS = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})


def stand_ins(piece: bytes) -> str:
    """A pre-token as the vocabulary writes it."""
    return piece.decode("latin-1").translate(_STAND_INS)


class PieceEncoder:
    """Ids, or numbers of ids, of the texts of an Arrow column."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = load(path)
        self.merge = self.tokenizer.model.tokenize
        self.merger: merges.Merger | bool | None = None  # made when numbers are asked for
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.known = Memory(lambda piece: array(self.kind.char, [t.id for t in self.merge(stand_ins(piece))]).tobytes())
        self.counts = Memory(lambda piece: len(self.merge(stand_ins(piece))))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of these rows, number of ids of each) of consecutive rows."""
        for a, b, data, offsets in tk.slices(column, LOOK_UP_BYTES):
            others, rows, start, end = _cut(data, offsets, True)
            values, place = pieces.look_up(data, start, end, self.known.many)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width
            flat = np.frombuffer(b"".join(values), self.kind)
            first = np.cumsum(sizes) - sizes
            n = np.bincount(rows, sizes[place], minlength=b - a).astype(np.int64) if len(rows) else np.zeros(b - a, np.int64)
            ids = flat[_ranges(first[place], sizes[place])]
            if len(others):
                own = {i: np.array(self.whole(_row(data, offsets, i)), self.kind) for i in others}
                cuts = np.concatenate([[0], np.cumsum(n)])
                ids = np.concatenate([own[i] if i in own else ids[cuts[i] : cuts[i + 1]] for i in range(b - a)])
                for i, x in own.items():
                    n[i] = len(x)
            yield a, b, ids, n

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of ids of each piece: short ones are merged on arrays where the model allows it, others one by one."""
        if self.merger is None:
            self.merger = merges.Merger.of(self.path, byte_alphabet()) or False
        size, n = end - start, np.zeros(len(start), np.int64)
        short = size <= (merges.LONGEST if self.merger else 0)
        if short.any():
            n[short] = self.merger.counts(data, start[short], size[short])
        if not short.all():
            values, place = pieces.look_up(data, start[~short], end[~short], self.counts.many)
            n[~short] = np.array(values, np.int64)[place]
        return n

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for a, b, data, offsets in tk.slices(column, LOOK_UP_BYTES):
            others, rows, start, end = _cut(data, offsets, True)
            n = self.numbers(data, start, end)
            out.append(np.bincount(rows, n, minlength=b - a).astype(np.int64))
            for i in others:
                out[-1][i] = len(self.whole(_row(data, offsets, i)))
        return np.concatenate(out)


def _cut(data: np.ndarray, offsets: np.ndarray, by_bytes: bool) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are not cut here, row of each piece, start, end)."""
    plain = pieces.plain_rows(data, offsets)
    start, end = pieces.cut(data, offsets, by_bytes)
    rows = np.searchsorted(offsets, start, "right") - 1
    if not plain.all():
        keep = plain[rows]
        rows, start, end = rows[keep], start[keep], end[keep]
    return np.flatnonzero(~plain).tolist(), rows, start, end


def _row(data: np.ndarray, offsets: np.ndarray, i: int) -> str:
    return data[offsets[i] : offsets[i + 1]].tobytes().decode()


def _sums(rows: np.ndarray, sizes: list[int], place: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, np.array(sizes, np.int64)[place], minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """A worker's encoder: tasks that follow find what it has learnt."""
    return PieceEncoder(path)


# ---- whole-token shortcut ------------------------------------------------------------------------------------------------------


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens that are one token alone: proved by encoding every vocabulary string that ends a word."""
    tokenizer, alphabet = load(path), byte_alphabet()
    surfaces = []
    for entry in tokenizer.get_vocab():
        if entry.endswith("</w>"):
            try:
                text = bytes(alphabet[c] for c in entry[:-4]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and text == text.lower():
                surfaces.append(text)
    alone = []
    for a, b, data, offsets in tk.slices(pa.array(surfaces, pa.large_string())):
        _, rows, start, end = _cut(data, offsets, False)
        alone += [surfaces[a + i] for i in rows[(start == offsets[rows]) & (end == offsets[rows + 1])].tolist()]
    return frozenset(t for t, got in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False)) if len(got.ids) == 1)


class WordCounter:
    """Numbers of tokens. Pre-tokens that are whole tokens count at once; only the others are merged by the library."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = load(path)
        self.merge = self.tokenizer.model.tokenize
        self.single = {piece.encode() for piece in whole}
        self.known = Memory(lambda piece: 1 if piece in self.single else len(self.merge(stand_ins(piece))))

    def count(self, column: pa.Array) -> np.ndarray:
        texts = tk.text_column(column)
        low = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())
        out = [np.zeros(0, np.int64)]
        for a, b, data, offsets in tk.slices(low, LOOK_UP_BYTES):
            others, rows, start, end = _cut(data, offsets, False)
            sizes, place = pieces.look_up(data, start, end, self.known.many)
            out.append(_sums(rows, sizes, place, b - a))
            for i in others:
                out[-1][i] = len(self.tokenizer.encode(texts[a + i].as_py(), add_special_tokens=False).ids)
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter_of(path: str, whole: frozenset[str]) -> WordCounter:
    return WordCounter(path, whole)


def count_tokens(documents: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. The vocabulary's whole tokens are broadcast: no more than it has entries."""
    bounded_batches(documents.sparkSession)
    whole = documents.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, whole.value)
        for batch in batches:
            for a, b, _, offsets in tk.slices(batch.column("text"), LOOK_UP_BYTES):
                part = batch.slice(a, b - a)
                n = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(tk.tidied(counted), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


# ---- Elias-Fano boundaries and the shard format --------------------------------------------------------------------------------

SAMPLE = 64  # every so many items, the place of its bit is stored
_ONES = bytes(i.bit_count() for i in range(256))


@dataclass
class EliasFano:
    """A non-decreasing sequence below 2**64 in about 2 + log2(universe / n) bits an item; ``select`` reads one item from a few words."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray  # uint32: bit place of items 0, SAMPLE, 2 * SAMPLE, ...

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        low = np.packbits(((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        return int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3], "little") >> (at & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Item ``i``: from the sample before it, whole bytes of set bits are passed over, then bits."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        byte = self.high[at] >> (place & 7) << (place & 7)
        while left >= _ONES[byte]:
            left -= _ONES[byte]
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def sections(self) -> tuple[bytes, bytes, bytes]:
        return self.low, self.high, self.samples.tobytes()

    @classmethod
    def from_sections(cls, n: int, low_bits: int, blob: bytes, at: int, sizes: tuple[int, int, int]) -> EliasFano:
        ends = np.cumsum((at, *sizes)).tolist()
        return cls(n, low_bits, blob[ends[0] : ends[1]], blob[ends[1] : ends[2]], np.frombuffer(blob, "<u4", sizes[2] // 4, ends[2]))


_HEAD = struct.Struct("<4sBBBBQQQq6QI")
_MAGIC = b"SFTK"


@dataclass
class Shard:
    """Documents in ascending order of doc_id, those without one first: the offsets of their tokens (one more than documents), and all
    tokens in one array. Document ids are a sorted sequence too, kept as their distances from the least."""

    n_null: int
    base: int
    own: EliasFano
    bounds: EliasFano
    ids: np.ndarray

    @classmethod
    def of(cls, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> Shard:
        named = [i for i in doc_ids if i is not None]
        base = named[0] if named else 0
        return cls(len(doc_ids) - len(named), base, EliasFano.encode(np.array([i - base for i in named], np.uint64)), EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)])), ids)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def to_bytes(self) -> bytes:
        """Head (magic, version, id width, low bits of both sequences, numbers of documents, of those without id, and of tokens, least id, lengths of
        the sections, crc of the rest), then both sequences (low bits, high bits, select samples), then the tokens."""
        sections = (*self.own.sections(), *self.bounds.sections())
        body = b"".join((*sections, self.ids.tobytes()))
        return _HEAD.pack(_MAGIC, 2, self.ids.dtype.itemsize, self.own.low_bits, self.bounds.low_bits, len(self), self.n_null, len(self.ids), self.base, *map(len, sections), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, blob: bytes) -> Shard:
        magic, version, width, own_bits, low_bits, n, n_null, n_ids, base, *sizes, crc = _HEAD.unpack_from(blob)
        at = _HEAD.size
        if magic != _MAGIC or version != 2 or zlib.crc32(memoryview(blob)[at:]) != crc:
            raise ValueError("not a token shard, or a damaged one")
        own = EliasFano.from_sections(n - n_null, own_bits, blob, at, tuple(sizes[:3]))
        bounds = EliasFano.from_sections(n + 1, low_bits, blob, at + sum(sizes[:3]), tuple(sizes[3:]))
        return cls(n_null, base, own, bounds, np.frombuffer(blob, f"<u{width}", n_ids, at + sum(sizes)))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.own.select(i - self.n_null)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


SHARD_TOKENS = 1 << 20  # a shard ends with the document that reaches this


def write_tokens(documents: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Encodes all documents and writes token shards in ascending doc_id order (null first; ties by text); returns the written table of
    (part, seq, n_docs, n_tokens, shard). Shards travel as binary cells of Parquet files, so Spark's committer and any store it knows
    hold them, and a task that runs again replaces its own output only.
    """
    bounded_batches(documents.sparkSession)
    n = parallelism(documents.sparkSession)
    ordered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        own: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            shard = Shard.of(own, np.concatenate(sizes), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([len(shard.ids)], pa.int64()), pa.array([shard.to_bytes()], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, got, n in encoder.encode(batch.column("text")):
                got = np.insert(got, np.cumsum(n), np.array(end_id, got.dtype))
                ends = np.cumsum(n + 1)
                at = 0
                while at < b - a:
                    done = int(ends[at - 1]) if at else 0
                    stop = min(b - a, int(np.searchsorted(ends, done + SHARD_TOKENS - held)) + 1)
                    ids.append(got[done : ends[stop - 1]])
                    sizes.append(n[at:stop] + 1)
                    own += names[a + at : a + stop]
                    held += len(ids[-1])
                    at = stop
                    if held >= SHARD_TOKENS:
                        yield flush()
                        ids, sizes, own, held, seq = [], [], [], 0, seq + 1
        if own:
            yield flush()

    return written(ordered.mapInArrow(tk.tidied(shards), "part int, seq int, n_docs long, n_tokens long, shard binary"), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shards. Starts are prefix sums of shard totals: first over parts, then within each."""
    totals = shards.select("part", "seq", "n_tokens")
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumn("inside", inside).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("shard")):
                shard = Shard.from_bytes(blob.as_py())
                n = len(shard)
                bounds = np.array([shard.bounds.select(i) for i in range(n + 1)], np.int64)
                ids = shard.ids.astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                own = pa.array([shard.doc_id(i) for i in range(n)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), own, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "shard").mapInArrow(tk.tidied(read), "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
