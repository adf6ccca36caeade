"""Quality rules and line labelling.

Base rules count words, symbols, repeated lines and repeated word windows. Documents that pass them are judged by a linear-chain
conditional random field over their lines: Viterbi decoding marks each line content or boilerplate, and the share of words that
stand in content lines decides retention. Null text counts as empty; an empty text has one empty line, no words, and fails the
base rules. Long texts are judged whole, one at a time; of labellings that score the same, content wins. Repeated rows are judged alike; an
empty table gives an empty result, and without labels every line counts as content. Only the id and text are read, so other
columns may have any names; ``keep_quality`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeflow.llm import textkit as tk
from scopeflow.llm.storage import bounded_batches

SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "pipes", "upper", "symbols", "shouts", "repeats", "digits")


@dataclass
class Crf:
    """Score of a labelling: sum of ``weights . features`` over content lines, plus ``moves[a][b]`` for each step from a to b."""

    weights: np.ndarray = field(default_factory=lambda: np.eye(len(FEATURES))[0])
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


@dataclass
class Lines:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the lines of row i


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Every row's text split at ``\\n``."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, "right") - 1
    before = np.searchsorted(breaks, offsets)
    first = before + np.arange(n_rows + 1)
    end = np.empty(len(breaks) + n_rows, np.int64)
    end[np.arange(len(breaks)) + of] = breaks
    end[first[1:] - 1] = offsets[1:]
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[first[:-1]] = offsets[:-1]
    return Lines(start, end, np.repeat(np.arange(n_rows), np.diff(first)), first)


def _per(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[end] - total[start]


@dataclass
class Measured:
    base: dict[str, np.ndarray]
    lines: Lines
    line_words: np.ndarray
    features: np.ndarray


def measure(data: np.ndarray, offsets: np.ndarray) -> Measured:
    """Base counts of each row, and each line's words and features."""
    words, lines = tk.words_of(data, offsets), lines_of(data, offsets)
    hashes = tk.range_hashes(data, words.start, words.end)
    start, end = offsets[:-1], offsets[1:]
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    of_line = np.searchsorted(lines.start, words.start, "right") - 1
    line_words = np.bincount(of_line, minlength=len(lines.start)) if len(words) else np.zeros(len(lines.start), np.int64)

    n_rows = len(offsets) - 1
    has = np.flatnonzero(line_words)
    key = tk.mix64(tk.range_hashes(data, lines.start[has], lines.end[has]) ^ tk.mix64(lines.row[has].astype(np.uint64)))
    _, once = np.unique(key, return_index=True)
    repeated = np.ones(len(has), bool)
    repeated[once] = False
    dup_lines = np.bincount(lines.row[has[repeated]], minlength=n_rows)

    covered = np.zeros(len(words) + 3, bool)
    at = np.flatnonzero(np.arange(len(words)) + 3 <= words.first[words.row + 1]) if len(words) else np.zeros(0, np.int64)
    if len(at):
        window = tk.mix64(hashes[at] + tk.mix64(hashes[at + 1] + tk.mix64(hashes[at + 2] + np.uint64(7))))
        window = tk.mix64(window ^ tk.mix64(words.row[at].astype(np.uint64)))
        ordered = np.sort(window)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            near = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            hit = at[twice[near] == window]
            covered[hit] = covered[hit + 1] = covered[hit + 2] = True
    base = {
        "n_words": np.diff(words.first),
        "word_chars": _per(((data & 0xC0) != 0x80) & ~tk.IS_SPACE[data], start, end),
        "n_symbols": _per(symbol, start, end),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(words.row[np.flatnonzero(covered[: len(words)])], minlength=n_rows),
    }

    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])
    n, size = np.maximum(line_words, 1), np.maximum(lines.end - lines.start, 1)
    upper = _per((data >= 65) & (data <= 90), lines.start, lines.end)
    letters = upper + _per((data >= 97) & (data <= 122), lines.start, lines.end)
    columns = (
        np.ones(len(size)),
        np.minimum(1, _per(data == 124, lines.start, lines.end) / n),
        upper / np.maximum(letters, 1),
        np.minimum(1, 4 * _per(symbol, lines.start, lines.end) / size),
        np.minimum(1, _per(data == 33, lines.start, lines.end) / n),
        np.bincount(of_line[same], minlength=len(size)) / n,
        _per((data >= 48) & (data <= 57), lines.start, lines.end) / size,
    )
    return Measured(base, lines, line_words, np.stack(columns, 1).astype(float))


def viterbi(crf: Crf, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labelling (1: content) of each run of lines, ties to content; all runs step together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    label = np.ones(len(emit), np.int8)
    if not len(sizes) or not sizes[0]:
        return label
    back = np.zeros((len(emit), 2), np.int8)
    score = np.zeros((int((sizes > 0).sum()), 2))
    score[:, 1] = emit[begin[: len(score)]]
    final = np.zeros((len(score), 2))
    for step in range(1, int(sizes[0]) + 1):
        alive = int(np.searchsorted(-sizes, -step))  # runs longer than step
        final[alive : len(score)] = score[alive:]
        score = score[:alive]
        if not alive:
            break
        at = begin[:alive] + step
        via = score[:, :, None] + crf.moves[None]
        back[at] = via[:, 1, :] >= via[:, 0, :]
        score = via.max(1)
        score[:, 1] += emit[at]
    n = len(final)
    state = (final[:, 1] >= final[:, 0]).astype(np.int8)
    for step in range(int(sizes[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-sizes[:n], -step))
        at = begin[:alive] + step
        label[at] = state[:alive]
        state[:alive] = back[at, state[:alive]]
    return label


def fit_crf(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 2, steps: int = 150) -> Crf:
    """Maximises the penalised conditional likelihood by Adam. Between rounds, lines of junk documents are decoded anew, as only some are junk."""
    crf, label = Crf(), label.astype(float).copy()
    if not len(label) or label.min() == label.max():
        return crf
    given = label.copy()
    sizes = np.diff(first)
    begin = first[:-1][sizes > 0]
    sizes = sizes[sizes > 0]
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = begin[order], sizes[order]
    alive = [int(np.searchsorted(-sizes, -t)) for t in range(int(sizes[0]))]
    for _ in range(rounds):
        theta = np.concatenate([crf.weights, crf.moves.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        k = features.shape[1]
        seen = np.zeros((2, 2))
        for t in range(1, len(alive)):
            at = begin[: alive[t]] + t
            np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)
        for step in range(1, steps + 1):
            emit, moves = features @ theta[:k], theta[k:].reshape(2, 2)
            fwd = np.zeros((len(emit), 2))
            fwd[begin, 1] = emit[begin]
            for t in range(1, len(alive)):
                at = begin[: alive[t]] + t
                fwd[at] = np.logaddexp(fwd[at - 1, :1] + moves[0], fwd[at - 1, 1:] + moves[1])
                fwd[at, 1] += emit[at]
            bwd = np.zeros((len(emit), 2))
            for t in range(len(alive) - 1, 0, -1):
                at = begin[: alive[t]] + t
                out = bwd[at].copy()
                out[:, 1] += emit[at]
                bwd[at - 1] = np.stack([np.logaddexp(out[:, 0] + moves[i, 0], out[:, 1] + moves[i, 1]) for i in (0, 1)], 1)
            both = fwd + bwd
            norm = np.logaddexp(both[:, 0], both[:, 1])
            p = np.exp(both[:, 1] - norm)
            used = np.zeros((2, 2))
            for t in range(1, len(alive)):
                at = begin[: alive[t]] + t
                for i in (0, 1):
                    for j in (0, 1):
                        used[i, j] += np.exp(fwd[at - 1, i] + moves[i, j] + j * emit[at] + bwd[at, j] - norm[at]).sum()
            grad = np.concatenate([features.T @ (label - p), (seen - used).ravel()]) / len(emit) - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        crf = Crf(theta[:k], theta[k:].reshape(2, 2))
        label = np.where(given > 0, 1.0, viterbi(crf, features @ crf.weights, first))
        if label.min() == label.max():
            break
    return crf


def train_crf(documents: DataFrame, labels: DataFrame, per_class: int = 400, max_lines: int = 512, max_bytes: int = 65536) -> Crf:
    """A CRF from at most ``per_class`` labelled documents of each quality, those of least hashed id, of at most ``max_lines``
    lines and ``max_bytes`` bytes each: these three bounds limit what reaches the driver. Lines take their document's label.
    Without labelled documents of both kinds, every line counts as content.
    """
    bounded_batches(documents.sparkSession)
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    hashed = marked.withColumn("h", F.xxhash64("doc_id"))
    # Three times as many ids as are used, for some have no document in bounds.
    ids = hashed.where("quality = 1").orderBy("h", "doc_id").limit(3 * per_class).unionAll(hashed.where("quality = 0").orderBy("h", "doc_id").limit(3 * per_class))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(f"octet_length(text) <= {max_bytes}").join(F.broadcast(ids), "doc_id")
    texts = texts.where(f"length(text) - length(replace(text, '\\n', '')) < {max_lines}").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("h").alias("h"), F.min("text").alias("text"))
    schema = "doc_id long, quality int, h long, n_lines int, features binary"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column("text")):
                got = measure(data, offsets)
                part = batch.slice(a, b - a)
                cells = [got.features[i:j].astype(np.float32).tobytes() for i, j in zip(got.lines.first[:-1], got.lines.first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int32()), part.column("h"), pa.array(np.diff(got.lines.first), pa.int32()), pa.array(cells, pa.binary())], ["doc_id", "quality", "h", "n_lines", "features"])

    rows = texts.mapInArrow(tk.tidied(lines), schema).collect()
    rows = [r for q in (0, 1) for r in sorted((r for r in rows if r.quality == q), key=lambda r: (r.h, r.doc_id))[:per_class]]
    if not rows:
        return Crf()
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, len(FEATURES)) for r in rows]).astype(float)
    first = np.concatenate([[0], np.cumsum([r.n_lines for r in rows])])
    return fit_crf(features, first, np.repeat([r.quality for r in rows], [r.n_lines for r in rows]))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge_quality(documents: DataFrame, crf: Crf, min_share: float = 0.5) -> DataFrame:
    """One row per document: base counts, base_failed, kept and content_share."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column("text")):
                got = measure(data, offsets)
                label = viterbi(crf, got.features @ crf.weights, got.lines.first)
                content = np.concatenate([[0], np.cumsum(got.line_words * label)])
                n = got.base["n_words"]
                share = (content[got.lines.first[1:]] - content[got.lines.first[:-1]]) / np.maximum(n, 1)
                failed = (n < 50) | (100 * got.base["n_repeat_words"] > 50 * n)
                columns = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), *(pa.array(got.base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                columns += [pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    bounded_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(tk.tidied(judged), RESULT)


def keep_quality(documents: DataFrame, crf: Crf, min_share: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns; works row by row, so repeated ids are no matter."""
    schema = documents.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column("text")):
                got = measure(data, offsets)
                label = viterbi(crf, got.features @ crf.weights, got.lines.first)
                content = np.concatenate([[0], np.cumsum(got.line_words * label)])
                n = got.base["n_words"]
                share = (content[got.lines.first[1:]] - content[got.lines.first[:-1]]) / np.maximum(n, 1)
                failed = (n < 50) | (100 * got.base["n_repeat_words"] > 50 * n)
                yield batch.slice(a, b - a).filter(pa.array(~failed & (share >= min_share)))

    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(tk.tidied(kept), schema)
