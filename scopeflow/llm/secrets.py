"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The guess cost of a value is the least sum over its segmentations into words, dates, repeats (whole copies, as many as there are, of a unit of up
to UNIT characters, which has a cost by the same rule), keyboard walks and single characters tried blindly: log10 of the guesses.
A value of at least MIN_COST that follows a credential word is a secret.

A word costs by its rank: among the words of the corpus by document frequency, or in a list of words that passwords are made of, if that is
lower. The first TOP words (of WORD_BYTES at most) are broadcast. Most values are settled by them: cheap enough already, or too
dear even if each of their letters belonged to the next word in rank. The few between are joined with the ranks of all words.

Null text counts as empty and has no secrets; whole texts are searched, in time linear in a value's length; repeated rows are treated alike;
spans are ordered by start, then kind; an empty table stays empty. Only doc_id and text are read for a scan, text and n_chars for masking;
other columns may have any names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.llm import pieces
from scopeflow.llm import textkit as tk
from scopeflow.llm.storage import bounded_batches, kept, scratch, unused, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: Credential words before a value that the fixed patterns don't take, and the credentials of a URL.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:bearer[\x20]+|basic[\x20]+)?["']?([^\s"'<>,;]{6,})|://[^\s/:@"']+:([^\s/@"']{6,})@""",
    re.IGNORECASE | re.ASCII,
)
#: Any text with a find has a match of this (a cheap search in the library that reads the column).
_MAY = r"(?i:pass|pwd|secret|token|api|key|credential|auth|://[^\s/:@]+:)|AKIA|[0-9a-f]{32}"
MIN_COST = 9.0
#: The dictionary that is broadcast: so many words, of so many bytes at most.
TOP, WORD_BYTES = 50_000, 32
UNIT = 16  # the longest unit of a repeat

# Words that people often put in passwords, most frequent first.
COMMON = """password pass admin welcome qwerty letmein monkey dragon master login love secret hello summer winter spring autumn football
baseball princess sunshine shadow superman michael jordan hunter killer soccer batman trust freedom whatever charlie daniel thomas
robert jessica ashley nicole michelle andrew joshua george computer internet server system root user guest test demo default change
changeme please company office service account money orange banana apple cookie coffee pepper ginger tiger lion eagle falcon flower
star moon silver gold diamond blue green black white red purple happy lucky angel family friend school music guitar piano london
paris berlin example sample local database oracle mysql redis spark token key access private public value string here your none null
true false todo enter insert placeholder redacted hidden removed xxxx""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@!", "aeoistsai")
_AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])(?:[-/.]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
WALK, STEP = math.log10(47), 0.3  # a key to begin with, and each step from it
#: What parts the words of texts: all ASCII but letters.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _near(a: str, b: str) -> bool:
    """Keys side by side in a row or one above the other."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and p != q)


def _blind(c: str) -> float:
    if c.isascii():
        return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


def _letter(c: str) -> bool:
    return c.isalpha() if c.isascii() else True


def _spelled(piece: str, rank: float, plain: bool) -> float:
    """What a word of a rank costs in this spelling; ``plain``: without digits and signs for letters."""
    cased = 0 if piece == piece.translate(_AZ) else 0.3 if piece.istitle() or piece.isupper() else 1.0
    return math.log10(rank) + 0.3 + cased + (0 if plain else 0.6)


def guess_cost(value: str, ranks: Mapping[str, int] = RANK, stop: float = math.inf, rest: int | None = None, units: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation takes; 0 for the empty value. From ``stop`` on, only that it is no less.

    With ``rest``, a lower bound: any letters of up to WORD_BYTES may be a word of that rank.
    """
    n, lower = len(value), value.translate(_AZ)
    plain = lower.translate(LEET)
    best = [0.0] + [math.inf] * n
    units = {} if units is None else units
    same_until = [0] * (UNIT + 1)  # by period: up to where the value is known to agree with itself so much later
    walk_from, walk_low = 0, math.inf  # of the walk that ends here: its first place, and the least cost to come in
    cheap = 0  # the last place that is reached for less than ``stop``

    for i in range(n + 1):
        if i >= 2 and not _near(lower[i - 2], lower[i - 1]):
            walk_from, walk_low = i - 1, math.inf
        if i - 4 >= walk_from:
            walk_low = min(walk_low, best[i - 4] - STEP * (i - 4))
            best[i] = min(best[i], walk_low + WALK + STEP * (i - 1))
        at = best[i]
        if i == n:
            break
        if at >= stop:
            if i >= cheap + 4 and walk_low + WALK + STEP * i >= stop:
                return at if math.isfinite(at) else stop
            continue

        def reach(end: int, cost: float) -> None:
            nonlocal cheap
            if cost < best[end]:
                best[end] = cost
                if cost < stop:
                    cheap = max(cheap, end)

        reach(i + 1, at + _blind(value[i]))
        j = i
        while j < min(n, i + WORD_BYTES) and _letter(plain[j]):
            j += 1
            if j - i >= 3:
                for text, own in ((lower[i:j], True), (plain[i:j], False)):
                    rank = ranks.get(text, rest)
                    if rank and (own or text != lower[i:j]) and (rank != rest or not own or all(map(_letter, text))):
                        reach(j, at + _spelled(value[i:j], rank, own))
        date = _DATE.match(value, i)
        if date:
            reach(date.end(), at + (2.1 if date.end() - i <= 4 else 4.7))
        for p in range(1, min(UNIT, (n - i) // 2) + 1):
            if same_until[p] < i + p and value[i : i + p] != value[i + p : i + 2 * p]:
                continue
            until = max(same_until[p], i + p)
            step = p
            while step:  # further by ever longer steps, then shorter ones
                if until + step + p <= n and value[until : until + step] == value[until + p : until + p + step]:
                    until += step
                    step *= 2
                else:
                    step //= 2
            same_until[p] = until
            copies = (until - i) // p + 1
            if copies * p >= 3:
                unit = value[i : i + p]
                if unit not in units:
                    units[unit] = guess_cost(unit, ranks, stop, rest, units)
                reach(i + copies * p, at + units[unit] + math.log10(copies) + 0.3)
    return best[n]


def find_secrets(text: str, min_cost: float = MIN_COST, is_secret: Callable[[str], bool | None] | None = None) -> list[tuple[int, int, int, str | None]]:
    """(start, kind's place in KINDS, end, value that is still open) in code points, by start, then kind. The first three kinds are the fixed patterns'
    own. ``is_secret`` judges a value, and says None where it can't yet.
    """
    judge = is_secret or (lambda value: guess_cost(value, stop=min_cost) >= min_cost)
    found = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), None) for m in LONG_HEX.finditer(text)]  # maximal runs of 32 characters or more
    found.sort(key=lambda f: f[:3])
    reach: list[int] = []
    for _, _, end, _ in found:
        reach.append(max(end, reach[-1] if reach else 0))
    starts = [f[0] for f in found]
    added = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1) if m.start(1) >= 0 else m.span(2)
        value = text[start:end].rstrip(".:!?)")
        end = start + len(value)
        k = bisect_right(starts, start) - 1
        if k >= 0 and reach[k] >= end:
            continue  # lies in a find of a fixed pattern
        if len(value) >= 6:
            verdict = judge(value)
            if verdict is not False:
                added.append((start, 3, end, value if verdict is None else None))
    return sorted(found + added, key=lambda f: f[:3])


# ---- the corpus's words ---------------------------------------------------------------------------------------------------------


def corpus_words(documents: DataFrame) -> DataFrame:
    """(word, df): in how many rows each word stands: runs of letters of 3 to WORD_BYTES bytes, A-Z lower-cased; non-ASCII counts as letters.

    Values in credential contexts and the fixed patterns' finds are left out, or a secret would be a word. Counts are summed for each slice of a batch
    before they are shuffled.
    """

    def prose(column: pa.Array) -> pa.Array:
        texts = tk.text_column(column)
        may = [i for i, look in enumerate(_candidates(texts)) if look]
        if not may:
            return texts
        out = texts.to_pylist()
        for i in may:
            spans = [m.span(1) if m.start(1) >= 0 else m.span(2) for m in CONTEXT.finditer(out[i])]
            spans += [m.span() for p in (ASSIGN, ACCESS, LONG_HEX) for m in p.finditer(out[i])]
            out[i] = masked(out[i], [(a, 0, b, None) for a, b in sorted(spans)], " ")
        return pa.array(out, pa.large_string())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tk.slices(prose(batch.column("text"))):
                low = tk.lowered(data)
                w = tk.words_of(low, offsets, _NO_LETTER)
                use = np.flatnonzero((w.end - w.start >= 3) & (w.end - w.start <= WORD_BYTES))
                found, place = pieces.look_up(low, w.start[use], w.end[use], list)
                pairs = np.unique(w.row[use] * len(found) + place)
                df = np.bincount(pairs % max(1, len(found)), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in found], pa.string()), pa.array(df, pa.int64())], ["word", "df"])

    return documents.select("text").mapInArrow(tk.tidied(counted), "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def _ranks(words: DataFrame) -> DataFrame:
    """(df, rank): how many words stand in so many rows or more: the last rank of that frequency. Frequencies that differ are few, as their sum is no
    more than that over all words."""
    below = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)
    return words.groupBy("df").agg(F.count("*").alias("n")).select("df", F.sum("n").over(below).alias("rank"))


def top_words(words: DataFrame) -> dict[str, int]:
    """The words of the highest document frequencies with their ranks: TOP at most, and all of a frequency or none."""
    least = _ranks(words).where(F.col("rank") <= TOP).agg(F.min("df")).first()[0]
    rows = [] if least is None else words.where(F.col("df") >= least).collect()
    return {r.word: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r.df, r.word)))}


def _judge(ranks: Mapping[str, int], rest: int | None, min_cost: float) -> Callable[[str], bool | None]:
    """By the first words alone; ``rest`` is the next rank, or None where there are no more words."""

    @lru_cache(maxsize=1 << 14)
    def judge(value: str) -> bool | None:
        if guess_cost(value, ranks, min_cost) < min_cost:
            return False
        return True if rest is None or guess_cost(value, ranks, min_cost, rest) >= min_cost else None

    return judge


def _harmless(values: DataFrame, words: DataFrame, ranks: Mapping[str, int], min_cost: float) -> DataFrame:
    """(value): those of the open ``values`` that cost less than ``min_cost`` with the ranks of all words. Words of one frequency share the last rank of it."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("value").to_pylist():
                lower = value.translate(_AZ)
                texts = {t[i:j] for t in {lower, lower.translate(LEET)} for i in range(len(t)) for j in range(i + 3, min(len(t), i + WORD_BYTES) + 1)}
                own = [t for t in texts if t not in ranks.value and all(map(_letter, t))]
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(own), pa.string()), pa.array(own, pa.string())], ["value", "word"])

    named = values.mapInArrow(tk.tidied(spelled), "value string, word string").join(words, "word").join(_ranks(words), "df")
    named = named.groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("words"))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("value").to_pylist(), batch.column("words").to_pylist())
            cheap = [v for v, own in rows if guess_cost(v, {**ranks.value, **{w["word"]: w["rank"] for w in own}}, min_cost) < min_cost]
            yield pa.RecordBatch.from_arrays([pa.array(cheap, pa.string())], ["value"])

    return named.mapInArrow(tk.tidied(settled), "value string")


def _each(documents: DataFrame, words: DataFrame, finish: Callable, schema: str, min_cost: float) -> DataFrame:
    """``finish(batch, rows, finds)`` over all rows: gets the finds of each row that may have any, and gives a batch of those rows.

    Rows with an open value wait for the join; all others are finished in their first scan.
    """
    bounded_batches(documents.sparkSession)
    spark = documents.sparkSession
    top = top_words(words)
    rest = len(top) + 1 if words.count() > len(top) else None
    ranks = spark.sparkContext.broadcast(top | {w: min(k, top.get(w, k)) for w, k in RANK.items()})
    row, harmless = unused(documents.columns, "row"), unused(documents.columns, "harmless")

    def finds(batch: pa.RecordBatch, judge: Callable[[str], bool | None]) -> list[list]:
        texts = batch.column("text")
        return [find_secrets(texts[i].as_py(), min_cost, judge) if look else [] for i, look in enumerate(_candidates(texts))]

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(ranks.value, rest, min_cost)
        for batch in batches:
            got = finds(batch, judge)
            done = [not any(f[3] is not None for f in own) for own in got]
            yield finish(batch.filter(pa.array(done)), [own for own, d in zip(got, done) if d])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(ranks.value, rest, min_cost)
        for batch in batches:
            values = [sorted({f[3] for f in own if f[3] is not None}) for own in finds(batch, judge)]
            some = [i for i, v in enumerate(values) if v]
            part = batch.take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([values[i] for i in some], pa.list_(pa.string()))], [*part.schema.names, harmless])

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(ranks.value, rest, min_cost)
        for batch in batches:
            own = [set(v or ()) for v in batch.column(harmless).to_pylist()]
            got = [[f for f in found if f[3] not in skip] for found, skip in zip(finds(batch, judge), own)]
            yield finish(batch.drop_columns([harmless]), got)

    done = documents.mapInArrow(tk.tidied(direct), schema)
    if rest is None:
        return done
    waiting = documents.mapInArrow(tk.tidied(opened), documents.select("*", F.array(F.lit("")).alias(harmless)).schema)
    waiting = written(waiting.withColumn(row, F.monotonically_increasing_id()), "waiting")
    values = waiting.select(row, F.explode(harmless).alias("value"))
    cheap = written(_harmless(values.select("value").distinct(), words, ranks, min_cost), "harmless")
    own = values.join(cheap, "value").groupBy(row).agg(F.collect_list("value").alias(harmless))
    last = waiting.drop(harmless).join(own, row, "left").drop(row)
    return done.unionAll(last.mapInArrow(tk.tidied(after), schema))


def spans_text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _candidates(column: pa.Array) -> list[bool]:
    return pc.match_substring_regex(tk.text_column(column), _MAY).to_pylist()


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(documents: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """One row per document: counts and digest of the fixed patterns' finds, and all spans."""

    def row(spans: list[tuple]) -> tuple:
        base = [s for s in spans if s[1] < 3]
        n = [sum(s[1] == k for s in base) for k in range(3)]
        return (*n, sha256(spans_text(base).encode()).hexdigest(), spans_text(spans))

    def finish(batch: pa.RecordBatch, found: list[list]) -> pa.RecordBatch:
        columns = list(zip(*map(row, found))) or [()] * 5
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = documents.select("doc_id", "text")
    with scratch(documents.sparkSession):
        return kept(_each(rows, written(corpus_words(rows), "words"), finish, SCANNED, min_cost), "secrets")


def masked(text: str, spans: list[tuple], mask: str = "[REDACTED]") -> str:
    """Every union of overlapping spans becomes one mask; a text without secrets is returned as it is."""
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(documents: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """All rows with secrets masked in ``text`` and ``n_chars`` (where there is one) set anew for rows that changed; other columns as they are."""

    def finish(batch: pa.RecordBatch, found: list[list]) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        changed = {i: new for i, spans in enumerate(found) if spans and (new := masked(texts[i], spans)) != texts[i]}
        if not changed:
            return batch
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns["n_chars"].to_pylist())], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return _each(documents, written(corpus_words(documents), "words"), finish, documents.schema, min_cost)
