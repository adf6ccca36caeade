"""Column functions on text: flags, identifiers, and masking of card-like numbers. All are native expressions.

``\\d`` is ASCII here.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a run of 13 to 19 digits, each with at most one space or dash after it, between non-digits.
RUN = r"(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])"
# Fixed value: texts that count as yes, in any case.
YES = ("yes", "y", "true", "1")


def is_yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*YES), F.lit(False))


def extract_id(c: Column) -> Column:
    """2 to 6 of 0-9A-Z at the start, then a word boundary; else null."""
    found = F.regexp_extract(F.trim(c), r"^([0-9A-Z]{2,6})\b", 1)
    return F.when(found != "", found)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    n = F.length(digits)
    return F.coalesce(digits.rlike(r"\A[0-9]{13,19}\z") & F.call_function("luhn_check", digits) & n.between(13, 19), F.lit(False))


def mask_pan(c: Column) -> Column:
    """First six and last four digits stay; with fewer than ten digits, none."""
    d = digits_of(c)
    n = F.length(d)
    return F.when(n < 10, F.repeat(F.lit("x"), n)).otherwise(F.concat(F.substring(d, 1, 6), F.repeat(F.lit("x"), n - 10), F.substring(d, -4, 4)))


def is_unmasked_pan(c: Column) -> Column:
    bare = F.regexp_replace(c, "[ -]", "")
    return F.coalesce(bare.rlike(r"\A[0-9]+\z") & luhn_ok(bare), F.lit(False))


def runs(c: Column) -> Column:
    """All runs of digits that may be a card number; a run takes one separator after its last digit with it."""
    return F.regexp_extract_all(c, F.lit(f"({RUN})"), F.lit(1))


def card_runs(c: Column) -> Column:
    return F.filter(runs(c), lambda r: luhn_ok(digits_of(r)))


def sanitize_text(c: Column) -> Column:
    """Every run whose digits pass the check is masked; a text that is masked already stays as it is.

    The text is cut at its runs and put together again with the masked ones, so equal digits elsewhere are not touched.
    """
    pieces = F.split(c, RUN, -1)
    between = F.transform(runs(c), lambda r: F.when(luhn_ok(digits_of(r)), mask_pan(r)).otherwise(r))
    whole = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(between, i), F.lit(""))))
    return F.when(F.size(runs(c)) > 0, F.array_join(whole, "")).otherwise(c)


def _sanitize_again(once: Column) -> Column:
    """A sanitized text, sanitized until no run passes the check: the six or four digits that a mask leaves may make a new run with digits beside it.

    A pass that masks takes three digits at the least, which bounds the passes; those after the last one that finds a run only hand the text on.
    """

    def again(state: Column, _: Column) -> Column:
        text = sanitize_text(state["text"])
        return F.when(state["left"], F.struct(text.alias("text"), (text != state["text"]).alias("left"))).otherwise(state)

    passes = F.sequence(F.lit(1), F.floor(F.length(digits_of(once)) / 3) + 1)
    start = F.struct(once.alias("text"), F.lit(True).alias("left"))
    return F.when(F.size(card_runs(once)) > 0, F.aggregate(passes, start, again)["text"]).otherwise(once)


def mask_all_cells(df: DataFrame) -> DataFrame:
    """Every string column masked until it holds no card number; ``masked_cells`` counts the row's cells that changed."""
    names = [c for c, t in df.dtypes if t == "string"]
    changed = reduce(add, [F.coalesce((sanitize_text(F.col(f"`{c}`")) != F.col(f"`{c}`")).cast("int"), F.lit(0)) for c in names], F.lit(0))
    once = df.withColumn("masked_cells", changed).withColumns({c: sanitize_text(F.col(f"`{c}`")) for c in names})
    return once.withColumns({c: _sanitize_again(F.col(f"`{c}`")) for c in names})


def scan_for_leaks(df: DataFrame, key: str) -> DataFrame:
    """One row per card number found: the row's key, the column, the masked number and its masked context of up to 60 characters."""
    names = [c for c, t in df.dtypes if t == "string" and c != key]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell")) for c in names]))
    rows = df.select(F.col(key), cells.alias("x")).select(key, "x.column", "x.cell").where(F.col("cell").rlike(RUN))
    found = rows.withColumn("run", F.explode(card_runs(F.col("cell"))))
    return found.select(key, "column", mask_pan(F.col("run")).alias("masked"), F.substring(sanitize_text(F.col("cell")), 1, 60).alias("context"))


class PanLeakError(RuntimeError):
    """Card numbers got through."""


def raise_if_leaked(leaks: DataFrame) -> None:
    first = leaks.select("column", "masked").take(5)
    if first:
        raise PanLeakError("unmasked card numbers: " + "; ".join(f"{r['column']} {r['masked']}" for r in first))


def token_estimate(*texts: Column) -> Column:
    return F.floor(reduce(add, [F.length(F.coalesce(t, F.lit(""))) for t in texts]) / 4)


def any_of(*flags: Column) -> Column:
    return reduce(or_, [F.coalesce(f, F.lit(False)) for f in flags])
