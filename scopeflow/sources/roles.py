"""CSV inputs by role: inventory, edges, survey and log findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeflow.functions import text as tx

# Name patterns of each role, tried in this order, and the headers that mark a role.
FILE_PATTERNS = {
    "DS1": ("ds1", "pci_to_pci", "pci to pci"),
    "DS2": ("ds2", "downstream"),
    "DS3": ("ds3", "upstream"),
    "DS4": ("ds4", "bam_report", "cardholder"),
    "DS5": ("ds5", "survey", "cde_end_state", "end state"),
    "DS6": ("ds6", "splunk", "pan_in"),
}
INVENTORY_KEY = "application_mnemonic_distributed_id"
LOG_KEYS = ("appid", "findings in sept - december logs")
SURVEY_KEY, SURVEY_UPSTREAM, SURVEY_DOWNSTREAM = "combo_distr_main_id", "upstream - dependency", "downstream - dependency"
EDGE_KEYS = ("parent app id", "child app id")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; quoted cells may hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, enforceSchema=False)


def norm_headers(df: DataFrame) -> DataFrame:
    """Names lower-cased and trimmed, texts trimmed, null as empty."""
    out = df.toDF(*[c.strip().lstrip("﻿").lower() for c in df.columns])
    return out.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in out.dtypes])


def role_by_header(columns: list[str]) -> str:
    keys = {c.strip().lower() for c in columns}
    if {INVENTORY_KEY, "pci"} <= keys:
        return "DS4"
    if set(LOG_KEYS) <= keys:
        return "DS6"
    if SURVEY_KEY in keys and any(k.startswith(SURVEY_UPSTREAM) for k in keys):
        return "DS5"
    return "DS1" if set(EDGE_KEYS) <= keys else "UNKNOWN"


def role_by_name(name: Column) -> Column:
    """The first role one of whose patterns is in the name; null if none is."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for role, patterns in reversed(FILE_PATTERNS.items()):
        out = F.when(tx.any_of(*[low.contains(p) for p in patterns]), F.lit(role)).otherwise(out)
    return out


def role_of(name: str, columns: list[str]) -> str:
    low = name.lower()
    return next((role for role, patterns in FILE_PATTERNS.items() if any(p in low for p in patterns)), None) or role_by_header(columns)


def role_by_ui_name(name: Column) -> Column:
    """The looser rule of upload forms: ``ds``, perhaps a separator, and a digit from 1 to 6."""
    found = F.regexp_extract(name, r"(?i)ds[ _-]?([1-6])", 1)
    return F.when(found != "", F.concat(F.lit("DS"), found))


def ingest(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """Role -> rows of all its files (masked), for file names and their paths; edges of the three edge roles are united under ``edges``.

    ``quality`` has a row for each file: its name, role, rows and masked cells.
    """
    found: dict[str, DataFrame] = {}
    quality = None
    for name, path in files.items():
        raw = norm_headers(read_csv(spark, path))
        role = role_of(name, raw.columns)
        rows = tx.mask_all_cells(raw)
        stats = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("masked_cells"), F.lit(0)).alias("masked_cells")).select(F.lit(name).alias("file"), F.lit(role).alias("role"), "rows", "masked_cells")
        quality = stats if quality is None else quality.unionAll(stats)
        rows = rows.drop("masked_cells")
        if role in ("DS1", "DS2", "DS3"):
            role, rows = "edges", rows.withColumn("_source_dataset", F.lit(role))
        if role != "UNKNOWN":
            found[role] = found[role].unionByName(rows, allowMissingColumns=True) if role in found else rows
    return found | {"quality": quality}
