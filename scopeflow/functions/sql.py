"""The engine's functions under names that SQL can call. All are SQL bodies that the optimizer sees through; none runs Python."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession, estate=None) -> list[str]:
    """Makes mask_pan, extract_id, is_yes, luhn_ok, and, with an estate, the table functions reach(system) and ancestors(system), for the session."""
    bodies = {
        "is_yes(s STRING) RETURNS BOOLEAN": "coalesce(lower(trim(s)) IN ('yes', 'y', 'true', '1'), false)",
        "extract_id(s STRING) RETURNS STRING": r"nullif(regexp_extract(trim(s), '^([0-9A-Z]{2,6})\\b', 1), '')",
        "luhn_ok(s STRING) RETURNS BOOLEAN": r"coalesce(s RLIKE '\\A[0-9]{13,19}\\z' AND luhn_check(s), false)",
        "mask_pan(s STRING) RETURNS STRING": "(SELECT if(length(d) < 10, repeat('x', length(d)), concat(substring(d, 1, 6), repeat('x', length(d) - 10), right(d, 4))) FROM (SELECT regexp_replace(s, '[^0-9]', '') AS d))",
    }
    if estate is not None:
        estate.pairs.createOrReplaceTempView("scopeflow_pairs")
        bodies["reach(system STRING) RETURNS TABLE (id STRING, hops INT)"] = "SELECT dst, hops FROM scopeflow_pairs WHERE src = system AND dst <> system"
        bodies["ancestors(system STRING) RETURNS TABLE (id STRING, hops INT)"] = "SELECT src, hops FROM scopeflow_pairs WHERE dst = system AND src <> system"
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
