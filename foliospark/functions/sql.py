"""Extension: the scalar operators as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions; their bodies are expressions that Catalyst inlines, no UDFs."""
    bodies = {
        "heading_level(line STRING) RETURNS INT": r"nullif(length(regexp_extract(regexp_replace(line, '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', ''), '(?U)^(#{1,10})[\\s\\x1c-\\x1f]', 1)), 0)",
        "squeeze(t STRING) RETURNS STRING": r"trim(regexp_replace(t, '(?U)[\\s\\x1c-\\x1f]+', ' '))",
        "split_at_heading(t STRING, level INT) RETURNS ARRAY<STRING>": r"split(coalesce(t, ''), concat('\\n(?=', repeat('#', level), ' )'))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
