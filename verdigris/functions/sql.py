"""The scalar rules as functions of SQL, for queries in text. Spark puts their bodies in place, so they cost no more."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: (name, parameters, type, body).
FUNCTIONS = (
    ("positive_fading", "layers DOUBLE, level DOUBLE", "DOUBLE", "exp(-(level - 0.5D) * (0.7D * power(exp(1D), 2D)) / layers)"),
    ("negative_fading", "layers DOUBLE, level DOUBLE", "DOUBLE", "1D / (1D + exp((level - 0.5D - layers / 2D) * (10D / layers)))"),
    ("ring_impact", "impact DOUBLE, layers DOUBLE, level DOUBLE", "DOUBLE", "CASE WHEN level = 0 THEN impact ELSE rint((CASE WHEN impact > 0 THEN positive_fading(layers, level) ELSE negative_fading(layers, level) END) * impact * 10D) / 10D + 0D END"),
    ("danger_impact", "danger INT", "INT", "CASE danger WHEN 1 THEN -10 WHEN 2 THEN -8 WHEN 3 THEN -6 WHEN 4 THEN -4 ELSE -2 END"),
    ("danger_fading", "danger INT", "DOUBLE", "CASE danger WHEN 1 THEN 0.8D WHEN 2 THEN 0.6D WHEN 3 THEN 0.4D WHEN 4 THEN 0.2D ELSE 0.1D END"),
    ("impact_radius", "impact DOUBLE, fading DOUBLE, factor DOUBLE", "DOUBLE", "rint(impact * fading * factor * 1000D * 10D) / 10D + 0D"),
    ("quantised", "value DOUBLE, step DOUBLE", "DOUBLE", "rint(value / step) * step + 0D"),
)


def register(spark: SparkSession, prefix: str = "vg_") -> list[str]:
    """Make the functions known to the session, under names with a prefix, in place of earlier ones; gives the names."""
    known = [name for name, *_ in FUNCTIONS]
    for name, parameters, kind, body in FUNCTIONS:
        for other in known:
            body = body.replace(f"{other}(", f"{prefix}{other}(")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in known]
