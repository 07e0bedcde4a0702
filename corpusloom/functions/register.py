"""The text functions under names of SQL, for sessions that query in it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom.functions import text as X

VECTORISED = {"loom_nfc": X.nfc, "loom_unescape_html": X.unescape_html, "loom_strip_diacritics": X.strip_diacritics, "loom_casefold": X.casefold, "loom_has_diacritics": X.has_diacritics}

# Expressions of the JVM, as SQL functions of one text.
EXPRESSIONS = {
    "loom_ascii_fold": ("STRING", f"translate(t, '{X.FOLD_FROM}', '{X.FOLD_TO}')"),
    "loom_strip_tags": ("STRING", "regexp_replace(t, '<[^>]+>', ' ')"),
    "loom_collapse": ("STRING", r"trim(regexp_replace(t, '(?U)\\s+', ' '))"),
    "loom_quarter_tokens": ("INT", "greatest(1, CAST(floor(length(t) / 4) AS INT))"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and returns their names."""
    for name, f in VECTORISED.items():
        spark.udf.register(name, f)
    for name, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return sorted([*VECTORISED, *EXPRESSIONS])
