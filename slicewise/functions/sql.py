"""The scalar operators as temporary SQL functions.

Their bodies are SQL expressions, so Catalyst inlines them like any other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from slicewise import constants as K

_TITLE = r"""array_join(transform(split(s, ''), (ch, i) ->
    CASE WHEN i > 0 AND get(split(s, ''), i - 1) RLIKE '^\\p{L}$' THEN lower(ch) ELSE upper(ch) END), '')"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _first_contained(column: str, table: dict, otherwise: str) -> str:
    cases = " ".join(f"WHEN contains({column}, {_text(k)}) THEN {_text(v) if isinstance(v, str) else f'{v}D'}"
                     for k, v in table.items())
    return f"CASE {cases} ELSE {otherwise} END"


def _location() -> str:
    key = "lower(btrim(raw))"
    exact = " ".join(f"WHEN {key} = {_text(k)} THEN {_text(v)}" for k, v in K.DEPARTMENTS.items())
    rest = _first_contained(key, K.DEPARTMENTS, "title_text(btrim(raw))")
    return f"CASE WHEN raw IS NULL OR raw = '' THEN 'Unknown' {exact} ELSE {rest} END"


def _score() -> str:
    def hits(words: list[str]) -> str:
        return " + ".join(f"CAST(contains(lower(d), {_text(w)}) AS INT)" for w in words)
    return f"({hits(K.WANTED_SERIES_WORDS)}) - 2 * ({hits(K.UNWANTED_SERIES_WORDS)})"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, body)."""
    return {
        "title_text": ("s STRING", "STRING", _TITLE),
        "department_location": ("raw STRING", "STRING", _location()),
        "indication_prior": ("t STRING", "DOUBLE",
                             _first_contained("lower(coalesce(t, ''))", K.INDICATION_PRIORS, f"{K.DEFAULT_PRIOR}D")),
        "series_description_score": ("d STRING", "INT", _score()),
        "compact_date": ("d STRING", "STRING",
                         "CASE WHEN d RLIKE '^[0-9]{8}$' THEN concat_ws('-', substring(d, 1, 4), substring(d, 5, 2), "
                         "substring(d, 7, 2)) ELSE '' END"),
        "hu_window": ("v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE",
                      "greatest(0D, least(1D, (v - low) / (high - low)))"),
        "sigmoid": ("x DOUBLE", "DOUBLE", "1D / (1D + exp(-x))"),
        "trailing_number": ("s STRING", "INT", "try_cast(substring_index(s, '-', -1) AS INT)"),
        "label_image": ("id STRING", "STRING", "substring_index(id, '_', 2)"),
        "label_class": ("id STRING", "STRING", "get(split(id, '_'), 2)"),
        "prevalence_rate": ("n BIGINT, pos BIGINT, min_n INT", "DOUBLE",
                            "CASE WHEN n >= min_n AND n > 0 THEN round(pos / n, 6) END"),
        "worklist_tier": ("stat BOOLEAN, positive BOOLEAN", "INT",
                          "CASE WHEN coalesce(stat, false) THEN 0 WHEN coalesce(positive, false) THEN 1 ELSE 2 END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (params, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(definitions())
