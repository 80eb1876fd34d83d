"""Keep only scalar metadata values (string, number, boolean)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata_scalars(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """``(key, key, value)`` -- the row key, then the entry's key -- for each top-level entry of a JSON object whose value is a
    string, number or boolean; arrays, objects and nulls are dropped (a string that looks
    like a list is kept). Values are rendered as text, strings without quotes."""
    # A JSON object parsed to VARIANT and cast to MAP<STRING, VARIANT> keeps each value's
    # own type, so a string "[s]" and an array [1] stay distinguishable.
    # Anything but an object gives no entries.
    obj = F.try_variant_get(F.try_parse_json(json_col), "$", "map<string,variant>")
    if key in ("key", "value"):
        raise ValueError("the row key may not be named 'key' or 'value'")
    ex = df.select(key, F.explode(obj).alias("key", "value"))
    kind = F.schema_of_variant("value")
    keep = ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"))
    return ex.where(F.col("value").isNotNull() & keep).select(
        key, "key", F.variant_get("value", "$", "string").alias("value"))


def scalar_json(json_col: str | Column) -> Column:
    """B3/F14 as a column: the JSON object with its scalar entries only (numbers and booleans keep their type); NULL
    if it is no object."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    obj = F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")

    def scalar(_, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return v.isNotNull() & ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"))

    return F.to_json(F.map_filter(obj, scalar))


def metadata_map(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """``(key, metadata MAP<STRING,STRING>)`` of the scalar entries."""
    s = metadata_scalars(df, key, json_col)
    return s.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("key", "value")))
                              .alias("metadata"))
