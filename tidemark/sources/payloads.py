"""JSON payloads whose shape varies: a list, a list under ``items`` or ``data``, or one object that stands for a list of itself.

A payload is parsed once, into a VARIANT; shape, items and typed fields are read from that value, so nothing is guessed
from the text and no payload is parsed for each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIST = "array<variant>"
# Where a list may be wrapped.
WRAPPERS = ("items", "data")


def payload_shape(value: Column) -> Column:
    """``array``, the wrapper's name, ``object``, or null: broken text, scalars and lists that hold anything but objects and nulls."""
    shape, items = _shape_and_items(value)
    return F.when(_only_objects(items), shape)


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string, variant>").isNotNull()


def _shape_and_items(value: Column) -> tuple[Column, Column]:
    whole = F.try_variant_get(value, "$", _LIST)
    wrapped = [(name, F.try_variant_get(value, f"$.{name}", _LIST)) for name in WRAPPERS]
    shape = F.when(whole.isNotNull(), "array")
    for name, items in wrapped:
        shape = shape.when(items.isNotNull(), name)
    shape = shape.when(_is_object(value), "object")
    return shape, F.coalesce(whole, *(items for _, items in wrapped), F.when(_is_object(value), F.array(value)))


def _only_objects(items: Column) -> Column:
    return ~F.exists(items, lambda i: F.coalesce(~F.is_variant_null(i) & ~_is_object(i), F.lit(False)))


def list_items(df: DataFrame, payload: str, fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row for each item of each payload: the other columns, ``shape``, ``place`` from 0, and ``item``.

    ``fields``: column to path within an item and type, as in ``{"score": ("$.risk.score", "double")}``; values of another type
    are null. Null, blank and broken payloads and such of no shape give no rows, an empty list none
    either; a null in a list is an item whose fields are null. Columns named like results are replaced.
    """
    rest = [c for c in df.columns if c not in (payload, "shape", "place", "item", *(fields or {}))]
    parsed = df.withColumn("_value", F.try_parse_json(F.when(F.trim(F.col(payload).cast("string")) != "", F.col(payload).cast("string"))))
    shape, items = _shape_and_items(F.col("_value"))
    whole = parsed.select(*rest, shape.alias("shape"), items.alias("_items")).where("shape is not null").where(_only_objects(F.col("_items")))
    each = whole.select(*rest, "shape", F.posexplode("_items").alias("place", "item"))
    return each.withColumns({name: F.try_variant_get("item", path, kind) for name, (path, kind) in (fields or {}).items()})


def one_object(df: DataFrame, payload: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with the fields of payloads that are one object; all null where a payload is anything else."""
    value = F.try_parse_json(F.when(F.trim(F.col(payload).cast("string")) != "", F.col(payload).cast("string")))
    parsed = df.withColumn("_value", value).withColumn("_value", F.when(_is_object(F.col("_value")), F.col("_value")))
    return parsed.withColumns({name: F.try_variant_get("_value", path, kind) for name, (path, kind) in fields.items()}).drop("_value")
