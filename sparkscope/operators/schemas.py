"""Schema evolution of tables, and compatibility of registered JSON schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The widenings a table may go through.
WIDENINGS = {
    (T.IntegerType, T.LongType),
    (T.IntegerType, T.FloatType),
    (T.IntegerType, T.DoubleType),
    (T.LongType, T.DoubleType),
    (T.FloatType, T.DoubleType),
}


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether values of ``old`` may be kept as ``new``: the same type or a widening, also inside."""
    if old == new or (type(old), type(new)) in WIDENINGS:
        return True
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return widens(old.elementType, new.elementType)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return widens(old.keyType, new.keyType) and widens(old.valueType, new.valueType)
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return not conflicts(old, new)
    return False


def conflicts(old: T.StructType, new: T.StructType) -> list[str]:
    """What keeps data of ``old`` out of a table of ``new``; empty when it fits."""
    found = []
    before = {f.name: f for f in old.fields}
    after = {f.name: f for f in new.fields}
    for name, field in after.items():
        if name not in before:
            if not field.nullable:
                found.append(f"{name}: a new field must be nullable")
        elif not widens(before[name].dataType, field.dataType):
            found.append(f"{name}: {before[name].dataType.simpleString()} to {field.dataType.simpleString()}")
        elif before[name].nullable and not field.nullable:
            found.append(f"{name}: nullable may not become required")
    found += [f"{name}: is missing from the new schema" for name in before if name not in after]
    return found


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the evolved schema: new columns are null, widened columns are cast."""
    found = conflicts(df.schema, schema)
    if found:
        raise ValueError("incompatible schema: " + "; ".join(found))
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def compatibility(pairs: DataFrame) -> DataFrame:
    """Judge pairs of JSON schemas (``mode``, ``old``, ``new`` as text) against the mode.

    Backward: no property of the old schema is missing from the new one. Forward: no
    property that the new schema adds is marked required. Full: both. None: always.
    """
    properties = lambda c: F.from_json(F.get_json_object(c, "$.properties"), "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    judged = pairs.withColumns(
        {
            "_old": F.coalesce(properties(F.col("old")), empty),
            "_new": F.coalesce(properties(F.col("new")), empty),
        }
    )
    missing = F.array_sort(F.array_except(F.map_keys("_old"), F.map_keys("_new")))
    added = F.array_except(F.map_keys("_new"), F.map_keys("_old"))
    demanding = F.array_sort(
        F.filter(added, lambda k: F.get_json_object(F.col("_new")[k], "$.required") == "true")
    )
    judged = judged.withColumns({"missing": missing, "demanding": demanding})
    backward, forward = F.size("missing") == 0, F.size("demanding") == 0
    ok = (
        F.when(F.col("mode") == "Backward", backward)
        .when(F.col("mode") == "Forward", forward)
        .when(F.col("mode") == "Full", backward & forward)
        .otherwise(F.lit(True))
    )
    return judged.withColumn("compatible", ok).drop("_old", "_new")
