"""Declared schemas of the graph's tables, their defaults and their checks.

Unsigned 32-bit columns are longs (Spark has no unsigned type), JSON columns are strings, and the
1536-wide embedding is an array whose length a check verifies. Parquet tables enforce neither keys nor
NOT NULL, so `violations` states both as a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
SYMBOL_KINDS = ("function", "class", "interface", "type", "enum", "variable")
SYMBOL_LANGUAGE = "typescript"
EDGE_KIND = "structural"
EMBEDDING_WIDTH = 1536

S, L, B, TS, FL = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType(), T.FloatType()
STRINGS = T.ArrayType(S)
RANGE_FIELDS = ("start_line", "start_col", "end_line", "end_col")
RANGE = T.StructType([T.StructField(n, L) for n in RANGE_FIELDS])


def _table(required: dict, optional: dict) -> T.StructType:
    return T.StructType([T.StructField(n, k, False) for n, k in required.items()] + [T.StructField(n, k, True) for n, k in optional.items()])


FILE = T.StructType(
    [
        *[T.StructField(n, S, False) for n in ("id", "path", "relative_path", "language")],
        T.StructField("loc", L, False),
        T.StructField("hash", S, False),
        T.StructField("last_indexed", TS, False),
        T.StructField("_schema_version", L, False),
        T.StructField("last_modified", TS),
        T.StructField("last_author", S),
        T.StructField("change_count_30d", L),
        T.StructField("is_core", B, False),
        T.StructField("tags", STRINGS),
        T.StructField("labels", STRINGS),
        T.StructField("metadata", S),
    ]
)
SYMBOL = T.StructType(
    [
        *[T.StructField(n, S, False) for n in ("id", "fqn", "name", "kind", "file_id")],
        T.StructField("range", RANGE, False),
        T.StructField("language", S, False),
        T.StructField("fan_in", L, False),
        T.StructField("is_core", B, False),
        T.StructField("flags", STRINGS),
        T.StructField("metrics", S),
        T.StructField("_schema_version", L),
        T.StructField("visibility", S),
        T.StructField("signature", S),
        T.StructField("return_type", S),
        T.StructField("parameter_types", STRINGS),
        T.StructField("docstring", S),
        T.StructField("diagnostics", S),
        T.StructField("embedding", T.ArrayType(FL)),
        T.StructField("tags", STRINGS),
        T.StructField("labels", STRINGS),
        T.StructField("metadata", S),
    ]
)
EDGE = _table({"id": S, "source_id": S, "target_id": S, "kind": S}, {"weight": FL, "metadata": S})
CALL_SITE = _table({"id": S}, {"caller_symbol_id": S, "callee_symbol_id": S, "file_id": S, "range": RANGE, "language": S, "metadata": S})
IMPORT_REF = _table({"id": S}, {"file_id": S, "import_path": S, "imported_symbol": S, "range": RANGE, "language": S, "metadata": S})
DIAGNOSTIC = _table({"id": S}, {"file_id": S, "symbol_id": S, "severity": S, "code": S, "message": S, "source": S, "range": RANGE, "metadata": S})

TABLES: dict[str, T.StructType] = {"file": FILE, "symbol": SYMBOL, "edge": EDGE, "call_site": CALL_SITE, "import_ref": IMPORT_REF, "diagnostic": DIAGNOSTIC}
#: Columns that are unique within a table.
UNIQUE = {"file": ("id", "path"), "symbol": ("id",), "edge": ("id",), "call_site": ("id",), "import_ref": ("id",), "diagnostic": ("id",)}
#: What a table's rows are sorted by within files, so that row-group statistics serve as indexes.
CLUSTERED = {"file": ("relative_path",), "symbol": ("file_id", "name"), "edge": ("source_id", "target_id"), "call_site": ("file_id",), "import_ref": ("file_id",), "diagnostic": ("file_id",)}

#: Columns with Bloom filters: those that rows are looked up by beside their bucket's.
SKIPPED = {"file": ("path", "relative_path"), "symbol": ("id", "fqn"), "edge": ("target_id",), "call_site": ("callee_symbol_id",), "diagnostic": ("symbol_id",)}

#: What tells a row's bucket.
BUCKETED = {"file": "id", "symbol": "file_id", "edge": "source_id", "call_site": "file_id", "import_ref": "file_id", "diagnostic": "file_id"}


def empty_list() -> Column:
    return F.array().cast("array<string>")


def defaults(table: str) -> dict[str, Column]:
    """The default of every column that has one; the others default to NULL."""
    return {
        "file": {"last_indexed": F.current_timestamp(), "_schema_version": F.lit(SCHEMA_VERSION).cast("long"), "is_core": F.lit(False), "tags": empty_list(), "labels": empty_list(), "metadata": F.lit("{}")},
        "symbol": {"fan_in": F.lit(0).cast("long"), "is_core": F.lit(False), "flags": empty_list(), "metrics": F.lit("{}"), "_schema_version": F.lit(SCHEMA_VERSION).cast("long")},
        "edge": {"metadata": F.lit("{}")},
        "call_site": {"metadata": F.lit("{}")},
        "import_ref": {"metadata": F.lit("{}")},
        "diagnostic": {"metadata": F.lit("{}")},
    }[table]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type: given ones cast, missing ones at their defaults."""
    given, known = set(df.columns), defaults(table)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in given else known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def violations(df: DataFrame, table: str) -> DataFrame:
    """(check, n) of every broken NOT NULL, width or uniqueness rule of the table; no row if all hold.

    Values are told apart by 128 bits of their hashes, so that no long keys are shuffled.
    """
    schema = TABLES[table]
    nulls = {f"{f.name} is null": F.col(f"`{f.name}`").isNull() for f in schema.fields if not f.nullable}
    if table == "symbol":
        nulls["range holds null"] = reduce(Column.__or__, [F.col(f"range.{n}").isNull() for n in RANGE_FIELDS])
        nulls["embedding width"] = F.col("embedding").isNotNull() & (F.size("embedding") != EMBEDDING_WIDTH)
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in nulls.items()])
    row_checks = counts.select(F.explode(F.create_map(*[x for n in nulls for x in (F.lit(n), F.col(f"`{n}`"))])).alias("check", "n"))
    doubles = [df.groupBy(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(table), c).alias("g")).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{c} is not unique").alias("check"), "n") for c in UNIQUE[table]]
    return reduce(DataFrame.unionByName, [row_checks, *doubles]).where("n > 0")
