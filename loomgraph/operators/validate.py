"""Checks of messages between a view and its host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST_SAFE = 9007199254740991


def may_navigate(file_path: Column, line: Column, kind: Column, root: Column) -> Column:
    """Whether a typed navigate message is valid: an absolute path within root that holds no `..`, and a whole line from 0 on."""
    absolute = file_path.startswith("/") | file_path.rlike(r"^[A-Za-z]:[/\\]")
    under = (file_path == root) | file_path.startswith(F.concat(root, F.lit("/")))
    number = line.cast("double")
    whole = (number == F.floor(number)) & (number >= 0) & (number <= LARGEST_SAFE)
    valid = (root != "") & (kind == "navigate") & (file_path != "") & absolute & ~file_path.contains("..") & under & whole
    return F.coalesce(valid, F.lit(False))


def navigate_message(message: Column, root: Column) -> Column:
    """The same for a message as JSON text: its parts must also have the right JSON types."""
    parsed = F.try_parse_json(message)
    kind_of = lambda part: F.schema_of_variant(F.try_variant_get(parsed, part, "variant"))
    path = F.when(kind_of("$.filePath") == "STRING", F.try_variant_get(parsed, "$.filePath", "string"))
    line = F.when(~kind_of("$.line").isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(parsed, "$.line", "double"))
    kind = F.when(kind_of("$.type") == "STRING", F.try_variant_get(parsed, "$.type", "string"))
    return may_navigate(path, line, kind, root)


def is_from_host(kind: Column) -> Column:
    return F.coalesce(kind == "symbols", F.lit(False))


def is_from_view(kind: Column) -> Column:
    """Only navigate: `ready` is handled before this check."""
    return F.coalesce(kind == "navigate", F.lit(False))
