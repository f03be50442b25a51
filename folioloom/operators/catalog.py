"""The document catalog: upsert, listing, checks and lenient values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(catalog: DataFrame, entries: DataFrame, key: str = "document_id") -> DataFrame:
    """``entries`` replace the rows of ``catalog`` with their key; other rows stay."""
    return catalog.join(entries.select(key).distinct(), key, "left_anti").unionByName(entries, allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The last row of every key by the given columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*key, "r.*").select(*rows.columns)


def missing_paths(entries: DataFrame, present: DataFrame) -> DataFrame:
    """(document_id, path): listed paths that no file has."""
    return entries.select("document_id", F.explode("paths").alias("path")).distinct().join(present.select("path"), "path", "left_anti").select("document_id", "path")


def without_empty(values: Column) -> Column:
    """A string map without null and empty values."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


def merged(*maps: Column) -> Column:
    """Maps laid over each other; later ones win."""
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def lenient_int(value: Column) -> Column:
    """The value as an integer, 0 where it is none."""
    return F.coalesce(value.try_cast("double").cast("bigint"), F.lit(0))


def flag(value: Column) -> Column:
    """Whether a text says yes."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("1", "true", "yes", "y", "on")


def lenient_number(value: Column) -> Column:
    """The value as a number, 0 where it is none."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def strict(value: Column, kind: str, name: str) -> Column:
    """The value as ``kind``; anything else, null included, is an error that names the field."""
    cast = value.try_cast(kind)
    return F.when(cast.isNotNull(), cast).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be {kind}, got "), F.coalesce(value.cast("string"), F.lit("null")))).cast(kind))


def optional(value: Column, kind: str = "string") -> Column:
    """The value as ``kind``, null where it is missing or blank; a filled value of another kind is an error."""
    filled = F.when(F.trim(value.cast("string")) != "", value)
    return F.when(filled.isNotNull(), filled.cast(kind))


def by_index_root(files: DataFrame) -> DataFrame:
    """(document_id, path): index manifests below a folder, one per document; the last one modified counts."""
    found = files.where("stem LIKE '%manifest%' OR folder LIKE '%/_manifest'").where("extension = 'json'")
    named = found.withColumn("document_id", F.regexp_extract("folder", r"([^/]+?)(?:/_manifest)?$", 1))
    return named.groupBy("document_id").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
