"""Sinks: JSON lines, CSV and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.browse import first_location, paths

#: Fields of an exported record, in order.
FIELDS = ("id", "sha256", "status", "has_text", "text_kind", "category", "language", "model", "tiled", "gated", "derivative", "duration_ms", "first_seen_at", "finished_at", "error", "paths", "text", "context")
#: Fields of an exported record that are true or false, and those of them that are never null.
TRUTHS, SETTLED = ("has_text", "tiled", "gated", "derivative"), ("tiled", "gated", "derivative")
_TIME = "yyyy-MM-dd'T'HH:mm:ss"


def export_records(photos: DataFrame, locations: DataFrame, status: str | None = "done") -> DataFrame:
    """Records of rows not trashed, hidden ones included, of one status or, with ``all`` or None, of every one.

    ``paths`` is an array, empty without a location; fields that the table lacks are null; ``has_text`` keeps its null, the other truths are false for it.
    """
    rows = photos.where(F.col("deleted_at").isNull())
    rows = rows if status in (None, "all") else rows.where(F.col("status") == status)
    met = rows.join(paths(locations), "id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    met = met.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in SETTLED else F.col(c).cast("boolean") for c in TRUTHS if c in met.columns})
    return met.select(*[F.col(c) if c in met.columns else F.lit(None).cast("string").alias(c) for c in FIELDS])


def write_jsonl(records: DataFrame, path: str) -> None:
    """One object a line, all fields present, nulls kept; ordered by id over all files."""
    records.orderBy("id").write.option("ignoreNullFields", "false").option("timestampNTZFormat", _TIME).json(path)


def _listed(values: Column) -> Column:
    """An array of strings as the text of a list: ``['a', 'b']``, with double quotes about what holds single ones only."""

    def one(x: Column) -> Column:
        safe = x
        for old, new in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            safe = F.replace(safe, F.lit(old), F.lit(new))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ", "), F.lit("]"))


def csv_rows(records: DataFrame) -> DataFrame:
    """Records as text: truths as ``True`` and ``False``, arrays as the text of a list, nulls empty."""

    def one(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return _listed(F.col(name))
        if kind == "boolean":
            return F.initcap(F.col(name).cast("string"))
        return F.date_format(name, _TIME) if kind.startswith("timestamp") else F.col(name).cast("string")

    return records.select(*[F.coalesce(one(n, t), F.lit("")).alias(n) for n, t in records.dtypes])


def write_csv(records: DataFrame, path: str) -> None:
    """With a header in every file, quotes doubled within quotes; ordered by id over all files."""
    csv_rows(records.orderBy("id")).write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def duplicates_json(groups: DataFrame, photos: DataFrame, locations: DataFrame) -> DataFrame:
    """``cluster, members``: each group as a JSON array of its files, by id, nulls kept."""
    rows = groups.select("cluster", "id").join(photos.select("id", "byte_size", F.date_format("date_taken", _TIME).alias("date_taken")), "id").join(first_location(locations), "id", "left")
    members = F.array_sort(F.collect_list(F.struct("id", "path", "byte_size", "date_taken")))
    return rows.groupBy("cluster").agg(F.to_json(members, {"ignoreNullFields": "false"}).alias("members"))


def snapshot(table: DataFrame, root: str, name: str, version: int) -> str:
    """Write a table as a new version; readers of older versions are not disturbed. Returns its path."""
    path = f"{root.rstrip('/')}/{name}/v{version:06d}"
    table.write.parquet(path)
    return path


def backup(tables: dict[str, DataFrame], root: str, version: int) -> dict[str, str]:
    """Every table as one version, before a migration; returns their paths."""
    return {name: snapshot(table, root, name, version) for name, table in tables.items()}


def restore(spark, root: str, names: list[str], version: int) -> dict[str, DataFrame]:
    """The tables as they were backed up."""
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}/v{version:06d}") for name in names}
