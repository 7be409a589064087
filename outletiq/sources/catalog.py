"""Catalog and source helpers (SRC1–SRC4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_source(spark: SparkSession, path_or_table: str, fmt: str = "parquet",
                view: str | None = None, cache: bool = False, **options) -> DataFrame:
    """SRC1: read a table (catalog name) or a path; optionally register a view
    and cache it when several builders share it in one session."""
    is_path = "/" in path_or_table or ":" in path_or_table  # 'db.table' is a catalog name
    if is_path and fmt != "table":
        df = spark.read.format(fmt).options(**options).load(path_or_table)
    else:
        df = spark.table(path_or_table)
    if view:
        df.createOrReplaceTempView(view)
    return df.cache() if cache else df


def table_structure(spark: SparkSession, database: str | None = None) -> DataFrame:
    """SRC2: table, column, type and position for every table/view of a database.

    Catalog metadata is small by nature (one row per column), so it is listed
    through the catalog API and returned as a DataFrame.
    """
    rows = []
    for t in spark.catalog.listTables(database):
        name = t.name if not t.database else f"{t.database}.{t.name}"
        for i, c in enumerate(spark.catalog.listColumns(name if t.database else t.name)):
            rows.append((t.name, c.name, c.dataType, i + 1))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, ordinal_position int") \
        .orderBy("table_name", "ordinal_position")


def search_structure(structure: DataFrame, text: str) -> DataFrame:
    """SRC3: case-insensitive 'contains' on table or column name."""
    t = text.lower()
    return structure.where(F.lower("table_name").contains(t) | F.lower("column_name").contains(t))


def first_existing_table(spark: SparkSession, names: list[str]) -> str | None:
    """SRC4: the first of ``names`` that exists in the catalog."""
    for n in names:
        if spark.catalog.tableExists(n):
            return n
    return None
