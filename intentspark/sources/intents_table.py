"""The intents table: replace it from a DataFrame, read it through a SQL
projection (SRC-4, SRC-5).

Two back ends: a catalog table (parquet at a given location, declared
column types kept) and JDBC (any database the caller names; connection
options, credentials included, come from the caller). The declared types
are applied in both, so a later ``=`` filter on the text columns works.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark import domain

INTENT_COLUMNS = ("Id", "Sentence", "Category")
DEFAULT_QUERY = "SELECT Id, Sentence, Category FROM {table}"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("Id").cast("long").alias("Id"),
                     F.col("Sentence").cast("string").alias("Sentence"),
                     F.col("Category").cast("string").alias("Category"))


def _columns(spark: SparkSession, name: str) -> list[tuple]:
    rows = spark.sql(f"DESCRIBE TABLE {name}").collect()
    return [(r["col_name"], r["data_type"]) for r in rows]


def replace_table(df: DataFrame, name: str, location: str, ddl: str = domain.INTENTS_TABLE_DDL) -> None:
    """SRC-5 (catalog): the table ``name`` with the columns ``ddl`` holds the rows
    of ``df`` (no index column) afterwards. The default types hold any id and any
    text; with narrower ones (``Id INT, Sentence VARCHAR(1024), ...``) a value
    that does not fit fails the write.

    The rows are written to a new folder under ``location`` through a table of
    their own, and only then does ``name`` point to them: a write that fails
    leaves the old table as it was, and ``df`` may read the old table. With the
    same columns the change is one step in the catalog, else, and where there
    are CHAR or VARCHAR columns, which a new location would turn into plain
    strings in the catalog, the old table is dropped and declared anew there. Folders of earlier contents stay for those
    who still read them."""
    spark = df.sparkSession
    version = uuid.uuid4().hex[:12]
    folder, staged = f"{location.rstrip('/')}/version-{version}", f"{name}_{version}"
    spark.sql(f"CREATE TABLE {staged} ({ddl}) USING parquet LOCATION '{folder}'")
    try:
        _typed(df).write.insertInto(staged, overwrite=True)
        columns = _columns(spark, staged)
        sized = any(kind.startswith(("char", "varchar")) for _, kind in columns)
        if not sized and spark.catalog.tableExists(name) and _columns(spark, name) == columns:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet LOCATION '{folder}'")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")  # its folder stays
    spark.catalog.refreshTable(name)


def read_table_query(spark: SparkSession, name: str, query: str = DEFAULT_QUERY) -> DataFrame:
    """SRC-4 (catalog): the table through a SQL projection (no order)."""
    return spark.sql(query.format(table=name))


def replace_intents_jdbc(df: DataFrame, url: str, table: str = "intents",
                         options: dict | None = None, ddl: str | None = None) -> None:
    """SRC-5 (JDBC): overwrite ``table``; ``ddl`` (e.g. ``Sentence VARCHAR(1024)``)
    declares column types other than the database's for long and string."""
    w = _typed(df).write.mode("overwrite").format("jdbc").option("url", url).option("dbtable", table)
    if ddl:
        w = w.option("createTableColumnTypes", ddl)
    w.options(**(options or {})).save()


def read_intents_jdbc(spark: SparkSession, url: str, table: str = "intents",
                      query: str | None = None, options: dict | None = None,
                      partitions: int | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """SRC-4 (JDBC): read through a projection. With ``partitions`` and
    ``bounds`` the table is read in parallel ranges of ``Id``; one without
    the other is an error, not a read by one task."""
    if bool(partitions) != bool(bounds):
        raise ValueError("give partitions and bounds together")
    r = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if partitions and bounds:
        r = (r.option("dbtable", f"({query or DEFAULT_QUERY.format(table=table)}) q")
             .option("partitionColumn", "Id").option("numPartitions", partitions)
             .option("lowerBound", bounds[0]).option("upperBound", bounds[1]))
    else:
        r = r.option("query", query or DEFAULT_QUERY.format(table=table))
    return r.load()
