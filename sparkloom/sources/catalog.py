"""Catalogue tables, views, attached databases and file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import folder

#: What a Spark type is called in the strict type system.
TYPE_NAMES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}


def table_info(df: DataFrame) -> DataFrame:
    """One row per column: cid, name, type, notnull, pk."""
    rows = [(k, f.name, TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()), int(not f.nullable), 0) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "cid long, name string, type string, notnull int, pk int")


def schema_table(spark: SparkSession) -> DataFrame:
    """type, name and tbl_name of every table and view of the session."""
    rows = [("view" if t.isTemporary or t.tableType == "VIEW" else "table", t.name, t.name) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "type string, name string, tbl_name string")


def create_view(spark: SparkSession, name: str, df: DataFrame, if_not_exists: bool = False) -> None:
    if not (if_not_exists and spark.catalog.tableExists(name)):
        df.createOrReplaceTempView(name)


def attach(spark: SparkSession, folder: str, alias: str, tables: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder as views ``alias_table``."""
    out = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}
    for t, df in out.items():
        df.createOrReplaceTempView(f"{alias}_{t}")
    return out


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = ",", null: str | None = None, line_breaks: bool = True) -> DataFrame:
    """An RFC 4180 file as a table: quotes double inside quotes, fields may hold line breaks. The schema is given, so nothing is read to infer it.

    Where no field holds a line break, say so: a large file is then read in parts.
    """
    reader = spark.read.schema(schema).option("header", header).option("multiLine", line_breaks).option("sep", sep).option("quote", '"').option("escape", '"')
    return (reader if null is None else reader.option("nullValue", null)).csv(path)


def copy_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """COPY's text format: tabs between fields, ``\\\\N`` for null."""
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)


def through_csv(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a table as CSV, to a new folder unless one is named, and reads it with its own schema."""
    path = path or folder(df.sparkSession, "csv")
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return read_csv(df.sparkSession, path, df.schema.simpleString()[7:-1].replace(":", " "), header=True)


#: Type numbers of another server's catalogue, by Spark type.
_OIDS = {"boolean": 16, "binary": 17, "bigint": 20, "smallint": 21, "int": 23, "string": 25, "float": 700, "double": 701, "date": 1082, "timestamp_ntz": 1114, "timestamp": 1184}


def pg_class(spark: SparkSession) -> DataFrame:
    """oid, relname and relkind (r: table, v: view) of every table of the session, as another server's catalogue has them."""
    rows = [(16384 + k, t.name, "v" if t.isTemporary or t.tableType == "VIEW" else "r") for k, t in enumerate(sorted(spark.catalog.listTables(), key=lambda t: t.name))]
    return spark.createDataFrame(rows, "oid int, relname string, relkind string")


def pg_attribute(spark: SparkSession, table: str) -> DataFrame:
    """attname, atttypid, attnum and attnotnull of a table's columns."""
    rows = [(f.name, _OIDS.get(f.dataType.simpleString(), 1700 if f.dataType.simpleString().startswith("decimal") else 25), k, not f.nullable) for k, f in enumerate(spark.table(table).schema, 1)]
    return spark.createDataFrame(rows, "attname string, atttypid int, attnum int, attnotnull boolean")
