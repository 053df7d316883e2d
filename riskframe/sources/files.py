"""Readers and writers: CSV, parquet, JSON documents, JSON lines, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order and decimals of the threshold tables.
THRESHOLD_COLUMNS = {
    "threshold": 2, "tn": None, "fp": None, "fn": None, "tp": None, "precision": 6, "recall": 6,
    "f1": 6, "accuracy": 6, "specificity": 6, "npv": 6, "total_cost": 2, "average_cost": 6,
    "cost_per_predicted": 6,
}
RETENTION_COLUMNS = {
    **THRESHOLD_COLUMNS, "net_business_value": 2, "expected_churn_loss": 2,
    "expected_intervention_cost": 2, "expected_retained_value": 2,
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """CSV with a header and a given schema; ``corrupt`` names a column for unparsable lines."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV by file name; a path without a known suffix is parquet."""
    if path.endswith(".csv"):
        if schema is None:
            header = spark.read.option("header", True).csv(path)
            return header
        return read_csv(spark, path, schema)
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table partitioned by split (only its files are read)."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def schema_columns(spark: SparkSession, path: str, numeric: Sequence[str], skip: Sequence[str]) -> list[str]:
    """Categorical columns of a parquet table from its footer."""
    known = {*numeric, *skip}
    return [f.name for f in spark.read.parquet(path).schema.fields if f.name not in known]


def formatted(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """The given columns as text with fixed decimals."""
    return df.select(
        *[
            (F.col(c).cast("string") if d is None else F.format_string(f"%.{d}f", F.col(c))).alias(c)
            for c, d in columns.items()
        ]
    )


def write_result_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A result table as one CSV file with a header. For tables of thresholds or scenarios only."""
    out = df.orderBy(*order) if order else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_threshold_csv(costed: DataFrame, path: str) -> None:
    """The threshold table of one scenario with its fixed columns and decimals."""
    columns = RETENTION_COLUMNS if "net_business_value" in costed.columns else THRESHOLD_COLUMNS
    write_result_csv(formatted(costed, columns), path, ["threshold"])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text document in any file system Spark can reach."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    if row is None:
        raise FileNotFoundError(path)
    return row["value"].rstrip("\n")


def append_events(events: DataFrame, path: str) -> None:
    """Append telemetry events as JSON lines."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.telemetry import EVENT_SCHEMA

    return spark.read.schema(EVENT_SCHEMA).json(path)


# ------------------------------------------------------------ integrity


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256)`` of every data file under ``path``; hashing runs in the tasks."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return files.select(
        name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def tree_digest(spark: SparkSession, path: str) -> str:
    """One hash for a folder: over the sorted relative names and hashes below it.

    Meant for model folders, whose list of files is short.
    """
    digests = file_digests(spark, path)
    # names relative to the folder, so that a file moved or swapped inside it changes the hash
    folder = f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"
    line = F.concat_ws(":", F.substring_index("file", folder, -1), "sha256")
    return digests.agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("h")
    ).first()["h"]


def manifest_report(
    df: DataFrame, rows: int | None = None, columns: int | None = None, digest: str | None = None,
    expected_digest: str | None = None,
) -> DataFrame:
    """``(check, expected, actual, ok)`` for row count, column count and file hash."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    lines = []
    if rows is not None:
        lines.append(("row_count", str(rows), F.col("n").cast("string")))
    if columns is not None:
        lines.append(("column_count", str(columns), F.lit(str(len(df.columns)))))
    if expected_digest is not None:
        lines.append(("sha256", expected_digest, F.lit(digest)))
    cells = [
        F.struct(F.lit(c).alias("check"), F.lit(e).alias("expected"), a.alias("actual")) for c, e, a in lines
    ]
    return n.select(F.explode(F.array(*cells)).alias("c")).select(
        "c.*", F.col("c.expected").eqNullSafe(F.col("c.actual")).alias("ok")
    )
