"""Scans. Schemas are declared; of CSV only the header is read first, and of chunks
without a schema the footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.session import setting
from abacist.sources import schemas

# Where a row of a text file stands: columns to order by.
FILE_ORDER = ["_file", "_block", "_line"]
# Where a row of a parquet chunk stands.
CHUNK_ORDER = ["chunk_path", "chunk_row"]
# Tasks a core that list the folders of a table by chunk.
LISTING = 4


def read_problems(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str = schemas.PROBLEMS,
) -> DataFrame:
    """A puzzle table in parquet or JSON lines."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Train and dev of one table partitioned by split; each reads its own folders only."""
    table = spark.read.schema(schemas.SPLITS).parquet(path)
    return tuple(table.filter(F.col("split") == s).drop("split") for s in ("train", "dev"))


def read_chunks(
    spark: SparkSession, pattern: str, schema: StructType | str | None = None, index: str | None = None
) -> DataFrame:
    """All chunk files matching ``pattern`` as one table; Spark fails if none match.

    Adds ``chunk_path`` and ``chunk_row``, which give the rows their order: by
    path as plain text, then as written. With ``index``, also their dense
    0-based number in that order, from the row counts of the files alone.
    """
    reader = spark.read.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    table = reader.parquet(pattern)
    df = table.select(
        "*",
        F.col("_metadata.file_path").alias("chunk_path"),
        F.col("_metadata.row_index").alias("chunk_row"),
    )
    if index is None:
        return df
    files = df.groupBy("chunk_path").agg(F.count(F.lit(1)).alias("_n"))
    # One row per file, never the data.
    earlier = Window.orderBy("chunk_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(
        "chunk_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        df.join(offsets, "chunk_path")
        .withColumn(index, (F.col("_before") + F.col("chunk_row")).cast("bigint"))
        .drop("_before")
    )


def read_results(
    spark: SparkSession, path: str, schema: str = schemas.TEACHER_CHUNK, chunk: str = "chunk"
) -> DataFrame:
    """A table written by chunk; a filter on ``chunk`` opens the folders of those chunks only.

    Folders are listed by a few tasks a core, each many of them, and not by one task each.
    """
    tasks = str(LISTING * spark.sparkContext.defaultParallelism)
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks):
        return spark.read.schema(f"{schema}, {chunk} bigint").parquet(path)


def read_summaries(spark: SparkSession, path: str, schema: str, chunk: str = "chunk") -> DataFrame:
    """The summaries of chunks that :func:`sinks.write_summaries` wrote, of each chunk the last."""
    table = spark.read.schema(f"{chunk} bigint, {schema}, written bigint, first_chunk bigint, n_chunks bigint").parquet(path)
    columns = [c for c in table.columns if c not in (chunk, "written", "first_chunk", "n_chunks")]
    last = F.max_by(F.struct(*columns), "written").alias("last")
    return table.groupBy(chunk).agg(last).select(*[f"last.{c}" for c in columns], chunk)


def read_results_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows and summary of results files that are one JSON document each, ``{"summary": {...}, "per_example": [...]}``.

    ``schema`` is that of a row; the fields of the summary are taken as they come, one
    row per file. A file is one task's work, as a document can't be split.
    """
    typed = f"per_example array<{StructType.fromDDL(schema).simpleString()}>"
    rows = spark.read.option("multiLine", True).schema(typed).json(path).select(F.inline("per_example"))
    return rows, spark.read.option("multiLine", True).json(path).select("summary.*")


def union_chunks(*frames: DataFrame) -> DataFrame:
    """Rows of all chunk tables, columns matched by name, missing ones NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _with_file_order(df: DataFrame) -> DataFrame:
    """Text lines keep their order by file, split of the file, and place in the split."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns by the names in the header, as strings, to the blank.

    ``multi_line`` allows line breaks inside quotes; a file is then one task's work.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.csv(path)


def read_test_csv(
    spark: SparkSession, path: str, id_type: str = "string", multi_line: bool = False
) -> DataFrame:
    """``id, nums, target`` by name, in any order, and all further columns as strings.

    The numbers are text like ``[75, 80]``; text that is no such list is an error.
    """
    raw = schemas.require_columns(
        _read_csv(spark, path, multi_line), {"id", "nums", "target"}, "the test table"
    )
    nums = F.from_json("nums", "array<bigint>")
    wrong = F.raise_error(F.concat(F.lit("not a list of numbers: "), F.col("nums"))).cast("array<bigint>")
    return raw.withColumns(
        {
            "id": F.col("id").cast(id_type),
            "nums": F.when(nums.isNull() & (F.trim("nums") != ""), wrong).otherwise(nums),
            "target": F.col("target").cast("bigint"),
        }
    )


def read_template(
    spark: SparkSession, path: str, id_type: str = "string", multi_line: bool = False
) -> DataFrame:
    """A submission template: at least ``id`` and ``equation``, other columns pass as they are.

    Every column is a string, ``id`` of ``id_type``. The columns of
    ``FILE_ORDER`` record the order of its lines.
    """
    table = schemas.require_columns(
        _read_csv(spark, path, multi_line), {"id", "equation"}, "the template"
    )
    return _with_file_order(table.withColumn("id", F.col("id").cast(id_type)))
