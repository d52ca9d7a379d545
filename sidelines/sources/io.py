"""Readers and sinks.

Everything returns a lazy DataFrame; nothing is collected.  Schemas are always
explicit for CSV (no ``inferSchema`` pass over the data).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

__all__ = ["TABLES", "load_tables", "table", "load_plays", "load_snapshot", "load_overrides",
           "read_csv_skip", "read_many", "read_indexed_csv", "baseline", "save_table",
           "load_ratings", "OVERRIDE_SCHEMA"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    """Lazy handles on the parquet tables of one scale factor."""
    return {n: table(spark, sf_dir, n) for n in names}


def load_plays(spark: SparkSession, path: str, seasons: Iterable[int] | None = None,
               season_col: str = "season") -> DataFrame:
    """Multi-season event load.  With a ``season=`` partitioned layout the
    ``isin`` filter prunes whole directories; otherwise it is a pushed filter."""
    df = spark.read.parquet(path)
    if seasons is not None:
        df = df.where(F.col(season_col).isin(list(seasons)))
    return df


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A saved intermediate table (parquet stands in for a workspace image)."""
    return spark.read.parquet(path)


OVERRIDE_SCHEMA = T.StructType([T.StructField("game_id", T.StringType()),
                                T.StructField("roof_update", T.StringType())])


def load_overrides(spark: SparkSession, path: str,
                   schema: T.StructType = OVERRIDE_SCHEMA) -> DataFrame:
    """S3: header CSV with an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_skip(spark: SparkSession, path: str, skip: int, schema: T.StructType,
                  header: bool = True) -> DataFrame:
    """CSV files that start with ``skip`` preamble lines.

    Files are read by line and split into blocks, so one large file is many
    tasks.  A block's lines come in order and say at which offset the block
    begins: the lines to drop are the first ones of the blocks at offset 0.
    No shuffle; the rest is parsed by ``from_csv`` with the given schema.  The preamble lies
    in a file's first block (``spark.sql.files.maxPartitionBytes``); quoted fields hold no line feeds."""
    drop = skip + (1 if header else 0)
    ddl = schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def without_preamble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i in np.flatnonzero(b.column("start").to_numpy() == 0):
                name = b.column("file")[int(i)].as_py()
                seen[name] = seen.get(name, 0) + 1
                if seen[name] > drop:
                    if b.column("file")[b.num_rows - 1].as_py() == name:
                        break                                     # the rest of the batch is of the same file, past its preamble
                    continue
                keep[i] = False
            yield b.select(["line"]).filter(pa.array(keep))

    lines = (spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                          F.col("_metadata.file_block_start").alias("start"))
             .mapInArrow(without_preamble, "line string").where(F.length("line") > 0))
    return lines.select(F.from_csv("line", ddl).alias("r")).select("r.*")


def read_many(spark: SparkSession, path_glob: str, schema: T.StructType,
              id_col: str = "source_path") -> DataFrame:
    """Many CSVs at once with the source file kept as a column."""
    return (spark.read.schema(schema).option("header", True).csv(path_glob)
            .withColumn(id_col, F.col("_metadata.file_path")))


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType,
                     index_col: str = "_idx") -> DataFrame:
    """CSV whose first (unnamed) column is a row index; the index is dropped.
    ``schema`` describes the named columns only."""
    full = T.StructType([T.StructField(index_col, T.IntegerType())] + list(schema.fields))
    return (spark.read.schema(full).option("header", True).option("nullValue", "NA")
            .csv(path).drop(index_col))


def baseline(spark: SparkSession, **cols) -> DataFrame:
    """A literal one-row table, e.g. the scenario baseline."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Iterable[str] | None = None) -> None:
    """Result sink.  Rendering to images is out of scope; the table is written."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load_ratings(spark: SparkSession, paths: Mapping[int, str], schema: T.StructType,
                 drop: Iterable[str] = (), rename: Mapping[str, str] | None = None,
                 fix: Mapping[str, str] | None = None, key_col: str = "Team") -> DataFrame:
    """Per-season rating files -> one table tagged with the season.

    Column names are title-cased, ``drop`` removed, ``rename`` applied, and
    ``fix`` maps stale codes in ``key_col`` to current ones."""
    frames = []
    for season, p in paths.items():
        df = spark.read.schema(schema).option("header", True).csv(p).drop(*drop)
        df = df.toDF(*[c.title() for c in df.columns])
        if rename:
            df = df.withColumnsRenamed(dict(rename))
        frames.append(df.withColumn("season", F.lit(int(season))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if fix:
        m = F.create_map(*[F.lit(x) for kv in fix.items() for x in kv])
        out = out.withColumn(key_col, F.coalesce(F.try_element_at(m, F.col(key_col)), F.col(key_col)))
    return out

