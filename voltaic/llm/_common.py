"""What the corpus operators share: table access, lineage cuts and the definition of a word."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a fresh local one where it is unset and all
    tasks run in this process. A cluster without that setting is refused: its executors could not read each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="voltaic-")
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: later stages no longer depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """df written once, dealt by column into buckets in the shared folder: grouping by column needs no further shuffle."""
    spark = df.sparkSession
    called = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{called}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path).saveAsTable(called)
    return spark.table(called)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files behind frames made by cut() or bucketed(), once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            spark.sql(f"DROP TABLE IF EXISTS `{path.getName()}`")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: what Python makes of one is gone when the next is taken up."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _holds(kind: T.DataType, what: tuple[type, ...]) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, what) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, what)
    return isinstance(kind, what)


def comparable(column: Column, kind: T.DataType) -> Column:
    """The column with what Spark can't hash in a form that it can, at any depth: maps as arrays of their entries,
    ordered by the entries' hashes, and variants as their JSON. Alike values stay alike, different ones different."""
    if isinstance(kind, T.VariantType):
        return F.to_json(column)
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value"))
        ranked = F.transform(F.map_entries(column), lambda e: F.struct(F.xxhash64(entry(e)).alias("rank"), F.hash(entry(e)).alias("tie"), entry(e).alias("entry")))
        return F.array_sort(ranked, lambda a, b: F.when(a["rank"] != b["rank"], F.when(a["rank"] < b["rank"], -1).otherwise(1)).when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0))
    if not _holds(kind, (T.MapType, T.VariantType)):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: comparable(x, kind.elementType))
    fields = F.struct(*(comparable(column[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)))
    return F.when(column.isNotNull(), fields)


def crc_mod(column: str, n: int):
    """crc32 of the column's text form, modulo n; null is taken as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n
