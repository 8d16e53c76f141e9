"""Sources and sinks by type. A reader is (spark, config) -> DataFrame; readers and writers can be added at run time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reader = Callable[[SparkSession, dict], DataFrame]
ENCODINGS = ("utf-8", "utf-16", "ascii", "latin-1", "cp1252")


def check_csv(config: dict) -> None:
    if len(config.get("delimiter", ",")) != 1:
        raise ValueError("a delimiter is one character")
    if config.get("encoding", "utf-8").lower() not in ENCODINGS:
        raise ValueError(f"unknown encoding {config['encoding']}")


def read_csv(spark: SparkSession, config: dict) -> DataFrame:
    """Needs path; schema makes it one pass and fixes the columns' order."""
    check_csv(config)
    options = {"header": True, "sep": config.get("delimiter", ","), "encoding": config.get("encoding", "utf-8"), "quote": config.get("quote", '"'), "escape": config.get("escape", "\\"), "nullValue": config.get("null", ""), "mode": "PERMISSIVE"}
    reader = spark.read.options(**options)
    if schema := config.get("schema"):
        names = schema.fieldNames() if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fieldNames()
        return reader.schema(schema).option("enforceSchema", False).csv(config["path"]).select(*names)
    return reader.option("inferSchema", True).csv(config["path"])


def read_json(spark: SparkSession, config: dict) -> DataFrame:
    reader = spark.read.option("multiLine", config.get("multi_line", False)).option("mode", "PERMISSIVE")
    return (reader.schema(config["schema"]) if config.get("schema") else reader).json(config["path"])


def _files(kind: str) -> Reader:
    def read(spark: SparkSession, config: dict) -> DataFrame:
        reader = spark.read.format(kind)
        return (reader.schema(config["schema"]) if config.get("schema") else reader).load(config["path"])

    return read


def read_jdbc(spark: SparkSession, config: dict) -> DataFrame:
    """A table in parallel ranges of partition_column where lower, upper and partitions are given."""
    options = {k: config[k] for k in ("url", "dbtable", "user", "password", "driver") if k in config}
    if "partition_column" in config:
        options |= {"partitionColumn": config["partition_column"], "lowerBound": config["lower"], "upperBound": config["upper"], "numPartitions": config.get("partitions", 32)}
    return spark.read.format("jdbc").options(**options).load()


PROTOCOLS, MECHANISMS = ("PLAINTEXT", "SSL", "SASL_PLAINTEXT", "SASL_SSL"), ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512", "GSSAPI")


def kafka_options(config: dict) -> dict:
    if config.get("security_protocol", "PLAINTEXT") not in PROTOCOLS:
        raise ValueError(f"unknown security protocol {config['security_protocol']}")
    if "sasl_mechanism" in config and config["sasl_mechanism"] not in MECHANISMS:
        raise ValueError(f"unknown SASL mechanism {config['sasl_mechanism']}")
    out = {"kafka.bootstrap.servers": config["servers"], "subscribe": config["topic"], "startingOffsets": config.get("offsets", "earliest"), "failOnDataLoss": "false", "kafka.security.protocol": config.get("security_protocol", "PLAINTEXT")}
    return out | ({"kafka.sasl.mechanism": config["sasl_mechanism"]} if "sasl_mechanism" in config else {})


def parse_messages(df: DataFrame, schema: str) -> DataFrame:
    """Messages with a JSON value: its fields, and key, topic, partition, offset and timestamp."""
    meta = ["key", "topic", "partition", "offset", "timestamp"]
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), *meta).select("v.*", *[F.col(m).alias(f"message_{m}") for m in meta])


def read_kafka(spark: SparkSession, config: dict) -> DataFrame:
    return parse_messages(spark.read.format("kafka").options(**kafka_options(config)).load(), config["schema"])


def stream_kafka(spark: SparkSession, config: dict) -> DataFrame:
    """The topic as a stream, from the latest offsets on if none are given; a checkpoint belongs to the sink that the caller starts."""
    return parse_messages(spark.readStream.format("kafka").options(**kafka_options({"offsets": "latest"} | config)).load(), config["schema"])


READERS: dict[str, Reader] = {"csv": read_csv, "json": read_json, "jdbc": read_jdbc, "kafka": read_kafka, **{k: _files(k) for k in ("parquet", "orc", "text")}}


def register(kind: str, reader: Reader) -> None:
    READERS[kind] = reader


def read(spark: SparkSession, kind: str, **config) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown source type {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, config)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite", **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**({"compression": "gzip"} if kind == "json" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def jdbc_options(config: dict) -> dict:
    """Options of a JDBC sink: rows a statement batch, connections at once, and no isolation, as rows are only appended."""
    wanted = {k: config[k] for k in ("url", "dbtable", "user", "password", "driver") if k in config}
    if "url" not in wanted or "dbtable" not in wanted:
        raise ValueError("a JDBC sink needs url and dbtable")
    return wanted | {"batchsize": str(config.get("batch_rows", 10_000)), "numPartitions": str(config.get("connections", 16)), "isolationLevel": config.get("isolation", "NONE")}


def write_jdbc(df: DataFrame, config: dict, mode: str = "append") -> None:
    df.write.format("jdbc").mode(mode).options(**jdbc_options(config)).save()


class Sources:
    """Named source configurations, one of them primary: read() takes that unless another is named."""

    def __init__(self, configs: dict[str, dict], primary: str, overrides: dict[str, str] | None = None):
        """overrides: values by NAME_KEY in capitals, such as an environment, that replace those of configs."""
        self.configs = {name: {k: (overrides or {}).get(f"{name}_{k}".upper(), v) for k, v in c.items()} for name, c in configs.items()}
        self.switch((overrides or {}).get("PRIMARY_SOURCE", primary))

    def switch(self, name: str) -> None:
        if name not in self.configs:
            raise ValueError(f"unknown source {name}; known: {sorted(self.configs)}")
        self.primary = name

    def read(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        config = dict(self.configs[name or self.primary])
        return read(spark, config.pop("type"), **config)


def write_all(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Every sink gets df, computed once; "success" or the error of each. A failing sink doesn't stop the others."""
    df = df.persist()
    out = {}
    for name, sink in sinks.items():
        try:
            sink(df)
            out[name] = "success"
        except Exception as error:  # one sink's failure is that sink's result
            out[name] = f"failed: {error}"
    df.unpersist()
    return out


def vendor_status(df: DataFrame, layouts: dict[str, tuple[str, dict[str, str]]], vendor: str = "vendor", payload: str = "payload") -> DataFrame:
    """Vendors' JSON as one record: layouts gives each vendor's schema and, by target column, the field it is taken from."""
    parts = []
    for name, (schema, fields) in layouts.items():
        parsed = df.filter(F.col(vendor) == name).withColumn("p", F.from_json(payload, schema))
        parts.append(parsed.select(F.col(vendor), *[F.col(f"p.{source}").alias(target) for target, source in fields.items()]))
    return reduce(DataFrame.unionByName, parts)
