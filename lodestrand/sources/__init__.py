"""Sources and sinks.  A source is anything that gives a DataFrame with a key column; stores without a Spark reader are registered by the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans.errors import StatementError

_READERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(kind: str, read: Callable[..., DataFrame]) -> None:
    """read(spark, host=..., port=..., **options) gives a keyed DataFrame."""
    _READERS[kind.lower()] = read


def read_parquet(spark: SparkSession, path: str, **_) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, **_) -> DataFrame:
    """A CSV with a header whose first column is the key; types are inferred."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumnRenamed(df.columns[0], "key")


def read_jdbc(spark: SparkSession, host: str, port: int, database: str, table: str, driver: str = "postgresql", **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=f"jdbc:{driver}://{host}:{port}/{database}", dbtable=table, **{k: v for k, v in options.items() if k in ("user", "password", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}).load()


def _remote(kind: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, **options) -> DataFrame:
        from .remote import read_remote

        return read_remote(spark, kind=kind, **options)

    return read


for _kind in ("influxdb", "iotdb", "opentsdb"):
    register_source(_kind, _remote(_kind))
for _kind, _read in (("parquet", read_parquet), ("csv", read_csv), ("postgresql", read_jdbc), ("timescaledb", read_jdbc)):
    register_source(_kind, _read)


def open_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    try:
        return _READERS[kind.lower()](spark, **options)
    except KeyError:
        raise StatementError(f"no reader for {kind}; register_source adds one") from None


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
