"""Scans of the stored tables, with their fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridetide import schemas


def parquet_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def fare_config(spark: SparkSession, path: str) -> DataFrame:
    return parquet_table(spark, path, schemas.FARE_CONFIG)


def zone_window_metrics(spark: SparkSession, path: str) -> DataFrame:
    return parquet_table(spark, path, schemas.ZONE_WINDOW_METRICS)


def zone_price_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return parquet_table(spark, path, schemas.ZONE_PRICE_SNAPSHOT)
