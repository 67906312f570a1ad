"""Settings for reading releases from remote object storage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def options(anonymous: bool = True, connections: int = 96, attempts: int = 5, timeout_ms: int = 30_000) -> dict[str, str]:
    """Spark settings for a public bucket: no credentials, many connections, retries, and a lookup of footers that is not repeated."""
    out = {
        "spark.hadoop.fs.s3a.connection.maximum": str(connections),
        "spark.hadoop.fs.s3a.threads.max": str(connections),
        "spark.hadoop.fs.s3a.attempts.maximum": str(attempts),
        "spark.hadoop.fs.s3a.connection.timeout": str(timeout_ms),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
        "spark.sql.hive.metastorePartitionPruning": "true",
    }
    if anonymous:
        out["spark.hadoop.fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return out


def configured(builder: SparkSession.Builder, **chosen) -> SparkSession.Builder:
    return builder.config(map=options(**chosen))
