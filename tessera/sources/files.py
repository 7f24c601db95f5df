"""Tables as files of other kinds: metrics as JSON, reports as CSV, partitioned Parquet that resumes, side inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON file of a few rows, such as a report's one."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_side(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small side input, such as a dictionary, as JSON rows of a given schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file with a header, in order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_by_country(df: DataFrame, path: str, resume: bool = False) -> list[str]:
    """A folder of Parquet for each country; with ``resume`` only of countries that have none yet. Gives the countries written.
    Each country is replaced as a whole, so a run that was broken off can be run again."""
    spark = df.sparkSession
    todo = sorted(r[0] for r in df.select("country").where("country is not null").distinct().collect())
    if resume:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def done(country: str) -> bool:
            at = fs_path(f"{path}/country={country}")
            return at.getFileSystem(conf).exists(at)

        todo = [c for c in todo if not done(c)]
    if todo:
        df.where(F.col("country").isin(todo)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)
    return todo


def with_columns_from(df: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with the columns of ``more`` that it lacks, 0 where ``more`` has no row: columns are added by a join and written
    anew, as files don't change in place."""
    new = [c for c in more.columns if c not in df.columns]
    return df.join(more.select(*on, *new), on, "left").na.fill(0, new) if new else df


def masked(df: DataFrame, entities: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of the pairs whose record is among ``entities`` (s1)."""
    return df.join(entities.select("s1").distinct(), "s1", "left_semi").select("s1", "s23", *columns)
