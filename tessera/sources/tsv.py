"""Record and link tables as tab-separated text: no quoting, empty is not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
LINKS = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str = RECORD, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).options(sep="\t", quote="", header=True, enforceSchema=False, mode="FAILFAST").csv(path).na.fill("")
    return df.select(*columns) if columns else df


def read_satellites(spark: SparkSession, second: str, third: str) -> DataFrame:
    """Sources 2 and 3 with ``src``."""
    parts = [read_tsv(spark, p).withColumn("src", F.lit(n).cast("tinyint")) for n, p in ((2, second), (3, third))]
    return parts[0].unionByName(parts[1])


def explode_links(rows: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(s1, s23), one row an id; empty lists give none."""
    return rows.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split(column, ",")).alias("s23")).where("s23 <> ''")


def encoded(entity_id: Column) -> Column:
    """Source times ten to the tenth plus the number, of ids like S2-17."""
    return F.substring(entity_id, 2, 1).cast("bigint") * F.lit(10_000_000_000) + F.regexp_extract(entity_id, r"-(\d+)$", 1).cast("bigint")


def id_lists(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids", rank: str = "rank") -> DataFrame:
    """Every id of ``s1`` (s1) with its partners in order of ``rank``, joined by commas; empty if it has none."""
    lists = pairs.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col("s23").cast("string").alias("id")))), lambda x: x["id"]).alias("ids"))
    return s1.join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias(column))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", quote="", emptyValue="", header=True).csv(path)
