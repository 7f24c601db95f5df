"""Checks of an id-list submission, a row for each rule that is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _finding(rule: str, severity: str, bad: DataFrame) -> DataFrame:
    """Number of bad rows and their first five examples (column ``example``), found without gathering the rows."""
    counted = bad.agg(F.count("*").alias("n"))
    firsts = bad.select("example").distinct().orderBy("example").limit(5).agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return counted.where("n > 0").crossJoin(F.broadcast(firsts)).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def findings(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``rows``: source1_entity_id, matched_entity_ids; ``required``: s1; ``known``: ids that exist; ``candidates``: s1, s23."""
    ids = rows.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("s23")).where("s23 <> ''")
    s1 = rows.select(F.col("source1_entity_id").alias("s1"))
    example = lambda df, c: df.select(F.col(c).alias("example"))
    out = [
        _finding("duplicate_s1", "error", example(s1.groupBy("s1").count().where("count > 1"), "s1")),
        _finding("duplicate_match", "error", ids.groupBy("s1", "s23").count().where("count > 1").select(F.concat_ws(" ", "s1", "s23").alias("example"))),
        _finding("self_match", "error", example(ids.where("s1 = s23"), "s1")),
        _finding("wrong_prefix", "error", example(ids.where(~F.col("s23").rlike("^S[23]-[0-9]+$")), "s23")),
        _finding("missing_s1", "error", example(required.join(s1, "s1", "left_anti"), "s1")),
        _finding("extra_s1", "error", example(s1.join(required, "s1", "left_anti"), "s1")),
    ]
    if known is not None:
        out.append(_finding("unknown_id", "error", example(ids.join(known.select(F.col("entity_id").alias("s23")), "s23", "left_anti"), "s23")))
    if candidates is not None:
        out.append(_finding("not_a_candidate", "warning", ids.join(candidates, ["s1", "s23"], "left_anti").select(F.concat_ws(" ", "s1", "s23").alias("example"))))
    return reduce(DataFrame.unionByName, out)


def file_findings(spark: SparkSession, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """(rule, severity, n) of what is wrong with a file as such: bytes that are no UTF-8, another header, commas for tabs,
    rows without a tab. Lines are read as bytes, and none is gathered but the header."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    # each file's first line is its header
    rows = lines.select("file", "at", F.rtrim(F.make_valid_utf8("value")).alias("line"), (~F.is_valid_utf8("value")).alias("broken"))
    heads = rows.groupBy("file").agg(F.min(F.struct("at", "line")).alias("h")).select("file", "h.at", F.col("h.line").alias("line"))
    body = rows.join(heads.select("file", "at"), ["file", "at"], "left_anti")
    wanted = "\t".join(header)
    found = [
        ("not_utf8", rows.where("broken")),
        ("header", heads.where(F.col("line") != wanted)),
        ("csv_not_tsv", heads.where(F.col("line") == ",".join(header))),
        ("malformed_row", body.where((F.col("line") != "") & (F.size(F.split("line", "\t")) > 2) | ((F.col("line") != "") & ~F.col("line").contains("\t") & ~F.col("line").rlike("^S1-[0-9]+$")))),
    ]
    parts = [bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), "n") for rule, bad in found]
    return reduce(DataFrame.unionByName, parts)
