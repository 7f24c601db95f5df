"""Documents as linkage records, and the signatures of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Words that count as legal forms among the records made of documents.
LEGAL = ["the", "of", "and", "le", "la", "der", "die", "el"]
#: Words of a document that make the name, and those after them that make the address.
NAME, ADDRESS = 5, 12


def from_documents(docs: DataFrame) -> DataFrame:
    """A language plays the country; the first five words are the name, the next twelve and a number the address. A record
    holds no more, so only the text up to its 17th word is cut into words."""
    head = F.regexp_extract(F.lower("text"), f"^[^0-9a-z]*+(?:[0-9a-z]++[^0-9a-z]*+){{0,{NAME + ADDRESS}}}", 0)
    rows = docs.select("doc_id", "lang", "n_chars", T.ascii_tokens(head).alias("w")).where(F.size("w") >= 1)
    return rows.select(
        F.col("doc_id").alias("entity_id"),
        F.col("lang").alias("country"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("src"),
        F.array_join(F.slice("w", 1, NAME), " ").alias("business_name"),
        F.concat(F.array_join(F.slice("w", NAME + 1, ADDRESS), " "), F.lit(" "), F.expr("n_chars div 100").cast("string")).alias("business_address"),
    )


def signatures(records: DataFrame, legal: list[str] | None = None, abbreviations: dict[str, str] | None = None, longs: list[str] | None = None, plain: bool = True) -> DataFrame:
    """entity_id, country, src and the forms that blocking and features use. ``plain``: names are ASCII and need no Python."""
    legal = LEGAL if legal is None else legal
    name = T.ascii_tokens(F.col("business_name")) if plain else T.tokens(T.canon(F.col("business_name")))
    addr = T.ascii_tokens(F.col("business_address")) if plain else T.tokens(T.canon(F.col("business_address")))
    rows = records.select("*", name.alias("all_words"), addr.alias("addr_words"), T.is_domain(F.col("business_name")).alias("is_domain"), T.has_indic(F.col("business_name")).alias("non_latin"))
    rows = rows.withColumn("words", F.when(F.col("is_domain"), T.without(F.col("all_words"), T.TLDS)).otherwise(F.col("all_words")))
    rows = rows.withColumn("core", T.without(F.col("words"), legal)).withColumn("merged", T.merged_pairs(F.col("addr_words"), longs or []))
    return rows.select(
        "entity_id",
        "country",
        "src",
        F.array_join("words", " ").alias("name_c"),
        "words",
        "core",
        T.suffixes(F.col("words"), legal).alias("sfx"),
        F.array_join("core", "").alias("squash"),
        T.mapped(T.alpha_words(F.col("merged")), abbreviations or {}).alias("addr"),
        T.numbers(F.array_join("merged", " ")).alias("nums"),
        F.col("is_domain").cast("int").alias("is_domain"),
        F.col("non_latin").cast("int").alias("non_latin"),
        (F.trim("business_address") == "").cast("int").alias("addr_empty"),
    )
