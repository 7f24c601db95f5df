"""Candidate generation: blocking keys, capped key joins, union of keys, pre-score, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import trigrams
from tessera.functions.similarity import phonetic, ratio_udf, token_set_udf
from tessera.session import materialize

MAX_BLOCK, MAX_CANDIDATES = 200, 40
K1, K2, K3, K4, K5, K6, K7 = (1 << i for i in range(7))


def idf(signed: DataFrame, column: str = "addr") -> DataFrame:
    """(token, df, idf): ln(n / (1 + df)) over all records."""
    n = signed.agg(F.count("*").alias("n"))
    df = signed.select(F.explode(F.array_distinct(column)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))  # n: one row


def rare_words(signed: DataFrame, weights: DataFrame, k: int = 2, column: str = "addr") -> DataFrame:
    """(entity_id, rare): the k rarest distinct words, by falling idf and then by the word. A shuffle join on the word, as a
    vocabulary grows with the data; rows are then gathered per record, whose words are few."""
    words = signed.select("entity_id", F.explode(F.array_distinct(column)).alias("token")).join(weights, "token")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("w"), "token")))
    return words.groupBy("entity_id").agg(F.transform(F.slice(ordered, 1, k), lambda x: x["token"]).alias("rare"))


def _struct(bit: int, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(bit).alias("bit"), k.alias("key")))


def keys(signed: DataFrame, rare: DataFrame | None = None, bits: int = K1 | K2 | K3 | K6 | K7) -> DataFrame:
    """(entity_id, country, src, bit, key), a row for each emission; repeats stay, as caps count them."""
    none = F.array().cast("array<string>")
    rows = signed.join(rare, "entity_id", "left").withColumn("rare", F.coalesce("rare", none)) if rare is not None else signed.withColumn("rare", none)
    nums, sq = F.slice("nums", 1, 3), F.col("squash")
    one = lambda cond, key: F.when(cond, F.array(key)).otherwise(none)
    made = {
        K1: F.flatten(F.transform(nums, lambda n: F.transform("rare", lambda r: F.concat(n, F.lit("|"), F.left(r, F.lit(3)))))),
        K2: one(F.size("rare") == 2, F.array_join(F.sort_array("rare"), "|")),
        K3: one(F.length(sq) >= 4, F.left(sq, F.lit(8))),
        K6: F.flatten(F.transform(F.filter(F.slice("core", 1, 2), lambda t: F.length(t) >= 3), lambda t: F.transform(nums, lambda n: F.concat(t, F.lit("#"), n)))),
        K7: one(F.length(sq) >= 6, F.concat(F.lit("="), sq)),
    }
    if bits & K4:
        rows = rows.withColumn("phon", phonetic(F.array_join("core", " ")))
        made[K4] = one(F.col("phon") != "", F.col("phon"))
    return rows.select("entity_id", "country", "src", F.explode(F.concat(*[_struct(b, k) for b, k in made.items() if bits & b])).alias("e")).select("entity_id", "country", "src", "e.bit", "e.key")


def capped_key_join(left: DataFrame, right: DataFrame, on: list[str], cap: int = MAX_BLOCK) -> DataFrame:
    """Inner join on the keys that ``right`` has at most ``cap`` times, emissions counted. The counts are aggregated before
    the shuffle, and large keys leave before the join, so no key is larger than cap on that side."""
    small = right.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") <= cap).drop("__n")
    return left.join(right.join(small, on, "left_semi"), on)


def candidates(emitted: DataFrame, cap: int = MAX_BLOCK) -> DataFrame:
    """(s1, s23, kbits): source 1 against the others within a country; bits of all keys that a pair shares."""
    on = ["country", "bit", "key"]
    s1 = emitted.where("src = 1").select(*on, F.col("entity_id").alias("s1")).distinct()
    s23 = emitted.where("src <> 1").select(*on, F.col("entity_id").alias("s23"))
    return capped_key_join(s1, s23, on, cap).groupBy("s1", "s23").agg(F.bit_or("bit").alias("kbits"))


def prescore(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """``pairs`` with ``prescore``: a blend of name, address and number similarity, by name alone where either address has no
    word, plus a little for each shared key."""
    of = lambda side: signed.select(F.col("entity_id").alias(side), F.col("squash").alias(f"{side}_q"), F.col("name_c").alias(f"{side}_n"), F.array_join("addr", " ").alias(f"{side}_a"), F.array_join("nums", " ").alias(f"{side}_m"))
    rows = pairs.join(of("s1"), "s1").join(of("s23"), "s23")
    both = lambda udf, f: udf(F.col(f"s1_{f}"), F.col(f"s23_{f}"))
    rows = rows.withColumn("__q", both(ratio_udf, "q")).withColumn("__a", both(token_set_udf, "a")).withColumn("__m", both(token_set_udf, "m")).withColumn("__n", both(token_set_udf, "n"))
    blend = F.when((F.col("s1_a") == "") | (F.col("s23_a") == ""), 0.9 * F.greatest("__q", "__n")).otherwise(0.35 * F.col("__q") + 0.35 * F.col("__a") + 0.2 * F.col("__m"))
    return rows.select(*pairs.columns, (blend / 100 + 0.02 * F.bit_count("kbits")).alias("prescore"))


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int = MAX_CANDIDATES) -> DataFrame:
    """The k largest of each group; Catalyst limits each partition's groups before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _texts(side: DataFrame, most: int) -> DataFrame:
    """(country, text, id, least, copies, part) of the texts of a country, dealt into parts of about ``most`` of them."""
    texts = side.where("country is not null and text is not null").groupBy("country", "text").agg(F.min("entity_id").alias("least"), F.count("*").alias("copies"))
    texts = materialize(texts.withColumn("id", F.xxhash64("country", "text")), "trigram-texts")
    n = texts.groupBy("country").agg(F.ceil(F.count("*") / most).alias("parts"))
    return texts.join(n, "country").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")


def trigram_top_k(left: DataFrame, right: DataFrame, k: int = 30, most: int = 1024) -> DataFrame:
    """(s1, s23, sim, rank): the k nearest by cosine of tf-idf weighted character trigrams (those on two records of ``right`` at
    least) within a country, exact to 12 decimals. Every two different texts of a country are compared, in blocks: ``most``
    texts of ``right`` at a time pass by twice as many of ``left``, which keep their k nearest, so no pair becomes a row.
    Records of one text share its neighbours. Inputs: entity_id, country, text."""
    most = max(most, 1)
    one, many = _texts(left, 2 * most), _texts(right, most)
    padded = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    df = many.select("country", "copies", F.explode(F.array_distinct(cut)).alias("g")).groupBy("country", "g").agg(F.sum("copies").alias("df")).where("df >= 2")
    n = right.groupBy("country").agg(F.count("*").alias("n"))
    weights = df.join(n, "country").select("country", "g", (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))).alias("idf"))

    def packed(rows: DataFrame, kind: int, part: Column, text: str, number: str, least: Column, idf: Column) -> DataFrame:
        entry = F.struct(F.col(text).alias("text"), F.col(number).alias("id") if number else F.lit(0).cast("long").alias("id"), least.cast("long").alias("least"), idf.alias("idf"))
        return rows.groupBy("country", part.alias("part")).agg(F.collect_list(entry).alias("rows")).withColumn("kind", F.lit(kind))

    none = F.lit(0.0)
    blocks = materialize(packed(one, 1, F.col("part"), "text", "id", F.col("least"), none).withColumnRenamed("part", "block"), "trigram-blocks")
    theirs = packed(weights, 0, F.pmod(F.xxhash64("g"), F.lit(8)), "g", "", F.lit(0), F.col("idf")).unionByName(packed(many, 2, F.col("part"), "text", "id", F.col("least"), none))
    met = theirs.drop("part").join(blocks.select("country", "block"), "country")
    rows = blocks.select("country", "block", "kind", "rows").unionByName(met.select("country", "block", "kind", "rows"))
    dealt = rows.repartition(max(1, min(2 * blocks.count(), 4096)), "country", "block").sortWithinPartitions("country", "block", "kind")
    near = materialize(dealt.mapInPandas(lambda batches: trigrams.nearest(batches, k), "a long, b long, sim double"), "trigram-near")
    copies = Window.partitionBy("b").orderBy("s23")  # of one text's records no more than k can be among the nearest
    first = right.where("country is not null and text is not null").select(F.xxhash64("country", "text").alias("b"), F.col("entity_id").alias("s23"))
    first = first.distinct().withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= k).drop("__n")
    ranked = top_k(near.join(first, "b").groupBy("a", "s23").agg(F.max("sim").alias("sim")), "a", "sim", "s23", k)
    own = left.select(F.xxhash64("country", "text").alias("a"), F.col("entity_id").alias("s1")).where("country is not null and text is not null").distinct()
    return own.join(ranked, "a").select("s1", "s23", "sim", "rank")
