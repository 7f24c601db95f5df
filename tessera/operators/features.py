"""Features of candidate pairs. Set, prefix and rarity features are columns; fuzzy ratios are Pandas UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as S

FORMS = ["name_c", "words", "core", "sfx", "squash", "addr", "nums", "is_domain", "non_latin", "addr_empty", "src"]


def attach(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """``pairs`` (s1, s23, ...) with both records' forms as a_* and b_*."""
    of = lambda key, p: signed.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in FORMS])
    return pairs.join(of("s1", "a"), "s1").join(of("s23", "b"), "s23")


def _share(x: Column, y: Column) -> Column:
    return x / F.greatest(y, F.lit(1))


def _jaccard(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i))))


def _acronym(a: Column, b: Column) -> Column:
    initials = F.array_join(F.transform(a, lambda w: F.left(w, F.lit(1))), "")
    return (F.size(F.array_distinct(a)) >= 2) & (initials == F.array_join(b, ""))


def native(rows: DataFrame) -> DataFrame:
    """The features that need no Python, except those that ``rows`` has; else ``rows`` as ``attach`` gives them."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    core_a, core_b, num_a, num_b = F.array_distinct(a("core")), F.array_distinct(b("core")), a("nums"), b("nums")
    shared = F.size(F.array_intersect(core_a, core_b))
    prefix = F.col("sq_prefix") if "sq_prefix" in rows.columns else common_prefix(a("squash"), b("squash"))
    sfx_a, sfx_b = a("sfx"), b("sfx")
    first = lambda x: F.when(F.size(x) > 0, F.element_at(x, 1))
    near = F.exists(F.slice(num_a, 1, 4), lambda p: F.exists(F.slice(num_b, 1, 4), lambda q: (F.length(p) >= 2) & (F.length(q) >= 2) & (p != q) & (F.levenshtein(p, q) <= 1)))
    made = {
        "sq_prefix": prefix,
        "core_jacc": _jaccard(core_a, core_b),
        "core_contain": _share(shared, F.least(F.size(core_a), F.size(core_b))),
        "acronym": (_acronym(a("core"), b("core")) | _acronym(b("core"), a("core"))).cast("int"),
        "sfx_compat": F.when(sfx_a == sfx_b, 0).when((sfx_a == "") | (sfx_b == ""), 1).when(F.arrays_overlap(F.split(sfx_a, " "), F.split(sfx_b, " ")), 2).otherwise(3),
        "num_jacc": _jaccard(num_a, num_b),
        "num_contain": _share(F.size(F.array_intersect(num_a, num_b)), F.size(num_a)),
        "lead_eq": F.coalesce(first(num_a) == first(num_b), F.lit(False)).cast("int"),
        "lead_in": F.coalesce(F.array_contains(num_b, first(num_a)), F.lit(False)).cast("int"),
        "num_near": near.cast("int"),
        "addr_jacc": _jaccard(F.array_distinct(a("addr")), F.array_distinct(b("addr"))),
        "sq_prefix_frac": _share(prefix, F.least(F.length(a("squash")), F.length(b("squash")))),
        "name_len_diff": F.abs(F.length(a("name_c")) - F.length(b("name_c"))),
        "name_ntok_diff": F.abs(F.size(a("words")) - F.size(b("words"))),
        "addr_ntok_a": F.size(a("addr")),
        "addr_ntok_b": F.size(b("addr")),
        "n_nums_a": F.size(num_a),
        "n_nums_b": F.size(num_b),
        "b_is_domain": b("is_domain"),
        "b_non_latin": b("non_latin"),
        "b_addr_empty": b("addr_empty"),
        "b_src": b("src"),
    }
    if "kbits" in rows.columns:
        made |= {f"k{i + 1}": F.getbit("kbits", F.lit(i)).cast("int") for i in range(7)} | {"n_keys": F.bit_count("kbits")}
    return rows.withColumns({name: f for name, f in made.items() if name not in rows.columns})


def fuzzy(rows: DataFrame) -> DataFrame:
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    text = lambda c, sep=" ": (F.array_join(a(c), sep), F.array_join(b(c), sep))
    name, squash, core, addr, nums = (a("name_c"), b("name_c")), (a("squash"), b("squash")), text("core"), text("addr"), text("nums")
    made = S.family(*name, *addr, *core, *squash, *nums)
    return rows.withColumn("__f", made).select(*rows.columns, "__f.*")


def meeting(rows: DataFrame) -> DataFrame:
    """``rows`` (forms and weights of words as a_* and b_*) with all that a pair's texts and words tell: set by set and weight by
    weight it costs less in one pass in Python than by the functions for arrays and maps."""
    of = lambda f: [f(p) for p in "ab"]
    text = lambda c: of(lambda p: F.array_join(f"{p}_{c}", " "))
    made = S.meeting(*of(lambda p: F.col(f"{p}_name_c")), *text("addr"), *text("core"), *text("nums"), *of(lambda p: F.col(f"{p}_w_addr")), *of(lambda p: F.col(f"{p}_w_core")))
    return rows.withColumn("__f", made).select(*rows.columns, "__f.*")


def rarity(pairs: DataFrame, signed: DataFrame, weights: DataFrame, column: str, prefix: str) -> DataFrame:
    """``pairs`` with what the shared and missing words of ``column`` weigh (``weights``: token, idf): sum and largest of the
    shared, their share of either side (1 if that side is empty), largest missing of either side. Words meet their weights
    once a record, not once a pair."""
    of = lambda key, name: bags(signed, weights, column).select(F.col("entity_id").alias(key), F.col("bag").alias(name))
    none = F.array().cast("array<struct<token:string,idf:double>>")
    rows = pairs.join(of("s1", "__a"), "s1", "left").join(of("s23", "__b"), "s23", "left")
    entries = lambda c: F.map_from_entries(F.coalesce(c, none))
    return with_rarity(rows.withColumns({"__a": entries("__a"), "__b": entries("__b")}), "__a", "__b", prefix).drop("__a", "__b")


def bags(signed: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """(entity_id, bag: array of (token, idf), by token) of the distinct words of ``column`` that have a weight."""
    words = signed.select("entity_id", F.explode(F.array_distinct(column)).alias("token")).join(weights.select("token", "idf"), "token")
    return words.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("bag"))


def with_rarity(rows: DataFrame, a: str, b: str, prefix: str) -> DataFrame:
    """``rows`` with what ``rarity`` tells of the maps ``a`` and ``b`` from words to weights."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    most = lambda m: F.coalesce(F.array_max(F.map_values(m)), F.lit(0.0))
    rows = rows.withColumn("__s", F.map_filter(a, lambda k, _: F.map_contains_key(F.col(b), k)))
    miss = lambda m, n: most(F.map_filter(m, lambda k, _: ~F.map_contains_key(F.col(n), k)))
    cover = lambda m: F.when(total(m) == 0, 1.0).otherwise(total(F.col("__s")) / total(m))
    made = {f"{prefix}_shared_sum": total(F.col("__s")), f"{prefix}_shared_max": most(F.col("__s")), f"{prefix}_cov_a": cover(F.col(a)), f"{prefix}_cov_b": cover(F.col(b)), f"{prefix}_miss_max_a": miss(F.col(a), b), f"{prefix}_miss_max_b": miss(F.col(b), a)}
    return rows.withColumns(made).drop("__s")


def squash_counts(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """log1p of how many records of source 1, and of the satellites, in the country have a pair's exact squashed names."""
    own = squash_numbers(signed)
    a = own.select(F.col("entity_id").alias("s1"), F.log1p("n1").alias("sq_n_s1_a"))
    b = own.select(F.col("entity_id").alias("s23"), F.log1p("n1").alias("sq_n_s1_b"), F.log1p("n23").alias("sq_n_s23_b"))
    return pairs.join(a, "s1").join(b, "s23")


def squash_numbers(signed: DataFrame) -> DataFrame:
    """(entity_id, n1, n23): records of source 1, and of the satellites, in a record's country with its squashed name."""
    keyed = signed.select("country", "squash", (F.col("src") == 1).alias("one"))
    n = keyed.groupBy("country", "squash").agg(F.sum(F.col("one").cast("long")).alias("n1"), F.sum((~F.col("one")).cast("long")).alias("n23"))
    return signed.select("entity_id", "country", "squash").join(n, ["country", "squash"]).select("entity_id", "n1", "n23")


#: What a pair takes along of either record; the other forms follow from these.
CARRIED = ["name_c", "core", "sfx", "addr", "nums", "is_domain", "non_latin", "addr_empty", "src"]


def sides(signed: DataFrame, weights: dict[str, DataFrame]) -> DataFrame:
    """entity_id, ``CARRIED``, the weights of the record's words in each column of ``weights`` (by word) and its squashed name's
    counts: all that features need of a record, so that pairs meet records once. ``signed`` as ``records.signatures`` gives it."""
    rows = signed.select("entity_id", *CARRIED).join(squash_numbers(signed), "entity_id", "left")  # none without a country
    for column, w in weights.items():
        rows = rows.join(bags(signed, w, column).select("entity_id", F.col("bag.idf").alias(f"w_{column}")), "entity_id", "left")
    return rows


def pair_features(pairs: DataFrame, records: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``pairs`` with all features of two records. ``records``: as ``sides`` gives them for addr and core; ``prefixes``: column to
    the name of what its words weigh."""
    of = lambda key, p: records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in records.columns[1:]])
    rows = pairs.join(of("s1", "a"), "s1").join(of("s23", "b"), "s23").where("a_n1 is not null and b_n1 is not null")
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    rows = rows.withColumns({x: y for p in "ab" for x, y in ((f"{p}_words", words(f"{p}_name_c")), (f"{p}_squash", F.array_join(f"{p}_core", "")))})
    rows = native(meeting(rows).withColumnsRenamed({f"{c}_{x}": f"{prefix}_{x}" for c, prefix in prefixes.items() for x in S.RARITY}))
    rows = rows.withColumns({"sq_n_s1_a": F.log1p("a_n1"), "sq_n_s1_b": F.log1p("b_n1"), "sq_n_s23_b": F.log1p("b_n23")})
    drop = [c for c in rows.columns if c[:2] in ("a_", "b_") and c not in ("b_is_domain", "b_non_latin", "b_addr_empty", "b_src", "a_addr_empty")]
    return rows.drop(*drop)
