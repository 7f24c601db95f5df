"""Registered queries of the linkage engine, over the records made of ``documents``, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import audit, blocking, context, decide, dictionaries, evaluate, explore, features, model, select, validate
from tessera.plans import link, records
from tessera.session import materialize, read_table
from tessera.sources import tsv

#: Block size cap of all queries and of their SQL.
CAP = blocking.MAX_BLOCK

_made: dict = {}


def _once(make):
    """A table that a query builds once, however often it reads it."""

    @functools.wraps(make)
    def made(spark: SparkSession, d: str, *more) -> DataFrame:
        key = (make.__name__, d, more)
        if key not in _made:
            _made[key] = materialize(make(spark, d, *more), make.__name__.strip("_"))
        return _made[key]

    return made


def _alone(query):
    """A query that builds its own tables, and none of an earlier one's."""

    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        _made.clear()
        try:
            return query(spark, d)
        finally:
            _made.clear()

    return run


@_once
def _signed(spark: SparkSession, d: str) -> DataFrame:
    return records.signatures(records.from_documents(read_table(spark, d, "documents")))


@_once
def _keys(spark: SparkSession, d: str, bits: int = 0x67) -> DataFrame:
    signed = _signed(spark, d)
    return blocking.keys(signed, blocking.rare_words(signed, blocking.idf(signed)) if bits & (blocking.K1 | blocking.K2) else None, bits)


@_once
def _pairs(spark: SparkSession, d: str, cap: int = CAP) -> DataFrame:
    return blocking.candidates(_keys(spark, d, blocking.K7), cap)


def _attached(spark: SparkSession, d: str, cap: int = CAP) -> DataFrame:
    return features.native(features.attach(_pairs(spark, d, cap), _signed(spark, d)))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts in one language; a satellite belongs to the lowest source-1 record."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text", (F.col("doc_id") % 3).alias("m"))
    one = docs.where("m = 0").groupBy("lang", "text").agg(F.min("doc_id").alias("s1"))
    return docs.where("m <> 0").join(one, ["lang", "text"]).select("s1", F.col("doc_id").alias("s23"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a made-up probability that SQL can repeat, and a flag for a missing address."""
    p = F.col("s1") * 7919 + F.col("s23") * 104_729
    return _pairs(spark, d).select("s1", "s23", ((p % 1009) / 1009.0).alias("p"), (F.col("s23") % 5 == 0).alias("noaddr"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).where("src = 1").select(F.col("entity_id").alias("s1"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact squashed names within a country, each satellite with one owner, a list of ids for every source-1 record."""
    pairs = context.owners(_scored(spark, sf_dir)).withColumn("rank", F.struct((-F.col("p")).alias("p"), "s23"))
    return tsv.id_lists(_entities(spark, sf_dir), pairs)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


FEATURES = ["sq_prefix", "core_jacc", "core_contain", "acronym", "sfx_compat", "num_jacc", "num_contain", "lead_eq", "lead_in", "num_near", "addr_jacc", "sq_prefix_frac", "name_len_diff", "name_ntok_diff", "addr_ntok_a", "addr_ntok_b", "n_nums_a", "n_nums_b", "b_src", "n_keys"]


def _rarity(s, d):
    signed = _signed(s, d)
    out = features.rarity(_pairs(s, d).select("s1", "s23"), signed, blocking.idf(signed), "addr", "idf")
    return _round(out, *[c for c in out.columns if c.startswith("idf_")])


def _name_stats(s, d):
    signed = _signed(s, d)
    out = features.squash_counts(_pairs(s, d).select("s1", "s23"), signed)
    return _round(out, "sq_n_s1_a", "sq_n_s1_b", "sq_n_s23_b")


def _vectors(s, d):
    v = read_table(s, d, "embeddings").select("vec_id", "embedding")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    cosine = F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("s1"), F.col("embedding").alias("a"))
    met = v.select(F.col("vec_id").alias("s23"), F.col("embedding").alias("b")).join(q, F.col("s1") != F.col("s23")).select("s1", "s23", F.round(cosine, 6).alias("sim"))
    return blocking.top_k(met, "s1", "sim", "s23", 10)


def _submission(s, d):
    rows = read_table(s, d, "documents").where("doc_id % 3 = 0")
    return rows.select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("source1_entity_id"), F.concat(F.lit("S"), (F.col("doc_id") % 4).cast("string"), F.lit("-"), F.col("n_chars").cast("string"), F.lit(",S2-7,S2-7")).alias("matched_entity_ids"))


def _findings(s, d):
    required = read_table(s, d, "documents").where("doc_id % 6 = 0 or doc_id % 7 = 1").select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("s1"))
    return validate.findings(_submission(s, d), required).select("rule", "severity", "n")


def _decided(mode, tau=0.3, tau_noaddr=None):
    return lambda s, d: decide.decide(_scored(s, d), tau, mode, tau_noaddr).select("s1", "s23", "rank")


def _groups(column):
    other = "s23" if column == "s1" else "s1"
    return lambda s, d: _round(context.group_stats(_scored(s, d), column, "p", other, "g"), "p", "g_margin", "g_sum").drop("noaddr")


def _block(bit):
    return lambda s, d: _keys(s, d).where(F.col("bit") == bit).groupBy("country", "src", "key").agg(F.count("*").alias("n"), F.min("entity_id").alias("least"))


def _report(s, d):
    n = _signed(s, d).agg(F.sum((F.col("src") == 1).cast("long")).alias("a"), F.sum((F.col("src") != 1).cast("long")).alias("b")).first()
    out = evaluate.blocking_report(materialize(blocking.candidates(_keys(s, d), CAP), "candidates"), _truth(s, d), n.a or 0, n.b or 0)
    return _round(out.select("pair_completeness", "k1_recall", "k2_recall", "k3_recall", "k6_recall", "k7_recall", "k3_only", "k7_only", "found", "n_candidates", "reduction_ratio"), "pair_completeness", "k1_recall", "k2_recall", "k3_recall", "k6_recall", "k7_recall", "k3_only", "k7_only", "reduction_ratio")


def _fuzzy(s, d):
    rows = features.fuzzy(features.attach(_pairs(s, d, blocking.MAX_BLOCK), _signed(s, d)))
    return rows.select("s1", "s23", *[c for c in rows.columns if c.endswith(("_ratio", "_partial", "_tsort", "_tset", "_lcs"))])


def _jaro(s, d):
    pairs = _pairs(s, d)
    name = _signed(s, d).select("entity_id", "name_c", F.array_join("addr", " ").alias("a"))
    rows = pairs.join(name.toDF("s1", "n1", "a1"), "s1").join(name.toDF("s23", "n2", "a2"), "s23")
    none = (F.col("a1") == "") & (F.col("a2") == "")  # DuckDB's SQL has 0 for two empty texts, the function 1
    return rows.select("s1", "s23", F.when(none, 0.0).otherwise(F.round(similarity.jaro_winkler_udf("a1", "a2"), 6)).alias("addr_jw"), F.levenshtein("a1", "a2").alias("addr_edit"))


def _labelled(s, d):
    label = _truth(s, d).select("s1", "s23", F.lit(1).alias("label")).distinct()
    return _scored(s, d).join(label, ["s1", "s23"], "left").na.fill(0, ["label"])


def _pair_texts(s, d):
    raw = records.from_documents(read_table(s, d, "documents"))
    text = lambda key: raw.select(F.col("entity_id").alias(key), F.col("country").alias(f"{key}_c"), explore.record_text(F.col("business_name"), F.col("business_address")).alias(f"{key}_t"))
    rows = _pairs(s, d).join(text("s1"), "s1").join(text("s23"), "s23")
    return rows.select("s1", "s23", explore.pair_text(F.col("s1_c"), F.col("s1_t"), F.col("s23_t")).alias("text"))


def _vocabulary(s, d):
    words = _signed(s, d).where("src <> 1").select("entity_id", "country", F.get("core", 0).alias("word"))
    known = _signed(s, d).where("src = 1").select("country", F.explode("core").alias("word")).groupBy("country", "word").agg(F.count("*").alias("n"))
    return select.vocabulary_counts(words, known).select("entity_id", "word", "n")


def _core_rarity(s, d):
    signed = _signed(s, d)
    out = features.rarity(_pairs(s, d).select("s1", "s23"), signed, blocking.idf(signed, "core"), "core", "nidf")
    return _round(out, *[c for c in out.columns if c.startswith("nidf_")])


def _findings_ids(s, d):
    docs = read_table(s, d, "documents")
    rows = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("S1-"), (F.col("doc_id") % 50).cast("string")).alias("source1_entity_id"), F.concat(F.lit("S2-"), F.col("doc_id").cast("string"), F.lit(",S1-"), (F.col("doc_id") % 50).cast("string")).alias("matched_entity_ids"))
    required = docs.where("doc_id < 50").select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("s1"))
    known = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("S2-"), F.col("doc_id").cast("string")).alias("entity_id"))
    allowed = docs.where("doc_id % 5 = 0").select(F.concat(F.lit("S1-"), (F.col("doc_id") % 50).cast("string")).alias("s1"), F.concat(F.lit("S2-"), F.col("doc_id").cast("string")).alias("s23"))
    return validate.findings(rows, required, known, allowed).select("rule", "severity", "n")


def _model(s, d):
    return link.link(_signed(s, d), _truth(s, d))


def _queries() -> dict:
    return {
        "owner_id_lists": flagship,
        "records_canon": lambda s, d: records.from_documents(read_table(s, d, "documents")),
        "signatures": lambda s, d: _signed(s, d).select("entity_id", "country", "src", "name_c", F.array_join("core", " ").alias("core"), "sfx", "squash", F.array_join("addr", " ").alias("addr"), F.array_join("nums", " ").alias("nums"), "is_domain", "addr_empty"),
        "flags_quality": lambda s, d: read_table(s, d, "pages").select("page_id", text.is_domain(F.regexp_extract("url", "://([^/]*)", 1)).alias("is_domain"), text.has_indic(F.col("html")).alias("has_indic")),
        "idf_tokens": lambda s, d: _round(blocking.idf(_signed(s, d)), "idf"),
        "rare_words": lambda s, d: blocking.rare_words(_signed(s, d), blocking.idf(_signed(s, d))).select("entity_id", F.array_join("rare", " ").alias("rare")),
        "block_k1": _block(blocking.K1),
        "block_k2": _block(blocking.K2),
        "block_k3": _block(blocking.K3),
        "block_k6": _block(blocking.K6),
        "block_k7": _block(blocking.K7),
        "block_capped": lambda s, d: _pairs(s, d),
        "candidate_union": lambda s, d: blocking.candidates(_keys(s, d), CAP),
        "topk_candidates": lambda s, d: blocking.top_k(_scored(s, d), "s1", "p", "s23", 3).select("s1", "s23", "rank"),
        "feat_native": lambda s, d: _round(_attached(s, d).select("s1", "s23", *FEATURES), "core_jacc", "core_contain", "num_jacc", "num_contain", "addr_jacc", "sq_prefix_frac"),
        "feat_idf_overlap": _rarity,
        "feat_name_counts": _name_stats,
        "feat_jaro_winkler": _jaro,
        "feat_ratio_family": _fuzzy,
        "metaphone_keys": lambda s, d: _keys(s, d, blocking.K4),
        "trigram_topk": lambda s, d: blocking.trigram_top_k(*[_signed(s, d).where(c).select("entity_id", "country", F.col("name_c").alias("text")) for c in ("src = 1", "src <> 1")], k=30),
        "group_stats_s1": _groups("s1"),
        "group_stats_s23": _groups("s23"),
        "owner_partition": lambda s, d: context.owners(_scored(s, d)).select("s1", "s23"),
        "decide_threshold": _decided("threshold"),
        "decide_partition": _decided("partition", 0.3, 0.6),
        "decide_full": _decided("full", 0.1),
        "decide_full_exact": _decided("full_exact", 0.1),
        "macro_f05": lambda s, d: _round(evaluate.macro_f05(decide.decide(_scored(s, d), 0.3), _truth(s, d), _entities(s, d)), "macro_f05"),
        "tau_sweep": lambda s, d: _round(decide.sweep(_scored(s, d), _truth(s, d), _entities(s, d), ("partition", "threshold")), "macro_f05", "tau"),
        "blocking_diagnostics": _report,
        "legal_suffixes": lambda s, d: dictionaries.legal_loose(_signed(s, d), 0.01),
        "legal_strict": lambda s, d: dictionaries.legal_strict(_signed(s, d), 0.003, 0.5, 2),
        "abbreviations": lambda s, d: dictionaries.abbreviations(dictionaries.pseudo_pairs(_signed(s, d)), 1),
        "vector_topk_cosine": _vectors,
        "validator_findings": _findings,
        "roles_folds": lambda s, d: model.roles(_entities(s, d)),
        "pair_set_diff": lambda s, d: audit.pair_diff(_pairs(s, d).select("s1", "s23"), context.owners(_scored(s, d)).select("s1", "s23")),
        "symmetric_diff_tokens": lambda s, d: audit.symmetric_tokens(_attached(s, d).select(F.array_distinct("a_addr").alias("a"), F.array_distinct("b_addr").alias("b")), "a", "b"),
        "audit_slices": lambda s, d: audit.slices(_attached(s, d, blocking.MAX_BLOCK).join(_signed(s, d).select(F.col("entity_id").alias("s1"), "country"), "s1")),
        "link_model": _model,
        "country_mix": lambda s, d: _round(explore.mix(_signed(s, d), "country", "src"), "share"),
        "match_counts": lambda s, d: explore.match_counts(_entities(s, d), _truth(s, d), _signed(s, d).select(F.col("entity_id").alias("s23"), "src")),
        "partition_check": lambda s, d: explore.partition_check(_pairs(s, d)),
        "field_quality": lambda s, d: _round(explore.field_quality(read_table(s, d, "documents"), "text", "lang"), "empty", "non_ascii", "domain", "junk_prefix", "brackets", "starts_with_number", "all_caps", "mean_length"),
        "key_recall": lambda s, d: _round(explore.key_recall(_keys(s, d), _truth(s, d), {"k1": 1, "k3": 4, "k7": 64, "k3 or k7": 68, "any": 0x67}), "recall"),
        "ranking_quality": lambda s, d: _round(explore.ranking_quality(_labelled(s, d), "p", "label"), "auc", "average_precision"),
        "grey_accuracy": lambda s, d: _round(explore.grey_accuracy(_labelled(s, d)), "accuracy"),
        "record_texts": lambda s, d: records.from_documents(read_table(s, d, "documents")).select("entity_id", explore.record_text(F.col("business_name"), F.col("business_address")).alias("text")).join(_signed(s, d).select("entity_id", explore.lead_number(F.col("nums")).alias("lead")), "entity_id"),
        "pair_texts": lambda s, d: _pair_texts(s, d),
        "best_pairs": lambda s, d: select.best_per_entity(_scored(s, d)).select("s1", "s23"),
        "hard_negatives": lambda s, d: select.hard_negatives(_labelled(s, d), 3, "p").select("s1", "s23"),
        "unmatched_entities": lambda s, d: select.without_match(_entities(s, d), decide.decide(_scored(s, d), 0.5)),
        "seeded_sample": lambda s, d: select.sample(_entities(s, d), "s1", 50),
        "shuffled_records": lambda s, d: select.shuffled(_signed(s, d).select("entity_id", "country"), "entity_id"),
        "random_pairs": lambda s, d: select.random_pairs(*[_signed(s, d).where(c).select("entity_id", "country") for c in ("src = 1", "src <> 1")]),
        "unseen_countries": lambda s, d: select.unseen(_signed(s, d), _signed(s, d).where("entity_id < 3")),
        "must_match_lookup": lambda s, d: select.lookup(_pairs(s, d).select("s1", "s23"), _signed(s, d).select(F.col("entity_id").alias("s23"), "src"), "s23"),
        "aligned_scores": lambda s, d: select.aligned(_scored(s, d).select("s1", "s23", "noaddr"), _pairs(s, d), ["s1", "s23"]),
        "vocabulary_counts": _vocabulary,
        "contested_pairs": lambda s, d: audit.contested(_attached(s, d).select("s1", "s23", "lead_eq")),
        "country_rates": lambda s, d: _round(audit.country_rates(_attached(s, d).join(_signed(s, d).select(F.col("entity_id").alias("s1"), "country"), "s1").withColumn("odd", F.col("lead_eq") == 0), _signed(s, d).where("src = 1"), "odd"), "per_1000"),
        "partition_effect": lambda s, d: audit.partition_effect(_pairs(s, d).select("s1", "s23"), context.owners(_scored(s, d)).select("s1", "s23")),
        "candidates_per_entity": lambda s, d: _round(evaluate.per_entity(_pairs(s, d), _entities(s, d)), "mean", "p95", "zero_share"),
        "decide_ceiling": lambda s, d: _round(decide.ceiling(_pairs(s, d), _truth(s, d), _entities(s, d)), "macro_f05"),
        "tau_noaddr_sweep": lambda s, d: _round(decide.sweep_noaddr(_scored(s, d), _truth(s, d), _entities(s, d), 0.3), "tau_noaddr", "macro_f05"),
        "feat_context": lambda s, d: _round(link.candidate_context(_scored(s, d), "p").select("s1", "s23", "pre_rank", "n_cand", "pre_margin", "pre_rev_rank", "n_comp"), "pre_margin"),
        "feat_score_context": lambda s, d: _round(context.score_context(_scored(s, d).select("s1", "s23", F.col("p").alias("p1"))), "p1", "p1_margin", "p1_sum", "p1_rev_margin"),
        "feat_name_rarity": lambda s, d: _core_rarity(s, d),
        "feat_keys": lambda s, d: blocking.candidates(_keys(s, d), CAP).select("s1", "s23", *[F.getbit("kbits", F.lit(i)).cast("int").alias(f"k{i + 1}") for i in range(7)], F.bit_count("kbits").alias("n_keys")),
        "grey_zone": lambda s, d: model.grey(_scored(s, d), 0.1, 0.9).select("s1", "s23"),
        "confident_pairs": lambda s, d: model.pseudo_labels(_scored(s, d)).select("s1", "s23", "label"),
        "fit_entities": lambda s, d: model.fit_entities(model.roles(_entities(s, d)), 100).select("s1"),
        "exploded_links": lambda s, d: tsv.explode_links(_submission(s, d).select("source1_entity_id", F.col("matched_entity_ids"))).select("s1", "s23", tsv.encoded(F.col("s23")).alias("code")),
        "validator_ids": _findings_ids,
    }


def queries() -> dict:
    return {name: _alone(query) for name, query in _queries().items()}


_LEGAL = ", ".join(f"'{x}'" for x in records.LEGAL)
_SIG = rf"""
t as (select doc_id, lang as country, n_chars,
  list_filter(string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: x <> '') as toks from documents),
r as (select doc_id as entity_id, country, cast(1 + doc_id % 3 as integer) as src, toks[1:5] as words,
  array_to_string(toks[1:5], ' ') as business_name, array_to_string(toks[6:17], ' ') || ' ' || cast(n_chars // 100 as varchar) as business_address
  from t where len(toks) >= 1),
w as (select *, list_filter(string_split(business_address, ' '), lambda x: x <> '') as aw,
  list_filter(words, lambda x: x not in ({_LEGAL})) as kept from r),
sig as (select entity_id, country, src, business_name as name_c, words, case when len(kept) > 0 then kept else words end as core,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(words, lambda x: x in ({_LEGAL})))), ' '), '') as sfx,
  array_to_string(case when len(kept) > 0 then kept else words end, '') as squash,
  list_filter(aw, lambda x: regexp_full_match(x, '[a-z]+') and len(x) > 1) as addr,
  list_transform(regexp_extract_all(array_to_string(aw, ' '), '[0-9]+'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end) as n0,
  cast(trim(business_address) = '' as integer) as addr_empty from w),
s as (select *, list_filter(n0, lambda x, i: list_position(n0, x) = i) as nums from sig)"""
_IDF = f"""{_SIG},
voc as (select token, count(*) as df from (select unnest(list_distinct(addr)) as token from s) group by token),
idf as (select token, df, ln((select count(*) from s) / (1.0::double + df)) as idf from voc)"""
_RARE = f"""{_IDF},
by_df as (select entity_id, token, row_number() over (partition by entity_id order by df, token) as k
  from (select entity_id, unnest(list_distinct(addr)) as token from s) join voc using (token)),
rare as (select entity_id, list(token order by k) as rare from by_df where k <= 2 group by entity_id)"""
_EMIT = f"""{_RARE},
q as (select s.*, coalesce(rare, []) as rare from s left join rare using (entity_id)),
emit as (
  select entity_id, country, src, 1 as bit, n || '|' || left(x, 3) as key from (select entity_id, country, src, n, unnest(rare) as x from (select *, unnest(nums[1:3]) as n from q))
  union all select entity_id, country, src, 2, array_to_string(list_sort(rare), '|') from q where len(rare) = 2
  union all select entity_id, country, src, 4, left(squash, 8) from q where len(squash) >= 4
  union all select entity_id, country, src, 32, x || '#' || n from (select entity_id, country, src, n, unnest(list_filter(core[1:2], lambda c: len(c) >= 3)) as x from (select *, unnest(nums[1:3]) as n from q))
  union all select entity_id, country, src, 64, '=' || squash from q where len(squash) >= 6)"""


def _cand(where: str) -> str:
    return f"""one as (select distinct country, bit, key, entity_id as s1 from emit where src = 1 and {where}),
many as (select country, bit, key, entity_id as s23, count(*) over (partition by country, bit, key) as n from emit where src <> 1 and {where}),
pairs as (select s1, s23, bit_or(bit) as kbits from one join many using (country, bit, key) where n <= {CAP} group by s1, s23)"""


_PAIRS = f"{_EMIT}, {_cand('bit = 64')}"
_SCORED = f"""{_PAIRS},
scored as (select s1, s23, ((s1 * 7919 + s23 * 104729) % 1009) / 1009.0::double as p, s23 % 5 = 0 as noaddr from pairs),
owned as (select * from (select *, row_number() over (partition by s23 order by p desc, s1) as o from scored) where o = 1)"""
_TRUTH = """truth as (select b.s1, d.doc_id as s23 from documents d join (select lang, text, min(doc_id) as s1 from documents where doc_id % 3 = 0 and text is not null group by lang, text) b
  on d.lang = b.lang and d.text = b.text where d.doc_id % 3 <> 0),
entities as (select entity_id as s1 from s where src = 1)"""
_LABELLED = f"""{_SCORED}, {_TRUTH}, labelled as (select scored.*, (exists (select 1 from truth t where t.s1 = scored.s1 and t.s23 = scored.s23))::int as label from scored)"""
_F05 = """case when coalesce(n_true, 0) = 0 then case when coalesce(n_pred, 0) = 0 then 1.0 else 0.0 end else 1.25 * coalesce(tp, 0) / (0.25 * n_true + coalesce(n_pred, 0)) end"""


def _sql_stats(g: str, tie: str) -> str:
    return f"""with {_SCORED} select s1, s23, round(p, 6) as p, row_number() over (partition by {g} order by p desc, {tie})::int as g_rank,
  round(max(p) over (partition by {g}) - p, 6) as g_margin, round(sum(p) over (partition by {g}), 6) as g_sum, count(*) over (partition by {g}) as g_n,
  sum((p > 0.5)::int) over (partition by {g})::bigint as g_above from scored"""


def _sql_decide(source: str, tau: str) -> str:
    return f"""with {_SCORED} select s1, s23, rank from (select *, row_number() over (partition by s1 order by p desc, s23)::int as rank from {source}) where p >= {tau} and rank <= 8"""


def _sql_full(bottom: str) -> str:
    return f"""with {_SCORED},
placed as (select s1, s23, p, row_number() over (partition by s1 order by p desc, s23)::int as rank, sum(p) over (partition by s1 order by p desc, s23 rows unbounded preceding) as upto, sum(p) over (partition by s1) as total,
  exp(sum(ln(1 - least(p, 1 - 1e-9))) over (partition by s1)) as none from owned),
e as (select *, p >= 0.1 and rank <= 8 as ok, case when p >= 0.1 and rank <= 8 then 1.25 * upto / ({bottom}) else -1.0 end as e from placed),
b as (select *, max(e) over (partition by s1) as best from e),
k as (select *, case when none >= best then 0 else min(case when e = best then rank end) over (partition by s1) end as k from b)
select s1, s23, rank from k where ok and rank <= k"""


def _sql_block(bit: int) -> str:
    return f"with {_EMIT} select country, src, key, count(*) as n, min(entity_id) as least from emit where bit = {bit} group by country, src, key"


_SHARED = "len(list_intersect({a}, {b}))"
_JACC = "round({i} / greatest(len(list_distinct({a})) + len(list_distinct({b})) - {i}, 1)::double, 6)"


def _jacc(c: str) -> str:
    return _JACC.format(i=_SHARED.format(a=f"a.{c}", b=f"b.{c}"), a=f"a.{c}", b=f"b.{c}")


_PREFIX = "len(list_filter(range(1, least(len(a.squash), len(b.squash)) + 1), lambda i: left(a.squash, i) = left(b.squash, i)))"
_INIT = "array_to_string(list_transform({x}.core, lambda w: left(w, 1)), '')"


def oracle_sql() -> dict[str, str]:
    return {
        "owner_id_lists": f"with {_SCORED}, lists as (select s1, string_agg(s23::varchar, ',' order by p desc, s23) as ids from owned group by s1) select entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from s left join lists on s1 = entity_id where src = 1",
        "records_canon": f"with {_SIG} select entity_id, country, src, business_name, business_address from r",
        "signatures": f"with {_SIG} select entity_id, country, src, name_c, array_to_string(core, ' ') as core, sfx, squash, coalesce(array_to_string(addr, ' '), '') as addr, array_to_string(nums, ' ') as nums, 0 as is_domain, addr_empty from s",
        "flags_quality": r"select page_id, coalesce(regexp_matches(regexp_extract(url, '://([^/]*)', 1), '(?i)^\s*(www\.)?[\w-]+\.(com|net|org|in|co|fr|biz|info|us|io)\b'), false) as is_domain, coalesce(regexp_matches(html, '[\x{0900}-\x{0D7F}]'), false) as has_indic from pages",
        "idf_tokens": f"with {_IDF} select token, df, round(idf, 6) as idf from idf",
        "rare_words": f"with {_RARE} select entity_id, array_to_string(rare, ' ') as rare from rare",
        **{f"block_k{i}": _sql_block(1 << (i - 1)) for i in (1, 2, 3, 6, 7)},
        "block_capped": f"with {_PAIRS} select s1, s23, kbits from pairs",
        "candidate_union": f"with {_EMIT}, {_cand('true')} select s1, s23, kbits from pairs",
        "topk_candidates": f"with {_SCORED} select s1, s23, rank from (select *, row_number() over (partition by s1 order by p desc, s23)::int as rank from scored) where rank <= 3",
        "feat_native": f"""with {_PAIRS} select s1, s23, {_PREFIX} as sq_prefix, {_jacc('core')} as core_jacc,
  round({_SHARED.format(a='a.core', b='b.core')} / greatest(least(len(list_distinct(a.core)), len(list_distinct(b.core))), 1)::double, 6) as core_contain,
  ((len(list_distinct(a.core)) >= 2 and {_INIT.format(x='a')} = b.squash) or (len(list_distinct(b.core)) >= 2 and {_INIT.format(x='b')} = a.squash))::int as acronym,
  case when a.sfx = b.sfx then 0 when a.sfx = '' or b.sfx = '' then 1 when len(list_intersect(string_split(a.sfx, ' '), string_split(b.sfx, ' '))) > 0 then 2 else 3 end as sfx_compat,
  {_jacc('nums')} as num_jacc, round({_SHARED.format(a='a.nums', b='b.nums')} / greatest(len(a.nums), 1)::double, 6) as num_contain,
  coalesce(a.nums[1] = b.nums[1], false)::int as lead_eq, coalesce(list_contains(b.nums, a.nums[1]), false)::int as lead_in,
  (len(list_filter(a.nums[1:4], lambda p: len(list_filter(b.nums[1:4], lambda z: len(p) >= 2 and len(z) >= 2 and p <> z and levenshtein(p, z) <= 1)) > 0)) > 0)::int as num_near,
  {_jacc('addr')} as addr_jacc, round({_PREFIX} / greatest(least(len(a.squash), len(b.squash)), 1)::double, 6) as sq_prefix_frac,
  abs(len(a.name_c) - len(b.name_c)) as name_len_diff, abs(len(a.words) - len(b.words)) as name_ntok_diff, len(a.addr) as addr_ntok_a, len(b.addr) as addr_ntok_b,
  len(a.nums) as n_nums_a, len(b.nums) as n_nums_b, b.src as b_src, bit_count(kbits) as n_keys
  from pairs join s a on a.entity_id = s1 join s b on b.entity_id = s23""",
        "feat_idf_overlap": f"""with {_PAIRS}, wt as (select distinct entity_id, token, idf from (select entity_id, unnest(addr) as token from s) join idf using (token)),
tot as (select entity_id, sum(idf) as total from wt group by entity_id),
sh as (select s1, s23, sum(a.idf) as ss, max(a.idf) as sm from pairs join wt a on a.entity_id = s1 join wt b on b.entity_id = s23 and b.token = a.token group by s1, s23),
ma as (select s1, s23, max(a.idf) as m from pairs join wt a on a.entity_id = s1 where not exists (select 1 from wt b where b.entity_id = s23 and b.token = a.token) group by s1, s23),
mb as (select s1, s23, max(b.idf) as m from pairs join wt b on b.entity_id = s23 where not exists (select 1 from wt a where a.entity_id = s1 and a.token = b.token) group by s1, s23)
select p.s1, p.s23, round(coalesce(ss, 0), 6) as idf_shared_sum, round(coalesce(sm, 0), 6) as idf_shared_max,
  round(case when coalesce(ta.total, 0) = 0 then 1.0 else coalesce(ss, 0) / ta.total end, 6) as idf_cov_a, round(case when coalesce(tb.total, 0) = 0 then 1.0 else coalesce(ss, 0) / tb.total end, 6) as idf_cov_b,
  round(coalesce(ma.m, 0), 6) as idf_miss_max_a, round(coalesce(mb.m, 0), 6) as idf_miss_max_b
from pairs p left join sh using (s1, s23) left join ma using (s1, s23) left join mb using (s1, s23) left join tot ta on ta.entity_id = p.s1 left join tot tb on tb.entity_id = p.s23""",
        "feat_name_counts": f"""with {_PAIRS}, c as (select country, squash, sum((src = 1)::int) as n1, sum((src <> 1)::int) as n23 from s group by country, squash)
select s1, s23, round(ln(1 + ca.n1), 6) as sq_n_s1_a, round(ln(1 + cb.n1), 6) as sq_n_s1_b, round(ln(1 + cb.n23), 6) as sq_n_s23_b
from pairs join s a on a.entity_id = s1 join s b on b.entity_id = s23 join c ca on ca.country = a.country and ca.squash = a.squash join c cb on cb.country = b.country and cb.squash = b.squash""",
        "feat_jaro_winkler": f"""with {_PAIRS}, n as (select entity_id, coalesce(array_to_string(addr, ' '), '') as a from s)
select s1, s23, round(jaro_winkler_similarity(x.a, y.a), 6) as addr_jw, levenshtein(x.a, y.a)::int as addr_edit from pairs join n x on x.entity_id = s1 join n y on y.entity_id = s23""",
        "group_stats_s1": _sql_stats("s1", "s23"),
        "group_stats_s23": _sql_stats("s23", "s1"),
        "owner_partition": f"with {_SCORED} select s1, s23 from owned",
        "decide_threshold": _sql_decide("scored", "0.3"),
        "decide_partition": _sql_decide("owned", "case when noaddr then 0.6 else 0.3 end"),
        "decide_full": _sql_full("0.25 * rank + total"),
        "decide_full_exact": _sql_full("0.25 * total + rank"),
        "macro_f05": f"""with {_SCORED}, {_TRUTH}, pred as (select s1, s23 from (select *, row_number() over (partition by s1 order by p desc, s23) as rank from owned) where p >= 0.3 and rank <= 8),
a as (select s1, count(*) as n_pred from pred group by s1), b as (select s1, count(*) as tp from pred join truth using (s1, s23) group by s1), c as (select s1, count(*) as n_true from truth group by s1)
select round(avg({_F05}), 6) as macro_f05 from entities left join a using (s1) left join b using (s1) left join c using (s1)""",
        "tau_sweep": f"""with {_SCORED}, {_TRUTH}, taus as (select round(0.05::double + 0.025::double * i, 3) as tau from range(38) x(i)), modes as (select unnest(['partition', 'threshold']) as mode),
ranked as (select 'partition' as mode, s1, s23, p, row_number() over (partition by s1 order by p desc, s23) as rank from owned union all select 'threshold', s1, s23, p, row_number() over (partition by s1 order by p desc, s23) from scored),
pred as (select mode, tau, s1, s23 from ranked join taus on p >= tau where rank <= 8),
a as (select mode, tau, s1, count(*) as n_pred from pred group by all), b as (select mode, tau, s1, count(*) as tp from pred join truth using (s1, s23) group by all), c as (select s1, count(*) as n_true from truth group by s1),
g as (select mode, tau, s1 from modes cross join taus cross join entities)
select mode, round(tau, 6) as tau, round(avg({_F05}), 6) as macro_f05 from g left join a using (mode, tau, s1) left join b using (mode, tau, s1) left join c using (s1) group by mode, tau""",
        "blocking_diagnostics": f"""with {_EMIT}, {_cand('true')}, {_TRUTH}, j as (select t.s1, t.s23, coalesce(kbits, 0) as bits from truth t left join pairs p on p.s1 = t.s1 and p.s23 = t.s23)
select round(avg((bits > 0)::int), 6) as pair_completeness, round(avg((bits & 1 > 0)::int), 6) as k1_recall, round(avg((bits & 2 > 0)::int), 6) as k2_recall, round(avg((bits & 4 > 0)::int), 6) as k3_recall,
  round(avg((bits & 32 > 0)::int), 6) as k6_recall, round(avg((bits & 64 > 0)::int), 6) as k7_recall, round(avg((bits = 4)::int), 6) as k3_only, round(avg((bits = 64)::int), 6) as k7_only, sum((bits > 0)::int)::bigint as found,
  (select count(*) from pairs) as n_candidates, round(1 - (select count(*) from pairs) / ((select count(*) from s where src = 1) * (select count(*) from s where src <> 1))::double, 6) as reduction_ratio from j""",
        "legal_suffixes": f"""with {_SIG}, n as (select country, count(*) as n from s group by country), l as (select country, words[-1] as last, case when len(words) >= 2 then words[-2] end as before from s),
one as (select distinct last as token from (select country, last, count(*) as v from l group by all) join n using (country) where v / n::double >= 0.01),
two as (select before as token from (select country, before, last, count(*) as v from l where before is not null group by all) join n using (country) where v / n::double >= 0.01 and last in (select token from one))
select token from (select token from one union select token from two) where not regexp_full_match(token, '[0-9]+') and len(token) <= 12""",
        "legal_strict": f"""with {_SIG}, n as (select country, count(*) as n from s group by country), l as (select country, words[-1] as token, count(*) as v, count(distinct case when len(words) >= 2 then words[-2] end) as preds from s group by all),
a as (select country, token, count(*) as places from (select country, unnest(list_distinct(words)) as token from s) group by all)
select country, token from l join n using (country) join a using (country, token) where v / n::double >= 0.003 and v / places::double >= 0.5 and preds >= 2 and not regexp_full_match(token, '[0-9]+') and len(token) <= 12""",
        "vector_topk_cosine": """select s1, s23, sim, rank from (select *, row_number() over (partition by s1 order by sim desc, s23)::int as rank from (
  select a.vec_id as s1, b.vec_id as s23, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)), 6) as sim from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)) where rank <= 10""",
        "validator_findings": """with d as (select 'S1-' || doc_id as s1, 'S' || (doc_id % 4) || '-' || n_chars as m from documents where doc_id % 3 = 0), i as (select s1, unnest([m, 'S2-7', 'S2-7']) as s23 from d),
req as (select 'S1-' || doc_id as s1 from documents where doc_id % 6 = 0 or doc_id % 7 = 1),
f as (select 'duplicate_match' as rule, 'error' as severity, (select count(*) from (select 1 from i group by s1, s23 having count(*) > 1)) as n
  union all select 'self_match', 'error', (select count(*) from i where s1 = s23)
  union all select 'wrong_prefix', 'error', (select count(*) from i where not regexp_full_match(s23, 'S[23]-[0-9]+'))
  union all select 'missing_s1', 'error', (select count(*) from req where s1 not in (select s1 from d))
  union all select 'extra_s1', 'error', (select count(*) from d where s1 not in (select s1 from req)))
select * from f where n > 0""",
        "roles_folds": f"""with {_SIG}, e as (select entity_id as s1, ((entity_id * 2654435761 + 42) % 1000003) / 1000003.0::double as u, ((entity_id * 2654435761 + 7919) % 1000003) / 1000003.0::double as v from s where src = 1)
select s1, case when u < 0.05 then 'CAL' when u < 0.1 then 'TUNE' else 'TRAIN' end as role, (v < 0.5)::int as fold from e""",
        "pair_set_diff": f"with {_SCORED} select s1, s23, 'removed' as change from pairs where (s1, s23) not in (select (s1, s23) from owned)",
        "symmetric_diff_tokens": f"""with {_PAIRS}, x as (select array_to_string(list_sort(list_concat(list_filter(list_distinct(a.addr), lambda w: not list_contains(b.addr, w)), list_filter(list_distinct(b.addr), lambda w: not list_contains(a.addr, w)))), ' ') as tokens
  from pairs join s a on a.entity_id = s1 join s b on b.entity_id = s23) select tokens, count(*) as n from x where tokens <> '' group by tokens order by n desc, tokens limit 15""",
        "country_mix": f"with {_SIG} select country, src, count(*) as n, round(count(*) / (select count(*) from s)::double, 6) as share from s group by country, src",
        "match_counts": f"""with {_SIG}, {_TRUTH}, c as (select s1, sum((src = 2)::int)::bigint as n2, sum((src = 3)::int)::bigint as n3 from truth join s on entity_id = s23 group by s1)
select coalesce(n2, 0) as n2, coalesce(n3, 0) as n3, count(*) as entities from entities left join c using (s1) group by 1, 2""",
        "partition_check": f"with {_PAIRS} select count(*) as links, count(distinct s23) as satellites, count(*) - count(distinct s23) as shared from pairs",
        "field_quality": r"""with t as (select lang, coalesce(text, '') as x, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g') as l from documents)
select lang, count(*) as n, round(avg((trim(x) = '')::int), 6) as empty, round(avg(regexp_matches(x, '[^\x00-\x7F]')::int), 6) as non_ascii,
  round(avg(regexp_matches(x, '(?i)^\s*(www\.)?[\w-]+\.(com|net|org|in|co|fr|biz|info|us|io)\b')::int), 6) as domain, round(avg(regexp_matches(x, '^\s*[^0-9A-Za-z\s]')::int), 6) as junk_prefix,
  round(avg(regexp_matches(x, '[\[\](){}]')::int), 6) as brackets, round(avg(regexp_matches(x, '^\s*[0-9]')::int), 6) as starts_with_number,
  round(avg((l <> '' and l = upper(l))::int), 6) as all_caps, round(avg(length(x)), 6) as mean_length from t group by lang""",
        "key_recall": f"""with {_EMIT}, {_TRUTH}, m as (select t.s1, t.s23, coalesce(bit_or(a.bit), 0) as bits from truth t left join emit a on a.entity_id = t.s1 and exists (select 1 from emit b where b.entity_id = t.s23 and b.bit = a.bit and b.key = a.key) group by t.s1, t.s23)
select g.keys, round(avg((bits & g.b > 0)::int), 6) as recall from m, (values ('k1', 1), ('k3', 4), ('k7', 64), ('k3 or k7', 68), ('any', 103)) g(keys, b) group by g.keys""",
        "ranking_quality": f"""with {_LABELLED}, c as (select p, sum(label) as pos, sum(1 - label) as neg from labelled group by p),
run as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over (order by p desc) as tp, sum(pos + neg) over (order by p desc) as taken from c)
select sum(pos + neg)::bigint as n, sum(pos)::bigint as positives, round(sum(pos * (below + neg / 2.0::double)) / nullif(sum(pos) * sum(neg), 0), 6) as auc, round(sum(pos * tp / taken::double) / nullif(sum(pos), 0), 6) as average_precision from run""",
        "grey_accuracy": f"with {_LABELLED} select count(*) as n, round(avg(((p >= 0.5)::int = label)::int), 6) as accuracy from labelled where p between 0.01 and 0.99",
        "record_texts": f"with {_SIG} select entity_id, business_name || ' ; ' || business_address as text, case when len(nums) > 0 and len(nums[1]) <= 18 then nums[1]::bigint else -1 end as lead from s join r using (entity_id)",
        "pair_texts": f"with {_PAIRS}, x as (select entity_id, country, business_name || ' ; ' || business_address as t from r) select s1, s23, a.country || chr(10) || 'A: ' || a.t || chr(10) || 'B: ' || b.t as text from pairs join x a on a.entity_id = s1 join x b on b.entity_id = s23",
        "best_pairs": f"with {_SCORED} select s1, s23 from (select *, row_number() over (partition by s1 order by p desc, s23) as k from scored) where k = 1",
        "hard_negatives": f"with {_LABELLED} select s1, s23 from (select *, row_number() over (partition by s1 order by p desc, s23) as k from labelled where label = 0) where k <= 3",
        "unmatched_entities": f"with {_SCORED} select entity_id as s1 from s where src = 1 and entity_id not in (select s1 from owned where p >= 0.5)",
        "seeded_sample": f"with {_SIG} select entity_id as s1 from s where src = 1 order by (entity_id * 2654435761 + 1701126) % 1000003, entity_id limit 50",
        "shuffled_records": f"with {_SIG} select entity_id, country, row_number() over (partition by country order by (entity_id * 2654435761 + 1701126) % 1000003, entity_id)::int as place from s",
        "random_pairs": f"""with {_SIG}, b as (select country, entity_id as s23, row_number() over (partition by country order by entity_id) as place, count(*) over (partition by country) as n from s where src <> 1)
select a.entity_id as s1, s23 from s a join b on a.country = b.country and place = ((a.entity_id * 2654435761 + 1701126) % 1000003) % n + 1 where a.src = 1""",
        "unseen_countries": f"with {_SIG} select distinct country from s where country is not null and country not in (select country from s where entity_id < 3 and country is not null)",
        "must_match_lookup": f"with {_PAIRS} select s1, s23, src from pairs join s on entity_id = s23",
        "aligned_scores": f"with {_SCORED} select s1, s23, noaddr, kbits from scored join pairs using (s1, s23)",
        "vocabulary_counts": f"""with {_SIG}, v as (select country, word, count(*) as n from (select country, unnest(core) as word from s where src = 1) group by all)
select entity_id, core[1] as word, coalesce(n, 0) as n from s left join v on v.country = s.country and v.word = core[1] where src <> 1""",
        "contested_pairs": f"""with {_PAIRS}, l as (select s1, s23, coalesce(a.nums[1] = b.nums[1], false)::int as lead_eq from pairs join s a on a.entity_id = s1 join s b on b.entity_id = s23)
select s1, s23, lead_eq, max(lead_eq) over (partition by s1) as some_lead_eq, count(*) over (partition by s23) >= 2 as contested from l""",
        "country_rates": f"""with {_PAIRS}, f as (select a.country, sum((not coalesce(a.nums[1] = b.nums[1], false))::int)::bigint as flagged from pairs join s a on a.entity_id = s1 join s b on b.entity_id = s23 group by a.country),
e as (select country, count(*) as records from s where src = 1 group by country)
select e.country, records, coalesce(flagged, 0) as flagged, round(1000.0::double * coalesce(flagged, 0) / records, 6) as per_1000 from e left join f using (country)""",
        "partition_effect": f"with {_SCORED} select (select count(*) from pairs) - (select count(*) from owned) as dropped, (select count(distinct s1) from pairs) - (select count(distinct s1) from owned) as emptied",
        "candidates_per_entity": f"with {_PAIRS}, c as (select entity_id, count(p.s1) as n from s left join pairs p on p.s1 = entity_id where src = 1 group by entity_id) select round(avg(n), 6) as mean, round(quantile_cont(n, 0.95), 6) as p95, max(n) as largest, round(avg((n = 0)::int), 6) as zero_share from c",
        "decide_ceiling": f"""with {_PAIRS}, {_TRUTH}, a as (select s1, count(*) as n_pred from truth join pairs using (s1, s23) group by s1), b as (select s1, n_pred as tp from a), c as (select s1, count(*) as n_true from truth group by s1)
select round(avg({_F05}), 6) as macro_f05 from entities left join a using (s1) left join b using (s1) left join c using (s1)""",
        "tau_noaddr_sweep": f"""with {_SCORED}, {_TRUTH}, taus as (select round(0.05::double + 0.025::double * i, 3) as tau from range(38) x(i) union all select unnest([0.97::double, 0.99::double])), grid as (select tau from taus where tau >= 0.3),
ranked as (select s1, s23, p, noaddr, row_number() over (partition by s1 order by p desc, s23) as rank from owned), pred as (select tau, s1, s23 from ranked join grid on p >= case when noaddr then tau else 0.3 end where rank <= 8),
a as (select tau, s1, count(*) as n_pred from pred group by all), b as (select tau, s1, count(*) as tp from pred join truth using (s1, s23) group by all), c as (select s1, count(*) as n_true from truth group by s1), g as (select tau, s1 from grid cross join entities)
select round(tau, 6) as tau_noaddr, round(avg({_F05}), 6) as macro_f05 from g left join a using (tau, s1) left join b using (tau, s1) left join c using (s1) group by tau""",
        "feat_context": f"""with {_SCORED} select s1, s23, row_number() over (partition by s1 order by p desc, s23)::int as pre_rank, count(*) over (partition by s1) as n_cand, round(max(p) over (partition by s1) - p, 6) as pre_margin,
  row_number() over (partition by s23 order by p desc, s1)::int as pre_rev_rank, count(*) over (partition by s23) as n_comp from scored""",
        "feat_score_context": f"""with {_SCORED} select s1, s23, round(p, 6) as p1, row_number() over (partition by s1 order by p desc, s23)::int as p1_rank, round(max(p) over (partition by s1) - p, 6) as p1_margin, round(sum(p) over (partition by s1), 6) as p1_sum,
  sum((p > 0.5)::int) over (partition by s1)::bigint as p1_n_above, row_number() over (partition by s23 order by p desc, s1)::int as p1_rev_rank, round(max(p) over (partition by s23) - p, 6) as p1_rev_margin from scored""",
        "feat_name_rarity": f"""with {_PAIRS}, cvoc as (select token, count(*) as df from (select unnest(list_distinct(core)) as token from s) group by token),
cidf as (select token, ln((select count(*) from s) / (1.0::double + df)) as idf from cvoc),
wt as (select distinct entity_id, token, idf from (select entity_id, unnest(core) as token from s) join cidf using (token)),
tot as (select entity_id, sum(idf) as total from wt group by entity_id),
sh as (select s1, s23, sum(a.idf) as ss, max(a.idf) as sm from pairs join wt a on a.entity_id = s1 join wt b on b.entity_id = s23 and b.token = a.token group by s1, s23),
ma as (select s1, s23, max(a.idf) as m from pairs join wt a on a.entity_id = s1 where not exists (select 1 from wt b where b.entity_id = s23 and b.token = a.token) group by s1, s23),
mb as (select s1, s23, max(b.idf) as m from pairs join wt b on b.entity_id = s23 where not exists (select 1 from wt a where a.entity_id = s1 and a.token = b.token) group by s1, s23)
select p.s1, p.s23, round(coalesce(ss, 0), 6) as nidf_shared_sum, round(coalesce(sm, 0), 6) as nidf_shared_max,
  round(case when coalesce(ta.total, 0) = 0 then 1.0 else coalesce(ss, 0) / ta.total end, 6) as nidf_cov_a, round(case when coalesce(tb.total, 0) = 0 then 1.0 else coalesce(ss, 0) / tb.total end, 6) as nidf_cov_b,
  round(coalesce(ma.m, 0), 6) as nidf_miss_max_a, round(coalesce(mb.m, 0), 6) as nidf_miss_max_b
from pairs p left join sh using (s1, s23) left join ma using (s1, s23) left join mb using (s1, s23) left join tot ta on ta.entity_id = p.s1 left join tot tb on tb.entity_id = p.s23""",
        "feat_keys": f"with {_EMIT}, {_cand('true')} select s1, s23, " + ", ".join(f"(kbits >> {i}) & 1 as k{i + 1}" for i in range(7)) + ", bit_count(kbits) as n_keys from pairs",
        "grey_zone": f"with {_SCORED} select s1, s23 from scored where p between 0.1 and 0.9",
        "confident_pairs": f"with {_SCORED} select s1, s23, (p >= 0.97)::int as label from scored where p >= 0.97 or p <= 0.03",
        "fit_entities": f"with {_SIG} select entity_id as s1 from s where src = 1 and ((entity_id * 2654435761 + 42) % 1000003) / 1000003.0::double >= 0.1 order by ((entity_id * 2654435761 + 17) % 1000003) / 1000003.0::double, entity_id limit 100",
        "exploded_links": """with x as (select 'S1-' || doc_id as s1, unnest(['S' || (doc_id % 4) || '-' || n_chars, 'S2-7', 'S2-7']) as s23 from documents where doc_id % 3 = 0) select s1, s23, s23[2]::bigint * 10000000000 + s23[4:]::bigint as code from x""",
        "validator_ids": """with d as (select 'S1-' || (doc_id % 50) as s1, doc_id from documents where doc_id % 3 = 0), i as (select s1, unnest(['S2-' || doc_id, s1]) as s23 from d),
req as (select 'S1-' || doc_id as s1 from documents where doc_id < 50), f as (
  select 'duplicate_s1' as rule, 'error' as severity, (select count(*) from (select 1 from d group by s1 having count(*) > 1)) as n
  union all select 'duplicate_match', 'error', (select count(*) from (select 1 from i group by s1, s23 having count(*) > 1))
  union all select 'self_match', 'error', (select count(*) from i where s1 = s23)
  union all select 'wrong_prefix', 'error', (select count(*) from i where not regexp_full_match(s23, 'S[23]-[0-9]+'))
  union all select 'missing_s1', 'error', (select count(*) from req where s1 not in (select s1 from d))
  union all select 'extra_s1', 'error', (select count(*) from d where s1 not in (select s1 from req))
  union all select 'unknown_id', 'error', (select count(*) from i where s23 not in (select 'S2-' || doc_id from documents where doc_id % 2 = 0))
  union all select 'not_a_candidate', 'warning', (select count(*) from i where not exists (select 1 from documents c where c.doc_id % 5 = 0 and 'S1-' || (c.doc_id % 50) = i.s1 and 'S2-' || c.doc_id = i.s23)))
select * from f where n > 0""",
    }
