"""The whole linkage: records to candidates, features, scores and an assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking, decide, features, model
from tessera.operators.context import group_stats
from tessera.session import materialize, release, settle

#: The 66 features of the first pass.
NUMERIC = [
    *("name_ratio", "name_partial", "name_tsort", "name_tset", "core_ratio", "core_tset", "sq_ratio", "sq_partial", "sq_jw", "sq_lcs", "sq_prefix", "phon_ratio", "addr_ratio", "addr_partial", "addr_tsort", "addr_tset", "num_tset"),
    *("core_jacc", "core_contain", "acronym", "sfx_compat", "num_jacc", "num_contain", "lead_eq", "lead_in", "num_near", "addr_jacc", "idf_cov_a", "idf_cov_b", "idf_shared_sum", "idf_shared_max"),
    *("sq_prefix_frac", "name_len_diff", "name_ntok_diff", "addr_ntok_a", "addr_ntok_b", "n_nums_a", "n_nums_b", "b_is_domain", "b_non_latin", "b_addr_empty", "b_src"),
    *(f"k{i}" for i in range(1, 8)), *("n_keys", "prescore", "ann_sim", "pre_rank", "n_cand", "pre_margin", "pre_rev_rank", "n_comp"),
    *("nidf_shared_sum", "nidf_shared_max", "nidf_cov_a", "nidf_cov_b", "nidf_miss_max_a", "nidf_miss_max_b", "sq_n_s1_a", "sq_n_s1_b", "sq_n_s23_b"),
]
ANN_K = 30


def with_neighbours(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Candidates (s1, s23, kbits) and nearest names (s1, s23, sim) as one table with ``ann_sim``, 0 where K5 did not find
    the pair; bits are joined, and of several similarities the largest stays."""
    found = pairs.select("s1", "s23", "kbits", F.lit(0.0).alias("sim")).unionByName(near.select("s1", "s23", F.lit(blocking.K5).alias("kbits"), "sim"))
    return found.groupBy("s1", "s23").agg(F.bit_or("kbits").alias("kbits"), F.max("sim").alias("ann_sim"))


def candidate_table(signed: DataFrame, cap: int = blocking.MAX_BLOCK, k: int = blocking.MAX_CANDIDATES, ann_k: int = ANN_K) -> DataFrame:
    """The best ``k`` candidates of each record by pre-score, from all seven keys."""
    rare = blocking.rare_words(signed, blocking.idf(signed))
    emitted = materialize(blocking.keys(signed, rare, 0x7F & ~blocking.K5), "keys")
    text = F.concat_ws(" ", "name_c", F.array_join("addr", " "), F.array_join("nums", " "))
    of = lambda c: signed.where(c).select("entity_id", "country", text.alias("text"))
    pairs = with_neighbours(blocking.candidates(emitted, cap), blocking.trigram_top_k(of("src = 1"), of("src <> 1"), ann_k))
    return blocking.top_k(blocking.prescore(pairs, signed), "s1", "prescore", "s23", k).drop("rank")


def feature_table(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Everything the classifier reads: the competition of both sides by pre-score, told of the pairs alone, then forms and
    rarity of shared words. Pairs meet each record once, with all that is needed of it."""
    records = materialize(features.sides(signed, {"addr": blocking.idf(signed), "core": blocking.idf(signed, "core")}), "sides")
    return features.pair_features(candidate_context(pairs), records, {"addr": "idf", "core": "nidf"})


def candidate_context(rows: DataFrame, score: str = "prescore") -> DataFrame:
    """``rows`` with each pair's place among its record's pairs (pre_rank, n_cand, pre_margin) and among its satellite's
    (pre_rev_rank, n_comp)."""
    rows = group_stats(group_stats(rows, "s1", score, "s23", "__a"), "s23", score, "s1", "__b")
    rows = rows.withColumnsRenamed({"__a_rank": "pre_rank", "__a_margin": "pre_margin", "__a_n": "n_cand", "__b_rank": "pre_rev_rank", "__b_n": "n_comp"})
    return rows.drop("__a_sum", "__a_above", "__b_margin", "__b_sum", "__b_above")


def link(signed: DataFrame, truth: DataFrame, tau: float = 0.5, mode: str = "partition", cap: int = blocking.MAX_BLOCK, trees: int = 10) -> DataFrame:
    """(s1, s23, p, rank): trained on ``truth`` (s1, s23) of the TRAIN entities, decided for all. Signatures, candidates and
    features are tables in the shared folder, as several jobs read them."""
    signed = materialize(signed, "signatures")
    pairs = settle(lambda: candidate_table(signed, cap), "candidates")
    known = pairs.join(truth.select("s1", "s23", F.lit(1).alias("label")).distinct(), ["s1", "s23"], "left").na.fill(0, ["label"])
    entities = signed.where("src = 1").select(F.col("entity_id").alias("s1"))
    known = known.join(model.roles(entities, 0.3), "s1")
    rows = settle(lambda: feature_table(known, signed), "features")
    fitted, scored = model.train_scored(rows, NUMERIC, trees)
    release(rows, pairs)
    done = model.second_pass(fitted, scored).select("s1", "s23", "p", ((F.col("a_addr_empty") + F.col("b_addr_empty")) > 0).alias("noaddr"))
    return decide.decide(done, tau, mode).select("s1", "s23", "p", "rank")
