"""From pair scores to an assignment, and the search for its thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.context import owners

MODES = ("partition", "threshold", "full")
MAX_MATCHES = 8
TAUS = [round(0.05 + 0.025 * i, 3) for i in range(38)]


def decide(pairs: DataFrame, tau: float | Column, mode: str = "partition", tau_noaddr: float | Column | None = None, most: int = MAX_MATCHES) -> DataFrame:
    """The accepted rows of ``pairs`` (s1, s23, p and, with ``tau_noaddr``, noaddr), with ``rank``.

    threshold: every pair counts; else only the best claimant of each satellite, before any threshold. Ranked by p within s1,
    a pair is allowed from tau on and within the first ``most``. full and full_exact accept the prefix that maximises an
    expected score: ``1.25 S / (0.25 k + T)`` as commonly written here, or ``1.25 S / (0.25 T + k)``, the F0.5 itself."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    if tau_noaddr is not None:
        tau = F.when(F.col("noaddr").cast("boolean"), tau_noaddr if isinstance(tau_noaddr, Column) else F.lit(tau_noaddr)).otherwise(tau)
    return _decided(pairs if mode == "threshold" else owners(pairs), tau, mode, most, [])


def _decided(live: DataFrame, tau: Column, mode: str, most: int, by: list[str]) -> DataFrame:
    own = Window.partitionBy(*by, "s1")
    order = own.orderBy(F.desc("p"), "s23")
    rows = live.withColumn("rank", F.row_number().over(order)).withColumn("__ok", (F.col("p") >= tau) & (F.col("rank") <= most))
    if not mode.startswith("full"):
        return rows.where("__ok").drop("__ok")
    total = F.sum("p").over(own)
    upto = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bottom = 0.25 * F.col("rank") + total if mode == "full" else 0.25 * total + F.col("rank")
    rows = rows.withColumn("__e", F.when(F.col("__ok"), 1.25 * upto / bottom).otherwise(-1.0))
    rows = rows.withColumn("__none", F.exp(F.sum(F.log(1 - F.least("p", F.lit(1 - 1e-9)))).over(own))).withColumn("__best", F.max("__e").over(own))
    rows = rows.withColumn("__k", F.when(F.col("__none") >= F.col("__best"), 0).otherwise(F.min(F.when(F.col("__e") == F.col("__best"), F.col("rank"))).over(own)))
    return rows.where("__ok and rank <= __k").drop("__ok", "__e", "__none", "__best", "__k")


def ceiling(candidates: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """The score of a perfect matcher on the candidates: it accepts every candidate that is true."""
    from tessera.operators.evaluate import macro_f05

    return macro_f05(truth.join(candidates.select("s1", "s23").distinct(), ["s1", "s23"], "left_semi"), truth, entities)


NOADDR_TAUS = [*TAUS, 0.97, 0.99]


def sweep_noaddr(pairs: DataFrame, truth: DataFrame, entities: DataFrame, tau: float, mode: str = "partition", taus: list[float] | None = None) -> DataFrame:
    """(tau_noaddr, macro_f05) for the thresholds not under ``tau`` of pairs without an address, in one job. Ranks and owners
    don't depend on the threshold, so each pair is ranked once."""
    from tessera.operators.evaluate import macro_f05

    grid = [t for t in (taus or NOADDR_TAUS) if t >= tau]
    ranked = decide(pairs, -1.0, mode).withColumn("tau_noaddr", F.explode(F.array(*map(F.lit, grid))))
    kept = ranked.where(F.col("p") >= F.when(F.col("noaddr").cast("boolean"), F.col("tau_noaddr")).otherwise(F.lit(tau)))
    table = entities.sparkSession.createDataFrame([(t,) for t in grid], "tau_noaddr double")
    return macro_f05(kept, truth, entities, by=["tau_noaddr"], grid=table)


def search(pairs: DataFrame, truth: DataFrame, entities: DataFrame, modes: tuple[str, ...] = MODES) -> dict:
    """The setting of the best score: mode and tau by ``best_setting``; then a threshold for pairs without an address, if one
    is strictly better. What comes to the driver is a row a setting."""
    from tessera.operators.evaluate import best_setting

    best = best_setting(sweep(pairs, truth, entities, modes)).first()
    out = {"mode": best.mode, "tau": best.tau, "tau_noaddr": best.tau, "macro_f05": best.macro_f05}
    if not best.mode.startswith("full"):
        for row in sweep_noaddr(pairs, truth, entities, best.tau, best.mode).orderBy("tau_noaddr").collect():
            if row.macro_f05 > out["macro_f05"] + 1e-12:
                out |= {"tau_noaddr": row.tau_noaddr, "macro_f05": row.macro_f05}
    return out


def sweep(pairs: DataFrame, truth: DataFrame, entities: DataFrame, modes: tuple[str, ...] = MODES, taus: list[float] | None = None) -> DataFrame:
    """(mode, tau, macro_f05) of the whole grid. Without a prefix rule (threshold, partition) a threshold only cuts each
    record's ranking, so every pair adds what it changes of its record's score to all thresholds up to its own: one pass over
    the pairs, then sums over as many rows as there are thresholds. Otherwise pairs meet the thresholds they pass."""
    from tessera.operators.evaluate import macro_f05

    taus = sorted(taus or TAUS)
    cut = [m for m in modes if not m.startswith("full")]
    out = [_curve(decide(pairs, -1.0, m), truth, entities, taus).select(F.lit(m).alias("mode"), "tau", "macro_f05") for m in cut]
    rest = [m for m in modes if m.startswith("full")]
    if rest:
        every = F.explode(F.array(*map(F.lit, taus)))
        found = [_decided(owners(pairs).withColumn("tau", every), F.col("tau"), m, MAX_MATCHES, ["tau"]).select(F.lit(m).alias("mode"), "tau", "s1", "s23") for m in rest]
        grid = entities.sparkSession.createDataFrame([(m, t) for m in rest for t in taus], "mode string, tau double")
        out.append(macro_f05(reduce(DataFrame.unionByName, found), truth, entities, by=["mode", "tau"], grid=grid).select("mode", "tau", "macro_f05"))
    return reduce(DataFrame.unionByName, out)


def _curve(ranked: DataFrame, truth: DataFrame, entities: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, macro_f05) of ``ranked`` (s1, s23, p, rank) cut at each of the ascending ``taus``."""
    links = truth.select("s1", "s23").distinct()
    n_true = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    every = entities.select("s1").join(n_true, "s1", "left").na.fill(0, ["n_true"])
    rows = ranked.select("s1", "s23", "p", "rank").join(every, "s1").join(links.withColumn("hit", F.lit(1)), ["s1", "s23"], "left").na.fill(0, ["hit"])
    tp = F.sum("hit").over(Window.partitionBy("s1").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    score = lambda tp, n: F.when(F.col("n_true") == 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(1.25 * tp / (0.25 * F.col("n_true") + n))
    rows = rows.withColumn("tp", tp).withColumn("gain", score(F.col("tp"), F.col("rank")) - score(F.col("tp") - F.col("hit"), F.col("rank") - 1))
    passed = F.size(F.filter(F.array(*map(F.lit, taus)), lambda t: t <= F.col("p")))
    gains = rows.withColumn("i", passed).where("i > 0").groupBy("i").agg(F.sum("gain").alias("gain"))
    base = every.agg(F.sum((F.col("n_true") == 0).cast("double")).alias("base"), F.count("*").alias("n"))
    grid = entities.sparkSession.createDataFrame(list(enumerate(taus, 1)), "i int, tau double")
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the grid, a parameter
    summed = grid.join(gains, "i", "left").withColumn("all", F.sum(F.coalesce("gain", F.lit(0.0))).over(down))
    return summed.crossJoin(F.broadcast(base)).select("tau", ((F.col("base") + F.col("all")) / F.col("n")).alias("macro_f05"))  # one row


def ceiling(candidates: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """The score of a perfect matcher on the candidates: it accepts every candidate that is true."""
    from tessera.operators.evaluate import macro_f05

    return macro_f05(truth.join(candidates.select("s1", "s23").distinct(), ["s1", "s23"], "left_semi"), truth, entities)


NOADDR_TAUS = [*TAUS, 0.97, 0.99]


def sweep_noaddr(pairs: DataFrame, truth: DataFrame, entities: DataFrame, tau: float, mode: str = "partition", taus: list[float] | None = None) -> DataFrame:
    """(tau_noaddr, macro_f05) for the thresholds not under ``tau`` of pairs without an address, in one job. Ranks and owners
    don't depend on the threshold, so each pair is ranked once."""
    from tessera.operators.evaluate import macro_f05

    grid = [t for t in (taus or NOADDR_TAUS) if t >= tau]
    ranked = decide(pairs, -1.0, mode).withColumn("tau_noaddr", F.explode(F.array(*map(F.lit, grid))))
    kept = ranked.where(F.col("p") >= F.when(F.col("noaddr").cast("boolean"), F.col("tau_noaddr")).otherwise(F.lit(tau)))
    table = entities.sparkSession.createDataFrame([(t,) for t in grid], "tau_noaddr double")
    return macro_f05(kept, truth, entities, by=["tau_noaddr"], grid=table)


def search(pairs: DataFrame, truth: DataFrame, entities: DataFrame, modes: tuple[str, ...] = MODES) -> dict:
    """The setting of the best score: mode and tau by ``best_setting``; then a threshold for pairs without an address, if one
    is strictly better. What comes to the driver is a row a setting."""
    from tessera.operators.evaluate import best_setting

    best = best_setting(sweep(pairs, truth, entities, modes)).first()
    out = {"mode": best.mode, "tau": best.tau, "tau_noaddr": best.tau, "macro_f05": best.macro_f05}
    if not best.mode.startswith("full"):
        for row in sweep_noaddr(pairs, truth, entities, best.tau, best.mode).orderBy("tau_noaddr").collect():
            if row.macro_f05 > out["macro_f05"] + 1e-12:
                out |= {"tau_noaddr": row.tau_noaddr, "macro_f05": row.macro_f05}
    return out


def sweep(pairs: DataFrame, truth: DataFrame, entities: DataFrame, modes: tuple[str, ...] = MODES, taus: list[float] | None = None) -> DataFrame:
    """(mode, tau, macro_f05) of the whole grid in one job: pairs meet the small table of thresholds they pass."""
    from tessera.operators.evaluate import macro_f05

    taus = taus or TAUS
    every = F.explode(F.array(*map(F.lit, taus)))
    found = []
    for mode in modes:
        if mode.startswith("full"):
            kept = _decided(owners(pairs).withColumn("tau", every), F.col("tau"), mode, MAX_MATCHES, ["tau"])
        else:  # ranks don't depend on the threshold
            kept = decide(pairs, -1.0, mode).withColumn("tau", every).where("p >= tau")
        found.append(kept.select(F.lit(mode).alias("mode"), "tau", "s1", "s23"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    grid = entities.sparkSession.createDataFrame([(m, t) for m in modes for t in taus], "mode string, tau double")
    return macro_f05(out, truth, entities, by=["mode", "tau"], grid=grid)
