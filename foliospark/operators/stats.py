"""Intervals and paired tests. Spark reduces the data to cluster totals; numpy draws over small groups in one task, and
weighs the clusters of large ones partition by partition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats_exprs import wilson
from ..functions.udfs import mcnemar_p
from ..sources.stages import staged
from .metrics import SCORES, first_hits, generation_pools, metric_values

INTERVAL = "estimate double, low double, high double, n long, method string, confidence double"


#: Clusters of a group up to which one task redraws them; larger groups get Poisson weights where their clusters are.
ONE_TASK = 20_000


def ratio_draws(total: np.ndarray, count: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Resampled ratios of sums. Drawing clusters with replacement is drawing how often each one comes from a multinomial."""
    rng, n = np.random.default_rng(seed), len(total)
    even, step = np.full(n, 1 / n), max(1, 1_000_000 // n)
    times = (rng.multinomial(n, even, min(step, draws - k)) for k in range(0, draws, step))
    return np.concatenate([(w @ total) / (w @ count) for w in times])


_TIMES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def poisson_times(hashes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each cluster comes in each draw: Poisson with mean 1, from a hash of cluster and draw alone."""
    h = hashes.astype(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_TIMES, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right")


def poisson_draws(totals: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """``draw, ratio`` of each group: every partition weighs its own clusters, and only sums by draw are shuffled.

    A draw in which no cluster comes is left out. The result depends on the clusters' names, not on the partitions.
    """
    kinds = dict(totals.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", t array<double>, c array<double>"
    names, numbers = [*by, "t", "c"], np.arange(draws)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for key, rows in batch.groupby(by, dropna=False, sort=False):
                key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                t, c = sums.setdefault(key, (np.zeros(draws), np.zeros(draws)))
                for k in range(0, len(rows), 128):
                    part = rows.iloc[k : k + 128]
                    times = poisson_times(part["hash"].to_numpy(), numbers)
                    t += part["total"].to_numpy(float) @ times
                    c += part["count"].to_numpy(float) @ times
            if len(sums) > 100:
                yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=names)
                sums = {}
        if sums:
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=names)

    hashed = totals.select(*by, F.xxhash64(F.lit(seed), F.col("cluster")).alias("hash"), "total", "count")
    parts = hashed.mapInPandas(weigh, schema).select(*by, F.posexplode(F.arrays_zip("t", "c")).alias("draw", "x"))
    sums = parts.groupBy(*by, "draw").agg(F.sum("x.t").alias("t"), F.sum("x.c").alias("c"))
    return sums.where("c > 0").select(*by, "draw", (F.col("t") / F.col("c")).alias("ratio"))


def _by_size(totals: DataFrame, by: list[str], one_task: int) -> tuple[DataFrame, DataFrame | None]:
    """The totals of groups that one task can redraw, and those of larger groups (None if there are none)."""
    totals = staged(totals)
    sizes = totals.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > one_task).select(*by)
    if not sizes.limit(1).count():
        return totals, None
    large = sizes.withColumnsRenamed({b: f"__{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return totals.join(large, same, "left_anti"), totals.join(large, same, "left_semi")


def _large(totals: DataFrame, by: list[str], draws: int, seed: int, tail: float) -> DataFrame:
    """Estimate, interval and signs of the draws of groups with many clusters."""
    drawn = poisson_draws(totals, by, draws, seed).groupBy(*by).agg(
        F.percentile("ratio", F.lit(tail)).alias("low"), F.percentile("ratio", F.lit(1 - tail)).alias("high"),
        F.count_if(F.col("ratio") <= 0).alias("under"), F.count_if(F.col("ratio") >= 0).alias("over"),
    )
    whole = totals.groupBy(*by).agg((F.sum("total") / F.sum("count")).alias("estimate"), F.sum("count").alias("n"))
    drawn = drawn.withColumnsRenamed({b: f"__{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return whole.join(drawn, same).drop(*[f"__{b}" for b in by])


def cluster_totals(values: DataFrame, by: list[str], cluster: str) -> DataFrame:
    return values.groupBy(*by, F.col(cluster).cast("string").alias("cluster")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("count")
    )


def cluster_bootstrap(
    values: DataFrame, by: list[str], cluster: str, draws: int = 10_000, seed: int = 13, confidence: float = 0.95, one_task: int = ONE_TASK
) -> DataFrame:
    """Percentile interval of a mean for each group, over clusters in the order of their names, so draws repeat.

    A group of over ``one_task`` clusters is drawn by Poisson weights, which agree with redrawing the more, the more
    clusters there are; no task holds such a group.
    """
    tail = (1 - confidence) / 2

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster", kind="stable")
        total, count = rows["total"].to_numpy(float), rows["count"].to_numpy(float)
        drawn = ratio_draws(total, count, draws, seed)
        low, high = np.quantile(drawn, [tail, 1 - tail])
        out = {b: rows[b].iloc[0] for b in by}
        out |= {"estimate": total.sum() / count.sum(), "low": low, "high": high, "n": int(count.sum()), "method": "bootstrap", "confidence": confidence}
        return pd.DataFrame([out])

    totals, many = _by_size(cluster_totals(values, by, cluster), by, one_task)
    keys = ", ".join(f"{b} {dict(values.dtypes)[b]}" for b in by)
    out = totals.groupBy(*by).applyInPandas(interval, f"{keys}, {INTERVAL}")
    if many is None:
        return out
    large = _large(many, by, draws, seed, tail)
    return out.unionByName(large.select(*by, "estimate", "low", "high", "n", F.lit("bootstrap").alias("method"), F.lit(confidence).alias("confidence")))


def summarize(values: DataFrame, by: list[str], cluster: str | None = None, **options) -> DataFrame:
    """Wilson's interval for 0/1 values without clusters, the bootstrap for everything else."""
    if cluster is not None:
        return cluster_bootstrap(values, by, cluster, **options)
    binary = values.groupBy(*by).agg(
        F.sum("value").alias("k"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("binary")
    )
    plain = binary.where("binary").withColumn("w", wilson("k", "n")).select(
        *by, "w.estimate", "w.low", "w.high", "n", F.lit("wilson").alias("method"), F.lit(0.95).alias("confidence")
    )
    rest = values.join(binary.where("NOT binary").select(*by), by, "left_semi")
    return plain.unionByName(histogram_bootstrap(rest, by, **options))


def histogram_bootstrap(values: DataFrame, by: list[str], draws: int = 10_000, seed: int = 13, confidence: float = 0.95) -> DataFrame:
    """The bootstrap of single values. Spark counts the rows of each value; drawing rows with replacement is drawing
    these counts from a multinomial, so what one task holds is the number of different values, not of rows."""
    tail = (1 - confidence) / 2

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value", kind="stable")
        value, count = rows["value"].to_numpy(float), rows["count"].to_numpy(np.int64)
        n, rng = int(count.sum()), np.random.default_rng(seed)
        step = max(1, 2_000_000 // len(value))
        drawn = np.concatenate([rng.multinomial(n, count / n, min(step, draws - k)) @ value / n for k in range(0, draws, step)])
        low, high = np.quantile(drawn, [tail, 1 - tail])
        out = {b: rows[b].iloc[0] for b in by}
        return pd.DataFrame([out | {"estimate": float(value @ count) / n, "low": low, "high": high, "n": n, "method": "bootstrap", "confidence": confidence}])

    counted = values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("count"))
    keys = ", ".join(f"{b} {dict(values.dtypes)[b]}" for b in by)
    return counted.groupBy(*by).applyInPandas(interval, f"{keys}, {INTERVAL}")


def paired(values: DataFrame, base: str, by: list[str]) -> DataFrame:
    """Differences of each other system to ``base`` by question: value (a - b), value_a, value_b."""
    b = values.where(F.col("system") == base).select("question_id", *by, F.col("value").alias("value_b"))
    a = values.where(F.col("system") != base).withColumnRenamed("value", "value_a")
    return a.join(b, ["question_id", *by]).withColumn("value", F.col("value_a") - F.col("value_b"))


def paired_bootstrap(
    differences: DataFrame, by: list[str], cluster: str, draws: int = 10_000, seed: int = 13, confidence: float = 0.95, one_task: int = ONE_TASK
) -> DataFrame:
    """Mean difference with interval, two-sided p (with one added to both counts), and a verdict from the interval.

    Groups of over ``one_task`` clusters are drawn as in ``cluster_bootstrap``.
    """
    tail = (1 - confidence) / 2

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster", kind="stable")
        total, count = rows["total"].to_numpy(float), rows["count"].to_numpy(float)
        drawn = ratio_draws(total, count, draws, seed)
        low, high = np.quantile(drawn, [tail, 1 - tail])
        p = min(1.0, 2 * (min((drawn <= 0).sum(), (drawn >= 0).sum()) + 1) / (draws + 1))
        verdict = "better" if low > 0 else "worse" if high < 0 else "no clear difference"
        out = {b: rows[b].iloc[0] for b in by}
        return pd.DataFrame([out | {"difference": total.sum() / count.sum(), "low": low, "high": high, "p_value": p, "n": int(count.sum()), "verdict": verdict}])

    totals, many = _by_size(cluster_totals(differences, by, cluster), by, one_task)
    keys = ", ".join(f"{b} {dict(differences.dtypes)[b]}" for b in by)
    out = totals.groupBy(*by).applyInPandas(test, f"{keys}, difference double, low double, high double, p_value double, n long, verdict string")
    if many is None:
        return out
    p = F.least(F.lit(1.0), 2 * (F.least("under", "over") + 1) / F.lit(draws + 1))
    verdict = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("no clear difference")
    large = _large(many, by, draws, seed, tail)
    return out.unionByName(large.select(*by, F.col("estimate").alias("difference"), "low", "high", p.alias("p_value"), "n", verdict.alias("verdict")))


def mcnemar_counts(differences: DataFrame, by: list[str]) -> DataFrame:
    """Questions that only a, or only b, got right (0/1 values)."""
    a, b = F.col("value_a") > 0, F.col("value_b") > 0
    return differences.groupBy(*by).agg(F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"))


def mcnemar_exact(differences: DataFrame, by: list[str]) -> DataFrame:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(a, b)], dtype=float)

    return mcnemar_counts(differences, by).withColumn("p_value", p("a_only", "b_only"))


def holm_adjust(df: DataFrame, p: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``holm_p``: running maximum of (m - rank) * p in order of p within each family, 1 at most."""
    family = Window.partitionBy(*by)
    ordered = family.orderBy(p, *order)
    m, k = F.count(F.lit(1)).over(family), F.row_number().over(ordered)
    raised = df.withColumn("__raised", (m - k + 1) * F.col(p))
    running = F.max("__raised").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raised.withColumn("holm_p", F.least(F.lit(1.0), running)).drop("__raised")


def cohens_kappa(pairs: DataFrame, by: list[str], a: str, b: str, weights: str = "none", scale: list[float] | None = None) -> DataFrame:
    """Kappa of two raters' numeric labels by group: plain, linear or quadratic; null where it is undefined.

    The distance of two labels is their difference over the width of the scale (given, or the labels seen).
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    if scale is not None:
        outside = rows.where(~F.col("a").isin(scale) | ~F.col("b").isin(scale))
        if not outside.isEmpty():
            raise ValueError("a label is outside the scale")
    cells = rows.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    right = cells.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    size = cells.groupBy(*by).agg(
        F.sum("n").alias("total"), (F.greatest(F.max("a"), F.max("b")) - F.least(F.min("a"), F.min("b"))).alias("width")
    )
    if scale is not None:
        size = size.withColumn("width", F.lit(float(max(scale) - min(scale))))
    gap = F.abs(F.col("a") - F.col("b")) / F.nullif(F.col("width"), F.lit(0.0))
    cost = {"none": (F.col("a") != F.col("b")).cast("double"), "linear": gap, "quadratic": gap * gap}[weights]
    cost = F.coalesce(cost, F.lit(0.0))
    key = by or None
    joined = lambda x, y: x.join(y, key) if key else x.crossJoin(y)  # noqa: E731  a handful of labels each
    seen = joined(cells, size).groupBy(*by).agg(F.sum(cost * F.col("n") / F.col("total")).alias("observed"), F.max("total").alias("n"))
    chance = joined(joined(left, right), size).groupBy(*by).agg(
        F.sum(cost * F.col("na") * F.col("nb") / (F.col("total") * F.col("total"))).alias("expected")
    )
    out = joined(seen, chance)
    return out.select(*by, "n", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).alias("kappa"))


def kappa_interval(
    pairs: DataFrame, by: list[str], a: str, b: str, weights: str = "none", draws: int = 2000, seed: int = 13, scale: list[float] | None = None
) -> DataFrame:
    """Kappa with a percentile interval: item counts redrawn from the confusion table; undefined draws are skipped.

    Distances are over the width of the scale, or of the labels seen.
    """

    def kappas(n: np.ndarray, cost: np.ndarray) -> np.ndarray:
        total = n.sum((1, 2))
        seen = (n * cost).sum((1, 2)) / total
        chance = ((n.sum(2)[:, :, None] * n.sum(1)[:, None, :]) * cost).sum((1, 2)) / total**2
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(chance > 0, 1 - seen / chance, np.nan)

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        labels = np.unique(np.concatenate([rows["a"], rows["b"]]))
        n = np.zeros((len(labels), len(labels)))
        np.add.at(n, (np.searchsorted(labels, rows["a"]), np.searchsorted(labels, rows["b"])), rows["n"])
        width = max(scale) - min(scale) if scale else labels[-1] - labels[0]
        gap = np.abs(labels[:, None] - labels[None, :]) / max(width, 1e-12)
        cost = {"none": (gap > 0).astype(float), "linear": gap, "quadratic": gap**2}[weights]
        rng = np.random.default_rng(seed)
        drawn = rng.multinomial(int(n.sum()), (n / n.sum()).ravel(), draws).reshape(draws, *n.shape)
        sample = kappas(drawn, cost)
        sample = sample[np.isfinite(sample)]
        low, high = np.quantile(sample, [0.025, 0.975]) if len(sample) else (np.nan, np.nan)
        return pd.DataFrame([{c: rows[c].iloc[0] for c in by} | {"kappa": kappas(n[None], cost)[0], "low": low, "high": high, "n": int(n.sum())}])

    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    keys = "".join(f"{c} {dict(pairs.dtypes)[c]}, " for c in by)
    return cells.groupBy(*by).applyInPandas(interval, f"{keys}kappa double, low double, high double, n long")


def compare_systems(values: DataFrame, clusters: DataFrame, base: str = "hybrid_rrf", draws: int = 10_000, seed: int = 13) -> DataFrame:
    """Each system against ``base`` for each level and metric: difference with interval, McNemar (recall only), Holm
    within the level; a claim needs both the interval and an adjusted p of 0.05 or less."""
    by = ["level", "system", "metric"]
    diff = paired(values, base, ["level", "metric"]).join(clusters, "question_id")
    out = paired_bootstrap(diff, by, "cluster", draws, seed)
    out = holm_adjust(out, "p_value", ["level"], ["system", "metric"])
    tests = mcnemar_exact(diff.where(F.col("metric").startswith("recall")), by).withColumnRenamed("p_value", "mcnemar_p")
    claim = (F.col("verdict") != "no clear difference") & (F.col("holm_p") <= 0.05)
    return out.join(tests, by, "left").withColumn("claim", claim)


def summarize_generation(records: DataFrame, cluster: str, **options) -> DataFrame:
    """Every metric of generation records with its interval, resampling whole clusters; errors are never scored.

    Five scores and the hallucination rate over judged answers, the share whose citations are in the context over
    answers that cite, and the refusal rate over all that were generated.
    """
    pools = generation_pools(records)
    judged = F.col("is_judged")
    metrics = [(s, judged, F.col(s).cast("double")) for s in SCORES]
    metrics.append(("hallucination_rate", judged, F.col("hallucination").cast("double")))
    metrics.append(("citations_in_context_rate", F.col("is_answered") & F.col("citations_in_context").isNotNull(), F.col("citations_in_context").cast("double")))
    metrics.append(("refusal_rate", F.col("in_scored_pool"), F.col("is_refused").cast("double")))
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.when(where, value).alias("value")) for name, where, value in metrics])
    values = pools.select(F.col(cluster).alias("cluster"), F.explode(pairs).alias("p")).select("cluster", "p.*").where("value IS NOT NULL")
    return cluster_bootstrap(values, ["metric"], "cluster", **options)


def judge_agreement(pairs: DataFrame, scored: tuple[str, ...], scale: list[float], draws: int = 2000, seed: int = 13) -> DataFrame:
    """For each field of judge-human pairs (field, judge, human): n, agreement, kappa and, for scores, quadratic kappa.

    Both kappas with intervals; a score's distances are over the fixed scale, and labels outside it are an error.
    """
    graded = pairs.where(F.col("field").isin(*scored))
    share = pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("judge") == F.col("human")).cast("double")).alias("agreement"))
    cohens_kappa(graded, ["field"], "judge", "human", "quadratic", scale)  # raises for labels outside the scale
    named = lambda df, name: df.select("field", F.col("kappa").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
    plain = named(kappa_interval(pairs, ["field"], "judge", "human", "none", draws, seed), "kappa")
    weighted = named(kappa_interval(graded, ["field"], "judge", "human", "quadratic", draws, seed, scale), "kappa_quadratic")
    return share.join(plain, "field", "left").join(weighted, "field", "left")


def evaluate_retrieval(
    items: DataFrame, ranked: DataFrame, gold: dict[str, tuple[DataFrame, str]], base: str = "hybrid_rrf",
    fields: tuple[str, ...] = ("question_type", "bench"), breakdown_k: int = 5, states: DataFrame | None = None, **options,
) -> dict[str, DataFrame]:
    """Every system scored on the same questions: ``counts``, ``systems``, ``comparisons`` and ``breakdown``.

    ``items`` has question_id, cluster and the fields; ``gold`` gives for each level the gold table (question_id, gold)
    and the column of ``ranked`` that it names. Questions that ``states`` (question_id, state) does not call ok are counted
    and left out. Intervals resample clusters. The breakdown is of the first level, where a field is not blank.
    """
    states = items.select("question_id", F.lit("ok").alias("state")) if states is None else states
    counts = states.groupBy("state").agg(F.count(F.lit(1)).alias("questions"))
    usable = items.join(states.where("state = 'ok'").select("question_id"), "question_id", "left_semi")
    values = None
    for level, (known, target) in gold.items():
        known = known.join(usable.select("question_id"), "question_id", "left_semi")
        part = metric_values(first_hits(ranked, known, target)).withColumn("level", F.lit(level))
        values = part if values is None else values.unionByName(part)
    values = staged(values)
    by = ["level", "system", "metric"]
    clusters = usable.select("question_id", "cluster")
    clustered = values.join(clusters, "question_id")
    sizes = clustered.groupBy(*by).agg(F.countDistinct("cluster").alias("clusters"))
    systems = cluster_bootstrap(clustered, by, "cluster", **options).join(sizes, by)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("bucket")) for f in fields])
    buckets = usable.select("question_id", F.explode(pairs).alias("p")).select("question_id", "p.*").where("coalesce(trim(bucket), '') <> ''")
    one = clustered.where((F.col("level") == next(iter(gold))) & (F.col("metric") == f"recall@{breakdown_k}"))
    breakdown = cluster_bootstrap(one.join(buckets, "question_id"), ["field", "bucket", "system"], "cluster", **options)
    return {"counts": counts, "systems": systems, "comparisons": compare_systems(values, clusters, base, **options), "breakdown": breakdown}
