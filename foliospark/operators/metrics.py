"""Retrieval and answer metrics as joins and grouped aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import LABELS
from ..functions.stats_exprs import wilson

KS = (1, 5, 10, 50)


def first_hits(ranked: DataFrame, gold: DataFrame, target: str) -> DataFrame:
    """question_id, system, hit_rank of each question with gold (question_id, gold) in each system; null for a miss."""
    systems = ranked.select("system").distinct()
    base = gold.select("question_id").distinct().join(F.broadcast(systems))
    hits = ranked.join(gold.withColumnRenamed("gold", target), ["question_id", target])
    best = hits.groupBy("question_id", "system").agg(F.min("rank").alias("hit_rank"))
    return base.join(best, ["question_id", "system"], "left")


def metric_values(hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Long (question_id, system, metric, value): recall@k as 0 or 1, and 1 / rank up to rank 10."""
    r = F.col("hit_rank")
    pairs = [F.struct(F.lit(f"recall@{k}").alias("metric"), F.coalesce((r <= k).cast("double"), F.lit(0.0)).alias("value")) for k in ks]
    pairs.append(F.struct(F.lit("mrr@10").alias("metric"), F.when(r <= 10, 1.0 / r).otherwise(0.0).alias("value")))
    return hits.select(*[c for c in hits.columns if c != "hit_rank"], F.explode(F.array(*pairs)).alias("m")).select(
        *[c for c in hits.columns if c != "hit_rank"], "m.metric", "m.value"
    )


def retrieval_scores(values: DataFrame) -> DataFrame:
    return values.groupBy("level", "system", "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def recall_breakdown(values: DataFrame, items: DataFrame, fields: tuple[str, ...], k: int = 10) -> DataFrame:
    """Recall@k by the value of each field; blank values are left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    keys = items.select("question_id", F.explode(pairs).alias("p")).select("question_id", "p.field", F.col("p.value").alias("bucket"))
    keys = keys.where("coalesce(trim(bucket), '') <> ''")
    rows = values.where(F.col("metric") == f"recall@{k}").join(keys, "question_id")
    return rows.groupBy("field", "bucket", "system").agg(F.avg("value").alias("recall"), F.count(F.lit(1)).alias("n"))


def hit_semi(ranked: DataFrame, gold: DataFrame, target: str, k: int) -> DataFrame:
    """Questions and systems with any gold id in the first k."""
    top = ranked.where(F.col("rank") <= k)
    return top.join(gold.withColumnRenamed("gold", target), ["question_id", target], "left_semi").select("question_id", "system").distinct()


def gold_intersect(ranked: DataFrame, gold: DataFrame, target: str, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k).select("question_id", F.col(target).alias("gold")).intersect(gold.select("question_id", "gold"))


SCORES = ("answer_relevance", "faithfulness", "citation_correctness", "overall_score", "unsupported_claim_rate")


def generation_means(records: DataFrame) -> DataFrame:
    """Means of five scores and the share of hallucinations; missing values count as 0; no row for no records."""
    means = [F.avg(F.coalesce(F.col(s).cast("double"), F.lit(0.0))).alias(s) for s in SCORES]
    halluc = F.avg(F.coalesce(F.col("hallucination").cast("double"), F.lit(0.0))).alias("hallucination_rate")
    return records.agg(F.count(F.lit(1)).alias("n"), *means, halluc).where("n > 0")


def score_distribution(records: DataFrame, names: tuple[str, ...] = SCORES[:4]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).alias("score")) for s in names])
    return records.select(F.explode(pairs).alias("p")).groupBy("p.metric", "p.score").agg(F.count(F.lit(1)).alias("n"))


def scores_by(records: DataFrame, group: str) -> DataFrame:
    means = [F.avg(F.col(s)).alias(s) for s in SCORES]
    return records.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *means).orderBy(F.desc("overall_score"), group)


def crosstab(records: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of the given values of a column by another one, zeros for none."""
    return records.groupBy(row).pivot(column, values).count().na.fill(0)


def citation_context(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Each cited id of each answer: not retrieved, wrong judgment or correct judgment."""
    cited = answers.select("question_id", "cnr", F.explode("cited").alias("chunk_id"))
    known = context.select("question_id", "chunk_id", F.col("cnr").alias("found")).distinct()
    out = cited.join(known, ["question_id", "chunk_id"], "left")
    kind = F.when(F.col("found").isNull(), "not_retrieved").when(F.col("found") == F.col("cnr"), "correct_judgment").otherwise("wrong_judgment")
    return out.select("question_id", "chunk_id", kind.alias("kind"))


def citation_consistency(kinds: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """Answers with any, a correct, a wrong, a not retrieved citation, by group."""
    one = lambda k: F.max((F.col("kind") == k).cast("int")).alias(k)
    per = kinds.groupBy("question_id").agg(one("correct_judgment"), one("wrong_judgment"), one("not_retrieved"))
    rows = answers.select("question_id", group).join(per, "question_id", "left")
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).alias(k)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("answers"), F.count("correct_judgment").alias("with_citation"),
        total("correct_judgment"), total("wrong_judgment"), total("not_retrieved"),
    )


def context_presence(context: DataFrame, items: DataFrame) -> DataFrame:
    """How many chunks of the right judgment each question's context holds, as a distribution by type."""
    right = context.join(items.select("question_id", F.col("cnr").alias("own"), "question_type", "hallucination"), "question_id", "right")
    per = right.groupBy("question_id", "question_type", "hallucination").agg(F.count_if(F.col("cnr") == F.col("own")).alias("right_chunks"))
    return per.groupBy("question_type", "right_chunks").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.col("hallucination").cast("double")).alias("mean_hallucination")
    )


def failure_table(records: DataFrame, label: str = "failure_label") -> DataFrame:
    """The fixed labels with count, share and interval, over rows that have a label."""
    spark = records.sparkSession
    listed = spark.sql("SELECT explode(array(" + ", ".join(f"'{x}'" for x in LABELS) + ")) AS label")
    counted = records.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("base"))
    out = listed.join(counted, "label", "left")
    out = out.join(F.broadcast(total)).withColumn("n", F.coalesce("c", F.lit(0))).withColumn("w", wilson("n", "base"))
    return out.select("label", "n", "base", "w.estimate", "w.low", "w.high")


def evaluation_records(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers with their gold record by number; an answer without one is an error."""
    lost = answers.join(gold, "cnr", "left_anti")
    if not lost.isEmpty():
        raise ValueError("answers without a gold record")
    return answers.join(gold, "cnr")


def scoreboard(values: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row for each system (and group), a column for each metric."""
    return values.groupBy(*by).pivot("metric", metrics).agg(F.avg("value"))


def with_delta(board: DataFrame, base: str, metric: str) -> DataFrame:
    """The difference of a metric to the base system's."""
    reference = board.where(F.col("system") == base).select(F.col(metric).alias("__base"))
    return board.join(F.broadcast(reference)).withColumn("delta", F.col(metric) - F.col("__base")).drop("__base")


def grounded_citations(answers: DataFrame, context: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Cited ids that are among the first k of the context, in citation order, with their chunk's columns, nested."""
    cited = answers.select("question_id", F.posexplode("cited").alias("place", "chunk_id"))
    known = context.where(F.col("rank") <= k).select("question_id", "chunk_id").distinct()
    rows = cited.join(known, ["question_id", "chunk_id"]).join(chunks, "chunk_id", "left")
    item = F.struct("place", "chunk_id", *[c for c in chunks.columns if c != "chunk_id"])
    return rows.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("citations"))


def generation_pools(records: DataFrame) -> DataFrame:
    """Flags of each record: generation error, scored, refused, answered, judged, judge error."""
    ok, refused = F.col("generation_ok"), F.col("refused")
    judged = ok & ~refused & (F.col("judge_status") == "ok")
    return records.withColumns(
        {
            "is_generation_error": ~ok,
            "in_scored_pool": ok,
            "is_refused": ok & refused,
            "is_answered": ok & ~refused,
            "is_judged": F.coalesce(judged, F.lit(False)),
            "is_judge_error": F.coalesce(ok & ~refused & (F.col("judge_status") != "ok"), F.lit(False)),
        }
    )


def generation_counts(pools: DataFrame, most_errors: float = 0.05, least_judged: int = 30) -> DataFrame:
    """Counts of the pools, with warnings for many errors or few judged answers."""
    c = lambda name: F.count_if(name)
    out = pools.agg(
        F.count(F.lit(1)).alias("total"), c("is_generation_error").alias("generation_errors"), c("is_refused").alias("refused"),
        c("is_answered").alias("answered"), c("is_judged").alias("judged"), c("is_judge_error").alias("judge_errors"),
    )
    return out.withColumns(
        {
            "warn_errors": F.coalesce(F.col("generation_errors") > most_errors * F.col("total"), F.lit(False)),
            "warn_few_judged": F.col("judged") < least_judged,
        }
    )


def token_cost(calls: DataFrame, text: str, expected_out: int, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """Calls, tokens in (characters / 4, rounded up) and out, and the cost if both prices (per million) are given."""
    out = calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(F.ceil(F.char_length(text) / 4)), F.lit(0)).alias("tokens_in"),
        (F.count(F.lit(1)) * expected_out).alias("tokens_out"),
    )
    if price_in is None or price_out is None:
        return out.withColumn("usd", F.lit(None).cast("double"))
    return out.withColumn("usd", F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out)


def percent_agreement(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    return pairs.agg(F.avg((a == b).cast("double")).alias("agreement"))
