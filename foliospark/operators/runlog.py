"""Run logs: what is done, what is missing, which record counts; and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_quantiles


def last_record_wins(log: DataFrame, item: str, line: str) -> DataFrame:
    latest = Window.partitionBy(item).orderBy(F.desc(line))
    return log.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def parse_log(lines: DataFrame, schema: str, item: str, line: str = "line", value: str = "value") -> DataFrame:
    """Last record of each item of a JSON-lines log; lines that do not parse or have no item are skipped.

    ``lines`` has the text in ``value`` and its place in ``line``.
    """
    parsed = lines.select(F.col(line), F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r")).select(line, "r.*")
    return last_record_wins(parsed.where(F.col(item).isNotNull()), item, line)


def count_broken(lines: DataFrame, schema: str, item: str, value: str = "value") -> DataFrame:
    bad = F.from_json(value, schema)[item].isNull() & (F.trim(value) != "")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("broken"))


def todo_items(items: DataFrame, done: DataFrame, item: str, retry: tuple[str, ...] = ()) -> DataFrame:
    """Items not yet done; records with a status in ``retry`` count as not done."""
    finished = done.where(~F.col("status").isin(*retry)) if retry else done
    return items.join(finished.select(item), item, "left_anti")


def missing_ids(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side that lacks them."""
    lost = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("lacking", F.lit("actual"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("lacking", F.lit("expected"))
    return lost.unionByName(extra)


def id_set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).subtract(actual.select(key))


def unresolved_chunk_ids(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of the index that the chunk table lacks, and null or repeated ids of the chunk table, with the reason."""
    lost = index.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti").withColumn("reason", F.lit("unresolved"))
    counted = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("chunk_id IS NULL OR n > 1")
    bad = counted.select("chunk_id", F.when(F.col("chunk_id").isNull(), "null").otherwise("repeated").alias("reason"))
    return lost.unionByName(bad)


def retrieval_for_items(items: DataFrame, log: DataFrame, item: str) -> DataFrame:
    """Items with an ok record, and ``skipped`` for the others: nothing is made up for them."""
    ok = log.where("status = 'ok'").select(item, F.lit(True).alias("__ok")).distinct()
    return items.join(ok, item, "left").withColumn("skipped", F.col("__ok").isNull()).drop("__ok")


def usable_questions(items: DataFrame, log: DataFrame, item: str) -> DataFrame:
    """Each item with state ok, error or not_run."""
    out = items.join(log.select(item, "status"), item, "left")
    return out.withColumn("state", F.when(F.col("status").isNull(), "not_run").when(F.col("status") == "ok", "ok").otherwise("error")).drop("status")


def judge_human_pairs(judged: DataFrame, human: DataFrame, item: str, fields: tuple[str, ...]) -> DataFrame:
    """(item, field, judge, human) where both have a label."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields])
        return df.select(item, F.explode(pairs).alias("p")).select(item, "p.*").where(F.col(name).isNotNull())

    return long(judged, "judge").join(long(human, "human"), [item, "field"])


def latency_stats(log: DataFrame, stage: str, value: str) -> DataFrame:
    """Records, mean, exact median and 95th percentile (linear) of a value at each stage."""
    out = log.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return with_quantiles(out, log, [stage], value, {"median": 0.5, "p95": 0.95})


def validate_candidates(rows: DataFrame, fields: tuple[str, ...], gold: str, kinds: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``reason`` (null: valid), and counts of valid rows by kind against the expected mix."""
    blank = None
    for f in fields:
        test = F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == ""
        blank = test if blank is None else blank | test
    reason = (
        F.when(blank, "blank_field")
        .when(~F.col("question_type").isin(*kinds), "unknown_type")
        .when(F.coalesce(F.size(gold), F.lit(0)) < 1, "no_gold")
    )
    out = rows.withColumn("reason", reason)
    expected = rows.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {n}L)" for k, n in kinds.items()) + " AS t(question_type, expected)")
    valid = out.where("reason IS NULL").groupBy("question_type").agg(F.count(F.lit(1)).alias("found"))
    mix = expected.join(valid, "question_type", "left").select("question_type", "expected", F.coalesce("found", F.lit(0)).alias("found"))
    return out, mix


def check_independence(pairs: DataFrame, judge: str, generator: str) -> DataFrame:
    """Distinct (judge, generator) pairs: error for the same model, warning for the same family, else ok."""
    from ..functions.answers import model_family, normalize_model

    a, b = normalize_model(judge), normalize_model(generator)
    verdict = F.when(a == b, "error").when((model_family(judge) == model_family(generator)) & (model_family(judge) != ""), "warning").otherwise("ok")
    return pairs.select(judge, generator).distinct().withColumn("verdict", verdict)
