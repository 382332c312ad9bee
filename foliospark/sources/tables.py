"""Readers and writers: record tables with a checked schema, benchmarks, logs, reports and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = (
    "cnr string, court_code string, bench string, year int, full_text string, title string, judge string, "
    "petitioner string, respondent string, decision_date string, disposal_nature_normalized string, case_type string"
)
REQUIRED = ("cnr", "full_text")


def read_judgments(spark: SparkSession, *paths: str, schema: str = RECORD, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Wanted columns of any parquet files, folders and globs, with the scan order as ``file_path, row_index``.

    Wanted columns that are absent come out as typed nulls; required ones that are absent are an error before any
    row is read. The column list is pushed to the scan.
    """
    wanted = T.StructType.fromDDL(schema)
    frame = spark.read.parquet(*sorted(set(paths)))
    have = set(frame.columns)
    lost = [c for c in required if c not in have]
    if lost:
        raise ValueError(f"required columns are missing: {', '.join(lost)}")
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return frame.select(*columns, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def check_schema(spark: SparkSession, *paths: str, schema: str = RECORD, required: tuple[str, ...] = REQUIRED) -> dict:
    """Files, rows, types, columns missing from some files, wanted ones absent, required ones missing."""
    files = sorted({f for p in paths for f in spark.read.parquet(p).inputFiles()})
    types = {f: dict(spark.read.parquet(f).dtypes) for f in files}
    every = {c for t in types.values() for c in t}
    wanted = T.StructType.fromDDL(schema).fieldNames()
    rows = spark.read.parquet(*files).groupBy("_metadata.file_path").count().collect() if files else []
    return {
        "files": len(files),
        "rows": {r[0]: r[1] for r in rows},
        "types": {c: sorted({t[c] for t in types.values() if c in t}) for c in sorted(every)},
        "missing_in_some": sorted(c for c in every if any(c not in t for t in types.values())),
        "absent": [c for c in wanted if c not in every],
        "required_missing": [c for c in required if c not in every],
    }


def cap_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def write_corpus(rows: DataFrame, links: DataFrame, folder: str, overwrite: bool = False) -> None:
    """search_corpus, lookup_only and duplicate_links as zstd parquet; refuses to overwrite unless told."""
    mode = "overwrite" if overwrite else "errorifexists"
    for name, part in (("search_corpus", rows.where("in_search_index")), ("lookup_only", rows.where("NOT in_search_index")), ("duplicate_links", links)):
        part.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/{name}")


def write_report(spark: SparkSession, folder: str, **parts: DataFrame) -> None:
    """Small aggregates as one JSON row: each part is an array of structs."""
    out = None
    for name, part in parts.items():
        one = part.agg(F.collect_list(F.struct(*part.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)
    out.coalesce(1).write.mode("overwrite").json(folder)


def write_csv_sample(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def normalize_benchmark(items: DataFrame) -> DataFrame:
    """Questions with gold_cnrs (else the source number) and group (source number, else first gold, else the id)."""
    have = set(items.columns)
    column = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    source = F.nullif(F.trim(column("source_cnr", "string")), F.lit(""))
    gold = column("gold_cnrs", "array<string>")
    gold = F.when(F.coalesce(F.size(gold), F.lit(0)) > 0, gold).when(source.isNotNull(), F.array(source))
    out = items.withColumns({"source_cnr": source, "gold_cnrs": gold, "gold_chunk_ids": column("gold_chunk_ids", "array<string>")})
    return out.withColumn("group", F.coalesce("source_cnr", F.get("gold_cnrs", 0), F.col("question_id").cast("string")))


def benchmark_problems(items: DataFrame) -> DataFrame:
    """Blank or repeated ids, and questions without any gold, as (question_id, problem)."""
    blank = F.coalesce(F.trim(F.col("question_id").cast("string")), F.lit("")) == ""
    none = (F.coalesce(F.size("gold_cnrs"), F.lit(0)) < 1) & (F.coalesce(F.size("gold_chunk_ids"), F.lit(0)) < 1)
    found = items.select("question_id", F.when(blank, "blank_id").when(none, "no_gold").alias("problem")).where("problem IS NOT NULL")
    twice = items.where(~blank).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(twice.select("question_id", F.lit("repeated_id").alias("problem")))


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, an object with ``questions``, or JSON lines; raises on blank or repeated ids and missing gold."""
    frame = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
    if "questions" in frame.columns:
        frame = frame.select(F.explode("questions").alias("q")).select("q.*")
    items = normalize_benchmark(frame)
    problems = benchmark_problems(items).limit(5).collect()
    if problems:
        raise ValueError("; ".join(f"{r['problem']}: {r['question_id']}" for r in problems))
    return items


def read_result_log(spark: SparkSession, path: str, schema: str, item: str) -> tuple[DataFrame, DataFrame]:
    """The last record of each item of a JSON-lines log, and how many lines did not parse."""
    from ..operators.runlog import count_broken, parse_log

    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("line"))
    return parse_log(lines, schema, item), count_broken(lines, schema, item)


def read_embeddings(spark: SparkSession, path: str, dim: int, rows: int) -> DataFrame:
    """Embedding shards; raises unless every width is ``dim`` and there are ``rows`` of them."""
    from ..operators.retrieval import check_embeddings

    vectors = spark.read.parquet(path)
    found = check_embeddings(vectors, "embedding").first()
    if (found["rows"], found["min_dim"], found["max_dim"]) != (rows, dim, dim):
        raise ValueError(f"expected {rows} vectors of width {dim}, found {found.asDict()}")
    return vectors
