"""Queries that write, stream, clean repeats, and the flagship; with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import corpus
from ..operators import quantiles as Q
from ..operators import quality
from ..operators import retrieval as R
from ..sources import tables as T
from ..sources.stages import scratch
from ..streaming.collect import stream_collect, stream_resume
from . import eval_queries as E
from .adapters import JUDGMENTS_SQL, judgments, table
from .corpus_queries import BUILD, BUILD_SQL, ROWS_SQL, labelled, sql_strip


def write_and_read(s, d):
    """Corpus tables written and read back: rows and characters of each."""
    folder = scratch(s)
    T.write_corpus(*corpus.build_corpus(judgments(s, d), BUILD), folder)
    search = s.read.parquet(f"{folder}/search_corpus").select("clean_chars")
    lookup = s.read.parquet(f"{folder}/lookup_only").select("clean_chars")
    removed = s.read.parquet(f"{folder}/duplicate_links")
    part = lambda df, name: df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("clean_chars"), F.lit(0)).alias("chars"))
    out = part(search, "search_corpus").unionByName(part(lookup, "lookup_only"))
    return out.unionByName(part(removed.withColumn("clean_chars", F.lit(0).cast("long")), "duplicate_links"))


def report_and_read(s, d):
    folder = scratch(s)
    known = labelled(s, d)
    T.write_report(s, folder, outcomes=corpus.outcome_counts(known), links=quality.link_stats(corpus.duplicate_links(known)))
    report = s.read.json(folder)
    return report.select(F.explode("outcomes").alias("o")).select("o.source_config", "o.outcome", "o.n")


def csv_and_read(s, d):
    folder = scratch(s)
    T.write_csv_sample(table(s, d, "documents").select("doc_id", "lang", "source").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(50), folder)
    return s.read.option("header", True).schema("doc_id long, lang string, source string").csv(folder)


def schema_rows(s, d):
    found = T.check_schema(s, f"{d}/documents.parquet", schema="doc_id long, text string, judge string", required=("doc_id",))
    return table(s, d, "documents").agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(sum(found["rows"].values())).alias("counted"), F.lit(",".join(found["absent"])).alias("absent"),
        F.lit(",".join(found["required_missing"])).alias("required_missing"),
    )


def collected(s, d):
    """documents as a stream of records in three parts, one after the other; numbers repeat by d % 97, texts as they do.

    The first run is started again when the second part is there, so it has a batch for each; the second run reads all three
    parts with a new checkpoint, so what it knows of the first is its shards.
    """
    folder = scratch(s)
    rows = judgments(s, d).select("d", "cnr", "full_text")
    last = rows.agg(F.max("d")).first()[0] or 0
    for k, (source, state) in enumerate((("early", "state0"), ("early", "state0"), ("*", "state1"))):
        part = rows.where(F.floor(F.col("d") * 3 / (last + 1)) == k)
        part.write.parquet(f"{folder}/in/{'early' if k < 2 else 'late'}/{k}")
        stream = s.readStream.schema("d long, cnr string, full_text string").parquet(f"{folder}/in/{source}/*")
        place = F.lpad(F.col("d").cast("string"), 20, "0")
        stream_collect(stream, f"{folder}/out", f"{folder}/{state}", "cnr", "full_text", place).awaitTermination()
    out = s.read.parquet(f"{folder}/out")
    shards = F.countDistinct("shard").cast("boolean").alias("numbered")
    return out.agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("cnr").alias("numbers"), F.countDistinct("text_hash").alias("texts"), F.sum("d").alias("d"), shards)


def resumed(s, d):
    """Items worked on in batches; the sink ends with one finished record for each."""
    folder = scratch(s)
    table(s, d, "customer").selectExpr("c_custkey AS item").repartition(2).write.parquet(f"{folder}/in")
    stream = s.readStream.schema("item long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    work = lambda todo: todo.withColumn("status", F.when(F.col("item") % 5 == 0, "error").otherwise("ok"))
    for run in range(2):  # the second stream starts anew, and only errors are left for it
        stream_resume(s, stream, "item", work, f"{folder}/out", f"{folder}/state{run}", {"model": "m"}, ("error",)).awaitTermination()
    return s.read.parquet(f"{folder}/out").groupBy("status").agg(F.countDistinct("item").alias("items"))


def repeats(s, d):
    """The words of each document, its first seven written three times."""
    docs = table(s, d, "documents").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    head = F.array_join(F.slice("w", 1, 7), " ")
    docs = docs.select("doc_id", F.concat_ws(" ", head, head, head, F.array_join("w", " ")).alias("text"), F.lit(0).cast("long").alias("removed"))
    return udfs.collapse_repeats(docs, "text", "removed").select("doc_id", "removed", F.char_length("text").cast("long").alias("chars"))


def flagship(s, d):
    """BM25 and dense lists of every question fused by reciprocal rank: the first ten, with each document's source."""
    fused = R.rrf_fuse(E.two_lists(s, d), top=10)
    return E.rounded(R.attach_chunks(fused, table(s, d, "documents").selectExpr("doc_id AS chunk_id", "source AS cnr")), "score")


def percentiles_in_passes(s, d):
    """Prices of each flag by selection in passes, as groups of any size are treated."""
    rows = table(s, d, "lineitem").selectExpr("l_returnflag", "CAST(l_extendedprice AS DOUBLE) AS __v")
    probs = {"p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    return E.rounded(Q.selected(rows, ["l_returnflag"], probs, small=0), *probs)


QUERIES = {
    "flagship_hybrid": flagship,
    "src3_check_schema": schema_rows,
    "src5_write_corpus": write_and_read,
    "src6_write_report": report_and_read,
    "src7_write_csv_sample": csv_and_read,
    "agg39_percentiles_in_passes": percentiles_in_passes,
    "str1_stream_collect": collected,
    "str2_stream_resume": resumed,
    "scl8_collapse_repeats": repeats,
    "agg6_repeat_clean_stats": lambda s, d: corpus.repeat_clean_stats(corpus.build_rows(corpus.label_records(judgments(s, d), corpus.Build(today=BUILD.today, min_chars=BUILD.min_chars, clean_repeats=True)), BUILD)),
    "jon_build_corpus": lambda s, d: corpus.build_corpus(judgments(s, d), BUILD)[0].groupBy("in_search_index").agg(F.count(F.lit(1)).alias("n"), F.sum("clean_chars").alias("chars")),
}

_OUT = ", ".join(f"'{x}'" for x in (*corpus.DROP_REASONS, *corpus.KEPT))
SQL = {
    "flagship_hybrid": f"WITH {E.LISTS_SQL} SELECT question_id, rank, chunk_id, round(score, 6) AS score, source AS cnr FROM fr LEFT JOIN documents ON doc_id = chunk_id WHERE rank <= 10",
    "src3_check_schema": "SELECT count(*) AS rows, count(*) AS counted, 'judge' AS absent, '' AS required_missing FROM documents",
    "src5_write_corpus": ROWS_SQL + "SELECT 'search_corpus' AS table, count(*) AS rows, CAST(sum(clean_chars) AS BIGINT) AS chars FROM r WHERE in_search_index UNION ALL SELECT 'lookup_only', count(*), CAST(sum(clean_chars) AS BIGINT) FROM r WHERE NOT in_search_index UNION ALL SELECT 'duplicate_links', count(*), 0 FROM b WHERE outcome_label = 'near_duplicate'",
    "src6_write_report": BUILD_SQL + f", o AS (SELECT unnest([{_OUT}]) AS outcome), g AS (SELECT unnest(['high_courts', 'supreme_court', 'all']) AS source_config) SELECT g.source_config, o.outcome, count(b.d) AS n FROM g CROSS JOIN o LEFT JOIN b ON b.outcome_label = o.outcome AND (g.source_config = 'all' OR b.source_config = g.source_config) GROUP BY 1, 2",
    "agg39_percentiles_in_passes": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS {n}" for n, p in (("p5", 0.05), ("median", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM lineitem GROUP BY 1",
    "src7_write_csv_sample": "SELECT doc_id, lang, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 50",
    "str1_stream_collect": f"WITH {JUDGMENTS_SQL}, v AS (SELECT d, {sql_strip('cnr')} AS c, {sql_strip('full_text')} AS t FROM j), a AS (SELECT * FROM v WHERE c <> '' AND t <> '' QUALIFY row_number() OVER (PARTITION BY c ORDER BY d) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY t ORDER BY d) = 1) SELECT count(*) AS kept, count(DISTINCT c) AS numbers, count(DISTINCT t) AS texts, CAST(sum(d) AS BIGINT) AS d, true AS numbered FROM b",
    "str2_stream_resume": "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS items FROM customer GROUP BY 1",
    "jon_build_corpus": ROWS_SQL + "SELECT in_search_index, count(*) AS n, CAST(sum(clean_chars) AS BIGINT) AS chars FROM r GROUP BY 1",
}
