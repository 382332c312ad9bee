"""Queries over chunks, retrieval, metrics, statistics, answers and run logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import udfs
from ..functions.stats_exprs import wilson
from ..operators import chunks as C
from ..operators import grounding as G
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import runlog as L
from ..operators import stats as S
from ..operators.inverted import read_index, write_index
from ..sources import tables as T
from ..sources.stages import scratch, staged
from .adapters import kept, table
from .corpus_queries import sql_strip
from .report_queries import sql_wilson

W = r"[\p{L}\p{N}_]+"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- adapters, written once for both dialects -------------------------------------------------------------------
GEN = [
    "d AS item_id", "source AS cluster", "d % 23 <> 0 AS generation_ok", "d % 17 = 0 AS refused",
    "CASE WHEN d % 19 = 0 THEN 'error' ELSE 'ok' END AS judge_status", "CAST(1 + (d * 3) % 4 AS INT) AS answer_relevance",
    "CAST(1 + (d * 7 + 1) % 4 AS INT) AS faithfulness", "CAST(1 + (d * 3 + 2) % 4 AS INT) AS citation_correctness",
    "CAST(1 + (d * 7 + 3) % 4 AS INT) AS overall_score", "CAST(d % 10 AS DOUBLE) / 10 AS unsupported_claim_rate",
    "toxic = 1 AS hallucination", "quality = 1 AS hit", "concat('type', CAST(d % 5 AS STRING)) AS question_type",
    "lang AS bench", "CASE WHEN d % 3 = 0 THEN NULL ELSE CAST(1 + (d * 3 + quality) % 4 AS INT) END AS human_relevance",
    "CASE WHEN d % 4 = 0 THEN NULL ELSE CAST(1 + (d * 7 + toxic) % 4 AS INT) END AS human_faithfulness", "d % 6 = 0 AS human_hallucination",
    "CASE WHEN d % 5 = 0 THEN NULL ELSE d % 7 > 1 END AS citations_in_context", "quality", "toxic", "d",
]
GEN_SQL = "gen AS (SELECT " + ", ".join(GEN) + " FROM (SELECT doc_id AS d, * FROM documents JOIN labels USING (doc_id)) AS x)"


def gen(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang").join(table(s, d, "labels"), "doc_id")
    return docs.withColumn("d", F.col("doc_id")).selectExpr(*GEN)


ANS = [
    "concat(CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS item_id", "conv_id", "turn",
    "concat(CASE WHEN conv_id % 11 = 0 THEN 'It Does Not contain sufficient information. ' ELSE text END, "
    "CASE WHEN conv_id % 11 = 0 AND turn < 3 THEN '' ELSE concat(' [Chunk ID: c', CAST(conv_id % 7 AS STRING), '] [chunk id: c', "
    "CAST(turn AS STRING), ' | Court: X] [Chunk ID: c', CAST(conv_id % 7 AS STRING), ']') END) AS answer",
]
ANS_SQL = "ans AS (SELECT " + ", ".join(ANS) + " FROM conversations WHERE role = 'assistant')"


def ans(s, d):
    return table(s, d, "conversations").where("role = 'assistant'").selectExpr(*ANS)


SYSTEMS = ("bm25", "dense", "hybrid_rrf")


def ranked(s, d):
    """Lists of three systems for each question: BM25 over documents, exact vector search, and both fused.

    A question's vector is that of id 20 * item_id; questions beyond the embeddings have no dense list. The lists are
    made once for a session and input, and read by all queries over them.
    """
    return kept(s, d, "ranked", ("documents", "benchmark", "embeddings"), lambda: _ranked(s, d))


def two_lists(s, d):
    """The BM25 and the dense lists as one table, made once for a session and input."""

    def make():
        known = table(s, d, "benchmark").selectExpr("item_id AS question_id")
        near = dense(s, d).withColumn("question_id", F.expr("question_id div 20")).join(known, "question_id", "left_semi")
        return staged(R.union_ranked({"bm25": bm25(s, d), "dense": near}))

    return kept(s, d, "two lists", ("documents", "benchmark", "embeddings"), make)


def _ranked(s, d):
    both = two_lists(s, d)
    fused = R.union_ranked({"hybrid_rrf": R.rrf_fuse(both)})
    lists = both.unionByName(fused).drop("list")
    lists = R.attach_chunks(lists, table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("cnr")))
    return staged(lists.select("question_id", "system", "rank", "chunk_id", "cnr"))


def items(s, d):
    b = table(s, d, "benchmark")
    return b.selectExpr("item_id AS question_id", "concat('src', CAST(item_id % 20 AS STRING)) AS cnr", "concat('type', CAST(item_id % 5 AS STRING)) AS question_type", "CASE WHEN item_id % 4 = 0 THEN '' ELSE concat('b', CAST(item_id % 3 AS STRING)) END AS bench", "item_id % 2 = 0 AS hallucination")


ITEMS_SQL = "items AS (SELECT item_id AS question_id, 'src' || item_id % 20 AS cnr, 'type' || item_id % 5 AS question_type, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'b' || item_id % 3 END AS bench, item_id % 2 = 0 AS hallucination FROM benchmark)"


def gold(s, d):
    return items(s, d).select("question_id", F.col("cnr").alias("gold"))


def values(s, d):
    return M.metric_values(M.first_hits(ranked(s, d), gold(s, d), "cnr")).withColumn("level", F.lit("judgment"))


def clusters(s, d):
    return items(s, d).select("question_id", F.col("cnr").alias("cluster"))


def windows(s, d):
    docs = table(s, d, "documents").where("n_chars > 0")
    return C.window_chunks(docs.select("doc_id", "text"), "doc_id", "text")


WINDOWS_SQL = (
    "chunks AS (SELECT doc_id || '_chunk_' || k AS chunk_id, doc_id AS cnr, k AS chunk_index, k * 1000 AS chunk_start, least(k * 1000 + 1200, length(text)) AS chunk_end, "
    "substring(text, k * 1000 + 1, 1200) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 1000 + 1)) AS k FROM documents WHERE n_chars > 0))"
)
_PASSAGE = "CASE WHEN d % 3 = 0 THEN substring(text, CAST(1 + d * 37 % greatest(n_chars - 420, 1) AS INT), 420) ELSE concat('Unseen lead in words here ', substring(text, CAST(1 + d * 53 % greatest(n_chars - 300, 1) AS INT), 300)) END"


def evidence(s, d):
    """A passage from somewhere in each document, as it stands or behind words that stand nowhere."""
    docs = table(s, d, "documents").withColumnRenamed("doc_id", "d").where("n_chars > 0")
    return docs.selectExpr("d AS question_id", "d AS cnr", f"{_PASSAGE} AS supporting_text")


EVIDENCE_SQL = f"evidence AS (SELECT d AS question_id, d AS cnr, {_PASSAGE} AS supporting_text FROM (SELECT doc_id AS d, text, n_chars FROM documents) WHERE n_chars > 0)"


_COUNTS = ["".join(c) for c in (*"abcdefghijklmnopqrstuvwxyz", " ", "0123456789")]


def _counted(x: str) -> str:
    each = [f"length({x}) - length(translate({x}, '{c}', ''))" for c in _COUNTS]
    return "[" + ", ".join(each) + f", length({x}) - (" + " + ".join(f"({e})" for e in each) + ")]"


SIMILAR_SQL = (
    f"WITH {WINDOWS_SQL}, {EVIDENCE_SQL}, a AS (SELECT question_id, cnr, x, {_counted('x')} AS m FROM (SELECT question_id, cnr, lower(supporting_text) AS x FROM evidence)), "
    f"b AS (SELECT chunk_id, cnr, x, {_counted('x')} AS n FROM (SELECT chunk_id, cnr, lower(text) AS x FROM chunks)), "
    "p AS (SELECT question_id, chunk_id, length(a.x) + length(b.x) AS l, list_sum(list_transform(list_zip(m, n), lambda z: least(z[1], z[2]))) AS c FROM a JOIN b USING (cnr)) "
    "SELECT question_id, chunk_id, round(CASE WHEN l = 0 THEN 1.0 ELSE 2.0 * c / l END, 6) AS bound FROM p"
)


def _blocks(s, d):
    rows = ranked(s, d).where("system = 'bm25'")
    docs = table(s, d, "documents").selectExpr("doc_id AS chunk_id", "text", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS court_code", "CAST(NULL AS STRING) AS decision_date")
    return R.context_rows(rows, docs).join(table(s, d, "benchmark").selectExpr("item_id AS question_id", "text AS question"), "question_id")


_CTX_SQL = (
    "blocks AS (SELECT r.question_id, r.rank, r.chunk_id, d.text AS text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS court FROM ranked r "
    "JOIN documents d ON d.doc_id = r.chunk_id WHERE system = 'bm25' AND rank <= 5), ctx AS (SELECT question_id, string_agg('[Chunk ID: ' || chunk_id || ' | Court: ' || "
    "coalesce(nullif(court, ''), 'Unspecified') || ' | Date: Unspecified]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS body FROM blocks GROUP BY 1)"
)


def bm25_queries(s, d):
    return table(s, d, "benchmark").selectExpr("item_id AS question_id", "text AS query")


def doc_chunks(s, d):
    return table(s, d, "documents").selectExpr("doc_id AS chunk_id", "text", "source AS cnr")


def bm25(s, d, k=50):
    return R.bm25_search(bm25_queries(s, d), None, k, index=_index(s, d))


def dense(s, d, k=50):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return R.dense_search(v.where("id % 20 = 0"), v, k, exclude_self=True)


BM25_CTES = f"""
bd AS MATERIALIZED (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '{W}') AS t FROM documents),
bq AS (SELECT question_id, token, count(*) AS times FROM (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM benchmark) GROUP BY 1, 2),
bc AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM bd),
bt AS MATERIALIZED (SELECT token, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM bd) GROUP BY 1, 2, 3),
b0 AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM bt GROUP BY 1), bc),
bi AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM b0, (SELECT avg(raw) AS mean FROM b0)),
bs AS (SELECT question_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bq JOIN bt USING (token) JOIN bi USING (token), bc GROUP BY 1, 2),
br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS k FROM bs) WHERE k <= 50),
bf AS (SELECT question_id, chunk_id, score FROM br UNION ALL SELECT q.question_id, l.chunk_id, 0.0 FROM (SELECT DISTINCT question_id FROM bq) q
  CROSS JOIN (SELECT chunk_id FROM bd ORDER BY chunk_id LIMIT 100) l WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.question_id = q.question_id AND br.chunk_id = l.chunk_id)
  AND (SELECT count(*) FROM br WHERE br.question_id = q.question_id) < 50),
bm AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM bf QUALIFY rank <= 50)"""
_DOT = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
DENSE_CTES = f"""
de AS (SELECT question_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, {_DOT} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 12) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 50)"""
FUSE_CTES = """
dq AS (SELECT question_id // 20 AS question_id, rank, chunk_id, score FROM de WHERE question_id // 20 IN (SELECT item_id FROM benchmark)),
fu AS (SELECT question_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min({'a': list, 'b': rank}) AS seen FROM
  (SELECT question_id, rank, chunk_id, 0 AS list FROM bm UNION ALL SELECT question_id, rank, chunk_id, 1 FROM dq) GROUP BY 1, 2),
fr AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, seen) AS INTEGER) AS rank, chunk_id, score FROM fu QUALIFY rank <= 50)"""


def rerank_ctes(pool: str) -> str:
    return f"""
rs AS (SELECT p.question_id, p.chunk_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS score FROM {pool} p
  JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{W}')) AS a FROM benchmark) q ON q.item_id = p.question_id
  JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{W}')) AS b FROM documents) c ON c.doc_id = p.chunk_id),
rr AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM rs)"""


LISTS_SQL = f"{BM25_CTES}, {DENSE_CTES}, {FUSE_CTES}"
RANKED_SQL = LISTS_SQL + """,
ranked AS (SELECT question_id, system, rank, chunk_id, source AS cnr FROM (SELECT question_id, 'bm25' AS system, rank, chunk_id FROM bm
  UNION ALL SELECT question_id, 'dense', rank, chunk_id FROM dq UNION ALL SELECT question_id, 'hybrid_rrf', rank, chunk_id FROM fr) LEFT JOIN documents ON doc_id = chunk_id)"""
VALUES_SQL = (
    RANKED_SQL + ", " + ITEMS_SQL + ", hits AS (SELECT i.question_id, s.system, min(r.rank) AS hit_rank FROM items i CROSS JOIN (SELECT DISTINCT system FROM ranked) s "
    "LEFT JOIN ranked r ON r.question_id = i.question_id AND r.system = s.system AND r.cnr = i.cnr GROUP BY 1, 2), "
    "vals AS (SELECT question_id, system, 'judgment' AS level, unnest(['recall@1', 'recall@5', 'recall@10', 'recall@50', 'mrr@10']) AS metric, "
    "unnest([CAST(coalesce(hit_rank <= 1, false) AS DOUBLE), CAST(coalesce(hit_rank <= 5, false) AS DOUBLE), CAST(coalesce(hit_rank <= 10, false) AS DOUBLE), "
    "CAST(coalesce(hit_rank <= 50, false) AS DOUBLE), CASE WHEN hit_rank <= 10 THEN 1.0 / hit_rank ELSE 0.0 END]) AS value FROM hits)"
)


def all_lists(s, d):
    known = table(s, d, "benchmark").selectExpr("item_id AS question_id")
    near = dense(s, d).withColumn("question_id", F.expr("question_id div 20")).join(known, "question_id", "left_semi")
    return R.retrieve_all(bm25_queries(s, d), doc_chunks(s, d), near, index=_index(s, d))


def retrieval_records(s, d):
    courts = table(s, d, "documents").selectExpr("doc_id AS chunk_id", "text", "source AS court_code", "CAST(NULL AS STRING) AS decision_date")
    asked = bm25_queries(s, d).select("question_id").unionByName(s.range(-2, 0).selectExpr("id AS question_id"))
    rows = R.retrieval_records(asked, ranked(s, d), courts)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select(
        "question_id", "status", ids(F.col("systems")["bm25"]).alias("bm25"), ids(F.col("systems")["hybrid_rrf"]).alias("hybrid"),
        ids(F.transform(F.col("context")["hybrid_rrf"], lambda x: x["chunk_id"])).alias("context"),
    )


def agreement_pairs(s, d):
    humans = gen(s, d).select("item_id", F.col("human_relevance").alias("answer_relevance"), F.col("human_faithfulness").alias("faithfulness"), F.col("human_hallucination").alias("hallucination"))
    return L.judge_human_pairs(gen(s, d), humans, "item_id", ("answer_relevance", "faithfulness", "hallucination"))


def evaluated(s, d, part):
    known = items(s, d).withColumn("cluster", F.col("cnr"))
    states = known.select("question_id", F.when(F.col("question_id") % 13 == 5, "error").otherwise("ok").alias("state"))
    return S.evaluate_retrieval(known, ranked(s, d), {"judgment": (gold(s, d), "cnr")}, states=states, draws=2000)[part]


def both_raters(s, d):
    return gen(s, d).select("question_type", F.col("answer_relevance").alias("a"), F.col("human_relevance").alias("b")).where("b IS NOT NULL")


def _index(s, d):
    """The stored index of the documents, written once for a session and input."""
    return kept(s, d, "index", ("documents",), lambda: write_index(doc_chunks(s, d), scratch(s)))


_CLASSES = ["".join(chr(97 + c) for c in range(26) if c % 8 == k) for k in range(8)]
EMBED_SQL = (
    "WITH c AS (SELECT doc_id, " + ", ".join(f"len(regexp_replace(coalesce(text, ''), '[^{x}{x.upper()}]', '', 'g')) AS c{k}" for k, x in enumerate(_CLASSES)) + " FROM documents), "
    "n AS (SELECT *, sqrt(" + " + ".join(f"c{k} * c{k}" for k in range(8)) + ") AS n FROM c) SELECT doc_id, "
    + ", ".join(f"round(CASE WHEN n = 0 THEN 0 ELSE c{k} / n END, 1) AS e{k}" for k in range(8)) + ", n > 0 AS unit FROM n"
)


def embedded(s, d):
    """Each document's vector of letter classes to one digit, and whether its length is one."""
    rows = R.embed(table(s, d, "documents").select("doc_id", "text"), R.letter_encoder, kind="double")
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    parts = [F.round(F.col("embedding")[k], 1).alias(f"e{k}") for k in range(8)]
    return rows.select("doc_id", *parts, (F.abs(length - 1) < 1e-5).alias("unit"))


def chunk_invariants(s, d):
    """Of each chunked document: whether its chunks stand in it, keep to the length, and have numbers that rise without
    repeats and ids made of them."""
    docs = table(s, d, "documents").select("doc_id", "text")
    chunks = C.chunk_documents(docs.withColumn("whole", F.col("text")), "doc_id", "text", carry=("whole",))
    inside = F.contains("whole", "text")
    named = F.col("chunk_id") == F.concat(F.col("cnr").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return chunks.groupBy(F.col("cnr").alias("doc_id")).agg(
        F.bool_and(inside).alias("inside"), F.bool_and(F.char_length("text").between(100, 1200)).alias("sized"), F.bool_and(named).alias("named"),
        (F.countDistinct("chunk_index") == F.count(F.lit(1))).alias("apart"),
    )


def index_postings(s, d):
    """What the stored postings say of each token; the index is opened anew, as a later session would."""
    path = scratch(s)
    write_index(doc_chunks(s, d), path)
    rows = read_index(s, path).postings.where("token IS NOT NULL").select("token", F.transform("postings", lambda p: p["tf"]).alias("tf"))
    sums = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("token").agg(F.sum(sums).alias("occurrences"), F.sum(F.size("tf")).alias("chunks"), F.max(F.array_max("tf")).cast("long").alias("most"))


def benchmark_file(s, d):
    """The benchmark as a JSON-lines file, read by the reader."""
    folder = f"{scratch(s)}/benchmark.jsonl"
    table(s, d, "benchmark").selectExpr("item_id AS question_id", "CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN ' ' ELSE concat('src', CAST(item_id AS STRING)) END AS source_cnr", "CASE WHEN item_id % 2 = 0 THEN array('g1', 'g2') END AS gold_cnrs").write.json(folder)
    return T.load_benchmark(s, folder).select("question_id", F.array_join("gold_cnrs", ",").alias("gold"), "group")


LOG_LINE = "CASE WHEN event_id % 13 = 0 THEN '{broken' ELSE concat('{\"id\": ', CAST(user_id AS STRING), ', \"event\": ', CAST(event_id AS STRING), ', \"status\": \"', event_type, '\"}') END AS value"


def log_file(s, d):
    """Events as one log file in their order, read by the reader: the last record of each user."""
    folder = scratch(s)
    table(s, d, "events").selectExpr("event_id", LOG_LINE).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(folder)
    last, broken = T.read_result_log(s, folder, "id long, event long, status string", "id")
    return last.select("id", F.col("event").alias("event_id"), "status").join(F.broadcast(broken))


def embedding_file(s, d):
    n = table(s, d, "embeddings").count()
    vectors = T.read_embeddings(s, f"{d}/embeddings.parquet", 64, n)
    return vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


REPLIES = (
    "concat(CASE d % 3 WHEN 0 THEN '<think>x</think>' WHEN 1 THEN '```json ' ELSE '' END, '{\"answer_relevance\": ', CAST(1 + d % 5 AS STRING), "
    "', \"faithfulness\": 2, \"citation_correctness\": \"3\", \"overall_score\": 4.0, \"unsupported_claim_rate\": 0.', CAST(d % 10 AS STRING), "
    "', \"hallucination\": ', CASE WHEN d % 2 = 0 THEN 'true' ELSE '\"False\"' END, CASE WHEN d % 7 = 0 THEN '' ELSE '}' END)"
)


def _kappa_sql(weights: str) -> str:
    cost = {"none": "CAST(x.a <> y.b AS DOUBLE)", "quadratic": "((x.a - y.b) / 3.0) * ((x.a - y.b) / 3.0)"}[weights]
    own = cost.replace("x.a", "p.a").replace("y.b", "p.b")
    return f"""WITH {GEN_SQL}, p AS (SELECT question_type, answer_relevance AS a, human_relevance AS b FROM gen WHERE human_relevance IS NOT NULL),
o AS (SELECT question_type, count(*) AS n, avg({own}) AS seen FROM p GROUP BY 1),
x AS (SELECT question_type, a, count(*) AS n FROM p GROUP BY 1, 2), y AS (SELECT question_type, b, count(*) AS n FROM p GROUP BY 1, 2),
e AS (SELECT x.question_type, sum({cost} * x.n * y.n) AS c FROM x JOIN y USING (question_type) GROUP BY 1)
SELECT question_type, o.n AS n, round(CASE WHEN c > 0 THEN 1 - seen / (c / (o.n * o.n)) END, 6) AS kappa FROM o JOIN e USING (question_type)"""


BY = ["level", "system", "metric"]
QUERIES = {
    "chk1_chunk_documents": lambda s, d: C.chunk_documents(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text"),
    "flt9_min_chunk_length": lambda s, d: C.drop_short(windows(s, d)).select("chunk_id", "chunk_index"),
    "agg38_chunk_stats": lambda s, d: rounded(C.chunk_stats(windows(s, d).withColumn("cnr", F.concat(F.lit("C"), "cnr")), 2), "mean_length"),
    "jon1_gold_exact": lambda s, d: G.gold_exact(evidence(s, d), windows(s, d)),
    "jon2_gold_window": lambda s, d: G.gold_window(evidence(s, d), windows(s, d)),
    "jon3_gold_span_overlap": lambda s, d: G.gold_span_overlap(evidence(s, d), table(s, d, "documents").select(F.col("doc_id").alias("cnr"), "text"), windows(s, d)),
    "jon4_similarity_bounds": lambda s, d: rounded(G.similar_pairs(evidence(s, d), windows(s, d)).select("question_id", "chunk_id", "bound"), "bound"),
    "chk1_invariants": chunk_invariants,
    "jon4_gold_similarity": lambda s, d: G.gold_similarity(evidence(s, d), windows(s, d), 0.3, 3),
    "win9_one_per_cnr": lambda s, d: G.one_per_cnr(items(s, d)).select("question_id", "cnr"),
    "src8_load_benchmark": benchmark_file,
    "src8_benchmark_problems": lambda s, d: T.benchmark_problems(T.normalize_benchmark(table(s, d, "benchmark").selectExpr("CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 7 = 1 THEN 'same' ELSE CAST(item_id AS STRING) END AS question_id", "CASE WHEN item_id % 5 > 0 THEN concat('src', CAST(item_id AS STRING)) END AS source_cnr"))),
    "src9_read_result_log": log_file,
    "src10_read_embeddings": embedding_file,
    "src10_check_embeddings": lambda s, d: R.check_embeddings(table(s, d, "embeddings"), "embedding"),
    "win8_last_record_wins": lambda s, d: L.last_record_wins(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id"),
    "flt10_usable_questions": lambda s, d: L.usable_questions(table(s, d, "customer").selectExpr("c_custkey AS user_id"), L.last_record_wins(table(s, d, "events").selectExpr("user_id", "event_id", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status"), "user_id", "event_id"), "user_id").groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    "jon6_retrieval_for_items": lambda s, d: L.retrieval_for_items(items(s, d).select("question_id"), table(s, d, "documents").selectExpr("doc_id AS question_id", "CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status"), "question_id"),
    "jon7_todo_items": lambda s, d: L.todo_items(table(s, d, "customer").selectExpr("c_custkey AS user_id"), table(s, d, "events").selectExpr("user_id", "event_type AS status"), "user_id", ("error",)),
    "jon8_missing_ids": lambda s, d: L.missing_ids(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), "doc_id"),
    "jon9_unresolved_chunk_ids": lambda s, d: L.unresolved_chunk_ids(table(s, d, "embeddings").selectExpr("vec_id * 3 AS chunk_id"), table(s, d, "documents").selectExpr("CASE WHEN doc_id % 100 = 1 THEN NULL WHEN doc_id % 50 = 2 THEN doc_id + 1 ELSE doc_id END AS chunk_id")),
    "set4_id_set_difference": lambda s, d: L.id_set_difference(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), "doc_id"),
    "agg39_latency_stats": lambda s, d: rounded(L.latency_stats(table(s, d, "events").selectExpr("event_type", "CAST(event_id % 977 AS DOUBLE) AS ms"), "event_type", "ms"), "mean", "median", "p95"),
    "flt12_validate_candidates": lambda s, d: L.validate_candidates(items(s, d).withColumn("gold", F.when(F.col("question_id") % 6 > 0, F.array("cnr"))), ("cnr", "bench", "question_type"), "gold", {"type0": 4, "type1": 4, "type2": 4})[0].groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n")),
    "flt12_mix": lambda s, d: L.validate_candidates(items(s, d).withColumn("gold", F.when(F.col("question_id") % 6 > 0, F.array("cnr"))), ("cnr", "bench", "question_type"), "gold", {"type0": 4, "type1": 4, "type2": 4})[1],
    "scl33_model_family": lambda s, d: L.check_independence(table(s, d, "documents").selectExpr("concat('Org/', upper(lang), CAST(doc_id % 3 AS STRING)) AS judge", "concat(lang, CAST(doc_id % 4 AS STRING)) AS generator"), "judge", "generator"),
    "ret1_bm25_index": lambda s, d: rounded(write_index(doc_chunks(s, d), scratch(s)).terms, "idf"),
    "ret1_bm25_postings": index_postings,
    "ret2_bm25_search": lambda s, d: rounded(bm25(s, d), "score"),
    "udf3_embed": embedded,
    "top1_top_k_per_query": lambda s, d: rounded(bm25(s, d).where("rank <= 5"), "score"),
    "ret3_normalize_index": lambda s, d: R.normalize_index(table(s, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * 3)), "vec_id", "embedding").select("chunk_id", F.round(F.get("embedding", 0).cast("double"), 5).alias("x0"), F.size("embedding").alias("dim")),
    "scl32_l2_normalize": lambda s, d: table(s, d, "embeddings").select("vec_id", A.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 2)).alias("u")).select("vec_id", F.round(F.get("u", 1), 6).alias("u1")),
    "ret4_dense_search": lambda s, d: rounded(dense(s, d), "score"),
    "ret5_rrf_fuse": lambda s, d: rounded(R.rrf_fuse(ranked(s, d).where("system <> 'hybrid_rrf'").withColumn("list", F.when(F.col("system") == "bm25", 0).otherwise(1))), "score"),
    "set3_union_ranked": lambda s, d: R.union_ranked({"x": ranked(s, d).where("system = 'bm25'"), "y": ranked(s, d).where("system = 'dense'")}).groupBy("system", "list").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("deepest")),
    "ret6_rerank": lambda s, d: rounded(R.rerank(ranked(s, d).where("system = 'bm25'"), bm25_queries(s, d), doc_chunks(s, d), k=5), "score"),
    "win7_rank_within_query": lambda s, d: ranked(s, d).where("rank <= 10").select("question_id", "system", "rank", "chunk_id"),
    "ret7_retrieve_all": lambda s, d: rounded(all_lists(s, d), "score"),
    "ret7_retrieval_records": retrieval_records,
    "jon5_attach_chunk_meta": lambda s, d: R.attach_chunks(ranked(s, d).where("rank <= 3").select("question_id", "system", (F.col("chunk_id") * 2).alias("chunk_id")), table(s, d, "documents").selectExpr("doc_id AS chunk_id", "source AS court", "lang")),
    "top2_context_rows": lambda s, d: _blocks(s, d).select("question_id", F.array_join(F.transform("context", lambda c: c["chunk_id"].cast("string")), ",").alias("ids")),
    "scl31_query_instruction": lambda s, d: table(s, d, "benchmark").select("item_id", A.query_instruction("text", "Th").alias("q")),
    "scl21_extract_citations": lambda s, d: ans(s, d).select("item_id", F.array_join(A.extract_citations("answer"), ",").alias("cited")),
    "scl22_citations_in_context": lambda s, d: ans(s, d).select("item_id", A.citations_in_context(A.extract_citations("answer"), F.array(*[F.lit(f"c{k}") for k in range(4)])).alias("inside")),
    "scl23_build_prompt": lambda s, d: _blocks(s, d).select("question_id", F.sha1(A.build_prompt("question", "context")).alias("h")),
    "scl24_build_judge_prompt": lambda s, d: _blocks(s, d).select("question_id", F.sha1(A.build_judge_prompt("question", F.when(F.col("question_id") % 4 > 0, F.col("context")).otherwise(F.slice("context", 1, 0)), F.lit("An answer."), F.when(F.col("question_id") % 3 == 0, F.lit("Seen.")))).alias("h")),
    "scl25_parse_judge_reply": lambda s, d: udfs.parse_judge_reply(table(s, d, "documents").selectExpr("doc_id", REPLIES.replace("d %", "doc_id %") + " AS reply"), "reply").select("doc_id", "verdict.status", "verdict.answer_relevance", "verdict.citation_correctness", "verdict.unsupported_claim_rate", "verdict.hallucination"),
    "scl26_is_refusal": lambda s, d: ans(s, d).select("item_id", A.is_refusal("answer").alias("refused")),
    "scl27_metric_values": lambda s, d: rounded(values(s, d), "value"),
    "scl28_classify_failure": lambda s, d: gen(s, d).select("item_id", A.classify_failure(F.col("hit"), F.col("hallucination"), F.col("faithfulness"), F.col("answer_relevance"), F.col("citation_correctness")).alias("label")),
    "scl29_label_failure": lambda s, d: _labelled(gen(s, d)).select("item_id", "failure_label"),
    "scl30_classify_failure_published": lambda s, d: gen(s, d).select("item_id", A.classify_failure_published(F.when(F.col("d") % 29 == 0, "please Switch to another").otherwise("fine"), F.col("hit"), F.col("hallucination"), F.col("citation_correctness"), F.col("answer_relevance")).alias("label")),
    "jon10_hit_semi": lambda s, d: M.hit_semi(ranked(s, d), gold(s, d), "cnr", 10),
    "set5_gold_intersect": lambda s, d: M.gold_intersect(ranked(s, d), gold(s, d), "cnr", 10),
    "jon15_judge_human_pairs": lambda s, d: L.judge_human_pairs(gen(s, d).select("item_id", "answer_relevance"), gen(s, d).select("item_id", F.col("human_relevance").alias("answer_relevance")), "item_id", ("answer_relevance",)),
    "jon17_citation_context": lambda s, d: M.citation_context(*_cited(s, d)),
    "jon18_evaluation_records": lambda s, d: M.evaluation_records(items(s, d).select("question_id", "cnr"), table(s, d, "documents").groupBy(F.col("source").alias("cnr")).agg(F.min("doc_id").alias("reference"))),
    "jon19_grounded_citations": lambda s, d: M.grounded_citations(_cited(s, d)[0], ranked(s, d).where("system = 'bm25'"), table(s, d, "documents").selectExpr("doc_id AS chunk_id", "source AS cnr", "lang")).select("question_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["chunk_id"].cast("string"), c["cnr"])), ",").alias("cited")),
    "agg27_retrieval_scores": lambda s, d: rounded(M.retrieval_scores(values(s, d)), "mean"),
    "agg28_recall_breakdown": lambda s, d: rounded(M.recall_breakdown(values(s, d), items(s, d), ("question_type", "bench")), "recall"),
    "agg29_generation_means": lambda s, d: rounded(M.generation_means(gen(s, d).where("generation_ok").drop("d")), *M.SCORES, "hallucination_rate"),
    "agg30_score_distribution": lambda s, d: M.score_distribution(gen(s, d)),
    "agg31_scores_by_type": lambda s, d: rounded(M.scores_by(gen(s, d), "question_type"), *M.SCORES),
    "agg32_crosstab": lambda s, d: M.crosstab(gen(s, d).withColumn("h", F.col("hallucination").cast("string")), "question_type", "h", ["false", "true"]),
    "agg33_citation_consistency": lambda s, d: M.citation_consistency(M.citation_context(*_cited(s, d)), _cited(s, d)[0].withColumn("kind_of", F.concat(F.lit("k"), F.col("question_id") % 3)), "kind_of"),
    "agg34_context_presence": lambda s, d: rounded(M.context_presence(ranked(s, d).where("system = 'bm25' AND rank <= 5"), items(s, d)), "mean_hallucination"),
    "agg35_failure_table": lambda s, d: rounded(M.failure_table(_labelled(gen(s, d))), "estimate", "low", "high"),
    "agg36_generation_counts": lambda s, d: M.generation_counts(M.generation_pools(gen(s, d))),
    "flt11_generation_pools": lambda s, d: M.generation_pools(gen(s, d)).select("item_id", "is_generation_error", "in_scored_pool", "is_refused", "is_answered", "is_judged", "is_judge_error"),
    "agg37_percent_agreement": lambda s, d: rounded(M.percent_agreement(gen(s, d), F.col("quality"), 1 - F.col("toxic")), "agreement"),
    "agg40_token_cost": lambda s, d: rounded(M.token_cost(table(s, d, "documents"), "text", 300, 0.5, 1.5), "usd"),
    "agg41_scoreboard": lambda s, d: rounded(M.with_delta(M.scoreboard(values(s, d), ["system"], ["recall@1", "recall@10", "mrr@10"]), "hybrid_rrf", "recall@10").withColumnsRenamed({"recall@1": "r1", "recall@10": "r10", "mrr@10": "mrr"}), "r1", "r10", "mrr", "delta"),
    "top6_label_sheet": lambda s, d: _sheet(s, d),
    "sta1_wilson": lambda s, d: rounded(gen(s, d).groupBy("cluster").agg(F.count_if("hallucination").alias("k"), F.count(F.lit(1)).alias("n")).withColumn("w", wilson("k", "n")).select("cluster", "k", "n", "w.*"), "estimate", "low", "high"),
    "sta2_cluster_bootstrap": lambda s, d: S.cluster_bootstrap(values(s, d).join(clusters(s, d), "question_id"), BY, "cluster", 2000),
    "sta2_estimates": lambda s, d: rounded(S.cluster_bootstrap(values(s, d).join(clusters(s, d), "question_id"), BY, "cluster", 200).select(*BY, "estimate", "n", "method"), "estimate"),
    "sta3_summarize": lambda s, d: S.summarize(values(s, d), BY, draws=2000),
    "sta3_wilson_intervals": lambda s, d: rounded(S.summarize(values(s, d), BY, draws=200).where("method = 'wilson'").select(*BY, "estimate", "low", "high", "n"), "estimate", "low", "high"),
    "sta4_paired_bootstrap": lambda s, d: S.paired_bootstrap(S.paired(values(s, d), "hybrid_rrf", ["level", "metric"]).join(clusters(s, d), "question_id"), BY, "cluster", 2000),
    "sta4_paired_differences": lambda s, d: rounded(S.paired(values(s, d), "hybrid_rrf", ["level", "metric"]).groupBy(*BY).agg(F.avg("value").alias("difference"), F.count(F.lit(1)).alias("n")), "difference"),
    "sta5_mcnemar_counts": lambda s, d: S.mcnemar_counts(S.paired(values(s, d), "hybrid_rrf", ["level", "metric"]), BY),
    # Tails are fractions of a power of two: moved off the halves, so that both sides round alike.
    "sta5_mcnemar_exact": lambda s, d: rounded(S.mcnemar_exact(S.paired(values(s, d), "hybrid_rrf", ["level", "metric"]), BY).withColumn("p_value", F.col("p_value") + 1e-9), "p_value"),
    "sta6_cohens_kappa": lambda s, d: rounded(S.cohens_kappa(both_raters(s, d), ["question_type"], "a", "b"), "kappa"),
    "sta6_quadratic_kappa": lambda s, d: rounded(S.cohens_kappa(both_raters(s, d), ["question_type"], "a", "b", "quadratic", [1, 2, 3, 4]), "kappa"),
    "sta7_kappa_interval": lambda s, d: S.kappa_interval(both_raters(s, d), ["question_type"], "a", "b", "quadratic"),
    "sta8_compare_systems": lambda s, d: S.compare_systems(values(s, d), clusters(s, d), draws=2000),
    "sta9_summarize_generation": lambda s, d: S.summarize_generation(gen(s, d), "cluster", draws=2000),
    "sta9_generation_estimates": lambda s, d: rounded(S.summarize_generation(gen(s, d), "cluster", draws=200).select("metric", "estimate", "n"), "estimate"),
    "sta10_judge_agreement": lambda s, d: rounded(S.judge_agreement(agreement_pairs(s, d), ("answer_relevance", "faithfulness"), [1, 2, 3, 4], 200).select("field", "n", "agreement", "kappa", "kappa_quadratic"), "agreement", "kappa", "kappa_quadratic"),
    "sta10_agreement_intervals": lambda s, d: S.judge_agreement(agreement_pairs(s, d), ("answer_relevance", "faithfulness"), [1, 2, 3, 4]),
    "sta11_evaluate_retrieval": lambda s, d: evaluated(s, d, "systems"),
    "sta11_estimates": lambda s, d: rounded(evaluated(s, d, "systems").select("level", "system", "metric", "estimate", "n", "clusters"), "estimate"),
    "sta11_counts": lambda s, d: evaluated(s, d, "counts"),
    "sta11_breakdown": lambda s, d: rounded(evaluated(s, d, "breakdown").select("field", "bucket", "system", "estimate", "n"), "estimate"),
    "sta11_comparisons": lambda s, d: rounded(evaluated(s, d, "comparisons").select("level", "system", "metric", "difference", "n", "a_only", "b_only"), "difference"),
    "win10_holm_adjust": lambda s, d: rounded(S.holm_adjust(table(s, d, "nation").selectExpr("n_nationkey", "n_regionkey", "CAST(n_nationkey * 7 % 25 + 1 AS DOUBLE) / 200 AS p"), "p", ["n_regionkey"], ["n_nationkey"]), "p", "holm_p"),
}


def _labelled(df):
    return df.withColumn("failure_label", A.label_failure(F.col("generation_ok"), F.col("refused"), F.col("judge_status") == "ok", F.col("hit"), F.col("hallucination"), F.col("faithfulness"), F.col("answer_relevance"), F.col("citation_correctness")))


def _cited(s, d):
    """Answers that cite three ids: one from their list, one from another judgment, one that was not retrieved."""
    rows = ranked(s, d).where("system = 'bm25'")
    per = rows.where("rank IN (1, 3)").groupBy("question_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("cited"))
    answers = items(s, d).select("question_id", "cnr").join(per, "question_id").withColumn("cited", F.concat("cited", F.array(F.lit(-1).cast("long"))))
    first = rows.where("rank = 1").select("question_id", F.col("cnr").alias("own"))
    answers = answers.join(first, "question_id").select("question_id", F.when(F.col("question_id") % 2 == 0, F.col("own")).otherwise(F.col("cnr")).alias("cnr"), "cited")
    return answers, rows


def _sheet(s, d):
    from ..operators.sampling import label_sheet

    rows = gen(s, d).selectExpr("item_id", "generation_ok", "refused", "question_type AS question", "bench AS answer")
    return label_sheet(rows, 30, 7).select("item_id", "question", "answer", "answer_relevance", "hallucination", "notes")


_V = f"WITH {VALUES_SQL} "
_G = f"WITH {GEN_SQL} "
_R = f"WITH {RANKED_SQL}, {ITEMS_SQL} "
_LABEL = "CASE WHEN NOT hit THEN 'Retrieval Failure' WHEN hallucination OR faithfulness <= 2 THEN 'Generation Grounding Failure' WHEN answer_relevance <= 2 THEN 'Low Answer Relevance' WHEN citation_correctness <= 2 THEN 'Context Selection / Citation' ELSE 'No Major Failure (Success)' END"
_LABEL2 = f"CASE WHEN NOT generation_ok THEN 'System Error (generation)' WHEN refused AND hit THEN 'Wrongful Refusal (evidence retrieved)' WHEN refused THEN 'Refusal (evidence not retrieved)' WHEN judge_status <> 'ok' THEN 'System Error (judge)' ELSE {_LABEL} END"
_SP = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _match(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{_SP}]', ' ', 'g'), '[{_SP}]+', ' ', 'g'))"


def _same(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[{_SP}]+', ' ', 'g'))"


_MATCHED = f"WITH {WINDOWS_SQL}, {EVIDENCE_SQL}, e AS (SELECT question_id, cnr, {_match('supporting_text')} AS p FROM evidence), c AS (SELECT chunk_id, cnr, chunk_index, {_match('text')} AS t FROM chunks), exact AS (SELECT question_id, chunk_id FROM e JOIN c USING (cnr) WHERE p <> '' AND contains(t, p)) "
_CITED = "_cite AS (SELECT question_id, list_sort(list(chunk_id)) AS ids FROM ranked WHERE system = 'bm25' AND rank IN (1, 3) GROUP BY 1), answers AS (SELECT i.question_id, CASE WHEN i.question_id % 2 = 0 THEN r.cnr ELSE i.cnr END AS cnr, list_append(ids, -1) AS cited FROM items i JOIN _cite USING (question_id) JOIN ranked r ON r.question_id = i.question_id AND r.system = 'bm25' AND r.rank = 1), kinds AS (SELECT a.question_id, a.chunk_id, CASE WHEN r.cnr IS NULL THEN 'not_retrieved' WHEN r.cnr = a.cnr THEN 'correct_judgment' ELSE 'wrong_judgment' END AS kind FROM (SELECT question_id, cnr, unnest(cited) AS chunk_id FROM answers) a LEFT JOIN ranked r ON r.question_id = a.question_id AND r.chunk_id = a.chunk_id AND r.system = 'bm25')"
_CITES = r"list_distinct(regexp_extract_all(answer, '(?i)\[Chunk ID:\s*([^\]|\s][^\]|]*?)\s*(?:\||\])', 1))"
_ORDERED = "list_filter({c}, lambda x, i: list_position({c}, x) = i)".format(c=r"regexp_extract_all(answer, '(?i)\[Chunk ID:\s*([^\]|\s][^\]|]*?)\s*(?:\||\])', 1)")
_PAIRED = _V + ", pd AS (SELECT a.question_id, a.system, a.level, a.metric, a.value AS va, b.value AS vb FROM vals a JOIN vals b USING (question_id, level, metric) WHERE a.system <> 'hybrid_rrf' AND b.system = 'hybrid_rrf') "
_LONG = _G + ", lg AS (SELECT unnest(['answer_relevance', 'faithfulness', 'citation_correctness', 'overall_score', 'unsupported_claim_rate', 'hallucination_rate']) AS metric, unnest([CAST(answer_relevance AS DOUBLE), faithfulness, citation_correctness, overall_score, unsupported_claim_rate, CAST(hallucination AS DOUBLE)]) AS value FROM gen WHERE generation_ok AND NOT refused AND judge_status = 'ok' UNION ALL SELECT 'citations_in_context_rate', CAST(citations_in_context AS DOUBLE) FROM gen WHERE generation_ok AND NOT refused AND citations_in_context IS NOT NULL UNION ALL SELECT 'refusal_rate', CAST(refused AS DOUBLE) FROM gen WHERE generation_ok) "
_AGREE = _G + ", p AS (SELECT 'answer_relevance' AS field, CAST(answer_relevance AS DOUBLE) AS a, CAST(human_relevance AS DOUBLE) AS b FROM gen WHERE human_relevance IS NOT NULL UNION ALL SELECT 'faithfulness', faithfulness, human_faithfulness FROM gen WHERE human_faithfulness IS NOT NULL UNION ALL SELECT 'hallucination', CAST(hallucination AS DOUBLE), CAST(human_hallucination AS DOUBLE) FROM gen), o AS (SELECT field, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS same, avg(CAST(a <> b AS DOUBLE)) AS d0, avg((a - b) * (a - b) / 9) AS d2 FROM p GROUP BY 1), x AS (SELECT field, a, count(*) AS n FROM p GROUP BY 1, 2), y AS (SELECT field, b, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT field, sum(CAST(a <> b AS DOUBLE) * x.n * y.n) AS c0, sum((a - b) * (a - b) / 9 * x.n * y.n) AS c2 FROM x JOIN y USING (field) GROUP BY 1) "
_USABLE = _V + ", uv AS (SELECT vals.*, cnr FROM vals JOIN items USING (question_id) WHERE question_id % 13 <> 5) "
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in M.SCORES)
_CAND = _R + ", v AS (SELECT *, CASE WHEN trim(cnr) = '' OR trim(bench) = '' OR trim(question_type) = '' THEN 'blank_field' WHEN question_type NOT IN ('type0', 'type1', 'type2') THEN 'unknown_type' WHEN question_id % 6 = 0 THEN 'no_gold' END AS reason FROM items) "
SQL = {
    "flt9_min_chunk_length": f"WITH {WINDOWS_SQL} SELECT chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index FROM chunks WHERE length(text) >= 100",
    "agg38_chunk_stats": f"WITH {WINDOWS_SQL} SELECT substring('C' || cnr, 1, 2) AS prefix, count(*) AS chunks, count(DISTINCT cnr) AS judgments, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length FROM chunks GROUP BY 1",
    "jon1_gold_exact": _MATCHED + "SELECT * FROM exact",
    "jon2_gold_window": _MATCHED + ", w AS (SELECT question_id, cnr, string_split(p, ' ') AS w FROM e WHERE p <> '' AND question_id NOT IN (SELECT question_id FROM exact)), s AS (SELECT *, unnest([60, 40, 25, 15, 10]) AS size FROM w), o AS (SELECT question_id, cnr, size, w, unnest(range(0, len(w) - size + 1, greatest(1, size // 2))) AS pos FROM s WHERE len(w) >= size), h AS (SELECT question_id, size, chunk_id, min({'p': pos, 'i': chunk_index}) AS seen FROM o JOIN c USING (cnr) WHERE contains(t, array_to_string(w[pos + 1:pos + size], ' ')) GROUP BY 1, 2, 3), m AS (SELECT *, max(size) OVER (PARTITION BY question_id) AS best FROM h) SELECT question_id, chunk_id, size, CAST(row_number() OVER (PARTITION BY question_id ORDER BY seen, chunk_id) AS INTEGER) AS place FROM m WHERE size = best",
    "jon4_similarity_bounds": SIMILAR_SQL,
    "chk1_invariants": f"SELECT doc_id, true AS inside, true AS sized, true AS named, true AS apart FROM documents WHERE length({sql_strip('text')}) >= 100",
    "jon3_gold_span_overlap": f"WITH {WINDOWS_SQL}, {EVIDENCE_SQL}, e AS (SELECT question_id, cnr, {_same('supporting_text')} AS p FROM evidence), t AS (SELECT doc_id AS cnr, {_same('text')} AS t FROM documents), c AS (SELECT chunk_id, cnr, chunk_index, {_same('text')} AS c FROM chunks), "
    "sp AS (SELECT question_id, cnr, instr(t, p) - 1 AS st, length(p) AS n FROM e JOIN t USING (cnr) WHERE p <> ''), pl AS (SELECT cnr, chunk_id, instr(t, c) - 1 AS lo, length(c) AS m FROM c JOIN t USING (cnr)), "
    "h AS (SELECT DISTINCT question_id, chunk_id FROM sp JOIN pl USING (cnr) WHERE st >= 0 AND lo >= 0 AND lo < st + n AND lo + m > st), "
    "w AS (SELECT question_id, cnr, string_split(p, ' ') AS w FROM e WHERE p <> '' AND question_id NOT IN (SELECT question_id FROM h)), s AS (SELECT *, unnest([60, 40, 25, 15, 10]) AS size FROM w), "
    "o AS (SELECT question_id, cnr, size, w, unnest(range(0, len(w) - size + 1)) AS pos FROM s WHERE len(w) >= size), "
    "f AS (SELECT question_id, arg_min(chunk_id, {'a': -size, 'b': pos, 'c': chunk_index}) AS chunk_id FROM o JOIN c USING (cnr) WHERE contains(c, array_to_string(w[pos + 1:pos + size], ' ')) GROUP BY 1) "
    "SELECT * FROM h UNION ALL SELECT * FROM f",
    "win9_one_per_cnr": _R + "SELECT min(question_id) AS question_id, cnr FROM items GROUP BY 2",
    "src8_load_benchmark": "SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'g1,g2' ELSE 'src' || item_id END AS gold, CASE WHEN item_id % 6 = 0 THEN 'g1' ELSE 'src' || item_id END AS \"group\" FROM benchmark",
    "src8_benchmark_problems": "WITH x AS (SELECT CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 7 = 1 THEN 'same' ELSE CAST(item_id AS VARCHAR) END AS question_id, item_id % 5 > 0 AS gold FROM benchmark) SELECT question_id, CASE WHEN trim(question_id) = '' THEN 'blank_id' ELSE 'no_gold' END AS problem FROM x WHERE trim(question_id) = '' OR NOT gold UNION ALL SELECT question_id, 'repeated_id' FROM x WHERE trim(question_id) <> '' GROUP BY 1 HAVING count(*) > 1",
    "src9_read_result_log": "SELECT user_id AS id, event_id, event_type AS status, (SELECT count(*) FROM events) AS lines, (SELECT count(*) FROM events WHERE event_id % 13 = 0) AS broken FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 13 > 0) WHERE k = 1",
    "src10_read_embeddings": "SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1",
    "src10_check_embeddings": "SELECT count(*) AS rows, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings",
    "win8_last_record_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "flt10_usable_questions": "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT CASE WHEN t IS NULL THEN 'not_run' WHEN t = 'error' THEN 'error' ELSE 'ok' END AS state, count(*) AS n FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY 1",
    "jon6_retrieval_for_items": "SELECT item_id AS question_id, NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = item_id AND doc_id % 3 > 0) AS skipped FROM benchmark",
    "jon7_todo_items": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')",
    "jon8_missing_ids": "SELECT doc_id, 'actual' AS lacking FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'expected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "jon9_unresolved_chunk_ids": "WITH c AS (SELECT CASE WHEN doc_id % 100 = 1 THEN NULL WHEN doc_id % 50 = 2 THEN doc_id + 1 ELSE doc_id END AS chunk_id FROM documents) SELECT DISTINCT vec_id * 3 AS chunk_id, 'unresolved' AS reason FROM embeddings WHERE vec_id * 3 NOT IN (SELECT chunk_id FROM c WHERE chunk_id IS NOT NULL) UNION ALL SELECT chunk_id, CASE WHEN chunk_id IS NULL THEN 'null' ELSE 'repeated' END FROM c GROUP BY 1 HAVING chunk_id IS NULL OR count(*) > 1",
    "set4_id_set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "agg39_latency_stats": "SELECT event_type, count(*) AS n, round(avg(ms), 6) AS mean, median(ms) AS median, quantile_cont(ms, 0.95) AS p95 FROM (SELECT event_type, CAST(event_id % 977 AS DOUBLE) AS ms FROM events) GROUP BY 1",
    "flt12_validate_candidates": _CAND + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM v GROUP BY 1",
    "flt12_mix": _CAND + "SELECT t AS question_type, CAST(4 AS BIGINT) AS expected, count(v.question_id) AS found FROM (SELECT unnest(['type0', 'type1', 'type2']) AS t) LEFT JOIN v ON question_type = t AND reason IS NULL GROUP BY 1",
    "scl33_model_family": "SELECT DISTINCT 'Org/' || upper(lang) || doc_id % 3 AS judge, lang || doc_id % 4 AS generator, CASE WHEN doc_id % 3 = doc_id % 4 THEN 'error' ELSE 'warning' END AS verdict FROM documents",
    "ret1_bm25_index": f"WITH {BM25_CTES} SELECT token, df, round(idf, 6) AS idf FROM bi",
    "ret1_bm25_postings": f"WITH {BM25_CTES} SELECT token, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS chunks, max(tf) AS most FROM bt GROUP BY 1",
    "ret2_bm25_search": f"WITH {BM25_CTES} SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM bm",
    "udf3_embed": EMBED_SQL,
    "top1_top_k_per_query": f"WITH {BM25_CTES} SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM bm WHERE rank <= 5",
    "ret3_normalize_index": "SELECT vec_id AS chunk_id, round(CAST(CAST(embedding[1] * 3 / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * 9) AS FLOAT) AS DOUBLE), 5) AS x0, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings",
    "scl32_l2_normalize": "SELECT vec_id, round(CAST(embedding[2] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS u1 FROM embeddings",
    "ret4_dense_search": f"WITH {DENSE_CTES} SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM de",
    "ret5_rrf_fuse": f"WITH {LISTS_SQL} SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM fr",
    "set3_union_ranked": _R + "SELECT 'x' AS system, 0 AS list, count(*) AS n, max(rank) AS deepest FROM ranked WHERE system = 'bm25' UNION ALL SELECT 'y', 1, count(*), max(rank) FROM ranked WHERE system = 'dense'",
    "ret6_rerank": f"WITH {LISTS_SQL}, {rerank_ctes('bm')} SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM rr WHERE rank <= 5",
    "win7_rank_within_query": _R + "SELECT question_id, system, rank, chunk_id FROM ranked WHERE rank <= 10",
    "ret7_retrieve_all": f"WITH {LISTS_SQL}, {rerank_ctes('fr')} SELECT question_id, 'bm25' AS system, rank, chunk_id, round(score, 6) AS score FROM bm UNION ALL SELECT question_id, 'dense', rank, chunk_id, round(score, 6) FROM dq UNION ALL SELECT question_id, 'hybrid_rrf', rank, chunk_id, round(score, 6) FROM fr UNION ALL SELECT question_id, 'hybrid_rerank', rank, chunk_id, round(score, 6) FROM rr",
    "ret7_retrieval_records": _R + ", q AS (SELECT item_id AS question_id FROM benchmark UNION ALL SELECT unnest([-2, -1])), l AS (SELECT question_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) FILTER (system = 'bm25') AS bm25, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) FILTER (system = 'hybrid_rrf') AS hybrid, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) FILTER (system = 'hybrid_rrf' AND rank <= 5) AS context FROM ranked GROUP BY 1) SELECT question_id, CASE WHEN bm25 IS NULL THEN 'error' ELSE 'ok' END AS status, bm25, hybrid, context FROM q LEFT JOIN l USING (question_id)",
    "jon5_attach_chunk_meta": _R + "SELECT r.question_id, r.system, r.chunk_id * 2 AS chunk_id, source AS court, lang FROM ranked r LEFT JOIN documents ON doc_id = r.chunk_id * 2 WHERE rank <= 3",
    "top2_context_rows": _R + "SELECT question_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM ranked WHERE system = 'bm25' AND rank <= 5 GROUP BY 1",
    "scl31_query_instruction": "SELECT item_id, CASE WHEN starts_with(text, 'Th') THEN text ELSE 'Th' || text END AS q FROM benchmark",
    "scl21_extract_citations": f"WITH {ANS_SQL} SELECT item_id, array_to_string({_ORDERED}, ',') AS cited FROM ans",
    "scl22_citations_in_context": f"WITH {ANS_SQL}, x AS (SELECT item_id, {_CITES} AS c FROM ans) SELECT item_id, CASE WHEN len(c) > 0 THEN list_has_all(['c0', 'c1', 'c2', 'c3'], c) END AS inside FROM x",
    "scl23_build_prompt": _R + f", {_CTX_SQL} SELECT question_id, sha1('### Retrieved Judgment Context Passages:' || chr(10) || body || chr(10) || chr(10) || '### Legal Inquiry:' || chr(10) || text || chr(10) || chr(10) || '### Instructions:' || chr(10) || 'Provide a precise, evidence-grounded answer based strictly on the context above, citing each supporting passage with [Chunk ID: ...].') AS h FROM ctx JOIN benchmark ON item_id = question_id",
    "scl24_build_judge_prompt": _R + f", {_CTX_SQL} SELECT question_id, sha1('### QUESTION' || chr(10) || text || chr(10) || chr(10) || '### CONTEXT' || chr(10) || CASE WHEN question_id % 4 > 0 THEN body ELSE '(no passages were provided)' END || chr(10) || chr(10) || CASE WHEN question_id % 3 = 0 THEN '### REFERENCE EVIDENCE (from the source judgment, for relevance only)' || chr(10) || 'Seen.' || chr(10) || chr(10) ELSE '' END || '### ANSWER' || chr(10) || 'An answer.' || chr(10) || chr(10) || 'Return only the JSON object.') AS h FROM ctx JOIN benchmark ON item_id = question_id",
    "scl25_parse_judge_reply": "SELECT doc_id, CASE WHEN doc_id % 5 < 4 AND doc_id % 7 > 0 THEN 'ok' ELSE 'parse_error' END AS status, CASE WHEN doc_id % 5 < 4 AND doc_id % 7 > 0 THEN CAST(1 + doc_id % 5 AS INTEGER) END AS answer_relevance, CASE WHEN doc_id % 5 < 4 AND doc_id % 7 > 0 THEN 3 END AS citation_correctness, CASE WHEN doc_id % 5 < 4 AND doc_id % 7 > 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END AS unsupported_claim_rate, CASE WHEN doc_id % 5 < 4 AND doc_id % 7 > 0 THEN doc_id % 2 = 0 END AS hallucination FROM documents",
    "scl26_is_refusal": f"WITH {ANS_SQL} SELECT item_id, contains(lower(answer), 'does not contain sufficient information') AND len({_CITES}) = 0 AS refused FROM ans",
    "scl27_metric_values": _V + "SELECT question_id, system, level, metric, round(value, 6) AS value FROM vals",
    "scl28_classify_failure": _G + f"SELECT item_id, {_LABEL} AS label FROM gen",
    "scl29_label_failure": _G + f"SELECT item_id, {_LABEL2} AS failure_label FROM gen",
    "scl30_classify_failure_published": _G + "SELECT item_id, CASE WHEN d % 29 = 0 THEN 'generation_or_api_error' WHEN NOT hit THEN 'retrieval_failure' WHEN hallucination AND citation_correctness <= 2 THEN 'context_selection_or_citation_failure' WHEN hallucination THEN 'generation_grounding_failure' WHEN answer_relevance <= 2 THEN 'low_answer_relevance' ELSE 'no_major_failure' END AS label FROM gen",
    "jon10_hit_semi": _R + "SELECT DISTINCT question_id, system FROM ranked JOIN items USING (question_id, cnr) WHERE rank <= 10",
    "set5_gold_intersect": _R + "SELECT DISTINCT question_id, cnr AS gold FROM ranked JOIN items USING (question_id, cnr) WHERE rank <= 10",
    "jon15_judge_human_pairs": _G + "SELECT item_id, 'answer_relevance' AS field, CAST(answer_relevance AS DOUBLE) AS judge, CAST(human_relevance AS DOUBLE) AS human FROM gen WHERE human_relevance IS NOT NULL",
    "jon17_citation_context": _R + f", {_CITED} SELECT * FROM kinds",
    "jon18_evaluation_records": _R + "SELECT question_id, cnr, reference FROM items JOIN (SELECT source AS cnr, min(doc_id) AS reference FROM documents GROUP BY 1) USING (cnr)",
    "jon19_grounded_citations": _R + f", {_CITED} SELECT x.question_id, string_agg(x.chunk_id || ':' || source, ',' ORDER BY place) AS cited FROM (SELECT question_id, unnest(cited) AS chunk_id, generate_subscripts(cited, 1) AS place FROM answers) x JOIN ranked r ON r.question_id = x.question_id AND r.chunk_id = x.chunk_id AND r.system = 'bm25' AND r.rank <= 5 JOIN documents ON doc_id = x.chunk_id GROUP BY 1",
    "agg27_retrieval_scores": _V + "SELECT level, system, metric, round(avg(value), 6) AS mean, count(*) AS n FROM vals GROUP BY 1, 2, 3",
    "agg28_recall_breakdown": _V + ", k AS (SELECT question_id, 'question_type' AS field, question_type AS bucket FROM items UNION ALL SELECT question_id, 'bench', bench FROM items WHERE bench <> '') SELECT field, bucket, system, round(avg(value), 6) AS recall, count(*) AS n FROM vals JOIN k USING (question_id) WHERE metric = 'recall@10' GROUP BY 1, 2, 3",
    "agg29_generation_means": _G + f"SELECT count(*) AS n, {_MEANS}, round(avg(CAST(hallucination AS DOUBLE)), 6) AS hallucination_rate FROM gen WHERE generation_ok",
    "agg30_score_distribution": _G + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS score, count(*) AS n FROM gen GROUP BY 2" for c in M.SCORES[:4]),
    "agg31_scores_by_type": _G + f"SELECT question_type, count(*) AS n, {_MEANS} FROM gen GROUP BY 1",
    "agg32_crosstab": _G + "SELECT question_type, count(*) FILTER (NOT hallucination) AS false, count(*) FILTER (hallucination) AS true FROM gen GROUP BY 1",
    "agg33_citation_consistency": _R + f", {_CITED}, p AS (SELECT question_id, max(CAST(kind = 'correct_judgment' AS INTEGER)) AS c, max(CAST(kind = 'wrong_judgment' AS INTEGER)) AS w, max(CAST(kind = 'not_retrieved' AS INTEGER)) AS n FROM kinds GROUP BY 1) SELECT 'k' || a.question_id % 3 AS kind_of, count(*) AS answers, count(c) AS with_citation, CAST(sum(c) AS BIGINT) AS correct_judgment, CAST(sum(w) AS BIGINT) AS wrong_judgment, CAST(sum(n) AS BIGINT) AS not_retrieved FROM answers a LEFT JOIN p USING (question_id) GROUP BY 1",
    "agg34_context_presence": _R + ", x AS (SELECT i.question_id, i.question_type, i.hallucination, count(r.cnr) FILTER (r.cnr = i.cnr) AS right_chunks FROM items i LEFT JOIN ranked r ON r.question_id = i.question_id AND system = 'bm25' AND rank <= 5 GROUP BY 1, 2, 3) SELECT question_type, right_chunks, count(*) AS questions, round(avg(CAST(hallucination AS DOUBLE)), 6) AS mean_hallucination FROM x GROUP BY 1, 2",
    "agg35_failure_table": _G + f", c AS (SELECT {_LABEL2} AS label, count(*) AS k FROM gen GROUP BY 1), t AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in A.LABELS) + f"]) AS label), u AS (SELECT t.label, coalesce(k, 0) AS k, (SELECT count(*) FROM gen) AS n FROM t LEFT JOIN c USING (label)) SELECT label, k AS n, n AS base, {sql_wilson('k', 'n')} FROM u",
    "agg36_generation_counts": _G + "SELECT count(*) AS total, count(*) FILTER (NOT generation_ok) AS generation_errors, count(*) FILTER (generation_ok AND refused) AS refused, count(*) FILTER (generation_ok AND NOT refused) AS answered, count(*) FILTER (generation_ok AND NOT refused AND judge_status = 'ok') AS judged, count(*) FILTER (generation_ok AND NOT refused AND judge_status <> 'ok') AS judge_errors, count(*) FILTER (NOT generation_ok) > 0.05 * count(*) AS warn_errors, count(*) FILTER (generation_ok AND NOT refused AND judge_status = 'ok') < 30 AS warn_few_judged FROM gen",
    "flt11_generation_pools": _G + "SELECT item_id, NOT generation_ok AS is_generation_error, generation_ok AS in_scored_pool, generation_ok AND refused AS is_refused, generation_ok AND NOT refused AS is_answered, generation_ok AND NOT refused AND judge_status = 'ok' AS is_judged, generation_ok AND NOT refused AND judge_status <> 'ok' AS is_judge_error FROM gen",
    "agg37_percent_agreement": _G + "SELECT round(avg(CAST(quality = 1 - toxic AS DOUBLE)), 6) AS agreement FROM gen",
    "agg40_token_cost": "SELECT count(*) AS calls, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens_in, count(*) * 300 AS tokens_out, round(sum(ceil(length(text) / 4)) / 1e6 * 0.5 + count(*) * 300 / 1e6 * 1.5, 6) AS usd FROM documents",
    "agg41_scoreboard": _V + ", b AS (SELECT system, avg(value) FILTER (metric = 'recall@1') AS r1, avg(value) FILTER (metric = 'recall@10') AS r10, avg(value) FILTER (metric = 'mrr@10') AS mrr FROM vals GROUP BY 1) SELECT system, round(r1, 6) AS r1, round(r10, 6) AS r10, round(mrr, 6) AS mrr, round(r10 - (SELECT r10 FROM b WHERE system = 'hybrid_rrf'), 6) AS delta FROM b",
    "top6_label_sheet": _G + "SELECT item_id, question_type AS question, bench AS answer, CAST(NULL AS INTEGER) AS answer_relevance, CAST(NULL AS BOOLEAN) AS hallucination, '' AS notes FROM gen WHERE generation_ok AND NOT refused ORDER BY md5('7|' || item_id), item_id LIMIT 30",
    "sta1_wilson": _G + f"SELECT cluster, k, n, {sql_wilson('k', 'n')} FROM (SELECT cluster, count(*) FILTER (hallucination) AS k, count(*) AS n FROM gen GROUP BY 1)",
    "sta4_paired_differences": _PAIRED + "SELECT level, system, metric, round(avg(va - vb), 6) AS difference, count(*) AS n FROM pd GROUP BY 1, 2, 3",
    "sta5_mcnemar_counts": _PAIRED + "SELECT level, system, metric, count(*) FILTER (va > 0 AND vb = 0) AS a_only, count(*) FILTER (vb > 0 AND va = 0) AS b_only FROM pd GROUP BY 1, 2, 3",
    "sta5_mcnemar_exact": _PAIRED + ", c AS (SELECT level, system, metric, count(*) FILTER (va > 0 AND vb = 0) AS a_only, count(*) FILTER (vb > 0 AND va = 0) AS b_only FROM pd GROUP BY 1, 2, 3) SELECT level, system, metric, a_only, b_only, round(1e-9 + least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))), 6) AS p_value FROM c",
    "sta2_estimates": _V + "SELECT level, system, metric, round(avg(value), 6) AS estimate, count(*) AS n, 'bootstrap' AS method FROM vals GROUP BY 1, 2, 3",
    "sta3_wilson_intervals": _V + f"SELECT level, system, metric, n, {sql_wilson('k', 'n')} FROM (SELECT level, system, metric, sum(value) AS k, count(*) AS n, bool_and(value IN (0, 1)) AS whole FROM vals GROUP BY 1, 2, 3) WHERE whole",
    "sta6_cohens_kappa": _kappa_sql("none"),
    "sta6_quadratic_kappa": _kappa_sql("quadratic"),
    "sta9_generation_estimates": _LONG + "SELECT metric, round(avg(value), 6) AS estimate, count(*) AS n FROM lg GROUP BY 1",
    "sta10_judge_agreement": _AGREE + "SELECT field, o.n AS n, round(same, 6) AS agreement, round(CASE WHEN c0 > 0 THEN 1 - d0 / (c0 / (o.n * o.n)) END, 6) AS kappa, round(CASE WHEN field <> 'hallucination' AND c2 > 0 THEN 1 - d2 / (c2 / (o.n * o.n)) END, 6) AS kappa_quadratic FROM o JOIN c USING (field)",
    "sta11_estimates": _USABLE + "SELECT level, system, metric, round(avg(value), 6) AS estimate, count(*) AS n, count(DISTINCT cnr) AS clusters FROM uv GROUP BY 1, 2, 3",
    "sta11_counts": "SELECT CASE WHEN item_id % 13 = 5 THEN 'error' ELSE 'ok' END AS state, count(*) AS questions FROM benchmark GROUP BY 1",
    "sta11_breakdown": _USABLE + ", k AS (SELECT question_id, 'question_type' AS field, question_type AS bucket FROM items UNION ALL SELECT question_id, 'bench', bench FROM items WHERE bench <> '') SELECT field, bucket, system, round(avg(value), 6) AS estimate, count(*) AS n FROM uv JOIN k USING (question_id) WHERE metric = 'recall@5' GROUP BY 1, 2, 3",
    "sta11_comparisons": _USABLE + ", cp AS (SELECT a.level, a.system, a.metric, a.value AS va, b.value AS vb FROM uv a JOIN uv b USING (question_id, level, metric) WHERE a.system <> 'hybrid_rrf' AND b.system = 'hybrid_rrf') SELECT level, system, metric, round(avg(va - vb), 6) AS difference, count(*) AS n, CASE WHEN metric LIKE 'recall%' THEN count(*) FILTER (va > 0 AND vb = 0) END AS a_only, CASE WHEN metric LIKE 'recall%' THEN count(*) FILTER (vb > 0 AND va = 0) END AS b_only FROM cp GROUP BY 1, 2, 3",
    "win10_holm_adjust": "WITH x AS (SELECT n_nationkey, n_regionkey, CAST(n_nationkey * 7 % 25 + 1 AS DOUBLE) / 200 AS p FROM nation), y AS (SELECT *, (count(*) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p, n_nationkey) + 1) * p AS r FROM x) SELECT n_nationkey, n_regionkey, round(p, 6) AS p, round(least(1.0, max(r) OVER (PARTITION BY n_regionkey ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING)), 6) AS holm_p FROM y",
}
