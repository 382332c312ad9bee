"""Citations, refusals, prompts, judge replies and failure labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import as_col

# Phrase of a refusal, pattern of a citation, labels.
REFUSAL = "does not contain sufficient information"
CITATION = r"(?i)\[Chunk ID:\s*([^\]|\s][^\]|]*?)\s*(?:\||\])"
LABELS = (
    "No Major Failure (Success)",
    "Retrieval Failure",
    "Generation Grounding Failure",
    "Low Answer Relevance",
    "Context Selection / Citation",
    "Refusal (evidence not retrieved)",
    "Wrongful Refusal (evidence retrieved)",
    "System Error (generation)",
    "System Error (judge)",
)
SCORES = ("answer_relevance", "faithfulness", "citation_correctness", "overall_score")


def extract_citations(c: Column | str) -> Column:
    """Cited ids, each once, in the order in which they first occur."""
    found = F.regexp_extract_all(F.coalesce(as_col(c), F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def citations_in_context(cited: Column | str, context: Column | str) -> Column:
    """Whether all cited ids are in the context; null if nothing is cited."""
    cited = as_col(cited)
    return F.when(F.size(cited) > 0, F.size(F.array_except(cited, as_col(context))) == 0)


def is_refusal(c: Column | str) -> Column:
    c = F.coalesce(as_col(c), F.lit(""))
    return F.lower(c).contains(REFUSAL) & (F.size(extract_citations(c)) == 0)


# The wording of context blocks and of both prompts, in the three functions below.
def format_context(chunk_id: Column, text: Column, court: Column, date: Column) -> Column:
    given = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("Unspecified"))
    return F.concat(
        F.lit("[Chunk ID: "), chunk_id, F.lit(" | Court: "), given(court), F.lit(" | Date: "), given(date), F.lit("]\n"), text
    )


def _joined(blocks: Column) -> Column:
    parts = F.transform(blocks, lambda b: format_context(b["chunk_id"], b["text"], b["court_code"], b["decision_date"]))
    return F.array_join(parts, "\n\n---\n\n")


def build_prompt(question: Column | str, blocks: Column | str) -> Column:
    """The prompt for an answer: context blocks (structs chunk_id, text, court_code, decision_date), then the question."""
    return F.concat(
        F.lit("### Retrieved Judgment Context Passages:\n"), _joined(as_col(blocks)),
        F.lit("\n\n### Legal Inquiry:\n"), as_col(question),
        F.lit(
            "\n\n### Instructions:\nProvide a precise, evidence-grounded answer based strictly on the context above, "
            "citing each supporting passage with [Chunk ID: ...]."
        ),
    )


def build_judge_prompt(question: Column | str, blocks: Column | str, answer: Column | str, reference: Column | str) -> Column:
    """The prompt for a judge; the reference part only where there is one."""
    passages = F.coalesce(F.nullif(_joined(as_col(blocks)), F.lit("")), F.lit("(no passages were provided)"))
    given = F.nullif(as_col(reference), F.lit(""))
    extra = F.coalesce(
        F.concat(F.lit("### REFERENCE EVIDENCE (from the source judgment, for relevance only)\n"), given, F.lit("\n\n")),
        F.lit(""),
    )
    return F.concat(
        F.lit("### QUESTION\n"), as_col(question), F.lit("\n\n### CONTEXT\n"), passages, F.lit("\n\n"), extra,
        F.lit("### ANSWER\n"), as_col(answer), F.lit("\n\nReturn only the JSON object."),
    )


def classify_failure(hit: Column, halluc: Column, faith: Column, relevance: Column, citation: Column) -> Column:
    """Missing scores count as 4, a missing hallucination flag as false."""
    four = lambda c: F.coalesce(c, F.lit(4))
    return (
        F.when(~hit, LABELS[1])
        .when(F.coalesce(halluc, F.lit(False)) | (four(faith) <= 2), LABELS[2])
        .when(four(relevance) <= 2, LABELS[3])
        .when(four(citation) <= 2, LABELS[4])
        .otherwise(LABELS[0])
    )


def label_failure(ok: Column, refused: Column, judged: Column, hit: Column, *scores: Column) -> Column:
    """System errors and refusals first, then the rule above (scores: hallucination, faithfulness, relevance, citation)."""
    return (
        F.when(~ok, LABELS[7])
        .when(refused & hit, LABELS[6])
        .when(refused, LABELS[5])
        .when(~judged, LABELS[8])
        .otherwise(classify_failure(hit, *scores))
    )


def classify_failure_published(answer: Column, present: Column, halluc: Column, citation: Column, relevance: Column) -> Column:
    """The rule of the published failure table; markers of model errors come first."""
    low = F.lower(answer)
    return (
        F.when(low.contains("no longer available") | low.contains("switch to"), "generation_or_api_error")
        .when(~present, "retrieval_failure")
        .when(halluc & (citation <= 2), "context_selection_or_citation_failure")
        .when(halluc, "generation_grounding_failure")
        .when(relevance <= 2, "low_answer_relevance")
        .otherwise("no_major_failure")
    )


def normalize_model(c: Column | str) -> Column:
    return F.element_at(F.split(F.lower(F.trim(F.coalesce(as_col(c), F.lit("")))), "/"), -1)


def model_family(c: Column | str) -> Column:
    """Leading letters of the model's name."""
    return F.regexp_extract(normalize_model(c), "^[a-z]+", 0)


def query_instruction(query: Column | str, instruction: str) -> Column:
    """The instruction once in front of the query; an empty one changes nothing."""
    q = as_col(query)
    return q if not instruction else F.when(q.startswith(instruction), q).otherwise(F.concat(F.lit(instruction), q))


def l2_normalize(c: Column | str) -> Column:
    """The vector with length one; a zero vector stays."""
    v = F.transform(as_col(c), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
