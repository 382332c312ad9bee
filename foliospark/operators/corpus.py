"""Corpus build: court filter, first record of a number, text and date rules, first fingerprint, accounting.

A record's place in the scan is an explicit order column. Each text is cleaned and judged once, where it is read; what
the rules need of it goes into a narrow table that is kept in the shared folder. Both duplicate rules work on that
table, and its verdicts meet the records once, by their place in the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import caseref, dates, textops
from ..sources.stages import staged

# Drop reasons in the order in which they are tried.
DROP_REASONS = (
    "court_not_selected",
    "missing_cnr",
    "duplicate_cnr",
    "empty_text",
    "corrupted_text",
    "no_valid_date",
    "near_duplicate",
)
KEPT = ("kept_search", "kept_lookup_only")
# The output columns, in order.
OUTPUT = (
    "cnr source_config court_code court_name bench bench_name bench_name_inferred title petitioner respondent judge "
    "judgment_date judgment_year date_source decision_date_raw cnr_date_raw decision_date_status cnr_date_status "
    "date_conflict year_conflict case_type case_type_source case_type_code case_type_name case_number case_year "
    "outcome raw_chars clean_chars repeat_chars_removed in_search_index text"
).split()


@dataclass(frozen=True)
class Build:
    """Settings of a build. ``courts`` gives the court code to keep for each source (absent: keep all)."""

    today: str
    min_chars: int = 5000
    date_rule: str = "prefer_decision"
    require_date: bool = False
    dedup: str = "prefix"
    clean_repeats: bool = False
    courts: tuple[tuple[str, str], ...] = (("high_courts", "27_1"),)
    court_names: tuple[tuple[str, str], ...] = (
        ("high_courts", "Bombay High Court"),
        ("supreme_court", "Supreme Court of India"),
    )
    supreme: tuple[str, ...] = ("supreme_court",)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Sources read in one pass: rows of earlier frames come first (``source_rank``)."""
    out = None
    for rank, frame in enumerate(frames):
        frame = frame.withColumn("source_rank", F.lit(rank))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


#: Keys with most rows that are dealt out over SALTS tasks each; rows without a key go over LOOSE.
HOT, SALTS, LOOSE = 1024, 64, 1 << 20


def first_of(df: DataFrame, key: str, order: list[str], flag: str, also: str | None = None) -> DataFrame:
    """Adds ``flag``: the row is the first of its key in the given order; null keys get no flag (null).

    Firsts are grouped minima, combined on the map side. Rows meet them by key and a salt, so neither a very common key
    nor the rows without one end up in one task.
    """
    place = F.struct(*order)
    value = F.struct(place.alias("place"), *([F.col(also).alias("also")] if also else []))
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
    firsts = firsts.agg(F.min(value).alias("__first"), F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(firsts.orderBy(F.desc("__n"), "__key").limit(HOT).select(F.col("__key").alias("__hot")))
    at = F.xxhash64(*order)
    salt = F.when(F.col(key).isNull(), F.pmod(at, F.lit(LOOSE))).when(F.col("__hot").isNotNull(), F.pmod(at, F.lit(SALTS))).otherwise(0)
    rows = df.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    salts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = firsts.join(hot, F.col("__key") == F.col("__hot"), "left").select("__key", "__first", F.explode(salts).alias("__salt2"))
    met = (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__salt2"))
    out = rows.join(firsts, met, "left").withColumn(flag, place == F.col("__first.place"))
    if also:
        out = out.withColumn(f"{flag}_of", F.col("__first.also"))
    return out.drop("__key", "__first", "__salt", "__salt2")


def selected(build: Build) -> Column:
    """Whether the court of a record is wanted: the given code where its source has one, else always."""
    wanted = F.lit(True)
    for source, code in build.courts:
        wanted = F.when(F.col("source_config") == source, F.coalesce(F.col("court_code") == code, F.lit(False))).otherwise(wanted)
    return wanted


def with_text(records: DataFrame, build: Build) -> DataFrame:
    """Adds the cleaned ``text`` and ``repeat_chars_removed``."""
    rows = records.withColumns({"text": textops.clean_text("full_text"), "repeat_chars_removed": F.lit(0).cast("long")})
    if build.clean_repeats:
        from ..functions.udfs import collapse_repeats

        rows = collapse_repeats(rows, "text", "repeat_chars_removed")
    return rows


def text_facts(records: DataFrame, build: Build, order: list[str]) -> DataFrame:
    """What the rules need of each record, without its text: place, number, court, text flags, dates and fingerprint."""
    long_enough = F.char_length("text") >= build.min_chars
    usable = F.col("__has_text") & ~F.col("__bad") & F.col("in_search_index")
    print_ = F.when(usable, textops.fingerprint("text", build.dedup)) if build.dedup != "off" else F.lit(None).cast("string")
    wanted = selected(build)
    rows = with_text(records.select(*order, wanted.alias("__selected"), textops.blank_to_null("cnr").alias("cnr"), "decision_date", "full_text"), build)
    rows = rows.select(
        *order, "__selected", "cnr", F.when(F.col("__selected"), F.col("cnr")).alias("__cnr"), "text",
        F.coalesce(F.col("full_text").rlike(f"[^{textops.SPACES}]"), F.lit(False)).alias("__has_text"),
        textops.is_corrupted("full_text").alias("__bad"), long_enough.alias("in_search_index"),
        dates.resolve_date("decision_date", "cnr", build.today, build.date_rule).alias("__date"),
    )
    return rows.select(*[c for c in rows.columns if c != "text"], print_.alias("__print"))


def label_records(records: DataFrame, build: Build, order: tuple[str, ...] = ("d",)) -> DataFrame:
    """Every record with ``outcome_label`` (a drop reason or where it is kept), its fields, and ``duplicate_of``.

    ``order`` tells a record's place in the scan and must be its own.
    """
    order = list(order)
    facts = staged(text_facts(records, build, order))
    rows = first_of(facts, "__cnr", order, "__first_cnr")
    alive = F.coalesce(F.col("__first_cnr") & F.col("__has_text") & ~F.col("__bad"), F.lit(False))
    undated = alive & F.col("in_search_index") & F.col("__date.judgment_date").isNull() if build.require_date else F.lit(False)
    rows = rows.withColumns({"__alive": alive, "__undated": undated})
    rows = rows.withColumn("__print", F.when(F.col("__alive") & ~F.col("__undated"), F.col("__print")))
    rows = first_of(rows, "__print", order, "__first_print", also="cnr")
    outcome = (
        F.when(~F.col("__selected"), "court_not_selected")
        .when(F.col("cnr").isNull(), "missing_cnr")
        .when(~F.col("__first_cnr"), "duplicate_cnr")
        .when(~F.col("__has_text"), "empty_text")
        .when(F.col("__bad"), "corrupted_text")
        .when(F.col("__undated"), "no_valid_date")
        .when(~F.col("__first_print"), "near_duplicate")
        .when(F.col("in_search_index"), "kept_search")
        .otherwise("kept_lookup_only")
    )
    rows = rows.withColumn("outcome_label", outcome)
    near = F.when(F.col("outcome_label") == "near_duplicate", F.col("__first_print_of"))
    places = [F.col(c).alias(f"__at{k}") for k, c in enumerate(order)]
    verdicts = rows.select(*places, "in_search_index", "__date", "outcome_label", near.alias("duplicate_of"))
    same = F.lit(True)
    for k, c in enumerate(order):
        same = F.col(c).eqNullSafe(F.col(f"__at{k}")) if k == 0 else same & F.col(c).eqNullSafe(F.col(f"__at{k}"))
    met = records.drop("in_search_index", "outcome_label", "duplicate_of", "text", "repeat_chars_removed").join(verdicts, same)
    met = met.drop(*[f"__at{k}" for k in range(len(order))])
    return with_text(met.withColumn("cnr", textops.blank_to_null("cnr")), build)


def build_rows(labelled: DataFrame, build: Build) -> DataFrame:
    """The output fields of kept records, and what the statistics of a build need."""
    supreme = F.col("source_config").isin(*build.supreme)
    names = F.create_map(*[F.lit(x) for pair in build.court_names for x in pair])
    kept = labelled.where(F.col("outcome_label").isin(*KEPT)).withColumns(
        {"is_supreme": supreme, "bench": textops.blank_to_null("bench"), "title": textops.blank_to_null("title")}
    )
    kept = caseref.with_bench_names(kept)
    kept = kept.withColumn("__ref", caseref.parse_case_reference("title"))
    given = textops.blank_to_null("case_type")
    kept = kept.withColumns(
        {
            "court_code": F.coalesce(textops.blank_to_null("court_code"), F.when(supreme, "SC")),
            "court_name": F.element_at(names, F.col("source_config")),
            "petitioner": textops.blank_to_null("petitioner"),
            "respondent": textops.blank_to_null("respondent"),
            "judge": textops.blank_to_null("judge"),
            "judgment_date": F.col("__date.judgment_date"),
            "judgment_year": dates.judgment_year("__date.judgment_date", "year"),
            "date_source": F.col("__date.date_source"),
            "decision_date_raw": textops.blank_to_null("decision_date"),
            "cnr_date_raw": dates.cnr_date_text("cnr"),
            "decision_date_status": F.col("__date.decision_date_status"),
            "cnr_date_status": F.col("__date.cnr_date_status"),
            "date_conflict": F.col("__date.date_conflict"),
            "year_conflict": F.col("__date.year_conflict"),
            "case_type_code": F.col("__ref.code"),
            "case_number": F.col("__ref.number"),
            "case_year": F.col("__ref.year"),
            "case_type_name": caseref.case_type_name("__ref.code", supreme),
            "outcome": textops.blank_to_null("disposal_nature_normalized"),
            "raw_chars": F.char_length("full_text").cast("long"),
            "clean_chars": F.char_length("text").cast("long"),
        }
    )
    return kept.withColumns(
        {
            "case_type": F.coalesce(given, F.col("case_type_code")),
            "case_type_source": F.when(given.isNotNull(), "dataset")
            .when(F.col("case_type_code").isNotNull(), "title")
            .otherwise("none"),
        }
    )


def build_corpus(records: DataFrame, build: Build, order: tuple[str, ...] = ("d",)) -> tuple[DataFrame, DataFrame]:
    """Kept rows with the fixed output columns, and the links from removed near duplicates to kept records."""
    labelled = label_records(records, build, order)
    return build_rows(labelled, build).select(*OUTPUT), duplicate_links(labelled)


def duplicate_links(labelled: DataFrame) -> DataFrame:
    """From each removed near duplicate to the record that was kept."""
    near = labelled.where(F.col("duplicate_of").isNotNull())
    return near.select(F.col("cnr").alias("duplicate_cnr"), F.col("duplicate_of").alias("kept_cnr"), "source_config")


def resolve_cnr(ids: DataFrame, links: DataFrame, cnr: str = "cnr") -> DataFrame:
    """Adds ``resolved_cnr``: a removed number becomes the one that was kept for it."""
    known = links.select(F.col("duplicate_cnr").alias("__dup"), F.col("kept_cnr").alias("__kept")).distinct()
    out = ids.join(known, F.col(cnr) == F.col("__dup"), "left")
    return out.withColumn("resolved_cnr", F.coalesce("__kept", cnr)).drop("__dup", "__kept")


def outcome_counts(labelled: DataFrame) -> DataFrame:
    """Rows by source and outcome, and over all sources ('all'); every outcome listed, zero where none."""
    spark = labelled.sparkSession
    outcomes = spark.sql("SELECT explode(array(" + ", ".join(f"'{x}'" for x in (*DROP_REASONS, *KEPT)) + ")) AS outcome")
    counted = labelled.groupBy("source_config", F.col("outcome_label").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    both = counted.unionByName(counted.groupBy("outcome").agg(F.sum("n").alias("n")).withColumn("source_config", F.lit("all")))
    sources = both.select("source_config").distinct()
    every = sources.join(F.broadcast(outcomes))
    return (
        every.join(both, ["source_config", "outcome"], "left")
        .groupBy("source_config", "outcome")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )


def identity_check(labelled: DataFrame) -> DataFrame:
    """scanned = dropped + kept, by source."""
    kept = F.col("outcome_label").isin(*KEPT)
    return labelled.groupBy("source_config").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(~kept).alias("dropped"), F.count_if(kept).alias("kept")
    )


def kept_date_stats(rows: DataFrame) -> DataFrame:
    """Kept rows by date status and source, as (measure, value, n)."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), v.alias("value"))
            for m, v in (
                ("decision_date_status", F.col("decision_date_status")),
                ("cnr_date_status", F.col("cnr_date_status")),
                ("date_source", F.coalesce("date_source", F.lit("none"))),
                ("date_conflict", F.col("date_conflict").cast("string")),
                ("year_conflict", F.col("year_conflict").cast("string")),
            )
        ]
    )
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.measure", "p.value").agg(F.count(F.lit(1)).alias("n"))


def kept_meta_stats(rows: DataFrame) -> DataFrame:
    """Kept rows by unknown bench, bench and prefix mismatch, and where the case type came from."""
    pairs = F.array(
        F.struct(
            F.lit("unknown_bench").alias("measure"),
            F.when(~F.col("bench_known") & ~F.col("is_supreme"), F.coalesce("bench", F.lit("(blank)"))).alias("value"),
        ),
        F.struct(
            F.lit("bench_prefix_mismatch").alias("measure"),
            F.when(F.col("bench_prefix_mismatch"), F.lit("true")).alias("value"),
        ),
        F.struct(F.lit("case_type_source").alias("measure"), F.col("case_type_source").alias("value")),
    )
    out = rows.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL")
    return out.groupBy("p.measure", "p.value").agg(F.count(F.lit(1)).alias("n"))


def unmapped_codes(rows: DataFrame, top: int = 25) -> DataFrame:
    """The most common codes without a readable name; the supreme court's are left out."""
    missing = rows.where("NOT is_supreme AND case_type_code IS NOT NULL AND case_type_name IS NULL")
    code = F.regexp_replace("case_type_code", r"\(.*\)$", "").alias("code")
    return missing.groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(top)


def build_rates(labelled: DataFrame) -> DataFrame:
    """Near duplicates among search-length rows, and date conflicts among kept ones; null over nothing."""
    kept = F.col("outcome_label").isin(*KEPT)
    near = F.count_if(F.col("outcome_label") == "near_duplicate")
    return labelled.agg(
        F.try_divide(near, near + F.count_if(F.col("outcome_label") == "kept_search")).alias("near_duplicate_rate"),
        F.try_divide(F.count_if(kept & F.col("__date.date_conflict")), F.count_if(kept)).alias("date_conflict_rate"),
    )


def repeat_clean_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("repeat_chars_removed") > 0).alias("records"),
        F.coalesce(F.sum("repeat_chars_removed"), F.lit(0)).alias("chars"),
    )
