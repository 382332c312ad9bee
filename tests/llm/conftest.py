import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_schema():
    return DOCS


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows and ids, clashing extra columns."""
    long_text = "\n".join(" ".join(f"w{(i * j) % 9973}" for j in range(60)) for i in range(1, 400))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, None, "en", None, None),
        (4, "", None, "", 0),
        (5, "   \n\n ", "de", "b", 3),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (6, long_text, "en", "a", len(long_text)),
        (7, long_text, "en", "a", len(long_text)),
        (8, base + " phi", "en", "b", 1),
        (9, "ééé ça où <|endoftext|> ß", "fr", "b", 1),
        (9, "another text under the same id", "en", "b", 1),
        (10, "!!! 123 ---", "en", "c", 1),
        (11, "one two", "en", "c", 1),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("score", "kept", "keep_id", "Digest", "no", "rank", "bucket", "lang_pred", "rejected", "labels", "mix_slot", "group", "chunks", "__key", "__before", "__bucket", "h", "salt", "marks", "t", "row", "hash", "bucket_", "quota"):
        frame = frame.withColumn(name, frame["n_chars"])
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
