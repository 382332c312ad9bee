"""String rules as column expressions. Classes are written out so that all engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the rules.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
NARROW_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
SPACES = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACES}]"
NON_WORD = r"[^\p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(as_col(c), f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def control_count(c: Column | str) -> Column:
    return F.regexp_count(as_col(c), F.lit(CONTROL))


def is_corrupted(c: Column | str, threshold: float = 0.01) -> Column:
    """Control characters make up more than ``threshold`` of the text; null and empty count as corrupted."""
    c = as_col(c)
    share = control_count(c).cast("double") / F.greatest(F.char_length(c), F.lit(1))
    return F.coalesce((F.char_length(c) == 0) | (share > threshold), F.lit(True))


def clean_text(c: Column | str) -> Column:
    """Control characters to spaces, any white space (line ends too) to one space, trimmed; null to ''."""
    spaced = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), CONTROL, " ")
    return F.trim(F.regexp_replace(spaced, f"{SPACE}+", " "))


def normalize_keep_paragraphs(c: Column | str) -> Column:
    """Keeps line ends: drops control characters, collapses blanks, trims around line ends, at most two in a row."""
    out = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), NARROW_CONTROL, " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def control_stats(c: Column | str) -> Column:
    c = as_col(c)
    return F.struct(
        F.char_length(c).alias("length"),
        control_count(c).alias("control_count"),
        F.regexp_count(c, F.lit(r"\x{FFFD}")).alias("replacement_count"),
        F.regexp_count(c, F.lit(r"\n")).alias("newline_count"),
    )


def caesar_decode(c: Column | str, shift: int = 3) -> Column:
    """Letters A-Z and a-z moved back by ``shift``; everything else stays."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    k = shift % 26
    return F.translate(as_col(c), upper + lower, upper[-k:] + upper[:-k] + lower[-k:] + lower[:-k])


def fingerprint(c: Column | str, mode: str = "prefix", prefix_chars: int = 2000) -> Column:
    """sha1 of the text without non-word characters, in lower case: its first characters, or all of it."""
    bare = F.lower(F.regexp_replace(as_col(c), NON_WORD, ""))
    if mode not in ("prefix", "exact"):
        raise ValueError(f"unknown fingerprint mode {mode!r}")
    return F.sha1(F.substring(bare, 1, prefix_chars) if mode == "prefix" else bare)


def snippet(c: Column | str, n: int = 400) -> Column:
    """The first ``n`` characters with white space collapsed."""
    return F.trim(F.regexp_replace(F.substring(F.coalesce(as_col(c), F.lit("")), 1, n), f"{SPACE}+", " "))


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(as_col(c), f"{SPACE}+"), lambda w: w != "")


def tokenize(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(f"({WORD}+)"), F.lit(1))


def tokenize_references(c: Column | str) -> Column:
    """Lower-cased ASCII tokens that keep joined references such as 12/2015 or a.b whole."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"([a-z0-9]+(?:[-_/().][a-z0-9]+)*)"), F.lit(1))


def tokenize_spaces(c: Column | str) -> Column:
    return words(F.lower(as_col(c)))


def normalize_match(c: Column | str, punctuation: bool = True) -> Column:
    """Lower case, punctuation to spaces (unless kept), white space collapsed, trimmed."""
    out = F.lower(F.coalesce(as_col(c), F.lit("")))
    if punctuation:
        out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{SPACES}]", " ")
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " "))


# The two patterns, tried in this order.
COURT_PATTERNS = [r"IN THE (?:HIGH COURT|HIGH COURT OF) ([A-Z][A-Z ]+)", r"IN THE HIGH COURT OF ([A-Z][A-Z ]+)"]


def extract_court(c: Column | str) -> Column:
    """The court named in the first 1,500 characters, else UNKNOWN."""
    head = F.substring(F.coalesce(as_col(c), F.lit("")), 1, 1500)
    found = [F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit("")) for p in COURT_PATTERNS]
    return F.coalesce(*found, F.lit("UNKNOWN"))


# Limits above which a text counts as badly scanned.
OCR_LIMITS = {
    "non_ascii_share": 0.05,
    "replacement_chars": 5,
    "spaced_letter_share": 0.02,
    "vowelless_share": 0.05,
    "symbol_share": 0.15,
}
SPACED_LETTERS = r"(?<![A-Za-z0-9(])(?:[A-Za-z] ){4,}[A-Za-z](?![A-Za-z0-9)])"
SYMBOL = rf"[^\p{{L}}\p{{N}}{SPACES}.,;:()\[\]{{}}'\"\-/&%?!_`’‘“”–—§]"


def ocr_metrics(c: Column | str) -> Column:
    """Shares that rise when a text came from a poor scan; all 0 for an empty text."""
    c = F.coalesce(as_col(c), F.lit(""))
    length = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    letter_words = F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1))
    vowelless = F.filter(
        letter_words,
        lambda w: (F.char_length(w) >= 5) & (w != F.upper(w)) & ~w.rlike("[aeiouyAEIOUY]"),
    )
    spaced = F.aggregate(
        F.regexp_extract_all(c, F.lit(f"({SPACED_LETTERS})"), F.lit(1)), F.lit(0), lambda n, x: n + F.char_length(x)
    )
    return F.struct(
        F.char_length(c).alias("chars"),
        (F.regexp_count(c, F.lit(r"[^\x00-\x7F]")) / length).alias("non_ascii_share"),
        F.regexp_count(c, F.lit(r"\x{FFFD}")).alias("replacement_chars"),
        (spaced / length).alias("spaced_letter_share"),
        (F.size(vowelless) / F.greatest(F.size(letter_words), F.lit(1)).cast("double")).alias("vowelless_share"),
        (F.regexp_count(c, F.lit(SYMBOL)) / length).alias("symbol_share"),
    )


def ocr_flags(metrics: Column | str, limits: dict[str, float] | None = None) -> Column:
    """Which limits are exceeded, and ``suspect`` if any is."""
    m, limits = as_col(metrics), limits or OCR_LIMITS
    over = {name: m[name] > limit for name, limit in limits.items()}
    any_ = None
    for x in over.values():
        any_ = x if any_ is None else any_ | x
    return F.struct(*[x.alias(name) for name, x in over.items()], any_.alias("suspect"))


def has_repeated_4gram(c: Column | str, head_chars: int = 3000, min_count: int = 3) -> Column:
    """Some phrase of four words occurs ``min_count`` times in the head. The last phrase is not formed (as the rule has it)."""
    head = words(F.substring(F.coalesce(as_col(c), F.lit("")), 1, head_chars))
    one = F.lit(1)

    def phrases(w: Column) -> Column:
        n = F.greatest(F.size(w) - 4, F.lit(0))
        return F.transform(F.slice(F.sequence(one, F.greatest(n, one)), one, n), lambda i: F.array_join(F.slice(w, i, F.lit(4)), " "))

    def repeats(ordered: Column) -> Column:
        n = F.greatest(F.size(ordered) - (min_count - 1), F.lit(0))
        at = F.slice(F.sequence(one, F.greatest(n, one)), one, n)
        return F.exists(at, lambda i: F.get(ordered, i - 1) == F.get(ordered, i + (min_count - 2)))

    # exists() over an array of one element binds its value, so it is computed once and not for each inner step.
    return F.exists(F.array(head), lambda w: F.exists(F.array(F.array_sort(phrases(w))), repeats))
