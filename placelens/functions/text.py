"""Text repair, cleaning, features and tokens as built-in column expressions."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COMPLAINT_LEXICON, NO_COMPLAINT, STOPWORDS_FREQUENCY

# Blanks as Unicode defines them. Java's (?U)\s lacks the four ASCII separators.
_BLANK = r"\s\x1c-\x1f"
_BLANK_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_WORD = "a-záéíóúüñ"


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_blanks(value: Column | str) -> Column:
    """Trim every Unicode blank from both ends (plain ``trim`` only knows U+0020)."""
    return F.trim(column(value), F.lit(_BLANK_CHARS))


def fix_encoding(value: Column | str) -> Column:
    """Undo one layer of UTF-8 read as Latin-1; the whole string or nothing. Null becomes ''."""
    text = F.coalesce(column(value), F.lit(""))
    repaired = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return (
        F.when(F.octet_length(text) == F.char_length(text), text)  # ASCII: nothing to repair
        .when(text.rlike(r"[^\x00-\xFF]"), text)  # not a Latin-1 string
        .otherwise(F.coalesce(repaired, text))
    )


def clean_review(value: Column | str) -> Column:
    """Repair, drop a trailing '...Más', turn control characters into spaces, trim."""
    text = fix_encoding(value)
    text = F.regexp_replace(text, rf"(?U)\.{{3}}[{_BLANK}]*[Mm][áa]s[{_BLANK}]*$", "")
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " ")
    return strip_blanks(text)


def n_chars(value: Column | str) -> Column:
    return F.char_length(column(value))


def n_words(value: Column | str) -> Column:
    return F.regexp_count(column(value), F.lit(rf"(?U)[^{_BLANK}]+"))


def n_sentences(value: Column | str) -> Column:
    return F.regexp_count(column(value), F.lit(r"[.!?]+"))


def full_text(title: Column | str, review: Column | str) -> Column:
    return F.concat(column(title), F.lit(". "), column(review))


def words(value: Column | str, min_len: int) -> Column:
    """Maximal runs of at least ``min_len`` word letters of the lower-cased text.

    Same words as replacing every other character by a space, splitting and
    dropping the short ones, in one regex pass and without the short strings.
    """
    return F.regexp_extract_all(
        F.lower(column(value)), F.lit(f"([{_WORD}]{{{int(min_len)},}})"), F.lit(1)
    )


def tokenize(
    value: Column | str, min_len: int = 4, stopwords: Collection[str] = STOPWORDS_FREQUENCY
) -> Column:
    """Array of words without stop words, in text order."""
    found = words(value, min_len)
    if not stopwords:
        return found
    return F.filter(found, lambda word: ~word.isin(sorted(stopwords)))


def classify_complaint(
    value: Column | str,
    lexicon: Mapping[str, Sequence[str]] = COMPLAINT_LEXICON,
    default: str = NO_COMPLAINT,
) -> Column:
    """Category with most keywords occurring as substrings; ties go to the earlier one."""
    text = F.lower(column(value))
    scores = {
        category: sum(
            (F.contains(text, F.lit(keyword)).cast("int") for keyword in keywords), F.lit(0)
        )
        for category, keywords in lexicon.items()
    }
    # One array evaluated once: array_position finds the first category at the maximum.
    score_array = F.array(*scores.values())
    best = F.array_max(score_array)
    category = F.element_at(
        F.array(*map(F.lit, scores)), F.array_position(score_array, best).cast("int")
    )
    return F.when(best > 0, category).otherwise(F.lit(default))
