"""Column functions over message text. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions.prefilter import fold, may_match, required_words

# Unicode classes and case folding; only "\n" ends a line.
IGNORE_CASE = "(?iUd)"
MATCH_CASE = "(?Ud)"
WORD = r"[\p{L}\p{N}_]"


def has(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """True where the pattern is found anywhere in the text, ignoring case.

    The regular expression only runs on texts that contain a word it requires. Pass `folded`, a column of
    prefilter.fold(text), where many patterns are tried on one text.
    """
    found = text.rlike(IGNORE_CASE + pattern)
    possible = may_match(fold(text) if folded is None else folded, pattern)
    return found if possible is None else possible & found


def literal(value: str) -> str:
    """A string as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: list[str]) -> str:
    return "array(" + ", ".join(literal(v) for v in values) + ")"


def has_sql(text: str, pattern: str, folded: str) -> str:
    """`has` as SQL text over column names, for packs of many patterns."""
    found = f"{text} RLIKE {literal(IGNORE_CASE + pattern)}"
    words = required_words(pattern)
    possible = " OR ".join(f"contains({folded}, {literal(w)})" for w in words)
    return f"(({possible}) AND {found})" if words else f"({found})"


def which_sql(text: str, patterns: list[str], folded: str) -> str:
    """SQL text for the array of positions of the patterns that match."""
    cases = ", ".join(f"CASE WHEN {has_sql(text, p, folded)} THEN {i} END" for i, p in enumerate(patterns))
    return f"array_compact(array({cases}))"


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Collapse white space runs to one blank and strip."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_message(text: Column) -> Column:
    """Message text without handles and with single blanks; null becomes ''."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)@[\w_]+", ""))


def pii_pattern(kind: str) -> str:
    for pattern, ignore_case, placeholder in fx.PII_RULES:
        if placeholder == kind:
            return (IGNORE_CASE if ignore_case else MATCH_CASE) + pattern
    raise KeyError(kind)


def redact(text: Column, mask_pii: bool = True, normalize_space: bool = True) -> Column:
    """Replace personal data by placeholders, in the fixed rule order."""
    out = F.coalesce(text, F.lit(""))
    if mask_pii:
        for _, _, placeholder in fx.PII_RULES:
            out = F.regexp_replace(out, pii_pattern(placeholder), F.lit(placeholder))
    return squeeze(out) if normalize_space else out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def ascii_share(text: Column) -> Column:
    """Share of code points below 128."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return plain / F.greatest(F.length(text), F.lit(1))


def is_english(text: Column, share: float = 0.85, min_length: int = 5) -> Column:
    """Mostly-ASCII text of some length after stripping."""
    return (F.length(strip(text)) >= min_length) & (ascii_share(text) > share)


def parse_created_at(text: Column) -> Column:
    """'Tue Oct 31 22:10:47 +0000 2017' to a timestamp; anything else to null."""
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM dd HH:mm:ss xx yyyy"))


def format_created_at(ts: Column) -> Column:
    return F.date_format(ts, "EEE MMM dd HH:mm:ss xx yyyy")


def reply_signature(reply: Column) -> Column:
    return F.lower(F.substring(strip(reply), 1, 60))


def latin_words(text: Column) -> Column:
    """Lower-cased words of two or more a-z letters that stand alone."""
    return F.regexp_extract_all(
        F.lower(text), F.lit(rf"(?<!{WORD})[a-z]{{2,}}(?!{WORD})"), F.lit(0)
    )


def index_words(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def space_words(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), F.lit(0)))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n consecutive words, joined by a blank; empty when there are fewer words."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def unigrams_and_bigrams(words: Column) -> Column:
    pairs = F.when(
        F.size(words) >= 2,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def hash_order(seed: int, key: Column) -> Column:
    """Repeatable pseudo-random sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_percent(seed: int, key: Column) -> Column:
    """Repeatable pseudo-random number in 0..99."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") % 100
