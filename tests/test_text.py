from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.fixed.baseline_rules import BASELINE_RULES
from parley.fixed.gold_strata import GOLD_STRATA
from parley.fixed.intent_patterns import INTENT_PATTERNS, SAFETY_OVERRIDES
from parley.functions import text as tx
from parley.functions.prefilter import fold, required_words


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("ref 405-4841727-8482714", "ref [PHONE]-[PHONE]"),
        ("order #12345 x", "[ORDER_ID] x"),
        ("order #112-9847291", "order #[PHONE]"),
        ("write  jo@mail.example.org\nnow", "write [EMAIL] now"),
        ("see https://example.com/a?b=1 ok", "see [LINK] ok"),
        ("order: abcdef", "order: abcdef"),
        (None, ""),
    ],
)
def test_redact(spark, raw, expected):
    assert one(spark, raw, tx.redact) == expected


def test_redact_flags(spark):
    assert one(spark, "a  b jo@x.org", lambda c: tx.redact(c, mask_pii=False)) == "a b jo@x.org"
    assert one(spark, "a  b jo@x.org", lambda c: tx.redact(c, normalize_space=False)) == "a  b [EMAIL]"


def test_clean_message(spark):
    assert one(spark, "@Brand  hello @x_1\tthere ", tx.clean_message) == "hello there"
    assert one(spark, None, tx.clean_message) == ""


def test_dates(spark):
    parsed = lambda c: F.date_format(tx.parse_created_at(c), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "Tue Oct 31 22:10:47 +0000 2017", parsed) == "2017-10-31 22:10:47"
    assert one(spark, "garbage", parsed) is None


def test_words_and_ngrams(spark):
    assert one(spark, "Héllo Big_x the Dog a 2nd", tx.latin_words) == ["the", "dog"]
    assert one(spark, "one", lambda c: tx.ngrams(tx.latin_words(c), 2)) == []
    assert one(spark, "one two three", lambda c: tx.ngrams(tx.latin_words(c), 2)) == ["one two", "two three"]
    assert one(spark, "ab c de", lambda c: tx.unigrams_and_bigrams(tx.index_words(c))) == ["ab", "de", "ab de"]
    assert one(spark, "", tx.word_count) == 0


PATTERNS = [p for _, p, _ in INTENT_PATTERNS] + [p for _, p in SAFETY_OVERRIDES] + [p for _, p, _, _ in GOLD_STRATA]
PATTERNS += [p for _, group in BASELINE_RULES for p in group]
WORDS = sorted({w for p in PATTERNS for w in re.findall(r"[a-z']+|\d+", p)})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS + [" ", "  ", "?", "Where", "IS"]), max_size=12))
def test_required_words_never_hide_a_match(parts):
    text = " ".join(parts)
    for pattern in PATTERNS:
        if re.search(pattern, text, re.I):
            words = required_words(pattern)
            assert not words or any(w in text.lower() for w in words), (pattern, text)


def test_fold_keeps_odd_case_pairs(spark):
    assert one(spark, "Kſıİ A", fold) == "ksii a"
    assert one(spark, "ſhipping was one day ſhipping days", lambda c: tx.has(c, r"\bone\s+day\s+shipping\b.*\bdays\b")) is True
