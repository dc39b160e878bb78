"""Text helpers on hand-worked tables."""

import pytest
from pyspark.sql import functions as F

from chatlake.functions import text as tx


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


# (text, stripped, words)
WORDS = [
    ("", "", 0), (" ", "", 0), ("a", "a", 1), (" a b  c ", "a b  c", 3), ("　x　", "x", 1), ("x\x1cy", "x\x1cy", 2),
    ("tab\tsep\nline\n", "tab\tsep\nline", 3), ("é è ê", "é è ê", 3), ("\x85  a b  ", "a b", 2),
    ("​x​", "​x​", 1), ("﻿x", "﻿x", 1), ("\x00 a", "\x00 a", 2),
]


def test_strip_and_words(spark):
    texts = [t for t, _, _ in WORDS]
    assert column(spark, texts, tx.py_strip) == [s for _, s, _ in WORDS]
    assert column(spark, texts, tx.n_words) == [n for _, _, n in WORDS]


@pytest.mark.parametrize("text,only", [
    ("\U0001F600", True), ("\U0001F600 \U0001F601", False), ("\U0001F600　\U0001F601", True), ("  \U0001F600\n", True), ("ok \U0001F600", False),
    ("한국어", True), ("☀️", True), ("\U0001F468‍\U0001F469", True), ("", True), ("  ", True), ("a", False), ("é", False), ("1", False)])
def test_emoji_only(spark, text, only):
    assert column(spark, [text], tx.is_emoji_only) == [only]


# The most frequent word besides stop words, and how often it stands there.
REPEATS = [("", 0), ("the the the", 0), ("dog Dog DOG cat", 3), ("lol lol lol u u", 0), ("a b b c c c", 3), ("x　x\nx\tx", 4),
           ("dog, dog dog.", 1), ("you're you're well well", 2), ("Okay ok OK fine", 1)]


def test_word_repeat(spark):
    assert column(spark, [t for t, _ in REPEATS], tx.max_word_repeat) == [n for _, n in REPEATS]


# (text, words of its longest message, speakers): messages are cut at bracketed times and at the delimiter, and
# what stands before a message's first colon does not count; a speaker stands between "] " and ": " of a line.
MESSAGES = [
    ("[2024-01-01 10:00:00] Ann: hi there you", 3, {"Ann"}),
    ("[2024-01-01 10:00:00] Ann: a b<|msg|>c d e f<|msg|>g", 4, {"Ann"}),
    ("one two three", 3, set()),
    ("one: two three", 2, set()),
    ("note: x\n[2024-01-01 10:00:00] Me: y z: w v", 4, {"Me"}),
    ("[2024-01-01  10:00:00] Ann: a b c", 3, {"Ann"}),
    ("[2024-01-01 10:00] Ann: a b c", 5, {"Ann"}),
    ("[2024-01-01 10:00:00] Ann: a\n[2024-01-01 10:01:00] Bob: b c\nmore words here", 5, {"Ann", "Bob"}),
    ("[x] Cy: hi [y] Di: yo", 4, {"Cy"}),
    ("[x] Cy hi\n] : odd", 1, {""}),
    ("", 0, set()),
]


def test_piece_words_and_speakers(spark):
    texts = [t for t, _, _ in MESSAGES]
    assert column(spark, texts, tx.max_piece_words) == [n for _, n, _ in MESSAGES]
    assert [set(x) for x in column(spark, texts, tx.line_speakers)] == [s for _, _, s in MESSAGES]
