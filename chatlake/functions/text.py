"""Text helpers that reproduce Python ``str`` semantics with Spark built-ins.

Python's ``str.split()`` / ``str.strip()`` use Unicode whitespace and ``\\d``
matches every Unicode decimal digit; Java's defaults are ASCII.  The classes
below spell the Python sets out so Spark (Java regex) and DuckDB (RE2) agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the studied pipeline's values for equal results)
# ---------------------------------------------------------------------------

# Delimiter placed between merged consecutive messages of one speaker.
MSG_DELIM = "<|msg|>"

# Words that drop a conversation from the conversation store (substring test).
STORE_BANNED_WORDS = ["sex", "sexy", "gamepigeon"]

# Strings that drop a training example (case-insensitive substring test).
EXAMPLE_BANNED_STRINGS = ["GamePigeon message:", "Library/Messages/"]

# URL markers for the contains-url filter.
URL_PATTERNS = [
    "http://", "https://", "www.", ".com", ".org", ".edu", ".gov",
    ".net", "maps.google", "discord.com", "tickets.princeton",
]

# English stop words (the classic NLTK English list) followed by the extra
# chat words the pipeline adds.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it",
    "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't",
    "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
    "yeah", "ok", "okay", "lol", "like", "um", "uh", "haha", "im", "i", "u",
]

# Characters of the emoji-only filter, as a class for Java and RE2 (the wide
# range from U+24C2 to U+1F251 also covers CJK and Hangul).
EMOJI_CLASS = (
    r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}"
    r"\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
    r"\x{200D}\x{2640}-\x{2642}\x{2600}-\x{2B55}\x{23CF}\x{23E9}\x{231A}\x{3030}\x{FE0F}]"
)

# Python ``str.isspace`` characters.
_WS_CODES = [
    "9", "A", "B", "C", "D", "1C", "1D", "1E", "1F", "20", "85", "A0", "1680",
    "2000-200A", "2028", "2029", "202F", "205F", "3000",
]

# ---------------------------------------------------------------------------
# Regex building blocks (valid in both Java regex and RE2)
# ---------------------------------------------------------------------------


def _cls_items(codes: list[str]) -> str:
    out = []
    for c in codes:
        if "-" in c:
            a, b = c.split("-")
            out.append(f"\\x{{{a}}}-\\x{{{b}}}")
        else:
            out.append(f"\\x{{{c}}}")
    return "".join(out)


WS = _cls_items(_WS_CODES)                       # inside [...]
WS_RE = f"[{WS}]"
NON_WS_RUN = f"[^{WS}]+"
DIGIT = "\\p{Nd}"
# ``[YYYY-MM-DD HH:MM:SS]`` rendered timestamp, Unicode digits and spaces.
TS_BRACKET_RE = (
    f"\\[{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}{WS_RE}+"
    f"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}\\]"
)
MSG_DELIM_RE = "<\\|msg\\|>"
STRIP_RE = f"^{WS_RE}+|{WS_RE}+$"


def lit_re(s: str) -> str:
    """Escape a literal for use inside a regex (Java and RE2)."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in "\\.^$|?*+()[]{}" else ch)
    return "".join(out)


# ---------------------------------------------------------------------------
# Column helpers
# ---------------------------------------------------------------------------


WS_CHARS = "".join(
    chr(cp) for code in _WS_CODES
    for cp in (range(int(code.split("-")[0], 16), int(code.split("-")[1], 16) + 1) if "-" in code
               else [int(code, 16)]))


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (linear trim)."""
    return F.btrim(c, F.lit(WS_CHARS))


def n_words(c: Column) -> Column:
    """``len(str.split())``: number of maximal non-whitespace runs."""
    return F.coalesce(F.regexp_count(c, F.lit(NON_WS_RUN)), F.lit(0))


def words(c: Column) -> Column:
    """``str.split()`` as an array (empty array for blank text)."""
    return F.regexp_extract_all(c, F.lit(f"({NON_WS_RUN})"), 1)


def is_blank(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NON_WS_RUN)) == 0


def contains_any_ci(c: Column, needles: list[str]) -> Column:
    """Case-insensitive substring test against a fixed list."""
    low = F.lower(c)
    cond = F.lit(False)
    for n in needles:
        cond = cond | low.contains(n.lower())
    return cond


def max_delims_per_line(c: Column) -> Column:
    """Largest number of message delimiters on any ``\\n``-separated line."""
    return F.array_max(
        F.transform(F.split(c, "\n"), lambda x: F.regexp_count(x, F.lit(MSG_DELIM_RE)))
    )


def count_ts_brackets(c: Column) -> Column:
    """Number of ``[YYYY-MM-DD HH:MM:SS]`` stamps in the text."""
    return F.regexp_count(c, F.lit(TS_BRACKET_RE))


def max_piece_words(c: Column) -> Column:
    """Largest word count of a message piece.

    The text is cut at every bracketed timestamp, each part at the message
    delimiter, and a piece's text before its first ``:`` (the speaker) is
    not counted.
    """
    parts = F.split(c, TS_BRACKET_RE)
    return F.array_max(
        F.transform(
            parts,
            lambda p: F.array_max(
                F.transform(
                    F.split(p, MSG_DELIM_RE),
                    lambda s: n_words(F.substring(s, F.instr(s, ":") + 1, 1 << 30)),
                )
            ),
        )
    )


def line_speakers(c: Column) -> Column:
    """Speakers named on the lines of rendered transcript text.

    A line counts when it holds both ``'] '`` and ``': '``; the name is the
    text after the first ``'] '`` (up to the next one) and before ``': '``.
    """
    lines = F.filter(F.split(c, "\n"), lambda ln: ln.contains("] ") & ln.contains(": "))
    return F.transform(
        lines, lambda ln: F.substring_index(F.element_at(F.split(ln, "\\] "), 2), ": ", 1)
    )


def is_emoji_only(c: Column) -> Column:
    """Text that is empty after stripping and removing emoji characters."""
    return F.regexp_replace(py_strip(c), EMOJI_CLASS, "") == ""


def max_word_repeat(c: Column, stop_words: list[str] | None = None) -> Column:
    """Highest count of one non-stop word among lower-cased ``split()`` words.

    Sorts the word array once and folds over it keeping the longest run of
    equal neighbours, so long texts cost n log n, not n * distinct.
    """
    sw = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None else STOP_WORDS)])
    ws = F.array_sort(F.filter(words(F.lower(c)), lambda w: ~F.array_contains(sw, w)))
    init = F.struct(F.lit("").alias("p"), F.lit(0).alias("r"), F.lit(0).alias("b"))

    def step(acc, x):
        run = F.when(x == acc["p"], acc["r"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("p"), run.alias("r"), F.greatest(acc["b"], run).alias("b"))

    return F.aggregate(ws, init, step, lambda acc: acc["b"])
