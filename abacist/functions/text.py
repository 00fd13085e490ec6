"""Text columns: where in a free-text response the equation may stand.

Everything here is a plain Column expression. Patterns avoid constructs whose
cost grows faster than the text, since responses may be arbitrarily long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what counts as blank, the markers, and the candidate test ---
# Code points Python's str.strip and \s treat as white space.
BLANK = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
THINK_END = "</think>"
ANSWER_OPEN = r"<(?:answer|Answer)>"
ANSWER_CLOSE = r"</(?:answer|Answer)>"
ANSWER_LABEL = r"(?:answer|Answer)"
FALLBACK = "0"
PREVIEW_CHARS = 400
SAMPLE_CHARS = 300
# --- end of fixed values ---

# The same set as a class for patterns.
BLANK_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of every kind, not only blanks."""
    return F.btrim(text, F.lit(BLANK))


def strip_think(text: Column) -> Column:
    """What follows the last closing think tag; the whole text without one."""
    return F.substring_index(text, THINK_END, -1)


def search_space(text: Column) -> Column:
    """The stripped part of the response to look in; NULL for blank responses."""
    whole = strip(text)
    tail = strip(strip_think(whole))
    return F.when(tail != "", tail).when(whole != "", whole)


def tag_candidates(text: Column) -> Column:
    """Bodies of all answer tags, in order, stripped.

    Cut at the closing tags first: in every piece but the last, the body runs
    from the first opening tag to the end of the piece. Same matches as a lazy
    pattern, but linear even when many tags are never closed.
    """
    pieces = F.split(text, ANSWER_CLOSE)
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    opened = F.filter(closed, lambda p: p.rlike(ANSWER_OPEN))
    return F.when(
        text.contains("nswer>"),
        F.transform(opened, lambda p: strip(F.regexp_extract(p, f"(?s){ANSWER_OPEN}(.*)", 1))),
    ).otherwise(F.array().cast("array<string>"))


def first_tag(text: Column) -> Column:
    """The first of :func:`tag_candidates`, or NULL, without building the others.

    The group up to the first opening tag is atomic: if that tag is never
    closed, no later one is, and the search ends.
    """
    closed = rf"(?s)^(?>.*?{ANSWER_OPEN})(.*?){ANSWER_CLOSE}"
    body = strip(F.regexp_extract(text, closed, 1))
    return F.when(text.contains("nswer>") & (body != ""), body)


def label_candidates(text: Column) -> Column:
    """Rest of the line after every ``answer:`` label."""
    return F.when(
        text.contains("nswer"),
        F.regexp_extract_all(
            text, F.lit(rf"{ANSWER_LABEL}{BLANK_CLASS}*:{BLANK_CLASS}*([^\n]+)"), F.lit(1)
        ),
    ).otherwise(F.array().cast("array<string>"))


def last_line(text: Column) -> Column:
    """The last line that is not blank, stripped; NULL if there is none.

    Lines end at a line feed only. Once the text is stripped, the piece after
    the last line feed cannot be blank.
    """
    line = strip(F.substring_index(strip(text), "\n", -1))
    return F.when(line != "", line)


def lhs_of_equals(text: Column) -> Column:
    """What stands before the first equals sign, stripped."""
    return strip(F.substring_index(text, "=", 1))


def is_candidate(text: Column) -> Column:
    """Has a digit (of any script) and at least one arithmetic operator."""
    return text.rlike(r"[*/+\-]") & text.rlike(r"\p{Nd}")


def candidates(text: Column) -> Column:
    """All candidates of a search space in the order they are tried."""
    return F.concat(
        tag_candidates(text),
        label_candidates(text),
        F.array_compact(F.array(last_line(text))),
        F.array(text),
    )


def normalize_equation(equation: Column) -> Column:
    """Before the first ``=``, white space collapsed; NULL for NULL or empty.

    The result may be the empty string: ``= 5`` has nothing before the sign.
    """
    head = strip(F.substring_index(equation, "=", 1))
    return F.when(equation != "", F.regexp_replace(head, f"{BLANK_CLASS}+", " "))


def equation_or_fallback(equation: Column) -> Column:
    """The stripped equation, or the fixed fallback for NULL and blank ones."""
    trimmed = strip(equation)
    return F.when(trimmed != "", trimmed).otherwise(F.lit(FALLBACK))


def response_preview(response: Column, chars: int = PREVIEW_CHARS) -> Column:
    """Head of what follows the first closing think tag, or of the raw response.

    Unlike :func:`strip_think` this cuts at the first tag, and only a cut
    response is stripped.
    """
    at = F.locate(THINK_END, response)
    tail = F.substr(response, at + F.lit(len(THINK_END)))
    return F.when(at > 0, F.left(strip(tail), F.lit(chars))).otherwise(
        F.left(response, F.lit(chars))
    )


def sample_text(response: Column, chars: int = SAMPLE_CHARS) -> Column:
    return F.substring(response, 1, chars)


WORD_CHARACTER = r"[\p{L}\p{M}\p{N}_]"
BLANK_CHARACTER = r"[\s\p{Z}\x{85}]"


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def word_count(text: Column) -> Column:
    r"""Stand-in token counter: runs of word characters and single symbols, of any script.

    Word characters are letters, marks, digits and ``_``. Nothing but lengths is
    kept: every run becomes one character, white space goes, the rest is counted.
    """
    runs = F.regexp_replace(text, f"{WORD_CHARACTER}+", "w")
    return F.length(F.regexp_replace(runs, f"{BLANK_CHARACTER}+", "")).cast("bigint")
