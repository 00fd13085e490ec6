"""Extraction against fixed cases and an independent per-row check."""

import random

from pyspark.sql import functions as F

from abacist.functions import text as T
from abacist.operators.scoring import extract_equation, score_responses

FIXED = [
    (
        "Let me see: 12 + 5 * (9 - 6) = 12 + 15 = 27, which works.\n</think>\n<answer>\n12 + 5 * (9 - 6) = 27\n</answer>",
        "12 + 5 * (9 - 6)",
    ),
    ("<answer>27 = 12 + 15</answer>", None),
    ("<Answer>4*5</answer>", "4*5"),
    ("ANSWER: 3+4\ndone", None),
    (None, None),
    ("  \n", None),
    ("<answer>abc def 3+4</answer> answer: 2**3 = 8\nfoo", "2**3"),
    ("<answer>1+</answer>\n'a'+3\n", "'a'+3"),
    ("<answer>x+</answer><answer>1.5*2</answer>", "1.5*2"),
    ("<answer>x-1</answer>", "x-1"),
    ("<think>only 3+4", None),
    ("hello\n3+4", "3+4"),
    ("answer:\n\n 5 + 6 = 11", "5 + 6"),
    ("<think>1+1</think> <think>2+2</think>", None),
    ("<answer>9+9</answer> <think>a</think> 3+4", "3+4"),
    # One body, and it parses: a chained comparison with a name.
    ("<answer>1+1 <answer>2+2</answer>", "1+1 <answer>2+2"),
    ("3+4\x1f", "3+4"),
]


# Parts a response is put together from, with the equation that each offers when it is the first to offer one.
TAGS = [
    ("<answer>3 + 4 = 7</answer>", "3 + 4"),
    ("<Answer> (1+2)*3 </answer>", "(1+2)*3"),
    ("<answer>\n2**3\n</Answer>", "2**3"),
    ("<answer>1 +</answer>", None),
    ("<answer>word word</answer>", None),
    ("<answer>7 = 3 + 4</answer>", None),
]
LABELS = [("answer: 5 - 2 = 3", "5 - 2"), ("Answer :x+1", "x+1"), ("answer:\n 8/4", "8/4"), ("Answer: nothing", None)]
LINES = [("6 * 7", "6 * 7"), ("10 - 2.5 = 7.5", "10 - 2.5"), ("So that is it.", None), ("1 + 'a", None)]
FILLERS = ["", "Let's see.", "words and more words", "\\frac", "× 3"]


def _assembled(rng):
    """A response and its equation: tags come before labels, labels before the last line; a think block hides what it closes."""
    tags, labels = ([rng.choice(x) for _ in range(rng.randint(0, 3))] for x in (TAGS, LABELS))
    line = rng.choice(LINES)
    placed = tags + labels
    rng.shuffle(placed)
    shown = [p for p in placed if p in tags] + [p for p in placed if p in labels] + [line]
    body = "\n".join(x for text, _ in placed for x in (rng.choice(FILLERS), text)) + "\n" + line[0] + "\n"
    hidden = rng.choice(["", "<think>9 + 9</think>\n", "<answer>9 * 9</answer> no\n</think>\n"])
    return hidden + body, next((equation for _, equation in shown if equation), None)


def test_fixed(spark):
    rows = spark.createDataFrame(FIXED, "response string, want string")
    assert extract_equation(rows).filter("NOT (want <=> equation)").collect() == []


def test_assembled_texts(spark):
    rng = random.Random(3)
    cases = sorted({_assembled(rng) for _ in range(5000)}, key=str)
    rows = spark.createDataFrame(cases, "response string, want string")
    wrong = extract_equation(rows).filter("NOT (want <=> equation)").take(3)
    assert wrong == []


def test_whole_documents(spark, sf):
    """Prose offers no equation, so what follows it is found."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    for tail, want in (("3 + 4 = 7", "3 + 4"), ("answer: 5*6", "5*6"), ("<answer>8-1</answer>", "8-1")):
        rows = texts.select(F.concat("text", F.lit("\n" + tail)).alias("response"))
        assert [r.equation for r in extract_equation(rows).select("equation").distinct().collect()] == [want]


def test_unclosed_tags_take_linear_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("<answer>3 +"), 50_000).alias("response"))
    assert extract_equation(df).first().equation is None


def test_score_without_equation(spark):
    df = spark.createDataFrame(
        [("no idea", [1], 1), ("<answer>1+</answer>", [1], 1), ("<answer>-1</answer>", [1], -1)],
        "response string, nums array<bigint>, target bigint",
    )
    out = score_responses(df).collect()
    assert [r.reason_code for r in out] == ["not_extracted", "not_extracted", "ok"]
    assert out[0].reason == "Failed to extract equation from response"


def test_text_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]

    assert one(T.normalize_equation, "  3  +\n4 = 7") == "3 + 4"
    assert one(T.normalize_equation, "= 5") == ""
    assert one(T.normalize_equation, "") is None
    assert one(T.normalize_equation, None) is None
    assert one(T.equation_or_fallback, None) == "0"
    assert one(T.equation_or_fallback, "  ") == "0"
    assert one(T.equation_or_fallback, " 1+2 ") == "1+2"
    assert one(T.response_preview, "a</think> b </think> c") == "b </think> c"
    assert one(T.response_preview, " raw ") == " raw "
    assert one(T.strip_think, "a</think>b</think>c") == "c"
    assert one(T.last_line, "a\n b \n \n") == "b"
    assert one(T.last_line, " ") is None
    assert one(T.is_candidate, "٣+1") is True
