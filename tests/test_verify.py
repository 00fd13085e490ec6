"""Grammar, evaluation and verdicts against fixed cases and the ast module."""

import ast
import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from abacist.functions import arithmetic as A
from abacist.functions.residual import judge_first
from abacist.functions.sql import register_sql
from abacist.operators.scoring import parse_status, verify_equations

CASES = [
    ("90 - 80 + 75 - 24", [75, 80, 90, 24], 61, "ok"),
    (None, [1], 1, "invalid"),
    (" \t ", [1], 1, "invalid"),
    ("1 +", [1], 1, "syntax"),
    ("05 + 1", [5, 1], 6, "syntax"),
    ("2.0 * 3", [2, 3], 6, "ok"),
    ("2.5 * 2", [2, 2], 5, "processing"),
    ("2 ** 3", [2, 3], 8, "processing"),
    ("7 // 2", [7, 2], 3, "processing"),
    ("2(3)", [2, 3], 6, "processing"),
    ("x + 1", [1], 1, "processing"),
    ("1 / (2 - 2)", [1, 2], 0, "processing"),
    ("-3 + 5", [-3, 5], 2, "numbers"),
    ("-3 + 5", [3, 5], 2, "ok"),
    ("1 / 3 * 3", [1, 3, 3], 1, "ok"),
    ("True + 2", [1, 2], 3, "ok"),
    ("8 / 2 * (2 + 2)", [8, 2, 2, 2], 16, "ok"),
    ("3 - -(4) * (2 - +(1+1))", [3, 4, 2, 1, 1], 3, "ok"),
    ("1 + 2", [2, 1], 4, "value"),
    ("1 + 2", [2, 1], None, "value"),
    ("1 + 2", None, 3, "numbers"),
    ("1.0 + 2", None, 3, "numbers"),
    ("9007199254740993 - 1", [9007199254740993, 1], 9007199254740993, "value"),
    ("1e308 * 10 * 1e308 * 10", [10, 10], 1, "numbers"),
    ("((((((((((1 + 2))))))))))", [1, 2], 3, "ok"),
    ("(" * 150 + "1 + 2" + ")" * 150, [1, 2], 3, "ok"),
    ("~1 + 2", [1, 2], 3, "processing"),
    ("1 + 2 # sum", [1, 2], 3, "ok"),
    ("0x10 + 1_0", [16, 10], 26, "ok"),
    ("3j + 1", [1], 1, "processing"),
]
SHAPE = "equation string, nums array<bigint>, target bigint, want string"


@pytest.mark.parametrize("native", [True, False])
def test_fixed_cases(spark, native):
    out = verify_equations(spark.createDataFrame(CASES, SHAPE), native=native).collect()
    assert [(r.equation, r.reason_code) for r in out] == [(c[0], c[3]) for c in CASES]


def test_reasons_and_results(spark):
    df = spark.createDataFrame(CASES, SHAPE)
    by_text = {r.equation: r for r in verify_equations(df).collect() if r.nums and r.target}
    assert by_text["90 - 80 + 75 - 24"].result == 61.0
    assert by_text["90 - 80 + 75 - 24"].reason == "All good"
    assert by_text["1 + 2"].reason == "Equation 1 + 2 != 4"
    assert by_text["x + 1"].reason.startswith("While ast processing raised Error=Unsupported ast node")
    assert by_text["2.5 * 2"].reason.endswith("Invalid constant type (float) 2.5")
    assert by_text["05 + 1"].reason.startswith("SyntaxError=")
    assert by_text["1 / 3 * 3"].ok


def test_sql_function(spark):
    register_sql(spark)
    df = spark.createDataFrame(CASES, SHAPE)
    out = spark.sql(
        "SELECT want, verify_equation(equation, nums, target).code AS code FROM {df}", df=df
    )
    assert out.filter("want <> code").count() == 0


def test_first_error_in_evaluation_order_is_reported():
    assert "node" in judge_first(["x + 1 / 0"], [1, 0], 1)[2]
    assert judge_first(["1 / 0 + x"], [1, 0], 1)[2] == "Division by zero"


def _random_expression(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.3:
        return str(rng.choice([0, 1, 2, 3, 7, 10, 25, 99]))
    if pick < 0.4:
        return rng.choice("+-") + _random_expression(rng, depth - 1)
    if pick < 0.6:
        return "(" + _random_expression(rng, depth - 1) + ")"
    op = rng.choice(["+", " - ", "*", "/", " / ", "-"])
    return _random_expression(rng, depth - 1) + op + _random_expression(rng, depth - 1)


def _random_texts(rng):
    alphabet = list("0123456789") * 2 + list("+-*/()  ") * 3
    words = (
        "if else a ab the 3 4 + - * ( ) ' \" # let's don't x in not and or lambda : , . = [ ] \\ "
        "f'x' rb 1.5 e3 0x1f é × да $ ! != yield await for is True None"
    ).split(" ")
    for _ in range(12000):
        kind = rng.random()
        if kind < 0.3:
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        elif kind < 0.6:
            text = _random_expression(rng, 4)
            if rng.random() < 0.2:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice(alphabet) + text[at + rng.randint(0, 1) :]
        else:
            text = "".join(
                rng.choice(words) + rng.choice([" ", "", "\n", " "])
                for _ in range(rng.randint(2, 9))
            )
        if text.strip():
            yield text.strip()


def test_native_grammar_and_value_agree_with_ast(spark):
    texts = sorted(set(_random_texts(random.Random(11))))
    df = spark.createDataFrame([(t,) for t in texts], "e string").repartition(8)
    rows = df.select(
        "e",
        A.grammar_status(F.col("e")).alias("status"),
        F.when(A.grammar_status(F.col("e")) == A.OK, A.evaluate_native(F.col("e"))).alias("v"),
    ).collect()
    seen = set()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in rows:
            try:
                tree = ast.parse(r.e, mode="eval")
            except SyntaxError:
                tree = None
            seen.add((r.status, tree is not None))
            if r.status == A.OK:
                assert tree is not None, r.e
                try:
                    want = (float(eval(compile(tree, "", "eval"))), False)
                except ZeroDivisionError:
                    want = (None, True)
                assert (r.v.value, r.v.zero_division) == want, r.e
            if r.status == A.BAD:
                assert tree is None, r.e
    assert {("ok", True), ("bad", False), ("other", True), ("other", False)} <= seen


def _long_expression(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.3:
        return str(rng.choice([0, 1, 3, 7, rng.randrange(10**9), rng.randrange(10**18), 2**53 + 1, 10**18 - 1]))
    if pick < 0.4:
        return rng.choice("+-") + _long_expression(rng, depth - 1)
    if pick < 0.6:
        return "(" + _long_expression(rng, depth - 1) + ")"
    return _long_expression(rng, depth - 1) + rng.choice("++--**/") + _long_expression(rng, depth - 1)


def test_long_integers_agree_with_ast_to_the_bit(spark):
    rng = random.Random(5)
    texts = sorted({t for t in (_long_expression(rng, rng.randint(1, 4)) for _ in range(8000)) if len(t) <= 256})
    df = spark.createDataFrame([(t,) for t in texts], "e string").repartition(8)
    plain = df.filter(A.grammar_status(F.col("e")) == A.OK)
    rows = plain.select("e", A.evaluate_exact(F.col("e")).alias("v"), A.exactly_evaluable(F.col("e")).alias("short")).collect()
    told = 0
    for r in rows:
        try:
            want = eval(compile(ast.parse(r.e, mode="eval"), "", "eval"))
        except ZeroDivisionError:
            assert r.v.zero_division or r.v.value is None, r.e
            continue
        assert not r.v.zero_division, r.e
        if r.v.value is None:
            assert not r.short, r.e
            continue
        told += 1
        assert r.v.value == float(want), r.e
        assert r.v.whole == (want if isinstance(want, int) else None), r.e
    assert told > 0.75 * len(rows) and len(rows) > 3000


def test_verdicts_on_long_integers(spark):
    rng, rows = random.Random(6), []
    for text in {_long_expression(rng, rng.randint(1, 3)) for _ in range(1500)}:
        numbers = [int(d) for d in re.findall("[0-9]+", text)]
        try:
            value = eval(text)
        except (ZeroDivisionError, SyntaxError):
            value = 0
        target = int(value) if abs(value) < 2**62 else 1
        rows += [(len(rows) + k, text, numbers, target + k) for k in (0, 1)]
    df = spark.createDataFrame(rows, "idx long, equation string, nums array<bigint>, target bigint")
    shown = ["idx", "ok", "reason_code", "reason", "result"]
    native = sorted(verify_equations(df).select(*shown).collect())
    assert native == sorted(verify_equations(df, native=False).select(*shown).collect())
    assert len({r.reason_code for r in native}) >= 3


def test_parse_status(spark):
    df = spark.createDataFrame(
        [("1+1", True), ("x y", False), ("x", True), (None, False), ("2(3)", True), ("1 +", False)],
        "equation string, want boolean",
    )
    assert parse_status(df).filter("want <> parses").count() == 0
