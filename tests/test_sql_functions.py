"""The verifier as SQL functions: verdicts, plans, and what reaches the host grammar."""

import random

import pytest
from pyspark.sql import functions as F

from abacist.functions import sql
from abacist.operators import scoring
from abacist.sources import puzzles

ASK = "SELECT idx, {f}(equation, nums, target) AS v FROM {{df}}"


def asked(spark, df, function="verify_equation"):
    return spark.sql(ASK.format(f=function), df=df)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_equations(spark, n=3000):
    rng, rows = random.Random(11), []
    for i in range(n):
        numbers = [rng.randint(0, 60) for _ in range(rng.randint(1, 5))]
        text = str(numbers[0])
        for x in numbers[1:]:
            text = rng.choice(["({} {} {})", "{}{}{}", "{} {}{}", "{} {} -({})"]).format(text, rng.choice("+-*/"), x)
        damage = rng.random()
        if damage < 0.25:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice([" ", ")", "(", "'", "x", "\n", "\t", "**", "0", "\\", " ", '"', ".5"]) + text[at:]
        elif damage < 0.3:
            text = rng.choice([None, "", "  ", "It's what", "a b", "1e3", "9" * 20, "1" * 9 + "*" + "3" * 9])
        rows.append((i, text, None if rng.random() < 0.02 else numbers, rng.choice([None, 0, 1, 24, sum(numbers)])))
    return spark.createDataFrame(rows, "idx long, equation string, nums array<long>, target long")


@pytest.mark.parametrize("source", [puzzles.proposed, puzzles.hard, random_equations])
def test_verdicts_are_those_of_the_operator(spark, sf, source):
    sql.register_sql(spark)
    df = source(spark) if source is random_equations else source(spark, sf)
    want = {r.idx: (r.ok, r.reason_code, r.result) for r in scoring.verify_equations(df).collect()}
    got = {r.idx: (r.v.ok, r.v.code, r.v.result) for r in asked(spark, df).collect()}
    assert got == want
    plain = {r.idx: (r.v.ok, r.v.code, r.v.result) for r in asked(spark, df, "verify_plain_equation").collect()}
    undecided = {i for i, v in plain.items() if v[1] == "other"}
    assert {i: v for i, v in plain.items() if i not in undecided} == {i: v for i, v in want.items() if i not in undecided}
    assert len(undecided) < len(want)


def test_plans(spark, sf):
    sql.register_sql(spark)
    df = puzzles.proposed(spark, sf)
    assert "Python" not in plan(asked(spark, df, "verify_plain_equation"))
    for verified in (asked(spark, df), asked(spark, df).filter("v.ok"), asked(spark, df).select("v.code", "v.result")):
        assert plan(verified).count("ArrowEvalPython") == 1
        # Each form of the evaluation is in the plan once, also below a filter on its result.
        assert plan(verified).count("aggregate(") == 2
        assert plan(verified).count("Exchange") == plan(df).count("Exchange")


def test_plain_texts_never_reach_the_host_grammar(spark, sf, monkeypatch):
    """With a grammar that fails on any question, plain texts pass and others fail."""

    def refusing(tolerance):
        import pyarrow as pa

        @F.arrow_udf("struct<ok:boolean, code:string, detail:string, result:double>")
        def ask(questions: pa.Array) -> pa.Array:
            assert questions.null_count == len(questions), "asked"
            kind = [("ok", pa.bool_()), ("code", pa.string()), ("detail", pa.string()), ("result", pa.float64())]
            return pa.array([None] * len(questions), type=pa.struct(kind))

        return ask.asNondeterministic()

    monkeypatch.setattr(sql, "_grammar", refusing)
    sql.register_sql(spark, "verify_strictly", "verify_strictly_plain")
    proposed = puzzles.proposed(spark, sf)
    assert asked(spark, proposed.filter("kind <> 11"), "verify_strictly").collect()
    with pytest.raises(Exception, match="asked"):
        asked(spark, proposed.filter("kind = 11"), "verify_strictly").collect()


def test_names_and_tolerance_are_the_caller_s(spark):
    sql.register_sql(spark, "check_loosely", "check_plainly", tolerance=0.5)
    row = spark.sql("SELECT check_loosely('7 / 2', array(7, 2), 4) AS a, check_plainly('7/2', array(2, 7), 4).code AS b").first()
    assert row.a.ok and row.a.result == 3.5 and row.b == "ok"
