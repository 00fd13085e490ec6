"""Puzzle and response tables derived from the ``orders`` table.

The driver's tables hold no puzzles, so each order becomes one puzzle and one
response, by closed formulas over its keys. Thirteen kinds of response cover
the ways a model answers. Used by the registered queries, tests and the bench.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_CAP = 600
CHUNK_ROWS = 1000
KINDS = 13


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the orders, dealt out by key: puzzles are much larger than the keys they are made of."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("idx"),
        F.col("o_custkey").alias("ck"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx")


def _numbers(df: DataFrame) -> DataFrame:
    df = df.withColumn("kind", F.col("idx") % KINDS)
    return df.select(
        "*",
        (1 + F.col("ck") % 50).alias("a"),
        (1 + F.col("idx") % 11).alias("b"),
        (1 + F.col("idx") % 7).alias("c"),
    )


def _target() -> Column:
    total = F.col("a") + F.col("b") * F.col("c")
    return F.when(F.col("kind") == 8, total + 1).otherwise(total)


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_orders(spark, sf_dir)).select(
        "idx", F.array("a", "b", "c").alias("nums"), _target().alias("target")
    )


def problems_with_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzles; those of orders with status P bring a prompt of their own."""
    own = F.array(F.struct(F.col("priority").alias("content"), F.lit("user").alias("role")))
    return _numbers(_orders(spark, sf_dir)).select(
        "idx",
        F.array("a", "b", "c").alias("nums"),
        _target().alias("target"),
        F.when(F.col("status") == "P", own).alias("prompt"),
    )


def _response() -> Column:
    a, b, c = (F.col(x).cast("string") for x in "abc")
    expr = F.concat(a, F.lit(" + "), b, F.lit(" * "), c)
    wide = F.when(F.col("ck") % 2 == 1, F.concat(a, F.lit("  +  "), b, F.lit(" * "), c)).otherwise(expr)
    total = (F.col("a") + F.col("b") * F.col("c")).cast("string")

    def answer(*parts):
        return F.concat(F.lit("<answer>"), *parts, F.lit("</answer>"))

    texts = [
        answer(expr),
        F.concat(
            F.lit("<think>try 9 - 9 = 0</think>\n"),
            answer(F.lit("\n"), expr, F.lit(" = "), total, F.lit("\n")),
        ),
        F.concat(answer(a, F.lit(" - "), b, F.lit(" - "), c), F.lit(" "), answer(expr)),
        F.concat(F.lit("Answer: "), wide, F.lit(" = "), total),
        F.concat(F.lit("Here is it\n\n"), expr, F.lit("\n")),
        F.concat(F.lit("<think>"), expr, F.lit("</think>")),
        answer((F.col("a") + 1).cast("string"), F.lit(" + "), b, F.lit(" * "), c),
        answer(a, F.lit(" + "), b),
        answer(expr, F.lit(" = "), total),
        answer(a, F.lit(" / ("), b, F.lit(" - "), b, F.lit(") + "), c),
        F.lit("I could not find it."),
        answer(a, F.lit(" ** "), b, F.lit(" * "), c),
        F.concat(F.lit("<think>maybe\nAnswer: "), expr),
    ]
    chosen = F.when(F.col("kind") == 0, texts[0])
    for kind, text in enumerate(texts[1:], start=1):
        chosen = chosen.when(F.col("kind") == kind, text)
    return chosen


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per puzzle, without the puzzle."""
    return _numbers(_orders(spark, sf_dir)).select(
        "idx",
        _response().alias("response"),
        (20 + (F.col("idx") * 37) % 600).alias("response_n_tokens"),
        F.floor(F.col("idx") / CHUNK_ROWS).alias("chunk"),
    )


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzle and response side by side, with the customer as the ``id`` they are asked under."""
    return _numbers(_orders(spark, sf_dir)).select(
        "idx",
        F.col("ck").alias("id"),
        F.array("a", "b", "c").alias("nums"),
        _target().alias("target"),
        _response().alias("response"),
        (20 + (F.col("idx") * 37) % 600).alias("response_n_tokens"),
        F.floor(F.col("idx") / CHUNK_ROWS).alias("chunk"),
    )


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzle and the bare equation its response proposes, NULL where there is none."""
    a, b, c = (F.col(x).cast("string") for x in "abc")
    expr = F.concat(a, F.lit(" + "), b, F.lit(" * "), c)
    wide = F.concat(a, F.lit("  +  "), b, F.lit(" * "), c)
    kind = F.col("kind")
    equation = (
        F.when(kind.isin(5, 10), None)
        .when(kind == 2, F.concat(a, F.lit(" - "), b, F.lit(" - "), c))
        .when((kind == 3) & (F.col("ck") % 2 == 1), wide)
        .when(
            kind == 6, F.concat((F.col("a") + 1).cast("string"), F.lit(" + "), b, F.lit(" * "), c)
        )
        .when(kind == 7, F.concat(a, F.lit(" + "), b))
        .when(kind == 9, F.concat(a, F.lit(" / ("), b, F.lit(" - "), b, F.lit(") + "), c))
        .when(kind == 11, F.concat(a, F.lit(" ** "), b, F.lit(" * "), c))
        .otherwise(expr)
    )
    return _numbers(_orders(spark, sf_dir)).select(
        "idx",
        F.col("ck").alias("id"),
        F.array("a", "b", "c").alias("nums"),
        _target().alias("target"),
        "kind",
        equation.alias("equation"),
    )


HARD_KINDS = 19
# 17 and 18 digits: more than a double holds.
LONG, LONGER, EVEN = 12345678901234567, 999999999999999999, 900719925474099300


def hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations that the plain kinds leave out, with their puzzle: quotients that are not whole, values just
    inside and outside the tolerance, signs, nesting, floats, names, blanks beyond ASCII, long broken texts, integers
    beyond what a double, and beyond what 38 digits hold."""
    df = _numbers(_orders(spark, sf_dir)).withColumn("kind", F.col("idx") % HARD_KINDS)
    a, b, c = (F.col(x) for x in "abc")
    sa, sb, sc = (x.cast("string") for x in (a, b, c))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def nums(*values):
        return F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("bigint") for v in values])

    cases = [
        (text(sa, " / ", sb, " / ", sc), nums(a, b, c), F.floor(a / (b * c))),
        (text("(", sa, " / ", sb, ") * ", sb), nums(a, b, b), a),
        (text("2.0 * ", sa), nums(2, a), 2 * a),
        (text("2.5 * ", sa), nums(2, a), 2 * a),
        (text("-(", sa, " - ", sb, ") + -", sc), nums(a, b, c), b - a - c),
        (text("(" * 12, sa, ")" * 12, " + ", sc), nums(a, c), a + c),
        (text("x + ", sa), nums(a), a),
        (text(sa, "\u00a0+ ", sb), nums(a, b), a + b),
        (text("(", F.repeat(text(sa, " + "), 130), sb), nums(a, b), a + b),
        (text(sa, " / 3"), nums(a, 3), F.floor(a / 3)),
        (text("True + ", sa), nums(1, a), a + 1),
        (text(sa, " // ", sb), nums(a, b), a),
        (text("0", sa, " + ", sb), nums(a, b), a + b),
        (text(sa, " + 1 / 2000000"), nums(a, 1, 2000000), a),
        (text(sa, " + 1 / 500000"), nums(a, 1, 500000), a),
        (text(f"{LONG} * ", sa, " + ", sb), nums(LONG, a, b), F.lit(LONG) * a + b),
        (text(f"{LONG} * ", sa, " + ", sb), nums(LONG, a, b), F.lit(LONG) * a + b + 1),
        (text(f"{LONGER} * {LONGER} * {LONGER} - ", sa), nums(LONGER, LONGER, LONGER, a), F.lit(0)),
        (text(f"{EVEN} / ", sa, " * ", sb), nums(EVEN, a, b), F.lit(0)),
    ]
    chosen = [F.when(F.col("kind") == 0, cases[0][i]) for i in range(3)]
    for kind, case in enumerate(cases[1:], start=1):
        chosen = [was.when(F.col("kind") == kind, now) for was, now in zip(chosen, case)]
    return df.select(
        "idx", chosen[0].alias("equation"), chosen[1].alias("nums"), chosen[2].cast("bigint").alias("target")
    )


def _note(kind: str, key: str) -> Column:
    """Text with what CSV has trouble with: blanks at the ends, quotes, a separator."""
    return F.concat(F.lit(f'  {kind} "'), F.col(key).cast("string"), F.lit('", so ')).alias("note")


def test_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One puzzle for each customer, the one of the last order, as a test table asks them."""
    last = F.max_by(F.struct("nums", "target", "idx", "response", "response_n_tokens"), "idx")
    return answered(spark, sf_dir).groupBy("id").agg(last.alias("last")).select("id", "last.*")


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission template: part keys, then supplier keys, which repeat some of them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"), _note("part", "p_partkey"), F.col("p_partkey").alias("pos")
    )
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("id"),
        _note("supplier", "s_suppkey"),
        (F.col("s_suppkey") + 10**12).alias("pos"),
    )
    return part.unionByName(supplier).select(
        "id", F.lit("1 + 1").alias("equation"), "note", "pos"
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results keyed by customer: many per id, the last one counts; not every template id has one."""
    return proposed(spark, sf_dir)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses seen at training steps 0, 25, 50, 75 and 100."""
    return answered(spark, sf_dir).withColumn("step", 25 * (F.col("idx") % 5))
