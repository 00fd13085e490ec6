"""Arithmetic over strings as Column expressions.

An expression of integers, ``+ - * /``, parentheses and blanks is checked and
evaluated inside the JVM. Anything unusual (names, floats, powers, newlines,
very long numbers ...) is classified ``other`` and left to
:mod:`abacist.functions.residual`, which applies the host grammar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, BAD, OTHER = "ok", "bad", "other"

# Up to this many digits in all, no integer that + - * can produce leaves the
# range in which doubles are exact.
EXACT_DIGITS = 15
# A literal of up to this many digits is a 64-bit integer.
LITERAL_DIGITS = 18
# Nesting up to this depth is checked natively; deeper ones are ``other``.
NATIVE_DEPTH = 8

# Numbers joined by binary operators, parentheses only where they may stand: one
# match that settles nearly every real equation but for the balance.
_NUMBER = rf"(?:0|[1-9][0-9]{{0,{LITERAL_DIGITS - 1}}}+)(?![0-9])"
COMMON = (
    rf"^(?=.{{1,256}}$)[ \t(]*+{_NUMBER}[ \t)]*+(?:[-+*/][ \t(]*+{_NUMBER}[ \t)]*+)*+$"
)

PLAIN = r"^[0-9+*/() \t-]{1,256}$"

# Valid or not for reasons the local rules below do not cover: powers, floor
# division, leading zeros, calls, empty groups and numbers of 19+ digits.
UNUSUAL = rf"[*]{{2}}|//|(?<![0-9])0[0-9]|[0-9)][ \t]*[(]|[(][ \t]*[)]|[0-9]{{{LITERAL_DIGITS + 1}}}"

# Two neighbouring tokens that no expression can contain, or a wrong first or
# last token. With balanced parentheses, a string free of these is valid.
MISPLACED = (
    r"^[*/)]|[-+*/(]$"
    r"|[-+*/][ \t]*[*/)]|[(][ \t]*[*/]"
    r"|[0-9)][ \t]+[0-9]|[)][0-9]"
)

# Prose is refused without a parser. The part before the finding holds no quote
# and no comment sign, so the finding is outside any string, and it is a syntax
# error wherever it stands:
#  - two names next to each other, neither of them an operator word;
#  - a name glued to a quote that is not a string prefix (``Let's``);
#  - a character that starts no token, or a stray backslash;
#  - a first or last character that cannot be one.
# Every character beyond ASCII counts as part of a name: it either is, or is an
# error itself.
_OPERATOR_WORD = r"(?:and|or|not|in|is|if|else|lambda|for|async|await|yield|from)\b"
_STRING_PREFIX = r"(?i:[rbutf]|br|rb|fr|rf)['\"]"
_START = r"[A-Za-z_\x80-\uFFFF]"
_PART = r"[A-Za-z0-9_\x80-\uFFFF]"
PROSE = (
    r"^(?:[<>=%&|^,;:)\]}/@]|[^'\"#]*?(?:"
    rf"(?<!{_PART})(?={_START})(?!{_OPERATOR_WORD}|{_STRING_PREFIX}){_PART}++"
    rf"(?:[ \t\n]++(?!{_OPERATOR_WORD}){_START}|['\"])"
    r"|[$?`\xD7\xF7\u2010-\u2027\u20AC\u2190-\u22FF]"
    r"|!(?!=)|\\[^\n\r]"
    r"|[-+*/%@&|^~<>=({\[]$))"
)


def _balanced(text: Column) -> Column:
    """ok / bad / other by parentheses alone, by removing innermost pairs."""
    rest = F.translate(text, "0123456789+-*/ \t", "")
    for _ in range(NATIVE_DEPTH):
        rest = F.replace(rest, F.lit("()"), F.lit(""))
    return F.when(rest == "", OK).when(rest.contains("()"), OTHER).otherwise(BAD)


def grammar_status(text: Column) -> Column:
    """``ok``: a valid plain expression; ``bad``: valid in no way; ``other``: ask the host grammar.

    NULL for NULL.
    """
    nesting = F.when(text.contains("(") | text.contains(")"), _balanced(text)).otherwise(OK)
    return (
        F.when(text.isNull(), None)
        .when(text.rlike(COMMON), nesting)
        .when(~text.rlike(PLAIN), F.when(text.rlike(PROSE), BAD).otherwise(OTHER))
        .when(text.rlike(UNUSUAL), OTHER)
        .when(text.rlike(MISPLACED), BAD)
        .otherwise(nesting)
    )


def exactly_evaluable(text: Column) -> Column:
    """Few enough digits that doubles hold every intermediate integer exactly.

    For texts :func:`grammar_status` calls ``ok``.
    """
    return F.length(F.translate(text, "+-*/() \t", "")) <= EXACT_DIGITS


def equation_numbers(text: Column) -> Column:
    """The integer literals in order of appearance; a sign is not part of them."""
    return F.transform(
        F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda d: d.try_cast("bigint")
    )


def _signed(text: Column) -> Column:
    """The expression without blanks, signs folded: ``3 - -(4)`` gives ``3--(4)``, ``3 - -+-4`` gives ``3-4``."""
    compact = F.translate(text, " \t", "")
    no_plus = F.regexp_replace(compact, r"(?<![0-9)])\+", "")
    marked = F.regexp_replace(no_plus, r"(?<![0-9)])-", "~")
    signed = F.translate(F.replace(marked, F.lit("~~"), F.lit("")), "~", "-")
    return F.when(compact.rlike(r"(?<![0-9)])[-+]"), signed).otherwise(compact)


def _operands(text: Column) -> Column:
    """Tokens of a valid expression, each operand with the operator before it.

    Signs that are not binary become part of the operand: ``3 - -(4)`` gives
    ``3``, ``--(``, ``4``, ``)``.
    """
    return F.regexp_extract_all(_signed(text), F.lit(r"[-+*/]?-?(?:[0-9]+|[(])|[)]"), F.lit(0))


def _evaluate_flat(text: Column) -> Column:
    """:func:`evaluate_native` of an expression without parentheses: a running sum and an open product."""

    def state(s, t, zero):
        return F.struct(s.alias("s"), t.alias("t"), zero.alias("zero"))

    def step(acc, token):
        op = F.substring(token, 1, 1)
        s, t, zero = acc["s"], acc["t"], acc["zero"]
        v = F.when(op.isin("+", "-", "*", "/"), F.substring(token, 2, 20)).otherwise(token).cast("double")
        return (
            F.when(op == "*", state(s, t * v, zero))
            .when(op == "/", state(s, F.try_divide(t, v), zero | (v == 0)))
            .when(op == "-", state(s + t, -v, zero))
            .otherwise(state(s + t, v, zero))
        )

    # The first operand has no operator; a sign of its own would pass for one.
    tokens = F.regexp_extract_all(
        F.concat(F.lit("+"), _signed(text)), F.lit(r"[-+*/]-?[0-9]+"), F.lit(0)
    )
    start = state(F.lit(0.0), F.lit(0.0), F.lit(False))
    return F.aggregate(tokens, start, step, _finished)


def _finished(acc: Column) -> Column:
    return F.struct(
        F.when(~acc["zero"], acc["s"] + acc["t"] + 0.0).alias("value"), acc["zero"].alias("zero_division")
    )


_FRAME = "struct<s:double,t:double,op:string,sign:double>"


def evaluate_native(text: Column) -> Column:
    """struct<value, zero_division> of an expression :func:`grammar_status` calls ``ok``.

    Exact for those :func:`exactly_evaluable`; :func:`evaluate_exact` takes longer ones.
    """
    return F.when(text.contains("("), _evaluate_nested(text)).otherwise(_evaluate_flat(text))


def _evaluate_nested(text: Column) -> Column:
    """One left-to-right fold. ``s`` is the finished part of the running sum and
    ``t`` the open product, so no precedence pass is needed and rounding follows
    the written order. An open parenthesis sets both aside on ``stack``.
    """

    def state(stack, s, t, zero):
        return F.struct(stack.alias("stack"), s.alias("s"), t.alias("t"), zero.alias("zero"))

    def combine(op, stack, s, t, v, zero):
        return (
            F.when(op == "*", state(stack, s, t * v, zero))
            .when(
                op == "/",
                state(stack, s, F.when(v == 0, F.lit(0.0)).otherwise(t / v), zero | (v == 0)),
            )
            .when(op == "-", state(stack, s + t, -v, zero))
            .otherwise(state(stack, s + t, v, zero))
        )

    def step(acc, token):
        lead = F.substring(token, 1, 1)
        led = lead.isin("+", "-", "*", "/")
        number = F.when(led, F.substring(token, 2, 20)).otherwise(token).cast("double")
        frame = F.struct(
            acc["s"].alias("s"),
            acc["t"].alias("t"),
            F.when(led, lead).otherwise("+").alias("op"),
            F.when(token.rlike(r"^.-"), -1.0).otherwise(1.0).alias("sign"),
        )
        top = F.get(acc["stack"], F.lit(0))
        below = F.slice(acc["stack"], F.lit(2), F.size(acc["stack"]) - 1)
        group = top["sign"] * (acc["s"] + acc["t"])
        return (
            F.when(
                token.endswith("("),
                state(
                    F.concat(F.array(frame), acc["stack"]), F.lit(0.0), F.lit(0.0), acc["zero"]
                ),
            )
            .when(token == ")", combine(top["op"], below, top["s"], top["t"], group, acc["zero"]))
            .otherwise(combine(lead, acc["stack"], acc["s"], acc["t"], number, acc["zero"]))
        )

    start = state(
        F.array().cast(f"array<{_FRAME}>"), F.lit(0.0), F.lit(0.0), F.lit(False)
    )

    return F.aggregate(_operands(text), start, step, _finished)


_WHOLE = "decimal(38,0)"
_NUMBER_TYPE = f"struct<i:{_WHOLE},d:double>"
_EXACT_FRAME = f"struct<s:{_NUMBER_TYPE},t:{_NUMBER_TYPE},op:string,negative:boolean>"
# Up to here the quotient of two integers, taken as doubles, is rounded once.
_DOUBLE_RANGE = 1 << 53


def _number(i: Column, d: Column) -> Column:
    """An integer ``i`` or a float ``d``; neither where columns can't tell the value."""
    return F.struct(i.cast(_WHOLE).alias("i"), d.cast("double").alias("d"))


def _as_float(x: Column) -> Column:
    return F.coalesce(x["d"], x["i"].cast("double"))


def _joined(x: Column, y: Column, whole, floating) -> Column:
    """Two integers give an integer, NULL beyond 38 digits; else both count as floats."""
    both = x["i"].isNotNull() & y["i"].isNotNull()
    return _number(
        F.when(both, whole(x["i"], y["i"])), F.when(~both, floating(_as_float(x), _as_float(y)))
    )


def _sum(x: Column, y: Column) -> Column:
    return _joined(x, y, F.try_add, lambda a, b: a + b)


def _product(x: Column, y: Column) -> Column:
    return _joined(x, y, F.try_multiply, lambda a, b: a * b)


def _quotient(x: Column, y: Column) -> Column:
    """Always a float; NULL for integers that doubles don't hold."""
    small = (F.abs(x["i"]) <= _DOUBLE_RANGE) & (F.abs(y["i"]) <= _DOUBLE_RANGE)
    known = x["d"].isNotNull() | y["d"].isNotNull() | small
    return _number(F.lit(None), F.when(known, F.try_divide(_as_float(x), _as_float(y))))


def _negative(x: Column) -> Column:
    return _number(-x["i"], -x["d"])


def _is_zero(x: Column) -> Column:
    return F.coalesce(x["i"] == 0, x["d"] == 0.0, F.lit(False))


def evaluate_exact(text: Column) -> Column:
    """struct<value, zero_division, whole> of an ``ok`` expression of any number of digits, as the host evaluates it.

    Integers stay integers of up to 38 digits until a division, from where on
    values are floats. ``whole`` is the value where it is an integer. ``value`` is
    NULL beside a division by zero and where columns can't tell: an integer
    of more digits, or a quotient of integers beyond 2**53.
    """

    def state(stack, s, t, zero):
        return F.struct(stack.alias("stack"), s.alias("s"), t.alias("t"), zero.alias("zero"))

    nought = _number(F.lit(0), F.lit(None))

    def combine(op, stack, s, t, v, zero):
        return (
            F.when(op == "*", state(stack, s, _product(t, v), zero))
            .when(op == "/", state(stack, s, _quotient(t, v), zero | _is_zero(v)))
            .when(op == "-", state(stack, _sum(s, t), _negative(v), zero))
            .otherwise(state(stack, _sum(s, t), v, zero))
        )

    def step(acc, token):
        lead = F.substring(token, 1, 1)
        led = lead.isin("+", "-", "*", "/")
        literal = F.when(led, F.substring(token, 2, LITERAL_DIGITS + 1)).otherwise(token)
        frame = F.struct(
            acc["s"].alias("s"), acc["t"].alias("t"),
            F.when(led, lead).otherwise("+").alias("op"), token.rlike(r"^.-").alias("negative"),
        )
        top = F.get(acc["stack"], F.lit(0))
        below = F.slice(acc["stack"], F.lit(2), F.size(acc["stack"]) - 1)
        inside = _sum(acc["s"], acc["t"])
        group = F.when(top["negative"], _negative(inside)).otherwise(inside)
        opened = state(F.concat(F.array(frame), acc["stack"]), nought, nought, acc["zero"])
        number = _number(literal, F.lit(None))
        return (
            F.when(token.endswith("("), opened)
            .when(token == ")", combine(top["op"], below, top["s"], top["t"], group, acc["zero"]))
            .otherwise(combine(lead, acc["stack"], acc["s"], acc["t"], number, acc["zero"]))
        )

    def finished(acc):
        total = _sum(acc["s"], acc["t"])
        return F.struct(
            F.when(~acc["zero"], _as_float(total) + 0.0).alias("value"),
            acc["zero"].alias("zero_division"),
            F.when(~acc["zero"], total["i"]).alias("whole"),
        )

    start = state(F.array().cast(f"array<{_EXACT_FRAME}>"), nought, nought, F.lit(False))
    return F.aggregate(_operands(text), start, step, finished)


def number_match(equation_nums: Column, nums: Column) -> Column:
    """Same numbers, each the same number of times."""
    return F.sort_array(equation_nums) == F.sort_array(nums)


def within_tolerance(value: Column, target: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(value - target) <= F.lit(tolerance)
