"""Verdicts as functions of SQL, with bodies that Spark inlines.

``verify_plain_equation`` is columns alone. ``verify_equation`` is the same and asks the
host grammar in an Arrow stage, but only about the texts that the columns leave
undecided: all others reach that stage as NULL.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from abacist.functions import arithmetic as A
from abacist.functions import text as T
from abacist.functions.residual import DIVISION, SYNTAX_DETAIL, judge_first

VERDICT = "STRUCT<ok BOOLEAN, code STRING, detail STRING, result DOUBLE>"
_VALUE = "STRUCT<value DOUBLE, zero_division BOOLEAN>"
_FRAME = "ARRAY<STRUCT<s:DOUBLE,t:DOUBLE,op:STRING,sign:DOUBLE>>"


def _text(value: str) -> str:
    """``value`` as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t").replace("\n", "\\n") + "'"


def _state(s: str, t: str, zero: str, stack: str | None = None) -> str:
    return f"named_struct({f'{_text('stack')}, {stack}, ' if stack else ''}'s', {s}, 't', {t}, 'zero', {zero})"


def _step(op: str, s: str, t: str, v: str, zero: str, stack: str | None = None) -> str:
    """The state after ``v`` is joined to the running sum ``s`` and open product ``t`` by ``op``."""
    return f"""CASE {op}
        WHEN '*' THEN {_state(s, f"{t} * {v}", zero, stack)}
        WHEN '/' THEN {_state(s, f"CASE WHEN {v} = 0 THEN 0D ELSE {t} / {v} END", f"{zero} OR {v} = 0", stack)}
        WHEN '-' THEN {_state(f"{s} + {t}", f"-{v}", zero, stack)}
        ELSE {_state(f"{s} + {t}", v, zero, stack)} END"""


_FINISH = "acc -> named_struct('value', IF(acc.zero, NULL, acc.s + acc.t + 0D), 'zero_division', acc.zero)"


def _flat(signed: str) -> str:
    """An expression without parentheses: each token is an operator and a number."""
    tokens = f"regexp_extract_all(concat('+', {signed}), {_text('[-+*/]-?[0-9]+')}, 0)"
    step = _step("left(x, 1)", "acc.s", "acc.t", "CAST(substring(x, 2) AS DOUBLE)", "acc.zero")
    return f"aggregate({tokens}, {_state('0D', '0D', 'FALSE')}, (acc, x) -> {step}, {_FINISH})"


def _nested(signed: str) -> str:
    """One fold; an open parenthesis sets the sum and the product aside."""
    tokens = f"regexp_extract_all({signed}, {_text('[-+*/]?-?(?:[0-9]+|[(])|[)]')}, 0)"
    led = "left(x, 1) IN ('+', '-', '*', '/')"
    frame = f"""named_struct('s', acc.s, 't', acc.t, 'op', IF({led}, left(x, 1), '+'),
        'sign', IF(x RLIKE '^.-', -1D, 1D))"""
    number = f"CAST(IF({led}, substring(x, 2), x) AS DOUBLE)"
    closed = _step("acc.stack[0].op", "acc.stack[0].s", "acc.stack[0].t", "(acc.stack[0].sign * (acc.s + acc.t))",
                   "acc.zero", "slice(acc.stack, 2, size(acc.stack))")
    joined = _step("left(x, 1)", "acc.s", "acc.t", number, "acc.zero", "acc.stack")
    opened = _state("0D", "0D", "acc.zero", f"concat(array({frame}), acc.stack)")
    start = _state("0D", "0D", "FALSE", f"CAST(array() AS {_FRAME})")
    step = f"CASE WHEN endswith(x, '(') THEN {opened} WHEN x = ')' THEN {closed} ELSE {joined} END"
    return f"aggregate({tokens}, {start}, (acc, x) -> {step}, {_FINISH})"


def _bodies(name: str, plain: str, grammar: str, tolerance: float) -> list[tuple[str, str, str, str]]:
    """(name, parameters, result, body) of the functions, each of which uses those before it."""
    rest = f"translate(e, {_text('0123456789+-*/ \t')}, '')"
    for _ in range(A.NATIVE_DEPTH):
        rest = f"replace({rest}, '()', '')"
    own = {k: f"{plain}_{k}" for k in ("balance", "status", "signs", "value", "judge")}
    balance = f"CASE WHEN rest = '' THEN '{A.OK}' WHEN contains(rest, '()') THEN '{A.OTHER}' ELSE '{A.BAD}' END"
    nesting = f"IF(contains(e, '(') OR contains(e, ')'), {own['balance']}({rest}), '{A.OK}')"
    status = f"""CASE WHEN e IS NULL OR e = '' THEN 'invalid'
        WHEN e RLIKE {_text(A.COMMON)} THEN {nesting}
        WHEN NOT e RLIKE {_text(A.PLAIN)} THEN IF(e RLIKE {_text(A.PROSE)}, '{A.BAD}', '{A.OTHER}')
        WHEN e RLIKE {_text(A.UNUSUAL)} THEN '{A.OTHER}'
        WHEN e RLIKE {_text(A.MISPLACED)} THEN '{A.BAD}'
        ELSE {nesting} END"""
    few = f"length(translate(e, {_text('+-*/() \t')}, '')) <= {A.EXACT_DIGITS}"
    unary = _text("(?<![0-9)])-")
    no_plus = f"regexp_replace(translate(e, {_text(' \t')}, ''), {_text('(?<![0-9)])[+]')}, '')"
    signs = f"translate(replace(regexp_replace({no_plus}, {unary}, '~'), '~~', ''), '~', '-')"
    value = f"""CASE WHEN status <> '{A.OK}' THEN NULL WHEN contains(signed, '(') THEN {_nested("signed")}
        ELSE {_flat("signed")} END"""
    numbers = f"transform(regexp_extract_all(e, '[0-9]+', 0), d -> try_cast(d AS BIGINT))"
    code = f"""CASE WHEN status = '{A.BAD}' THEN 'syntax' WHEN status <> '{A.OK}' THEN status
        WHEN v.zero_division THEN 'processing' WHEN NOT coalesce(same, FALSE) THEN 'numbers'
        WHEN abs(v.value - target) <= {tolerance!r} THEN 'ok' ELSE 'value' END"""
    verdict = f"""named_struct('ok', code = 'ok', 'code', code,
        'detail', CASE code WHEN 'processing' THEN {_text(DIVISION)} WHEN 'syntax' THEN {_text(SYNTAX_DETAIL)} END,
        'result', IF(code IN ('ok', 'value'), value, NULL))"""
    e = f"btrim(equation, {_text(T.BLANK)})"
    settled = f"IF({own['status']}({e}) = '{A.OK}' AND NOT {few.replace('(e,', f'({e},')}, '{A.OTHER}', {own['status']}({e}))"
    asked = "STRING, nums ARRAY<BIGINT>, target BIGINT"
    question = f"""CASE WHEN verdict.code = '{A.OTHER}'
        THEN to_json(named_struct('texts', array({e}), 'nums', nums, 'target', target)) END"""
    return [
        (own["balance"], "rest STRING", "STRING", balance),
        (own["status"], "e STRING", "STRING", status),
        (own["signs"], "e STRING", "STRING", signs),
        (own["value"], "status STRING, signed STRING", _VALUE, value),
        (f"{plain}_code", f"status STRING, v {_VALUE}, same BOOLEAN, target BIGINT", "STRING", code),
        (f"{plain}_verdict", "code STRING, value DOUBLE", VERDICT, verdict),
        (
            own["judge"],
            f"e STRING, status STRING, v {_VALUE}, nums ARRAY<BIGINT>, target BIGINT",
            VERDICT,
            f"{plain}_verdict({plain}_code(status, v, sort_array({numbers}) = sort_array(nums), target), v.value)",
        ),
        (f"{plain}_settled", "e STRING, status STRING, nums ARRAY<BIGINT>, target BIGINT", VERDICT,
         f"{own['judge']}(e, status, {own['value']}(status, {own['signs']}(e)), nums, target)"),
        (plain, f"equation {asked}", VERDICT, f"{plain}_settled({e}, {settled}, nums, target)"),
        (f"{name}_asked", f"equation {asked}, verdict {VERDICT}", VERDICT, f"coalesce({grammar}({question}), verdict)"),
        (name, f"equation {asked}", VERDICT, f"{name}_asked(equation, nums, target, {plain}(equation, nums, target))"),
    ]


def _grammar(tolerance: float):
    """The Arrow function behind ``verify_equation``; NULL for NULL."""
    shape = pa.struct([("ok", pa.bool_()), ("code", pa.string()), ("detail", pa.string()), ("result", pa.float64())])

    @F.arrow_udf("struct<ok:boolean, code:string, detail:string, result:double>")
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for questions in batches:
                rows = [None] * len(questions)
                asked = pc.indices_nonzero(questions.is_valid())
                for i, question in zip(asked.to_pylist(), questions.take(asked).to_pylist()):
                    q = json.loads(question)
                    _, code, detail, result = judge_first(q["texts"], q.get("nums"), q.get("target"), tolerance)
                    rows[i] = {"ok": code == "ok", "code": code, "detail": detail, "result": result}
                yield pa.array(rows, type=shape)

    return ask.asNondeterministic()


def register_sql(
    spark: SparkSession, name: str = "verify_equation", plain: str = "verify_plain_equation", tolerance: float = 1e-6
) -> None:
    """Make ``name(equation, nums, target)`` and ``plain`` of the same arguments callable from SQL.

    Both give struct<ok, code, detail, result>. ``plain`` takes no row out of the JVM and
    says ``other`` as the code of a text that it can't settle; ``name`` asks the host
    grammar about those. NULL and blank equations are ``invalid``. The functions
    last as long as the session, with helpers that carry these names as a prefix.
    """
    grammar = f"{name}_by_grammar"
    spark.udf.register(grammar, _grammar(tolerance))
    for own, parameters, result, body in _bodies(name, plain, grammar, tolerance):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {own}({parameters}) RETURNS {result} RETURN {body}")
