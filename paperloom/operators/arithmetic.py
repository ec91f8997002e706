"""Arithmetic expressions as data: a tokeniser and a two-stack evaluation by precedence, inside one column expression.

Numbers are doubles. Binary + - * / ** and unary + - are known, ** binds to the right and tighter than a sign before it. Whatever else
an expression holds makes an error, which is a value: nothing is raised.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, and operators by precedence. A sign stands between * and **.
TOKEN = r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\*\*|[-+*/()]|\S"
NUMBER = r"^(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
LEVELS = (("+", 1), ("-", 1), ("*", 2), ("/", 2), ("neg", 3), ("pos", 3), ("**", 4))
STATE = "struct<values:array<double>,ops:array<string>,operand:boolean,error:string>"


def level(op: Column) -> Column:
    found = F.lit(0)
    for name, value in LEVELS:
        found = F.when(op == name, value).otherwise(found)
    return found


def top(stack: Column, depth: int = 1) -> Column:
    return F.try_element_at(stack, F.lit(-depth))


def popped(stack: Column, n: Column | int = 1) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - n, F.lit(0)))


def state(values: Column, ops: Column, operand: Column, error: Column) -> Column:
    return F.struct(values.alias("values"), ops.alias("ops"), operand.alias("operand"), error.alias("error")).cast(STATE)


def applied(s: Column) -> Column:
    """The state after its last operator has met its operands."""
    op, a, b = top(s["ops"]), top(s["values"], 2), top(s["values"])
    unary = op.isin("neg", "pos")
    error = F.when((op == "/") & (b == 0), "division by zero").when((op == "**") & (a == 0) & (b < 0), "division by zero").when((op == "**") & (a < 0) & (b != F.floor(b)), "no real result")
    result = F.when(op == "neg", -b).when(op == "pos", b).when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b)).otherwise(F.pow(a, b))
    result = F.when(error.isNull(), result)
    over = error.isNull() & (F.isnan(result) | (F.abs(result) == float("inf")))
    values = F.concat(popped(s["values"], F.when(unary, 1).otherwise(2)), F.array(F.coalesce(result, F.lit(0.0))))
    return state(values, popped(s["ops"]), s["operand"], F.coalesce(s["error"], error, F.when(over, "too large")))


def reduced(s: Column, ready) -> Column:
    """The state after all operators on its top, one after the other, for which ready() holds; a stack holds as many as it has places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(s["ops"]), F.lit(1))), s, lambda t, _: F.when((F.size(t["ops"]) > 0) & t["error"].isNull() & ready(top(t["ops"])), applied(t)).otherwise(t))


def calculate(expression: Column) -> Column:
    """A struct of result (null where there is an error) and error (null where there is none). Null and blank expressions are empty."""
    tokens = F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(TOKEN), F.lit(0))
    start = F.expr(f"cast(named_struct('values', array(), 'ops', array(), 'operand', false, 'error', null) as {STATE})")

    def fail(s: Column, why: str) -> Column:
        return state(s["values"], s["ops"], s["operand"], F.coalesce(s["error"], F.lit(why)))

    def push(s: Column, op: Column, operand: bool) -> Column:
        return state(s["values"], F.concat(s["ops"], F.array(op)), F.lit(operand), s["error"])

    def step(s: Column, t: Column) -> Column:
        number = F.when(s["operand"], fail(s, "operator missing")).otherwise(state(F.concat(s["values"], F.array(t.try_cast("double"))), s["ops"], F.lit(True), s["error"]))
        sign = F.when(t == "-", "neg").otherwise("pos")
        binary = push(reduced(s, lambda op: F.when(t == "**", F.lit(False)).otherwise(level(op) >= level(t))), t, False)
        closed = reduced(s, lambda op: op != "(")
        opened = F.size(closed["ops"]) > 0
        shut = F.when(opened, state(closed["values"], popped(closed["ops"]), F.lit(True), closed["error"])).otherwise(fail(closed, "unbalanced parentheses"))
        return (
            F.when(s["error"].isNotNull(), s).when(t.rlike(NUMBER), number).when(t == "(", F.when(s["operand"], fail(s, "operator missing")).otherwise(push(s, t, False)))
            .when(t == ")", F.when(s["operand"], shut).otherwise(fail(s, "operand missing"))).when(~t.isin("+", "-", "*", "/", "**"), fail(s, "unknown token"))
            .when(s["operand"], binary).when(t.isin("+", "-"), push(s, sign, False)).otherwise(fail(s, "operand missing"))
        )

    def finish(s: Column) -> Column:
        done = reduced(s, lambda op: op != "(")
        left = F.when(F.size(done["ops"]) > 0, "unbalanced parentheses")
        error = F.coalesce(s["error"], F.when(F.size(tokens) == 0, "empty"), F.when(~s["operand"], "operand missing"), done["error"], left)
        return F.struct(F.when(error.isNull(), F.get(done["values"], F.lit(0))).alias("result"), error.alias("error"))

    return F.aggregate(tokens, start, step, finish)
