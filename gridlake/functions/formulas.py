"""formulas of metrics and arithmetic of answers, parsed once and compiled to a Column."""

from __future__ import annotations

import ast
import decimal
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..constants import FORMULAS

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}


def _remainder(a: Column, b: Column) -> Column:
    """The remainder of floor division: with the sign of the divisor; null for a zero divisor."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((b < 0) != (rest < 0)), rest + b).otherwise(rest)


def _floor_divided(a: Column, b: Column) -> Column:
    """Floor division in doubles, whatever their size: (a - remainder) / b, set to the nearest whole number."""
    quotient = F.try_divide(a - _remainder(a, b), b)
    whole = F.when(F.abs(quotient) < 2.0**53, F.floor(quotient).cast("double")).otherwise(quotient)
    return F.when(quotient - whole > 0.5, whole + 1).otherwise(whole)


def _rounded(digits: int | None):
    """Half to even of the number itself, not of its shortest text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([None if v is None else float(round(v, digits)) if v - v == 0 else v for v in x.to_pylist()], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


#: What answers may use beside: floor division, remainders with the sign of the divisor, powers, and five functions.
_MORE = {ast.FloorDiv: _floor_divided, ast.Mod: _remainder, ast.Pow: F.pow}
_CALLS = {
    "abs": (1, 1, lambda x: F.abs(x)),
    "min": (1, None, lambda *x: F.least(*x) if len(x) > 1 else x[0]),
    "max": (1, None, lambda *x: F.greatest(*x) if len(x) > 1 else x[0]),
    "sum": (1, None, lambda *x: sum(x[1:], x[0])),
}
_UNARY = {ast.UAdd: lambda x: x, ast.USub: lambda x: -x}


class FormulaError(ValueError):
    """The expression uses something other than names, numbers, + - * / and signs."""


def variables(expression: str) -> list[str]:
    """Names of an expression in the order of their first use; raises FormulaError as compiled() does."""
    compiled(expression)
    names = [n for n in ast.walk(ast.parse(expression, mode="eval")) if isinstance(n, ast.Name)]
    return list(dict.fromkeys(n.id for n in sorted(names, key=lambda n: n.col_offset)))


def compiled(expression: str, columns: dict[str, Column] | None = None, answers: bool = False) -> Column:
    """The expression over columns of the same names (or those given); a zero denominator gives null.

    answers allows // % ** and abs, round (half to even), min, max, sum as well; they compute as Python does in floats, but
    for what is an error there (a zero divisor), which is null.
    """
    try:
        tree = ast.parse(expression, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(expression) from e

    def column(node: ast.expr) -> Column:
        match node:
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](column(a), column(b))
            case ast.BinOp(left=a, op=op, right=b) if answers and type(op) in _MORE:
                return _MORE[type(op)](column(a), column(b))
            case ast.Call(func=ast.Name(id="round"), args=[a], keywords=[]) if answers:
                return _rounded(None)(column(a))
            case ast.Call(func=ast.Name(id="round"), args=[a, ast.Constant(value=int() as digits)], keywords=[]) if answers:
                return _rounded(digits)(column(a))
            case ast.Call(func=ast.Name(id=name), args=[*args], keywords=[]) if answers and name in _CALLS:
                least, most, f = _CALLS[name]
                if len(args) < least or (most and len(args) > most):
                    raise FormulaError(f"{name} takes other arguments")
                return f(*map(column, args))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
                return _UNARY[type(op)](column(a))
            case ast.Name(id=name):
                if columns is not None and name not in columns:
                    raise FormulaError(f"unknown name {name}")
                return columns[name] if columns else F.col(name)
            case ast.Constant(value=bool()):
                raise FormulaError("truth values are no numbers")
            case ast.Constant(value=int() | float() as value):
                return F.lit(float(value))
        raise FormulaError(f"{type(node).__name__} is not allowed")

    return column(tree)


def derived(formula_id: str) -> tuple[Column, list[str]]:
    """A catalogued formula and its variables."""
    return compiled(FORMULAS[formula_id]), variables(FORMULAS[formula_id])


#: Significant digits that each step of a decimal formula keeps, half to even.
PRECISION = 28
_EXACT = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def _value(node: ast.expr, values: dict[str, decimal.Decimal]) -> decimal.Decimal:
    match node:
        case ast.Name(id=name):
            return values[name]
        case ast.Constant(value=value):
            return decimal.Decimal(str(value))
        case ast.UnaryOp(op=op, operand=a):
            return _UNARY[type(op)](_value(a, values))
        case ast.BinOp(left=a, op=op, right=b):
            return _EXACT[type(op)](_value(a, values), _value(b, values))
    raise FormulaError(type(node).__name__)


def exact(expression: str, columns: dict[str, Column] | None = None) -> Column:
    """struct (value, text, status) of an expression over decimals.

    Each step keeps PRECISION significant digits, half to even, which no type of fixed scale can do, so batches of rows are
    computed in Python's decimals; columns may be decimals, numbers or their texts.  text is the result as it is, value the
    same as decimal(38, 12), half to even, null where it has more than 26 digits before the point.  status is available,
    missing (an input is null or no number) or not_meaningful (a zero denominator).
    """
    names = variables(expression)
    tree = ast.parse(expression, mode="eval").body
    if columns is not None and set(names) - set(columns):
        raise FormulaError(f"unknown names {sorted(set(names) - set(columns))}")
    step = decimal.Decimal(1).scaleb(-12)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        context, wide = decimal.Context(prec=PRECISION, rounding=decimal.ROUND_HALF_EVEN), decimal.Context(prec=38, rounding=decimal.ROUND_HALF_EVEN)
        for arrays in batches:
            rows = []
            with decimal.localcontext(context):
                for given in zip(*(a.to_pylist() for a in arrays), strict=True):
                    try:
                        values = {n: decimal.Decimal(x) for n, x in zip(names, given, strict=True)}
                        if not all(v.is_finite() for v in values.values()):
                            raise decimal.InvalidOperation
                    except (TypeError, decimal.InvalidOperation):
                        rows.append({"value": None, "text": None, "status": C.MISSING})
                        continue
                    try:
                        result = _value(tree, values)
                    except (ZeroDivisionError, decimal.InvalidOperation):
                        rows.append({"value": None, "text": None, "status": C.NOT_MEANINGFUL})
                        continue
                    try:
                        value = result.quantize(step, context=wide)
                    except decimal.InvalidOperation:
                        value = None
                    rows.append({"value": value, "text": str(result), "status": C.AVAILABLE})
            yield pa.array(rows, pa.struct([("value", pa.decimal128(38, 12)), ("text", pa.string()), ("status", pa.string())]))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    inputs = [(F.col(n) if columns is None else columns[n]).cast("string") for n in names]
    if not inputs:
        raise FormulaError("a formula needs an input")
    return F.arrow_udf(run, "value decimal(38,12), text string, status string")(*inputs)
