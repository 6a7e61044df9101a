"""Arithmetic over series A to Z as a column expression."""

from __future__ import annotations

import ast

from pyspark.sql import Column, functions as F

MAX_LENGTH = 500


def formula(source: str, series: list[Column]) -> Column:
    """Compile ``source``; dividing by zero gives 0."""
    if len(source) > MAX_LENGTH:
        raise ValueError("formula is too long")
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"invalid formula {source!r}") from error
    return _column(tree, series)


def _column(node: ast.expr, series: list[Column]) -> Column:
    match node:
        case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
            return F.lit(float(number))
        case ast.Name(id=name) if len(name) == 1 and name.isalpha() and name.isascii():
            position = ord(name.upper()) - ord("A")
            if position >= len(series):
                raise ValueError(f"formula names a missing series {name}")
            return series[position]
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_column(inner, series)
        case ast.BinOp(left=left, op=op, right=right):
            a, b = _column(left, series), _column(right, series)
            match op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    raise ValueError("formulas take series letters, numbers, + - * / and parentheses")
