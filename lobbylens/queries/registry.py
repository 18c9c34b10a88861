"""Collects checked queries: name -> (DataFrame function, check SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results are rounded for comparison at a point that exact decimal ties miss, so
# that the last bit of a sum cannot flip a digit.
OFF_TIE = 0.5123456789


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def register(function):
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return register


def num(value: Column, digits: int = 6) -> Column:
    """Round by floor, which any engine reproduces bit for bit."""
    scale = 10.0**digits
    return F.floor(value * F.lit(scale) + F.lit(OFF_TIE)) / F.lit(scale)


def num_text(value: str, digits: int = 6) -> str:
    """The same rounding as expression text."""
    scale = f"{10.0**digits}D"
    return f"floor(({value}) * {scale} + {OFF_TIE}D) / {scale}"
