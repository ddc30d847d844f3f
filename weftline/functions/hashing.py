"""Pseudo-random columns that any SQL engine can repeat: three steps modulo a Mersenne prime, in 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
_FIRST, _SECOND, _SEED, _SPREAD = 48271, 69621, 16807, 30011


def pseudo(x: Column | str, seed: int = 0) -> Column:
    """0 to MODULUS - 1, the same for equal x and seed; x is a non-negative long."""
    x = F.col(x) if isinstance(x, str) else x
    first = (x % MODULUS * _FIRST + seed * _SEED + 11) % MODULUS
    mixed = first * (first % _SPREAD + 1) % MODULUS  # not linear, so that pairs of values fill the plane
    return (mixed * _SECOND + 7) % MODULUS


def pseudo_sql(x: str, seed: int = 0) -> str:
    """The same in SQL."""
    first = f"((CAST({x} AS BIGINT) % {MODULUS} * {_FIRST} + {seed * _SEED + 11}) % {MODULUS})"
    return f"((({first} * ({first} % {_SPREAD} + 1) % {MODULUS}) * {_SECOND} + 7) % {MODULUS})"
