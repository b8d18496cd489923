"""Expressions that Spark SQL and other engines evaluate alike, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_sql(key: str, salt: int = 0) -> str:
    """A pseudo-random BIGINT below 2^31 from an integer expression: two linear congruential steps, halves swapped between."""
    one = f"((({key}) % 2147483648) * 1103515245 + {12345 + salt * 40503}) % 2147483648"
    swapped = f"(({one}) % 65536) * 32768 + cast((({one}) - (({one}) % 65536)) / 65536 as bigint)"
    return f"((({swapped}) * 1103515245 + 12345) % 2147483648)"


def draw(key: str, salt: int = 0) -> Column:
    return F.expr(draw_sql(key, salt))


def uniform_sql(key: str, salt: int = 0) -> str:
    """A number in [0, 1) from an integer expression."""
    return f"({draw_sql(key, salt)} / 2147483648.0e0)"


def uniform(key: str, salt: int = 0) -> Column:
    return F.expr(f"cast({uniform_sql(key, salt)} as double)")


def pack_bits(bins: list[Column], width: int) -> Column:
    """Bins of one row in a BIGINT, the first in the lowest bits; saturates at the width."""
    if len(bins) * width > 63:
        raise ValueError("more than 63 bits in one word")
    out = F.lit(0).cast("long")
    for i, b in enumerate(bins):
        out = out.bitwiseOR(F.shiftleft(F.greatest(F.least(b.cast("long"), F.lit((1 << width) - 1)), F.lit(0)), i * width))
    return out


def unpack_bits(word: Column, width: int, n: int) -> list[Column]:
    return [F.shiftrightunsigned(word, i * width).bitwiseAND((1 << width) - 1) for i in range(n)]


def bits_required(largest: Column) -> Column:
    """Bits that hold integers up to the given one; at least one."""
    return F.greatest(F.lit(1), F.length(F.bin(largest))).cast("int")


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    d = b * precision + recall
    return F.when(d > 0, (1 + b) * precision * recall / d).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))
