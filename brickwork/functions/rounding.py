"""Weighted sums in exact decimals: one rule for all scores, the same on any engine."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_sum(weights: dict[str, float], parts: Column | dict[str, Column]) -> Column:
    """The sum of parts by weight, as a decimal; a part counts to four places. Null if a part is null."""
    return reduce(lambda a, b: a + b, [F.lit(Decimal(str(w))) * parts[k].cast("decimal(18,4)") for k, w in weights.items()])


def half_even(total: Column, places: int = 1) -> Column:
    """A decimal rounded to so many places, ties to the even digit, as a double."""
    return F.bround(total, places).cast("double")


def weighted_sql(weights: dict[str, float], parts: dict[str, str], places: int = 1, within: tuple[int, int] = (0, 100)) -> str:
    """The same in SQL by whole numbers, for sums of 0 and more: millionths, of which the last digits decide."""
    total = " + ".join(f"{round(w * 100)} * CAST(round(({parts[k]}) * 10000) AS BIGINT)" for k, w in weights.items())
    unit = 10 ** (6 - places)
    t = f"least(greatest({total}, {within[0] * 10**6}), {within[1] * 10**6})"
    return f"(CASE WHEN 2 * ({t} % {unit}) > {unit} OR (2 * ({t} % {unit}) = {unit} AND ({t} // {unit}) % 2 = 1) THEN {t} // {unit} + 1 ELSE {t} // {unit} END / {10**places}.0)::DOUBLE"
