"""Averages and medians that give the same answer on any partitioning."""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tallymill.session import checkpoint

#: The median search brings distinct values to the driver only below this count.
MEDIAN_TAIL_VALUES = 50_000
_CUTS = 64
_ACCURACY = 10_000


def mean(value: str | Column, digits: int | None = None) -> Column:
    """Average of a column.

    A floating-point sum depends on the order in which partial sums meet. With
    ``digits`` the values are summed as whole units of that many decimals, so
    the result does not depend on the partitioning; the buffer is one long, and
    a sum beyond its range is an error rather than a wrong number.
    """
    value = F.col(value) if isinstance(value, str) else value
    if digits is None:
        return F.avg(value)
    unit = 10**digits
    units = F.rint(value * F.lit(float(unit))).cast("long")
    total = F.sum(units).cast("double") / F.lit(float(unit))
    return F.when(F.count(value) > 0, total / F.count(value))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """The distinct values ``v`` of a column and how often (``n``) each occurs.

    Equal values meet before the shuffle. The result is written once, and every
    statistic over all values can be taken from it. Whole numbers and decimals
    stay what they are; anything else becomes a double.
    """
    kind = df.schema[value].dataType
    number = F.col(value)
    if isinstance(kind, IntegralType):
        number = number.cast("decimal(20,0)")
    elif not isinstance(kind, DecimalType):
        number = number.cast("double")
    return checkpoint(
        df.filter(number.isNotNull()).groupBy(number.alias("v")).agg(F.count("*").alias("n"))
    )


def histogram_mean(digits: int | None = None) -> Column:
    """Average over a histogram, as :func:`mean` gives it over the values."""
    n = F.col("n")
    if digits is None:
        return F.try_divide(F.sum(F.col("v").cast("double") * n), F.sum(n))
    unit = F.lit(float(10**digits))
    units = F.sum(F.rint(F.col("v").cast("double") * unit).cast("decimal(20,0)") * n).cast("double")
    return F.try_divide(units / unit, F.sum(n))


def _even_cuts(low: Decimal, high: Decimal, scale: int) -> list[Decimal]:
    """Values that divide a range evenly, on the digits a decimal has."""
    with localcontext(prec=100):
        unit = Decimal(1).scaleb(-scale)
        steps = int((high - low) / unit)
        return sorted({low + unit * (steps * i // _CUTS) for i in range(1, _CUTS)})


def histogram_median(values: DataFrame) -> float | Decimal | None:
    """Exact median of a histogram, without a global sort.

    Each round cuts the values at approximate quantiles, adds up the counts
    between the cuts and keeps the ranges that hold the middle: about 1/64 of
    the values, whatever their distribution. Quantiles are doubles inside Spark;
    decimals that lie closer together than doubles are cut evenly between the
    least and the greatest of them, which takes another digit or two each round.
    The rest is small enough to look at. The median of doubles is a double, that
    of decimals and whole numbers a decimal without any rounding.
    """
    size, total = values.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if total == 0:
        return None
    kind = values.schema["v"].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else None
    first, second = (total - 1) // 2, total // 2
    steps = F.array(*(F.lit(i / _CUTS) for i in range(1, _CUTS)))
    last = None
    while size > MEDIAN_TAIL_VALUES:
        if scale is not None and last is not None and size > last / 2:
            low, high = values.agg(F.min("v"), F.max("v")).first()
            cuts = [c for c in _even_cuts(low, high, scale) if c < high]
        else:
            cuts = values.agg(F.percentile_approx("v", steps, F.lit(_ACCURACY))).first()[0]
        last = size
        bounds = list(enumerate(sorted(set(cuts))))
        place = reduce(lambda c, b: c.when(F.col("v") <= F.lit(b[1]), b[0]), bounds, F)
        ranges = (
            values.groupBy(place.otherwise(len(bounds)).alias("range"))
            .agg(
                F.sum("n").alias("n"),
                F.count("*").alias("size"),
                F.min("v").alias("low"),
                F.max("v").alias("high"),
            )
            .collect()  # at most one row per cut
        )
        below, kept = 0, []
        for part in sorted(ranges, key=lambda row: row.range):
            if below <= second and below + part.n > first:
                kept.append((below, part))
            below += part.n
        before = kept[0][0]
        values = values.filter(F.col("v").between(F.lit(kept[0][1].low), F.lit(kept[-1][1].high)))
        size = sum(part.size for _, part in kept)
        first, second = first - before, second - before
    middle, seen = [], 0
    for row in sorted(values.collect(), key=lambda r: (r.v != r.v, r.v)):
        middle += [row.v for rank in (first, second) if seen <= rank < seen + row.n]
        seen += row.n
    if scale is None:
        return (middle[0] + middle[1]) / 2.0
    with localcontext(prec=100):
        return (middle[0] + middle[1]) / 2


def exact_median(df: DataFrame, value: str) -> float | Decimal | None:
    """Median of a column over a whole DataFrame; NULLs do not count."""
    return histogram_median(histogram(df, value))
