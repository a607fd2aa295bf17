"""Vector arithmetic as array expressions (whole-stage code, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def centre(a: Column) -> Column:
    m = mean(a)
    return F.transform(a, lambda x: x.cast("double") - m)


def masked(a: Column, above: float) -> Column:
    return F.filter(a, lambda x: x > above)


def pad(a: Column, size: int, value: float = 0.0) -> Column:
    """Right-pad to ``size``; longer arrays are an error, never cut."""
    short = F.lit(size) - F.size(a)
    filled = F.concat(a.cast("array<double>"), F.array_repeat(F.lit(value), F.greatest(short, F.lit(0))))
    return F.when(short >= 0, filled).otherwise(F.raise_error(F.lit("array longer than the padded size")).cast("array<double>"))
