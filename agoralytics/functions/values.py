"""Small column expressions that are not about text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


_OFFSET = r"\d:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[zZ]|[+-]\d{1,2}(?::?\d{2})?)$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    """Hash text that puts rows in a random but repeatable order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), _col(key).cast("string")))


def seeded_unit(key: Column | str, seed: int | str) -> Column:
    """Repeatable number in [0, 1) for a key."""
    head = F.substring(seeded_hash(key, seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def parse_date(value: Column | str) -> Column:
    """Time stamp without zone; what cannot be read is NULL.

    A time with an offset, or with Z, is turned to UTC, so that times with other
    offsets stay in order; a time without one is taken as it stands.
    """
    text = F.trim(_col(value).cast("string"))
    # From the instant itself: a local clock shows one time twice when summer time ends.
    micros = F.unix_micros(text.try_cast("timestamp"))
    in_utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    return F.when(text.rlike(_OFFSET), in_utc).otherwise(text.try_cast("timestamp_ntz"))


def id_number(value: Column | str) -> Column:
    """`"12.0"` becomes 12; text that is no number becomes NULL.

    Whole numbers are read as such: beyond 2^53 a double no longer tells them apart.
    """
    text = _col(value).cast("string")
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(~F.isnan(number), number.try_cast("bigint")))


def by_date(date: str = "post_date", key: str = "message_id") -> list[Column]:
    """Order inside a thread: by date, missing dates last, ties by id."""
    return [F.col(date).asc_nulls_last(), F.col(key).asc()]


def date_rank(date: str = "post_date", key: str = "message_id") -> Column:
    """The same order as one comparable value, for min_by and max_by."""
    return F.struct(F.col(date).isNull(), F.col(date), F.col(key))


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series eight steps further on."""
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(z + k)
    far = z + 8
    series = 1 / (12 * far) - 1 / (360 * F.pow(far, F.lit(3.0))) + 1 / (1260 * F.pow(far, F.lit(5.0)))
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - steps


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 300) -> Column:
    """Regularised incomplete beta function, by a continued fraction of `terms` steps.

    The fraction converges fast below (a + 1) / (a + b + 2); beyond, its mirror image is taken.
    """
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a

        def step(state: Column, m: Column) -> Column:
            c, d, f = state["c"], state["d"], state["f"]
            for part in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 / safe(1 + part * d)
                c = safe(1 + part / c)
                f = f * c * d
            return F.struct(c.alias("c"), d.alias("d"), f.alias("f"))

        first = 1 / safe(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))
        return front * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["f"])

    return (
        F.when((x <= 0) | (x >= 1), F.when(x >= 1, 1.0).otherwise(0.0))
        .when(x < (a + 1) / (a + b + 2), fraction(x, a, b))
        .otherwise(1 - fraction(1 - x, b, a))
    )


def f_test(f: Column, between: Column, within: Column) -> Column:
    """How likely an F value at least as large is by chance, with these degrees of freedom."""
    x = within / (within + between * f)
    return incomplete_beta(x, within.cast("double") / 2, between.cast("double") / 2)
