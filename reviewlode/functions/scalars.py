"""Dates, arithmetic and arrays: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_timestamp(c: Column | str) -> Column:
    """A timestamp without zone from text of several usual formats; null where none fits."""
    c = _col(c)
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "dd/MM/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def month(c: Column | str) -> Column:
    return F.to_date(F.date_trunc("month", _col(c)))


def quarter_start(c: Column | str) -> Column:
    return F.to_date(F.date_trunc("quarter", _col(c)))


def quarter_end(c: Column | str) -> Column:
    return F.last_day(F.add_months(quarter_start(c), 2))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Days as a fraction; null if negative."""
    d = (F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))) / 86_400_000_000
    return F.when(d >= 0, d)


def months_from(month_start: Column | str, year: int, mon: int) -> Column:
    m = _col(month_start)
    return (F.year(m) - year) * 12 + F.month(m) - mon


def valence(p_pos: Column | str, p_neg: Column | str) -> Column:
    return _col(p_pos) - _col(p_neg)


def argmax_label(neg: Column | str, neu: Column | str, pos: Column | str) -> Column:
    """The label with the largest share; ties go to the earlier of Negative, Neutral, Positive; null if all are null."""
    neg, neu, pos = _col(neg), _col(neu), _col(pos)
    return F.when(neg.isNull() & neu.isNull() & pos.isNull(), None).when((neg >= neu) & (neg >= pos), "Negative").when(neu >= pos, "Neutral").otherwise("Positive")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax2(a: Column, b: Column) -> Column:
    """The first one's share of two, as of entailment against contradiction."""
    m = F.greatest(a, b)
    return F.exp(a - m) / (F.exp(a - m) + F.exp(b - m))


def softmax3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    m = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - m), F.exp(b - m), F.exp(c - m)
    total = ea + eb + ec
    return ea / total, eb / total, ec / total
