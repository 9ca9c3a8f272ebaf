"""Keep-first lookups of one table, reduced together by a single hash aggregation.

``drop_duplicates`` in file order keeps, per key, the row of the least order value.
Sorting a key's rows, or finding its least order value and joining the rows back,
costs a sort or a second scan for every lookup.  Here the order value and a column's
value are packed into one number of fixed width, order first, whose minimum *is* the
kept value; a hash aggregation (partial before the shuffle, so a key of any size is a
row a task) takes all minima of all lookups of a table in one scan.

A packed number is a decimal of 38 digits: order x 2^64 + image, with the order
below 2^62 and the image a 64-bit whole number (``functions.images``).  Texts are
packed by their place in a declared list; another text fails the job.  The order has
no ties within a key and lookup (a row number or primary key): what is kept of
several columns is then one row.  A null order comes last, as a row without one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.functions.exprs import col_of
from leadspark.functions.images import double_image, image_double, image_time, time_image

_WIDE = "decimal(38,0)"
_SIGN = 1 << 63


@dataclass
class First:
    """One keep-first lookup: of the rows ``where``, the columns of the row of the least ``order``.

    ``cols`` maps output names to input columns; ``texts`` gives the declared
    values of string columns; ``order_as`` names the kept order value, if wanted.
    """
    order: str
    cols: dict = field(default_factory=dict)
    where: Column | None = None
    texts: dict = field(default_factory=dict)
    order_as: str | None = None


def _number(text: int) -> Column:
    return F.lit(str(text)).cast(_WIDE)


def _image(kind: T.DataType, c: Column, texts) -> Column:
    if isinstance(kind, T.StringType):
        if not texts:
            raise ValueError("a string column needs its declared values to be of fixed width")
        out = F.when(c.isNull(), F.lit(None).cast("long"))
        for i, t in enumerate(texts):
            out = out.when(c == t, F.lit(i).cast("long"))
        return out.otherwise(F.raise_error(F.concat(F.lit("not a declared value: "), c)).cast("long"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_image(c)
    if isinstance(kind, T.TimestampNTZType):
        return time_image(c)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("long")
    raise ValueError(f"no image of fixed width for {kind.simpleString()}")


def _value(kind: T.DataType, c: Column, texts) -> Column:
    if isinstance(kind, T.StringType):
        return F.get(F.array(*[F.lit(t) for t in texts]), c.cast("int"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return image_double(c).cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return image_time(c)
    return c.cast(kind)


def firsts(df: DataFrame, key: str, lookups: list[First], sums: dict | None = None) -> DataFrame:
    """One row per ``key``: the kept columns of each lookup, and plain aggregates (``sums``: name -> aggregate).

    A key without rows of a lookup has nulls there.  Null keys form one group.
    """
    types = {f.name: f.dataType for f in df.schema}
    ready, aggs, out = [], [], [col_of(key)]

    def where(lk: First, c: Column) -> Column:
        return c if lk.where is None else F.when(lk.where, c)
    for i, lk in enumerate(lookups):
        order = col_of(lk.order).cast("long")
        # null counts as the least image, which no double, time or text has
        for j, (name, c) in enumerate(lk.cols.items()):
            kind, texts = types[c], lk.texts.get(name)
            image = F.coalesce(_image(kind, col_of(c), texts), F.lit(-_SIGN).cast("long")).cast(_WIDE)
            packed = order.cast(_WIDE) * _number(1 << 64) + (image + _number(_SIGN))
            ready.append(where(lk, packed.cast(_WIDE)).alias(f"_{i}_{j}"))
            aggs.append(F.min(f"_{i}_{j}").alias(f"_{i}_{j}"))
            image = (F.pmod(F.col(f"_{i}_{j}"), _number(1 << 64)) - _number(_SIGN)).cast("long")
            image = F.when(image != F.lit(-_SIGN).cast("long"), image)
            out.append(_value(kind, image, texts).alias(name))
        if lk.order_as:
            ready.append(where(lk, order).alias(f"_{i}"))
            aggs.append(F.min(f"_{i}").alias(f"_{i}"))
            out.append(F.col(f"_{i}").cast(types[lk.order]).alias(lk.order_as))
    for name, agg in (sums or {}).items():
        aggs.append(agg.alias(name))
        out.append(F.col(name))
    used = [col_of(key)] + ready if not sums else ["*"] + ready
    return df.select(*used).groupBy(col_of(key)).agg(*aggs).select(*out)
