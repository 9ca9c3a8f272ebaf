"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Column from a name (any characters allowed) or a Column."""
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def rollup(c, mapping: dict, default=None) -> Column:
    """``CASE WHEN c IN (..) THEN group .. ELSE default END``.

    ``mapping`` is group -> list of members.  ``default`` None keeps the
    input value (SQL ``ELSE <column>``).
    """
    c = col_of(c)
    out = None
    for group, members in mapping.items():
        cond = c.isin(list(members))
        out = F.when(cond, F.lit(group)) if out is None else out.when(cond, F.lit(group))
    other = c if default is None else F.lit(default)
    return other if out is None else out.otherwise(other)


def category(l1, l2, sep: str = " ") -> Column:
    """Composite category ``l1 + sep + l2``; null when either part is null."""
    return F.concat(col_of(l1), F.lit(sep), col_of(l2))


def md5_int(*parts) -> Column:
    """Non-negative 32-bit integer from the first 8 hex digits of md5(parts).

    Uses ``:`` between parts; equals DuckDB
    ``('0x' || substr(md5(s), 1, 8))::bigint`` on the same string.
    """
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append(col_of(p).cast("string") if not isinstance(p, Column) else p.cast("string"))
    s = F.concat(*cols) if len(cols) > 1 else cols[0]
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def clean_name(name: str, chars=(" ", ",", ";"), repl: str = "_") -> str:
    for ch in chars:
        name = name.replace(ch, repl)
    return name


def vector_element(c, i: int) -> Column:
    """Element ``i`` of an ML vector column (dense or sparse), as double."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(col_of(c)).getItem(i)
