"""Lookup enrichment: pandas-merge semantics on Spark joins.

* ``merge`` keeps both key columns when they have different names (one,
  coalesced, when they share a name), suffixes other clashing names
  (``_x``/``_y``) and can match null keys to each other (``null_safe``), as
  pandas merges do.
* ``lookup`` = optional semi-join of the dimension to the fact's keys
  (``prefilter``), optional keep-first dedupe of the dimension + merge +
  strict drop of the columns not wanted.
* ``star`` folds a list of lookups over a (written) fact table, with one
  shared key set for all prefilters.

Joins are left to Catalyst/AQE (which turns a shuffle join into a broadcast
join at run time when the bytes of the built side turn out small).
Null-safe keys use ``<=>``, which Spark still plans as an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.operators.cleanse import drop_strict, first_by
from leadspark.session import freeze


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, how: str = "left",
          suffixes=("_x", "_y"), null_safe: bool = False) -> DataFrame:
    right_on = right_on or left_on
    same = right_on == left_on
    rk = "_rk"
    sx, sy = suffixes
    lcols = [c for c in left.columns]
    rcols = [c for c in right.columns if not (same and c == right_on)]
    clash = {c for c in lcols if c in rcols and not (same and c == left_on)}
    lnames = {c: (c + sx if c in clash else c) for c in lcols}
    rnames = {c: (c + sy if c in clash else c) for c in rcols}
    # the left side keeps its own columns, the key among them: a chain of joins
    # on one key then shuffles the left side once
    L = left.select(*[col_of(c).alias(lnames[c]) for c in lcols]) if clash else left
    R = right.select(*[col_of(c).alias(rnames[c]) for c in rcols], col_of(right_on).alias(rk))
    lk = col_of(lnames[left_on])
    # ``<=>`` is planned as an equi-join key (null flag + value).  A large null
    # group of a left or inner join is divided by the skew join; a full outer
    # join is never divided.
    j = L.join(R, lk.eqNullSafe(F.col(rk)) if null_safe else (lk == F.col(rk)), how)
    if same and how in ("outer", "full", "right"):
        out = [F.coalesce(col_of(c), F.col(rk)).alias(c) if c == left_on else col_of(lnames[c]) for c in lcols]
        return j.select(*out, *[col_of(rnames[c]) for c in rcols])
    return j.drop(rk)


def semi_filter(dim: DataFrame, keys: DataFrame, right_on: str, null_safe: bool = False) -> DataFrame:
    """Rows of ``dim`` whose key occurs in ``keys`` (one column ``_fk``, distinct):
    a left-semi join.  When the key set is small, AQE broadcasts it and the
    dimension is filtered map-side before any shuffle or dedupe."""
    k = col_of(right_on)
    cond = k.eqNullSafe(keys["_fk"]) if null_safe else (k == keys["_fk"])
    return dim.join(keys, cond, "left_semi")


def key_set(fact: DataFrame, left_on: str) -> DataFrame:
    return fact.select(col_of(left_on).alias("_fk")).distinct()


def lookup(fact: DataFrame, dim: DataFrame, left_on: str, right_on: str, how: str = "left",
           drop=None, dedupe_order=None, null_safe: bool = False,
           drop_right_key: bool = True,
           prefilter: bool = False, keys: DataFrame | None = None, unique_order: bool = False) -> DataFrame:
    """Enrich ``fact`` with ``dim``; optional semi-join reduction of ``dim`` to the
    fact's keys (``prefilter``; ``keys`` may supply a precomputed superset),
    keep-first dedupe of ``dim`` on its key (by ``dedupe_order``), then merge
    and strict drop."""
    if prefilter and how in ("left", "inner"):
        dim = semi_filter(dim, keys if keys is not None else key_set(fact, left_on), right_on, null_safe)
    if dedupe_order is not None:
        dim = first_by(dim, right_on, dedupe_order, unique=unique_order)
    j = merge(fact, dim, left_on, right_on, how, null_safe=null_safe)
    to_drop = list(drop or [])
    if drop_right_key and right_on != left_on and right_on not in to_drop:
        to_drop.append(right_on)
    return drop_strict(j, to_drop) if to_drop else j


@dataclass
class Lookup:
    dim: DataFrame
    left_on: str
    right_on: str
    how: str = "left"
    drop: list = field(default_factory=list)
    dedupe_order: object = None
    unique_order: bool = False                   # dedupe_order has no ties within a key
    null_safe: bool = False
    derive: dict = field(default_factory=dict)   # new fact columns before the join
    prefilter: bool = True                       # semi-join the dim to the fact's keys first


def star(fact: DataFrame, lookups, keys: dict | None = None, write_fact: bool = True) -> DataFrame:
    """Chain of lookups (a star enrichment) as one lazy plan.

    Key sets for the semi-join prefilter are taken once from the base fact
    (left and inner joins never add keys).  The base fact is written once to
    the checkpoint folder first, so the key sets and the chain read it
    instead of re-running its plan.
    """
    if write_fact and any(lk.prefilter for lk in lookups):
        fact = freeze(fact, "star_fact")
    base = fact
    keys = dict(keys or {})
    for lk in lookups:
        for name, expr in lk.derive.items():
            fact = fact.withColumn(name, expr)
        ks = None
        if lk.prefilter and lk.left_on in base.columns:
            ks = keys.setdefault(lk.left_on, key_set(base, lk.left_on))
        fact = lookup(fact, lk.dim, lk.left_on, lk.right_on, lk.how, lk.drop, lk.dedupe_order,
                      lk.null_safe, drop_right_key=False,
                      prefilter=ks is not None, keys=ks, unique_order=lk.unique_order)
    return fact


def zip3(c) -> object:
    """First three characters of a ZIP kept as a string (leading zeros stay)."""
    return F.substring(col_of(c), 1, 3)
