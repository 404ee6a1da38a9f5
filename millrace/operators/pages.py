"""Pages of a table in an order that a reader chooses, without sorting the pages before.

A page is a range of ranks. What value stands at a rank is found by counts of value ranges alone (`percentiles.values_at`); only rows whose values lie between
a page's first and last are sorted. Where very many rows share a value, the same is done among them for their ids. The page after a known row needs
no ranks: its rows come after that row (`page_after`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .percentiles import values_at

#: Rows of one value that are sorted with a page; beyond, their ids are narrowed first.
TIES = 50_000


@dataclass(frozen=True)
class Order:
    """A number to sort by, falling or rising; equal numbers by rising id."""

    key: Column | None
    falling: bool = False

    def number(self, id_col: str) -> Column:
        """Rising in the order. Rows without a number stand like the smallest there is."""
        key = F.col(id_col) if self.key is None else self.key
        key = F.coalesce(key.cast("double"), F.lit(-1.7976931348623157e308))
        return -key if self.falling else key


def sample_orders(speed: str, tokens: str, label: str) -> dict[str, Order]:
    """The seven orders of a viewer of samples: by place, speed and tokens (none is 0), and length of label. Names are fixed values."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return {
        "default": Order(None), "ts_desc": Order(zero(speed), True), "ts_asc": Order(zero(speed)), "gt_desc": Order(zero(tokens), True), "gt_asc": Order(zero(tokens)),
        "label_short": Order(F.char_length(label)), "label_long": Order(F.char_length(label), True),
    }


def nulls_lowest(column: str, falling: bool) -> Order:
    """A table's column, nulls below all numbers."""
    return Order(F.col(column), falling)


def page_at(df: DataFrame, order: Order, id_col: str, page: int, per_page: int) -> DataFrame:
    """Page `page` (from 0) of df, in order, with `_place`, the rank from 0. A page beyond the end has no rows. Ids are numbers, unique and not null."""
    start, end = page * per_page, (page + 1) * per_page
    rows = df.withColumn("_number", order.number(id_col))
    found = values_at(rows, F.col("_number"), [start, end - 1])
    if start not in found:
        return rows.limit(0).drop("_number").withColumn("_place", F.lit(None).cast("long"))
    first, below = found[start]
    if end - 1 in found:
        last, under = found[end - 1]
    else:
        last, under = None, None
    near = rows.where(F.col("_number") >= first)
    if last is not None:
        near = near.where(F.col("_number") <= last)
    many = lambda value: rows.where(F.col("_number") == value).count() > TIES
    among = lambda value, place: values_at(rows.where(F.col("_number") == value), F.col(id_col), [place]).get(place)
    if last is not None and many(last):
        near = near.where((F.col("_number") < last) | (F.col(id_col) <= among(last, end - 1 - under)[0]))
    if many(first):
        low, passed = among(first, start - below)
        near = near.where((F.col("_number") > first) | (F.col(id_col) >= low))
        below += passed
    # near starts with the rows of the first value, of which start - below are on pages before.
    some = near.orderBy("_number", id_col).offset(start - below).limit(per_page)
    return some.withColumn("_place", F.row_number().over(_page_order(id_col)) + F.lit(start - 1).cast("long")).drop("_number")


def _page_order(id_col: str):
    from pyspark.sql import Window

    return Window.partitionBy().orderBy("_number", id_col)  # over one page


def page_after(df: DataFrame, order: Order, id_col: str, last: tuple[float, int] | None, per_page: int) -> DataFrame:
    """The page after the row with number and id `last` (None: the first page), and `_number`, by which to go on."""
    rows = df.withColumn("_number", order.number(id_col))
    if last is not None:
        number, id_ = F.lit(last[0]), F.lit(last[1])
        rows = rows.where((F.col("_number") > number) | ((F.col("_number") == number) & (F.col(id_col) > id_)))
    return rows.orderBy("_number", id_col).limit(per_page)
