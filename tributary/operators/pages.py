"""Long lists in numbered pages: a key's items are numbered by ranges of their order, so no row and no task holds all of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loops import counted, numbered

#: Items of a page.
PAGE_ITEMS = 1_000


def pages(rows: DataFrame, keys: Sequence[str], item: str = "item", size: int = PAGE_ITEMS) -> DataFrame:
    """(keys.., page, items): each key's items in ascending order, `size` of them a page; pages go from 0 without gaps, and only a key's last one may be shorter.

    Joined in order, a key's pages are its sorted list. Equal items stay, each as often as it is there; null ones are no items, and keys without items have no page. Null keys are keys like others.
    """
    named = [f"key{i}" for i in range(len(keys))]
    listed, n = counted(rows.where(F.col(item).isNotNull()).select(*(F.col(k).alias(a) for k, a in zip(keys, named, strict=True)), F.col(item).alias("item")))
    placed = numbered(listed, (*named, "item"), "place", n)
    firsts = placed.groupBy(*named).agg(F.min("place").alias("first"))
    firsts = firsts.select("first", *(F.col(k).alias(f"of_{k}") for k in named))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in named))
    dealt = placed.join(firsts, same).withColumn("page", F.floor((F.col("place") - F.col("first")) / size))
    found = dealt.groupBy(*named, "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return found.select(*(F.col(a).alias(k) for k, a in zip(keys, named, strict=True)), "page", "items")
