"""Keeping a caller's rows apart from the columns an operator adds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the caller's whole row), ``doc`` (its id), ``mark`` (a hash of its text) and ``body`` (its text).

    A NULL text is an empty one.  (doc, mark) names a row: two rows that agree in both have the same text,
    so they get the same result, and a frame may repeat ids or whole rows or hold columns of any name.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs[doc_id].cast("long").alias("doc"),
        F.xxhash64(body).alias("mark"),
        body.alias("body"),
    )


def whole_rows(docs: DataFrame) -> DataFrame:
    """The caller's rows as one column ``row``."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """The join condition on (doc, mark); a NULL id equals a NULL id."""
    return left["doc"].eqNullSafe(right["doc"]) & (left["mark"] == right["mark"])


def unpacked(frame: DataFrame, names: list[str], added: dict[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """The caller's columns again, then the added ones; an added name replaces a caller's column of that name."""
    taken = {n.lower() for n in added} | {n.lower() for n in drop}
    kept = [F.col("row").getField(n).alias(n) for n in names if n.lower() not in taken]
    return frame.select(*kept, *[value.alias(name) for name, value in added.items()])
