"""Whole rows as values that can be hashed and ordered, whatever the types of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def is_plain(docs: DataFrame, name: str) -> bool:
    """Maps and variants have neither an order nor a hash."""
    kind = dict(docs.dtypes)[name]
    return "map<" not in kind and "variant" not in kind


def plain(docs: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns, those without an order as JSON."""
    return [F.col(f"`{c}`") if is_plain(docs, c) else F.to_json(F.struct(F.col(f"`{c}`"))) for c in names]


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*plain(docs, docs.columns))
