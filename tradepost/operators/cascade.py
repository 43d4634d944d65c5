"""Deletes that take all depending rows with them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import cut
from ..functions.joins import keyed_join
from ..sources.schema import TABLES, ForeignKey

Frames = Mapping[str, DataFrame]


def _parents_first(tables: Frames) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for fk in TABLES[name].foreign_keys:
            if fk.parent in tables:
                visit(fk.parent)
        order.append(name)

    for name in tables:
        visit(name)
    return order


def cascade_delete(tables: Frames, root: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The tables without the ``root`` rows whose key is in ``keys`` and without every row that refers,
    over any number of references, to a deleted one. Untouched tables are not in the result."""
    # Victims are written once; the tables that refer to them read them from there.
    doomed: dict[str, DataFrame] = {root: cut(keys.select(*TABLES[root].key).distinct())}
    survivors = {root: _without(tables[root], doomed[root], TABLES[root].key[0])}
    for name in _parents_first(tables):
        fks = [fk for fk in TABLES[name].foreign_keys if fk.parent in doomed]
        if name == root or not fks:
            continue
        rows = tables[name]
        for fk in fks:
            rows = _without(rows, _renamed(doomed[fk.parent], fk), fk.column)
        survivors[name] = rows
        if any(fk.parent == name for spec in TABLES.values() for fk in spec.foreign_keys):
            doomed[name] = cut(_victims(tables[name], fks, doomed, TABLES[name].key))
    return survivors


def _renamed(keys: DataFrame, fk: ForeignKey) -> DataFrame:
    return keys.select(F.col(fk.parent_column).alias(fk.column))


def _without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return keyed_join(rows, keys, column, "left_anti")


def _victims(rows: DataFrame, fks: list[ForeignKey], doomed: dict[str, DataFrame], key: tuple[str, ...]) -> DataFrame:
    hits = [
        keyed_join(rows.select(*key, fk.column), _renamed(doomed[fk.parent], fk), fk.column, "left_semi").select(*key)
        for fk in fks
    ]
    return reduce(DataFrame.unionByName, hits).distinct()


def delete_customers(tables: Frames, usernames: DataFrame) -> dict[str, DataFrame]:
    """Delete customers by username with their addresses, lists, orders and all that hangs on those."""
    keys = keyed_join(tables["customer"], usernames.select("username").distinct(), "username", "left_semi")
    return cascade_delete(tables, "customer", keys.select("customer_id"))
