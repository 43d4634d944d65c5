"""Bulk insert of loosely typed rows: defaults, coercion, rules, and what was refused and why."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut
from ..functions.joins import first_per_key, keyed_join
from ..functions.scan import new_ids
from ..operators.quality import row_rules
from .schema import TableSpec


def coerced(field: T.StructField, given: Column) -> Column:
    """``given`` as the column's type, NULL if it cannot be. A fraction given for a whole number is
    rounded, halves away from zero, as is money to cents."""
    text = given.cast("string")
    if isinstance(field.dataType, T.IntegralType):
        return F.round(text.try_cast("decimal(38,10)")).try_cast(field.dataType.simpleString())
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, (T.ArrayType, T.StructType)):
        return given
    return text.try_cast(field.dataType.simpleString())


def ingest(
    raw: DataFrame,
    spec: TableSpec,
    existing: DataFrame | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    seq: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in the table's schema, and rejected ones as (seq, reasons).

    ``raw`` has a unique arrival number ``seq`` and any of the table's columns. Missing values take
    the column's default, and a single id column that ``raw`` does not have is numbered on. A row is rejected for a value that does not fit, a broken rule, a reference
    to no parent in ``parents``, or a key that ``existing`` or an earlier good row already has.
    """
    serial = spec.key[0] if len(spec.key) == 1 and spec.key[0] not in raw.columns else None
    typed, bad = [], []
    for f in spec.schema.fields:
        given = F.col(f.name) if f.name in raw.columns else F.lit(None)
        value = coerced(f, given)
        bad.append(F.when(given.isNotNull() & value.isNull(), F.lit(f"type:{f.name}")))
        if f.name == serial:
            value = F.lit(0).cast(f.dataType)
        elif f.name in spec.defaults:
            value = F.when(given.isNull(), F.expr(spec.defaults[f.name]).cast(f.dataType)).otherwise(value)
        typed.append(value.alias(f.name))
    rows = raw.select(F.col(seq).alias("_seq"), F.array(*bad).alias("_types"), *typed)
    # Values of a wrong type are NULL here; only the reason "type" is kept for them.
    types = {f.name: F.col("_types")[i] for i, f in enumerate(spec.schema.fields)}
    found = [*types.values()]
    for rule, broken in row_rules(spec, rows).items():
        wrong_type = types[rule.removeprefix("not_null:")].isNotNull() if rule.startswith("not_null:") else F.lit(False)
        found.append(F.when(F.expr(broken) & ~wrong_type, F.lit(rule)))
    # Most rows break nothing: the array is only packed for the others.
    rows = rows.withColumn("_faults", F.when(F.coalesce(*found).isNotNull(), F.array_compact(F.array(*found))).otherwise(_none())).drop("_types")
    for fk in spec.foreign_keys:
        if parents and fk.parent in parents:
            known = parents[fk.parent].select(F.col(fk.parent_column).alias(fk.column), F.lit(True).alias("_known"))
            rows = keyed_join(rows, known, fk.column, "left")
            lost = F.col(fk.column).isNotNull() & F.col("_known").isNull()
            rows = _fault(rows, lost, f"foreign_key:{fk.column}").drop("_known")
    judged = [key for key in spec.unique_keys if all(c in raw.columns for c in key)]
    if existing is not None:
        for key in judged:
            taken = existing.select(*key).withColumn("_taken", F.lit(True))
            rows = _fault(
                rows.join(taken, list(key), "left"), F.coalesce("_taken", F.lit(False)), "unique:" + ",".join(key)
            ).drop("_taken")
    # Judged once: the rows that clash with each other, the accepted and the rejected ones all come from here.
    rows = cut(rows) if judged else rows
    good = rows.filter(F.size("_faults") == 0)
    late = _late_rows(good.select("_seq", *{c: None for key in judged for c in key}), judged)
    if late is not None:
        rows = (
            rows.join(late, "_seq", "left")
            .withColumn("_faults", F.concat("_faults", F.coalesce("_late", F.array().cast("array<string>"))))
            .drop("_late")
        )
    accepted = rows.filter(F.size("_faults") == 0).drop("_faults").withColumnRenamed("_seq", seq)
    if serial:
        known = existing if existing is not None else accepted.limit(0)
        accepted = new_ids(accepted.drop(serial), known, serial, seq)
    rejected = rows.filter(F.size("_faults") > 0).select(F.col("_seq").alias(seq), F.col("_faults").alias("reasons"))
    return accepted.select(seq, *spec.schema.fieldNames()), rejected


def _late_rows(rows: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame | None:
    """Rows (_seq, _late) refused because an earlier accepted row has one of their keys.

    With one key that is every row but the first. With several, a row refused for one key does not
    hold its other keys, so rows are settled in rounds: those that are first for all their keys are
    accepted, rows meeting an accepted key are refused, and the others go to the next round.
    """
    if not keys:
        return None
    if len(keys) == 1:
        late = first_per_key(rows, *keys[0], seq="_seq").filter(~F.col("is_first"))
        return late.select("_seq", F.array(F.lit("unique:" + ",".join(keys[0]))).alias("_late"))
    refused, open_rows = None, cut(rows)
    while not open_rows.isEmpty():
        marked = open_rows
        for i, key in enumerate(keys):
            marked = first_per_key(marked, *key, seq="_seq").withColumnRenamed("is_first", f"_first{i}")
        winners = cut(marked.filter(" and ".join(f"_first{i}" for i in range(len(keys)))).select(*open_rows.columns))
        rest = open_rows.join(winners.select("_seq"), "_seq", "left_anti").withColumn("_late", F.array().cast("array<string>"))
        for key in keys:
            held = winners.select(*key).withColumn("_held", F.lit(True))
            rest = rest.join(held, list(key), "left").withColumn(
                "_late",
                F.when(F.col("_held"), F.concat("_late", F.array(F.lit("unique:" + ",".join(key))))).otherwise(F.col("_late")),
            ).drop("_held")
        rest = cut(rest)
        lost = rest.filter(F.size("_late") > 0).select("_seq", "_late")
        refused = lost if refused is None else refused.unionByName(lost)
        open_rows = rest.filter(F.size("_late") == 0).drop("_late")
    return refused


def _none() -> Column:
    return F.array().cast("array<string>")


def _fault(rows: DataFrame, broken: Column, name: str) -> DataFrame:
    return rows.withColumn(
        "_faults", F.when(broken, F.concat("_faults", F.array(F.lit(name)))).otherwise(F.col("_faults"))
    )


def append_rows(accepted: DataFrame, spec: TableSpec, folder: str) -> None:
    accepted.select(*spec.schema.fieldNames()).write.mode("append").parquet(f"{folder}/{spec.name}")
