"""Data-quality reports and the split of incoming rows into good and rejected ones.

Reports have one row per rule with the number of violations; ``violating_keys`` lists the keys
themselves. A check, reference or length rule is broken only by a value: NULL passes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import keyed_join
from ..sources.schema import TABLES, TableSpec

Frames = Mapping[str, DataFrame]


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _specs(tables: Frames) -> list[TableSpec]:
    return [TABLES[name] for name in tables if name in TABLES]


def not_null_rules(spec: TableSpec) -> dict[str, str]:
    """Rule name -> SQL condition of a broken row."""
    return {f"not_null:{c}": f"{c} is null" for c in spec.required}


def check_rules(spec: TableSpec) -> dict[str, str]:
    return {f"check:{name}": f"not coalesce({text}, true)" for name, text in spec.checks.items()}


def domain_rules(spec: TableSpec, df: DataFrame) -> dict[str, str]:
    """Texts that are too long, and numbers that do not fit the declared decimal."""
    rules = {f"length:{c}": f"coalesce(length({c}) > {n}, false)" for c, n in spec.lengths.items()}
    given = {f.name: f.dataType for f in df.schema.fields}
    for f in spec.schema.fields:
        if isinstance(f.dataType, T.DecimalType) and given.get(f.name, f.dataType) != f.dataType:
            kind = f.dataType.simpleString()
            rules[f"range:{f.name}"] = f"{f.name} is not null and try_cast({f.name} as {kind}) is null"
    return rules


def _count_rules(name: str, df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One pass over the table for all its rules, then one row per rule."""
    counts = df.selectExpr(*[f"count_if({broken}) as r{i}" for i, broken in enumerate(rules.values())])
    pairs = ", ".join(f"struct('{rule}' as rule, r{i} as violations)" for i, rule in enumerate(rules))
    return counts.selectExpr(f"'{name}' as table_name", f"inline(array({pairs}))")


def _rule_report(tables: Frames, rules_of) -> DataFrame:
    parts = []
    for spec in _specs(tables):
        rules = rules_of(spec, tables[spec.name])
        if rules:
            parts.append(_count_rules(spec.name, tables[spec.name], rules))
    return _union(parts)


def dq_not_null(tables: Frames) -> DataFrame:
    return _rule_report(tables, lambda spec, df: not_null_rules(spec))


def dq_checks(tables: Frames) -> DataFrame:
    return _rule_report(tables, lambda spec, df: check_rules(spec))


def dq_domain(tables: Frames) -> DataFrame:
    return _rule_report(tables, domain_rules)


def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dq_unique(tables: Frames) -> DataFrame:
    """Per key: how many rows are one too many. Keys with a missing part are not compared."""
    parts = []
    for spec in _specs(tables):
        for key in spec.unique_keys:
            extra = duplicate_keys(tables[spec.name], key).selectExpr("coalesce(sum(copies - 1), 0L) as violations")
            parts.append(
                extra.selectExpr(f"'{spec.name}' as table_name", f"'unique:{','.join(key)}' as rule", "violations")
            )
    return _union(parts)


def orphans(tables: Frames, spec: TableSpec, column: str) -> DataFrame:
    """Values of a reference that name no parent row, with the number of rows using them. Rows are
    counted by value first, so a value used very often meets the parent table once."""
    parent, parent_column = spec.references[column]
    used = tables[spec.name].groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    known = tables[parent].select(F.col(parent_column).alias("value"))
    return keyed_join(used.filter("value is not null"), known, "value", "left_anti")


def dq_foreign_keys(tables: Frames) -> DataFrame:
    """Per reference: how many rows name no parent row. A table is read once for all its references and once for all that refer to
    it; rows are counted by value before they meet the parents."""
    fks = [(spec.name, fk) for spec in _specs(tables) for fk in spec.foreign_keys]
    used, known = [], []
    for name in dict.fromkeys(table for table, _ in fks):
        values = [F.struct(F.lit(i).alias("rule_id"), F.col(fk.column).alias("value")) for i, (t, fk) in enumerate(fks) if t == name]
        used.append(tables[name].select(F.inline(F.array(*values))))
    for parent, column in dict.fromkeys((fk.parent, fk.parent_column) for _, fk in fks):
        rules = F.array(*(F.lit(i) for i, (_, fk) in enumerate(fks) if (fk.parent, fk.parent_column) == (parent, column)))
        known.append(tables[parent].select(F.explode(rules).alias("rule_id"), F.col(column).alias("value")))
    counted = _union(used).filter("value is not null").groupBy("rule_id", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    lost = counted.join(_union(known), ["rule_id", "value"], "left_anti").groupBy("rule_id").agg(F.sum("n_rows").alias("violations"))
    names = [(i, name, f"foreign_key:{fk.column}->{fk.parent}") for i, (name, fk) in enumerate(fks)]
    listed = tables[fks[0][0]].sparkSession.createDataFrame(names, "rule_id int, table_name string, rule string")
    return listed.join(lost, "rule_id", "left").select("table_name", "rule", F.coalesce("violations", F.lit(0)).alias("violations"))


def quality_report(tables: Frames) -> DataFrame:
    return _union([dq_not_null(tables), dq_unique(tables), dq_foreign_keys(tables), dq_checks(tables), dq_domain(tables)])


def row_rules(spec: TableSpec, df: DataFrame) -> dict[str, str]:
    """The rules a row can break by itself: name -> SQL condition of a broken row."""
    return {**not_null_rules(spec), **check_rules(spec), **domain_rules(spec, df)}


def row_faults(spec: TableSpec, df: DataFrame) -> Column:
    """Names of the rules a row breaks by itself, as an array."""
    found = ", ".join(f"if({broken}, '{rule}', null)" for rule, broken in row_rules(spec, df).items())
    return F.expr(f"array_compact(array({found}))")


def violating_keys(tables: Frames) -> DataFrame:
    """(table_name, rule, row_key, detail) for every broken rule of every row, key or reference."""
    parts = []
    for spec in _specs(tables):
        df = tables[spec.name]
        row_key = F.concat_ws(",", *[F.col(c).cast("string") for c in spec.key])
        parts.append(
            df.select(F.explode(row_faults(spec, df)).alias("rule"), row_key.alias("row_key")).select(
                F.lit(spec.name).alias("table_name"), "rule", "row_key", F.lit(None).cast("string").alias("detail")
            )
        )
        for key in spec.unique_keys:
            parts.append(
                duplicate_keys(df, key).select(
                    F.lit(spec.name).alias("table_name"),
                    F.lit("unique:" + ",".join(key)).alias("rule"),
                    F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("row_key"),
                    F.format_string("%d rows", "copies").alias("detail"),
                )
            )
        for fk in spec.foreign_keys:
            if fk.parent in tables:
                parts.append(
                    orphans(tables, spec, fk.column).select(
                        F.lit(spec.name).alias("table_name"),
                        F.lit(f"foreign_key:{fk.column}->{fk.parent}").alias("rule"),
                        F.col("value").cast("string").alias("row_key"),
                        F.format_string("%d rows", "n_rows").alias("detail"),
                    )
                )
    return _union(parts)
