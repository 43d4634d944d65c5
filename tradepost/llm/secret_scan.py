"""Secrets in texts, with the parts of multipart credentials linked to each other.

Three kinds are reported on their own: assignments, access identifiers and long hex strings. Two weak kinds, bare
keys and endpoints, are reported only when a part that completes them stands nearby: a key needs an access
identifier or an endpoint, an endpoint needs an access identifier, an assigned secret or a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import ROW, Scratch, column, numbered


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # leftmost matches that don't overlap
    test: str  # SQL over ``m`` (the match) and ``v`` (its group); matches that fail are dropped after matching
    group: int = 0
    cheap: str | None = None  # a text without a match of this has no match at all
    needs: tuple[str, ...] = ()  # weak kinds: one of these must be near


# Kinds and patterns, in the order in which kinds are listed.
KINDS = (
    Kind(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "length(v) >= 6",
        2,
        "(?i)passw|secret|token|api_?key",
    ),
    Kind("access", "AKIA[A-Z0-9]+", "length(m) >= 20", cheap="AKIA"),
    Kind("hex", "[0-9a-f]+", "length(m) >= 24", cheap="[0-9a-f]{24}"),
    Kind("key", "[A-Za-z0-9+/]{40,}", "length(m) = 40", cheap="[A-Za-z0-9+/]{40}", needs=("access", "endpoint")),
    Kind("endpoint", r"""https?://[^\s"'<>]+""", "length(m) >= 12", cheap="https?://", needs=("access", "assign", "key")),
)
BASE = ("assign", "access", "hex")
#: Code points between two parts of one credential at most.
REACH = 256


def _matches(text: Column, at: int, kind: Kind) -> Column:
    """Per match its kind, its number, the length of the text between the match before and itself, its own length, and
    whether it passes the kind's test. Gaps and matches alternate, so their lengths give places."""
    shape = "array<struct<kind:int,n:int,gap:int,size:int,ok:boolean>>"
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    pairs = F.arrays_zip(found.alias("m"), value.alias("v"), F.split(text, kind.pattern, -1).alias("gap"))
    entries = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit(at).alias("kind"),
            i.alias("n"),
            F.length(p["gap"]).alias("gap"),
            F.length(p["m"]).alias("size"),
            F.coalesce(_passes(kind, p["m"], p["v"]), F.lit(False)).alias("ok"),
        ),
    )
    # The last gap has no match.
    entries = F.filter(entries, lambda e: e["size"].isNotNull()).cast(shape)
    none = F.array().cast(shape)
    return F.when(text.rlike(kind.cheap or kind.pattern), entries).otherwise(none)


def _passes(kind: Kind, match: Column, value: Column) -> Column:
    side, op, n = kind.test.split()
    length = F.length(value if side == "length(v)" else match)
    return length >= int(n) if op == ">=" else length == int(n)


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / REACH), F.floor(end / REACH)))


def _linked(weak: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of ``weak`` that have a completing part within reach. Parts widened by the reach and candidates meet in
    stretches of the text, which hold few spans however long the text is."""
    at = {k.name: i for i, k in enumerate(KINDS)}
    needs = F.create_map(
        *(x for k in KINDS if k.needs for x in (F.lit(at[k.name]), F.array(*(F.lit(at[n]) for n in k.needs))))
    )
    left = weak.withColumn("bucket", _buckets(F.col("start"), F.col("end")))
    right = parts.select(
        F.col("row").alias("p_row"),
        F.col("kind").alias("p_kind"),
        (F.col("start") - REACH).alias("p_from"),
        (F.col("end") + REACH).alias("p_to"),
        _buckets(F.greatest(F.col("start") - REACH, F.lit(0)), F.col("end") + REACH).alias("p_bucket"),
    )
    near = (
        (F.col("row") == F.col("p_row"))
        & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("start") <= F.col("p_to"))
        & (F.col("end") >= F.col("p_from"))
        & F.array_contains(F.element_at(needs, F.col("kind")), F.col("p_kind"))
    )
    return left.join(right, near, "left_semi").select(*weak.columns).distinct()


def find_spans(rows: DataFrame, keep: Scratch, temp: Scratch) -> DataFrame:
    """(row, id, spans) for rows (row, id, text): spans is an array of (start, kind, end) by start and then kind, in
    code points, end exclusive; empty for a text without any."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*(_matches(text, i, k) for i, k in enumerate(KINDS)))
    scanned = keep.cut(rows.select("row", "id", found.alias("found")))
    upto = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        scanned.select("row", F.inline("found"))
        .withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("size")).over(upto))
        .filter("ok")
        .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    placed = temp.cut(placed)
    weak = [i for i, k in enumerate(KINDS) if k.needs]
    strong = placed.filter(~F.col("kind").isin(weak))
    spans = keep.cut(
        strong.unionByName(_linked(placed.filter(F.col("kind").isin(weak)), placed))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    )
    none = F.array().cast(spans.schema["spans"].dataType)
    return scanned.drop("found").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (row, id, spans) per row of ``docs``. Missing and empty texts have no spans, repeated rows are
    scanned each for itself, an empty table gives no rows. Other columns are not read."""
    return _spans(numbered(docs), id_column, text)


def _spans(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """``secret_spans`` of rows with a number; ``find_spans`` stores the numbers it reads."""
    slim = rows.select(F.col(ROW).alias("row"), column(rows, id_column).alias("id"), column(rows, text).alias("text"))
    with Scratch(rows.sparkSession, "secret-places") as temp:
        return find_spans(slim, Scratch(rows.sparkSession, "secrets"), temp)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind and the spans as text."""
    at = {k.name: i for i, k in enumerate(KINDS)}
    base = F.filter("spans", lambda s: s["kind"].isin([at[n] for n in BASE]))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == at[n])).cast("bigint").alias(f"n_{n}")
    return found.select(
        "id",
        *(count(n) for n in BASE),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by ``[secret]``; spans that overlap become one. ``size`` becomes the number of
    code points of the new text. Texts without spans stay as they are."""
    spark = docs.sparkSession
    rows = Scratch(spark, "secret-rows").cut(numbered(docs))
    found = _spans(rows, id_column, text).filter(F.size("spans") > 0).select(F.col("row").alias(ROW), F.col("spans").alias("_tp_spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state, span):
        fresh = span["start"] >= state["at"]
        between = F.substring(F.col(_q(text)), state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int"))
        out = F.when(fresh, F.concat(state["out"], between, F.lit("[secret]"))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    done = F.aggregate("_tp_spans", start, step)
    rest = F.substring(F.col(_q(text)), done["at"].cast("int") + 1, F.length(F.col(_q(text))))
    clean = F.when(F.col("_tp_spans").isNotNull(), F.concat(done["out"], rest)).otherwise(F.col(_q(text)))
    joined = rows.join(found, ROW, "left").withColumn(text, clean)
    if size in docs.columns:
        kind = docs.schema[size].dataType
        joined = joined.withColumn(size, F.when(F.col("_tp_spans").isNotNull(), F.length(F.col(_q(text))).cast(kind)).otherwise(F.col(_q(size))))
    return joined.select(*(F.col(_q(c)) for c in docs.columns))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
