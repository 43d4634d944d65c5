"""Toxic texts by a weighted lexicon, matched with Aho-Corasick after look-alike letters are folded.

The lexicon is learned from labelled texts: whole words and word beginnings that stand far more often in toxic texts, each
with the logarithm of how much more often. A text's matches add up their weights, except where a match lies inside an
exception phrase, a pair of words with a lexicon entry that clean texts use. The sum and the sum over the length of the
text go through a logistic curve fitted on the same texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, column

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(
    zip(
        "авсԁеһіјкӏмнорԛѕтԝхуαβγικνορτυχ",
        "abcdehijkimhopqstwxyabyiknoptux",
    )
)
# Digits and signs used for letters. One, the bar, the exclamation mark and l all become i.
DIGITS = str.maketrans("0134578@$|!l", "oieastbasiii")
_DROPPED = [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
_FOLD = str.maketrans(LOOK_ALIKE) | dict.fromkeys(_DROPPED)
_MIXED = re.compile(r"(?<![^\W\d_])[0134578@$|!]*[^\W\d_][\w@$|!]*[0134578@$|!][\w@$|!]*|[0134578@$|!]+[^\W\d_][\w@$|!]*")
_GAPS = re.compile(r"[\W\d_]+")

#: Labelled texts that the lexicon and the curve are fitted on, at most.
FIT_ROWS = 20_000
#: Entries of the lexicon, at most.
ENTRIES = 2_000
PREFIXES = range(3, 9)
#: An entry stands at least e^1.5 times as often in toxic texts, and its counts are no accident.
LEAST_WEIGHT = 1.5
SURE = 20.0


def folded(text: str | None) -> str:
    """Lower-case words between single blanks, a blank at both ends: accents dropped, look-alikes of other scripts and digits
    within words replaced, l written as i."""
    t = (text or "").casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_FOLD)
    t = _MIXED.sub(lambda m: m[0].rstrip("!").translate(DIGITS) + " ", t)
    return " " + _GAPS.sub(" ", t).strip().replace("l", "i") + " "


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]  # " word " or " beginning"
    exceptions: tuple[str, ...]  # " two words "
    curve: tuple[float, float, float]  # constant, for the sum, for the sum by length


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.lexicon:
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(start, weight) of the matches in folded text that lie in no exception."""
        if not len(self.automaton):
            return []
        found = [(end - size + 1, end, weight) for end, (size, weight) in self.automaton.iter(text)]
        excepted = [(a, b) for a, b, weight in found if not weight]
        return [(a, w) for a, b, w in found if w and not any(x <= a and b <= y for x, y in excepted)]

    def features(self, text: str) -> tuple[float, float]:
        """Logarithm of the summed weights, and the sum per 100 words."""
        total = sum(w for _, w in self.matches(text))
        return math.log1p(total), min(total / (text.count(" ") - 1 + 20) * 100, 50.0)

    def score(self, text: str) -> float:
        a, b, c = self.model.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


@lru_cache(maxsize=4)
def matcher(model: Model) -> Matcher:
    return Matcher(model)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            texts = [folded(t) for t in batch.column("text").to_pylist()]
            # The smallest hash of five words: near copies mostly share it.
            sketch = []
            for t in texts:
                words = t.split()
                runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
                sketch.append(min(xxhash.xxh64_intdigest(r) for r in runs) >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts), pa.array(sketch, pa.int64()), batch.column("toxic").cast(pa.int32())], names=["text", "sketch", "toxic"]
            )


def _counted(items):
    """Texts per item and label, added up inside a task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["item", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[1 if label else 0].update(items(text))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield flush()
        yield flush()

    return run


def _words_and_beginnings(text: str) -> set[str]:
    words = set(text.split())
    out = {f" {w} " for w in words if 2 < len(w) <= 30}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return out


def _counts(sample: DataFrame, items) -> DataFrame:
    counted = sample.select("text", "toxic").mapInArrow(_counted(items), "item string, clean bigint, toxic bigint")
    return counted.groupBy("item").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> Model:
    """Model from ``docs`` and ``labels`` (doc_id, toxic), fitted on at most ``FIT_ROWS`` labelled texts, of near copies one. The
    caller leaves out of ``labels`` what must not be learned from. Null labels are ignored; without toxic and clean
    texts the lexicon is empty."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select(column(docs, id_column).cast("bigint").alias("doc_id"), column(docs, text).alias("text"))
    with Scratch(docs.sparkSession, "toxicity-sample") as temp:
        picked = temp.cut(picked)  # at most FIT_ROWS rows of two numbers
        sample = texts.join(F.broadcast(picked), "doc_id").select("text", "toxic")
        sample = temp.cut(sample.mapInArrow(_prepared, "text string, sketch bigint, toxic int"))
        sample = temp.cut(sample.groupBy("sketch", "toxic").agg(F.min("text").alias("text")))
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        clean, toxic = n.get(0, 0), sum(v for k, v in n.items() if k)
        if not clean or not toxic:
            return Model((), (), (-2.0, 1.0, 0.0))
        least = max(3, toxic // 100)
        t, c, share = F.col("toxic"), F.col("clean"), toxic / (toxic + clean)
        odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
        # How surely the counts differ from the share of toxic texts: twice the log-likelihood ratio.
        sure = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
        found = _counts(sample, _words_and_beginnings).filter(t >= least).withColumn("weight", odds).withColumn("sure", sure)
        best = found.filter((F.col("weight") > LEAST_WEIGHT) & (F.col("sure") > SURE)).orderBy(F.desc("sure"), "item").limit(10 * ENTRIES)
        lexicon = _distinct({r["item"]: (r["weight"], r["toxic"], r["sure"]) for r in best.collect()})
        first = Model(tuple(lexicon), (), (0.0, 1.0, 0.0))
        pairs = _counts(sample, _Pairs(first)).filter((F.col("clean") >= least) & (F.col("clean") > F.col("toxic") * (4 * clean / toxic)))
        exceptions = sorted(r["item"] for r in pairs.orderBy(F.desc("clean"), "item").limit(ENTRIES).collect())
        second = Model(first.lexicon, tuple(exceptions), first.curve)
        rows = sample.mapInArrow(_featured(second), "x double, y double, toxic int").toPandas()  # at most FIT_ROWS rows
    return Model(second.lexicon, second.exceptions, _curve(rows[["x", "y"]].to_numpy(), (rows["toxic"] > 0).to_numpy(float)))


def _distinct(found: dict[str, tuple[float, int, float]]) -> list[tuple[str, float]]:
    """The surest of the entries (weight, toxic texts, sureness) of which none is the beginning of another; of equally sure ones the
    shorter. Each is then made as long as it can be while it keeps nearly all its toxic texts, so that a beginning that only
    one word has becomes that word."""
    kept: list[str] = []
    beginnings: set[str] = set()
    for item, _ in sorted(found.items(), key=lambda x: (-x[1][2], len(x[0]), x[0])):
        own = [item[:n] for n in range(1 + PREFIXES[0], len(item))]
        if item not in beginnings and not any(o in kept for o in own):
            kept.append(item)
            beginnings.update(own)
    kept = kept[:ENTRIES]
    longer = {k: max((i for i in found if i.startswith(k) and found[i][1] >= 0.95 * found[k][1]), key=len) for k in kept}
    return [(longer[k], round(found[longer[k]][0], 6)) for k in kept]


class _Pairs:
    """Pairs of neighbouring words of which one holds a match."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, text: str) -> set[str]:
        out = set()
        for start, _ in matcher(self.model).matches(text):
            here = text.index(" ", start + 1)
            before = text.rfind(" ", 0, start)
            after = text.find(" ", here + 1)
            if before >= 0:
                out.add(text[before : here + 1])
            if after > 0:
                out.add(text[start : after + 1])
        return out


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for batch in batches:
            values = [m.features(t) for t in batch.column("text").to_pylist()]
            x, y = (pa.array([v[i] for v in values], pa.float64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([x, y, batch.column("toxic")], names=["x", "y", "toxic"])

    return run


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(text: Column, model: Model) -> Column:
    """Score between 0 and 1 of a text; higher is likelier toxic. Missing and empty texts get the score of a text without
    matches."""

    def scored(texts: pd.Series) -> pd.Series:
        m = matcher(model)
        return pd.Series([m.score(folded(t)) for t in texts], dtype=float)

    return F.pandas_udf(scored, "double")(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: a third of all ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Scores from here on count as toxic.
CUT = 0.7


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below ``CUT``, with all their columns. An empty table gives no rows."""
    return docs.filter(score(column(docs, text), model) < CUT)
