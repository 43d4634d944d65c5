"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import alignment, byte_bpe, embedding_join, exact_dedup, near_join, packing, periodic_runs, secret_scan, sharding, token_files, tool_calls, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    placed = sharding.assign_shards(
        docs, "doc_id", sharding.byte_size(docs["text"]), 16, {"text_crc32": F.crc32(text.cast("binary"))}
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    decided = exact_dedup.exact_dedup(table(spark, folder, "documents"))
    return decided.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query
def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


#: What the tools of ``conversation_calls`` accept.
TOOLS = [
    ("ask", "prompt", "string", True, 1.0, 400.0),
    ("ask", "turn", "integer", True, 0.0, 100.0),
    ("configure", "prompt", "string", True, 1.0, 200.0),
    ("configure", "turn", "integer", True, 0.0, 0.0),
]


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of conversations: user and system turns call a tool, an assistant turn is the result of the turn before
    it, and a call depends on the calls one and two turns before it. Identifiers are the turns' numbers, the same in every conversation."""

    def ident(back: int):
        return F.concat(F.lit("call-"), F.col("turn") - back)

    asks = turns.filter(F.col("role").isin("user", "system")).select(
        "conv_id",
        "turn",
        ident(0).alias("call_id"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("tool"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"),
        F.array(ident(1), ident(2)).alias("needs"),
    )
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content")
    )
    return asks, answers


@query
def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, folder, "conversations"))
    schemas = spark.createDataFrame(TOOLS, tool_calls.SCHEMA)
    linked = tool_calls.tool_calls(calls, results, schemas, "conv_id").select(
        "conv_id", "turn", "call_id", "linked", "n_results", "level", F.array_join("problems", "; ").alias("problems"), "valid", "json"
    )
    lost = tool_calls.orphans(results, calls, "conv_id").select("conv_id", "turn", "call_id", F.lit("orphan").alias("linked"))
    return linked.unionByName(lost, allowMissingColumns=True)


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "n_links", "kept"
    )


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = docs.select("doc_id", toxicity.score(docs["text"], toxicity_model(spark, folder, docs)).alias("score"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return files.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), path, pattern), path, pattern)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_join.near_vectors(table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


WORD = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text, by a checksum of its id, repeats itself from some word on."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.floor(check / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        first = seed % n
        period = 1 + F.floor((n - first) / (3 + seed % 8))
        place = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        return F.array_join(F.transform(words, lambda _, i: F.get(words, place(i).cast("int"))), " ")

    # Held in an array of one, the words are found once per text.
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    changed = F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return docs.withColumn("text", F.when(check % 10 == 0, changed).otherwise(F.col("text")))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(table(spark, folder, "documents"))).withColumn("best", periodic_runs.longest())
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    period = -F.col("best.period")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    tokens = alignment.tokenizer_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("written").cast("binary"), 256))
    return alignment.aligned(table(spark, folder, "documents"), tokens, {"groups_sha256": digest}).withColumnRenamed("id", "doc_id")


@query
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archived(table(spark, folder, "pages"))
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").alias("refers_to")
    )
