"""One registered query per operator, over whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profseek.functions.shared import ship_package
from profseek.llm.byte_bpe import round_trip
from profseek.llm.chat import formatted, linear_trees, masked_text, read_back
from profseek.llm.extract import extracted
from profseek.llm.line_dedup import without_widespread_lines
from profseek.llm.manifest import folded, leaf_digest, manifest, proof_digest
from profseek.llm.near_dedup import near_duplicates
from profseek.llm.packing import packed_documents
from profseek.llm.personal_data import KINDS, found_spans, written
from profseek.llm.quality import judged
from profseek.llm.repair import Repair, damaged, digests, empty_digest
from profseek.llm.token_counts import token_counts
from profseek.llm.vector_search import nearest_neighbours
from profseek.llm.warc import archive_round_trip

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = judged(_read(spark, sf, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "n_stop_words")


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = without_widespread_lines(_read(spark, sf, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = found_spans(_read(spark, sf, "documents"), doc_id="doc_id")
    count = lambda kind: F.size(F.filter("seeds", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                        F.sha2(written(F.col("seeds")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(_read(spark, sf, "documents"), WORD_BPE)


def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    chats = formatted(linear_trees(rows.unionByName(extra)))
    read = chats.select("tree", "conversation", "loss_spans", read_back(F.col("conversation")).alias("turns"))
    masked = read.withColumn("masked", masked_text(F.col("conversation"), F.col("loss_spans")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return masked.select(
        F.col("tree.id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"))


def op6_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(_read(spark, sf, "documents"), WORD_BPE)


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(_read(spark, sf, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_read(spark, sf, "documents"), words=2)


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archive_round_trip(_read(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    table = _read(spark, sf, "conversations")
    repair = Repair(damaged(table))
    chat = lambda c: F.struct(F.col(c).alias("id")).alias("chat")
    every = table.select(chat("conv_id")).distinct()
    report = repair.report().select(chat("id"), "*").drop("id")
    hashed = digests(repair.rows()).select(chat("id"), "digest")
    found = every.join(report, "chat", "left").join(hashed, "chat", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("chat.id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("digest", empty_digest()).alias("repaired_sha256"))


def op12_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(_read(spark, sf, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.col("n_chars").cast("decimal(20,0)") + 1
    claimed = F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf_digest(
        [changed if c == "n_chars" else F.col(c) for c in columns])).otherwise(leaf_digest([F.col(c) for c in columns]))
    rows = manifest(docs, columns, "lang", "doc_id", {"claimed": claimed})
    found = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias(
        "proof_sha256"), folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_personal_data,
                                op4_token_counts, op5_chat_format, op6_vector_search, op7_best_fit_packing,
                                op8_byte_bpe,
                                op9_minhash_near_dedup, op10_warc, op11_conversation_repair,
                                op12_html_extraction, op13_merkle_manifest)}
