"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm import ann, chat, html_extract, mixing, packing, phrases, pieces, quality, repair, simhash, substrings, token_files, winnow
from txguard.llm.oracles import ORACLES as ORACLES
from txguard.llm.text import ROW, identified, stored
from txguard.session import scratch_path, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, with the session settings that the operators here rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    shared_folder(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.scored(docs, labels).select("doc_id", "held_out", "score", "predicted")


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mixture(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.edited_fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
    sha = F.sha2(F.col("edited_text"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], given.schema)
    output = stored(chat.formatted(given.unionByName(added)), "chat")
    read = chat.parsed(output)
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    lost = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def cross_polytope_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(table(spark, folder, "embeddings"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extract.extracted(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def byte_bpe() -> str:
    """The installed tokenizer file of the contract."""
    return public_tokenizers.path("byte_bpe_50k.json")


def simple8b_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, byte_bpe())
    return token_files.read_token_files(spark, path)


def packing_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), byte_bpe()).drop("ids")


def damaged(conversations: DataFrame) -> DataFrame:
    """A fifth of all turns damaged in one of five ways, chosen by the CRC-32 of conversation and turn; null is a space."""
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = identified(conversations).select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), ROW,
        F.crc32(name.cast("binary")).alias("crc") % 20,
    ).toDF("conv_id", "turn", "role", "text", ROW, "way")
    way = F.col("way")
    text = F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(way == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(way != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), ROW, F.explode(copies).alias("copy"))


def structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    return repair.repaired_conversations(damaged(given), given)


def piece_bpe() -> str:
    """The installed model file of the contract."""
    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encoded(table(spark, folder, "documents"), piece_bpe())
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": quality_classifier,
    "op2_simhash_near_dedup": simhash_near_dedup,
    "op3_mixing_sources": mixing_sources,
    "op4_cross_polytope_neighbours": cross_polytope_neighbours,
    "op5_substring_dedup": substring_dedup,
    "op6_html_extraction": html_extraction,
    "op7_simple8b_token_files": simple8b_token_files,
    "op8_winnowing": winnowing,
    "op9_chat_formatting": chat_formatting,
    "op10_packing": packing_sequences,
    "op11_structure_repair": structure_repair,
    "op12_sentencepiece": sentencepiece_encoding,
    "op13_phrase_mining": phrase_mining,
}
