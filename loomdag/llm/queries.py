"""The thin queries of this subpackage: tables in, the contracted columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdag.llm import oracles, sentencepiece, warc
from loomdag.llm.common import write_table
from loomdag.llm.exact_dedup import exact_dedup
from loomdag.llm.maxent import score_texts
from loomdag.llm.packing import pack
from loomdag.llm.preference import format_pairs, neighbour_pairs
from loomdag.llm.quality import quality_rules
from loomdag.llm.secrets import joined, secret_spans
from loomdag.llm.sharding import assign_shards
from loomdag.llm.simhash import near_duplicates
from loomdag.llm.tokens import token_pieces

SHARDS = 24
SEQUENCE = 1024
#: Every so many pages one record of the audited replica is damaged.
DAMAGED = 101


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = tokenizer_path("piece_bpe_32k.model")
    coded = sentencepiece.decode(sentencepiece.encode(docs, model), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), SEQUENCE)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(digest, SEQUENCE)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_read(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return format_pairs(turns, neighbour_pairs(turns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), width=3, budget=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("__print")), 16, "0").alias("fingerprint"), F.col("__class").alias("component_id")
    )


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = warc.records(_read(spark, sf_dir, "pages", "page_id", "url", "html"))
    theirs = warc.damage(ours, "page_id", DAMAGED)
    own = write_table(warc.leaves(ours), "warc-ours")
    other = write_table(warc.leaves(theirs), "warc-theirs")
    unlike = warc.audit(warc.build_tree(own), warc.build_tree(other)).select(F.col("index").alias("__at"), "theirs")
    return own.join(unlike, F.col("index") == F.col("__at"), "left").select(
        "page_id", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("digest").alias("record_sha256"),
        F.coalesce("theirs", "digest").alias("replica_sha256"), F.col("__at").isNotNull().alias("corrupted"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "n_lines", "lang", "source")


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_packing": op2_packing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_sharding": op4_sharding,
        "op5_chat_format": op5_chat_format,
        "op6_simhash": op6_simhash,
        "op7_warc_audit": op7_warc_audit,
        "op8_quality": op8_quality,
        "op9_maxent_lm": op9_maxent_lm,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
