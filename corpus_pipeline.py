"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows and reads them again, and
deletes the tables that a stage made for itself once its result is written.

Defined results, for all stages: a null text counts as empty and fails the quality rules; a
null language or source is a group of its own; a null doc_id loses to any other; rows that
repeat doc_id and text are one after exact dedup; ties fall to the larger doc_id there and
to the smaller in near dedup; an empty table gives an empty one; columns besides those of
``documents`` are carried along to packing, whatever their names; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdag.llm import exact_dedup, packing, quality, secrets, shingles
from loomdag.llm.common import write_table
from loomdag.llm.queries import SEQUENCE, tokenizer_path
from loomdag.sources.shared import drop_tables, recording

#: Packed pieces are tokens of this vocabulary file.
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: candidates of the SimHash trie join and, beyond its
    budget, of MinHash bands, confirmed by Jaccard; of each class the row with the least
    doc_id stays."""
    return shingles.drop_similar(docs, width=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and ``n_chars`` with it; every document stays."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with ids, sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(VOCABULARY), SEQUENCE)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", pack_sequences),
]

#: Sketches, MinHash, the randomness battery and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with recording() as made:
            out = stage(spark, docs, sf_dir)
        with recording() as written:
            docs = write_table(out, name.replace(" ", "-"))
        # what the stage read and made for itself isn't read any more
        drop_tables(spark, [*made, *before])
        before = written
    packed = STAGES[-1][1](spark, docs, sf_dir)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
