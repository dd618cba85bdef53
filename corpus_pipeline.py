"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; the last gives pieces in sequences.
"""

import public_tokenizers
from pyspark.sql import functions as F

from courtflow.llm import mixing, packing, quality, secret_scan, simhash
from courtflow.session import staged


def quality_rules(spark, docs, sf_dir):
    """Documents that the base and the risk-controlled rules keep; labels are joined by doc_id."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash class (4-word shingles, 4 bits): that with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def secrets(spark, docs, sf_dir):
    """All documents, secrets in their texts replaced."""
    return secret_scan.redact(docs)


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.copies(docs)


def sequences(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("sequences", sequences),
]
#: no SQL: fingerprints, forest, rounding and tokens are beyond it; the stages are tested against plain loops
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the documents of ``sf_dir``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
