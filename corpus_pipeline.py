"""From raw documents to sampled token ids: filters, one of each near copy, secrets cut out, a mix, and encoding.

Each stage works on all that the one before it kept, which is written as
Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lapsight.llm import near_duplicates, piece_sampling, quality_rules, secret_scan, source_mix
from lapsight.llm.staging import documents, shared_dir, shuffles_removed

#: (name, function of (spark, docs, sf_dir)). The last stage returns ids, the others the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.keep_good),
    ("near_duplicates", near_duplicates.one_of_each),
    ("secret_scan", secret_scan.redact),
    ("source_mix", source_mix.take),
    ("piece_sampling", piece_sampling.encode_documents),
]

#: SQL can neither hash signatures nor sample a lattice as these stages do; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        with shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
