"""A corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes to the shared folder and reads again as the next stage's docs. All but the last return the columns of
documents. Labels of documents that are held out, or that an earlier stage dropped, train nothing.

A surrogate is as long as what it replaces, so n_chars stays right after the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspark.llm import minhash, packing, pii, quality, toxicity
from larkspark.llm.common import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, pii.session_key(spark), entities_col=None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, limit=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash near-dedup", near_dedup),
    ("pii surrogates", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
