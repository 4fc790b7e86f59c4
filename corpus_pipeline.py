"""The corpus pipeline: documents through five operators, each stage written and reread before the next.

Edge cases: null or empty texts, null ids and sources, repeated rows and very long texts go through as each operator's module states; repeated
rows stay or go together. Extra columns, whatever their names, are kept by all stages but the last. Empty tables give empty results: without
labels nothing is rejected, without a benchmark nothing is contaminated.
"""

from pyspark.sql import DataFrame, SparkSession

from cinderflow.llm import decontamination, jaccard_join, mixing, quality_classifier, token_ids
from cinderflow.storage import remove, scratch, ship_package, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles, the one with the smallest doc_id stays."""
    ship_package(spark)
    return jaccard_join.kept(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: left out, in part, or repeated."""
    ship_package(spark)
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written in the file format and read back: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)
    return token_ids.write_and_read(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next; what only an earlier stage read is removed."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as own:
            docs = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                own.keep_all()
                break
            docs = written(docs, f"stage-{k}")
            kept = own.keep()
        if held:
            remove(spark, held)
        held = kept
    return docs


#: A trained classifier and a tokenizer have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None
