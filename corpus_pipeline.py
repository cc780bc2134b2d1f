"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, personal data, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, the last one the encoded documents. ``run`` applies them in order; between stages the rows are
written to the shared folder and read again, so a stage that reads its input twice does not compute it twice.

Null texts fail the quality rules; null languages, sources and doc_ids are kept as such. Of repeated rows the second
stage keeps one, of ties in doc_id the first row. An empty table gives an empty table with the same columns, after the
last stage with those of the encoding. Extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import bpe, decontaminate, jaccard_join, pii, quality
from sessionlake.llm.common import table, written
from sessionlake.llm.queries import word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far outside their language and source go."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, the one of the smallest doc_id stays."""
    return jaccard_join.deduplicated(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; the count of characters follows."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every document left."""
    return bpe.encode_documents(docs, word_bpe())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("BPE encoding", encoding),
]

#: The robust estimates, the components and the tokens are beyond SQL; tests/llm tests each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
