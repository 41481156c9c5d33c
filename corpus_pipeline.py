"""The corpus pipeline: quality rules, near duplicates, surrogates, mixing, packing.

Each stage works on all that the one before it kept, and all but the last give the
columns of the documents, whatever else those are called. Edge cases: a null or empty
text fails the quality rules; rows with a null id are kept apart and pass the
near-duplicate stage; of repeated rows one stays, and of texts that share an id those
that are nobody's near copy; a null source is mixed as a source of its own; a document
comes twice where its source has a second pass; very long texts are worked on whole and
packed in pieces; an empty table, or one of which nothing is kept, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import written
from lectern.llm.jaccard_join import distinct_documents
from lectern.llm.mixing import mixed_documents
from lectern.llm.packing import packed_documents
from lectern.llm.pii import private_documents
from lectern.llm.quality import kept_documents

#: Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality_rules", kept_documents),
    ("jaccard_join", distinct_documents),
    ("pii", private_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

#: Surrogates and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the mixed corpus in their sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
