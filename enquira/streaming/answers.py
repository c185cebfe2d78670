"""Answers and audit rows for a stream of queries against a stored index.

The index is a snapshot: tables of one folder that do not change while a stream runs.  Every micro-batch is joined with it as a
static table and written to a folder of its own, so that a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from enquira.operators.retrieval import keyword_bonus, tfidf_index, tfidf_search

PARTS = ("postings", "idf", "faq")


class IndexSnapshot:
    """Postings, term weights and questions, written once and read by every batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, faq: DataFrame, folder: str) -> IndexSnapshot:
        """Index ``faq`` (idx, document, question, answer, category, institution, keywords) into a new folder."""
        snapshot = cls(faq.sparkSession, folder)
        postings, idf = tfidf_index(faq)
        for name, df in zip(PARTS, (postings, idf, faq)):
            df.write.parquet(f"{snapshot.folder}/{name}")
        return snapshot

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        found = tfidf_search(queries, self.table("postings"), self.table("idf"), k)
        return keyword_bonus(found, queries, self.table("faq"))


#: Makes rows of queries, their hits and the questions.
Answer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def answer_stream(queries: DataFrame, snapshot: IndexSnapshot, answer: Answer, out: str, k: int = 5) -> DataFrame:
    """Answer all queries that are available and return the rows; a later call with the same ``out`` goes on after them.

    ``answer`` is ``route_answers`` or ``audit_rows`` with its settings."""
    spark = snapshot.spark

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows, snapshot.search(rows, k), snapshot.table("faq")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    started = queries.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")
