"""Streams of questions and of arriving statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Recorded, Remote, Rules
from ..operators.retrieve import prepared
from ..plans.answer import answer
from ..sources.files import write_logs


def answer_stream(questions: DataFrame, triples: DataFrame, provider: Rules | Recorded | Remote, out: str, checkpoint: str) -> StreamingQuery:
    """Answer each micro-batch of ``questions(key, question)`` and append the logs under ``out``. What all batches need
    of the graph is computed once, before the first."""
    graph = prepared(triples)

    def batch(rows: DataFrame, number: int) -> None:
        write_logs(answer(rows, triples, provider, graph=graph), out, f"batch-{number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def statements_by_window(statements: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of statements by kind and event-time window; rows later than the watermark are dropped by it.

    ``statements(assertion_id, type, asserted_at)``; repeated deliveries within the watermark count once.
    """
    s = statements.withColumn("asserted_at", F.col("asserted_at").cast("timestamp")).withWatermark("asserted_at", late)
    return s.dropDuplicatesWithinWatermark(["assertion_id"]).groupBy(F.window("asserted_at", width), "type").agg(F.count(F.lit(1)).alias("n"))
