"""Batch scoring of a stored linear model, applied unchanged to a stream of new reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from triagemill.operators.models import load_linear, score_linear


def score_stream(
    reports: DataFrame, key: str, branches, model_path: str, sink: str, checkpoint: str
) -> StreamingQuery:
    """Score every micro-batch of ``reports`` and append the predictions to ``sink``.

    Each batch writes its own folder and overwrites it when the batch is replayed, so a
    restart after a failure neither loses nor repeats predictions.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        terms, labels = load_linear(batch.sparkSession, model_path)
        predictions = score_linear(batch, key, branches, terms, labels)
        predictions.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        reports.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
