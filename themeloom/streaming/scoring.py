"""Scoring messages as they arrive and storing each turn exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from themeloom.operators.linear import TopicModel, predict


def stage_predictions(messages: DataFrame, model: TopicModel, folder: str, checkpoint: str,
                      id_col: str = "message_id", text_col: str = "text",
                      keep: tuple[str, ...] = (), **options) -> DataStreamWriter:
    """Score every micro-batch with the batch scorer and a fixed model.

    Scoring groups by message, which a stream cannot do without waiting, so each micro-batch runs
    as a batch job over the model's tables.
    """
    def score(batch: DataFrame) -> DataFrame:
        return predict(model, batch, id_col, text_col, keep=keep, **options)

    return store_batches(messages, folder, checkpoint, score)


def store_batches(stream: DataFrame, folder: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] = lambda df: df
                  ) -> DataStreamWriter:
    """Write each micro-batch into its own folder, named by batch id.

    A replayed batch overwrites its folder, so restarts neither lose nor repeat rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
