"""Ingestion of conversation turns on Structured Streaming: each event once, late ones within a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MOST_CHARS = 4000


def shortened(text: Column, most: int = MOST_CHARS) -> Column:
    """Texts over `most` characters end at the last sentence within them, else at the last space, else there."""
    head = F.substring(text, 1, most)
    sentence, word = F.regexp_extract(head, r"(?s)^(.*[.!?])\s", 1), F.regexp_extract(head, r"(?s)^(.*\S)\s", 1)
    return F.when(F.length(text) <= most, text).when(sentence != "", sentence).when(word != "", word).otherwise(head)


def keyed(turns: DataFrame) -> DataFrame:
    """turns (session_id, turn, role, text) with event_id (a hash of all of them, the whole text), the shortened text and its token estimate."""
    whole = F.coalesce("text", F.lit(""))
    event = F.sha2(F.concat_ws("\u0001", F.col("session_id").cast("string"), F.col("turn").cast("string"), "role", whole), 256)
    text = shortened(whole)
    return turns.select(event.alias("event_id"), "session_id", "turn", "role", text.alias("text"), F.floor(F.length(text) / 3).alias("tokens"))


def ingest(turns: DataFrame, path: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Append what is new to Parquet under path.

    The checkpoint keeps the files read and the events that arrived within
    `late`; older ones leave the state, so it does not grow without end.
    """
    arriving = keyed(turns).withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", late)
    once = arriving.dropDuplicatesWithinWatermark(["event_id"]).drop("arrived_at")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
