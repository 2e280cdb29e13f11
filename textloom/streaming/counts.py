"""Running token counts of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_vocabulary(docs: DataFrame) -> DataFrame:
    """``item, freq`` for update or complete output; also right on a batch."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("item")).groupBy("item").agg(F.count("*").alias("freq"))
