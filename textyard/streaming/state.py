"""Review pages taken in as they land, in page order, each once, until a source is done."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textyard.sources.reviews import SOURCED_PAGE, accepted, reviews_of

OUT = "source string, page bigint, body string, take int"
# next page, reviews taken, whether the source is done, pages that wait for an earlier one
STATE = "next bigint, taken bigint, done boolean, waiting string"


def _decide(target: int):
    """Which pages of a source count, and how many of their reviews.

    Pages are taken in the order of their numbers: one that comes early waits, one that was taken or waits already is
    dropped. A page without success or reviews ends its source, as does an empty cursor behind a page and the target.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, taken, done, held = state.get if state.exists else (0, 0, False, "{}")
        waiting = json.loads(held)
        for frame in frames:
            for row in frame.itertuples(index=False):
                if not done and row.page >= following:
                    waiting.setdefault(str(row.page), [bool(row.good), bool(row.last), int(row.n), row.body])
        out = []
        while not done and str(following) in waiting:
            good, last, n, body = waiting.pop(str(following))
            if not good:
                done = True
                break
            take = min(n, target - taken)
            taken += take
            if take:
                out.append((key[0], following, body, take))
            following += 1
            done = last or taken >= target
        state.update((following, taken, done, json.dumps({} if done else waiting)))
        yield pd.DataFrame(out, columns=["source", "page", "body", "take"])

    return run


def page_files(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    reader = spark.readStream.schema(SOURCED_PAGE).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def reviews_until(pages: DataFrame, target: int) -> DataFrame:
    """``(source, text, label)`` of a stream of pages: the first ``target`` accepted reviews of every source.

    Reviews are trimmed, measured and cut by column expressions; the state of a source is four values and the pages that
    wait, not its reviews.
    """
    measured = accepted(pages)
    narrow = measured.select("source", "page", "good", "last", F.size("kept").alias("n"), F.to_json("kept").alias("body"))
    taken = narrow.groupBy("source").applyInPandasWithState(_decide(target), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    kept = F.slice(F.from_json("body", T.ArrayType(reviews_of())), F.lit(1), F.col("take"))
    return taken.select("source", F.inline(kept))


def ingest_until(spark: SparkSession, folder: str, out: str, checkpoint: str, target: int, files_per_trigger: int = 1_000) -> StreamingQuery:
    """Take in all files landed since the last call; a restart goes on with the state in ``checkpoint`` (shared storage)."""
    rows = reviews_until(page_files(spark, folder, files_per_trigger), target)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
