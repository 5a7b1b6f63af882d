"""Streaming admission: new transcript files are admitted once per content hash, cut into passages, embedded, merged and appended.

The hashes of all admitted texts are kept in Spark's state store, keyed by hash, so a batch reads only its own files and the
states of their hashes, whatever the size of the library. Only names, headers and hashes pass the stateful step; the
texts of a batch's admitted files are read again by their paths, of which a batch has at most ``max_files``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from layerloom import config
from layerloom.functions import text as T
from layerloom.operators import admission, episodes, packing
from layerloom.scratch import written

ADMITTED = "file_id long, path string, title string, guest string, content_hash string, reject_reason string, duplicate_of long"
#: Files of one batch.
MAX_FILES = 10_000


def _first_of_each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The files of one hash: the one that was first, in this batch or before, is admitted, and the others are its copies."""
    first = state.get[0] if state.exists else None
    rows = pd.concat(list(frames), ignore_index=True)
    if first is None:
        first = int(rows["file_id"].min())
        state.update((first,))
        copy = rows["file_id"] != first
    else:
        copy = rows["file_id"] == rows["file_id"]
    rows["reject_reason"] = ["duplicate" if c else None for c in copy]
    rows["duplicate_of"] = pd.array([first if c else None for c in copy], dtype="Int64")
    yield rows


def admitted_files(spark: SparkSession, folder: str, max_files: int = MAX_FILES) -> DataFrame:
    """A stream of ADMITTED's columns: every ``.txt`` file that appears in ``folder``, with the first rule that it fails. A file's id is a hash of its path."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    path = F.col("_metadata.file_path")
    files = files.select(F.xxhash64(path).alias("file_id"), path.alias("path"), F.col("_metadata.file_name").alias("name"), T.strip("value").alias("raw"))
    rows = admission.checked(files, "path")
    names = ["file_id", "path", "title", "guest", "content_hash"]
    good = rows.where("rule IS NULL").select(*names).groupBy("content_hash").applyInPandasWithState(_first_of_each, ADMITTED, "first long", "append", GroupStateTimeout.NoTimeout)
    bad = rows.where("rule IS NOT NULL").select(*names, F.col("rule").alias("reject_reason"), F.lit(None).cast("long").alias("duplicate_of"))
    return good.unionByName(bad)


def ingest_files(spark: SparkSession, folder: str, library: str, checkpoint: str, embed: Callable[[list[str]], list[list[float]]] | None = None, threshold: float = config.MERGE_THRESHOLD, max_files: int = MAX_FILES) -> StreamingQuery:
    """Episodes, rejected files and passages as tables below ``library``. With ``embed``, a plug-in, neighbours are merged.

    A batch writes to its own partition and replaces it, so a batch that runs again after a failure leaves the same
    rows. Runs over what is there and stops.
    """

    def save(rows: DataFrame, table: str, number: int) -> None:
        parted = rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        parted.partitionBy("batch").parquet(f"{library}/{table}")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = written(batch.select("file_id", "path", "title", "guest", "content_hash", "reject_reason", "duplicate_of"))
        save(batch.where("reject_reason IS NOT NULL").select("file_id", "path", "reject_reason", "duplicate_of"), "rejected", number)
        good = batch.where("reject_reason IS NULL").select("file_id", "title", "guest", "content_hash", "path")
        save(good.drop("path"), "episodes", number)
        paths = [r.path for r in good.select("path").collect()]  # max_files at most
        if not paths:
            return
        texts = session.read.format("text").option("wholetext", True).load(paths)
        bodies = texts.select(F.xxhash64("_metadata.file_path").alias("file_id"), T.clean(T.header(T.strip("value")).getField("body")).alias("text"))
        passages = packing.passage(bodies, "file_id")
        if embed is not None:
            raw = passages.withColumnsRenamed({"passage_index": "position", "token_estimate": "tokens"})
            raw = written(episodes.embedded(raw, embed, keep=("episode_id", "position", "content", "tokens")))
            passages = episodes.final_passages(raw, admission.merge_neighbours(raw, threshold))
        save(passages.select("episode_id", "passage_index", "content", "token_estimate"), "passages", number)

    return admitted_files(spark, folder, max_files).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
