"""A table of the attempts to have requests answered, which a later run continues.

Each round sends, in one batch job, only requests that have no good reply yet and attempts left, and appends what came
back. After the last round, what has no good reply is set aside with its last reply. A request whose good reply the table
holds is not sent again, by this run or a later one; only a task that dies before its round is written may send its batch
again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom import config
from layerloom.operators.replies import ATTEMPTS, request_replies

LEDGER = "id long, attempt int, raw string, good boolean"


def is_object(raw: Column | str) -> Column:
    """Whether a reply is a JSON object, which is what requests ask for."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))


class RequestLedger:
    """The attempts below ``path``: (id, attempt, raw, good), one folder for each round."""

    def __init__(self, spark: SparkSession, path: str, good: Callable[[str], Column] = is_object):
        self.spark, self.path, self.good = spark, path, good
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def attempts(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def open_requests(self, requests: DataFrame, most: int = ATTEMPTS) -> DataFrame:
        """``requests`` (id, request) without a good reply that have attempts left, with the number of the next one."""
        tried = self.attempts().groupBy("id").agg(F.max("attempt").alias("last"), F.bool_or("good").alias("done"))
        rows = requests.join(tried, "id", "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("last", F.lit(0)) < most))
        return rows.select("id", "request", (F.coalesce("last", F.lit(0)) + 1).alias("attempt"))

    def run(self, requests: DataFrame, ask: Callable[[list[str]], list[str]], most: int = ATTEMPTS, batch: int = config.EMBED_BATCH) -> int:
        """Sends what is open until nothing is, ``most`` attempts a request; returns the number of rounds."""
        requests = requests.select("id", "request").dropDuplicates(["id"])
        for rounds in range(most + 1):
            todo = self.open_requests(requests, most)
            if rounds == most or todo.isEmpty():
                return rounds
            said = request_replies(todo, ask, batch)
            rows = said.join(todo.select("id", "attempt"), "id").select("id", "attempt", "raw", self.good("raw").alias("good"))
            rows.write.mode("append").parquet(self.path)
        return most

    def replies(self) -> DataFrame:
        """(id, raw, attempt): the first good reply of each request."""
        first = F.min(F.struct("attempt", "raw")).alias("first")
        return self.attempts().where("good").groupBy("id").agg(first).select("id", "first.raw", "first.attempt")

    def set_aside(self, requests: DataFrame, most: int = ATTEMPTS) -> DataFrame:
        """(id, attempts, raw) of requests without a good reply after ``most`` attempts, with what came back last."""
        last = self.attempts().groupBy("id").agg(F.max("attempt").alias("attempts"), F.bool_or("good").alias("done"), F.max_by("raw", "attempt").alias("raw"))
        return requests.select("id").distinct().join(last.where(~F.col("done") & (F.col("attempts") >= most)), "id").select("id", "attempts", "raw")
