"""Each file of a folder taken once, running counts, tokens that grow with the stream."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from eventmill.functions.identity import TOKEN_CAPACITY, TOKEN_WIDTH, token, token_capacity
from eventmill.functions.json_text import record_text
from eventmill.functions.paths import event_field
from eventmill.operators.filters import date_gt
from eventmill.operators.ordering import number_rows
from eventmill.plans.logs import clean_and_desensitize
from eventmill.sources.cached import is_complete
from eventmill.sources.lines import read_lines


def incremental_ingest(
    spark: SparkSession, source: str, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None,
    only_gz: bool = False, file_column: str | None = None, by_content: bool = True,
) -> StreamingQuery:
    """Append the lines of all files not seen before to a Parquet folder, then stop.

    A file counts as taken once its rows are committed; after a failure the run is repeated without doubles. Plain text
    named `.gz` is read as such; where all names are right, `by_content=False` spares the look into the files.
    """
    lines = read_lines(spark, source, only_gz=only_gz, file_column=file_column, streaming=True, by_content=by_content)
    rows = change(lines) if change else lines
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(stream: DataFrame, path: str) -> DataFrame:
    """Events per value of a path; run it in complete or update mode."""
    return stream.groupBy(event_field(stream, path).alias(path)).agg(F.count(F.lit(1)).alias("events"))


def running_field_set(stream: DataFrame, path: str) -> DataFrame:
    """Distinct values of a path, NULL included, each given once: when it first comes. Run it in append or update mode.

    The state holds every value that was seen, by value, over all tasks.
    """
    return stream.select(event_field(stream, path).alias(path)).dropDuplicates()


def running_users(stream: DataFrame, path: str = "username", include_missing: bool = True) -> DataFrame:
    """Distinct users so far, all events without a user counted as one more. Run it in complete or update mode.

    Two steps of state: the users that were seen, spread over the tasks, and one number. An event of a known user goes no
    further than the first.
    """
    seen = running_field_set(stream, path)
    return (seen if include_missing else seen.where(F.col(f"`{path}`").isNotNull())).agg(F.count(F.lit(1)).alias("users"))


class PassingRows(StreamingQueryListener):
    """Rows that passed the probes of streams (`item_count_probe` with a label), summed over their micro-batches.

    Add it to `spark.streams` before the stream starts. `total` waits until everything that a stopped stream has reported
    is here.
    """

    def __init__(self) -> None:
        self._rows: dict[tuple[str, str], int] = {}
        self._ended: dict[str, threading.Event] = {}

    def _end_of(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        for label, row in event.progress.observedMetrics.items():
            key = (str(event.progress.runId), label)
            self._rows[key] = self._rows.get(key, 0) + row["rows"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def total(self, query: StreamingQuery, label: str, timeout: float = 60) -> int:
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(timeout):
            raise TimeoutError(f"the end of stream {query.runId} was not reported")
        return self._rows.get((str(query.runId), label), 0)


def show_stream(stream: DataFrame, rows: int = 20) -> StreamingQuery:
    """Print the first rows of each batch of what is there now."""
    return stream.writeStream.format("console").option("numRows", rows).trigger(availableNow=True).start()


def read_tokens(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema("user string, number bigint, token string, batch bigint").parquet(table)


def token_writer(
    table: str, user: str | Column, ordinal: str, capacity: int | None = None, width: int = TOKEN_WIDTH
) -> Callable[[DataFrame, int], None]:
    """Function for `foreachBatch` that gives new users the next tokens, in order of first appearance in their batch.

    `user` is a path or an expression. Every batch has its own folder, so a batch that is run again replaces what it wrote
    and gives the same tokens. Users of wide tokens are numbered by ranges, not in one task.
    """

    capacity = token_capacity(width, capacity)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not is_complete(spark, f"{table}/batch=-1"):  # so that the table can be read before it has users
            batch.limit(0).select(
                F.lit("").alias("user"), F.lit(0).cast("bigint").alias("number"), F.lit("").alias("token")
            ).write.mode("overwrite").parquet(f"{table}/batch=-1")
        known = read_tokens(spark, table).where(F.col("batch") < number)
        name = event_field(batch, user) if isinstance(user, str) else user
        fresh = (
            batch.where(name.isNotNull()).groupBy(name.alias("user")).agg(F.min(ordinal).alias("first")).join(known, "user", "left_anti")
        )
        # users that are new in a batch have its number, so numbers before it stay as they are
        taken = known.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        if capacity <= TOKEN_CAPACITY:
            ranked = fresh.orderBy("first", "user").limit(capacity - taken + 1)
            ranked = ranked.withColumn("number", F.row_number().over(Window.orderBy("first", "user")) - 1)
        else:
            ranked = number_rows(fresh, "first", "user", name="number")
        full = F.raise_error(F.lit(f"more than {capacity} users, and no token left")).cast("string")
        rows = ranked.select("user", (F.col("number") + taken).cast("bigint").alias("number"))
        rows.withColumn(
            "token", F.when(F.col("number") < capacity, token(F.col("number"), width)).otherwise(full)
        ).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return write


def masking_writer(
    tokens: str, out: str, ordinal: str, mindate: str | None = None, width: int = TOKEN_WIDTH, change: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """Function for `foreachBatch` over parsed records: extends the token table and writes the batch masked with it.

    Both go to folders of the batch's own, `batch=<number>`. A batch that is cut off anywhere and run again finds the tokens
    of earlier batches only, so it gives its users the same tokens and replaces both folders. `change` is applied to the
    masked records before they are written as Parquet.
    """
    user = record_text(F.col("rec")["username"])
    extend = token_writer(tokens, user, ordinal, width=width)

    def write(batch: DataFrame, number: int) -> None:
        # only dated records are written, but all of a batch that counts are named: both see the same rows
        records = date_gt(batch, mindate)
        extend(records, number)
        known = read_tokens(batch.sparkSession, tokens).where(F.col("batch") <= number).select("user", "token")
        masked = clean_and_desensitize(records, ordinal, tokens=known, width=width)
        (change(masked) if change else masked).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def desensitize_stream(
    records: DataFrame, tokens: str, out: str, checkpoint: str, ordinal: str, mindate: str | None = None, width: int = TOKEN_WIDTH,
    change: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Mask a stream of records into a Parquet folder, users by a token table that grows with it; takes what is there, then stops."""
    write = masking_writer(tokens, out, ordinal, mindate, width, change)
    started = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return started.trigger(availableNow=True).start()
