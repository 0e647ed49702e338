"""Streaming twins: event-time windows, de-duplication, enrichment, and keyed text state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketspark.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A parquet file or folder as a stream, with the schema it has."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling or sliding window; rows later than ``late`` behind the watermark are dropped."""
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys)


def enrich(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; the static side is planned again for each batch."""
    return events.join(dimension, key, "left")


def _keep(state: GroupState, held: str, ended: bool, wait_ms: int | None) -> None:
    """Hold the rest of a text until its next delta; an ended text leaves no state."""
    if not ended and held:
        state.update((held,))
        if wait_ms:
            state.setTimeoutDuration(wait_ms)
    elif state.exists:
        state.remove()


def _timeout(wait_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout


def unmask_stream(deltas: DataFrame, originals: dict[str, str], wait_ms: int | None = None) -> DataFrame:
    """conv_id, seq, text: text deltas with '[CATEGORY_n]' tokens replaced by their originals.

    A token may be split over deltas: what follows the last unclosed '[' is held back in keyed state
    until it closes or the delta that carries ``last`` arrives; where neither comes within ``wait_ms``, the
    rest is given out with a null seq and the state ends (streams that never end should set it).  ``deltas``: conv_id, seq, delta, last.
    ``originals`` is one conversation set's map; longer tokens go first, so [X_10] is not read as [X_1].
    """
    tokens = sorted(originals, key=len, reverse=True)
    longest = max(map(len, tokens), default=0)

    def put_back(s: str) -> str:
        for t in tokens:
            s = s.replace(t, originals[t])
        return s

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], None, put_back(held))] if held else [], columns=["conv_id", "seq", "text"])
            return
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            s = held + (r.delta or "")
            at = s.rfind("[")
            keep = at >= 0 and "]" not in s[at:] and len(s) - at < longest and not r.last
            held = s[at:] if keep else ""
            out.append((key[0], r.seq, put_back(s[:at] if keep else s)))
        _keep(state, held, bool(rows["last"].any()), wait_ms)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "text"])

    return deltas.groupBy("conv_id").applyInPandasWithState(run, "conv_id string, seq long, text string", "held string", "append", _timeout(wait_ms))


def assemble_lines(deltas: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """conv_id, seq, line: text deltas put together to whole lines; the rest of a stream comes with its ``last`` delta.

    ``deltas``: conv_id, seq, delta, last.  The state of a key is its unfinished line; it ends with the
    ``last`` delta, or is given out with a null seq after ``wait_ms`` without one.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], None, held)] if held else [], columns=["conv_id", "seq", "line"])
            return
        held, out = state.get[0] if state.exists else "", []
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            *whole, held = (held + (r.delta or "")).split("\n")
            if r.last and held:
                whole, held = [*whole, held], ""
            out += [(key[0], r.seq, line) for line in whole]
        _keep(state, held, bool(rows["last"].any()), wait_ms)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "line"])

    return deltas.groupBy("conv_id").applyInPandasWithState(run, "conv_id string, seq long, line string", "held string", "append", _timeout(wait_ms))


def valid_rows(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """JSON lines of a known ``column_index``: conv_id, column_index, summary, flag (grey by default); others dropped.

    ``columns``: the known column_index values, a static table.
    """
    parsed = lines.select("conv_id", F.from_json("line", "column_index int, summary string, flag string", {"mode": "PERMISSIVE"}).alias("r"))
    rows = parsed.where("r.column_index IS NOT NULL").select("conv_id", "r.column_index", F.coalesce("r.summary", F.lit("")).alias("summary"), F.coalesce("r.flag", F.lit("grey")).alias("flag"))
    return rows.join(columns.select("column_index").distinct(), "column_index", "left_semi").select("conv_id", "column_index", "summary", "flag")


def block_roots(log: DataFrame, out: str, name: str = "roots") -> None:
    """A Merkle root over the new rows (id, hash) of each micro-batch, appended to the table ``out``.

    Batches are numbered by the stream, and a batch that is run again replaces its own row.
    """
    from docketspark.operators.ledger import merkle_roots

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(number).cast("long").alias("block"), "id", "hash").distinct()
        span = rows.groupBy("block").agg(F.min("id").alias("block_start"), F.max("id").alias("block_end"))
        merkle_roots(rows, "block", "id", "hash").join(span, "block").drop("block").write.mode("overwrite").parquet(f"{out}/batch={number}")

    ensure_checkpoint_dir(log.sparkSession)
    q = log.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-{name}-state").foreachBatch(put).start()
    q.awaitTermination()


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a bounded stream to its end (availableNow) into a table in the shared folder and read it."""
    import uuid

    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"
    sink = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "complete":
        sink = sink.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        sink = sink.outputMode("append").format("parquet").option("path", out)
    q = sink.start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
