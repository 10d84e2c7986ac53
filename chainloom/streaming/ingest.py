"""Ledgers that grow: blocks that arrive, and watchlists that are matched as they do.

Raw blocks land as Parquet files of (height, block_hash, raw). A micro-batch is
parsed once and all tables are written from it under its range of heights, which
makes a batch that runs again overwrite itself. What needs the whole past, such
as resolved spends, is derived from the landed tables afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainloom.functions.hashing import hash160
from chainloom.functions.scripts import script_pushes
from chainloom.plans import nonces, reveal
from chainloom.plans.ingest import parsed

RAW = "height int, block_hash binary, raw binary"


def landed(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The stream of raw blocks of a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(folder)


def _batch(out: str):
    def run(df: DataFrame, batch_id: int) -> None:
        rows = parsed(df).persist()
        try:
            inputs = rows.select("height", F.explode("txs").alias("t")).where("not t.coinbase").select("height", F.explode("t.inputs").alias("i")).select("height", "i.*")
            inputs = inputs.withColumn("pushes", script_pushes("script_sig"))
            sinks = {"parsed": rows, "revelations": reveal.sightings(inputs), "nonces": nonces.census(nonces.extracted(inputs))}
            for name, table in sinks.items():
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    return run


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parses what has landed and writes parsed blocks, sightings and nonces; ends when all of it is done."""
    return stream.writeStream.foreachBatch(_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revelations(spark: SparkSession, out: str) -> DataFrame:
    """The reduction of all batches' sightings: order and batches don't matter."""
    return reveal.reduced(spark.read.parquet(f"{out}/revelations").drop("batch"))


def matched(stream: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(height, txid, lock, value, label) of outputs that pay a lock of watchlist(lock, label), as blocks arrive.

    The watchlist is a caller's, small, and broadcast; a stream joined to it keeps
    no state.
    """
    rows = parsed(stream).select("height", F.explode("txs").alias("t")).select("height", "t.txid", F.explode("t.outputs").alias("o"))
    rows = rows.select("height", "txid", hash160("o.script").alias("lock"), "o.value")
    return rows.join(F.broadcast(watchlist), "lock").select("height", "txid", "lock", "value", "label")
