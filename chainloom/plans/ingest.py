"""From raw blocks to the tables of a ledger."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.hashing import hash160
from chainloom.functions.scripts import script_pushes
from chainloom.plans.ledger import ordinals, resolve, txid_index
from chainloom.sources.parse import BlockError, block

INPUT = "struct<prev_txid:binary,prev_vout:bigint,script_sig:binary,sequence:bigint,witness:array<binary>>"
TX = f"struct<txid:binary,wtxid:binary,coinbase:boolean,inputs:array<{INPUT}>,outputs:array<struct<value:bigint,script:binary>>>"
PARSED = f"height int, block_id binary, header binary, version bigint, prev_hash binary, merkle_root binary, time bigint, bits bigint, nonce bigint, size bigint, weight bigint, coinbase_script binary, txs array<{TX}>"
FIELDS = [f.split(" ")[0] for f in PARSED.split(", ")]
_binary, _long = pa.binary(), pa.int64()
_input = pa.struct([("prev_txid", _binary), ("prev_vout", _long), ("script_sig", _binary), ("sequence", _long), ("witness", pa.list_(_binary))])
_tx = pa.struct([("txid", _binary), ("wtxid", _binary), ("coinbase", pa.bool_()), ("inputs", pa.list_(_input)), ("outputs", pa.list_(pa.struct([("value", _long), ("script", _binary)])))])
ARROW = pa.schema([("height", pa.int32())] + [(f, _binary if f in ("block_id", "header", "prev_hash", "merkle_root", "coinbase_script") else pa.list_(_tx) if f == "txs" else _long) for f in FIELDS[1:]])
#: Values are below this: 2**56.
MOST = 1 << 56


def parsed(raw: DataFrame) -> DataFrame:
    """raw(height, block_hash, raw) -> a nested row for each block; a block that doesn't hold together stops the query."""

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a batch of blocks can be large
                one = batch.slice(i, 1).to_pylist()[0]
                try:
                    own = block(one["raw"], one["block_hash"])
                except BlockError as e:
                    raise BlockError(f"height {one['height']}: {e}") from None
                if any(o["value"] >= MOST for t in own["txs"] for o in t["outputs"]):
                    raise BlockError(f"height {one['height']}: a value of 2**56 or more")
                yield pa.RecordBatch.from_pylist([{"height": one["height"]} | own], ARROW)

    return raw.select("height", "block_hash", "raw").mapInArrow(parse, PARSED)


@dataclass
class Tables:
    """The tables of a range of heights."""

    blocks: DataFrame
    txs: DataFrame
    outputs: DataFrame
    inputs: DataFrame
    spends: DataFrame

    def reveals(self) -> DataFrame:
        """(height, pushes, witness, ...) of inputs that spend something."""
        return self.inputs.where("not coinbase").withColumn("pushes", script_pushes("script_sig"))


def linked(blocks: DataFrame) -> DataFrame:
    """blocks, or a stop where one does not follow the one below it."""
    from pyspark.sql import Window

    up = Window.orderBy("height")
    broken = (F.lag("block_id").over(up) != F.col("prev_hash")) | (F.lag("height").over(up) + 1 != F.col("height"))
    kept = F.when(~F.coalesce(broken, F.lit(False)), F.col("height")).otherwise(F.raise_error(F.concat(F.lit("no link below height "), F.col("height"))).cast("int"))
    return blocks.withColumn("height", kept)


def tables(rows: DataFrame, tolerate: bool = False) -> Tables:
    """Tables of parsed blocks; rows should be a written table, as it is read several times.

    tolerate: inputs that spend an unknown transaction have no output, instead of
    stopping the query.
    """
    rows = rows.withColumn("height", F.col("height").cast("long"))
    blocks = linked(rows.withColumn("n_tx", F.size("txs").cast("long")).drop("txs"))
    txs = rows.select("height", F.posexplode("txs").alias("pos", "t")).select("height", F.col("pos").cast("long").alias("pos"), "t.*")
    txs = ordinals(txs.withColumn("n_out", F.size("outputs").cast("long")), "height", [F.col("pos")], F.col("n_out"), "tx_ord", "first_out")
    outputs = txs.select("height", "tx_ord", "first_out", F.posexplode("outputs").alias("vout", "o"))
    outputs = outputs.select((F.col("first_out") + F.col("vout")).alias("out_ord"), "tx_ord", "height", F.col("vout").cast("long").alias("vout"), "o.value", "o.script", hash160("o.script").alias("lock"))
    inputs = txs.select("height", "tx_ord", "coinbase", F.posexplode("inputs").alias("idx", "i")).select("height", "tx_ord", "coinbase", "idx", "i.*")
    heads = txs.select("tx_ord", "height", "pos", "txid", "wtxid", "coinbase", "first_out", "n_out")
    asked = inputs.where("not coinbase").select(F.col("tx_ord").alias("spender_tx"), "prev_txid", "prev_vout")
    spends = resolve(asked, txid_index(heads), tolerate)
    return Tables(blocks, heads, outputs, inputs, spends)
