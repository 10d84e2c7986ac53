"""Blocks and headers of a node, by JSON-RPC or REST, as a Spark data source.

    spark.dataSource.register(NodeSource)
    spark.read.format("ledger-node").option("url", ...).option("from", 1).option("to", 100).load()

Each partition is a range of heights that a task fetches, so order and overlap
of the transfers are Spark's business; the height column restores the order.
Options: transport (rpc or rest), kind (block or header), batch (heights of a
request), cookie (file of user:password, on every executor) or auth, tries.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

BLOCKS = StructType([StructField("height", IntegerType()), StructField("block_hash", BinaryType()), StructField("raw", BinaryType())])
HEADERS = StructType([StructField("height", IntegerType()), StructField("block_hash", StringType()), StructField("time", LongType())])
LONGEST_WAIT = 60.0


class NodeError(RuntimeError):
    """The node does not answer, or not what it was asked."""


def credentials(cookie: str | None = None, auth: str | None = None) -> str | None:
    """user:password from a cookie file, a given value or LEDGER_RPC_AUTH; never from a command line."""
    if cookie:
        with open(cookie) as f:
            return f.read().strip()
    return auth or os.environ.get("LEDGER_RPC_AUTH")


class Client:
    """Requests with waits between tries; only what can pass is tried again."""

    def __init__(self, url: str, auth: str | None = None, tries: int = 8, wait: float = 1.0):
        self.url, self.tries, self.wait = url.rstrip("/"), tries, wait
        self.headers = {"Content-Type": "application/json"}
        if auth:
            self.headers["Authorization"] = "Basic " + base64.b64encode(auth.encode()).decode()

    def _open(self, request: urllib.request.Request) -> bytes:
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=120) as reply:
                    return reply.read()
            except urllib.error.HTTPError as e:
                if e.code < 500 or request.data:
                    body = e.read()
                    if request.data and body[:1] in (b"[", b"{"):
                        return body
                    raise NodeError(f"HTTP {e.code} of {request.full_url}") from e
            except OSError:
                pass
            if k + 1 < self.tries:
                time.sleep(min(LONGEST_WAIT, self.wait * 2**k))
        raise NodeError(f"no answer from {request.full_url} after {self.tries} tries")

    def calls(self, requests: list[tuple[str, list]]) -> list:
        """Results of several calls in one request; replies go by their ids, in whatever order they come."""
        body = [{"jsonrpc": "1.0", "id": i, "method": m, "params": p} for i, (m, p) in enumerate(requests)]
        replies = json.loads(self._open(urllib.request.Request(self.url, json.dumps(body).encode(), self.headers)))
        if isinstance(replies, dict):
            replies = [replies]
        by = {r.get("id"): r for r in replies}
        out = []
        for i, (method, _) in enumerate(requests):
            if i not in by or by[i].get("error"):
                raise NodeError(f"{method}: {by.get(i, {}).get('error', 'no reply')}")
            out.append(by[i]["result"])
        return out

    def call(self, method: str, *params):
        return self.calls([(method, list(params))])[0]

    def get(self, path: str) -> bytes:
        return self._open(urllib.request.Request(self.url + path, headers=self.headers))

    def blocks(self, heights: list[int], rest: bool = False) -> list[tuple[bytes, bytes]]:
        """(hash as serialised, raw) of each height."""
        if rest:
            names = [json.loads(self.get(f"/rest/blockhashbyheight/{h}.json"))["blockhash"] for h in heights]
            raws = [self.get(f"/rest/block/{n}.bin") for n in names]
        else:
            names = self.calls([("getblockhash", [h]) for h in heights])
            raws = [bytes.fromhex(x) for x in self.calls([("getblock", [n, 0]) for n in names])]
        return [(bytes.fromhex(n)[::-1], raw) for n, raw in zip(names, raws, strict=True)]

    def times(self, heights: list[int]) -> list[tuple[str, int]]:
        """(hash as displayed, time) of each height; a header of another height is an error."""
        names = self.calls([("getblockhash", [h]) for h in heights])
        out = []
        for h, n, head in zip(heights, names, self.calls([("getblockheader", [n]) for n in names]), strict=True):
            if head["height"] != h:
                raise NodeError(f"asked for height {h}, got {head['height']}")
            out.append((n, head["time"]))
        return out

    def balances(self, scripts: list[bytes]) -> tuple[int, dict[bytes, int]]:
        """(height, satoshis by script) by one scan of the unspent outputs; what wasn't asked for is left out."""
        from decimal import Decimal

        reply = self.call("scantxoutset", "start", [f"raw({s.hex()})" for s in scripts])
        sums = dict.fromkeys(scripts, 0)
        for coin in reply["unspents"]:
            script = bytes.fromhex(coin["scriptPubKey"])
            if script in sums:
                sums[script] += int(Decimal(str(coin["amount"])) * 100_000_000)
        return reply["height"], sums


class Heights(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class NodeReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.first, self.last = int(options["from"]), int(options["to"])

    def partitions(self):
        step = int(self.options.get("partition", 1000))
        return [Heights(a, min(a + step - 1, self.last)) for a in range(self.first, self.last + 1, step)]

    def read(self, partition: Heights) -> Iterator[tuple]:
        o = self.options
        client = Client(o["url"], credentials(o.get("cookie"), o.get("auth")), int(o.get("tries", 8)), float(o.get("wait", 1.0)))
        batch = int(o.get("batch", 25))
        for a in range(partition.first, partition.last + 1, batch):
            heights = list(range(a, min(a + batch, partition.last + 1)))
            got = client.times(heights) if o.get("kind") == "header" else client.blocks(heights, o.get("transport") == "rest")
            yield from ((h, x, y) for h, (x, y) in zip(heights, got, strict=True))


class NodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger-node"

    def schema(self):
        return HEADERS if self.options.get("kind") == "header" else BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return NodeReader(self.options)
