"""Price series and other series from files, and files with one exact content."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chainloom.functions.chain import canonical_price


def strict_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV whose header must be that of the schema; a cell that doesn't fit stops the query."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def numbered_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """strict_csv with line, the place of each row; the file is one that a single task reads."""
    rows = strict_csv(spark, path, schema).coalesce(1)
    return rows.withColumn("line", F.monotonically_increasing_id())


def _time(value: Column, form: str) -> Column:
    if form == "unix":
        return F.trim(value.cast("string")).cast("decimal(20,3)").cast("long")
    if form == "unix_ms":
        return F.floor(F.trim(value.cast("string")).cast("decimal(20,3)") / 1000).cast("long")
    return F.unix_timestamp(F.trim(value.cast("string")), form)


def price_series(spark: SparkSession, path: str, time: str = "time", price: str = "price", time_format: str = "unix", records: str = "", rows_are_lists: bool = False) -> DataFrame:
    """(ts, price) of a CSV with a header or of a JSON file, by time.

    records: dotted path to the list in a JSON file; time and price: names, or
    numbers where rows are lists; time_format: unix, unix_ms or a pattern read as
    UTC. Of several rows of one time the first counts; rows without a price are
    left out; one that is not a positive decimal stops the query. price keeps the
    publisher's digits, as text.
    """
    if path.lower().endswith(".json"):
        item = "array<string>" if rows_are_lists else "map<string,string>"
        text = spark.read.text(path, wholetext=True)
        schema = f"array<{item}>"
        for name in reversed(records.split(".") if records else []):
            schema = f"struct<`{name}`:{schema}>"
        found = F.from_json("value", schema)
        for name in records.split(".") if records else []:
            found = found[name]
        rows = text.select(F.posexplode(found).alias("line", "r"))
        pick = (lambda k: F.get("r", F.lit(int(k)))) if rows_are_lists else (lambda k: F.col("r")[k])
    else:
        rows = spark.read.option("header", True).csv(path).coalesce(1).withColumn("line", F.monotonically_increasing_id())
        pick = lambda k: F.col(f"`{k}`")
    rows = rows.select("line", _time(pick(time), time_format).alias("ts"), F.trim(pick(price)).alias("p")).where("p is not null and p <> ''")
    own = canonical_price(F.col("p"))
    rows = rows.withColumn("price", F.when(own.isNotNull(), own).otherwise(F.raise_error(F.concat(F.lit("not a positive price: "), F.col("p")))))
    first = F.row_number().over(Window.partitionBy("ts").orderBy("line"))
    return rows.withColumn("k", first).where("k = 1").select("ts", "price").orderBy("ts")


def write_text(path: str, text: str, private: bool = False) -> None:
    """A file with exactly this text, all at once: a reader sees the old content or the new."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o600 if private else 0o644)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_json(path: str, value, private: bool = False) -> None:
    write_text(path, json.dumps(value, indent=1, sort_keys=True) + "\n", private)


def write_csv(df: DataFrame, path: str, order: list[str], comments: Iterable[str] = ()) -> None:
    """A report as one CSV file in a stated order, or the table's own; null is empty. For results of a bounded size: rows pass the driver one by one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    temporary = f"{path}.part"
    with open(temporary, "w", newline="") as f:
        f.writelines(f"# {c}\n" for c in comments)
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in (df.orderBy(*order) if order else df).toLocalIterator():
            out.writerow(["" if v is None else v.hex() if isinstance(v, (bytes, bytearray)) else v for v in row])
    os.replace(temporary, path)
