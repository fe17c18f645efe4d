"""Incremental ingest as Structured Streaming: file drops merged batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import merge
from threadloom.session import cut, exists, file_names, publish_text, read_text, release

#: parts of a state table by the hash of its keys; a batch rewrites those that its keys are in
PARTS = 64


def upsert_files(spark: SparkSession, folder: str, schema: str, keys: list[str], order: str, state: str, checkpoint: str, fmt: str = "parquet", parts: int = PARTS) -> None:
    """Runs over all files that are there: each micro-batch is merged into the state table.

    The state is cut into parts by the hash of its keys. A batch writes the parts
    its keys are in under a folder of its own and then publishes a manifest that
    names the folder of every part; a manifest appears whole or not at all, so a
    batch that fails anywhere leaves the state of the batch before. The order
    column decides, so a batch that is replayed changes nothing.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        have = manifest(spark, state, before=number)
        new = cut(merge.latest(batch, keys, [F.col(order)]).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        old = _read(spark, {p: have[p] for p in touched if p in have})
        both = new if old is None else old.unionByName(new)
        target = f"{state}/v{number:08d}"
        merge.latest(both, [*keys, "part"], [F.col(order)]).write.mode("overwrite").partitionBy("part").parquet(target)
        publish_text(spark, f"{state}/manifest-{number:08d}.json", json.dumps({**have, **dict.fromkeys(touched, target)}))
        release(new)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def manifest(spark: SparkSession, state: str, before: int | None = None) -> dict[int, str]:
    """The folder of every part as of the last finished batch (before a number, if given); empty if there is none."""
    if not exists(spark, state):
        return {}
    names = [n for n in file_names(spark, state) if n.startswith("manifest-") and n.endswith(".json")]
    names = [n for n in names if before is None or int(n[9:-5]) < before]
    return {int(k): v for k, v in json.loads(read_text(spark, f"{state}/{max(names)}")).items()} if names else {}


def _read(spark: SparkSession, folders: dict[int, str]) -> DataFrame | None:
    """The parts of a state, with their number."""
    out = None
    for folder in sorted(set(folders.values())):
        mine = [p for p, f in folders.items() if f == folder]
        df = spark.read.parquet(folder).where(F.col("part").isin(mine))  # prunes the other parts' folders
        out = df if out is None else out.unionByName(df)
    return out


def current(spark: SparkSession, state: str) -> DataFrame | None:
    """The state table as of the last finished batch; None before the first."""
    df = _read(spark, manifest(spark, state))
    return None if df is None else df.drop("part")


def new_urls(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Addresses seen for the first time, with state dropped once the watermark passed."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["url"])


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is there and stops: the idle end of a polling loop."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def checkpoint_union(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Last value per key of a collector's checkpoint, and how many keys are new."""
    state = merge.overwrite(old, new, [key])
    return state, max(0, state.count() - old.select(key).distinct().count())
