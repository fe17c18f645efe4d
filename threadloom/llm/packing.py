"""Problem 8: filling fixed-capacity containers with items.

Harmonic packing. A document of n tokens is of class j if j of them, with the
separators between, fit into a container and j + 1 do not; a container of class
j is filled with j documents of its class, and only then topped up from smaller
classes (best fit, which the plain method leaves out). Every worker fills the containers of
its own scan partition, so no document is shuffled. What a container of large
documents leaves over is topped up with the largest documents of smaller
classes that fit, and the documents left of incomplete classes share the
worker's last containers.

A document over the capacity is split: full containers of its own and a rest
that is packed as a document. Nothing else is split.

Edge cases: null and empty texts have no tokens and are in no container; a
document of exactly the capacity fills one container; equal documents are
packed each; capacities below one token are an error; an empty table gives no
rows; other columns are ignored. The capacities are a small table (its rows are
checked against ``MAX_CAPACITIES``) and reach the workers as parameters.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import DEFAULT_RANKS, count_tokens, shipped

MAX_CAPACITIES = 1_000
#: documents a worker packs at a time
CHUNK = 200_000

SCHEMA = "pack_name string, worker int, container long, slot int, doc_id long, piece int, token_start long, tokens long"


def harmonic_class(n: int, capacity: int, separator: int) -> int:
    """How many documents of n tokens fit into one container."""
    return (capacity + separator) // (n + separator)


def pack(items: list[tuple[int, int]], capacity: int, separator: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers of (doc_id, piece, token_start, tokens) for (doc_id, tokens) items."""
    bins: list[list[tuple[int, int, int, int]]] = []
    by_len: dict[int, list[tuple[int, int, int, int]]] = {}
    for doc, n in items:
        piece = start = 0
        while n - start > capacity:
            bins.append([(doc, piece, start, capacity)])
            start += capacity
            piece += 1
        if n > start:
            by_len.setdefault(n - start, []).append((doc, piece, start, n - start))
    lengths = sorted(by_len)  # lengths that still have documents

    def take(most: int):
        """The longest document of at most ``most`` tokens."""
        i = bisect_right(lengths, most) - 1
        if i < 0:
            return None
        n = lengths[i]
        got = by_len[n].pop()
        if not by_len[n]:
            lengths.pop(i)
        return got

    while lengths:
        j = harmonic_class(lengths[-1], capacity, separator)
        low = (capacity + separator) // (j + 1) - separator  # documents above are of class j
        box, used = [], -separator
        while len(box) < j and lengths and lengths[-1] > low:
            got = take(capacity - used - separator)
            if got is None:
                break
            box.append(got)
            used += got[3] + separator
        while (got := take(capacity - used - separator)) is not None:
            box.append(got)
            used += got[3] + separator
        bins.append(box)
    return bins


def packed(docs: DataFrame, capacities: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """One row for each piece in a container: a container is (pack_name, worker, container)."""
    caps = capacities.select("pack_name", F.col("capacity_tokens").alias("c"), F.coalesce("separator_tokens", F.lit(0)).alias("s")).distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(caps) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    caps = [(r["pack_name"], int(r["c"]), int(r["s"])) for r in caps if r["c"] is not None]
    if any(c < 1 or s < 0 for _, c, s in caps):
        raise ValueError("a capacity must hold a token, and a separator can't be negative")
    content = shipped(docs, ranks)

    def run(batches):
        worker = TaskContext.get().partitionId()
        held: list[tuple[int, int]] = []
        base = dict.fromkeys((c[0] for c in caps), 0)

        def close():
            for name, capacity, separator in caps:
                rows = []
                for box in pack(held, capacity, separator):
                    k = base[name]
                    base[name] += 1
                    rows.extend((name, worker, k, i, *p) for i, p in enumerate(box))
                yield pd.DataFrame(rows, columns=["pack_name", "worker", "container", "slot", "doc_id", "piece", "token_start", "tokens"])

        for pdf in batches:
            held.extend((d, n) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()) if (n := count_tokens(t, ranks, content.value)))
            if len(held) >= CHUNK:
                yield from close()
                held.clear()
        if held:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''").mapInPandas(run, SCHEMA)


def fill_report(packing: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, documents, split documents, tokens, share of the space in use, fullest container."""
    caps = capacities.select("pack_name", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens")).distinct()
    box = packing.groupBy("pack_name", "worker", "container").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") > 0).alias("later"))
    box = box.join(F.broadcast(caps), "pack_name").withColumn("used", F.col("tokens") + (F.col("n") - 1) * F.col("separator_tokens"))
    return box.groupBy("pack_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), (F.sum("n") - F.sum("later")).alias("documents"), F.sum("tokens").alias("tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("used_share"),
    )
