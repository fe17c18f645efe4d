"""Problem 3: page boilerplate beside the main content.

The text-to-tag ratio of every line: a streaming standard-library parser counts
its tags, and what the corpus shows to be page furniture (``recurrence``: units
that recur in blocks, over many texts) or links (titles under the heading of a
sidebar) is markup, not text. The ratios of a record are smoothed with a Gaussian;
two-means over the histogram of the smoothed ratios of all lines of the corpus
gives the threshold between the sparse and the dense cluster, and the sparse
lines are the page's surroundings. No phrase is listed anywhere.

Plan: see ``recurrence``; texts are read twice at most (once for the features, once
for the bodies), only features and hashes are shuffled.

Edge cases: null and empty texts have no lines; a text of surroundings only
keeps an empty body; records of problem 5 keep their text and give no rows;
rows delivered again give one result; a null title is ignored; an empty table
gives no rows; other columns are ignored; texts of any length are read whole. A
corpus in which nothing recurs has no surroundings but lines full of tags.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.recurrence import Corpus
from threadloom.llm.residue import labelled
from threadloom.session import cut

SIGMA = 0.5
BINS = 200


def smoother(sigma: float = SIGMA):
    """Gaussian smoothing of a list, with weights renewed at the borders."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(r + 1)]

    def smooth(v: list[float]) -> list[float]:
        n = len(v)
        if v.count(1.0) == n:
            return v  # nothing but text: each mean is one of ones
        out = []
        for i, x in enumerate(v):
            a, b = x * w[0], w[0]
            for d in range(1, r + 1):
                if i >= d:
                    a += v[i - d] * w[d]
                    b += w[d]
                if i + d < n:
                    a += v[i + d] * w[d]
                    b += w[d]
            out.append(a / b)
        return out

    return smooth


def threshold(histogram: dict[int, int], bins: int = BINS) -> float:
    """Boundary between two clusters of the values in a histogram over [0, 1] (two-means); below all values if there is one cluster."""
    if len(histogram) < 2:
        return -1.0
    x = np.array(sorted(histogram))
    n = np.array([histogram[i] for i in x], np.float64)
    v = (x + 0.5) / bins
    lo, hi = v[0], v[-1]
    while True:
        low = v <= (lo + hi) / 2
        lo2, hi2 = np.average(v[low], weights=n[low]), np.average(v[~low], weights=n[~low])
        if abs(lo2 - lo) + abs(hi2 - hi) < 1e-9:
            return float((lo + hi) / 2)
        lo, hi = lo2, hi2


def judged(items: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """(record_id, lines): the numbers of the surrounding lines of each record that has some."""
    found = cut(labelled(Corpus(items), finish=smoother(sigma)).select("record_id", "no", "label", F.col("text").alias("ratio")))
    per = found.select(F.explode("ratio").alias("x")).groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("x") * BINS)).cast("int").alias("bin")).count()
    at = threshold({r["bin"]: r["count"] for r in per.collect()})  # at most BINS rows
    sparse = F.filter(F.arrays_zip("no", "ratio"), lambda x: x["ratio"] <= at)
    rows = found.where("label is null").select("record_id", F.transform(sparse, lambda x: x["no"]).alias("lines")).where("size(lines) > 0")
    # copies delivered again: one array per record before the lines are spread
    return rows.groupBy("record_id").agg(F.first("lines").alias("lines"))


def surrounding_rows(items: DataFrame) -> DataFrame:
    """(saved_item_id, line_no): every line that belongs to the page, not to the content."""
    return judged(items).select(F.col("record_id").alias("saved_item_id"), F.explode("lines").alias("line_no"))


def main_bodies(items: DataFrame) -> DataFrame:
    """(saved_item_id, body, removed_lines) for every row with a text."""
    rows = items.select("id", "extracted_text").where("id is not null and extracted_text is not null")
    both = rows.join(judged(items).withColumnRenamed("record_id", "id"), "id", "left")
    gone = F.coalesce("lines", F.expr("cast(array() as array<int>)"))
    kept = F.filter(F.split("extracted_text", "\n", -1), lambda x, i: ~F.array_contains(gone, i + 1))
    return both.select(F.col("id").alias("saved_item_id"), F.when(F.size(gone) == 0, F.col("extracted_text")).otherwise(F.array_join(kept, "\n")).alias("body"), F.size(gone).alias("removed_lines"))
