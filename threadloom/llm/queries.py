"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import batchdedup, boilerplate, mixing, neighbours, packing, pairs, residue, spans, truncation
from threadloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


OUTPUTS = "groq_batch_all_1776865759_outputs"


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "saved_items"), table(spark, d, "groq_batch_3r"), table(spark, d, OUTPUTS)


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(*_texts(spark, d))


@query("p1_cut_share")
def p1_cut_share(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_share(*_texts(spark, d))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, OUTPUTS), table(spark, d, "groq_batch_3r"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.surrounding_rows(table(spark, d, "saved_items"))


@query("p3_main_body")
def p3_main_body(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "saved_items")).distinct()


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "saved_items"), table(spark, d, "groq_batch_3r")).select("table_name", "record_id")


@query("p5_labels")
def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "saved_items"), table(spark, d, "groq_batch_3r"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "source_embeddings"))


@query("p4_nearest")
def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "source_embeddings"), k=5).select("model", "node_id", "rank", "neighbour_id", F.round("sim", 4).alias("sim"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return batchdedup.batch_duplicates(table(spark, d, "llm_batched"))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


@query("p10_shared_share")
def p10_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


@query("p8_packing")
def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    caps = table(spark, d, "pack_capacities")
    return packing.fill_report(packing.packed(table(spark, d, "documents"), caps), caps)


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixed(table(spark, d, "documents"), targets)[0], targets)
