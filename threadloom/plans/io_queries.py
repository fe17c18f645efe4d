"""Queries that go through sources, sinks and streams, in the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.operators import embed, graph, merge
from threadloom.plans.graph_queries import _MENTIONS, _normalised
from threadloom.plans.registry import query
from threadloom.session import checkpoint_dir, table
from threadloom.sources import readers, sinks
from threadloom.streaming import ingest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("batch_jsonl_roundtrip", "SELECT DISTINCT id, canonical_url, status, max_completion_tokens, round(estimated_cost_usd, 6) AS estimated_cost_usd, len(messages) AS messages FROM groq_batch_3r")
def batch_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "batch")
    sinks.write_lines(sinks.batch_lines(table(spark, d, "groq_batch_3r").dropDuplicates(["id"]), [F.col("id")]), path)
    return readers.jsonl(spark, path, readers.BATCH_SCHEMA).select("id", "canonical_url", "status", "max_completion_tokens", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"), F.size("messages").alias("messages"))


@query("url_text_roundtrip", "SELECT DISTINCT trim(raw_url) AS url FROM saved_items WHERE regexp_matches(trim(raw_url), '^https?://')")
def url_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "urls")
    table(spark, d, "saved_items").select(F.concat(F.lit("  "), "raw_url").alias("value")).write.text(path)
    return readers.url_text(spark, path).distinct()


@query("success_ids", "SELECT DISTINCT id FROM groq_batch_all_1776865759_outputs WHERE http_status IS NOT NULL AND http_status < 400 AND parsed IS NOT NULL")
def success_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.success_ids(table(spark, d, "groq_batch_all_1776865759_outputs")).distinct()


@query("run_manifest", "SELECT sha1(array_to_string(list_sort(list(DISTINCT id)), ',')) AS ids FROM groq_batch_3r")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = sinks.run_manifest(table(spark, d, "groq_batch_3r").select("id").distinct())
    return m.select(F.sha1(F.array_join(F.from_json("json", "array<string>"), ",")).alias("ids"))


@query("stream_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events arrive as files, one after another, and are merged by micro-batches."""
    path = _folder(spark, "stream")
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    e.repartition(3, F.col("event_id") % 3).write.parquet(f"{path}/in")
    schema = "user_id long, event_type string, event_id long, value double"
    ingest.upsert_files(spark, f"{path}/in", schema, ["user_id", "event_type"], "event_id", f"{path}/state", f"{path}/checkpoint")
    return ingest.current(spark, f"{path}/state")


@query("checkpoint_union", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def checkpoint_union(spark: SparkSession, d: str) -> DataFrame:
    """A collector's checkpoint: last value per key over what was kept and what came."""
    e = table(spark, d, "events").select("user_id", "value", "event_id")
    old, new = e.where("event_id % 4 < 2"), e.where("event_id % 4 >= 2")
    kept = [merge.latest(x, ["user_id"], [F.col("event_id")]) for x in (old, new)]
    return merge.latest(kept[0].unionByName(kept[1]), ["user_id"], [F.col("event_id")])


@query("source_embedding_edges")
def source_embedding_edges(spark: SparkSession, d: str) -> DataFrame:
    """Concept texts embedded once each and joined to their most similar ones, batch against all."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Type: "), "p_type", F.lit("\nName: "), "p_name").alias("text"))
    e = embed.embed(p, embed.hashing_embedder(64)).withColumnRenamed("embedding", "v")
    return graph.cosine_edges(e.where("id % 100 = 0"), e, 8, 0.55)


@query("html_rows", "SELECT DISTINCT id, '<tr><td>' || replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') || '</td><td>' || replace(replace(replace(replace(coalesce(canonical_url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') || '</td></tr>' AS html FROM saved_items")
def html_rows(spark: SparkSession, d: str) -> DataFrame:
    """Saved items as rows of an HTML table."""
    return table(spark, d, "saved_items").select("id", sinks.html_row([F.col("title"), F.col("canonical_url")]).alias("html")).distinct()


@query("normalised_jsonl", f"WITH {_MENTIONS} SELECT o.id, count(c.concept_id) AS concepts FROM (SELECT DISTINCT id FROM o) o LEFT JOIN c ON c.id = o.id AND c.concept_id IS NOT NULL GROUP BY 1")
def normalised_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Normalised outputs written as JSONL and read again."""
    n = _normalised(spark, d).dropDuplicates(["id"])
    with sinks.run_output(spark, _folder(spark, "normalised")) as path:
        sinks.write_normalised(n, path)
    back = spark.read.schema(n.schema).json(path)
    return back.select("id", F.size(F.filter("concepts", lambda c: ids.concept_id(c["type"], c["name"]).isNotNull())).cast("long").alias("concepts"))
