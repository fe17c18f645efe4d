"""Queries that choose, sample, price, merge and check work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids, sample, text
from threadloom.operators import ledger, merge, selection
from threadloom.plans import sql
from threadloom.plans.registry import query
from threadloom.session import table

_FRACTION = "(CASE WHEN n <= 4000 THEN 0.25::DOUBLE WHEN n <= 12000 THEN 0.35::DOUBLE WHEN n <= 40000 THEN 0.45::DOUBLE WHEN n <= 120000 THEN 0.55::DOUBLE ELSE 0.6::DOUBLE END)"
_TEXTS = f"t AS (SELECT doc_id, {sql.strip('coalesce(text, chr(32))')} AS s FROM documents), l AS (SELECT *, length(s) AS n FROM t), a AS (SELECT *, greatest(1200, least(CAST(floor({_FRACTION} * n) AS INTEGER), 18000)) AS most FROM l)"


@query("prompt_fraction", f"WITH {_TEXTS} SELECT doc_id, n AS chars, {_FRACTION} AS p, most AS allowed_chars FROM a WHERE n > 0")
def prompt_fraction(spark: SparkSession, d: str) -> DataFrame:
    t = sample.with_payload(table(spark, d, "documents").select("doc_id", "text"), "text").where("mode = 'full'")
    return t.select("doc_id", "chars", "p", "allowed_chars")


_HEAD, _TAIL = "CAST(floor(most * 0.20::DOUBLE) AS INTEGER)", "CAST(floor(most * 0.10::DOUBLE) AS INTEGER)"
_EACH = f"greatest(200, CAST(floor((most - {_HEAD} - {_TAIL}) / 5.0) AS INTEGER))"
_SPAN = f"greatest(1, greatest({_HEAD}, n - {_TAIL}) - {_HEAD})"
_MID = ", ".join(f"substring(s, greatest(0, {_HEAD} + CAST(floor({i}.5::DOUBLE * ({_SPAN} / 5.0::DOUBLE)) AS INTEGER) - CAST(floor({_EACH} / 2.0) AS INTEGER)) + 1, {_EACH})" for i in range(5))


@query(
    "prompt_sample",
    f"WITH {_TEXTS} SELECT doc_id, sha1(CASE WHEN n <= most THEN s ELSE array_to_string(list_filter(list_transform([substring(s, 1, {_HEAD}), {_MID}, right(s, {_TAIL})], lambda x: {sql.strip('x')}), lambda x: x <> ''), chr(10) || chr(10)) END) AS sent_sha1 FROM a WHERE n > 0",
)
def prompt_sample(spark: SparkSession, d: str) -> DataFrame:
    t = sample.with_payload(table(spark, d, "documents").select("doc_id", "text"), "text").where("mode = 'full'")
    return t.select("doc_id", F.sha1("sent").alias("sent_sha1"))


@query("cost_estimate", "WITH m AS (SELECT DISTINCT id, list_sum(list_transform(messages, lambda x: length(x.content))) AS chars FROM groq_batch_3r) SELECT id, chars, round(chars / 4.0 / 1e6 * 0.15 + 2493 / 1e6 * 0.60, 9) AS cost FROM m")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.responses import content_length

    m = table(spark, d, "groq_batch_3r").select("id", content_length(F.col("messages")).cast("long").alias("chars")).distinct()
    return m.select("id", "chars", F.round(sample.cost_usd(F.col("chars")), 9).alias("cost"))


_QUEUE = "q AS (SELECT doc_id, coalesce(length(text), 0) AS n, 100 + coalesce(length(text), 0) // 10 AS cost FROM documents), r AS (SELECT *, sum(cost) OVER (ORDER BY n, doc_id ROWS UNBOUNDED PRECEDING) AS running_cost, row_number() OVER (ORDER BY n, doc_id) AS rank FROM q)"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", n.alias("n"), (100 + F.floor(n / 10)).cast("long").alias("cost"))


@query("budget_prefix_first_free", f"WITH {_QUEUE} SELECT doc_id, cost, CAST(running_cost AS BIGINT) AS running_cost FROM r WHERE running_cost <= 30000 OR rank = 1")
def budget_prefix_first_free(spark: SparkSession, d: str) -> DataFrame:
    return selection.budget_prefix(_queue(spark, d), "cost", [F.col("n"), F.col("doc_id")], 30_000).select("doc_id", "cost", "running_cost")


@query("budget_prefix_strict", f"WITH {_QUEUE} SELECT doc_id, cost, CAST(running_cost AS BIGINT) AS running_cost FROM r WHERE running_cost <= 9000 AND rank <= 90")
def budget_prefix_strict(spark: SparkSession, d: str) -> DataFrame:
    return selection.budget_prefix(_queue(spark, d), "cost", [F.col("n"), F.col("doc_id")], 9_000, first_free=False, most=90).select("doc_id", "cost", "running_cost")


_RANK = "CASE status WHEN 'crawled' THEN 0 WHEN 'crawled_wayback' THEN 1 WHEN 'title_only' THEN 2 ELSE 99 END"


@query("status_rank_queue", f"SELECT DISTINCT id, {_RANK} AS status_rank FROM saved_items WHERE status IN ('crawled', 'crawled_wayback', 'title_only')")
def status_rank_queue(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items").where(F.col("status").isin(*selection.POST_CRAWL))
    return s.select("id", selection.status_rank(F.col("status")).alias("status_rank")).distinct()


@query(
    "pending_counts",
    "SELECT CASE WHEN url_source IN ('reddit', 'linkedin', 'x') THEN url_source ELSE 'generic' END AS source_class, count(*) AS n, count_if(url_source IS NULL OR url_source IN ('generic', 'youtube', 'web')) AS generic_n"
    " FROM (SELECT DISTINCT id, url_source, status FROM saved_items) WHERE status IN ('pending_crawl', 'crawl_failed', 'extraction_failed') GROUP BY 1",
)
def pending_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items").select("id", "url_source", "status").distinct().where(F.col("status").isin(*selection.RETRYABLE))
    return s.groupBy(selection.source_class(F.col("url_source")).alias("source_class")).agg(F.count("*").alias("n"), F.count_if(selection.is_generic(F.col("url_source"))).alias("generic_n"))


@query(
    "quota_topk_antijoin",
    f"""WITH s AS (SELECT DISTINCT id, url_source, status, coalesce(length(extracted_text), 0) AS n FROM saved_items WHERE status IN ('crawled', 'crawled_wayback', 'title_only')),
 p AS (SELECT id FROM groq_batch_all_1776865759_outputs WHERE http_status IS NOT NULL AND http_status < 400 AND parsed IS NOT NULL),
 f AS (SELECT *, CASE WHEN url_source IN ('reddit', 'linkedin', 'x') THEN url_source ELSE 'generic' END AS source_class FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = s.id) AND NOT EXISTS (SELECT 1 FROM groq_batch_3r b WHERE b.id = s.id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_class ORDER BY {_RANK}, n DESC, id) AS rank FROM f)
 SELECT id, source_class, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE source_class WHEN 'reddit' THEN 30 WHEN 'linkedin' THEN 10 WHEN 'x' THEN 15 ELSE 20 END""",
)
def quota_topk(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items").where(F.col("status").isin(*selection.POST_CRAWL)).select("id", "url_source", "status", F.coalesce(F.length("extracted_text"), F.lit(0)).alias("n")).distinct()
    from threadloom.sources.readers import success_ids

    done = success_ids(table(spark, d, "groq_batch_all_1776865759_outputs"))
    s = s.join(done, "id", "left_anti").join(table(spark, d, "groq_batch_3r").select("id"), "id", "left_anti")
    k = selection.quota_topk(s, selection.source_class(F.col("url_source")), {"reddit": 30, "linkedin": 10, "x": 15, "generic": 20}, [selection.status_rank(F.col("status")), F.desc("n"), F.col("id")])
    return k.select("id", "source_class", "rank")


@query(
    "cascading_quota",
    """WITH c AS (SELECT CASE WHEN url_source IN ('reddit', 'linkedin', 'x') THEN url_source ELSE 'generic' END AS class, count(*) AS pending FROM (SELECT DISTINCT id, url_source FROM saved_items WHERE status IN ('pending_crawl', 'crawl_failed', 'extraction_failed')) GROUP BY 1),
 p AS (SELECT class, pending, CASE class WHEN 'reddit' THEN 1 WHEN 'linkedin' THEN 2 WHEN 'x' THEN 3 ELSE 4 END AS pos, CASE class WHEN 'reddit' THEN 5 WHEN 'linkedin' THEN 4 WHEN 'x' THEN 3 ELSE 6 END AS cap FROM c),
 w AS (SELECT *, coalesce(sum(least(pending, cap)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
 SELECT class, pending, CAST(greatest(0, least(least(pending, cap), 10 - before)) AS BIGINT) AS take FROM w""",
)
def cascading_quota(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items").where(F.col("status").isin(*selection.RETRYABLE)).select("id", selection.source_class(F.col("url_source")).alias("class")).distinct()
    c = s.groupBy("class").agg(F.count("*").alias("pending"))
    pos = F.when(F.col("class") == "reddit", 1).when(F.col("class") == "linkedin", 2).when(F.col("class") == "x", 3).otherwise(4)
    cap = F.when(F.col("class") == "reddit", 5).when(F.col("class") == "linkedin", 4).when(F.col("class") == "x", 3).otherwise(6)
    return selection.cascade(c.withColumn("pos", pos).withColumn("cap", cap), 10).select("class", "pending", "take")


@query("ordered_id_lookup", "SELECT row_id AS pos, saved_item_id AS id, s.status FROM llm_batched b JOIN (SELECT DISTINCT id, status FROM saved_items) s ON s.id = b.saved_item_id")
def ordered_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "llm_batched").select(F.col("row_id").alias("pos"), F.col("saved_item_id").alias("id"))
    return selection.ordered_lookup(i, table(spark, d, "saved_items").select("id", "status").distinct(), "id").select("pos", "id", "status")


@query("missing_ids", "SELECT DISTINCT saved_item_id AS id FROM llm_batched WHERE saved_item_id NOT IN (SELECT id FROM saved_items)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "llm_batched").select(F.col("saved_item_id").alias("id")).distinct()
    return selection.missing_ids(i, table(spark, d, "saved_items"), "id")


_EDIT = "CASE WHEN o_orderkey % 22 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END"


@query("snapshot_diff", f"SELECT a.o_orderkey FROM orders a JOIN (SELECT o_orderkey, {_EDIT} AS s, o_totalprice FROM orders) b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.s OR a.o_totalprice IS DISTINCT FROM b.o_totalprice")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    after = o.withColumn("o_orderstatus", F.when(k % 22 == 0, None).when(k % 11 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus")))
    return merge.changed(o, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("two_hop_id_map", "SELECT r_regionkey, min(c_custkey) AS from_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.select("c_custkey", "c_nationkey").join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    via = rows.select(F.col("c_custkey").alias("o_id"), F.col("n_regionkey").alias("o_key"))
    return selection.translate(rows.select("c_custkey"), via, r, "o_id", "o_key", "r_regionkey", "r_regionkey")


@query("latest_per_key", "SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1, 2")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("first_last_seen", "SELECT user_id, CAST(min(ts)::DATE AS VARCHAR) AS first_seen_batch, CAST(max(ts)::DATE AS VARCHAR) AS last_seen_batch FROM events GROUP BY 1")
def first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"))
    return merge.first_last_seen(e, ["user_id"], "day", [], [])


_OLD_NEW = "old AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 3 < 2 GROUP BY 1, 2), new AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 3 >= 1 GROUP BY 1, 2)"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    old = e.where("event_id % 3 < 2").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return old, e.where("event_id % 3 >= 1").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("upsert_latest", f"WITH {_OLD_NEW} SELECT user_id, event_type, coalesce(new.event_id, old.event_id) AS event_id FROM old FULL JOIN new USING (user_id, event_type)")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return merge.overwrite(*_old_new(spark, d), ["user_id", "event_type"])


@query("upsert_partial", f"WITH {_OLD_NEW} SELECT user_id, event_type, coalesce(new.event_id, old.event_id) AS event_id, coalesce(old.event_id % 7, new.event_id % 7) AS batched FROM old FULL JOIN new USING (user_id, event_type)")
def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.withColumn("batched", F.col("event_id") % 7) for x in _old_new(spark, d))
    return merge.overwrite_keep(old, new, ["user_id", "event_type"], ["batched"])


@query("insert_ignore", f"WITH {_OLD_NEW} SELECT user_id, event_type, coalesce(old.event_id, new.event_id) AS event_id FROM old FULL JOIN new USING (user_id, event_type)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return merge.insert_ignore(*_old_new(spark, d), ["user_id", "event_type"], [F.col("event_id")])


@query("compute_once", "SELECT DISTINCT node_id FROM source_embeddings WHERE model = (SELECT max(model) FROM source_embeddings) AND node_id NOT IN (SELECT source_node_id FROM source_payloads)")
def compute_once(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "source_embeddings").select("node_id", "model")
    top = e.agg(F.max("model").alias("model"))
    want = e.join(F.broadcast(top), "model").select("node_id").distinct()  # one row
    return merge.compute_once(want, table(spark, d, "source_payloads").select(F.col("source_node_id").alias("node_id")), ["node_id"])


@query("rollback_restore", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders")
def rollback_restore(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return merge.restore(o.withColumn("o_totalprice", F.col("o_totalprice") * 2), o, o.where("o_orderkey % 5 = 0").select("o_orderkey"), "o_orderkey")


@query(
    "set_checks",
    """SELECT * FROM (VALUES ('count')) t(check_name), (SELECT (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS actual) x, (SELECT false AS ok) y
 UNION ALL SELECT 'present', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), (SELECT count(DISTINCT o_custkey) FROM orders) = (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
 UNION ALL SELECT 'same', (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)), (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)), (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) = (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders))""",
)
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    k = o.select(F.col("o_custkey").alias("k"))
    return ledger.check_counts([("count", o, o.where("o_orderkey % 3 <> 0"))]).unionByName(ledger.check_present("present", k, c, "k")).unionByName(ledger.same_set("same", c, k, "k"))


_EVENTS = "e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run_id, event_type AS step_name, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' ELSE 'running' END AS status, event_id AS seq, ts AS tm FROM events)"


@query(
    "ledger_latest_status",
    f"WITH {_EVENTS} SELECT run_id, step_name, arg_max(status, seq) AS status, arg_max(tm, seq) FILTER (status = 'running') AS started_at, CASE WHEN arg_max(status, seq) <> 'running' THEN arg_max(tm, seq) END AS finished_at, CASE WHEN arg_max(status, seq) = 'failed' THEN 'boom' END AS error, count_if(status = 'running') AS attempts FROM e GROUP BY 1, 2",
)
def ledger_latest_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 4 == 1, "done").otherwise("running")
    e = table(spark, d, "events").select((F.col("user_id") % 20).cast("string").alias("run_id"), F.col("event_type").alias("step_name"), s.alias("status"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return ledger.step_states(ledger.event(e.withColumn("error", F.when(F.col("status") == "failed", "boom"))))


@query("artifact_sha256", "SELECT doc_id, 'doc_' || doc_id || '.txt' AS file_name, 'text/plain' AS content_type, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def artifact_sha256(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return t.select("doc_id", F.col("path").alias("file_name"), ids.mime_type(F.col("path")).alias("content_type"), "size_bytes", "sha256")


@query("filename_allocation", r"""WITH b AS (SELECT p_partkey, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', '-', 'g'), '[^a-z0-9\-]+', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 80), '^-+|-+$', '', 'g'), ''), 'untitled') || ' ' || (p_size % 3) AS base FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b) SELECT p_partkey AS id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS name FROM r""")
def filename_allocation(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.layout import file_names

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(text.slug(F.col("p_name")), F.lit(" "), (F.col("p_size") % 3).cast("string")).alias("b"))
    return file_names(p, F.col("b"), [F.col("id")]).select("id", "name")
