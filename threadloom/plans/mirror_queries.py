"""Queries over mirrors, queues, replies and the wider graph, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids, text, url
from threadloom.operators import graph, layout, ledger, merge, selection
from threadloom.plans import sql
from threadloom.plans.graph_queries import _MENTIONS, _SIM, OUT, _normalised
from threadloom.plans.registry import query
from threadloom.session import table

# ---- mirrors -----------------------------------------------------------------



def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, d, "llm_batched").where("saved_item_id is not null").select("row_id", "saved_item_id", "canonical_url")
    last = b.agg(F.max("row_id").alias("m"))
    b = b.join(F.broadcast(last), F.lit(True))  # one row
    return b.where("row_id * 2 <= m").select("saved_item_id", "canonical_url"), b.where("row_id * 2 > m").select("saved_item_id", "canonical_url")


_HALF = "m AS (SELECT max(row_id) AS m FROM llm_batched WHERE saved_item_id IS NOT NULL), b AS (SELECT saved_item_id, canonical_url, row_id * 2 > (SELECT m FROM m) AS late FROM llm_batched WHERE saved_item_id IS NOT NULL), o AS (SELECT saved_item_id, arg_max(canonical_url, {'v': coalesce(canonical_url, '')}) AS canonical_url FROM b WHERE NOT late GROUP BY 1), w AS (SELECT saved_item_id, arg_max(canonical_url, {'v': coalesce(canonical_url, '')}) AS canonical_url, count(*) AS n FROM b WHERE late GROUP BY 1)"


@query("mirror_state", f"WITH {_HALF} SELECT saved_item_id, CASE WHEN w.n IS NOT NULL THEN w.canonical_url ELSE o.canonical_url END AS canonical_url FROM o FULL JOIN w USING (saved_item_id)")
def mirror_state(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the batches mirrored into what the earlier half left."""
    old, new = _halves(spark, d)
    return merge.mirror(old, new, ["saved_item_id"])[0]


@query(
    "mirror_counts",
    f"WITH {_HALF} SELECT CAST((SELECT coalesce(sum(n), 0) FROM w) AS BIGINT) AS received, count_if(w.n IS NOT NULL AND x.saved_item_id IS NULL) AS inserted, count_if(w.n IS NOT NULL AND x.saved_item_id IS NOT NULL AND w.canonical_url IS DISTINCT FROM x.canonical_url) AS updated,"
    " count_if(w.n IS NOT NULL AND x.saved_item_id IS NOT NULL AND w.canonical_url IS NOT DISTINCT FROM x.canonical_url) AS unchanged, count(*) AS after FROM o x FULL JOIN w ON w.saved_item_id = x.saved_item_id",
)
def mirror_counts(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return merge.mirror(old, new, ["saved_item_id"])[1]


_COUNTED = {"source_payloads": "batch_id", "llm_batched": "batch_file", "source_embeddings": "model", "groq_batch_3r": "status"}


@query("batch_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {c} AS batch_id, count(*) AS n FROM {t} GROUP BY 2" for t, c in _COUNTED.items()))
def batch_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.counts_per_batch({t: (table(spark, d, t), c) for t, c in _COUNTED.items()})


@query("latest_update_per_source", "SELECT source_node_id, max(updated_at) AS updated_at FROM source_payloads GROUP BY 1")
def latest_update(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_payloads").groupBy("source_node_id").agg(F.max("updated_at").alias("updated_at"))


@query("latest_edges", "SELECT l_partkey AS a, l_suppkey AS b, arg_max(l_quantity, {'o': l_orderkey, 'l': l_linenumber, 'p': l_extendedprice}) AS strength, max(l_orderkey) AS batch FROM lineitem GROUP BY 1, 2")
def latest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of many batches: the last batch's strength wins."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("strength"), F.col("l_orderkey").alias("batch"), "l_linenumber", "l_extendedprice")
    return graph.latest_edges(e, ["a", "b"], [F.col("batch"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("a", "b", "strength", "batch")


_RUNS = "SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS step, event_id, repeat(event_type || ' failed; ', 200) AS error FROM events WHERE event_type = 'error'"


@query("run_error_cut", f"SELECT run_id, left(arg_max(error, event_id), 2000) AS error, count(*) AS failures FROM ({_RUNS}) GROUP BY 1")
def run_error_cut(spark: SparkSession, d: str) -> DataFrame:
    """The last error of every run, cut to the ledger's length."""
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("run_id"), "event_id", F.repeat(F.concat("event_type", F.lit(" failed; ")), F.lit(200)).alias("error"))
    return e.groupBy("run_id").agg(F.left(F.max_by("error", "event_id"), F.lit(ledger.IMPORT_ERROR_CUT)).alias("error"), F.count("*").alias("failures"))


# ---- choice of work ----------------------------------------------------------


@query("raw_url_contains", "SELECT DISTINCT id, p AS part FROM saved_items, (VALUES ('X.com'), ('reddit.com'), ('.example/r/'), ('100%'), ('a_b')) t(p) WHERE contains(lower(raw_url), lower(p))")
def raw_url_contains(spark: SparkSession, d: str) -> DataFrame:
    """Saved addresses that contain a piece of text, whatever its case; wild cards stand for themselves."""
    s = table(spark, d, "saved_items").select("id", "raw_url")
    out = None
    for p in ("X.com", "reddit.com", ".example/r/", "100%", "a_b"):
        x = s.where(selection.contains_url(F.col("raw_url"), p)).select("id", F.lit(p).alias("part"))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


_SUB = rf"regexp_extract({sql.part('canonical_url', 3)}, '(?i)^/r/([^/]+)', 1)"


@query("subreddit_filter", f"WITH s AS (SELECT DISTINCT id, {_SUB} AS sub FROM saved_items) SELECT id, lower(sub) IN ('nightowls', 'jobtalk') AND sub <> '' AS included, NOT (lower(sub) IN ('nightowls', 'jobtalk') AND sub <> '') AS kept FROM s")
def subreddit_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items").select("id", url.subreddit(F.col("canonical_url")).alias("sub")).distinct()
    names = ["r/NightOwls", " jobtalk "]
    return s.select("id", selection.by_subreddit(F.col("sub"), names).alias("included"), selection.by_subreddit(F.col("sub"), names, "exclude").alias("kept"))


_ORDERED = "SELECT DISTINCT id, CASE status WHEN 'crawled' THEN 0 WHEN 'crawled_wayback' THEN 1 WHEN 'title_only' THEN 2 ELSE 99 END AS priority, coalesce(length(extracted_text), 0) AS n FROM saved_items"


@query("queue_positions", f"SELECT id, row_number() OVER (ORDER BY priority, n DESC, id) AS pos FROM ({_ORDERED})")
def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    """The place of every item in the queue: by priority, long texts first."""
    s = table(spark, d, "saved_items").select("id", selection.status_rank(F.coalesce("status", F.lit(""))).alias("priority"), F.coalesce(F.length("extracted_text"), F.lit(0)).alias("n")).distinct()
    return selection.ranked(s, [F.col("priority"), F.desc("n"), F.col("id")], "pos").select("id", "pos")


_KINDS = f"SELECT DISTINCT id, {sql.kind('canonical_url', 'title')} AS kind FROM saved_items WHERE status IN ('pending_crawl', 'crawl_failed', 'extraction_failed')"


@query("next_pending", f"SELECT id, {sql.priority('kind')} AS priority FROM ({_KINDS}) ORDER BY 2, 1 LIMIT 1")
def next_pending(spark: SparkSession, d: str) -> DataFrame:
    """The pending item that comes next."""
    s = table(spark, d, "saved_items").where(F.col("status").isin(*selection.RETRYABLE)).select("id", url.kind_priority(url.kind(F.col("canonical_url"), F.col("title"))).alias("priority")).distinct()
    return selection.next_items(s, [F.col("priority"), F.col("id")])


@query("newest_sources", "SELECT doc_id, canonical_url FROM documents ORDER BY saved_at DESC NULLS LAST, canonical_url DESC NULLS LAST, doc_id LIMIT 500")
def newest_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "canonical_url", "saved_at").orderBy(F.desc_nulls_last("saved_at"), F.desc_nulls_last("canonical_url"), "doc_id").limit(500).select("doc_id", "canonical_url")


@query("item_projection", "SELECT id, max({'canonical_url': canonical_url, 'title': title, 'status': status, 'url_source': url_source}).status AS status, count(DISTINCT title) AS titles FROM saved_items GROUP BY 1")
def item_projection(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items")
    p = selection.dictionary(s, "id", ["canonical_url", "title", "status", "url_source"])
    return p.select("id", F.col("row.status").alias("status")).join(s.groupBy("id").agg(F.count_distinct("title").alias("titles")), "id")


# ---- replies, selectors, engagement --------------------------------------------

_REPLIES = r"r AS (SELECT host, doc_id, (doc_id % 97)::DOUBLE AS likes, (doc_id % 13)::DOUBLE AS replies, text, len(regexp_extract_all(text, '[.!?]')) AS marks FROM documents WHERE text IS NOT NULL AND host IS NOT NULL), q AS (SELECT *, length(text) + CASE WHEN marks > 0 THEN 12 ELSE 0 END + 3 * least(marks, 6) + least(likes / 10.0, 500.0) + least(replies * 3.0, 300.0) AS quality FROM r)"


@query("best_replies", f"WITH {_REPLIES} SELECT host, arg_max(doc_id, {{'q': round(quality, 6), 'l': likes, 'r': replies, 'd': doc_id}}) FILTER (likes < 48) AS below_main, arg_max(doc_id, {{'q': round(quality, 6), 'l': likes, 'r': replies, 'd': doc_id}}) FILTER (likes >= 48) AS at_least_main FROM q GROUP BY 1")
def best_replies(spark: SparkSession, d: str) -> DataFrame:
    """The best reply with fewer likes than the post, and the best with as many or more."""
    likes, replies = (F.col("doc_id") % 97).cast("double"), (F.col("doc_id") % 13).cast("double")
    r = table(spark, d, "documents").where("text is not null and host is not null")
    r = r.select("host", "doc_id", likes.alias("likes"), replies.alias("replies"), F.round(text.reply_quality(F.col("text"), likes, replies), 6).alias("quality"))
    return text.best_of_classes(r, ["host"], F.col("doc_id"), F.col("likes"), F.lit(48), [F.col("quality"), F.col("likes"), F.col("replies"), F.col("doc_id")])


@query("best_selector", "SELECT user_id, arg_max(event_type, {'n': n, 't': event_type}) AS selector, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def best_selector(spark: SparkSession, d: str) -> DataFrame:
    """Of several ways to find the posts of a page the one that found most."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("selector"), F.max("n").alias("n"))


@query("engagement_max", "SELECT event_id, CAST(greatest((event_id % 7) * 1000.0, event_id % 900, CASE WHEN event_id % 3 = 0 THEN 1500000.0 ELSE 0 END) AS DOUBLE) AS likes FROM events")
def engagement_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest number that any of several texts gives for likes."""
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    texts = [F.concat(s(i % 7), F.lit("K likes and 9M views")), F.concat(F.lit("Likes "), s(i % 900)), F.when(i % 3 == 0, "1.5M Likes"), F.lit("no number here")]
    return table(spark, d, "events").select("event_id", text.most_engagement(texts, ["likes?"]).alias("likes"))


_LINKEDIN = "'" + "', '".join(w.replace("'", "''") for w in text.LINKEDIN_LINES) + "'"


def _linkedin_clean() -> str:
    u = "t"
    for p in (r"https?://\S+", r"\bwww\.\S+\b", r"\blinkedin\.com/\S+\b"):
        u = f"regexp_replace({u}, '(?i){p}', '', 'g')"
    lines = rf"string_split(regexp_replace({u}, '\r\n?', chr(10), 'g'), chr(10))"
    col = sql.strip(r"regexp_replace(replace(s, chr(160), ' '), '[ \t]+', ' ', 'g')")
    keep = rf"s <> '' AND NOT (lower(s) IN ({_LINKEDIN}) OR regexp_matches(lower(s), '^\d+\s+(reactions?|comments?|reposts?)$') OR regexp_matches(lower(s), '^\d+[smhdwy]$') OR regexp_matches(s, '^[^\p{{L}}\p{{N}}]+$') OR regexp_matches(s, '^#[\p{{L}}\p{{N}}_]+$'))"
    return f"array_to_string(list_filter(list_transform({lines}, lambda s: {col}), lambda s: {keep}), chr(10))"


@query("clean_lines_linkedin", f"SELECT id, sha1({_linkedin_clean()}) AS cleaned FROM (SELECT DISTINCT id, extracted_text AS t FROM saved_items WHERE extracted_text IS NOT NULL)")
def clean_lines_linkedin(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "saved_items").where("extracted_text is not null").select("id", F.col("extracted_text").alias("t")).distinct()
    return i.select("id", F.sha1(text.clean_lines(F.col("t"), "linkedin")).alias("cleaned"))


@query("post_links", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'https://www.linkedin.com/feed/update/urn:li:activity:' || event_id || '/' WHEN event_id % 3 = 1 THEN 'https://www.linkedin.com/feed/update/urn:li:ugcPost:' || event_id || '/' ELSE '' END AS link, event_id % 3 = 2 AS saved_page FROM events")
def post_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of posts made from their names, and which addresses are pages of saved posts."""
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    urn = F.when(i % 3 == 0, F.concat(F.lit("urn:li:activity:"), s)).when(i % 3 == 1, F.concat(F.lit("x urn:li:ugcPost:"), s)).otherwise("none")
    page = F.when(i % 3 == 2, F.concat(F.lit("https://old.reddit.com/user/u"), s, F.lit("/saved/?after=x"))).otherwise(F.concat(F.lit("https://www.reddit.com/user/u/saved_"), s))
    return table(spark, d, "events").select("event_id", url.post_link(urn).alias("link"), url.is_saved_page(page).alias("saved_page"))


# ---- the wider graph -----------------------------------------------------------


_NAMED = f"""o AS (SELECT DISTINCT id, canonical_url, parsed FROM {OUT} WHERE http_status IS NOT NULL AND http_status < 400 AND parsed IS NOT NULL AND trim(coalesce(canonical_url, '')) <> ''),
 m AS (SELECT canonical_url AS u, 1 AS tier, 'Domain' AS kind, x.name AS raw, k FROM (SELECT canonical_url, unnest(parsed.domains) AS x, generate_subscripts(parsed.domains, 1) AS k FROM o)
 UNION ALL SELECT canonical_url, 2, 'Theme', x.name, k FROM (SELECT canonical_url, unnest(parsed.themes) AS x, generate_subscripts(parsed.themes, 1) AS k FROM o)
 UNION ALL SELECT canonical_url, 3, coalesce(x.type, 'Concept'), x.name, k FROM (SELECT canonical_url, unnest(parsed.concepts) AS x, generate_subscripts(parsed.concepts, 1) AS k FROM o)
 UNION ALL SELECT canonical_url, 4, coalesce(x.type, 'Insight'), left(trim(x.text), 100), k FROM (SELECT canonical_url, unnest(parsed.micro_insights) AS x, generate_subscripts(parsed.micro_insights, 1) AS k FROM o)),
 c AS (SELECT u, kind, {sql.concept_id('kind', 'raw')} AS concept_id FROM m)"""


@query("concepts_over_sources", f"WITH {_NAMED} SELECT concept_id, min(kind) AS kind, count(DISTINCT u) AS doc_freq FROM c WHERE concept_id IS NOT NULL GROUP BY 1")
def concepts_over_sources(spark: SparkSession, d: str) -> DataFrame:
    """Concepts over all sources: one kind each (it is part of the id) and the sources that name it."""
    return concepts_first_name(spark, d).select("concept_id", "kind", "doc_freq")


def concepts_first_name(spark: SparkSession, d: str) -> DataFrame:
    """Concepts over all sources: the first mention names each."""
    m = _normalised(spark, d).dropDuplicates(["id"]).select("source_id", F.posexplode("concepts").alias("pos", "c"))
    m = m.select(ids.concept_id(F.col("c.type"), F.col("c.name")).alias("concept_id"), ids.concept_name(F.col("c.name")).alias("name"), F.col("c.tier").alias("tier"), F.col("c.type").alias("kind"), "source_id", "pos").where("concept_id is not null").dropDuplicates()
    return graph.first_names(m)


@query("concept_kinds", f"WITH {_MENTIONS} SELECT DISTINCT kind FROM c WHERE concept_id IS NOT NULL")
def concept_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = _normalised(spark, d).select(F.explode("concepts").alias("c"))
    return n.where(ids.concept_id(F.col("c.type"), F.col("c.name")).isNotNull()).select(F.col("c.type").alias("kind")).distinct()


@query("children_by_parent", "SELECT n_regionkey AS parent, list_sort(list(n_nationkey)) AS children FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation) GROUP BY 1")
def children_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """Children grouped under their parents; those of unknown parents under null."""
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.lit(-1)).otherwise(F.col("n_regionkey")).alias("p"))
    return graph.children(n, table(spark, d, "region").select(F.col("r_regionkey").alias("p")), "n_nationkey", "p").select(F.col("p").alias("parent"), "children")


@query("doc_freq_lookup", "SELECT p_partkey AS id, coalesce(n, 0) AS doc_freq FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def doc_freq_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = graph.doc_freq(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("concept_id")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(f, F.col("id") == F.col("concept_id"), "left").select("id", F.coalesce("doc_freq", F.lit(0)).alias("doc_freq"))


_E = f"{_SIM.format(extra=' AND a.vec_id % 100 = 0', least=0.2)}, e AS (SELECT a, b, strength, rank FROM r WHERE rank <= 30)"


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e, graph.cosine_edges(e.where("id % 100 = 0"), e, 30, 0.2)


@query("related_nodes", f"WITH {_E}, n AS (SELECT a, b, strength, row_number() OVER (PARTITION BY a ORDER BY rank, b) AS n FROM e WHERE b % 6 BETWEEN 2 AND 4) SELECT a, b, strength, n FROM n WHERE n <= 12")
def related_nodes(spark: SparkSession, d: str) -> DataFrame:
    v, e = _edges(spark, d)
    return layout.related_nodes(e, v.select("id", (F.col("id") % 6).cast("int").alias("tier")))


@query("drawn_relations", f"WITH {_E}, x AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM e WHERE strength >= 0.3) SELECT a, b FROM e WHERE EXISTS (SELECT 1 FROM x WHERE lo = least(a, b) AND hi = greatest(a, b))")
def drawn_relations(spark: SparkSession, d: str) -> DataFrame:
    _, e = _edges(spark, d)
    return layout.drawn(e.select("a", "b"), e, 0.3)


_REL = f"{_E}, x AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, least(a, b) % 2 + 1 AS tier FROM e WHERE a % 2 = b % 2 AND a % 7 <> b % 7), p AS (SELECT *, a % 7 + 1 AS ap, b % 7 + 1 AS bp FROM x), l AS (SELECT *, row_number() OVER (ORDER BY tier, least(ap, bp), greatest(ap, bp), a, b) AS edge, row_number() OVER (PARTITION BY tier ORDER BY least(ap, bp), greatest(ap, bp), a, b) - 1 AS lane FROM p), t AS (SELECT count_if(tier = 1) AS n1 FROM x)"


@query("relation_lanes", f"WITH {_REL} SELECT a, b, tier, edge, lane, CASE WHEN tier = 1 THEN 1200 + lane * 95 ELSE 1200 + greatest(1, (SELECT n1 FROM t)) * 95 + 2200 + lane * 95 END AS lane_y FROM l")
def relation_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Lanes of the relations between islands: by tier, then by the islands' order, then by nodes."""
    v, e = _edges(spark, d)
    r = e.where((F.col("a") % 2 == F.col("b") % 2) & (F.col("a") % 7 != F.col("b") % 7)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    r = r.select((F.col("a") % 7).alias("a_source"), "a", (F.col("b") % 7).alias("b_source"), "b", (F.col("a") % 2 + 1).cast("int").alias("tier"))
    order = v.select((F.col("id") % 7).alias("source_id")).distinct().withColumn("pos", F.col("source_id") + 1)
    x = layout.lanes(r, order)
    return x.select("a", "b", F.col("tier").cast("long").alias("tier"), F.col("edge").cast("long").alias("edge"), F.col("lane").cast("long").alias("lane"), F.col("lane_y").cast("long").alias("lane_y"))


@query("even_spread", "SELECT n_nationkey, CASE WHEN count(*) OVER w <= 1 THEN 5850 ELSE CAST(trunc(700 + (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) * 10300.0::DOUBLE / (count(*) OVER w - 1)) AS INTEGER) END AS x FROM nation WINDOW w AS (PARTITION BY n_regionkey)")
def even_spread(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey")
    n = table(spark, d, "nation").select("n_nationkey", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("n_nationkey")) - 1).alias("k"))
    return n.select("n_nationkey", layout.even_spread_x(F.col("n"), F.col("k"), 700, 11_000).alias("x"))


@query("graph_edges_least", f"WITH {_E} SELECT a, b, strength FROM e WHERE strength >= 0.25")
def graph_edges_least(spark: SparkSession, d: str) -> DataFrame:
    """A graph table read with a least strength."""
    from threadloom.sources import readers

    return readers.graph_edges(_edges(spark, d)[1], 0.25).select("a", "b", "strength")

