"""Queries over addresses. Variants of every address are made the same way on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import url
from threadloom.operators import merge, selection
from threadloom.plans import sql
from threadloom.plans.registry import query
from threadloom.session import table


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """(id, v, u): each saved address as it is, as a Markdown link, and on the hosts the rules tell apart."""
    s = table(spark, d, "saved_items").select("id", "raw_url", "canonical_url", "title").distinct()
    path = F.regexp_replace("canonical_url", r"^https?://[^/]*", "")
    forms = [
        F.col("raw_url"), F.concat(F.lit("["), F.col("canonical_url"), F.lit("]("), F.col("canonical_url"), F.lit("?utm_q=1&b=a%20b&ref=z&c)")),
        F.concat(F.lit("https://Old.Reddit.com"), path), F.concat(F.lit("https://x.com"), path), F.concat(F.lit("https://www.linkedin.com"), path),
        F.concat(F.lit("https://youtu.be"), path), F.concat(F.lit("https://www.netflix.com/"), F.left("id", F.lit(4))), F.concat(F.lit("https://getpocket.com/"), F.left("id", F.lit(3))),
    ]
    x = F.array(*(F.struct(F.lit(i).alias("v"), f.alias("u")) for i, f in enumerate(forms)))
    return s.select("id", "title", F.explode(x).alias("x")).select("id", "title", "x.v", "x.u")


_P = "regexp_replace(canonical_url, '^https?://[^/]*', '')"
_URLS = f"""
WITH s AS (SELECT DISTINCT id, raw_url, canonical_url, title FROM saved_items),
urls AS (
  SELECT id, title, 0 AS v, raw_url AS u FROM s
  UNION ALL SELECT id, title, 1, '[' || canonical_url || '](' || canonical_url || '?utm_q=1&b=a%20b&ref=z&c)' FROM s
  UNION ALL SELECT id, title, 2, 'https://Old.Reddit.com' || {_P} FROM s
  UNION ALL SELECT id, title, 3, 'https://x.com' || {_P} FROM s
  UNION ALL SELECT id, title, 4, 'https://www.linkedin.com' || {_P} FROM s
  UNION ALL SELECT id, title, 5, 'https://youtu.be' || {_P} FROM s
  UNION ALL SELECT id, title, 6, 'https://www.netflix.com/' || left(id, 4) FROM s
  UNION ALL SELECT id, title, 7, 'https://getpocket.com/' || left(id, 3) FROM s)
"""


@query("url_canonicalize", _URLS + f"SELECT id, v, {sql.canonical('c')} AS canonical FROM (SELECT id, v, {sql.unwrap('u')} AS c FROM urls)")
def url_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("id", "v", url.canonical(F.col("u")).alias("canonical"))


@query("url_unwrap_markdown", _URLS + f"SELECT id, v, {sql.unwrap('u')} AS unwrapped FROM urls")
def url_unwrap(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("id", "v", url.unwrap_markdown(F.col("u")).alias("unwrapped"))


@query("url_source_counts", _URLS + f"SELECT {sql.source('u')} AS source, count(*) AS n FROM urls GROUP BY 1")
def url_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).groupBy(url.source(F.col("u")).alias("source")).agg(F.count("*").alias("n"))


@query("url_platform_compat", _URLS + f"SELECT {sql.platform('u')} AS platform, count(*) AS n FROM urls GROUP BY 1")
def url_platform(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).groupBy(url.platform(F.col("u")).alias("platform")).agg(F.count("*").alias("n"))


@query("url_kind_priority", _URLS + f"SELECT id, v, kind, {sql.priority('kind')} AS priority FROM (SELECT id, v, {sql.kind('u', 'title')} AS kind FROM urls)")
def url_kind_priority(spark: SparkSession, d: str) -> DataFrame:
    k = _urls(spark, d).select("id", "v", url.kind(F.col("u"), F.col("title")).alias("kind"))
    return k.withColumn("priority", url.kind_priority(F.col("kind")))


@query("title_from_url", _URLS + f"SELECT id, v, {sql.title('u')} AS title FROM urls ")
def title_from_url(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("id", "v", url.title(F.col("u")).alias("title"))


@query(
    "url_site_normalisers",
    _URLS
    + rf"""SELECT id, v,
 CASE WHEN lower({sql.part('u', 1)}) IN ('http', 'https') AND ({sql.host('u')} = 'reddit.com' OR {sql.host('u')} LIKE '%.reddit.com') AND contains({sql.part('u', 3)}, '/comments/') THEN 'https://www.reddit.com' || regexp_replace({sql.part('u', 3)}, '/+$', '') ELSE '' END AS thread,
 CASE WHEN {sql.bare('u')} IN ('x.com', 'twitter.com', 'mobile.twitter.com') AND regexp_matches({sql.part('u', 3)}, '^/([^/]+)/status/(\d+)') AND NOT regexp_matches({sql.part('u', 3)}, '/(?:analytics|retweets|quotes|likes)/?$')
  THEN 'https://x.com/' || regexp_extract({sql.part('u', 3)}, '^/([^/]+)/status/(\d+)', 1) || '/status/' || regexp_extract({sql.part('u', 3)}, '^/([^/]+)/status/(\d+)', 2) ELSE '' END AS status_url,
 regexp_extract({sql.part('u', 3)}, '(?i)^/r/([^/]+)', 1) AS sub, regexp_extract(u, '/status(?:es)?/(\d+)', 1) AS status_id,
 lower(regexp_extract(u, '(?i)https?://(?:www\.)?(?:x\.com|twitter\.com)/([^/?#]+)/status(?:es)?/\d+', 1)) AS handle,
 len({sql.segments('u')}) >= 6 AND lower(coalesce({sql.segments('u')}[3], '')) = 'comments' AS permalink
 FROM urls""",
)
def url_site_normalisers(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, d).select("id", "v", url.reddit_thread(u).alias("thread"), url.x_status(u).alias("status_url"), url.subreddit(u).alias("sub"), url.status_id(u).alias("status_id"), url.handle(u).alias("handle"), url.is_comment_permalink(u).alias("permalink"))


@query(
    "url_first_seen_dedupe",
    f"SELECT c AS canonical, min(row_id) AS row_id, count(*) AS n FROM (SELECT row_id, {sql.canonical('canonical_url')} AS c FROM llm_batched WHERE canonical_url IS NOT NULL) GROUP BY 1",
)
def url_first_seen(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "llm_batched").where("canonical_url is not null").select("row_id", url.canonical(F.col("canonical_url")).alias("canonical"))
    return u.groupBy("canonical").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@query(
    "import_outcome_counts",
    f"""WITH n AS (SELECT row_id, {sql.canonical('raw')} AS c, raw FROM (SELECT row_id, CASE WHEN row_id % 9 = 0 THEN 'ftp://x/' || row_id ELSE canonical_url END AS raw FROM llm_batched)),
 old AS (SELECT DISTINCT canonical_url FROM saved_items WHERE url_source = 'reddit'),
 r AS (SELECT n.*, row_number() OVER (PARTITION BY c ORDER BY row_id) AS k FROM n WHERE raw LIKE 'http%')
 SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN k > 1 OR c IN (SELECT canonical_url FROM old) THEN 'existing' ELSE 'inserted' END AS outcome FROM r
 UNION ALL SELECT 'invalid' FROM n WHERE raw IS NULL OR raw NOT LIKE 'http%') GROUP BY 1""",
)
def import_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "llm_batched").select("row_id", F.when(F.col("row_id") % 9 == 0, F.concat(F.lit("ftp://x/"), F.col("row_id").cast("string"))).otherwise(F.col("canonical_url")).alias("raw_url"))
    ok = F.coalesce(F.col("raw_url").startswith("http"), F.lit(False))
    new = n.where(ok).withColumn("canonical_url", url.canonical(F.col("raw_url")))
    old = table(spark, d, "saved_items").where("url_source = 'reddit'").select("canonical_url", "raw_url").dropDuplicates(["canonical_url"])
    _, outcome = merge.fill_or_insert(old, new, ["canonical_url"], ["raw_url"], [F.col("row_id")])
    return outcome.select("outcome").unionByName(n.where(~ok).select(F.lit("invalid").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("url_unseen", f"SELECT DISTINCT c AS canonical_url FROM (SELECT {sql.canonical('canonical_url')} AS c FROM llm_batched WHERE canonical_url IS NOT NULL) WHERE c NOT IN (SELECT canonical_url FROM saved_items) AND c NOT IN (SELECT canonical_url FROM documents)")
def url_unseen(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "llm_batched").where("canonical_url is not null").select(url.canonical(F.col("canonical_url")).alias("canonical_url")).distinct()
    return selection.unseen(c, table(spark, d, "saved_items"), table(spark, d, "documents"), keys=["canonical_url"])
