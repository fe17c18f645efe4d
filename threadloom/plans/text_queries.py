"""Queries that clean, score and structure texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import selection
from threadloom.plans import sql
from threadloom.plans.registry import query
from threadloom.session import table

_REDDIT = "'" + "', '".join(w.replace("'", "''") for w in text.REDDIT_LINES) + "'"
_X = "'" + "', '".join(w.replace("'", "''") for w in text.X_LINES) + "'"
_ITEMS = "i AS (SELECT DISTINCT id, extracted_text AS t, url_source FROM saved_items WHERE extracted_text IS NOT NULL)"
_LINES = r"string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10))"


def reddit_clean() -> str:
    keep = rf"s <> '' AND NOT (lower(s) IN ({_REDDIT}) OR regexp_matches(lower(s), '^\d+\s+(upvotes?|downvotes?|points?|votes?)$') OR regexp_matches(lower(s), '^\d+\s+(second|minute|hour|day|week|month|year)s?\s+ago$') OR length(s) = 1 OR regexp_matches(s, '^u/[\p{{L}}\p{{N}}_]+$'))"
    return f"array_to_string(list_filter(list_transform({_LINES}, lambda s: {sql.strip('s')}), lambda s: {keep}), chr(10))"


def x_clean() -> str:
    u = "t"
    for p in (r"https?://\S+", r"\bwww\.\S+\b", r"\bx\.com/\S+\b", r"\btwitter\.com/\S+\b"):
        u = f"regexp_replace({u}, '(?i){p}', '', 'g')"
    lines = _LINES.replace("(t,", f"({u},")
    col = sql.strip(r"regexp_replace(replace(s, chr(160), ' '), '[ \t]+', ' ', 'g')")
    keep = rf"s <> '' AND NOT (lower(s) IN ({_X}) OR lower(s) LIKE 'replying to %' OR regexp_matches(s, '^@\S+$') OR regexp_matches(lower(s), '^\d+[smhdwy]$') OR regexp_matches(s, '^[^\p{{L}}\p{{N}}]+$') OR regexp_matches(lower(s), '^\d+(\.\d+)?[kmb]?$'))"
    return f"array_to_string(list_filter(list_transform({lines}, lambda s: {col}), lambda s: {keep}), chr(10))"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "saved_items").where("extracted_text is not null").select("id", F.col("extracted_text").alias("t"), "url_source").distinct()


@query("clean_lines_reddit", f"WITH {_ITEMS} SELECT id, sha1({reddit_clean()}) AS cleaned FROM i")
def clean_lines_reddit(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("id", F.sha1(text.clean_lines(F.col("t"), "reddit")).alias("cleaned"))


@query("clean_lines_x", f"WITH {_ITEMS} SELECT id, sha1({x_clean()}) AS cleaned FROM i")
def clean_lines_x(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("id", F.sha1(text.clean_lines(F.col("t"), "x")).alias("cleaned"))


@query("first_meaningful_line", rf"WITH {_ITEMS}, c AS (SELECT id, {x_clean()} AS k FROM i) SELECT id, coalesce(left(list_filter(list_transform(string_split(k, chr(10)), lambda s: regexp_replace(s, '^[ \-–—|]+|[ \-–—|]+$', '', 'g')), lambda s: length(s) >= 8)[1], 120), '') AS line FROM c")
def first_meaningful_line(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("id", text.first_line(F.col("t"), "x").alias("line"))


@query("longest_text_per_source", f"WITH {_ITEMS} SELECT url_source, arg_max(id, {{'n': length(t), 'i': id}}) AS id, max(length(t)) AS n FROM i WHERE url_source IS NOT NULL GROUP BY 1")
def longest_text(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where("url_source is not null").groupBy("url_source").agg(F.max_by("id", F.struct(F.length("t"), "id")).alias("id"), F.max(F.length("t")).alias("n"))


@query("structured_sections", "SELECT DISTINCT id, sha1(concat_ws(chr(10) || chr(10), CASE WHEN coalesce(title, '') <> '' THEN 'TITLE:' || title END, CASE WHEN coalesce(extracted_text, '') <> '' THEN 'POST:' || extracted_text END, CASE WHEN coalesce(summary, '') <> '' THEN 'COMMENTS:' || summary END)) AS body FROM saved_items")
def structured_sections(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saved_items").select("id", "title", "extracted_text", "summary")
    body = text.structured("linkedin", {"TITLE": F.col("title"), "POST": F.col("extracted_text"), "COMMENTS": F.col("summary")})
    return s.select("id", F.sha1(body).alias("body")).distinct()


_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events), t AS (SELECT user_id, min(idx) AS target, arg_min(event_type, idx) AS author FROM e WHERE idx % 10 = 5 GROUP BY 1)"


def _thread(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as the posts of a thread: type is the author, one post is the target."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"))
    t = e.where("idx % 10 = 5").groupBy("user_id").agg(F.min("idx").alias("target"), F.min_by("event_type", "idx").alias("author"))
    return e.join(t, "user_id")


@query("thread_neighbours", f"WITH {_EVENTS} SELECT user_id, event_id, CASE WHEN idx < target THEN 'above' ELSE 'below' END AS side FROM e JOIN t USING (user_id) WHERE idx <> target AND event_type = author AND abs(idx - target) <= 15")
def thread_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = _thread(spark, d).where("idx <> target and event_type = author and abs(idx - target) <= 15")
    return e.select("user_id", "event_id", F.when(F.col("idx") < F.col("target"), "above").otherwise("below").alias("side"))


@query("reply_split", f"WITH {_EVENTS}, r AS (SELECT user_id, event_id, value, idx FROM e JOIN t USING (user_id) WHERE idx > target AND NOT (event_type = author AND abs(idx - target) <= 15)) SELECT user_id, arg_max(event_id, {{'v': value, 'e': event_id}}) FILTER (value < 50) AS below_main, arg_max(event_id, {{'v': value, 'e': event_id}}) FILTER (value >= 50) AS at_least_main, count(*) AS replies FROM r GROUP BY 1")
def reply_split(spark: SparkSession, d: str) -> DataFrame:
    r = _thread(spark, d).where("idx > target and not (event_type = author and abs(idx - target) <= 15)")
    best = lambda c: F.max_by(F.when(c, F.col("event_id")), F.when(c, F.struct("value", "event_id")))
    return r.groupBy("user_id").agg(best(F.col("value") < 50).alias("below_main"), best(F.col("value") >= 50).alias("at_least_main"), F.count("*").alias("replies"))


@query(
    "compact_numbers",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id * 1000.0 WHEN 1 THEN CAST(event_id AS DOUBLE) WHEN 2 THEN (event_id + 0.5) * 1000000.0 WHEN 3 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS n FROM events",
)
def compact_numbers(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    t = F.when(i % 5 == 0, F.concat(s, F.lit("K"))).when(i % 5 == 1, F.format_number(i, 0)).when(i % 5 == 2, F.concat(s, F.lit(".5m"))).when(i % 5 == 3, "n/a").otherwise(F.concat(F.lit("about "), s))
    return table(spark, d, "events").select("event_id", F.round(text.compact_number(t), 3).alias("n"))


@query("reply_quality", r"WITH i AS (SELECT doc_id, text, (doc_id % 97)::DOUBLE AS likes, (doc_id % 13)::DOUBLE AS replies, len(regexp_extract_all(text, '[.!?]')) AS marks FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(length(text) + CASE WHEN marks > 0 THEN 12 ELSE 0 END + 3 * least(marks, 6) + least(likes / 10.0, 500.0) + least(replies * 3.0, 300.0), 6) AS quality FROM i")
def reply_quality(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.round(text.reply_quality(F.col("text"), (F.col("doc_id") % 97).cast("double"), (F.col("doc_id") % 13).cast("double")), 6).alias("quality"))


@query("meaningful_counts", f"WITH {_ITEMS} SELECT url_source, count_if(length({x_clean()}) >= 25) AS x_ok, count_if(length({sql.strip('t')}) >= 200) AS usable FROM i WHERE url_source IS NOT NULL GROUP BY 1")
def meaningful_counts(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.sources.readers import crawl_usable

    return _items(spark, d).where("url_source is not null").groupBy("url_source").agg(F.count_if(text.is_meaningful(F.col("t"), "x", 25)).alias("x_ok"), F.count_if(crawl_usable(F.col("t"))).alias("usable"))


def _gone(site: str) -> str:
    """The first marker that a text holds, in the order of the list."""
    cases = " ".join(f"WHEN contains(t, '{m.replace(chr(39), chr(39) * 2)}') THEN '{m.replace(' ', '_').replace(chr(39), chr(39) * 2)}'" for m in text.GONE_MARKERS[site])
    return f"CASE WHEN status >= 400 THEN 'http_' || status {cases} END"


_PLANTED = "('this post was deleted'), ('Page not found'), ('CONTENT UNAVAILABLE now'), ('not visible; page not found'), ('all is well')"


@query("gone_reasons", f"WITH {_ITEMS}, p AS (SELECT * FROM (VALUES {_PLANTED}) v(x)), c AS (SELECT id, x, lower(t || ' ' || x) AS t, CASE WHEN id < '4' THEN 404 ELSE 200 END AS status FROM i, p) SELECT id, x, {_gone('linkedin')} AS linkedin, {_gone('x')} AS x_site FROM c")
def gone_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a post is gone, for every text as it is and with a marker behind it."""
    x = F.explode(F.array(*(F.lit(v) for v in ("this post was deleted", "Page not found", "CONTENT UNAVAILABLE now", "not visible; page not found", "all is well"))))
    i = _items(spark, d).select("id", "t", F.when(F.col("id") < "4", 404).otherwise(200).alias("status"), x.alias("x")).withColumn("t", F.concat_ws(" ", "t", "x"))
    return i.select("id", "x", text.gone_reason("linkedin", F.col("status"), F.col("t")).alias("linkedin"), text.gone_reason("x", F.col("status"), F.col("t")).alias("x_site"))


@query("slugs", r"SELECT p_partkey, coalesce(nullif(trim(left(trim(regexp_replace(regexp_replace(array_to_string(list_slice(string_split(trim(regexp_replace(p_name, '\s+', ' ', 'g')), ' '), 1, 6), ' '), '[^\p{L}\p{N}_\s\-]', '', 'g'), '\s+', ' ', 'g')), 44)), ''), 'Untitled') AS short FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug_short(F.col("p_name")).alias("short"))
