"""Model calls: job order, retries, parsing, normalising. The call itself is pluggable."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import cogmap, ids, url
from threadloom.functions.url import strip_blanks

RETRY_STATUS = (429, 500, 502, 503)
RESPONSE = "id string, http_status int, attempts int, assistant_content string, raw_text string, error string"


def content_length(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))


def job_order(batch: DataFrame, title_hint: Column | None = None, by_file: bool = False) -> DataFrame:
    """Jobs with priority and content length; to be ordered by (priority, content_len desc, pos), or by pos."""
    k = url.kind(F.col("canonical_url"), title_hint if title_hint is not None else F.lit("-"))
    d = batch.withColumn("kind", k).withColumn("priority", url.kind_priority(F.col("kind"))).withColumn("content_len", content_length(F.col("messages")))
    return d if not by_file else d.withColumn("priority", F.lit(0)).withColumn("content_len", F.lit(0))


def call_with_retry(call: Callable[[dict], tuple[int | None, str]], request: dict, attempts: int = 3, pause: float = 1.5, sleep=time.sleep) -> tuple[int | None, int, str, str | None]:
    """(status, attempts, body, error): waits pause x attempt after a failure that may pass."""
    status, body, error = None, "", None
    for n in range(1, attempts + 1):
        try:
            status, body = call(request)
            error = None if status is not None and status < 400 else f"HTTP {status}: {body[:200]}"
        except Exception as e:  # noqa: BLE001 - a transport failure of the pluggable call
            status, body, error = None, "", f"{type(e).__name__}: {e}"
        passing = status is None or status in RETRY_STATUS or (status == 400 and "json_validate_failed" in body)
        if error is None or not passing:
            return status, n, body, error
        if n < attempts:
            sleep(pause * n)
    return status, attempts, body, error


def complete(batch: DataFrame, call: Callable[[dict], tuple[int | None, str]], attempts: int = 3, pause: float = 1.5) -> DataFrame:
    """One response per request; requests are spread over tasks, the call runs in Python workers."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, messages in zip(pdf["id"], pdf["messages"]):
                s, n, body, error = call_with_retry(call, {"id": i, "messages": json.loads(messages)}, attempts, pause)
                text = None
                if error is None:
                    try:
                        text = json.loads(body)["choices"][0]["message"]["content"]
                    except (ValueError, KeyError, IndexError, TypeError):
                        text = None
                rows.append((i, s, n, text, body or None, error))
            out = pd.DataFrame(rows, columns=["id", "http_status", "attempts", "assistant_content", "raw_text", "error"])
            yield out.astype({"http_status": "Int32", "attempts": "Int32"})

    return batch.select("id", F.to_json("messages").alias("messages")).mapInPandas(run, RESPONSE)


def replay(recorded: dict[str, str]) -> Callable[[dict], tuple[int | None, str]]:
    """A call that answers from recorded bodies."""

    def call(request: dict) -> tuple[int | None, str]:
        body = recorded.get(request["id"])
        return (200, body) if body is not None else (404, "no record")

    return call


def normalise(outputs: DataFrame) -> DataFrame:
    """Outputs to source and concept nodes: (id, source_id, canonical_url, name, concepts, normalize_warning).

    Rows without an address, that failed, or without a parsed value are dropped;
    an unreadable answer gives a row without concepts and a warning.
    """
    ok = outputs.where((F.trim(F.coalesce("canonical_url", F.lit(""))) != "") & F.col("http_status").isNotNull() & (F.col("http_status") < 400) & F.col("parsed").isNotNull())
    text = cogmap.assistant_text(F.col("assistant_content"), F.col("raw_json"))
    # explode of one element keeps the parsed map from being parsed again for every use
    d = ok.withColumn("_text", text).withColumn("_p", F.explode(F.array(F.struct(cogmap.parse_state(F.col("_text")).alias("state"), cogmap.parse(F.col("_text")).alias("map")))))
    d = d.withColumn("_state", F.col("_p.state")).withColumn("_map", F.col("_p.map"))
    name = F.coalesce(F.nullif(strip_blanks(F.col("_map.root.label")), F.lit("")), url.title(F.col("canonical_url")))
    none = F.array().cast("array<struct<type:string,name:string,tier:int,confidence:double>>")
    return d.select("id", ids.source_id(F.col("canonical_url")).alias("source_id"), "canonical_url", name.alias("name"), F.when(F.col("_state") == "ok", cogmap.concepts(F.col("_map"))).otherwise(none).alias("concepts"), F.when(F.col("_state") != "ok", F.col("_state")).alias("normalize_warning"))


def mentions(normalised: DataFrame) -> DataFrame:
    """(source_id, concept_id, concept_type, name, tier, confidence, pos) of all concepts."""
    x = normalised.select("source_id", F.posexplode("concepts").alias("pos", "c"))
    return x.select("source_id", ids.concept_id(F.col("c.type"), F.col("c.name")).alias("concept_id"), F.col("c.type").alias("concept_type"), ids.concept_name(F.col("c.name")).alias("name"), F.col("c.tier").alias("tier"), F.col("c.confidence").alias("confidence"), "pos")
