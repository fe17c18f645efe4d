"""Problem 1: text cut off by field limits or broken transfers.

One pass over the texts gives, per record, the evidence at its end, and for the
corpus the counts of its words and of the ends of all its lines.

* The vocabulary becomes a trie stored as a table: one row per node (prefix), with
  whether it is a word and whether words go on from it. Last words of texts are
  left out, so cut words never enter it. A final token that is an unknown proper
  prefix of known words is a cut; so is a known word that (almost) never ends a
  phrase, such as an article.
* Ends that recur over distinct texts are usual closings, footers or controls,
  and whole; their proper prefixes are cut (the same trie, of lines).
* Length evidence: an open end (no full stop) is described by its form and the number
  of its words. Lines inside texts were not cut, so the share of each form among
  them says how often texts end that way of themselves; a form that is at least
  ``LIFT`` times as frequent at the ends of texts is a cut. So a long open sentence
  is, a list item or title isn't. Lengths of texts at which open ends pile up are field
  limits; an open end there is a cut.

Ends, lengths and forms count over distinct texts (a hash of the whole text), so
copies and prompts of one text are one witness. Nothing is broadcast but the
limits and forms, which are few by their definition, and ends that are at least
1/HOT of all.

Answers are cut if they stop inside their map; prose answers end like other texts.

Edge cases: null, empty and blank texts are whole; a text of one word is cut
only if the trie says so; rows delivered again give one result; of two versions of
one id the record is cut if one is; a missing answer or message is whole; a
null source is reported as "(none)"; empty tables give no rows; other columns are
ignored; texts are read whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.recurrence import _BARS, _ITEM, _SEP, _SLOT, HOT, LEAST, MARK, SLOT_AT, hints, key, prompt_parts, site_name, spell
from threadloom.session import cut

LIMITS = 5_000
WHOLE, CUT, ASK = range(3)
#: how much more frequent a form of open ends must be at the ends of texts than inside them
LIFT = 2.0
#: a known word that ends fewer than this share of the phrases it is in does not end one
INNER, INNER_LEAST = 0.002, 50

# What crawlers and editors leave where they cut.
_MARKS = re.compile(
    r"(?:\.{2,}|…)?\s*(?:(?:[\[<({]|>{2,})\s*(?:\w+ )?(?:truncated|clipped|cut(?: off| short)?|shortened|snip(?:ped)?|omitted|continues)\s*[\]>)}]?|\(more\)|\[\+\d+ chars?\]|\[(?:…|\.\.\.)\]|(?:\.{3}|…)\s*(?:see more|read more|continue reading|show more))$",
    re.I,
)
# An entity, escape, tag, link or code span that was opened and not closed.
_OPEN = re.compile(r"(?:^|(?<=\s))(?:&(?:#\w*|[a-z]+)|\\u[0-9a-fA-F]{0,3}|<[a-zA-Z/][^<>\n]*|!?\[[^\]\n]*|`[^`\n]+)$")
_URL_END = re.compile(r"https?:?/{0,2}[^\s]*$")
_DONE = re.compile(r"""[.!?。！？]["'”’»)\]]*$""")
_ELLIPSIS = re.compile(r"(?:…|\.{3,})$")
_LAST_TOKEN = re.compile(r"([^\W\d_]+)$")
_SENTENCE = re.compile(r"""(?<=[.!?])["'”’»)\]]*\s+""")
_WORDS = re.compile(r"[^\W\d_]+")


def line_end(line: str, site: str = "") -> tuple[str, str | None, str | None, bool]:
    """(form, last token, key of the last phrase, whether a finished sentence is before it) of a line's end.

    The form is "done", or for open ends a kind (dots, link, sign, word), whether
    finished sentences are before it, whether it is a list item, and its words.
    """
    if hints(line):
        line = _SLOT.sub(SLOT_AT, line)
    if m := MARK.match(line):
        line = line[m.end() :]
    if not line:
        return "done", None, None, False
    dots = _ELLIPSIS.search(line)
    if not dots and _DONE.search(line):
        return "done", None, None, False
    parts = _SEP.split(line) if any(b in line for b in _BARS) else [line]
    fragment = _SENTENCE.split(parts[-1])[-1]
    goes_on = fragment != line
    bare = _ELLIPSIS.sub("", fragment)
    token = _LAST_TOKEN.search(bare)
    kind = "dots" if dots else "link" if _URL_END.search(line) else "word" if token else "sign"
    n = len(_WORDS.findall(fragment))
    form = f"{kind} {goes_on and len(parts) == 1:d}{len(parts) > 1:d}{bool(_ITEM.match(line)):d} {min(n, 12)}"
    return form, token[1].casefold() if token else None, spell(fragment, site), goes_on


def end_evidence(text: str | None, title: str | None = None, site: str = "") -> tuple[int, str | None, str | None, str]:
    """(verdict, last token, last phrase, form) of one text; ASK needs the corpus."""
    s = (text or "").rstrip()
    if not s:
        return WHOLE, None, None, "done"
    if s[-1] == "�":
        return CUT, None, None, "done"
    line = s[s.rfind("\n") + 1 :].strip()
    if _MARKS.search(line):
        return CUT, None, None, "done"
    if title and line.casefold() == title.strip().casefold():
        return WHOLE, None, None, "done"
    if _OPEN.search(line):
        return CUT, None, None, "done"
    form, token, phrase, _ = line_end(line, site)
    return (WHOLE if form == "done" else ASK), token, phrase, form


def open_map(text: str) -> bool:
    """Whether a JSON text ends inside a string, an object or a list."""
    depth, inside, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif inside:
            if c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def answer_cut(text: str | None) -> bool:
    """Whether an answer stops inside its map."""
    s = (text or "").strip()
    if not s:
        return False
    if s[-1] == "�":
        return True
    at = s.find("{")
    if at < 0:
        return False
    s = s[at:]
    if s.endswith(("}", "}\n```", "```")) or "}" in s:
        try:
            json.JSONDecoder(strict=False).raw_decode(s)
            return False
        except (ValueError, RecursionError):
            pass
    return open_map(s)


# ---- one pass over the texts ----------------------------------------------

# what: 0 a record, 1 a word, 2 an open end of a line, 3 ends of lines by form
_SCHEMA = "what int, table_name string, record_id string, source string, verdict int, token string, phrase long, form string, n long, ends long, whole long, spelled string"


class _Counts:
    """Words and line ends of a partition; the last word of a text is no witness."""

    def __init__(self):
        self.words: Counter = Counter()
        self.last: Counter = Counter()
        self.forms: Counter = Counter()

    def add(self, text: str, site: str, whole: int, out: list) -> None:
        lines = [x for x in (x.strip() for x in text.split("\n")) if x]
        for x in lines[:-1]:
            toks = x.split()
            self.words.update(toks)
            self.last[toks[-1]] += 1
            form, _, phrase, _ = line_end(x, site)
            if form == "done":
                self.forms[form, 0] += 1
            elif phrase:
                out.append((2, None, None, None, 0, None, key(phrase), form, None, None, whole, phrase))
        if lines:
            self.words.update(lines[-1].split()[:-1])

    def drain(self):
        out: Counter = Counter()
        ends: Counter = Counter()
        for raw, n in self.words.items():
            ws = _WORDS.findall(raw.casefold())
            for w in ws:
                out[w] += n
            if ws:
                ends[ws[-1]] += n if _DONE.search(raw) else min(n, self.last[raw])
        rows = [(1, None, None, None, None, w, None, None, n, ends[w], None, None) for w, n in out.items()]
        rows += [(3, None, None, None, v, None, None, f, n, None, None, None) for (f, v), n in self.forms.items()]
        self.words.clear()
        self.last.clear()
        self.forms.clear()
        return _batch(rows)


def _batch(rows):
    cols = list(zip(*rows)) if rows else [[]] * 12
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["what", "table_name", "record_id", "source", "verdict", "token", "phrase", "form", "n", "ends", "whole", "spelled"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _pass(name: str, judge):
    """judge(row) -> (verdict, token, phrase, form, length, hash of the text, [(text, site, hash)] for the counts)."""

    def run(batches):
        counts = _Counts()
        for b in batches:
            rows: list = []
            for i, source, *rest in zip(*(c.to_pylist() for c in b.columns)):
                verdict, tok, phrase, form, n, whole, texts = judge(*rest)
                for t, site, h in texts:
                    counts.add(t, site, h, rows)
                rows.append((0, name, i, source, verdict, tok, None if phrase is None else key(phrase), form, n, None, whole, phrase))
            yield _batch(rows)
            if len(counts.words) > 200_000:
                yield counts.drain()
        yield counts.drain()

    return run


def _hash(text: str | None) -> int | None:
    """The same for a saved text and for a prompt that holds it."""
    return key(s) if (s := (text or "").strip()) else None


def _judge_item(text, title, url):
    site, h = site_name(url), _hash(text)
    return *end_evidence(text, title, site), len(text or ""), h, [(text, site, h)] if text else []


def _judge_prompt(messages, url, mode):
    """The worst of the messages; the vocabulary sees each once. A prompt of a title alone carries the project's note, which is whole."""
    best, texts, site = (WHOLE, None, None, "done", 0, None), [], site_name(url)
    rank = {CUT: 2, ASK: 1, WHOLE: 0}
    for m in messages or []:
        content = (m or {}).get("content")
        if not content:
            continue
        title, body = ("", content) if (m.get("role") == "system") else prompt_parts(content)
        if mode == "title_only" and m.get("role") != "system":
            continue
        h = _hash(body)
        texts.append((body, site, h))
        got = (*end_evidence(body, title or None, site), len(body), h)
        if rank[got[0]] > rank[best[0]]:
            best = got
    return *best, texts


def _judge_answer(text):
    s = (text or "").strip()
    h = _hash(s)
    if "{" in s or not _WORDS.search(s):
        return (CUT if answer_cut(s) else WHOLE), None, None, "done", len(text or ""), h, []
    s = re.sub(r"^```\w*\s*|\s*```$", "", s)
    return *end_evidence(s), len(text), h, [(s, "", h)]


def answer_text(raw_column: str = "raw", content: str = "assistant_content"):
    """The answer of an output row: its own column, else the first choice of the raw response."""
    first = F.get(F.col(f"{raw_column}.choices"), F.lit(0))["message"]["content"]
    blank = F.trim(F.coalesce(F.col(content), F.lit(""))) == ""
    return F.when(blank, first).otherwise(F.col(content))


_HOST = r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def evidence(items: DataFrame, prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Ends of all records and lines, and words of all texts, in one pass over each table."""
    host = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("canonical_url", "source"), _HOST, 1), F.lit("")), F.lit("(none)"))
    url = F.col("canonical_url") if "canonical_url" in items.columns else F.lit(None).cast("string")
    a = items.select("id", F.coalesce("url_source", F.lit("(none)")).alias("source"), "extracted_text", "title", url.alias("url")).where("id is not null")
    mode = F.col("content_mode") if "content_mode" in prompts.columns else F.lit(None).cast("string")
    b = prompts.where("id is not null").select("id", host.alias("source"), "messages", "canonical_url", mode.alias("mode"))
    c = outputs.where("id is not null").select("id", host.alias("source"), answer_text().alias("text"))
    return (
        a.mapInArrow(_pass("saved_items", _judge_item), _SCHEMA)
        .unionByName(b.mapInArrow(_pass("groq_batch_3r", _judge_prompt), _SCHEMA))
        .unionByName(c.mapInArrow(_pass("groq_batch_all_1776865759_outputs", _judge_answer), _SCHEMA))
    )


def trie(words: DataFrame) -> DataFrame:
    """(node, is_word, goes_on, inner): one row per prefix of a word of the corpus that occurs at least twice.

    inner: a frequent word that (almost) never ends a phrase.
    """
    known = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where("n >= 2")
    known = known.select("word", ((F.col("n") >= INNER_LEAST) & (F.col("ends") < INNER * F.col("n"))).alias("inner"))
    nodes = known.select(F.explode(F.expr("transform(sequence(1, length(word)), i -> struct(substring(word, 1, i) as node, i = length(word) as is_word, i = length(word) and inner as inner))")).alias("x")).select("x.*")
    return nodes.groupBy("node").agg(F.max("is_word").alias("is_word"), F.max(~F.col("is_word")).alias("goes_on"), F.max("inner").alias("inner"))


def judged(items: DataFrame, prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(table_name, record_id, source, is_cut): one row per record."""
    seen = cut(evidence(items, prompts, outputs))
    records = seen.where("what = 0")
    asked = records.where(f"verdict = {ASK}").select("table_name", "record_id", "source", "token", "phrase", "form", "n").distinct()
    nodes = trie(seen.where("what = 1").select(F.col("token").alias("word"), "n", "ends"))
    tokens = asked.select(F.col("token").alias("node")).where("node is not null").distinct()
    cut_tokens = tokens.join(nodes, "node").where("(goes_on and not is_word) or inner").select(F.col("node").alias("token"), F.lit(True).alias("cut_token"))
    texts = records.where("n > 0").select("table_name", "n", "verdict", "whole").distinct()  # copies are one text
    # field limits: lengths at which far more open texts stop than at the lengths beside
    per = texts.where(f"verdict <> {WHOLE}").groupBy("table_name", "n").agg(F.count("*").alias("c"))
    total = F.lit(texts.count() / LIMITS)
    w = Window.partitionBy("table_name").orderBy("n").rangeBetween(-4, 4)
    limits = per.withColumn("around", (F.sum("c").over(w) - F.col("c")) / 8).where(F.col("c") >= F.greatest(F.lit(5), total, 5 * F.col("around"))).select("table_name", "n", F.lit(True).alias("at_limit"))
    limits = cut(limits)  # at most LIMITS rows
    # ends of lines over distinct texts: those that recur are usual
    at_limit = records.join(F.broadcast(limits), ["table_name", "n"], "left")
    free = at_limit.where("at_limit is null").select("phrase", "form", F.lit(1).alias("final"), "whole", "spelled").unionByName(seen.where("what = 2").select("phrase", "form", F.lit(0).alias("final"), "whole", "spelled"))
    ends = free.where("phrase is not null and form <> 'done'").dropDuplicates(["phrase", "final", "whole"])
    ends = ends.groupBy("phrase", "form").agg(F.count_distinct("whole").alias("c"), F.sum("final").alias("finals"), F.count("*").alias("all"), F.first("spelled").alias("spelled"))
    ends = cut(ends)
    per_phrase = ends.groupBy("phrase").agg(F.sum("c").alias("c"), F.first("spelled").alias("spelled")).where(F.col("c") >= LEAST)
    usual = cut(per_phrase.select("phrase", "c", "spelled"))
    # forms of the other open ends: at the ends of texts against inside them
    rare = ends.join(usual.select("phrase"), "phrase", "left_anti")
    forms = rare.groupBy("form").agg(F.sum("finals").alias("last"), F.sum(F.col("all") - F.col("finals")).alias("inside"))
    n_last = texts.count()
    n_inside = seen.where("what = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + (ends.agg(F.coalesce(F.sum(F.col("all") - F.col("finals")), F.lit(0))).first()[0])
    high = F.col("last") * max(1, n_inside) >= LIFT * (F.col("inside") + 0.5) * max(1, n_last)
    forms = forms.where(high).select("form", F.lit(True).alias("odd"))
    begins = usual.where("length(spelled) > 3").select(F.explode(F.expr("transform(sequence(3, length(spelled) - 1), i -> xxhash64(substring(spelled, 1, i)))")).alias("phrase")).distinct()
    begins = begins.join(usual, "phrase", "left_anti").select("phrase", F.lit(True).alias("begun"))
    often = F.col("c") >= F.lit(max(1.0, n_last / HOT))
    hot = usual.where(often).select("phrase", F.lit(True).alias("hot"))
    out = asked.join(F.broadcast(hot), "phrase", "left")
    out = out.where("hot").withColumn("is_usual", F.lit(True)).unionByName(out.where("hot is null").join(usual.where(~often).select("phrase", F.lit(True).alias("is_usual")), "phrase", "left"))
    out = out.join(begins, "phrase", "left").join(cut_tokens, "token", "left").join(F.broadcast(forms), "form", "left").join(F.broadcast(limits), ["table_name", "n"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_cut = ~yes("is_usual") & (yes("cut_token") | yes("begun") | yes("at_limit") | yes("odd"))
    settled = records.where(f"verdict <> {ASK}").select("table_name", "record_id", "source", (F.col("verdict") == CUT).alias("is_cut"))
    found = settled.unionByName(out.select("table_name", "record_id", "source", is_cut.alias("is_cut")))
    return found.groupBy("table_name", "record_id").agg(F.max("source").alias("source"), F.max("is_cut").alias("is_cut"))


def cut_records(items: DataFrame, prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(table_name, record_id) of every record whose text was cut."""
    return judged(items, prompts, outputs).where("is_cut").select("table_name", "record_id")


def cut_share(items: DataFrame, prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(table_name, source, records, cut_records, cut_share) of every source."""
    j = judged(items, prompts, outputs)
    g = j.groupBy("table_name", "source").agg(F.count("*").alias("records"), F.count_if("is_cut").alias("cut_records"))
    return g.withColumn("cut_share", F.col("cut_records") / F.col("records"))
