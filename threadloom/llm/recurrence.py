"""What recurs across a corpus of crawled texts, and what that says of its lines.

Nothing here knows a phrase of a page. A line is cut into units at the
separators of bars; a unit is compared without case, numbers, codes and the
name of its own site. Over the distinct texts of the corpus every unit that
recurs gets four figures: in how many texts it stands, how often it stands
beside another recurring line (page furniture comes in blocks, a sign-off stands
alone under its prose), how often a run of titles follows it (the heading of a
sidebar), and how often the whole text has nothing of its own (the text of an
error page or of a template). From these follow

* FURNITURE - part of the page around the content,
* LEAD - heading of a sidebar; the titles under it are links,
* RESIDUE - what stands where the content should be,
* SLOT - a sentence with an unfilled slot that recurs with the slot masked.

Plan: one pass over the texts writes their features (lines, units, hashes); all
counts are sums of hashes with map-side aggregates. Units of at least 1/HOT of
all occurrences (so at most HOT of them) are joined by broadcast, the others by
a shuffle of hashes in which no key is more frequent than that; so a unit in a
third of all rows is never one task. All texts under one title are one witness
(a text without title is its own), so neither copies nor near-copies of an
article make its lines recur.

Edge cases: null, empty and blank texts have no lines; null ids are skipped;
null titles and addresses are empty; rows delivered again are counted once;
an empty table gives no units; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

FURNITURE, LEAD, RESIDUE, SLOT, RECURS, BEGUN = 1, 2, 4, 8, 16, 32
MARKED, TITLE_LIKE = 1, 2
#: witnesses for a unit that recurs
LEAST = 3
#: shares of a unit's occurrences: beside furniture, before titles, in texts without anything of their own
BESIDE, BEFORE, BARE = 0.2, 0.8, 0.5
HOT = 20_000
#: a word in at least this share of the texts is a common word
COMMON = 0.01

_SEP = re.compile(r"\s+[|·>»•]\s+|\s{2,}")
_CODE = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+(?:[.,:]\d+)*")
_ITEM = re.compile(r"(?:[-*•]|\d+[.)])\s+\S")
_LETTERS = re.compile(r"[^\W\d_]+")
_TO_SPACE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_SENT = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+")
_HOST = re.compile(r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")
# The project's own marks.
MARK = re.compile(r"(?:POST:|COMMENTS:|---COMMENT---)\s*")
# What crawlers and editors leave where they cut.
CUT_MARK = re.compile(r"\s*(?:\.{2,}|…)?\s*[\[<(]\s*(?:content |text |message )?(?:truncated|clipped|cut(?: off)?|shortened|snip(?:ped)?)\s*[\]>)]\s*$|\s*(?:\.{3,}|…)\s*$", re.I)
# The slot forms of template languages and the literal stand-ins of missing values.
SLOT_FORMS = [
    r"\{\{[^{}\n]{0,40}\}\}",
    r"\{%[^%\n]{1,40}%\}",
    r"<%=?[^%\n]{1,40}%>",
    r"<{2,3}[^<>\n]{1,40}>{2,3}",
    r"<INSERT [^<>\n]{1,40}>",
    r"\[\[[^\[\]\n]{1,40}\]\]",
    r"\[(?!TRUNCATED|CUT|CLIPPED|SHORTENED|SNIP)[A-Z][A-Z _]{1,30}\]",
    r"%%\w+%%",
    r"%\(\w+\)s",
    r"\*\|\w+\|\*",
    r"__[A-Z][A-Z_]*__",
    r"\b[A-Z]+(?:_[A-Z]+)*_GOES_HERE\b",
    r"@Model(?:\.\w+)+",
    r"#\{[^{}\n]{1,40}\}",
    r"\$\{[^{}\n]{1,40}\}",
    r"\$[a-z][a-z_]*\$",
    r"\{[a-z][a-z_ ]{1,30}\}",
    r"\[object Object\]",
    r"(?<![\w.])(?:undefined|null|NULL|None|nan|NaN|nil|N/A|\(null\))(?!\w)",
]
_SLOT = re.compile("|".join(SLOT_FORMS))
# what every slot form holds; each branch begins with a fixed character, so a search skips to the next of them
_HINT = re.compile(r"\{|<[%<I]|\[[\[A-Zo]|%[%(]|\*\||__|_GOES_HERE|@Model|\$[a-z]|" + "|".join(rf"{w}(?!\w)" for w in ("undefined", "null", "NULL", "None", "nan", "NaN", "nil", "N/A")))
# the same, as plain searches, which are faster on a text without any
_HINTS = (*"{}<>$%[]@_", "undefined", "null", "NULL", "None", "nan", "NaN", "nil", "N/A")
_BARS = ("|", "·", ">", "»", "•", "  ", "\t")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
_STOPS, _QUOTES = frozenset(".!?…:;,"), "\"”’»)]"
_CLOSED = _STOPS | frozenset(_QUOTES)
SLOT_AT = "\x00"


def site_name(url: str | None) -> str:
    """The name of a site: the label before the last of its host."""
    m = _HOST.match(url or "")
    labels = m[1].casefold().split(".") if m else []
    return labels[-2] if len(labels) > 1 else ""


def spell(part: str, site: str = "", last: bool = False) -> str:
    """A unit without case, numbers, codes and the name of its site."""
    return _masked(" ".join(part.casefold().split()), site, last)


def _digits(p: str) -> bool:
    if p.isascii():
        return "0" in p or "1" in p or "2" in p or "3" in p or "4" in p or "5" in p or "6" in p or "7" in p or "8" in p or "9" in p
    return _DIGIT.search(p) is not None


def _masked(p: str, site: str, last: bool) -> str:
    if site:
        p = p.replace(site, "*")
        if last and " " in p:
            head, _, tail = p.rpartition(" ")
            if len(tail) >= 3 and site.startswith(tail):
                p = f"{head} *"
    if not _digits(p):
        return p
    # a code lies within one token, so only tokens with a digit are searched
    out, done = [], 0
    m = _DIGIT.search(p)
    while m:
        a = p.rfind(" ", done, m.start()) + 1 or done
        b = p.find(" ", m.end())
        b = len(p) if b < 0 else b
        out += p[done:a], _CODE.sub("#", p[a:b])
        done = b
        m = _DIGIT.search(p, b)
    return "".join(out) + p[done:]


def key(unit: str) -> int:
    """The same as Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(unit, seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


class _LineEvents(HTMLParser):
    """Streams parser events into text characters and tags per line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: dict[int, int] = {}
        self.tags: dict[int, int] = {}

    def handle_starttag(self, tag, attrs):
        n = self.getpos()[0]
        self.tags[n] = self.tags.get(n, 0) + 1

    def handle_endtag(self, tag):
        n = self.getpos()[0]
        self.tags[n] = self.tags.get(n, 0) + 1

    def handle_data(self, data):
        n = self.getpos()[0]
        for i, part in enumerate(data.split("\n")):
            if part:
                self.text[n + i] = self.text.get(n + i, 0) + len(part)


_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")


def tag_counts(text: str, n_lines: int) -> tuple[list[int], list[int]]:
    """Text characters and tags of each line, from the streaming parser.

    A text without anything that looks like a tag is not parsed: every line is
    text then, which is what the parser would report.
    """
    lines = text.split("\n")
    if not _TAG.search(text):
        return [len(x) for x in lines], [0] * n_lines
    p = _LineEvents()
    try:
        p.feed(text)
        p.close()
    except (AssertionError, ValueError):
        return [len(x) for x in lines], [0] * n_lines
    return [p.text.get(i + 1, 0) for i in range(n_lines)], [p.tags.get(i + 1, 0) for i in range(n_lines)]


def letter_words(text: str) -> set[str]:
    """The distinct runs of letters of a text."""
    # what is no letter in ASCII goes in one step; the few tokens with another sign are searched
    got = set(text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).decode("utf-8", "surrogatepass").split())
    for x in [x for x in got if not x.isalpha()]:
        got.remove(x)
        got.update(_LETTERS.findall(x))
    return got


def hints(text: str) -> bool:
    """Whether a text may hold a slot."""
    return any(h in text for h in _HINTS)


def slot_windows(text: str) -> list[str]:
    """Sentences and lines with an unfilled slot, the slots masked."""
    out: list[str] = []
    if not hints(text) or not _HINT.search(text):
        return out
    for line in text.split("\n"):
        if _HINT.search(line):
            masked = _SLOT.sub(SLOT_AT, line)
            if SLOT_AT in masked:
                out += [spell(w) for w in _SENT.split(masked) if SLOT_AT in w]
    return out


def read(text: str | None, title: str | None, url: str | None, titled: bool = False):
    """Lines and units of one text: (line numbers, marks, tags, words, units, their lines, lengths, spellings).

    The windows with slots come last, as units of line -1.
    """
    no, marks, tags, words, at, chars, spelled = [], [], [], [], [], [], []
    head, nl, last = (text or "").rstrip().rpartition("\n")
    text = head + nl + (CUT_MARK.sub("", last) if last.endswith(("]", ">", ")", "…", "...")) else last)
    raw = text.split("\n")
    site = site_name(url)
    seen, found = tag_counts(text, len(raw)) if "<" in text else ([], [0] * len(raw))
    bars = [b for b in _BARS if b in text]
    end = len(raw) - 1
    while end > 0 and not raw[end].strip():
        end -= 1
    for i, s in enumerate(raw):
        x = s.strip()
        if not x:
            continue
        m = MARK.match(x)
        if m and not (x := x[m.end() :]):
            continue
        n = len(no)
        parts = [p for p in _SEP.split(x) if p] if bars and any(b in x for b in bars) else [x]
        open_ = not m and len(parts) == 1 and not (x[-1] in _CLOSED and x.rstrip(_QUOTES)[-1:] in _STOPS) and not _ITEM.match(x)
        title_like = open_ and len(list(islice(_LETTERS.finditer(x), 3))) == 3
        no.append(i + 1)
        marks.append((MARKED if m else 0) | (TITLE_LIKE if title_like else 0))
        tags.append(found[i])
        folded = [" ".join(p.casefold().split()) for p in parts]
        words.append((folded[0].count(" ") + 1 if len(parts) == 1 else len(x.split())) if _LETTER.search(x) else 0)
        for j, p in enumerate(parts):
            at.append(n)
            chars.append(len(p) if not found[i] else seen[i] // len(parts))
            spelled.append(_masked(folded[j], site, i == end and j == len(parts) - 1))
    for w in slot_windows(text) + (slot_windows(title or "") if titled else []):
        at.append(-1)
        chars.append(0)
        spelled.append(w)
    return no, marks, tags, words, [key(u) for u in spelled], at, chars, spelled


# ---- features ---------------------------------------------------------------

_LISTS = {"no": pa.int32(), "marks": pa.int32(), "tags": pa.int32(), "words": pa.int32(), "u": pa.int64(), "at": pa.int32(), "chars": pa.int32(), "spelled": pa.string()}
# a row with a null rid holds a word (as title) and in how many texts of a partition it stands (as witness)
_FEATURES = "rid long, table_name string, record_id string, title string, witness long, no array<int>, marks array<int>, tags array<int>, words array<int>, u array<long>, at array<int>, chars array<int>, spelled array<string>"

_HEAD = re.compile(r"(?:(?:URL|TITLE):[^\n]*(?:\n\s*|$)|CONTENT:[ \t]*\n?)+")
_TITLES = re.compile(r"^TITLE:[ \t]*(.*)$", re.M)


def prompt_parts(content: str) -> tuple[str, str]:
    """Title and saved text of a user message; the head may come twice."""
    m = _HEAD.match(content)
    head, body = (m[0], content[m.end() :]) if m else ("", content)
    titles = _TITLES.findall(head)
    title = titles[-1].strip() if titles else ""
    return ("" if title == "(no title)" else title), body


def plain(column) -> list:
    """The same as ``to_pylist`` of a column of strings, or of lists of strings or whole numbers, by slices of all values."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()
    if column.values.null_count:
        return column.to_pylist()
    at, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()
    out = [values[a:b] for a, b in zip(at, at[1:])]
    return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist())] if column.null_count else out


def _emit(rows):
    cols = list(zip(*rows)) if rows else [[]] * 13
    arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))]
    arrays += [pa.array(c, pa.list_(t)) for c, t in zip(cols[5:], _LISTS.values())]
    return pa.RecordBatch.from_arrays(arrays, names=["rid", "table_name", "record_id", "title", "witness", *_LISTS])


def _reader(name: str, texts):
    """texts(row) -> (title, url, text, whether the title counts as text) of each text of a row."""

    def counted(words: Counter):
        rows = [(None, None, None, w, n, *[None] * 8) for w, n in words.items()]
        words.clear()
        return _emit(rows)

    def run(batches):
        n = TaskContext.get().partitionId() << 36
        words: Counter = Counter()
        for b in batches:
            rows = []
            for i, *rest in zip(*(c.to_pylist() for c in b.columns)):
                for title, url, text, titled in texts(*rest):
                    if text and text.strip() or titled and title:
                        got = read(text, title, url, titled)
                        words.update(letter_words(" ".join(got[-1])))
                        head = (title or "").strip().casefold()
                        rows.append((n, name, i, spell(title or "", site_name(url)), key(head or (text or "").strip()), *got))
                        n += 1
            yield _emit(rows)
            if len(words) > 200_000:
                yield counted(words)
        yield counted(words)

    return run


def _item_texts(url, title, text):
    yield title, url, text, False


def _prompt_texts(url, mode, messages):
    """The saved texts of a prompt; one made of the title alone carries a note of the project, which is no saved text."""
    for m in messages or []:
        content = (m or {}).get("content")
        if content and (m.get("role") or "") != "system":
            title, body = prompt_parts(content)
            yield title, url, None if mode == "title_only" else body, True


def features(items: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """One row per text with its lines and units; written once."""
    url = F.col("canonical_url") if "canonical_url" in items.columns else F.lit(None).cast("string")
    out = items.select("id", url.alias("url"), "title", "extracted_text").where("id is not null and extracted_text is not null").mapInArrow(_reader("saved_items", _item_texts), _FEATURES)
    if prompts is not None:
        mode = F.col("content_mode") if "content_mode" in prompts.columns else F.lit(None).cast("string")
        p = prompts.select("id", "canonical_url", mode.alias("mode"), "messages").where("id is not null").mapInArrow(_reader("groq_batch_3r", _prompt_texts), _FEATURES)
        # row numbers of the two tables never meet: prompts have negative ones
        out = out.unionByName(p.withColumn("rid", -1 - F.col("rid")))
    return cut(out)


def joined(left: DataFrame, right: DataFrame, total: int) -> DataFrame:
    """Inner join on ``u``; right: (u, n, ...). Units of at least total/HOT occurrences come by broadcast (at most HOT)."""
    often = F.col("n") >= max(1.0, total / HOT)
    value = [c for c in right.columns if c not in ("u", "n")]
    hot = right.where(often).select("u", F.lit(True).alias("_hot"), *value)
    both = left.join(F.broadcast(hot), "u", "left")
    rest = both.where("_hot is null").select(*left.columns).join(right.where(~often).select("u", *value), "u")
    return both.where("_hot").select(*left.columns, *value).unionByName(rest)


def _context(marks, recurs):
    """(whether another recurring line is beside, length of the run of titles that follows) of each line."""
    n = len(marks)
    out = []
    for j in range(n):
        k = j + 1
        while k < n and marks[k] & TITLE_LIKE and not recurs[k]:
            k += 1
        out.append(((j > 0 and recurs[j - 1]) or (j + 1 < n and recurs[j + 1]), k - j - 1))
    return out


def _lines_of(units_at, hit, n):
    """Whether each line consists of hit units only."""
    out, any_ = [True] * n, [False] * n
    for k, line in enumerate(units_at):
        if line >= 0:
            any_[line] = True
            if not hit[k]:
                out[line] = False
    return [a and b for a, b in zip(out, any_)]


_STATS = "u long, n long, beside long, before long, bare long, slot long"


def _stats(batches):
    """Per recurring unit its occurrences and their contexts; pre-added within a partition."""
    units: dict[int, list] = {}

    def drain():
        cols = list(zip(*((u, *v) for u, v in units.items()))) if units else [[]] * 6
        units.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "n", "beside", "before", "bare", "slot"])

    for b in batches:
        for marks, u, at, ks in zip(*(plain(b.column(c)) for c in ("marks", "u", "at", "ks"))):
            hit = [False] * len(u)
            for k in ks:
                hit[k] = True
            n = len(marks)
            recurs = [r and not m & MARKED for r, m in zip(_lines_of(at, hit, n), marks)]
            context = _context(marks, recurs)
            held = list(recurs)  # lines that recur, and titles that follow them
            for j in range(n):
                if recurs[j]:
                    for i in range(j + 1, j + 1 + context[j][1]):
                        held[i] = True
            bare = all(held)
            done = set()
            for k in ks:
                if u[k] in done:
                    continue
                done.add(u[k])
                line = at[k]
                v = units.get(u[k])
                if v is None:
                    v = units[u[k]] = [0, 0, 0, 0, 0]
                v[0] += 1
                if line < 0:
                    v[4] += 1
                elif recurs[line]:
                    beside, run = context[line]
                    v[1] += beside
                    v[2] += run > 0
                    v[3] += bare
        if len(units) > 200_000:
            yield drain()
    yield drain()


class Corpus:
    """The features of all texts and what recurs in them."""

    def __init__(self, items: DataFrame, prompts: DataFrame | None = None):
        read_ = features(items, prompts)
        f = self.features = read_.where("rid is not null")
        # what recurs: units with at least LEAST witnesses
        df = f.select("witness", F.explode(F.array_distinct("u")).alias("u")).distinct().groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
        recurring = cut(df)
        self.texts, total = f.agg(F.count("*"), F.coalesce(F.sum(F.size("u")), F.lit(0))).first()
        spots = f.select("rid", F.posexplode("u").alias("k", "u"))
        seen = joined(spots, recurring, total).groupBy("rid").agg(F.collect_list(F.struct("k", "u")).alias("hits"))
        seen = self.seen = cut(seen)
        stats = f.select("rid", "marks", "u", "at").join(seen.select("rid", F.col("hits.k").alias("ks")), "rid").drop("rid").mapInArrow(_stats, _STATS)
        units = stats.groupBy("u").agg(*(F.sum(c).alias(c) for c in ("n", "beside", "before", "bare", "slot")))
        words = read_.where("rid is null").groupBy(F.col("title").alias("word")).agg(F.sum("witness").alias("n")).where(F.col("n") >= max(float(LEAST), COMMON * self.texts))
        #: word -> share of the texts it stands in; at most (distinct words of a text) / COMMON of them
        self.common = {r["word"]: r["n"] / max(1, self.texts) for r in words.collect()}
        has = lambda c, share: F.col(c) >= share * F.col("n")
        slot = F.col("slot") > 0
        lead = ~slot & has("before", BEFORE)
        residue = ~slot & ~lead & has("bare", BARE)
        furniture = ~slot & (has("beside", BESIDE) | lead)
        bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
        flag = F.lit(RECURS) + bit(furniture, FURNITURE) + bit(lead, LEAD) + bit(residue, RESIDUE) + bit(slot, SLOT)
        self.units = cut(units.select("u", "n", flag.alias("flag")))
        # the spelling of those that are furniture or residue
        named = self.units.where(F.col("flag").bitwiseAND(FURNITURE | RESIDUE) > 0)
        pieces = f.select(F.explode(F.arrays_zip("u", "spelled")).alias("x")).select("x.u", "x.spelled")
        self.named = cut(joined(pieces, named, total).groupBy("u").agg(F.first("spelled").alias("spelled")).join(named, "u"))
        self.total = total

    def exemplars(self) -> list[tuple[str, int]]:
        """(spelling, texts) of all recurring residue, however rare: a text may hold a variant of any of it."""
        return [(x["spelled"], x["n"]) for x in self.named.where(F.col("flag").bitwiseAND(RESIDUE) > 0).select("spelled", "n").collect()]

    def flagged(self) -> DataFrame:
        """The features of all texts with ``ks`` and ``fs``: numbers and flags of the units that recur or begin one that is furniture."""
        spots = self.seen.select("rid", F.explode("hits").alias("h")).select("rid", F.col("h.k").alias("k"), F.col("h.u").alias("u"))
        flags = joined(spots, self.units.select("u", "n", "flag"), self.total).select("rid", "k", "flag")
        # the last unit of a text that was cut: the beginning of a unit of furniture
        begins = self.named.where(F.col("flag").bitwiseAND(FURNITURE) > 0).where("length(spelled) > 3")
        begins = begins.select(F.explode(F.expr("transform(sequence(3, length(spelled) - 1), i -> xxhash64(substring(spelled, 1, i)))")).alias("u")).distinct()
        lasts = self.features.select("rid", F.expr("size(filter(at, x -> x >= 0))").alias("n"), "u").where("n > 0").select("rid", (F.col("n") - 1).alias("k"), F.get("u", F.col("n") - 1).alias("u"))
        lasts = lasts.join(self.units.select("u"), "u", "left_anti").join(begins, "u").select("rid", "k", F.lit(FURNITURE | BEGUN).alias("flag"))
        v = flags.unionByName(lasts).groupBy("rid").agg(F.collect_list(F.struct("k", "flag")).alias("x")).select("rid", F.col("x.k").alias("ks"), F.col("x.flag").alias("fs"))
        return self.features.drop("u", "witness").join(v, "rid", "left")
