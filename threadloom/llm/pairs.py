"""Problem 2: broken prompt and response pairs.

One pass over the joined pairs labels what the pair alone shows: nothing usable
(empty_answer), an answer that stops inside its map (truncated_answer), large
verbatim parts of the prompt (copied_question), another language than the saved
text or its title (other_language). Refusals come from templates, and from nothing
else: the openings of the answers that name nothing of their own are cut into
five-word shingles, MinHash bands bring like ones together, each member is verified
against its bucket's exemplar (Jaccard of at least 0.8), and all links make connected
components. What a component holds counts once per unrelated prompt (prompts of
different saved pages): a component over at least ``RECURS`` of them is a template, and
so is a run of shingles that recurs over as many of them inside components that
begin or end differently. An answer of which templates are at least ``COVERED`` of the
words declines. No phrase is listed.

A bucket is never paired out: members meet only its exemplar, and equal
openings are one row before they are bucketed, so a template used by a third of
all answers stays one row.

Edge cases: an answer without its prompt is judged alone; null columns count as
missing; a blank answer with a filled parsed map is sound; rows delivered again
give one result; no pair has two defects (empty, truncated, copied, refusal,
other language, in this order); empty tables give no rows; other columns are
ignored; answers and prompts are read whole (an opening is the first
``OPENING_WORDS`` words by definition). A refusal worded as no other is only
found once it recurs.
"""

from __future__ import annotations

import itertools
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.recurrence import key, prompt_parts
from threadloom.llm.truncation import answer_cut, answer_text
from threadloom.operators.graph import components
from threadloom.session import cut

SHINGLE, SIMILAR = 5, 0.8
PERMUTATIONS, BANDS = 40, 10
OPENING_WORDS = 24
#: unrelated prompts over which a template recurs
RECURS = 3
#: share of an answer's words that templates must hold
COVERED = 0.5

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")

# Frequent function words by language.
LANGUAGE_WORDS = {
    "en": "the or and that this with for are was not have from they you but has were their been our my of to in is it on one another an because instead without despite after before behind beside inside near next along thanks top if when how what who anyone some here people which while into",
    "de": "der die das und ist nicht ein eine mit auf für sich dem den des von zu im auch als es an wird sind neben trotz während hinter statt dank ohne fast immer wieder gestern endlich langsam vorsichtig",
    "fr": "le la de les des et est une un pour dans que qui sur pas plus par avec ce cette au aux du en malgré derrière sous sans après près avant toujours encore souvent presque enfin lentement",
    "es": "el la de los las del una un para por con que es se su al lo como más y en junto antes encima cerca gracias lugar siempre casi ayer despacio prisa vez fin",
    "pt": "o os as de da do das dos uma um para por com que não é se ao e em no na apesar depois sobre antes sem devagar sempre quase ontem enfim outra vez pressa cuidado",
}
_LANG: dict[str, list[str]] = {}
for _k, _v in LANGUAGE_WORDS.items():
    for _w in _v.split():
        _LANG.setdefault(_w, []).append(_k)
# Letters that tell a language.
_MARKERS = {"ã": "pt", "õ": "pt", "ñ": "es", "¿": "es", "ó ": "es", "ß": "de", "ä": "de", "ü": "de", "œ": "fr", "è": "fr", "ê": "fr", "ù": "fr"}


def language(text: str, least: int = 4) -> str | None:
    """The language of a text by its function words; None if it cannot be told."""
    n = 0
    score = dict.fromkeys(LANGUAGE_WORDS, 0.0)
    for m in _WORD.finditer(text):
        n += 1
        ls = _LANG.get(m[0].casefold())
        if ls:
            for x in ls:
                score[x] += 1.0 / len(ls)
    if n < least:
        return None
    for c, x in _MARKERS.items():
        score[x] += 0.5 * min(4, text.count(c))
    best, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    if best[1] < max(1.0, 0.08 * n) or best[1] < 1.15 * second[1]:
        return None
    return best[0]


def find_map(text: str) -> tuple[dict | list | None, bool]:
    """The JSON value in an answer, with whatever stands around it, and whether the answer has one."""
    at = text.find("{")
    if at < 0:
        try:
            v = json.loads(text.strip().strip("`").removeprefix("json").strip())
            return (v, True) if isinstance(v, (list, dict)) else (None, v is None or v == "")
        except (ValueError, RecursionError):
            return None, False
    try:
        return json.JSONDecoder(strict=False).raw_decode(text[at:])[0], True
    except (ValueError, RecursionError):
        return None, False


_BLANKS = frozenset(("", "-", "n/a", "none", "null", "untitled", "saved item", "nan", "unknown", "—"))


def _filled(v) -> bool:
    return isinstance(v, str) and v.strip().casefold() not in _BLANKS


def map_prose(m) -> list[str]:
    """The sentences a map holds: why it was saved and its insights."""
    out = []
    if isinstance(m, dict):
        root = m.get("root") if isinstance(m.get("root"), dict) else m
        for k in ("why_saved", "whysaved"):
            if isinstance(root.get(k), str):
                out.append(root[k])
        ins = m.get("micro_insights") or m.get("microinsights") or []
        for i in ins if isinstance(ins, list) else []:
            t = i.get("text") if isinstance(i, dict) else i
            if isinstance(t, str):
                out.append(t)
    return [x for x in out if x.strip()]


def map_empty(m) -> bool:
    """Whether a map holds nothing: no sentence, no named entry."""
    if not isinstance(m, dict):
        return not m
    if any(_filled(x) for x in map_prose(m)):
        return False
    for k in ("domains", "themes", "concepts", "micro_insights"):
        v = m.get(k)
        for e in v if isinstance(v, list) else []:
            if _filled(e.get("name") or e.get("text")) if isinstance(e, dict) else _filled(e):
                return False
    return True


def strings_of(v) -> list[str]:
    if isinstance(v, str):
        return [v]
    if isinstance(v, dict):
        return [s for x in v.values() for s in strings_of(x)]
    if isinstance(v, list):
        return [s for x in v for s in strings_of(x)]
    return []


def copied(answer: str, prompt: str, gram: int = 8) -> float:
    """Share of the answer's words that lie in runs of at least ``gram`` words of the prompt."""
    a = [w.casefold() for w in _WORD.findall(answer)]
    p = [w.casefold() for w in _WORD.findall(prompt)]
    if len(a) < gram:
        return 1.0 if a and " ".join(a) in " ".join(p) and len(a) >= 5 else 0.0
    grams = {tuple(p[i : i + gram]) for i in range(len(p) - gram + 1)}
    hit = bytearray(len(a))
    for i in range(len(a) - gram + 1):
        if tuple(a[i : i + gram]) in grams:
            hit[i : i + gram] = b"\x01" * gram
    return sum(hit) / len(a)


def saved_languages(title: str, body: str) -> set[str]:
    """The languages of a saved text's lines of prose and of its title, as far as they can be told."""
    prose = "\n".join(x for x in body.split("\n") if len(_WORD.findall(x)) >= 8)
    return {x for x in (language(prose), language(title, 3)) if x}


def opening_of(plain: str) -> str:
    """The first words of an answer's prose."""
    return " ".join(m[0].casefold() for m in itertools.islice(_WORD.finditer(plain), OPENING_WORDS))


def judge(text: str | None, parsed: str | None, messages, mode: str | None = None) -> tuple[str | None, str, bool]:
    """(defect, prose of the answer, whether it names something of its own) of one pair."""
    s = (text or "").strip().strip("\u200b\ufeff").strip()
    if not s:
        try:
            p = json.loads(parsed) if parsed else None
        except ValueError:
            p = None
        if p is None or map_empty(p):
            return "empty_answer", "", False
        m, has = p, True
    else:
        m, has = find_map(s)
    if has:
        if m is None or map_empty(m):
            return "empty_answer", "", False
        plain = "\n".join(map_prose(m))
    else:
        if answer_cut(s):
            return "truncated_answer", "", False
        plain = re.sub(r"^```\w*|```$", "", s).strip()
        if plain.strip("\"'`[](){}.-—– \n").casefold() in _BLANKS:
            return "empty_answer", "", False
    own = has and not _bare(m)
    everything = "\n".join((x or {}).get("content") or "" for x in messages or [])
    if everything:
        share = copied(plain if not has else " ".join(strings_of(m)) if len(plain) < 40 else plain, everything)
        words = len(_WORD.findall(plain))
        if has and share >= 0.8 and words >= 5 and not own:
            return "copied_question", plain, own
        if has and share >= 0.55 and words >= 8 or not has and share >= 0.5:
            # one quoted sentence is sound: a copy goes on beyond it
            if not has or words >= 60 or len(map_prose(m)) == 1 and words >= 30:
                return "copied_question", plain, own
            if share >= 0.55 and _long_copy(map_prose(m), everything):
                return "copied_question", plain, own
        user = next(((x or {}).get("content") or "" for x in reversed(messages or []) if (x or {}).get("role") != "system"), "")
        title, body = prompt_parts(user)
        la = language(plain)
        saved = saved_languages(title, "" if mode == "title_only" else body)
        if la and saved and la not in saved:
            return "other_language", plain, own
    return None, plain, own


def _bare(m) -> bool:
    """Whether a map names nothing of its own."""
    return isinstance(m, dict) and not any(m.get(k) for k in ("domains", "themes", "concepts"))


def _long_copy(prose: list[str], prompt: str) -> bool:
    """Whether one string of the map alone holds several sentences of the prompt."""
    for x in prose:
        if len(re.split(r"(?<=[.!?])[\"”’)]*\s", x)) >= 3 and copied(x, prompt) >= 0.6:
            return True
    return False


# ---- Spark -----------------------------------------------------------------


def _about(messages) -> int | None:
    """What a prompt is about: its saved page by title, else by text."""
    user = next(((x or {}).get("content") or "" for x in reversed(messages or []) if (x or {}).get("role") != "system"), "")
    title, body = prompt_parts(user)
    return key(title.strip().casefold() or body.strip()) if user else None


_JUDGED = "output_id string, defect string, opening string, words int, about long"


def _judge_all(batches):
    for b in batches:
        rows = []
        for i, text, parsed, messages, mode in zip(*(c.to_pylist() for c in b.columns)):
            defect, plain, own = judge(text, parsed, messages, mode)
            # an answer that names something of its own declines nothing, whatever its opening
            open_ = defect in (None, "other_language") and plain and not own
            rows.append((i, defect, (opening_of(plain) or None) if open_ else None, len(_WORD.findall(plain)), _about(messages)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["output_id", "defect", "opening", "words", "about"])


_SEEDS = [xxhash.xxh64_intdigest(str(i)) | 1 for i in range(PERMUTATIONS)]
_TOP = (1 << 64) - 1


def shingles(opening: str) -> set[int]:
    w = opening.split()
    if len(w) < SHINGLE:
        return {xxhash.xxh64_intdigest(opening)} if w else set()
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE])) for i in range(len(w) - SHINGLE + 1)}


def _bands(batches):
    for b in batches:
        keys, openings = [], []
        for o in b.column(0).to_pylist():
            sh = shingles(o)
            if not sh:
                continue
            mins = [min((h * s & _TOP) >> 8 for h in sh) for s in _SEEDS]
            r = PERMUTATIONS // BANDS
            for k in range(BANDS):
                keys.append(xxhash.xxh64_intdigest(repr((k, mins[k * r : (k + 1) * r]))) - (1 << 63))
                openings.append(o)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(openings, pa.string())], names=["band", "opening"])


def templates(openings: DataFrame, least_prompts: int = 3) -> DataFrame:
    """(opening, exemplar, prompts): openings linked to an exemplar, and over how many prompts they recur.

    Prompts with the same saved text (``about``, if there is that column) are one prompt.
    """
    about = "about" in openings.columns
    once = openings.select("opening").distinct()
    bands = cut(once.mapInArrow(_bands, "band long, opening string"))
    heads = bands.groupBy("band").agg(F.min("opening").alias("exemplar"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = bands.join(heads, "band").where("opening <> exemplar").select("opening", "exemplar").distinct()

    def words(c):
        w = F.split(c, " ")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " ")))

    a, b = words(F.col("opening")), words(F.col("exemplar"))
    both = F.size(F.array_intersect(a, b))
    like = both / (F.size(a) + F.size(b) - both)
    links = cut(pairs.where(like >= SIMILAR))
    nodes = links.select(F.col("opening").alias("id")).union(links.select("exemplar")).distinct()
    found = components(nodes, links.toDF("a", "b")).select(F.col("id").alias("opening"), F.col("component").alias("exemplar"))
    named = openings.join(found, "opening", "left").withColumn("exemplar", F.coalesce("exemplar", "opening"))
    n = named.groupBy("exemplar").agg((F.count_distinct("about") if about else F.count("*")).alias("prompts")).where(F.col("prompts") >= least_prompts)
    return named.select("opening", "exemplar").distinct().join(n, "exemplar").select("opening", "exemplar", "prompts")


def covered(openings: DataFrame) -> DataFrame:
    """(opening, held): how many words of an opening are held by templates; openings: (opening, about)."""
    named = templates(openings, 0)
    size = F.size(F.split("opening", " "))
    whole = named.where(F.col("prompts") >= RECURS).select("opening", size.alias("held"))
    # shingles over components: how many unrelated prompts have them
    w = F.split("opening", " ")
    cutting = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice(w, i + 1, SHINGLE), " ")).alias("shingle")))
    spots = openings.select("opening").distinct().select("opening", F.explode(cutting).alias("s")).select("opening", "s.at", "s.shingle")
    spots = cut(spots)
    per = openings.distinct().join(spots, "opening").select("shingle", "about").distinct().groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS)
    inside = spots.join(per, "shingle").groupBy("opening").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + SHINGLE - 1))))).alias("held"))
    return whole.unionByName(inside.select("opening", F.least("held", size).alias("held"))).groupBy("opening").agg(F.max("held").alias("held"))


def defects(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(output_id, defect): one row for each defective pair."""
    o = outputs.where("id is not null").select("id", answer_text().alias("text"), "parsed")
    o = o.select("id", "text", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.to_json("parsed")).alias("parsed"))
    mode = F.col("content_mode") if "content_mode" in prompts.columns else F.lit(None).cast("string")
    p = prompts.where("id is not null").select("id", "messages", mode.alias("mode"))
    judged = cut(o.join(p, "id", "left").mapInArrow(_judge_all, _JUDGED))
    one = judged.groupBy("output_id").agg(F.max(F.struct(F.col("opening").isNotNull().alias("open"), "defect", "opening", "words", "about")).alias("x")).select("output_id", "x.*")
    open_ = cut(one.where("open").select("output_id", "words", "about", "opening"))
    held = covered(open_.select("opening", "about"))
    refused = open_.join(held, "opening").where(F.col("held") >= COVERED * F.col("words")).select("output_id", F.lit(True).alias("t"))
    found = one.join(refused, "output_id", "left")
    return found.select("output_id", F.when(F.col("t"), "refusal").otherwise(F.col("defect")).alias("defect")).where("defect is not null")
