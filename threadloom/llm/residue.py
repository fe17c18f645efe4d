"""Problem 5: template residue, filler, error pages and script demands.

Labelled exemplars stand in an inverted index: a small table given as parameter
(``SEEDS``: what protocols, frameworks and editors print by default) and what the
corpus itself shows to be residue (``recurrence``: units that recur in texts
without anything of their own; all of them, however rare). Every passage window -
a line or sentence that is no page furniture - retrieves the exemplars that share
one of its heavy words, and TF-IDF containment in both directions decides, with
the inverse document frequencies of the corpus. A slot window is residue if it
recurs with its slot masked, or if its slots are most of its weight. Filler prose
has no word that is common in the corpus and letter pairs that are contained in
the standard filler paragraph. A record is excluded if matched windows cover
most of its words, or all but one stray sentence after them.

Edge cases: null, empty and blank text is missing text, not residue; a null
title is ignored; the order of messages does not matter; rows delivered again
give one result; an empty table gives none; other columns are ignored; texts
are read whole. In a corpus too small to show what recurs, the seeds alone judge.
"""

from __future__ import annotations

import math
import re
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.recurrence import COMMON, FURNITURE, LEAD, MARKED, RECURS, RESIDUE, SLOT, SLOT_AT, Corpus, _context, _lines_of, plain, spell

# The standard filler paragraph.
LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)
# Default notices of frameworks, content systems and protection services.
SEEDS: list[tuple[str, str]] = [
    *(("error", s.phrase) for s in HTTPStatus if s >= 400),
    *(("error", s.description) for s in HTTPStatus if s >= 400 and s.description),
    ("error", "Page not found"),
    ("error", "The page you are looking for could not be found."),
    ("error", "Something went wrong. Please try again later."),
    ("script", "You need to enable JavaScript to run this app."),
    ("script", "Please enable JavaScript and cookies to continue."),
    ("script", "Please enable JavaScript to view the comments."),
    ("script", "JavaScript is disabled in your browser."),
    ("script", "Checking your browser before accessing the site."),
    ("script", "Please complete the security check to access the site."),
    ("script", "Verify you are human by completing the action below."),
    ("filler", "Lorem ipsum dolor sit amet"),
    ("filler", "This is your first post. Edit or delete it, then start writing!"),
    ("filler", "Insert your text here."),
    ("filler", "To do"),
]

CONTAINED = 0.75
COVERED = 0.75
#: share of a window's weight that its slots hold, if it is not seen to recur
SLOTS = 0.5
#: share of the letter pairs of a window that the filler paragraph has
PAIRS = 0.65

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d[\w:.]*|#|\*")
_SENT = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+")
# finds the same ends, faster: a search skips to the next full stop
_FIRST_END = re.compile(r"[.!?…][\"”’)\]]*\s")


def _pairs(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


_FILLER = frozenset(p for w in re.findall(r"[a-z]+", LOREM.casefold()) for p in _pairs(w))


class ExemplarIndex:
    """Inverted index over labelled exemplars; ``common`` gives the share of texts of the corpus' common words."""

    def __init__(self, exemplars: list[tuple[str, str]], common: dict[str, float]):
        self.common = common
        self.most = math.log(1 + 1 / COMMON)
        self.idf: dict[str, float] = {"#": 0.5, "*": 0.5}
        self.items: list[tuple[str, frozenset, float]] = []
        self.post: dict[str, list[int]] = {}
        self._seen: dict[str, str | None] = {}
        for label, text in exemplars:
            ws = frozenset(words_of(text))
            if ws - {"#", "*"}:
                for w in ws - {"#", "*"}:
                    self.post.setdefault(w, []).append(len(self.items))
                self.items.append((label, ws, sum(self.weight(w) for w in ws if w != "*")))
        self.heaviest = max((x[2] for x in self.items), default=0.0)
        # the weight beyond which no exemplar contains a window, with room for rounding
        self.beyond = (self.heaviest / CONTAINED + self.most) * (1 + 1e-9)

    def weight(self, word: str) -> float:
        got = self.idf.get(word)
        if got is None:
            share = self.common.get(word)
            got = self.idf[word] = math.log(1 + 1 / share) if share else self.most
        return got

    def match(self, window: str) -> str | None:
        """The label of the exemplar that contains the window and is contained in it."""
        if window in self._seen:
            return self._seen[window]
        got = self._match(window)
        if len(self._seen) > 200_000:
            self._seen.clear()
        self._seen[window] = got
        return got

    def _match(self, window: str) -> str | None:
        weights: dict[str, float] = {}
        total = 0.0
        # what an exemplar holds is at most its weight; one name may stand for a star: a heavier window is read no further
        for token in window.split():
            for w in (token,) if token.isalpha() else words_of(token):
                if w not in weights:
                    weights[w] = weight = self.idf.get(w) or self.weight(w)
                    total += weight
            if total > self.beyond:
                return None
        if (total - self.most) * CONTAINED > self.heaviest or self.post.keys().isdisjoint(weights):
            return None
        # to be contained, one of the heavy words beyond the free share must be the exemplar's
        near: set[int] = set()
        passed, free = 0.0, (1 - CONTAINED) * total + self.most
        for weight, w in sorted(((weight, w) for w, weight in weights.items()), reverse=True):
            if passed > free:
                break
            passed += weight
            near.update(self.post.get(w, ()))
        best, label = 0.0, None
        for i in sorted(near):
            lab, ex, weight = self.items[i]
            star = self.most if "*" in ex else 0.0
            # both hold at most the lighter one's weight (the exemplar's is without its star), with room for rounding
            if total < CONTAINED * weight - 1e-6 or weight + self.idf["*"] < CONTAINED * (total - star) - 1e-6:
                continue
            both = sum(weights[w] for w in weights.keys() & ex)
            s = min(both / max(1e-9, total - star), both / max(1e-9, weight), 1.0)
            if s > best:
                best, label = s, lab
        return label if best >= CONTAINED else None

    def filler(self, window: str) -> bool:
        """No word common in the corpus, and the letter pairs of the filler paragraph."""
        tokens = window.split()
        known = list(filter(str.isalpha, tokens))
        # in the other tokens, a word takes at least one character and one that parts it from the next
        others = (sum(map(len, tokens)) - sum(map(len, known)) + len(tokens) - len(known)) // 2
        if sum(map(self.common.__contains__, known)) > 0.2 * (len(known) + others):
            return False
        w = [x for x in words_of(window) if x.isalpha()]
        if len(w) < 4 or sum(x in self.common for x in w) > 0.2 * len(w):
            return False
        pairs = [p for x in w if x not in self.common for p in _pairs(x)]
        return bool(pairs) and sum(p in _FILLER for p in pairs) >= PAIRS * len(pairs)

    def slot(self, window: str) -> bool:
        """The slots of a window are most of its weight."""
        ws = words_of(window.replace(SLOT_AT, " "))
        slots = window.count(SLOT_AT) * self.most
        return slots >= SLOTS * (slots + sum(map(self.weight, set(ws))))


def words_of(line: str) -> list[str]:
    return _WORD.findall(line)


def _hits(n: int, flags: dict[int, int], bit: int) -> list[bool]:
    """Which of n units have a flag."""
    out = [False] * n
    for k, f in flags.items():
        if f & bit:
            out[k] = True
    return out


def judge(index: ExemplarIndex, title, marks, tags, words, at, chars, spelled, flags):
    """(label, share of text of each line) of one record; flags: {unit number: flag}.

    The share is what is left of a line without tags, furniture and links.
    """
    n = len(marks)
    recurs = [r and not m & MARKED for r, m in zip(_lines_of(at, _hits(len(at), flags, RECURS), n), marks)]
    furniture, lead, residue = (_hits(len(at), flags, bit) for bit in (FURNITURE, LEAD, RESIDUE))
    lines: list[list[int]] = [[] for _ in range(n)]
    for k, line in enumerate(at):
        if line >= 0:
            lines[line].append(k)
    heads = [len(ks) == 1 and title != "" and spelled[ks[0]] == title for ks in lines]
    # links: the titles under the heading of a sidebar
    link = [False] * n
    for j, (_, run) in enumerate(_context(marks, recurs)):
        if run and recurs[j] and any(lead[k] for k in lines[j]):
            longest = 0
            for i in range(j + 1, j + 1 + run):
                if heads[i] or i == n - 1 and i > j + 1 and words[i] > longest + 1:
                    break  # the title of the record, or a sentence cut short
                link[i] = True
                longest = max(longest, words[i])
    text = []
    for j in range(n):
        whole = sum(chars[k] for k in lines[j])
        if marks[j] & MARKED:
            text.append(1.0)
            continue
        own = 0 if link[j] else sum(chars[k] for k in lines[j] if not furniture[k])
        text.append(own / max(1, whole + TAG * tags[j]))
    if any(f & SLOT for f in flags.values()) or any(line < 0 and index.slot(spelled[k]) for k, line in enumerate(at)):
        return "slot", text
    return _covered(index, [(words[j], lines[j]) for j in range(n) if words[j] and not (link[j] or heads[j] or all(furniture[k] and not residue[k] for k in lines[j]))], spelled, residue), text


def _label(index: ExemplarIndex, ks: list[int], s: str, spelled, residue) -> str | None:
    """The label of one line if it is residue as a whole."""
    label = index.match(s)
    if label is None and all(residue[k] for k in ks):
        return "notice"
    if label is None and (end := _FIRST_END.search(s)) and index.match(s[: end.start() + 1]):
        for p in filter(None, _SENT.split(s)):
            got = index.match(p)
            if got is None:
                label = None
                break
            label = label or got
    if label is None and len(ks) > 1:
        label = next(filter(None, (index.match(spelled[k]) for k in ks)), None)
    if label is None and index.filler(s):
        return "filler"
    return label


def _covered(index: ExemplarIndex, windows: list[tuple[int, list[int]]], spelled, residue) -> str | None:
    """The label of a text whose windows are residue for the most part, or all but one stray sentence after the first.

    The longest window is judged first: once what is left uncovered rules out both, the rest need not be.
    """
    total = sum(n for n, _ in windows)
    got: dict[int, str | None] = {}
    uncovered = sentences = 0
    votes: dict[str, int] = {}
    for j in sorted(range(len(windows)), key=lambda j: (-windows[j][0], j)):
        n, ks = windows[j]
        s = " ".join(spelled[k] for k in ks)
        label = got[j] = _label(index, ks, s, spelled, residue)
        if label is None:
            uncovered += n
            # only whether it is more than one counts
            sentences += 1 if sentences or not _FIRST_END.search(s) else 2
            if uncovered > (1 - COVERED) * total and (sentences > 1 or j == 0):
                return None
        else:
            votes[label] = votes.get(label, 0) + n
    if votes and (total - uncovered >= COVERED * total or (got[0] is not None and sentences == 1)):
        return max(sorted(votes), key=votes.get)
    return None


#: characters that a tag counts as
TAG = 20


def _judge_all(index: ExemplarIndex, finish):
    names = ("title", "marks", "tags", "words", "at", "chars", "spelled", "ks", "fs")

    def run(batches):
        for b in batches:
            labels, texts = [], []
            for *row, ks, fs in zip(*(plain(b.column(c)) for c in names)):
                label, text = judge(index, *row, dict(zip(ks, fs)) if ks else {})
                labels.append(label)
                texts.append(finish(text))
            yield pa.RecordBatch.from_arrays(
                [b.column("table_name"), b.column("record_id"), b.column("no"), pa.array(texts, pa.list_(pa.float32())), pa.array(labels, pa.string())], names=["table_name", "record_id", "no", "text", "label"]
            )

    return run


def labelled(corpus: Corpus, seeds: list[tuple[str, str]] | None = None, finish=list) -> DataFrame:
    """(table_name, record_id, no, text, label): the lines of each text with their share of text (after ``finish``), and its label if it is residue."""
    seeds = [(label, spell(x)) for label, x in (SEEDS if seeds is None else seeds)]
    near = ExemplarIndex(seeds, corpus.common)
    found = sorted(corpus.exemplars())
    index = ExemplarIndex(seeds + [(near.match(x) or "notice", x) for x, _ in found], corpus.common)
    return corpus.flagged().mapInArrow(_judge_all(index, finish), "table_name string, record_id string, no array<int>, text array<float>, label string")


def residue(items: DataFrame, prompts: DataFrame) -> DataFrame:
    """(table_name, record_id, label) of the records to exclude."""
    found = labelled(Corpus(items, prompts)).where("label is not null")
    return found.groupBy("table_name", "record_id").agg(F.min("label").alias("label"))
