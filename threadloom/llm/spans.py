"""Problem 10: long exact spans shared between records.

Level-wise doubling over the lengths 50, 100 and 200 (for the default least
length). At 50 only windows chosen by their content are looked at: of every
stretch of 200 characters the 50-character window with the least hash, so two
copies of a stretch choose the same window. Windows repeated in another record
are extended to 100 characters to their left or right, repeated ones of those
to the runs of 200-character windows around them: first each run as one string
(up to 350 characters), then, where runs differ, what an eighth of the run has
in common, at last the single windows that are left. Touching and overlapping
windows are joined, which gives spans of every greater length.

Every level groups hashes with partial aggregates (least and greatest record),
so a passage in a third of all records stays a few rows per task; nothing is
paired. Rows of the last levels are equal in two hashes of 64 bits, the gram's
and the window's.

Edge cases: null, empty and shorter texts share nothing; repeated text inside
one record alone is not shared; rows delivered again (same id) count once;
positions are code points; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut, release

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64
#: characters that are hashed at a time; a longer text is a block of its own
_BLOCK = 1 << 18
_cache: dict = {}


def _powers(n: int):
    if len(_cache.get("p", ())) < n + 1:
        m = max(n + 1, _BLOCK + 1)
        for name, b in (("p", _BASE), ("i", _INV)):
            a = np.full(m, _U(b))
            a[0] = 1
            _cache[name] = np.cumprod(a)
    return _cache["p"], _cache["i"]


def _mix(x):
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _sliding(x, w: int, op, pad):
    """op over every window of w values (blocks of w, forward and backward)."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    y = np.concatenate([x, np.full((-len(x)) % w, pad, x.dtype)]).reshape(-1, w)
    f = op.accumulate(y, axis=1).ravel()
    b = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(b[:m], f[w - 1 : w - 1 + m])


class Block:
    """Hashes of the concatenated texts of some records."""

    def __init__(self, texts: list[str], length: int, gram: int):
        arrays = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.sizes = np.array([len(a) for a in arrays])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        codes = np.concatenate(arrays).astype(np.uint64)
        self.n = n = len(codes)
        self.length, self.gram = length, gram
        self.p, self.i = _powers(n)
        values = _mix(codes * _U(0xD6E8FEB86659FD93) + _U(0x632BE59BD9B4E019))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.p[:n])])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.end = np.repeat(self.starts + self.sizes, self.sizes)

    def hashes(self, k: int):
        m = self.n - k + 1
        return _mix((self.prefix[k:] - self.prefix[:m]) * self.i[:m]) if m > 0 else np.zeros(0, np.uint64)

    def hash_at(self, pos, k: int):
        return _mix((self.prefix[pos + k] - self.prefix[pos]) * self.i[pos])

    def choose(self):
        """Positions of the chosen grams, the gram hashes, the least hash per stretch, and which stretches lie in one record."""
        h = self.hashes(self.gram)
        top = _U(0xFFFFFFFFFFFFFFFF)
        w = self.length - self.gram + 1
        least = _sliding(h, w, np.minimum, top)
        m = len(least)
        ok = np.arange(m) + self.length <= self.end[:m]
        seen = np.where(ok, least, _U(0))
        # a gram is chosen if it is the least of some stretch that holds it
        padded = np.concatenate([np.zeros(w - 1, np.uint64), seen, np.zeros(w - 1, np.uint64)])
        most = _sliding(padded, w, np.maximum, _U(0))[: len(h)]
        pos = np.flatnonzero((most == h) & (h > 0))
        return pos, h, least, ok


def _blocks(ids: list, texts: list, length: int, extra: list | None = None):
    """Records of sufficient length in blocks of about _BLOCK characters."""
    part, size = [], 0
    for n, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        if part and size + len(t) > _BLOCK:
            yield part
            part, size = [], 0
        part.append(n)
        size += len(t)
    if part:
        yield part


def _anchors(length: int, gram: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for part in _blocks(ids, texts, length):
                blk = Block([texts[n] for n in part], length, gram)
                pos, h, _, _ = blk.choose()
                d = blk.doc[pos]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[pos].view(np.int64)), pa.array(ids[part][d]), pa.array((pos - blk.starts[d]).astype(np.int32))],
                    names=["h", "doc_id", "pos"],
                )

    return run


def _runs(length: int, gram: int):
    """Runs of stretches around the surviving grams, with the hashes of the doubled gram and the run's text."""

    def run(batches):
        for b in batches:
            ids, texts, marks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist()
            for part in _blocks(ids, texts, length):
                blk = Block([texts[n] for n in part], length, gram)
                pos, h, least, ok = blk.choose()
                if not len(pos):
                    continue
                alive = np.zeros(blk.n + 1, bool)
                for j, n in enumerate(part):
                    alive[blk.starts[j] + np.asarray(marks[n], np.int64)] = True
                win = np.flatnonzero(ok)
                at = np.searchsorted(pos, win)
                while len(bad := np.flatnonzero(h[pos[at]] != least[win])):
                    at[bad] += 1
                p = pos[at]
                keep = alive[p]
                win, p = win[keep], p[keep]
                if not len(win):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (win[1:] != win[:-1] + 1)]))
                last = np.concatenate([new[1:], [len(win)]]) - 1
                a, z, g = win[new], win[last], p[new]
                d = blk.doc[g]
                s, e = blk.starts[d], blk.starts[d] + blk.sizes[d]
                two = 2 * gram
                has_l, has_r = g + gram - two >= s, g + two <= e
                hl = np.where(has_l, blk.hash_at(np.where(has_l, g + gram - two, 0), two), _U(0))
                hr = np.where(has_r, blk.hash_at(np.where(has_r, g, 0), two), _U(0))
                ctx = [texts[part[x]][i:j] for x, i, j in zip(d, a - s, z - s + length)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[g].view(np.int64)),
                        pa.array(ids[part][d]),
                        pa.array((a - s).astype(np.int32)),
                        pa.array((z - a + 1).astype(np.int32)),
                        pa.array((g - a).astype(np.int32)),
                        pa.array(hl.view(np.int64), mask=~has_l),
                        pa.array(hr.view(np.int64), mask=~has_r),
                        pa.array(ctx, pa.string()),
                    ],
                    names=["h", "doc_id", "first", "n", "off", "hl", "hr", "ctx"],
                )

    return run


def _repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur in at least two records; partial aggregates before the shuffle."""
    return df.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")


#: bits of the filter that keeps texts without a repeated gram out of the shuffle (1 MB, whatever the input)
_BITS = 1 << 23


def _with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs joined with marks; a bit map of fixed size drops most other texts before the shuffle."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_BITS))
    maps = marks.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(bit) div 8 as int) + 1, 1)")), 16, 10)
    kept = docs.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(maps), "bucket")
    kept = kept.withColumn("byte", byte.cast("int")).where(F.expr("shiftright(byte, cast(bitmap_bit_position(bit) % 8 as int)) & 1 = 1"))
    return kept.select("doc_id", "text").join(marks, "doc_id").select("doc_id", "text", "marks")


def shared_windows(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, span_start, span_end) of stretches that occur in another record; they may overlap."""
    gram = length // 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= length)
    # level 1: grams chosen by content, repeated in another record
    grams = cut(docs.mapInArrow(_anchors(length, gram), "h long, doc_id long, pos int"))
    alive = grams.join(_repeated(grams, "h").select("h"), "h", "left_semi")
    marks = cut(alive.groupBy("doc_id").agg(F.collect_set("pos").alias("marks")))
    release(grams)
    # level 2: twice the length, to the left or to the right
    runs = _with_marks(docs, marks).mapInArrow(_runs(length, gram), "h long, doc_id long, first int, n int, off int, hl long, hr long, ctx string")
    runs = cut(runs.withColumns({"rid": F.monotonically_increasing_id(), "k": F.xxhash64("ctx")}))
    sides = runs.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("hl").alias("w")), F.struct(F.lit(1).alias("side"), F.col("hr").alias("w")))).alias("s")).select("doc_id", "s.side", "s.w").where("w is not null")
    double = cut(_repeated(sides, "side", "w").select("side", "w"))
    slim = runs.select("rid", "h", "k", "doc_id", "first", "n", "hl", "hr")
    slim = slim.join(double.where("side = 0").select(F.col("w").alias("hl"), F.lit(True).alias("l")), "hl", "left")
    slim = slim.join(double.where("side = 1").select(F.col("w").alias("hr"), F.lit(True).alias("r")), "hr", "left").where("l or r")
    slim = slim.select("rid", "h", "k", "doc_id", "first", "n")
    # level 4: all stretches of a run at once
    same = slim.groupBy("h", "k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    far = cut(slim.join(same, ["h", "k"]))
    whole = far.where("lo < hi").select("doc_id", F.col("first").alias("span_start"), (F.col("first") + F.col("n") - 1 + length).alias("span_end"))
    # the runs that differ, beside two records of each whole run with their gram
    open_h = far.where("lo = hi").select("h").distinct()
    rest = far.where("lo = hi or doc_id = lo or doc_id = hi").join(open_h, "h", "left_semi").select("rid", (F.col("lo") == F.col("hi")).alias("open"))
    rest = cut(runs.select("rid", "h", "doc_id", "first", "n", "off", "ctx").join(rest, "rid"))
    # level 3: what all stretches of an eighth of the run have in common
    step = max(1, -(-(length - gram + 1) // 8))
    part = rest.select("rid", "h", "doc_id", "first", "n", "off", "open", "ctx", F.explode(F.expr(f"sequence((off - n + 1) div {step}, off div {step})")).alias("part"))
    # stretches with offsets part * step .. part * step + step - 1 before the gram share this text
    part = part.withColumn("core", F.xxhash64("part", F.expr(f"substring(ctx, off - part * {step} + 1, {length} - {step} + 1)")))
    part = part.join(_repeated(part, "h", "core").select("h", "core"), ["h", "core"], "left_semi")
    lo, hi = F.greatest(F.col("off") - (F.col("part") + 1) * step + 1, F.lit(0)), F.least(F.col("off") - F.col("part") * step, F.col("n") - 1)
    single = part.select("h", "doc_id", "open", "first", "ctx", F.explode(F.sequence(lo, hi)).alias("i"))
    single = single.select("h", "doc_id", (F.col("first") + F.col("i")).alias("at"), "open", F.xxhash64(F.expr(f"substring(ctx, i + 1, {length})")).alias("k"))
    single = cut(single)
    apart = single.where("open").join(_repeated(single, "h", "k").select("h", "k"), ["h", "k"], "left_semi")
    return whole.unionByName(apart.select("doc_id", F.col("at").alias("span_start"), (F.col("at") + length).alias("span_end")))


def merged(spans: DataFrame) -> DataFrame:
    """Longest runs of spans that overlap or touch."""
    w = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    before = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = spans.withColumn("_new", F.when(before >= F.col("span_start"), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "_g").agg(F.min("span_start").cast("long").alias("span_start"), F.max("span_end").cast("long").alias("span_end")).drop("_g")


def shared_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, span_start, span_end): each longest run of characters shared with another record."""
    return merged(shared_windows(docs, length))


def shared_share(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per record: its characters, how many are shared elsewhere, and their share (0 for an empty text)."""
    per = shared_spans(docs, length).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars"))
    return base.join(per, "doc_id", "left").select(
        "doc_id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.when(F.col("chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("chars")).otherwise(F.lit(0.0)).alias("share"),
    )
