"""Evaluation texts leaking into training text, by winnowing.

A text is read as its words: runs of letters and digits, case ignored. Every k words in a row are hashed, and of the
hashes in each window of w neighbours the least is kept (the rightmost of equals). Two texts that share a run of
w + k - 1 words share a window, keep the same hash of it, and so meet in the join of the fingerprints: with
``run = w + k - 1`` no shared run of ``run`` words or more is missed. A hit is then extended to both sides over the
w - 1 words around it and counts if the run is long enough. Kept hashes of a run lie at most w words apart, so the
extended hits of a run touch, and together they are the whole passage, however long: passages() reports where it begins
in the text and in the item and how many words it has.

The whole text is scanned as one array of code points per Arrow batch; no word becomes a Python object. A fingerprint
carries the hashes of the words that an extension can need, so no text is shuffled. A Bloom filter over the evaluation
side's fingerprints (16 bits each up to MOST_BITS, combined on the executors) leaves out training fingerprints that
can't meet any: it bounds what is shuffled by the hits, and drops no hit. A fingerprint that more than HOT training
texts have is divided by the text's id among several tasks, each with a copy of the items that have it.

Edge cases: null and wordless texts, and texts with fewer words than the run, have no fingerprint and no case; texts
may be of any length; repeated texts and items each get their rows; an empty side gives no rows; extra columns of any
name are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordmill.session import Workspace

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of the largest filter (32 MiB). Two are set for a fingerprint.
MOST_BITS = 1 << 28
#: Rows of one fingerprint that one task joins.
HOT = 50_000

_LETTERS: dict[str, np.ndarray] = {}


def _alnum(points: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    if "basic" not in _LETTERS:
        _LETTERS["basic"] = np.array([chr(i).isalnum() for i in range(1 << 16)])
    table = _LETTERS["basic"]
    if points.max(initial=0) < 1 << 16:
        return table[points]
    far = points >= 1 << 16
    out = table[np.where(far, 0, points)]
    out[far] = [chr(i).isalnum() for i in points[far].tolist()]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the texts, in order."""
    whole = "\x00".join(texts)
    if whole.count("\x00") != len(texts) - 1:
        whole = "\x00".join(t.replace("\x00", " ") for t in texts)
    points = np.frombuffer(whole.casefold().encode("utf-32-le", "surrogatepass"), np.uint32)
    part = _alnum(points)
    edge = np.diff(part.astype(np.int8), prepend=0)
    starts = np.nonzero(edge == 1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = points[part].astype(np.uint64)
    ends = np.concatenate([np.nonzero(edge == -1)[0], [len(points)] if part[-1] else []]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    place = (np.arange(len(inside)) - np.repeat(at, ends - starts)).astype(np.uint64)
    hashes = _mix(np.add.reduceat(_mix(inside + (place << np.uint64(21)) + ODD), at))
    row = np.searchsorted(np.nonzero(points == 0)[0], starts)
    return hashes, row


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, over rows' ends too."""
    n = len(hashes)
    power = np.full(n + 1, ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:n], dtype=np.uint64)])
    return _mix((total[k:] - total[: n - k + 1]) * back[: n - k + 1])


def fingerprints(hashes: np.ndarray, row: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of the k-grams that winnowing keeps."""
    run = k + window - 1
    if len(hashes) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(hashes, k)
    m = len(h) - window + 1
    least, at = h[:m].copy(), np.arange(m)
    for j in range(1, window):
        other = h[j : j + m]
        better = other <= least
        np.copyto(least, other, where=better)
        np.copyto(at, np.arange(j, j + m), where=better)
    whole = row[:m] == row[run - 1 : run - 1 + m]
    keep = np.zeros(len(h), bool)
    keep[at[whole]] = True
    pos = np.nonzero(keep)[0]
    return pos, h[pos]


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _around(hashes: np.ndarray, row: np.ndarray, pos: np.ndarray, k: int, reach: int) -> pa.Array:
    """Per fingerprint the words from ``reach`` before its start to ``reach`` after its end; 0 beyond the text."""
    take = pos[:, None] + np.arange(-reach, k + reach)[None]
    ok = (take >= 0) & (take < len(hashes))
    take = np.clip(take, 0, max(len(hashes) - 1, 0))
    ok &= row[take] == row[pos][:, None]
    flat = np.where(ok, hashes[take], np.uint64(0)).ravel().view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32) * (k + 2 * reach)), pa.array(flat))


def _fingerprinter(k: int, window: int, bloom=None, most: int = 1 << 22):
    reach = window - 1  # a run through a kept k-gram that reaches the length does so within this many words

    def pieces(b):
        """Rows of a batch in turns of a few million characters, so memory follows neither batch nor text."""
        ids, texts, begin, size = b.column(0), b.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > most:
                yield ids.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, size = i + 1, 0
        if begin < len(texts):
            yield ids.slice(begin), texts[begin:]

    def run(batches):
        bits = np.frombuffer(bloom.value, np.uint64) if bloom is not None else None
        for b in batches:
            for ids, texts in pieces(b):
                hashes, row = words(texts)
                pos, h = fingerprints(hashes, row, k, window)
                if bits is not None and len(pos):
                    one, two = _slots(h, len(bits) * 64)
                    seen = np.ones(len(h), bool)
                    for s in (one, two):
                        seen &= (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1
                    pos, h = pos[seen], h[seen]
                begin = np.searchsorted(row, row[pos]) if len(pos) else pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), ids.take(pa.array(row[pos])), pa.array((pos - begin).astype(np.int64)), _around(hashes, row, pos, k, reach)], names=["fp", "id", "pos", "around"]
                )

    return run


def _bloom_bytes(items: DataFrame) -> bytes:
    """The filter, sized by the number of fingerprints: bits are combined on the executors."""
    bits, n = 1 << 20, items.count()
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2
    slots = items.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1)))).alias("slot"))
    packed = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    t = packed.toArrow()
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    return out.tobytes()


def _extend(k: int, window: int):
    """Joined fingerprints -> the equal words through them: (id, item, begin in the text, begin in the item, words)."""
    reach = window - 1

    def run(batches):
        for b in batches:
            width = k + 2 * reach
            a, c = (np.asarray(pa.concat_arrays([b.column(i)]).flatten()).reshape(-1, width) for i in (4, 5))
            same = (a == c) & (a != 0)
            ok = same[:, reach : reach + k].all(axis=1)
            left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, reach + k :], axis=1).sum(axis=1)
            at, to = (b.column(i).to_numpy() - left for i in (2, 3))
            took = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(took), b.column(1).filter(took), *(pa.array(x[ok].astype(np.int64)) for x in (at, to, left + k + right))], names=["id", "item", "at", "item_at", "words"])

    return run


def hits(documents: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, text: str, run: int, k: int, work: Workspace | None = None) -> DataFrame:
    """(id, item, at, item_at, words): a stretch of equal words per common fingerprint."""
    spark = documents.sparkSession
    work = work or Workspace(spark, "leaks")
    window = run - k + 1
    schema = "fp long, id long, pos long, around array<long>"
    side = lambda df, key: df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null and id is not null")
    test = work.put(side(items, item_id).mapInArrow(_fingerprinter(k, window), schema), "items")
    bloom = spark.sparkContext.broadcast(_bloom_bytes(test))
    train = work.put(side(documents, doc_id).mapInArrow(_fingerprinter(k, window, bloom), schema), "documents")
    test = test.select("fp", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("around").alias("around_item"))
    hot = work.put(train.groupBy("fp").agg(F.ceil(F.count("*") / HOT).cast("int").alias("shares")).where("shares > 1"), "hot")
    keys = ["fp"]
    if not hot.isEmpty():
        train = train.join(hot, "fp", "left").withColumn("share", F.pmod(F.xxhash64("id", "pos"), F.coalesce("shares", F.lit(1)))).drop("shares")
        test = test.join(hot, "fp", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shares", F.lit(1)).cast("bigint") - 1))).drop("shares")
        keys = ["fp", "share"]
    met = train.join(test, keys).select("id", "item", "pos", "item_pos", "around", "around_item")
    return met.mapInArrow(_extend(k, window), "id long, item long, at long, item_at long, words long")


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 12, k: int = 6) -> DataFrame:
    """(doc_id, item_id), distinct: the document and the item share a run of ``run`` or more consecutive words."""
    found = hits(documents, items, doc_id=doc_id, item_id=item_id, text=text, run=run, k=k).where(F.col("words") >= run).select("id", "item").distinct()
    return found.select(F.col("id").alias(doc_id), F.col("item").alias(item_id))


def passages(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 12, k: int = 6) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): every longest run of ``run`` or more words that a document and an
    item share, with the number (from 0) of its first word in both."""
    each = hits(documents, items, doc_id=doc_id, item_id=item_id, text=text, run=run, k=k).withColumn("shift", F.col("at") - F.col("item_at")).distinct()
    # stretches on one diagonal that overlap are parts of one run; two runs on it are at least a word apart
    w = Window.partitionBy("id", "item", "shift").orderBy("at", "words")
    before = F.max(F.col("at") + F.col("words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = each.withColumn("new", F.when(before >= F.col("at"), 0).otherwise(1)).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = part.groupBy("id", "item", "shift", "part").agg(F.min("at").alias("doc_word"), F.max(F.col("at") + F.col("words")).alias("end"))
    whole = whole.withColumn("n_words", F.col("end") - F.col("doc_word")).where(F.col("n_words") >= run)
    return whole.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "doc_word", (F.col("doc_word") - F.col("shift")).alias("item_word"), "n_words")
