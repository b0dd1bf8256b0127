"""Filling contexts of fixed capacity with texts of varying length.

1. Texts are measured in tokens of a public byte-level BPE vocabulary. Pre-tokens are found for a whole batch at once
   from character classes, hashed, and counted through a table of known pre-tokens, so the encoder sees each distinct
   pre-token once per task and whole texts are never turned into token lists.
2. Each text is a vector (tokens, segments, loss-bearing tokens; tokens of quoted lines bear no loss). A text that is
   above a limit is cut into pieces that each go up to the first limit they reach, and a rest; no other text is cut. A
   piece names its first token, so tokens start to start + tokens of the encoded text are its content.
3. Vector bin packing by the dot-product heuristic: an open context takes, of all that still fits in every dimension,
   the piece whose vector has the greatest dot product with what is left. Each task packs its own pieces; contexts
   that are less than ``full`` filled are opened again and packed together in a second round with fewer tasks, so the
   space lost to the borders between tasks is that of a few contexts.

Edge cases: null and empty texts have 0 tokens and no context; a text of exactly the capacity is one piece; ties go
to the class that comes first by size; repeated texts are each placed; an empty table gives no rows; extra columns of
any name are ignored. No piece is lost and none is placed twice.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordmill.session import Workspace

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space as regular expressions have it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: The pattern by which byte-level BPE vocabularies of this kind cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_KEPT: dict = {}


def _class_of(i: int) -> int:
    c = unicodedata.category(chr(i))[0]
    return LETTER if c == "L" else NUMBER if c == "N" else SPACE if chr(i) in WHITE and not 0x1C <= i <= 0x1F else OTHER


def classes(points: np.ndarray) -> np.ndarray:
    if "class" not in _KEPT:
        _KEPT["class"] = np.array([_class_of(i) for i in range(1 << 16)], np.uint8)
    table = _KEPT["class"]
    if points.max(initial=0) < 1 << 16:
        return table[points]
    far = points >= 1 << 16
    out = table[np.where(far, 0, points)]
    out[far] = [_class_of(i) for i in points[far].tolist()]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pretoken_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie one after the other."""
    n = len(points)
    kind = classes(points)
    first = np.zeros(n, bool)
    first[text_starts[text_starts < n]] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    last_of_run = np.append(run[1:], True)
    ends_text = np.append(first[1:], True)
    # the last space of a run goes with what follows it in the text; any other last white space stands alone
    lone = (kind == SPACE) & last_of_run & ~ends_text
    start = run.copy()
    start[lone] = True
    joined = lone & (points == 32)
    after = np.nonzero(joined)[0] + 1
    start[after] = False
    # contractions: an apostrophe that is a pre-token of its own, before letters that begin with an ending
    mark = np.nonzero((points == 39) & start & last_of_run & ~ends_text)[0]
    if len(mark):
        mark = mark[kind[mark + 1] == LETTER]
        for m in mark.tolist():
            tail = "".join(map(chr, points[m + 1 : m + 3].tolist()))
            for e in ENDINGS:
                if tail.startswith(e) and (len(e) == 1 or not first[m + 2 : m + 3].any()):
                    start[m + 1] = False
                    if m + 1 + len(e) < n:
                        start[m + 1 + len(e)] = True
                    break
    return np.nonzero(start)[0]


class Counter:
    """Token counts of pre-tokens, each encoded once."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def measure(self, texts: list[str], quote: str = ">") -> tuple[np.ndarray, np.ndarray, list]:
        """(tokens, loss-bearing tokens) of each text, and per text the counts of its pre-tokens on demand."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        n = len(texts)
        if not len(points):
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        starts = pretoken_starts(points, bounds[:-1])
        ends = np.append(starts[1:], len(points))
        place = (np.arange(len(points)) - np.repeat(starts, ends - starts)).astype(np.uint64)
        hashes = _mix(np.add.reduceat(_mix(points.astype(np.uint64) + (place << np.uint64(21)) + np.uint64(0x9E3779B97F4A7C15)), starts))
        counts = self._look_up(hashes, starts, ends, whole)
        line = points == 10
        begin = np.zeros(len(points), bool)
        begin[bounds[:-1][lengths > 0]] = True
        begin[1:] |= line[:-1]
        since = np.maximum.accumulate(np.where(begin, np.arange(len(points)), 0))
        bears = points[since[starts]] != ord(quote)
        cut = np.searchsorted(starts, bounds)
        total = np.concatenate([[0], np.cumsum(counts)])
        loss = np.concatenate([[0], np.cumsum(np.where(bears, counts, 0))])
        return total[cut[1:]] - total[cut[:-1]], loss[cut[1:]] - loss[cut[:-1]], cut, counts, bears

    def _look_up(self, hashes, starts, ends, whole):
        known = len(self.hashes)
        at = np.searchsorted(self.hashes, hashes)
        hit = (self.hashes[np.minimum(at, known - 1)] == hashes) if known else np.zeros(len(hashes), bool)
        if not hit.all():
            new, where = np.unique(hashes[~hit], return_index=True)
            src = np.nonzero(~hit)[0][where]
            made = np.array([len(self.encoding.encode_ordinary(whole[a:b])) for a, b in zip(starts[src].tolist(), ends[src].tolist())], np.int64)
            merged = np.concatenate([self.hashes, new])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.counts = merged[order], np.concatenate([self.counts, made])[order]
            at = np.searchsorted(self.hashes, hashes)
        return self.counts[at]


def cuts(tokens: np.ndarray, loss: np.ndarray, capacity: int, loss_capacity: int) -> np.ndarray:
    """First tokens of the pieces of a text, given for each pre-token how many tokens it has and whether they bear
    loss. A piece ends where it is full in one dimension."""
    each = np.repeat(loss, tokens)
    borne = np.concatenate([[0], np.cumsum(each)])
    starts = [0]
    while True:
        # the last token that keeps the piece within both limits; a limit on loss below one token can't hold any
        end = min(starts[-1] + capacity, int(np.searchsorted(borne, borne[starts[-1]] + max(1, loss_capacity), "right")) - 1)
        if end >= len(each):
            return np.array(starts)
        starts.append(end)


def _measurer(path: str, capacity: int, loss_capacity: int, most: int = 1 << 21):
    """(doc_id, text) -> (doc_id, piece, start, tokens, loss): pieces within the limits."""

    def run(batches):
        counter = Counter(path)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            begin, size = 0, 0
            for i in range(len(texts) + 1):
                if i < len(texts):
                    size += len(texts[i])
                if i == len(texts) or size > most:
                    part, own = texts[begin : i + 1], ids[begin : i + 1]
                    begin, size = i + 1, 0
                    if not part:
                        continue
                    tokens, loss, cut, counts, bears = counter.measure(part)
                    fits = (tokens <= capacity) & (loss <= loss_capacity)
                    zero = np.zeros(int(fits.sum()), np.int64)
                    rows, piece, start, n, lb = [own[fits]], [zero], [zero], [tokens[fits]], [loss[fits]]
                    for r in np.nonzero(~fits)[0].tolist():
                        told, lossy = counts[cut[r] : cut[r + 1]], bears[cut[r] : cut[r + 1]]
                        edges = cuts(told, lossy, capacity, loss_capacity)
                        borne = np.concatenate([[0], np.cumsum(np.repeat(lossy, told))])
                        rows.append(np.full(len(edges), own[r]))
                        piece.append(np.arange(len(edges)))
                        start.append(edges)
                        n.append(np.diff(np.append(edges, tokens[r])))
                        lb.append(np.diff(borne[np.append(edges, tokens[r])]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, piece, start, n, lb)], names=["doc_id", "piece", "start", "tokens", "loss"])

    return run


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The context of every piece (numbered from 0). limits: tokens, segments, loss-bearing tokens. No piece
    is above a limit by itself (see cuts)."""
    cap, segments, loss_cap = limits
    if len(tokens) and (tokens.max() > cap or loss.max() > max(1, loss_cap)):
        raise ValueError("a piece is above a limit")
    code = tokens.astype(np.int64) * (cap + 1) + loss
    kinds, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    size, lossy = kinds // (cap + 1), kinds % (cap + 1)
    order = np.argsort(inverse, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(counts)[:-1]])
    left = counts.copy()
    out = np.full(len(tokens), -1, np.int64)
    weight = np.array([1 / cap, 1 / max(1, loss_cap), 1 / segments])
    remaining, context = len(tokens), 0
    while remaining:
        room, room_loss, room_seg = cap, max(1, loss_cap), segments
        while room_seg and remaining:
            top = np.searchsorted(size, room, "right")  # classes are sorted by size
            if not top:
                break
            ok = (left[:top] > 0) & (lossy[:top] <= room_loss)
            # every piece is one segment
            score = np.where(ok, size[:top] * (weight[0] ** 2 * room) + lossy[:top] * (weight[1] ** 2 * room_loss) + weight[2] ** 2 * room_seg, -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                break
            out[order[next_of[best]]] = context
            next_of[best] += 1
            left[best] -= 1
            remaining -= 1
            room, room_loss, room_seg = room - size[best], room_loss - lossy[best], room_seg - 1
            if left[best] == 0 and (left == 0).mean() > 0.5:
                live = left > 0
                size, lossy, left, next_of = size[live], lossy[live], left[live], next_of[live]
        context += 1
    return out


def _packer(limits: tuple[int, int, int], offset: int, at_most: int = 200_000):
    """Pack the pieces of a task, at_most at a time; contexts are numbered by task."""

    def run(batches):
        from pyspark import TaskContext

        base, done = (offset + TaskContext.get().partitionId()) << 32, 0

        def flush(rows):
            nonlocal done
            t = pa.Table.from_batches(rows)
            n, loss = t.column("tokens").to_numpy(), t.column("loss").to_numpy()
            where = pack(n, loss, limits)
            filled = np.maximum.reduce([np.bincount(where, weights=w) / most for w, most in zip((n, np.ones(len(n)), loss), limits)]) if len(n) else np.zeros(0)
            made = pa.array(where + base + done)
            done += len(filled)
            return pa.RecordBatch.from_arrays([*(t.column(x).combine_chunks() for x in ("doc_id", "piece", "start", "tokens", "loss")), made, pa.array(filled[where])], names=["doc_id", "piece", "start", "tokens", "loss", "context", "filled"])

        rows, n = [], 0
        for b in batches:
            if b.num_rows:
                rows.append(b)
                n += b.num_rows
            if n >= at_most:
                yield flush(rows)
                rows, n = [], 0
        if rows:
            yield flush(rows)

    return run


PACKED = "doc_id long, piece long, start long, tokens long, loss long, context long, filled double"


def contexts(documents: DataFrame, *, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, segments: int = 64, loss_capacity: int | None = None, full: float = 0.99) -> DataFrame:
    """(doc_id, piece, start, tokens, loss, context): the context of every document or piece of one. A context that is
    ``full`` in one dimension is done after the first round."""
    limits = (capacity, segments, loss_capacity or capacity)
    work = Workspace(documents.sparkSession, "packing")
    pieces = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _measurer(vocabulary, capacity, limits[2]), "doc_id long, piece long, start long, tokens long, loss long"
    )
    first = work.put(pieces.where("tokens > 0").mapInArrow(_packer(limits, 0), PACKED), "first")
    kept = first.where(F.col("filled") >= full)
    again = first.where(F.col("filled") < full).drop("context", "filled")
    tasks = max(1, first.rdd.getNumPartitions() // 16)
    second = again.repartition(tasks, F.xxhash64("doc_id", "piece")).mapInArrow(_packer(limits, 1 << 30), PACKED)
    return kept.unionByName(second).drop("filled")


def usage(packed: DataFrame, capacity: int, segments: int = 64, loss_capacity: int | None = None) -> DataFrame:
    """One row: contexts, tokens, the share of the space that is used in each dimension, and the most in any context."""
    each = packed.groupBy("context").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l"))
    share = lambda c, most: (F.sum(c) / (F.count("*") * most))
    return each.agg(
        F.count("*").alias("n_contexts"), F.sum("t").alias("n_tokens"), share("t", capacity).alias("used"), share("s", segments).alias("used_segments"), share("l", loss_capacity or capacity).alias("used_loss"),
        F.max("t").alias("most_tokens"), F.max("s").alias("most_segments"), F.max("l").alias("most_loss"),
    )


def faults(packed: DataFrame, capacity: int, segments: int = 64, loss_capacity: int | None = None) -> DataFrame:
    """One row: texts that are placed, and how often a rule is broken: contexts above a limit, pieces that repeat, don't
    follow each other or are smaller than they need to be."""
    most = loss_capacity or capacity
    over = packed.groupBy("context").agg(((F.sum("tokens") > capacity) | (F.count("*") > segments) | (F.sum("loss") > most)).alias("over")).agg(F.count_if("over").alias("n_over"))
    # a piece ends at a limit, or its text does: tokens up to a last piece fill it in one dimension
    per = packed.groupBy("doc_id").agg(
        F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.max("piece").alias("last"), F.countDistinct("piece").alias("kinds"),
        F.sum((F.greatest(F.col("tokens") / capacity, F.col("loss") / most) < 1).cast("int")).alias("short"),
    )
    bad = (F.col("end") != F.col("t")) | (F.col("kinds") != F.col("n")) | (F.col("last") + 1 != F.col("n")) | (F.col("short") > 1)
    told = per.agg(F.count("*").alias("n_texts"), F.count_if(bad).alias("n_badly_cut")).withColumn("n_over", F.lit(0).cast("bigint"))
    both = told.unionByName(over.select(F.lit(0).cast("bigint").alias("n_texts"), F.lit(0).cast("bigint").alias("n_badly_cut"), "n_over"))
    return both.agg(*(F.sum(c).alias(c) for c in both.columns))
