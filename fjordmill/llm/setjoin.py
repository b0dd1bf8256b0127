"""All similar pairs between set-valued records, by a size-aware overlap join.

Equal sets are one class, so copies are joined once and their links come from the class. Tokens are ordered from rare
to frequent; two sets A, B with Jaccard similarity of at least s share at least ``s * max(|A|, |B|)`` tokens, so the
first ``|A| - ceil(s |A|) + c`` tokens of A and the like of B (their c-prefixes) share at least c tokens.
- A small set enumerates subsets of its prefix. How many tokens a subset has is chosen from the data: single tokens
  first; a subset that more than BLOCK sets have is not used but extended by each later token of the next prefix, up to
  DEEPEST tokens. The c first common tokens of a pair are a subset of both, for every c, so no pair is lost.
- A large set (whose 2-prefix has more than SUBSETS pairs) is scanned through inverted lists of single tokens; every set
  that can be similar to a large set puts the tokens of its prefix into these lists too.
The union of both is filtered: by the sizes, by upper bounds of the overlap from two signatures of 64 bits, and by the exact
similarity, all where the sets meet: a row carries its tokens. Of all keys that a pair shares only that of its first
common tokens makes the pair, so none comes twice.

How often keys occur is counted in a table of slots, which goes out as one bit per slot (at most MOST_SLOTS): a slot
that several keys share may extend some of them too early, which costs rows but no pair. Keys that are still too
frequent at DEEPEST tokens, and long inverted lists, are cut into blocks by the row's hash, and every two blocks meet
in a task of their own.

Edge cases: null sets, null tokens and sets below ``least`` tokens have no pairs; repeated tokens count once; repeated
records (equal id) are one record, the latest delivery holds; copies are linked with each other; an empty table gives
no pairs; extra columns of any name are ignored. Text tokens are compared by 64-bit hashes, integer tokens exactly.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordmill.session import Workspace

#: Tokens whose frequency is looked up; the others are rarer than any of these and ordered by hash.
HEAVY = 20_000
#: Rows of one key that are compared with each other in one task.
BLOCK = 16384
#: Pairs of a prefix from which a set counts as large.
SUBSETS = 96
#: Tokens of the largest subsets.
DEEPEST = 4
MOST_SLOTS = 1 << 27
#: Candidate pairs that a task holds at once.
MOST_HITS = 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)


def _positions(column: int):
    def run(batches):
        for b in batches:
            lists = b.column(column)
            lists = pa.concat_arrays([lists])
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = pc.fill_null(lists.values, 0).to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            off = off - off[0]
            at = np.nonzero(flat)[0]
            row = np.searchsorted(off[1:], at, "right")
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))]).astype(np.int32), mask=np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False))
            tokens = pa.ListArray.from_arrays(cut, pa.array((at - off[row]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([tokens if k == column else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return run


def on_positions(df: DataFrame, column: str) -> DataFrame:
    """The bit vectors of a column become the sets (array<long>) of the positions that are on, over whole Arrow batches;
    null elements are off, a null vector stays null."""
    schema = ", ".join(f"`{f.name}` {'array<long>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_positions(df.columns.index(column)), schema)


def label_set(labels: Column) -> Column:
    """Labels -> set of their hashes, ignoring case, outer blanks and nulls."""
    clean = F.array_distinct(F.transform(F.array_compact(labels), lambda x: F.upper(F.trim(x))))
    return F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.xxhash64(x))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(size: int, s: float, c: int) -> int:
    return min(size, size - ceil(s * size - 1e-9) + c)


def is_large(size: int, s: float) -> bool:
    return comb(prefix(size, s, 2), 2) > SUBSETS


def _order(flat: np.ndarray, heavy: dict | None) -> np.ndarray:
    """Sort key of tokens: frequency of the heavy ones (0 for the rest), then hash."""
    h = _mix(flat.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    if heavy is None or not len(heavy[0]):
        return h
    at = np.clip(np.searchsorted(heavy[0], flat), 0, len(heavy[0]) - 1)
    rank = np.where(heavy[0][at] == flat, heavy[1][at], 0).astype(np.uint64)
    return (rank << np.uint64(40)) | h


def signatures(tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits each of sets that lie one after the other (none is empty): a bit per token by two hashes."""
    h = _mix(tokens.view(np.uint64))
    return tuple(np.bitwise_or.reduceat(np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63)), off[:-1]) for k in (58, 40))


def _key(sums: np.ndarray, field: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """Key of a subset from the sum of its tokens' hashes; the last bits are the level: the number of its tokens, or 0
    in an inverted list."""
    return (_mix(sums + field) & ~np.uint64(7)) | np.asarray(level, np.uint64)


class _Keys:
    """The keys of sets, level by level, as far as the bit tables of too frequent keys are known."""

    def __init__(self, s: float, deepest: int, heavy, tables: dict[int, np.ndarray]):
        self.s, self.deepest, self.heavy, self.tables, self.shapes = s, deepest, heavy, tables, {}

    def _hot(self, level: int, keys: np.ndarray) -> np.ndarray:
        words = self.tables.get(level)
        if words is None or not len(words):
            return np.zeros(len(keys), bool)
        slot = (keys >> np.uint64(3)) & np.uint64(len(words) * 64 - 1)
        return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def shape(self, size: int) -> tuple[bool, int]:
        """Whether a set of this size enumerates subsets, and how many tokens it puts into inverted lists."""
        if size not in self.shapes:
            large = is_large(size, self.s)
            near = large or any(is_large(t, self.s) for t in range(size, int(size / self.s + 1e-9) + 1))
            self.shapes[size] = not large, prefix(size, self.s, 1) if near and 0 in self.tables else 0
        return self.shapes[size]

    def ordered(self, b: pa.RecordBatch):
        """(tokens from rare to frequent, offsets) of a batch (f, id, tokens)."""
        lists = pa.concat_arrays([b.column(2)])
        off = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        off = (off - off[0]).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(off))
        return flat[np.lexsort((flat, _order(flat, self.heavy), row))], off

    def walk(self, tokens: np.ndarray, off: np.ndarray, field: np.ndarray):
        """(level, rows, keys, too frequent) of all keys that the tables before them leave open."""
        sizes, mixed = np.diff(off), _mix(tokens.view(np.uint64) + ODD)
        for size in np.unique(sizes).tolist():
            subsets, singles = self.shape(size)
            every = np.nonzero(sizes == size)[0]
            for cut in range(0, len(every), 1 << 12):
                at = every[cut : cut + (1 << 12)]
                if singles:
                    rows = np.repeat(at, singles)
                    keys = _key(mixed[(off[at][:, None] + np.arange(singles)).ravel()], field[rows], 0)
                    yield 0, rows, keys, self._hot(0, keys)
                if not subsets:
                    continue
                width = prefix(size, self.s, 1)
                rows, last = np.repeat(at, width), np.tile(np.arange(width), len(at))
                sums = mixed[off[rows] + last]
                for level in range(1, self.deepest + 1):
                    keys = _key(sums, field[rows], level)
                    hot = self._hot(level, keys)
                    yield level, rows, keys, hot
                    if not hot.any() or level == self.deepest:
                        break
                    more = prefix(size, self.s, level + 1) - 1 - last[hot]
                    begin = np.repeat(last[hot] + 1, more)
                    last = begin + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                    rows, sums = np.repeat(rows[hot], more), np.repeat(sums[hot], more) + mixed[off[np.repeat(rows[hot], more)] + last]


def _made(sent, s: float, deepest: int) -> _Keys:
    both, tables = sent.value
    both = np.frombuffer(both, np.int64)
    return _Keys(s, deepest, (both[: len(both) // 2], both[len(both) // 2 :]), {k: np.frombuffer(t, np.uint64) for k, t in tables.items()})


def _counter(sent, s: float, deepest: int, level: int, slots: int):
    """(f, id, tokens) -> (slot, n) of the keys of a level."""

    def run(batches):
        made = _made(sent, s, deepest)
        for b in batches:
            if not b.num_rows:
                continue
            tokens, off = made.ordered(b)
            got = [k for lv, _, k, _ in made.walk(tokens, off, b.column(0).to_numpy().view(np.uint64)) if lv == level]
            slot, n = np.unique((np.concatenate(got) >> np.uint64(3)) & np.uint64(slots - 1) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return run


ROWS = "key long, f long, id long, tokens binary"


def _emitter(sent, s: float, deepest: int, hot: bool):
    """(f, id, tokens) -> a row per key, of those that are used as they are or (hot) of those that are too frequent."""

    def run(batches):
        made = _made(sent, s, deepest)
        for b in batches:
            if not b.num_rows:
                continue
            tokens, off = made.ordered(b)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(off * 8), pa.py_buffer(np.ascontiguousarray(tokens))]).cast(pa.binary())
            for level, rows, keys, much in made.walk(tokens, off, b.column(0).to_numpy().view(np.uint64)):
                use = (much if level in (0, deepest) else np.zeros(len(keys), bool)) if hot else ~much
                at = pa.array(rows[use])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64)), b.column(0).take(at), b.column(1).take(at), binary.take(at)], names=["key", "f", "id", "tokens"])

    return run


def _index_pairs(bounds: np.ndarray, n_small: int):
    """Index pairs (i < j) within each run of at most n_small rows, in turns."""
    n = np.diff(bounds)
    for size in np.unique(n[(n > 1) & (n <= n_small)]).tolist():
        starts = bounds[:-1][n == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 20) // len(i))
        for cut in range(0, len(starts), step):
            s = starts[cut : cut + step, None]
            yield (s + i).ravel(), (s + j).ravel()


def _matrix(tokens: np.ndarray, off: np.ndarray, rows: np.ndarray, width: np.ndarray, top: int, fill: int) -> np.ndarray:
    """The first ``width`` tokens of rows, padded."""
    at = off[rows][:, None] + np.arange(top)
    return np.where(np.arange(top)[None] < width[rows][:, None], tokens[np.minimum(at, len(tokens) - 1)], fill)


def _common(tokens: np.ndarray, off: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray):
    """In turns: (slice of the pairs, tokens of i as a matrix, which of them j has too) within the first ``width``."""
    order = np.argsort(np.maximum(width[i], width[j]), kind="stable")
    begin = 0
    while begin < len(order):
        top = int(max(width[i[order[begin]]], width[j[order[begin]]]))
        end = min(len(order), begin + max(1, (1 << 21) // (top * top)))
        at = order[begin:end]
        top = int(max(width[i[at]].max(), width[j[at]].max()))
        if top > 256:  # long sets: pair by pair, sorted
            for k in at.tolist():
                x, y = (tokens[off[r] : off[r] + width[r]] for r in (i[k], j[k]))
                yield np.array([k]), x[None], np.isin(x, y)[None]
        else:
            valid = np.arange(top)[None] < width[i[at]][:, None]
            x, y = _matrix(tokens, off, i[at], width, top, 0), _matrix(tokens, off, j[at], width, top, 0)
            in_y = np.arange(top)[None] < width[j[at]][:, None]
            yield at, x, ((x[:, :, None] == y[:, None, :]) & in_y[:, None, :]).any(axis=2) & valid
        begin = end


def _pairs(s: float):
    """Rows sorted by meet -> the similar pairs of each run. Rows of side 1 are compared with those of side 2 only."""

    def compare(t: pa.Table, run_id: np.ndarray):
        raw = t.column("tokens").combine_chunks()
        raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
        start = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64) // 8
        tokens = np.frombuffer(raw.buffers()[2], np.int64, int(start[-1]))[start[0] :]
        off = start - start[0]
        sizes = np.diff(off)
        order = np.lexsort((sizes, run_id))  # by size within a run: partners lie in a stretch
        ids, key, side = (t.column(x).to_numpy()[order] for x in ("id", "key", "side"))
        sig = [x[order] for x in signatures(tokens, off)]
        off, sizes, run_id = off[:-1][order], sizes[order], run_id[order]
        bounds = np.concatenate([[0], np.nonzero(run_id[1:] != run_id[:-1])[0] + 1, [len(ids)]])
        # all but so many tokens of i are in any partner, and so are all but so many bits
        bits = [np.bitwise_count(x).astype(np.int64) for x in sig]
        floor = np.clip(bits[0] - (sizes - np.ceil(s * sizes - 1e-9).astype(np.int64)), 0, 64).astype(np.uint8)
        large = np.array([is_large(x, s) for x in range(int(sizes.max()) + 1)])[sizes]
        level = (key & 7).astype(np.int64)
        field = t.column("f").to_numpy()[order].view(np.uint64)
        part = np.maximum(level, 1)
        width = np.minimum(sizes, sizes - np.ceil(s * sizes - 1e-9).astype(np.int64) + part)
        hits, n_hits = [], 0

        def keep(i, j):
            need = np.ceil(s / (1 + s) * (sizes[i] + sizes[j]) - 1e-9)
            ok = (np.minimum(sizes[i], sizes[j]) >= s * np.maximum(sizes[i], sizes[j]) - 1e-9) & ((side[i] == 0) | (side[i] != side[j])) & (ids[i] != ids[j])
            ok &= (level[i] > 0) | large[i] | large[j]
            for word, n in zip(sig, bits):
                common = np.bitwise_count(word[i] & word[j])
                ok &= (common >= n[i] - (sizes[i] - need)) & (common >= n[j] - (sizes[j] - need))
            return i[ok], j[ok]

        def made():
            """The similar pairs among the hits so far."""
            i, j = (np.concatenate(x) for x in zip(*hits))
            # of the keys that a pair shares, that of its first common tokens makes it
            own = np.zeros(len(i), bool)
            for at, x, both in _common(tokens, off, width, i, j):
                first = both & (np.cumsum(both, axis=1) <= part[i[at]][:, None])
                sums = np.where(first, _mix(x.view(np.uint64) + ODD), np.uint64(0)).sum(axis=1, dtype=np.uint64)
                own[at] = _key(sums, field[i[at]], level[i[at]]) == key[i[at]].view(np.uint64)
            i, j = i[own], j[own]
            true = np.zeros(len(i), bool)
            for at, _, both in _common(tokens, off, sizes, i, j):
                shared = both.sum(axis=1)
                true[at] = shared >= s * (sizes[i[at]] + sizes[j[at]] - shared) - 1e-9
            i, j = i[true], j[true]
            return pa.RecordBatch.from_arrays([pa.array(field[i].view(np.int64)), pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["f", "a", "b"])

        def candidates():
            for i, j in _index_pairs(bounds, 24):
                ok = np.bitwise_count(sig[0][i] & sig[0][j]) >= floor[i]
                yield keep(i[ok], j[ok])
            for r in np.nonzero(np.diff(bounds) > 24)[0]:
                lo, hi = int(bounds[r]), int(bounds[r + 1])
                for x in range(lo, hi, 128):
                    y = min(x + 128, hi)
                    end = lo + int(np.searchsorted(sizes[lo:hi], int(sizes[y - 1] / s + 1e-9), "right"))
                    flat = np.flatnonzero((np.bitwise_count(sig[0][x:y, None] & sig[0][None, x:end]) >= floor[x:y, None]).ravel())
                    i, j = flat // (end - x), flat % (end - x)
                    up = i < j
                    yield keep(i[up] + x, j[up] + x)

        for i, j in candidates():
            if len(i):
                hits.append((i, j))
                n_hits += len(i)
            if n_hits > MOST_HITS:  # near-equal sets by the thousand: the pairs leave the task in turns
                yield made()
                hits, n_hits = [], 0
        if hits:
            yield made()

    def cut(t):
        m = t.column("meet").to_numpy()
        return np.cumsum(np.concatenate([[0], m[1:] != m[:-1]]))

    def run(batches):
        held, rows, enough = [], 0, 1 << 16
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows < enough:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            ids = cut(t)
            last = int(np.searchsorted(ids, ids[-1]))
            if last:
                yield from compare(t.slice(0, last).combine_chunks(), ids[:last])
            held, rows = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
            enough = max(1 << 16, 2 * rows)
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from compare(t, cut(t))

    return run


def _too_frequent(sets: DataFrame, count, slots: int) -> bytes:
    """Bits of the slots that more than BLOCK keys fall into; empty where there is none."""
    much = sets.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    words = much.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    if not words.num_rows:
        return b""
    out = np.zeros(slots // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def class_pairs(distinct_sets: DataFrame, s: float, deepest: int, work: Workspace) -> DataFrame:
    """(field, a, b), a < b: similar pairs of (field, id, tokens array<long>) whose sets all differ."""
    spark = distinct_sets.sparkSession
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = distinct_sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    total, longest = distinct_sets.agg(F.sum(F.size("tokens").cast("long")), F.max(F.size("tokens"))).first()
    heavy = counts.where(F.col("count") * HEAVY > (total or 0)).toArrow()  # fewer than HEAVY rows
    token, n = (heavy.column(x).to_numpy().astype(np.int64) for x in ("token", "count"))
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(1, len(token) + 1)
    order = np.argsort(token)
    ranks = np.concatenate([token[order], rank[order]]).tobytes()
    sets = distinct_sets.select(F.xxhash64("field").alias("f"), "id", "tokens")
    slots = 1 << 16
    while slots < min(MOST_SLOTS, 8 * (total or 0) // BLOCK):
        slots *= 2
    tables: dict[int, bytes] = {0: b""} if longest is not None and is_large(longest, s) else {}  # no inverted lists without large sets
    send = lambda: spark.sparkContext.broadcast((ranks, dict(tables)))
    for level in [*tables, *range(1, deepest + 1)]:
        tables[level] = _too_frequent(sets, _counter(send(), s, deepest, level, slots), slots)
        if level and not tables[level]:
            break
    sent = send()
    schema = f"{ROWS}, side int, meet long"
    rows = sets.mapInArrow(_emitter(sent, s, deepest, False), ROWS).select("*", F.lit(0).alias("side"), F.col("key").alias("meet"))
    if tables.get(0) or tables.get(deepest):
        hot = work.put(sets.mapInArrow(_emitter(sent, s, deepest, True), ROWS), "hot")
        sized = hot.join(hot.groupBy("f", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), ["f", "key"])
        placed = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y")))).alias("m")
        side = F.when(F.col("m.x") == F.col("m.y"), 0).when(F.col("block") == F.col("m.x"), 1).otherwise(2)
        rows = rows.unionByName(placed.select("*", meets).select("key", "f", "id", "tokens", side.alias("side"), F.xxhash64("key", "m.x", "m.y").alias("meet")))
    ordered = rows.repartition(parts, "meet").sortWithinPartitions("meet")
    near = work.put(ordered.mapInArrow(_pairs(s), "f long, a long, b long"), "near")
    return near.join(work.put(distinct_sets.select("field", F.xxhash64("field").alias("f")).distinct(), "fields"), "f").select("field", "a", "b")


def similar_pairs(sets: DataFrame, *, similarity: float = 0.8, least: int = 6, deepest: int = DEEPEST, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """sets: field string, id long, tokens array<long> (distinct tokens), one row per field and id.

    Returns (membership, links): (field, id, class) of every record with a set of ``least`` or more tokens, and
    (field, a, b) between classes. A class is named by the least id of its records.
    """
    work = work or Workspace(sets.sparkSession, "setjoin")
    usable = work.put(sets.where("id is not null and field is not null").where(F.size("tokens") >= max(1, least)).select("field", "id", F.array_sort("tokens").alias("tokens")), "sets")
    # equal sets are found by 128 bits of hash, so copies are combined before the shuffle
    hashed = usable.withColumns({"h": F.xxhash64("tokens"), "g": F.xxhash64(F.lit(1), "tokens")})
    named = hashed.groupBy("field", "h", "g").agg(F.min("id").alias("class"))
    both = work.put(hashed.join(named, ["field", "h", "g"]).select("field", "id", "class", "tokens"), "classes")
    member, named = both.select("field", "id", "class"), both.where("id = class").drop("class")
    # any two similar sets share that many tokens
    deepest = max(1, min(deepest, ceil(similarity * max(1, least) - 1e-9)))
    links = class_pairs(named, similarity, deepest, work)
    return member, work.put(links, "links")


def link_counts(member: DataFrame, links: DataFrame) -> DataFrame:
    """(field, id, class, n_links): every record with the number of records it is linked with, without making pairs."""
    sizes = member.groupBy("field", "class").agg(F.count("*").alias("n"))
    ends = links.select("field", F.col("a").alias("class"), F.col("b").alias("to")).unionByName(links.select("field", F.col("b").alias("class"), F.col("a").alias("to")))
    others = ends.join(sizes.select("field", F.col("class").alias("to"), "n"), ["field", "to"]).groupBy("field", "class").agg(F.sum("n").alias("more"))
    per = sizes.join(others, ["field", "class"], "left").select("field", "class", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return member.join(per, ["field", "class"]).select("field", "id", "class", "n_links")


def record_pairs(member: DataFrame, links: DataFrame) -> DataFrame:
    """(field, a, b), a < b: all pairs of records, from the links of their classes and within the classes."""
    own = member.select("field", F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    left = member.select("field", F.col("class").alias("a"), F.col("id").alias("x"))
    right = member.select("field", F.col("class").alias("b"), F.col("id").alias("y"))
    several = member.groupBy("field", "class").count().where("count > 1").select("field", F.col("class").alias("a"), F.col("class").alias("b"))
    inside = several.join(left, ["field", "a"]).join(right, ["field", "b"]).where("x < y")
    between = links.join(left, ["field", "a"]).join(right, ["field", "b"])
    return inside.select("field", "x", "y").unionByName(between.select("field", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
