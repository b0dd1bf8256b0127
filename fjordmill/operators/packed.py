"""Several values packed in one field, one row per value with its position.

The texts of an Arrow batch are scanned as one buffer of bytes: quote parity and bracket depth come from cumulative
sums over the whole buffer, delimiter masks from table look-ups, and the child offsets from the positions where the
item number changes. List arrays are built on these offsets and flattened together with their parents' ordinals.

Rules. Separators inside quotation marks or inside brackets of an item do not split. Quotation marks around an item
and brackets around a whole list are no part of it; a doubled quotation mark inside quotes is one. Outer blanks and
empty items are dropped, repeated values stay, positions count from 1. Markers for nothing (unquoted) are no value.
- codes: blanks and every mark that is no part of a code separate (part of a code: letters, digits, _ . : -).
- modules: an item reads ``name [database id] (from-to)``; what stands between two modules separates them.

Texts whose quotation marks are mixed (both kinds in one text) or unbalanced can't be settled by parity; these are
scanned mark by mark, where an unclosed quotation mark is ordinary text. Null texts and empty tables give no rows.
Texts may be of any length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordmill.functions.scalars import PLACEHOLDERS

OPEN, CLOSE = b"[({", b"])}"
MODULE = re.compile(r"(?s)(.*?\[[^\]]*\]\s*\(\s*\d+\s*-\s*\d+\s*\))")
BETWEEN = " \t\r\n;,|/+& "


def _code_bytes() -> np.ndarray:
    """Bytes that are part of a code; bytes of characters beyond ASCII are letters here."""
    part = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        part[lo:hi] = True
    part[list(b"_.:-")] = True
    return part


def _is(data: np.ndarray, marks: bytes) -> np.ndarray:
    hit = np.zeros(256, bool)
    hit[list(marks)] = True
    return hit[data]


def _clean(item: str, whole_list: bool = False) -> str | None:
    """An item without outer blanks and quotation marks; None where nothing is left."""
    item = item.strip(BETWEEN[:4] + " ")
    for q in "\"'":
        if len(item) >= 2 and item[0] == q == item[-1]:
            inner = item[1:-1].replace(q + q, q).strip()
            return inner or None
    return None if item.lower() in PLACEHOLDERS else item


def _unwrapped(text: str) -> str:
    """The text without brackets around the whole list."""
    t = text.strip()
    while len(t) >= 2 and t[0] in "[({" and t[-1] == "])}"["[({".index(t[0])]:
        depth = 0
        for i, ch in enumerate(t):
            depth += (ch in "[({") - (ch in "])}")
            if depth == 0:
                break
        if i < len(t) - 1:
            break
        t = t[1:-1].strip()
    return t


def scan_codes(text: str) -> list[str]:
    """One text, mark by mark: for mixed or unbalanced quotation marks."""
    t, out, item, depth, i = _unwrapped(text), [], [], 0, 0
    part = _code_bytes()
    while i < len(t):
        ch = t[i]
        if ch in "\"'" and not "".join(item).strip():
            end = i + 1
            while (end := t.find(ch, end)) != -1 and t[end + 1 : end + 2] == ch:
                end += 2
            if end != -1:
                out.append(t[i : end + 1])
                i, item = end + 1, []
                while i < len(t) and t[i] == "[":  # brackets that belong to a quoted code
                    close = t.find("]", i)
                    if close == -1:
                        break
                    out[-1], i = out[-1][:-1] + t[i : close + 1] + ch, close + 1
                continue
        depth = max(0, depth + (ch in "[({") - (ch in "])}"))
        if depth or ch in "])}" or ord(ch) > 127 and ch not in BETWEEN or part[min(ord(ch), 127)]:
            item.append(ch)
        else:
            out.append("".join(item))
            item = []
        i += 1
    out.append("".join(item))
    return [x for x in map(_clean, out) if x]


def scan_modules(text: str) -> list[str]:
    t, out, i = _unwrapped(text), [], 0
    while i < len(t):
        while i < len(t) and t[i] in BETWEEN:
            i += 1
        if i >= len(t):
            break
        if t[i] in "\"'":
            q, end = t[i], i + 1
            while (end := t.find(q, end)) != -1 and t[end + 1 : end + 2] == q:
                end += 2
            if end != -1:
                out.append(t[i : end + 1])
                i = end + 1
                continue
        m = MODULE.match(t, i)
        if m:
            out.append(m[1])
            i = m.end()
        else:
            out.append(t[i:].strip(BETWEEN))
            break
    return [x for x in map(_clean, out) if x]


def split_buffer(data: np.ndarray, offsets: np.ndarray, modules: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every raw item of balanced texts laid end to end in one buffer of bytes."""
    n = len(data)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    quote = _is(data, b"\"'")
    before = np.concatenate([[0], np.cumsum(quote)])
    inside = (before[:-1] - before[offsets[:-1]][rows]) % 2 == 1  # parity of the quotation marks before a byte in its text
    inside |= quote
    up, down = _is(data, OPEN) & ~inside, _is(data, CLOSE) & ~inside
    level = np.concatenate([[0], np.cumsum(up.astype(np.int64) - down)])
    depth = level[1:] - level[offsets[:-1]][rows]  # after the byte
    # brackets around a whole list: open at the text's first mark, never closed before its last
    blank = _is(data, b" \t\r\n")
    some = ~blank
    first = np.full(len(offsets) - 1, -1)
    last = np.full(len(offsets) - 1, -1)
    at = np.nonzero(some)[0]
    first[rows[at[::-1]]] = at[::-1]
    last[rows[at]] = at
    full = first >= 0
    lowest = np.full(len(offsets) - 1, 1)
    mid = some & (np.arange(n) < last[rows])
    low = np.minimum.reduceat(np.where(mid, depth, 9), np.minimum(offsets[:-1], n - 1)) if n else lowest
    wrapped = full & (first < last) & up[np.maximum(first, 0)] & down[np.maximum(last, 0)] & (np.diff(offsets) > 0) & (low >= 1)
    depth = depth - wrapped[rows]
    skip = np.zeros(n, bool)
    skip[first[wrapped]] = True
    skip[last[wrapped]] = True
    if modules:
        # a module ends with the bracket that closes (from-to); the next item begins at the next mark that does not separate
        ends = down & (data == 41) & (depth <= 0) & ~skip
        closes = np.concatenate([[False], ends[:-1]]) if n else ends
        after_quote = quote & ((before[1:] - before[offsets[:-1]][rows]) % 2 == 0)
        doubled = after_quote & np.concatenate([quote[1:], [False]]) & np.concatenate([rows[1:] == rows[:-1], [False]])
        closes |= np.concatenate([[False], (after_quote & ~doubled)[:-1]]) if n else closes
        closes &= ~(quote & np.concatenate([[False], quote[:-1]]))
        sep = skip | (_is(data, BETWEEN[:9].encode()) & ~inside & (depth <= 0) & _edge(closes, rows, data, inside))
        start_new = closes
    else:
        sep = skip | (~_code_bytes()[data] & ~inside & (depth <= 0) & ~down & ~up)
        start_new = np.zeros(n, bool)
    keep = ~sep
    prev = np.concatenate([[False], keep[:-1]]) if n else keep
    same = np.concatenate([[False], rows[1:] == rows[:-1]]) if n else keep
    begins = keep & (~prev | ~same | start_new)
    starts = np.nonzero(begins)[0]
    nxt = np.concatenate([keep[1:], [False]]) if n else keep
    final = keep & (~nxt | np.concatenate([~same[1:], [True]]) | np.concatenate([begins[1:], [True]])) if n else keep
    return starts, np.nonzero(final)[0] + 1, rows[starts]


def _edge(closes: np.ndarray, rows: np.ndarray, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """True from the end of a module (or the start of a text) to the first mark that does not separate."""
    n = len(data)
    plain = ~_is(data, BETWEEN[:9].encode()) | inside
    at = np.arange(n)
    new_row = np.concatenate([[True], rows[1:] != rows[:-1]]) if n else closes
    opened = np.maximum.accumulate(np.where(closes | new_row, at, -1)) if n else at
    solid = np.maximum.accumulate(np.where(plain, at, -1)) if n else at
    return solid < opened


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts from stretches of a buffer of bytes, as one Arrow array: the bytes are gathered once, no text is made."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def clean_items(items: pa.Array) -> pa.Array:
    """_clean for a whole array: null where nothing is left."""
    blanks = BETWEEN[:4] + " "
    items = pc.utf8_trim(items, blanks)
    out = pc.if_else(pc.is_in(pc.utf8_lower(items), pa.array(PLACEHOLDERS, pa.large_string())), pa.scalar(None, pa.large_string()), items)
    for q in "\"'":
        quoted = pc.and_(pc.and_(pc.starts_with(items, q), pc.ends_with(items, q)), pc.greater_equal(pc.utf8_length(items), 2))
        inner = pc.utf8_trim_whitespace(pc.replace_substring(pc.utf8_slice_codeunits(items, 1, -1), q + q, q))
        inner = pc.if_else(pc.equal(inner, ""), pa.scalar(None, pa.large_string()), inner)
        out = pc.if_else(quoted, inner, out)
    return out


def split_texts(texts: pa.Array, modules: bool) -> tuple[np.ndarray, pa.Array]:
    """(row of each item, items) over an Arrow array of texts, in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.if_else(pc.is_in(pc.utf8_lower(pc.utf8_trim_whitespace(texts)), pa.array(PLACEHOLDERS, pa.large_string())), "", texts)
    if not modules:  # the one marker for nothing that holds a separator
        texts = pc.replace_substring_regex(texts, r"(^|[;,|+&\s])[nN]/[aA]($|[;,|+&\s])", r"\1 \2")
    double, single = (pc.count_substring(texts, q).to_numpy(zero_copy_only=False) for q in "\"'")
    odd = (double % 2 == 1) | (single % 2 == 1) | ((double > 0) & (single > 0))
    calm = pc.if_else(pa.array(odd), "", texts)
    buffers = calm.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(calm) + 1, calm.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends, rows = split_buffer(data, offsets, modules) if len(data) else (np.zeros(0, np.int64),) * 3
    items = clean_items(_slices(data, starts, ends))
    some = pc.is_valid(items).to_numpy(zero_copy_only=False)
    rows, items = rows[some], items.filter(pa.array(some))
    if odd.any():  # parity can't settle these: mark by mark
        one = scan_modules if modules else scan_codes
        more = [(r, item) for r in np.nonzero(odd)[0].tolist() for item in one(texts[r].as_py())]
        rows = np.concatenate([rows, np.array([r for r, _ in more], np.int64)])
        order = np.argsort(rows, kind="stable")
        items = pa.concat_arrays([items, pa.array([i for _, i in more], pa.large_string())]).take(pa.array(order))
        rows = rows[order]
    return rows, items


def _splitter(modules: bool):
    def run(batches):
        for b in batches:
            rows, items = split_texts(b.column(1), modules)
            child = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(child), items.cast(pa.string()))
            parent = pc.list_parent_indices(lists)
            pos = np.arange(len(items)) - child[:-1][rows] + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(parent), pa.array(pos.astype(np.int64)), lists.flatten()], names=["row_id", "pos", "item"])

    return run


def unpack(df: DataFrame, column: str, *, row_id: str = "row_id", modules: bool = False) -> DataFrame:
    """(row_id, pos, item): a narrow pass over the rows, no shuffle."""
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(column).cast("string").alias("text")).where("text is not null").mapInArrow(
        _splitter(modules), "row_id long, pos long, item string"
    )


def unpack_all(fields: list[tuple[str, DataFrame, str, bool]]) -> DataFrame:
    """(src_table, row_id, pos, item) over several (name, rows, column, modules) fields."""
    out = None
    for name, df, column, modules in fields:
        one = unpack(df, column, modules=modules).select(F.lit(name).alias("src_table"), "row_id", "pos", "item")
        out = one if out is None else out.unionByName(one)
    return out
