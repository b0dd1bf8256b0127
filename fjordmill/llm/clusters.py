"""Grouping records into similarity clusters, each described by its size and most typical members.

Records carry a group and a set of features. A group of more than BLOCK records is cut into blocks by a hash of the id.
1. Per block a cluster-feature tree is grown. Its entries are (n, linear sum, square sum): a record goes down to the
   nearest child at each node and is absorbed by the nearest entry if that entry's radius stays small; else it opens
   an entry. A node with more than BRANCH children splits. If more than LEAVES entries hold several records, they are
   inserted into a new tree of greater radius.
2. The leaf entries are mergeable: those of FAN blocks at a time are inserted into one tree, level by level, until one
   tree per group is left; no task sees more than FAN times MOST_LEAVES entries.
3. Ward agglomeration joins the leaf entries of a group that hold several records as long as the merged radius allows:
   its Ward clusters.
4. One full pass assigns each record to its nearest leaf entry, and so to a Ward cluster, or, if it is farther than
   TIGHT radii from all of them, to the outliers.
5. An exact linkage starts from these clusters, which are its cells (a Ward cluster above BLOCK records is taken leaf
   by leaf). A record can only be linked to a member of another cell if it lies near enough to a leaf of it (triangle
   inequality: linked records differ in at most (1 - s) / (1 + s) of the sum of their sizes) and shares enough with
   the union of that leaf; only then it visits the cell: outliers any cell, members of a cell only larger ones. Linked
   records are joined into components; a component of ``least`` or more is a cluster, all else is noise.

What is shuffled is each record once per pass plus its visits. A cell that is still above BLOCK is divided by the id;
a record linked to the cell's most central record needs no further comparison there, all others visit every part of
the cell. Outliers are near nothing, so no summary can rule them out for each other: they are compared block by block
(OUTLIERS rows a block), the one part that is quadratic, in the outliers of one group. Inside a task only records that
aren't in one component yet are compared.

Groups of one block go through 1 to 5 within their task.

Within a task records are rows of a matrix over the features that occur among them: the records of a block should have
some thousands of features in all.

``radius`` should be about that of two linked records: sqrt((1 - s) / (1 + s) * size / 2) for sets of a usual size. It
decides how much is compared and what the Ward clusters are, not which records are linked.

Edge cases: null sets and sets below ``smallest`` features are noise; records with a null group or id are noise;
repeated records (equal id) are one record, of their least group and set; equal records link; ties for the most typical member go
to the least id; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordmill.operators.blocks import column, runs
from fjordmill.operators.components import roots
from fjordmill.session import Workspace

BLOCK = 2048
LEAVES = 512
#: Leaf entries of the largest group's tree: as many as Ward's table of costs may hold in one task.
MOST_LEAVES = 4096
BRANCH = 32
#: Radii from a leaf entry's center within which a record belongs to it.
TIGHT = 1.6
#: Outliers of a group that are compared in one task with each other, or with another such block.
OUTLIERS = 8192
FAN = 16
CHUNK = 256


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the elements of an Arrow array of lists."""
    lists = pa.concat_arrays([lists])
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), np.diff(off)), flat[off[0] : off[-1]]


def dense(*lists: pa.Array) -> list[np.ndarray]:
    """Sets as rows of 0 and 1 over the features that occur among all of them."""
    parts = [_flat(x) for x in lists]
    features, column = np.unique(np.concatenate([f for _, f in parts]), return_inverse=True)
    out, at = [], 0
    for (row, flat), x in zip(parts, lists):
        m = np.zeros((len(x), max(1, len(features))), np.float32)
        m[row, column[at : at + len(flat)]] = 1
        at += len(flat)
        out.append(m)
    return out


class _Node:
    __slots__ = ("n", "ls", "ss", "kids", "ids")

    def __init__(self, n, ls, ss, kids=None, ids=None):
        self.n, self.ls, self.ss, self.kids, self.ids = n, ls, ss, kids, ids

    def near(self, centers: np.ndarray) -> np.ndarray:
        own = self.ls / self.n[:, None]
        return ((own * own).sum(axis=1)[None] - 2 * centers @ own.T).argmin(axis=1)

    def take(self, at: np.ndarray) -> _Node:
        return _Node(self.n[at], self.ls[at], self.ss[at], [self.kids[i] for i in at.tolist()] if self.kids is not None else None, self.ids[at] if self.ids is not None else None)


class Tree:
    """A cluster-feature tree."""

    def __init__(self, width: int, radius: float, branch: int = BRANCH):
        self.radius2, self.branch, self.count = radius * radius, branch, 0
        self.root = _Node(np.zeros(0), np.zeros((0, width), np.float32), np.zeros(0), ids=np.zeros(0, np.int64))

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> np.ndarray:
        """Add entries (records are entries of one), in turns; the number of the leaf entry of each."""
        where = np.full(len(n), -1, np.int64)
        for a in range(0, len(n), CHUNK):
            pieces = self._into(self.root, n, ls, ss, np.arange(a, min(a + CHUNK, len(n))), where)
            while len(pieces) > 1:
                self.root = self._above(pieces)
                pieces = self._split(self.root)
            self.root = pieces[0]
        return where

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, linear sums, square sums) of the leaf entries by number."""
        leaves, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.kids is None:
                leaves.append(node)
            else:
                todo += node.kids
        order = np.argsort(np.concatenate([x.ids for x in leaves]))
        return tuple(np.concatenate([getattr(x, part) for x in leaves])[order] for part in ("n", "ls", "ss"))

    def _above(self, kids: list[_Node]) -> _Node:
        return _Node(np.array([k.n.sum() for k in kids]), np.stack([k.ls.sum(axis=0) for k in kids]), np.array([k.ss.sum() for k in kids]), list(kids))

    def _into(self, node: _Node, n, ls, ss, at, where) -> list[_Node]:
        if node.kids is None:
            self._absorb(node, n, ls, ss, at, where)
            return self._split(node)
        near = node.near(ls[at] / n[at][:, None])
        kids = []
        for k, kid in enumerate(node.kids):
            own = at[near == k]
            kids += self._into(kid, n, ls, ss, own, where) if len(own) else [kid]
        return self._split(self._above(kids))

    def _absorb(self, node: _Node, n, ls, ss, at, where) -> None:
        if len(node.n):
            near = node.near(ls[at] / n[at][:, None])
            both, sums, squares = node.n[near] + n[at], node.ls[near] + ls[at], node.ss[near] + ss[at]
            ok = squares / both - (sums * sums).sum(axis=1) / both**2 <= self.radius2
            to = near[ok]
            where[at[ok]] = node.ids[to]
            np.add.at(node.n, to, n[at[ok]])
            np.add.at(node.ss, to, ss[at[ok]])
            np.add.at(node.ls, to, ls[at[ok]])
            at = at[~ok]
        new_n, new_ls, new_ss, new_ids = [], [], [], []
        while len(at):  # what fits nowhere opens an entry, with all the others that lie about it
            first, rest = at[0], at[1:]
            both, sums, squares = n[first] + n[rest], ls[first] + ls[rest], ss[first] + ss[rest]
            ok = squares / both - (sums * sums).sum(axis=1) / both**2 <= self.radius2 / 2
            own = np.concatenate([[first], rest[ok]])
            where[own] = self.count
            new_n.append(n[own].sum())
            new_ls.append(ls[own].sum(axis=0))
            new_ss.append(ss[own].sum())
            new_ids.append(self.count)
            self.count += 1
            at = rest[~ok]
        if new_n:
            node.n, node.ss = np.append(node.n, new_n), np.append(node.ss, new_ss)
            node.ls, node.ids = np.concatenate([node.ls, np.stack(new_ls)]), np.append(node.ids, new_ids)

    def _split(self, node: _Node) -> list[_Node]:
        """The node, or the nodes it splits into: by the two children farthest from each other (seen from the mean)."""
        done, todo = [], [node]
        while todo:
            x = todo.pop()
            m = len(x.n)
            if m <= self.branch:
                done.append(x)
                continue
            c = x.ls / x.n[:, None]
            one = ((c - c.mean(axis=0)) ** 2).sum(axis=1).argmax()
            d_one = ((c - c[one]) ** 2).sum(axis=1)
            d_two = ((c - c[d_one.argmax()]) ** 2).sum(axis=1)
            side = d_one <= d_two
            if side.all() or not side.any():
                side = np.arange(m) < m // 2
            todo += [x.take(np.nonzero(side)[0]), x.take(np.nonzero(~side)[0])]
        return done


def condense(n, ls, ss, radius: float, most: int, last: bool = False):
    """(n, ls, ss) of the leaf entries of a tree, at most ``most``. Entries of several records come first: if there
    are too many, the radius grows until they fit. Entries of one record fill what is left, and go at the last level."""
    while True:
        tree = Tree(ls.shape[1], radius)
        tree.insert(n, ls, ss)
        n, ls, ss = tree.entries()
        several = n > 1.5
        if several.sum() <= most:
            keep = np.nonzero(several)[0]
            if not last:
                keep = np.sort(np.concatenate([keep, np.nonzero(~several)[0][: most - len(keep)]]))
            return n[keep], ls[keep], ss[keep]
        n, ls, ss, radius = n[several], ls[several], ss[several], radius * 1.3


def ward(n: np.ndarray, ls: np.ndarray, ss: np.ndarray, radius: float) -> np.ndarray:
    """Labels of the entries after Ward agglomeration: always the two whose union adds least to the sum of squares,
    as long as the union's radius stays within bounds."""
    m = len(n)
    label = np.arange(m)
    if m < 2:
        return label
    n, ls, ss = n.astype(float).copy(), ls.astype(np.float64).copy(), ss.astype(float).copy()
    c = ls / n[:, None]
    sq = (c * c).sum(axis=1)
    cost = (n[:, None] * n[None] / (n[:, None] + n[None])) * np.maximum(sq[:, None] + sq[None] - 2 * c @ c.T, 0)
    np.fill_diagonal(cost, np.inf)
    best = cost.argmin(axis=1)
    low = cost[np.arange(m), best]
    while m > 1:
        i = int(low.argmin())
        if not np.isfinite(low[i]):
            break
        j = int(best[i])
        both = n[i] + n[j]
        total = ls[i] + ls[j]
        if (ss[i] + ss[j]) / both - (total @ total) / both**2 > radius * radius:
            cost[i, j] = cost[j, i] = np.inf
            for x in (i, j):
                best[x] = cost[x].argmin()
                low[x] = cost[x, best[x]]
            continue
        n[i], ls[i], ss[i] = both, total, ss[i] + ss[j]
        label[label == j] = i
        c[i] = ls[i] / n[i]
        sq[i] = c[i] @ c[i]
        row = n[i] * n / (n[i] + n) * np.maximum(sq[i] + sq - 2 * c @ c[i], 0)
        row[i] = np.inf
        row[np.isinf(cost[i]) & np.isinf(cost[j])] = np.inf
        cost[j], cost[:, j] = np.inf, np.inf
        gone = label != np.arange(len(label))
        row[gone] = np.inf
        cost[i], cost[:, i] = row, row
        stale = np.nonzero((best == i) | (best == j) | (row < low))[0]
        best[stale] = cost[stale].argmin(axis=1)
        low[stale] = cost[stale, best[stale]]
        low[j] = np.inf
        best[i] = row.argmin()
        low[i] = row[best[i]]
    return np.unique(label, return_inverse=True)[1]


def nearest(x: np.ndarray, size: np.ndarray, centers: np.ndarray, tight: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each record, -1 where none is within ``tight``, and the squared distance to it."""
    if not len(centers):
        return np.full(len(x), -1), np.zeros(len(x))
    d = size[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)[None]
    at = d.argmin(axis=1)
    d2 = np.maximum(d[np.arange(len(x)), at], 0).astype(np.float64)
    return np.where(d2 <= tight * tight, at, -1), d2


def may_reach(x, size, centers, reach, either, extra, least, most, similarity: float) -> np.ndarray:
    """Which leaves could hold a record that is linked to a record of x. reach: greatest distance of a member from the
    leaf's center; either: union of the members' features; extra: the most features of a member beside the leaf's core;
    least, most: their sizes."""
    size = size.astype(np.float64)
    apart = np.sqrt(np.maximum(size[:, None] - 2 * (x @ centers.T).astype(np.float64) + (centers.astype(np.float64) ** 2).sum(axis=1)[None], 0))
    bound = np.sqrt((1 - similarity) / (1 + similarity) * (size[:, None] + most[None]))
    # no member shares more with the record than the union of all members does, or the core and the most that a member
    # has beside it, nor has a member fewer features than the least
    share = np.minimum(np.minimum(x @ either.T, x @ (centers >= 0.5).astype(np.float32).T + extra[None]).astype(np.float64), most[None])
    return (apart <= bound + reach[None] + 1e-2) & (share >= similarity * (size[:, None] + np.maximum(least[None], share) - share) - 1e-6)


def connect(x: np.ndarray, leaf: np.ndarray, similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """Component of each row: the least index of the rows it is linked with, directly or through others. Rows of one
    leaf should lie together. A row is compared only with rows that aren't in its component yet and whose leaf it can
    reach; with ``side`` (0 and 1) only rows of different sides are compared. Counts are compared as float64: float32 has
    too few digits for pairs right at the threshold."""
    m = len(x)
    size = x.sum(axis=1).astype(np.float64)
    label, open_ = np.arange(m), np.ones(m, bool) if side is None else side == 0
    across = None if side is None else np.nonzero(side == 1)[0]
    starts = np.concatenate([[0], np.nonzero(np.diff(leaf))[0] + 1])
    own_leaf = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, m)))
    either, least, most = np.maximum.reduceat(x, starts, axis=0), np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
    while True:
        left = np.nonzero(open_)[0]
        if not len(left):
            return label
        # the greatest component that is open goes first, so that its rows are out of the way of the others
        of, count = np.unique(label[left], return_counts=True)
        if count.max() > CHUNK:
            batch = left[label[left] == of[count.argmax()]][: 4 * CHUNK]
            others = left if across is None else across
            others = others[label[others] != label[batch[0]]]
        else:
            batch, others = left[:CHUNK], left if across is None else across
        open_[batch] = False
        if len(others) > CHUNK:
            share = np.minimum((x[batch] @ either.T).astype(np.float64), most[None])
            near = (share >= similarity * (size[batch][:, None] + np.maximum(least[None], share) - share) - 1e-6).any(axis=0)
            others = others[near[own_leaf[others]]]
        for a in range(0, len(others), 4 * CHUNK):
            o = others[a : a + 4 * CHUNK]
            common = (x[batch] @ x[o].T).astype(np.float64)
            i, j = np.nonzero(common >= similarity * (size[batch][:, None] + size[o][None] - common) - 1e-6)
            p, q = label[batch[i]], label[o[j]]
            off = p != q
            if off.any():
                label = _joined(label, p[off], q[off])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components a and b pairwise; the least index names a component."""
    low = np.arange(len(label))
    while True:
        new = low.copy()
        m = np.minimum(low[a], low[b])
        for x in (a, b, low[a], low[b]):
            np.minimum.at(new, x, m)
        new = new[new]
        if (new == low).all():
            return low[label]
        low = new


def _sparse(ls: np.ndarray, features: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Linear sums as lists of features and lists of their sums."""
    row, col = np.nonzero(ls)
    off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ls)))]).astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.array(features[col])), pa.ListArray.from_arrays(off, pa.array(ls[row, col].astype(np.float64)))


def _sums(features: pa.Array, sums: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: (linear sums, features)."""
    row, flat = _flat(features)
    weight = _flat(sums)[1]
    kinds, column = np.unique(flat, return_inverse=True)
    ls = np.zeros((len(features), max(1, len(kinds))), np.float32)
    ls[row, column] = weight
    return ls, kinds if len(kinds) else np.zeros(1, np.int64)


GROWN = "kind int, grp string, block int, blocks int, id long, ward int, root long, n double, features array<long>, sums array<double>"
_GROWN = ["kind", "grp", "block", "blocks", "id", "ward", "root", "n", "features", "sums"]


def _grower(radius: float, ward_radius: float, similarity: float | None):
    """Rows sorted by (grp, block) -> of groups of one block each record with its Ward cluster and component (kind 0),
    of larger groups the leaf entries of each block (kind 1)."""

    def run(batches):
        for t, at in runs(batches, ["grp", "block"]):
            lists, ids, blocks, block = column(t, "tokens"), t.column("id").to_numpy(), t.column("blocks").to_numpy(), t.column("block").to_numpy()
            done, label, root = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                part = lists.slice(a, b - a)
                (x,) = dense(part)
                size = x.sum(axis=1)
                n, ls, ss = condense(np.ones(b - a), x, size, radius, LEAVES, last=bool(blocks[a] == 1))
                if blocks[a] == 1:
                    leaf = nearest(x, size, ls / n[:, None].astype(np.float32), TIGHT * radius)[0]
                    own = np.append(ward(n, ls, ss, ward_radius), -1)[leaf]
                    done.append(np.arange(a, b))
                    label.append(own)
                    if similarity is not None:
                        order = np.lexsort((leaf, own))
                        comp = np.empty(b - a, np.int64)
                        comp[order] = connect(x[order], leaf[order], similarity)
                        least = np.full(b - a, np.iinfo(np.int64).max)
                        np.minimum.at(least, comp, ids[a:b])
                        root.append(np.where(np.bincount(comp, minlength=b - a)[comp] > 1, least[comp], np.iinfo(np.int64).min))
                    continue
                features, sums = _sparse(ls, np.unique(_flat(part)[1]))
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(k, np.int32)), column(t, "grp").take(pa.array(np.full(k, a))), pa.array(np.full(k, block[a], np.int32)), pa.array(np.full(k, blocks[a], np.int32)),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(n.astype(float)), features, sums], names=_GROWN)
            if done:
                row = pa.array(np.concatenate(done))
                k = len(row)
                comp = np.concatenate(root) if root else np.full(k, np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(k, np.int32)), column(t, "grp").take(row), pa.array(np.zeros(k, np.int32)), pa.array(np.ones(k, np.int32)), pa.array(ids).take(row),
                     pa.array(np.concatenate(label).astype(np.int32)), pa.array(comp, mask=comp == np.iinfo(np.int64).min), pa.nulls(k, pa.float64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.float64()))], names=_GROWN)

    return run


ENTRIES = "grp string, block int, blocks int, leaf int, ward int, n double, features array<long>, sums array<double>"


def _merger(radius: float, ward_radius: float | None):
    """Leaf entries sorted by (grp, block) -> those of one tree per (grp, block); with a radius for Ward, the last
    level, their Ward clusters too."""

    def run(batches):
        for t, at in runs(batches, ["grp", "block"], 1 << 12):
            features, sums, n_all = column(t, "features"), column(t, "sums"), t.column("n").to_numpy()
            block, blocks = t.column("block").to_numpy(), t.column("blocks").to_numpy()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                ls, kinds = _sums(features.slice(a, b - a), sums.slice(a, b - a))
                # features are 0 or 1, so their squares are themselves
                n, ls, ss = condense(n_all[a:b].astype(float), ls, ls.sum(axis=1).astype(float), radius, int(np.clip(4 * blocks[a], LEAVES, MOST_LEAVES)), last=ward_radius is not None)
                label = ward(n, ls, ss, ward_radius) if ward_radius is not None else np.zeros(len(n), int)
                f, s = _sparse(ls, kinds)
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [column(t, "grp").take(pa.array(np.full(k, a))), pa.array(np.full(k, block[a], np.int32)), pa.array(np.full(k, blocks[a], np.int32)), pa.array(np.arange(k, dtype=np.int32)),
                     pa.array(label.astype(np.int32)), pa.array(n.astype(float)), f, s], names=["grp", "block", "blocks", "leaf", "ward", "n", "features", "sums"])

    return run


ASSIGNED = "grp string, part int, id long, tokens array<long>, leaf int, ward int, d2 double, extra int"


def _assigner(tight: float):
    """Per (grp, part) the group's leaf entries, then records -> records with leaf, Ward cluster (-1: outlier) and
    squared distance from the leaf's center, and the number of features it has beside the leaf's core (the features
    of half of its entry or more)."""

    def run(batches):
        for t, at in runs(batches, ["grp", "part"]):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                s = t.slice(a, b - a)
                model, rows = s.filter(s.column("is_leaf")), s.filter(pc.invert(s.column("is_leaf")))
                if not rows.num_rows:
                    continue
                centers, x = _aligned(model, column(rows, "tokens"))
                core = np.concatenate([centers >= 0.5, np.zeros((1, x.shape[1]), bool)])
                name, label = np.append(model.column("leaf").to_numpy(), -1), np.append(model.column("ward").to_numpy(), -1)
                for c in range(0, len(x), 4096):
                    y = x[c : c + 4096]
                    size = y.sum(axis=1)
                    leaf, d2 = nearest(y, size, centers, tight)
                    extra = size - (y * core[leaf]).sum(axis=1)
                    part = rows.slice(c, len(y))
                    yield pa.RecordBatch.from_arrays(
                        [*(column(part, k) for k in ("grp", "part", "id", "tokens")), pa.array(name[leaf].astype(np.int32)), pa.array(label[leaf].astype(np.int32)), pa.array(d2), pa.array(extra.astype(np.int32))],
                        names=["grp", "part", "id", "tokens", "leaf", "ward", "d2", "extra"])

    return run


def _aligned(model: pa.Table, *lists: pa.Array) -> list[np.ndarray]:
    """Centers of leaf entries, and further sets, over the same features."""
    members, *others = dense(column(model, "tokens"), *lists)
    row, col = np.nonzero(members)
    weight = _flat(column(model, "sums"))[1]
    centers = np.zeros(members.shape, np.float32)
    centers[row, col] = weight  # both are ordered by row and feature
    return [centers / model.column("n").to_numpy()[:, None].astype(np.float32), *others]


VISITS = "grp string, cell int, sub int, other int, side int, id long, leaf int, tokens array<long>, to long"
#: The cell of the outliers.
OUT = -1


def _visitor(similarity: float, block: int, outliers: int):
    """Per (grp, part) the group's leaves with what holds for their members, then records -> one row per cell that a
    record belongs to or visits; links to the most central record of a cell have that record in ``to``. Blocks of
    outliers (sub, other) hold both blocks, the first as side 0."""

    def run(batches):
        for t, at in runs(batches, ["grp", "part"]):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                s = t.slice(a, b - a)
                model, rows = s.filter(s.column("is_leaf")), s.filter(pc.invert(s.column("is_leaf")))
                if not rows.num_rows or not model.num_rows:
                    continue
                loners = model.filter(pc.equal(model.column("leaf"), OUT)).column("members").to_pylist()
                model = model.filter(pc.not_equal(model.column("leaf"), OUT))
                out_blocks = max(1, -(-int(sum(loners)) // outliers))
                centers, either, central, x = _aligned(model, column(model, "either"), column(model, "central"), column(rows, "tokens"))
                count, reach, extra, least, most, name, label, hub = (model.column(c).to_numpy() for c in ("members", "reach", "extra", "least", "most", "leaf", "ward", "hub"))
                total = np.bincount(label, weights=count)
                cell_of = np.where(total[label] <= block, label, name + len(total))  # a Ward cluster, or a leaf of a large one
                cells, cell = np.unique(cell_of, return_inverse=True)
                # the outliers are the last cell, and count as the smallest
                weight = np.append(np.bincount(cell, weights=count), 0.0)
                cells, cell, k_out = np.append(cells, OUT), np.append(cell, len(cells)), len(cells)
                subs = np.maximum(1, np.ceil(weight / block)).astype(np.int64)
                at_leaf = np.full(int(name.max(initial=0)) + 2, -1)
                at_leaf[name] = np.arange(len(name))
                own_all, ids_all = at_leaf[rows.column("leaf").to_numpy()], rows.column("id").to_numpy()
                central, hub = np.concatenate([central, np.zeros((1, x.shape[1]), np.float32)]), np.append(hub, 0)
                step = int(np.clip((1 << 21) // max(1, len(name)), 64, 2048))
                for c in range(0, len(x), step):
                    y, own, ids = x[c : c + step], own_all[c : c + step], ids_all[c : c + step]
                    size, home = y.sum(axis=1), cell[own]
                    visit = np.zeros((len(y), len(cells)), bool)
                    if len(name):
                        r, lf = np.nonzero(may_reach(y, size, centers, reach, either, extra, least, most, similarity))
                        visit[r, cell[lf]] = True
                    # of two cells the smaller one's records visit
                    visit &= (weight[home][:, None] < weight[None]) | ((weight[home][:, None] == weight[None]) & (home[:, None] < np.arange(len(cells))[None]))
                    visit[np.arange(len(y)), home] = False
                    spread = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    sub = (spread % np.where(home == k_out, out_blocks, subs[home]).astype(np.uint64)).astype(np.int64)
                    common = (y * central[own]).sum(axis=1).astype(np.float64)
                    core = common >= similarity * (size + central[own].sum(axis=1) - common) - 1e-6
                    parted, out = subs[home] > 1, home == k_out
                    r, k = np.nonzero(visit)
                    loose = np.nonzero(parted & ~core)[0]  # not settled by the central record: these meet all of their cell
                    v_row, v_cell = np.concatenate([r, loose]), np.concatenate([k, home[loose]])
                    wide = np.repeat(np.arange(len(v_row)), subs[v_cell])
                    turn = np.arange(len(wide)) - np.repeat(np.cumsum(subs[v_cell]) - subs[v_cell], subs[v_cell])
                    tied = np.nonzero(parted & core)[0]
                    stay = np.nonzero(~(parted & ~core) & ~out)[0]
                    lone = np.repeat(np.nonzero(out)[0], out_blocks)
                    meets = np.tile(np.arange(out_blocks), int(out.sum()))
                    row = np.concatenate([stay, v_row[wide], lone, tied])
                    where = np.concatenate([home[stay], v_cell[wide], home[lone], home[tied]])
                    first = np.concatenate([sub[stay], turn, np.minimum(sub[lone], meets), np.full(len(tied), -1)])
                    plain, tail = np.zeros(len(stay) + len(wide), np.int64), np.zeros(len(tied), np.int64)
                    other = np.concatenate([plain, np.maximum(sub[lone], meets), tail])
                    side = np.concatenate([plain, (sub[lone] > meets).astype(np.int64), tail])
                    no_link = len(row) - len(tied)
                    took = pa.array(row + c)
                    yield pa.RecordBatch.from_arrays(
                        [column(rows, "grp").take(took), *(pa.array(v.astype(np.int32)) for v in (cells[where], first, other, side)), pa.array(ids[row]), column(rows, "leaf").take(took),
                         column(rows, "tokens").take(took), pa.array(np.concatenate([np.zeros(no_link, np.int64), hub[own[tied]]]), mask=np.arange(len(row)) < no_link)],
                        names=["grp", "cell", "sub", "other", "side", "id", "leaf", "tokens", "to"])

    return run


def _linker(similarity: float):
    """Rows sorted by (grp, cell, sub, other) -> (a, b): each linked record with the least record of its component
    there."""

    def run(batches):
        for t, at in runs(batches, ["grp", "cell", "sub", "other"]):
            lists = column(t, "tokens")
            ids, leaf, side, sub, other = (t.column(c).to_numpy() for c in ("id", "leaf", "side", "sub", "other"))
            out_a, out_b = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 2:
                    continue
                order = np.argsort(leaf[a:b], kind="stable")
                own = ids[a:b][order]
                (x,) = dense(lists.slice(a, b - a))
                comp = connect(x[order], leaf[a:b][order], similarity, side[a:b][order] if other[a] > sub[a] else None)
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, comp, own)
                linked = np.bincount(comp, minlength=b - a)[comp] > 1
                out_a.append(own[linked])
                out_b.append(least[comp[linked]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], names=["a", "b"])

    return run


def _parts(df: DataFrame) -> int:
    return max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _beside(model: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Records and, in front of them, a copy of their group's leaves per part of the group; columns of the model only
    are null in records."""
    kinds = {**dict(model.dtypes), **dict(rows.dtypes)}

    def side(df: DataFrame, is_leaf: bool) -> DataFrame:
        return df.select("grp", "part", F.lit(is_leaf).alias("is_leaf"), *(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))

    every, own = side(model.join(rows.select("grp", "part").distinct(), "grp"), True), side(rows, False)
    return every.unionByName(own).repartition(_parts(rows), "grp", "part").sortWithinPartitions("grp", "part", F.desc("is_leaf"))


class Clustering:
    """The Ward clusters of all records, and with a similarity their exact components: see the module's steps.

    rows: (grp string, id long, tokens array<long>)."""

    def __init__(self, rows: DataFrame, *, similarity: float | None, smallest: int = 6, radius: float = 2.2, ward_radius: float = 3.0, block: int = BLOCK, outliers: int = OUTLIERS, work: Workspace | None = None):
        self.outliers = outliers
        self.work = work = work or Workspace(rows.sparkSession, "clusters")
        self.radius, self.ward_radius, self.similarity, self.block = radius, ward_radius, similarity, block
        once = rows.where("grp is not null and id is not null").where(F.size("tokens") >= smallest).groupBy("id").agg(F.min(F.struct("grp", F.array_sort("tokens").alias("tokens"))).alias("r"))
        usable = work.put(once.select("r.grp", "id", "r.tokens"), "usable")
        big = work.put(usable.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "big")
        self.several = not big.isEmpty()
        placed = usable.join(big, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if self.several else usable.withColumn("blocks", F.lit(1))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("grp", "block", "blocks", "id", "tokens")
        ordered = placed.repartition(_parts(rows), "grp", "block").sortWithinPartitions("grp", "block", "id")
        self.grown = work.put(ordered.mapInArrow(_grower(radius, ward_radius, similarity), GROWN), "grown")
        if self.several:
            top = big.agg(F.max("blocks")).first()[0]
            self.assigned = self._assign(placed.where("blocks > 1"), top)

    def _assign(self, placed: DataFrame, blocks: int) -> DataFrame:
        """Merge the leaf entries of the blocks level by level, agglomerate, assign every record."""
        entries = self.grown.where("kind = 1").select("grp", "block", "blocks", "n", "features", "sums")
        while True:
            blocks, last = -(-blocks // FAN), blocks <= FAN
            ordered = entries.withColumn("block", F.floor(F.col("block") / FAN).cast("int")).repartition(_parts(placed), "grp", "block").sortWithinPartitions("grp", "block")
            entries = self.work.put(ordered.mapInArrow(_merger(self.radius, self.ward_radius if last else None), ENTRIES), "entries")
            if last:
                break
        self.model = entries.select("grp", "leaf", "ward", "n", F.col("features").alias("tokens"), "sums")
        rows = placed.select("grp", F.floor(F.col("block") / 8).cast("int").alias("part"), "id", "tokens")
        return self.work.put(_beside(self.model, rows, ["id", "tokens", "leaf", "ward", "n", "sums"]).mapInArrow(_assigner(TIGHT * self.radius), ASSIGNED), "assigned")

    def ward(self) -> DataFrame:
        """(grp, id, ward): the Ward cluster of each record that has one."""
        own = self.grown.where("kind = 0").select("grp", "id", "ward")
        return (own.unionByName(self.assigned.select("grp", "id", "ward")) if self.several else own).where("ward >= 0")

    def visits(self) -> DataFrame:
        """(grp, cell, sub, other, side, id, leaf, tokens, to) of the records of groups of several blocks."""
        told = self.assigned.groupBy("grp", "leaf").agg(
            F.first("ward").alias("ward"), F.count("*").cast("double").alias("members"), F.sqrt(F.max("d2") + 0.01).alias("reach"), F.max("extra").cast("float").alias("extra"), F.min(F.size("tokens")).cast("double").alias("least"), F.max(F.size("tokens")).cast("double").alias("most"),
            F.min_by(F.struct("id", "tokens"), F.struct("d2", "id")).alias("hub"))
        each = self.assigned.where(F.col("leaf") != OUT).select("grp", "leaf", F.explode("tokens").alias("f")).distinct().groupBy("grp", "leaf").agg(F.array_sort(F.collect_list("f")).alias("either"))
        model = told.join(each, ["grp", "leaf"], "left").join(self.model.select("grp", "leaf", "n", "tokens", "sums"), ["grp", "leaf"], "left")
        lists = [F.coalesce("either", F.expr("array()")).alias("either"), F.coalesce("n", F.lit(1.0)).alias("n"), F.coalesce("tokens", F.expr("array()")).alias("tokens"), F.coalesce("sums", F.expr("array()")).alias("sums")]
        model = model.select("grp", "leaf", "ward", "members", "reach", "extra", "least", "most", F.col("hub.id").alias("hub"), F.col("hub.tokens").alias("central"), *lists)
        model = self.work.put(model, "leaves")
        columns = ["id", "tokens", "leaf", "ward", "members", "reach", "extra", "least", "most", "hub", "central", "either", "n", "sums"]
        return self.work.put(_beside(model, self.assigned.select("grp", "part", "id", "tokens", "leaf"), columns).mapInArrow(_visitor(self.similarity, self.block, self.outliers), VISITS), "visits")

    def components(self) -> DataFrame:
        """(id, cluster): records with a neighbour, and the least id of their component."""
        done = self.grown.where("kind = 0 and root is not null").select("id", F.col("root").alias("cluster"))
        if not self.several:
            return done
        visits = self.visits()
        meet = visits.where("to is null").repartition(_parts(visits), "grp", "cell", "sub", "other").sortWithinPartitions("grp", "cell", "sub", "other")
        stars = meet.mapInArrow(_linker(self.similarity), "a long, b long").unionByName(visits.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
        return done.unionByName(roots(stars, self.work, "clusters").select(F.col("node").alias("id"), F.col("root").alias("cluster")))


def clusters(rows: DataFrame, *, similarity: float = 0.6, smallest: int = 6, least: int = 4, radius: float = 2.2, ward_radius: float = 3.0, block: int = BLOCK, outliers: int = OUTLIERS, work: Workspace | None = None) -> DataFrame:
    """(id, cluster): the clusters of ``least`` or more records; all other records are noise."""
    made = Clustering(rows, similarity=similarity, smallest=smallest, radius=radius, ward_radius=ward_radius, block=block, outliers=outliers, work=work)
    found = made.work.put(made.components(), "linked")
    sizes = found.groupBy("cluster").count().where(F.col("count") >= least).select("cluster")
    return found.join(sizes, "cluster", "left_semi").select("id", "cluster")


def ward_clusters(rows: DataFrame, *, smallest: int = 6, radius: float = 2.2, ward_radius: float = 3.0, block: int = BLOCK, work: Workspace | None = None) -> DataFrame:
    """(grp, id, ward): each record of ``smallest`` or more features that has a Ward cluster, numbered within its group;
    the others are outliers."""
    return Clustering(rows, similarity=None, smallest=smallest, radius=radius, ward_radius=ward_radius, block=block, work=work).ward()


def describe(members: DataFrame, typical: int = 1) -> DataFrame:
    """members: (grp, id, cluster, tokens). (grp, cluster, n, medoids): size and the members nearest to the centroid."""
    sizes = members.groupBy("cluster").agg(F.first("grp").alias("grp"), F.count("*").alias("n"))
    long_ = members.select("cluster", "id", F.explode("tokens").alias("f"))
    share = long_.groupBy("cluster", "f").agg(F.count("*").alias("k")).join(sizes, "cluster").select("cluster", "f", (F.col("k") / F.col("n")).alias("p"))
    # squared distance to the centroid: |x| - 2 x.c + |c|^2, and the last part is the same for all members
    near = long_.join(share, ["cluster", "f"]).groupBy("cluster", "id").agg(F.sum(1 - 2 * F.col("p")).alias("d"))
    if typical == 1:  # an aggregate: no cluster is sorted in one task
        medoids = near.groupBy("cluster").agg(F.array(F.min_by("id", F.struct("d", "id"))).alias("medoids"))
    else:
        ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("d", "id"))).where(F.col("r") <= typical)
        medoids = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("medoids"))
    return sizes.join(medoids, "cluster").select("grp", "cluster", "n", "medoids")
