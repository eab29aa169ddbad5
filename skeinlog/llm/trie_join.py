"""Prefix-tree join of the sets in memory: which sets are linked, directly or through others.

Sets are stored in a trie under one global order of elements, and sets to look up walk it together,
a level at a time: the overlap of a set with a path is counted once for all sets below that path, and a
subtree is left as soon as its sizes, or the overlap so far and what can still come, cannot do.

Which subtrees a set enters is told by an index of each set's last elements, the infrequent ones at the trie's leaves:
linked sets share one of those, so a walk is led to the leaves that may do and leaves the others' branches untouched.
The bounds on size and overlap then prune on the way down, for all sets that take a path at once. Without the index a
walk from the root by the bounds alone would enter every branch of frequent elements before they bite.
"""

from __future__ import annotations

import numpy as np

#: Rows of a walk (set and node) that are expanded at a time.
WALK = 1 << 20


def _ragged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all [start, end) in a row, and where each range begins in that row."""
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    return np.repeat(starts - begins, lengths) + np.arange(int(lengths.sum())), begins


class Trie:
    """A path-compressed trie of sets, whose elements are in one global order, frequent ones first.

    Nodes are numbered breadth first, so that the children of a node are consecutive. A node has the
    elements on the edge above it (elems[elem_at[i]:elem_at[i + 1]]), the depth at its end, the least
    and greatest size of the sets at or below it, and the set that ends there.
    """

    def __init__(self, sets: list[np.ndarray], p: int, q: int, levels: np.ndarray | None = None):
        """sets: sorted distinct hashes, no set twice. levels: how frequent hashes are in the whole corpus, by
        their low bits; the order is by falling level, then by hash, and so the same in every tree."""
        self.p, self.q = p, q
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        level = np.zeros(len(values), np.int64) if levels is None else levels[(values & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.int64)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-level, kind="stable")] = np.arange(len(values))
        self.universe = len(values)
        self.ranked = [np.sort(r) for r in np.split(rank[inverse.ravel()], np.cumsum(self.sizes)[:-1])]
        keys = [r.astype(">u4").tobytes() for r in self.ranked]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self._build()
        self._index()

    def _build(self) -> None:
        parent, begin, end, owner = [-1], [0], [0], [0]  # the root; owner: a set whose elements the edge has
        self.at_node = np.zeros(len(self.sizes), np.int64)
        path, last = [0], None
        for s in self.order:
            elems = self.ranked[s]
            common = 0
            if last is not None:
                k = min(len(last), len(elems))
                differ = np.flatnonzero(last[:k] != elems[:k])
                common = int(differ[0]) if len(differ) else k
            while begin[path[-1]] >= common and len(path) > 1:
                path.pop()
            if (top := path[-1]) and end[top] > common:  # the edge is split: its upper part becomes a new node
                parent.append(parent[top]), begin.append(begin[top]), end.append(common), owner.append(owner[top])
                path[-1] = parent[top] = len(parent) - 1
                begin[top] = common
            if len(elems) > common:
                parent.append(path[-1]), begin.append(common), end.append(len(elems)), owner.append(s)
                path.append(len(parent) - 1)
            self.at_node[s] = path[-1]
            last = elems
        self._number(np.array(parent), np.array(begin), np.array(end), np.array(owner))

    def _number(self, parent, begin, end, owner) -> None:
        n = len(parent)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[parent[i]].append(i)
        bfs, at = [0], 0
        self.child_at = np.zeros(n + 1, np.int64)
        while at < len(bfs):
            self.child_at[at] = len(bfs)
            bfs += kids[bfs[at]]
            at += 1
        self.child_at[n] = n
        new = np.empty(n, np.int64)
        new[bfs] = np.arange(n)
        self.at_node = new[self.at_node]
        self.depth = end[bfs]
        self.elem_at = np.concatenate(([0], np.cumsum(end[bfs] - begin[bfs])))
        self.elems = np.concatenate([self.ranked[owner[i]][begin[i] : end[i]] for i in bfs]) if n > 1 else np.zeros(0, np.int64)
        self.parent = np.where(parent[bfs] >= 0, new[parent[bfs]], -1)
        self.least, self.most = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        np.minimum.at(self.least, self.at_node, self.sizes)
        np.maximum.at(self.most, self.at_node, self.sizes)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.least[p], self.most[p] = min(self.least[p], self.least[i]), max(self.most[p], self.most[i])
        self.floor = np.zeros(n, np.int64)  # nodes above
        for i in range(1, n):
            self.floor[i] = self.floor[self.parent[i]] + 1
        self.set_at = np.full(n, -1, np.int64)  # distinct sets end at distinct nodes
        self.set_at[self.at_node] = np.arange(len(self.sizes))

    def _index(self) -> None:
        """Of each element, the sets that have it among their last ones. Linked sets share at least p / q of
        either, so the last element that they share is among the last n - ceil(n p / q) + 1 of both."""
        self.flat, self.flat_at = np.concatenate(self.ranked), np.concatenate(([0], np.cumsum(self.sizes)))
        last = self.sizes + (-self.sizes * self.p) // self.q + 1
        at, begins = _ragged(self.flat_at[1:] - last, self.flat_at[1:])
        self.last_at = np.append(begins, len(at))
        self.last = self.flat[at]
        owner = np.repeat(np.arange(len(last)), last)
        order = np.argsort(self.last, kind="stable")
        self.having = owner[order]
        self.having_at = np.searchsorted(self.last[order], np.arange(self.universe + 1))

    def links(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links (x, y) of those sets with all others."""
        at, begins = _ragged(self.last_at[sets], self.last_at[sets + 1])
        cost = np.add.reduceat(np.diff(self.having_at)[self.last[at]], begins) if len(at) else np.zeros(0, np.int64)
        cost = cost + self.sizes[sets]
        found, first = [(np.zeros(0, np.int64),) * 2], 0
        ends = np.cumsum(cost)
        while first < len(sets):  # so many sets at once that memory is bounded
            end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + WALK, side="right")))
            found.append(self._walk(sets[first:end]))
            first = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _walk(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q, n_nodes = self.p, self.q, len(self.parent)
        # where to go: the nodes of sets that share a last element, and all nodes above them
        at, begins = _ragged(self.last_at[sets], self.last_at[sets + 1])
        elems = self.last[at]
        who = np.repeat(np.arange(len(sets)), np.diff(np.append(begins, len(at))))
        to, begins = _ragged(self.having_at[elems], self.having_at[elems + 1])
        who = np.repeat(who, np.diff(np.append(begins, len(to))))
        y, a = self.having[to], self.sizes[sets[who]]
        fits = (y != sets[who]) & (self.sizes[y] * p <= a * q) & (self.sizes[y] * q >= a * p)
        step = np.unique(who[fits] * n_nodes + self.at_node[y[fits]])
        wanted = [step]
        while len(step):
            above = self.parent[step % n_nodes]
            step = np.unique((step // n_nodes * n_nodes + above)[above >= 0])
            wanted.append(step)
        wanted = np.unique(np.concatenate(wanted))
        who, node = wanted // n_nodes, wanted % n_nodes
        # the elements of the sets that walk, as sorted keys
        mine, begins = _ragged(self.flat_at[sets], self.flat_at[sets + 1])
        keys = np.repeat(np.arange(len(sets)), self.sizes[sets]) * self.universe + self.flat[mine]
        key_end = np.append(begins[1:], len(mine))
        here = node == 0
        state, overlap = wanted[here], np.zeros(int(here.sum()), np.int64)
        xs, ys = [], []
        for floor in range(1, int(self.floor[node].max(initial=0)) + 1):
            now = self.floor[node] == floor
            w, v = who[now], node[now]
            up = w * n_nodes + self.parent[v]
            i = np.searchsorted(state, up)
            alive = i < len(state)
            alive[alive] = state[i[alive]] == up[alive]
            w, v, above = w[alive], v[alive], overlap[i[alive]]
            if not len(w):
                break
            picked, begins = _ragged(self.elem_at[v], self.elem_at[v + 1])
            ask = np.repeat(w, self.elem_at[v + 1] - self.elem_at[v]) * self.universe + self.elems[picked]
            i = np.searchsorted(keys, ask)
            i[i == len(keys)] = 0
            both = above + np.add.reduceat((keys[i] == ask).astype(np.int64), begins)
            a = self.sizes[sets[w]]
            last = w * self.universe + self.elems[self.elem_at[v + 1] - 1]
            to_come = np.minimum(key_end[w] - np.searchsorted(keys, last, side="right"), self.most[v] - self.depth[v])
            fits = ((p + q) * (both + to_come) >= p * (a + self.least[v])) & (self.least[v] * p <= a * q) & (self.most[v] * q >= a * p)
            w, v, both, a = w[fits], v[fits], both[fits], a[fits]
            state, overlap = w * n_nodes + v, both
            y = self.set_at[v]
            hit = (y >= 0) & (y != sets[w])
            hit[hit] = (p + q) * both[hit] >= p * (a[hit] + self.sizes[y[hit]])
            xs.append(sets[w[hit]])
            ys.append(y[hit])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + xs), np.concatenate(none + ys)


def components(sets: list[np.ndarray], p: int, q: int, levels: np.ndarray | None = None, known: np.ndarray | None = None, probes: np.ndarray | None = None) -> np.ndarray:
    """For each distinct set the least index linked with it, directly or through others.

    Sets look up their links in the trie, in batches that grow: those outside the largest component found
    so far, until none is left that has not. Links between two sets of that component would join nothing,
    and any other has an end that looked up its links: no component is missed, and a group of near copies
    costs about one look-up. known: for each set the least index of a set it is known to be joined with.

    probes: which sets may look up (all if not given); then only links that one of these has are looked for.
    One that may is left out only if it is in one component with all sets that may not.
    """
    label = np.arange(len(sets)) if known is None else known.copy()
    if len(sets) < 2:
        return label
    trie = Trie(sets, p, q, levels)
    silent = np.zeros(len(sets), bool) if probes is None else ~probes
    asked, batch = silent.copy(), 1
    while True:
        todo = ~asked
        if silent.any():
            if (label[silent] == (anchor := label[silent][0])).all():
                todo &= label != anchor
        elif batch > 1:  # the first to ask is anyone
            todo &= label != int(np.bincount(label).argmax())
        todo = np.flatnonzero(todo)
        if not len(todo):
            return label
        todo = todo[:batch]
        asked[todo] = True
        x, y = trie.links(todo)
        label = merge(label, x, y)
        batch *= 8


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label, the least index of each component, after joining those of x[i] and y[i]."""
    pairs = np.stack((label[x], label[y]), axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    root = {int(i): int(i) for i in np.unique(pairs)}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    to = np.arange(len(label))
    for i in root:
        to[i] = find(i)
    return to[label]
