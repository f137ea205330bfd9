"""External induced sorting of one shard's suffixes, with common-prefix values.

A suffix is of type S if it is smaller than the next one, else L; a leftmost S suffix has an L suffix before it. The leftmost S suffixes are sorted
first: their substrings by induction, which gives them names, then the string of names. From them all L suffixes follow in ascending order and all S
suffixes in descending order, each suffix being pushed to the queue of its first symbol when the suffix after it is taken out.

The queue is a priority queue by first symbol, first in, first out within a symbol (pushes arrive in sorted order), so that all that is queued for the least symbol
is taken out as one batch of arrays. Blocks beyond ``memory`` bytes go to unnamed scratch files of the task, which vanish with it. With each suffix
travels the length of the prefix that it shares with the one pushed before it: one more than the least such value among the suffixes taken out between the two.
Prefixes count up to ``cap``.

The string of names has an alphabet too large for batches by symbol; it is sorted by prefix doubling, of groups not yet told apart alone, and only as far as
``cap`` symbols of the text reach.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

FAR = np.iinfo(np.int32).max
#: Pairs of suffixes compared at a time, 64 symbols each at most.
PAIRS = 1 << 15


class Queue:
    """Arrays of (position, common prefix) by symbol; the largest symbols' blocks are written out when memory is short."""

    def __init__(self, symbols: int, memory: int):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="suffixes-")
        size = lambda b: sum(x[0].nbytes + x[1].nbytes for x in b if isinstance(x[0], np.ndarray))
        for s in sorted(range(len(self.blocks)), key=lambda s: -size(self.blocks[s])):
            if self.held <= self.memory // 2:
                break
            for k, x in enumerate(self.blocks[s]):
                if isinstance(x[0], np.ndarray):
                    start = self.file.seek(0, 2)
                    x[0].tofile(self.file)
                    x[1].tofile(self.file)
                    self.file.flush()
                    self.blocks[s][k] = (start, len(x[0]))
                    self.held -= x[0].nbytes + x[1].nbytes

    def _load(self, x) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(x[0], np.ndarray):
            self.held -= x[0].nbytes + x[1].nbytes
            return x
        self.file.seek(x[0])
        return np.fromfile(self.file, np.int64, x[1]), np.fromfile(self.file, np.int32, x[1])

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the symbol until none is left, those included that are pushed meanwhile. Small ones are joined."""
        while self.blocks[symbol]:
            now, self.blocks[symbol] = self.blocks[symbol], []
            some, n = [], 0
            for x in now:
                some.append(self._load(x))
                n += len(some[-1][0])
                if n > 1 << 20:
                    yield np.concatenate([a for a, _ in some]), np.concatenate([b for _, b in some])
                    some, n = [], 0
            if some:
                yield np.concatenate([a for a, _ in some]), np.concatenate([b for _, b in some])


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol is the least and S."""
    kind = np.int32 if len(t) < 2**31 else np.int64
    at = np.where(t[1:] != t[:-1], np.arange(len(t) - 1, dtype=kind), kind(len(t) - 1))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    del at
    s = np.ones(len(t), bool)
    s[:-1] = np.append(t[1:] > t[:-1], True)[nxt]
    return s


def runs_after(t: np.ndarray) -> np.ndarray:
    """How often each position's symbol repeats from there on."""
    kind = np.int32 if len(t) < 2**31 else np.int64
    here = np.arange(len(t), dtype=kind)
    end = np.where(np.append(t[1:] != t[:-1], True), here, kind(len(t)))
    end = np.minimum.accumulate(end[::-1])[::-1]
    return (np.minimum(end - here, FAR - 1) + 1).astype(np.int32)


class _Least:
    """The least common prefix of what was taken out since a symbol's last push."""

    def __init__(self, symbols: int):
        self.value = np.full(symbols, FAR, np.int64)

    def push(self, queue: Queue, target: np.ndarray, at: np.ndarray, lcp: np.ndarray, cap: int) -> None:
        """``lcp``: of every item taken out; ``target``: the symbol each pushes ``at`` to, or -1."""
        least = int(lcp.min()) if len(lcp) else FAR
        hit = np.flatnonzero(target >= 0)
        pushed = np.zeros(len(self.value), bool)
        if len(hit):
            order = hit[np.argsort(target[hit], kind="stable")]
            symbols, starts = np.unique(target[order], return_index=True)
            for s, group in zip(symbols.tolist(), np.split(order, starts[1:])):
                out = np.minimum.reduceat(lcp[: group[-1] + 1], np.concatenate([[0], group[:-1] + 1])).astype(np.int64)
                out[0] = min(int(self.value[s]), int(out[0]))
                queue.push(s, at[group], np.minimum(out + 1, cap).astype(np.int32))
                rest = lcp[group[-1] + 1 :]
                self.value[s] = int(rest.min()) if len(rest) else FAR
                pushed[s] = True
        self.value[~pushed] = np.minimum(self.value[~pushed], least)


def induce(t: np.ndarray, s: np.ndarray, symbols: int, seeds: np.ndarray, seed_lcp: np.ndarray, cap: int, memory: int, run: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the sorted leftmost S ones, as (positions, common prefix with the one before) in descending order of blocks' symbols.

    Within a symbol S suffixes come first, descending, then L suffixes, descending: one descending sequence. Common prefixes across symbols are 0."""
    large, least = Queue(symbols, memory // 2), _Least(symbols)
    kept = Queue(symbols, memory // 2)
    first = t[seeds]
    bounds = np.searchsorted(first, np.arange(symbols + 1))
    last = np.full(symbols, -1, np.int64)

    def out_of(at: np.ndarray, lcp: np.ndarray, c: int, want_s: bool, queue: Queue, low: _Least) -> None:
        before = at - 1
        ok = before >= 0
        sym = np.where(ok, t[before], 0).astype(np.int64)
        ok &= (s[before] & (sym <= c)) if want_s else (~s[before] & (sym >= c))
        low.push(queue, np.where(ok, sym, -1), before, lcp, cap)

    for c in range(symbols):
        fresh = True
        for at, lcp in large.take(c):
            if fresh:
                lcp = lcp.copy()
                lcp[0] = 0
                fresh = False
            kept.push(c, at, lcp)
            last[c] = at[-1]
            out_of(at, lcp, c, False, large, least)
        lo, hi = bounds[c], bounds[c + 1]
        if hi > lo:
            lcp = seed_lcp[lo:hi].copy()
            lcp[0] = 0 if fresh else (min(int(run[last[c]]), int(run[seeds[lo]]), cap) if run is not None else 0)
            out_of(seeds[lo:hi], lcp, c, False, large, least)
    small, least = Queue(symbols, memory // 2), _Least(symbols)
    for c in range(symbols - 1, -1, -1):
        previous = -1
        for at, lcp in small.take(c):
            if previous < 0:
                lcp = lcp.copy()
                lcp[0] = 0
            previous = at[-1]
            out_of(at, lcp, c, True, small, least)
            yield at, lcp
        blocks = list(kept.take(c))
        for k in range(len(blocks) - 1, -1, -1):
            at, lcp = blocks[k]
            # of the descending sequence: what was shared with the one before is now shared with the one after
            nxt = previous
            down = np.empty_like(lcp)
            down[1:] = lcp[::-1][:-1]
            if k == len(blocks) - 1:
                down[0] = 0 if nxt < 0 else (min(int(run[nxt]), int(run[at[-1]]), cap) if run is not None else 0)
            else:
                down[0] = blocks[k + 1][1][0]
            at = at[::-1]
            previous = at[-1]
            out_of(at, down, c, True, small, least)
            yield at, down


def _doubling(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``steps`` names at least; only groups not yet told apart are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while h < steps:
        tail = np.append(~head[1:], False)
        open_ = np.flatnonzero(~head | tail)
        if not len(open_):
            break
        at = order[open_]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        o = np.lexsort((ahead, rank[at]))
        at, ahead = at[o], ahead[o]
        order[open_] = at
        same = rank[at]
        new = np.concatenate([[True], (same[1:] != same[:-1]) | (ahead[1:] != ahead[:-1])])
        head[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    return order


def _packed(t: np.ndarray) -> np.ndarray:
    """Four symbols from each position on as one number; beyond the end the text goes on as if with a symbol of its own."""
    x = np.concatenate([t, np.full(4, 0xFFFF, np.uint16)]).astype(np.uint64)
    out = x[: len(t) + 1].copy()
    for k in (1, 2, 3):
        out |= x[k : k + len(t) + 1] << np.uint64(16 * k)
    return out


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, packed: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to ``cap``, of pairs not yet told apart: four symbols at a time where the text is held packed, else
    by comparing symbols, more and more."""
    if len(a) > PAIRS:
        return np.concatenate([_shared(t, a[i : i + PAIRS], b[i : i + PAIRS], cap, packed) for i in range(0, len(a), PAIRS)])
    n, out = len(t), np.zeros(len(a), np.int32)
    if packed is not None:
        # a suffix that ends is told from the other, as they end at different places
        live, x, y, k = np.arange(len(a)), a.copy(), b.copy(), 0
        while len(live) and k < cap:
            d = packed[x] ^ packed[y]
            apart = np.flatnonzero(d)
            low = d[apart]
            at = np.where(low & np.uint64(0xFFFF), 0, np.where(low & np.uint64(0xFFFF0000), 1, np.where(low & np.uint64(0xFFFF00000000), 2, 3)))
            out[live[apart]] = k + at
            same = np.flatnonzero(d == 0)
            live, x, y, k = live[same], x[same] + 4, y[same] + 4, k + 4
        out[live] = cap
        return np.minimum(out, cap)
    live, step = np.arange(len(a)), 4
    while len(live):
        x, y, done = a[live], b[live], out[live]
        width = min(step, cap)
        k = done[:, None] + np.arange(width)[None, :]
        i, j = x[:, None] + k, y[:, None] + k
        eq = (t[np.minimum(i, n - 1)] == t[np.minimum(j, n - 1)]) & (i < n) & (j < n) & (k < cap)
        good = np.where(eq.all(1), width, (~eq).argmax(1))
        out[live] = done + good
        live = live[(good == width) & (out[live] < cap)]
        step = min(64, step * 2)
    return np.minimum(out, cap)


def suffixes(t: np.ndarray, symbols: int, cap: int, memory: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``t``, sorted by their first ``cap`` symbols, in descending order: blocks of (positions, common prefix with the one before).

    ``t``: symbols below ``symbols``; the last must be 0. Other zeros end texts, and are compared like any symbol."""
    if len(t) < 2:
        if len(t):
            yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    # substrings by induction from any order within symbols, then names
    rough = lms[np.argsort(t[lms], kind="stable")]
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    far = np.zeros(len(rough), np.int32)
    found = [at[is_lms[at]] for at, _ in induce(t, s, symbols, rough, far, 1, memory)]
    by = np.concatenate([*found, lms[-1:]])[::-1]  # nothing comes after the last suffix to induce it; it is the least
    nxt = np.append(lms[1:], len(t) - 1)
    place = np.searchsorted(lms, by)
    length = nxt[place] - by + 1
    same = np.zeros(len(by), bool)
    if len(by) > 1:
        maybe = np.flatnonzero(length[1:] == length[:-1])
        at, to, size = by[maybe], by[maybe + 1], length[maybe]
        eq = np.ones(len(maybe), bool)
        live, k = np.arange(len(maybe)), 0
        while len(live):
            eq[live] &= t[at[live] + k] == t[to[live] + k]
            k += 1
            live = live[eq[live] & (size[live] > k)]
        same[maybe + 1] = eq
    names = np.empty(len(by), np.int64)
    names[place] = np.cumsum(~same) - 1
    # a name spans two symbols at least before the next begins
    order = _doubling(names, cap // 2 + 2)
    seeds = lms[order]
    seed_lcp = np.zeros(len(seeds), np.int32)
    packed = _packed(t) if t.dtype == np.uint16 and 8 * len(t) <= memory else None
    seed_lcp[1:] = _shared(t, seeds[:-1], seeds[1:], cap, packed)
    del packed
    block = None
    for block in induce(t, s, symbols, seeds, seed_lcp, cap, memory, runs_after(t)):
        yield block
    yield np.array([len(t) - 1]), np.array([int(t[block[0][-1]] == 0) if block else 0], np.int32)
