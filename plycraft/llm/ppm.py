"""Prediction by partial matching over bytes: count tables, a context trie, and scoring.

The model predicts each byte of a text, and an end symbol, from the longest context of up
to ``ORDER`` bytes that the trie has. Escapes follow method D: a context with q distinct
symbols in T observations escapes with q / 2T, half a count of each symbol. Symbols of a longer context are
excluded below it. In a trie of complete counts a context's symbols are a subset of its
suffix's, so what exclusion removes at the next level depends on the context alone, and
every conditional probability can be tabulated once: a table row per context, a column per
byte class, with the next context beside it. Scoring then walks all texts in step.

A trie of all contexts grows with the text, so ``lm`` tabulates only the contexts of up to
``LOW`` bytes that way. Longer contexts with the same last ``LOW + 1`` bytes form a table of
their own (``Part``), complete by itself above the low orders: ``answers`` gives from it the
probability that the trie of all contexts would give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 6
DISCOUNT = 0.5
START, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
SYMBOLS = 255  # what may follow: any byte but START (END stands for the end)
SEGMENT = 1024
#: Highest order whose contexts are tabulated in one place (at most 256**2).
LOW = 2


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A packed (order + 1)-gram for every predicted symbol: each text is preceded by
    ``order`` start bytes and followed by the end symbol."""
    n, rows = len(data), len(offsets) - 1
    if not rows:
        return np.zeros(0, np.uint64)
    sizes = np.diff(offsets)
    begin = offsets[:-1] + np.arange(rows) * (order + 1) + order
    out = np.full(n + rows * (order + 1) + 8, START, np.uint8)
    out[np.arange(n) + np.repeat(begin - offsets[:-1], sizes)] = data
    out[begin + sizes] = END
    windows = np.ndarray((n + rows * (order + 1) - order,), ">u8", out, strides=(1,))
    key = windows.astype(np.uint64) >> np.uint64(8 * (7 - order))
    return key[out[order : len(out) - 8] != START]


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, ascending."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def suffix(key: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of packed keys."""
    return key & np.uint64((1 << (8 * n)) - 1)


@dataclass
class Trie:
    """``logp[c, s]`` and ``step[c, s]``: log10 probability of class s in context c, and the
    context after it; ``cls`` maps bytes to classes; ``start`` is the context of a new text."""

    logp: np.ndarray
    step: np.ndarray
    cls: np.ndarray
    start: int
    order: int


def build(grams: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Trie:
    """``grams[k]``: packed (k + 1)-grams and counts of the contexts of order k that are
    kept, complete for each of them; suffixes of a kept context are kept."""
    seen = np.unique(np.concatenate([suffix(g, 1) for g, _ in grams.values()])) if grams else np.zeros(0, np.uint64)
    cls = np.full(256, len(seen), np.int64)  # the last class: bytes that training never saw
    cls[seen.astype(np.int64)] = np.arange(len(seen))
    width = len(seen) + 1
    names, lengths, rows = [], [], []
    logs: list[np.ndarray] = []
    ids: dict[int, tuple[np.ndarray, int]] = {}
    base = 0
    above = None  # (context keys, probabilities, totals, distinct, seen mask, counts) of the order below
    for k in range(order + 1):
        g, n = grams.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        contexts = np.unique(g >> np.uint64(8))
        if k == 0 and not len(contexts):
            contexts = np.zeros(1, np.uint64)
        if not len(contexts):
            break
        count = np.zeros((len(contexts), width), np.float32)
        count[np.searchsorted(contexts, g >> np.uint64(8)), cls[suffix(g, 1).astype(np.int64)]] = n
        has = count > 0
        count[has] -= DISCOUNT
        total, distinct = count.sum(1, dtype=np.float64), DISCOUNT * has.sum(1)  # what symbols and the escape weigh
        if above is None:
            lower = np.full((1, width), 1 / max(1.0, SYMBOLS - has.sum()))
        else:
            p_keys, p_prob, p_total, p_distinct, p_has, p_count = above
            parent = np.searchsorted(p_keys, suffix(contexts, k - 1))
            left_t = p_total[parent] - np.where(has, p_count[parent], 0).sum(1, dtype=np.float64)
            left_q = p_distinct[parent] - distinct
            all_t, all_q = p_total[parent], p_distinct[parent]
            some = left_q > 0
            left = np.where(some, left_t + left_q, 1.0)
            inside = (all_t + all_q) / left
            outside = np.where(some, left_q / left, 1.0) / (all_q / (all_t + all_q))
            lower = p_prob[parent] * np.where(p_has[parent], inside[:, None], outside[:, None])
        escape = np.where(distinct > 0, distinct / np.maximum(total + distinct, DISCOUNT), 1.0)
        prob = np.where(has, count / np.maximum(total + distinct, DISCOUNT)[:, None], escape[:, None] * lower)
        logs.append(np.log10(prob).astype(np.float32))
        ids[k] = (contexts, base)
        names.append(contexts)
        lengths.append(np.full(len(contexts), k))
        rows.append(np.arange(base, base + len(contexts)))
        base += len(contexts)
        above = (contexts, prob, total, distinct, has, count)
    symbols = np.r_[seen, 0].astype(np.uint64)
    step = np.zeros((base, width), np.int32)
    for k, (contexts, first) in ids.items():
        grown = (contexts[:, None] << np.uint64(8)) | symbols[None, :]
        to = np.zeros(grown.shape, np.int32)
        done = np.zeros(grown.shape, bool)
        for m in range(min(k + 1, max(ids)), 0, -1):
            keys, at = ids[m]
            want = suffix(grown, m)
            pos = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = ~done & (keys[pos] == want)
            to[hit] = (at + pos[hit]).astype(np.int32)
            done |= hit
        to[:, -1] = 0  # after an unseen byte only the empty context is left
        step[first : first + len(contexts)] = to
    begin = 0
    for m in range(max(ids), 0, -1):
        keys, at = ids[m]
        want = np.uint64(int.from_bytes(bytes([START]) * m, "big"))
        pos = int(np.searchsorted(keys, want))
        if pos < len(keys) and keys[pos] == want:
            begin = at + pos
            break
    return Trie(np.concatenate(logs), step, cls, begin, order)


def score(trie: Trie, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of every text. Texts are cut into segments that are walked in
    step; a later segment first reads the ``order`` bytes before it, which fix its context."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    parts = np.maximum(1, -(-sizes // SEGMENT))
    row = np.repeat(np.arange(rows), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][row] + nth * SEGMENT
    stop = np.minimum(begin + SEGMENT, offsets[1:][row])
    warm = np.where(nth > 0, trie.order, 0)
    order = np.argsort(-(stop - begin), kind="stable")
    begin, stop, warm, row = begin[order], stop[order], warm[order], row[order]
    length = stop - begin
    width = trie.logp.shape[1]
    flat, step = trie.logp.reshape(-1), trie.step.reshape(-1)
    cls = trie.cls[data] if len(data) else np.zeros(1, np.int64)
    state = np.where(warm > 0, 0, trie.start).astype(np.int64)
    later = np.flatnonzero(warm > 0)
    for j in range(trie.order, 0, -1):
        if len(later):
            state[later] = step[state[later] * width + cls[begin[later] - j]]
    total = np.zeros(len(row))
    active = len(row)
    for t in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length[:active], -t, "left"))
        at = state[:active] * width + cls[begin[:active] + t]
        total[:active] += flat[at]
        state[:active] = step[at]
    last = nth[order] == parts[row] - 1
    total[last] += trie.logp[state[last], trie.cls[END]]
    return np.bincount(row, total, rows)


@dataclass
class Low:
    """Orders 0 to LOW: sorted grams and counts of each, and the trie's probabilities, whose
    rows are the contexts of order 0, then 1, then 2."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    logp: np.ndarray
    cls: np.ndarray

    def __post_init__(self):
        self.contexts = [distinct(g >> np.uint64(8)) for g, _ in self.grams]
        self.base = np.cumsum([0, max(1, len(self.contexts[0])), *(len(c) for c in self.contexts[1:])])


def build_low(grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> Low:
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    kept = {k: grams[k] for k in range(LOW + 1) if k in grams}
    trie = build(kept, LOW)
    return Low([kept.get(k, none) for k in range(LOW + 1)], trie.logp, trie.cls)


def _place(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def low_logp(low: Low, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after the longest low context it has."""
    row, open_ = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for k in range(LOW, 0, -1):
        at, hit = _place(low.contexts[k], suffix(keys >> np.uint64(8), k))
        hit &= open_
        row[hit] = low.base[k] + at[hit]
        open_ &= ~hit
    return low.logp[row, low.cls[suffix(keys, 1).astype(np.int64)]].astype(np.float64)


def _by_context(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, first gram, observations, distinct symbols) of sorted grams."""
    if not len(g):
        return g, np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    first = np.flatnonzero(np.r_[True, (g[1:] >> np.uint64(8)) != (g[:-1] >> np.uint64(8))])
    return g[first] >> np.uint64(8), first, np.add.reduceat(n, first).astype(np.float64), np.diff(np.r_[first, len(g)]).astype(np.float64)


def answers(keys: np.ndarray, counts: np.ndarray, low: Low, asked: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each asked (order + 1)-gram after the bytes
    before it. ``keys``, ``counts``: all grams of training, sorted, of the contexts that share
    their last LOW + 1 bytes with an asked one.

    Where a context lacks the symbol, its suffix's probability is multiplied by a number that
    depends on the context, and on whether the suffix has the symbol."""
    total, open_ = np.zeros(len(asked)), np.ones(len(asked), bool)
    grams = {order: (keys, counts), LOW: low.grams[LOW]}
    for k in range(order - 1, LOW, -1):
        grams[k] = counted(suffix(grams[k + 1][0], k + 1), grams[k + 1][1])
    for k in range(order, LOW, -1):
        g, n = grams[k]
        contexts, first, seen, distinct = _by_context(g, n)
        if not len(g):
            continue
        # what each context's symbols weigh in its suffix
        h, m = grams[k - 1]
        p_contexts, _, p_seen, p_distinct = _by_context(h, m)
        parent = np.searchsorted(p_contexts, suffix(contexts, k - 1))
        shared = np.add.reduceat(m[np.searchsorted(h, suffix(g, k))] - DISCOUNT, first)
        all_q = DISCOUNT * p_distinct[parent]
        left_q = all_q - DISCOUNT * distinct
        left_t = p_seen[parent] - all_q - shared
        some = left_q > 0
        left = np.where(some, left_t + left_q, 1.0)
        escape = DISCOUNT * distinct / seen
        inside = escape * p_seen[parent] / left
        outside = escape * np.where(some, left_q / left, 1.0) * p_seen[parent] / all_q
        want = np.flatnonzero(open_)
        key = suffix(asked[want], k + 1)
        at, hit = _place(g, key)
        context, known = _place(contexts, key >> np.uint64(8))
        total[want[hit]] += np.log10((n[at[hit]] - DISCOUNT) / seen[context[hit]])
        open_[want[hit]] = False
        miss = known & ~hit
        _, above = _place(h, suffix(key[miss], k))
        total[want[miss]] += np.log10(np.where(above, inside[context[miss]], outside[context[miss]]))
    rest = np.flatnonzero(open_)
    total[rest] += low_logp(low, asked[rest])
    return total
