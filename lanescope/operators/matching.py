"""Greedy one-to-one matching of intervals, best IoU first, of a stretch of time and without most of its pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FEW, MANY = 200_000, 4_000_000  # pairs that a level may look at in any case, and at once


class Classes:
    """Intervals of one side with the same start and end as one: `members` are their rows, the greatest id first."""

    def __init__(self, start: np.ndarray, end: np.ndarray, ids: np.ndarray, home: np.ndarray, torn: np.ndarray):
        order = np.lexsort((-ids, end, start))
        s, e, i = start[order], end[order], ids[order]
        same = np.concatenate([[False], (s[1:] == s[:-1]) & (e[1:] == e[:-1])]) if len(s) else np.zeros(0, bool)
        again = same.copy()
        again[1:] &= i[1:] == i[:-1]  # a row that is there twice
        order, same = order[~again], same[~again]
        first = np.flatnonzero(~same)
        self.members, self.at, self.till = order, first.tolist(), np.append(first[1:], len(order)).tolist()
        self.start, self.end, self.home = start[order][first], end[order][first], home[order][first]
        self.unsure = (np.maximum.reduceat(torn[order].astype(np.int8), first) > 0).tolist() if len(first) else []

    def live(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.at, np.int64) < np.array(self.till, np.int64))


def near(a: Classes, b: Classes, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows x of a, ranges of the rows y of b, in the order returned first, that may have an IoU of `least` with them: a length
    within a factor and a start within a distance."""
    length = lambda c, k: c.end[k] - c.start[k]
    step = np.log(1 / least) * (1 + 1e-9) + 1e-9
    ka, kb = np.floor(np.log(length(a, x)) / step), np.floor(np.log(length(b, y)) / step)
    kinds, number = np.unique(kb, return_inverse=True)
    reach = length(a, x) * (1 / least - 1) * (1 + 1e-9) + 1e-6
    zero = min(a.start[x].min(), b.start[y].min())
    room = max(a.start[x].max(), b.start[y].max()) - zero + 2 * reach.max() + 1
    key = number * room + (b.start[y] - zero)
    order = np.argsort(key, kind="stable")
    lows, highs = [], []
    for off in (-1, 0, 1):
        k = np.minimum(np.searchsorted(kinds, ka + off), len(kinds) - 1)
        at = k * room + (a.start[x] - zero)
        low = np.searchsorted(key[order], at - np.minimum(reach, a.start[x] - zero + 0.5), "left")
        high = np.searchsorted(key[order], at + reach, "right")
        lows.append(low)
        highs.append(np.where(kinds[k] == ka + off, high, low))
    return order, np.stack(lows), np.stack(highs)


def pairs_at(t: Classes, p: Classes, x: np.ndarray, y: np.ndarray, least: float, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(truth, prediction, IoU) of the rows x and y with an IoU of `least`; None if they are more to look at than the budget."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order, low, high = near(t, p, x, y, least)
    n = (high - low).ravel()
    if n.sum() > budget:
        return None
    out = []
    row, low = np.tile(np.arange(len(x)), 3), low.ravel()
    cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + MANY, MANY), "left").clip(0, len(n)))
    for lo, hi in zip(cuts, [*cuts[1:], len(n)], strict=True):
        m = n[lo:hi]
        i = np.repeat(x[row[lo:hi]], m)
        j = y[order[np.repeat(low[lo:hi] - np.cumsum(m) + m, m) + np.arange(m.sum())]]
        both = np.maximum(np.minimum(t.end[i], p.end[j]) - np.maximum(t.start[i], p.start[j]), 0.0)
        union = (t.end[i] - t.start[i]) + (p.end[j] - p.start[j]) - both
        iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        ok = iou >= least
        out.append((i[ok], j[ok], iou[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def settle(t: Classes, p: Classes, least: float, lo: float, hi: float, t_ids: np.ndarray, p_ids: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
    """Matches of the intervals that start in [lo, hi), as (truth class, first member, prediction class, first member, number, IoU).

    Levels of IoU come one by one, and only what the ones before have left is paired: matches free a level of most of its pairs.
    An interval is unsure at the level from which it may have partners outside, and so is whatever meets it while both are free;
    what isn't is as in the matching of everything."""
    made: list[tuple[int, int, int, int, int, float]] = []
    done, step = 1.0, 1 / 64

    def meet(a: int, b: int, iou: float) -> None:
        n = min(t.till[a] - t.at[a], p.till[b] - p.at[b])
        if n <= 0:
            return
        if t.unsure[a] or p.unsure[b]:
            t.unsure[a] = p.unsure[b] = True
            return
        made.append((a, t.at[a], b, p.at[b], n, iou))
        t.at[a] += n
        p.at[b] += n

    def meet_equal(edges: list[tuple[int, int]], iou: float) -> None:
        """Pairs of one IoU go by truth and then by prediction, the greatest first."""
        edges = [(a, b) for a, b in edges if t.at[a] < t.till[a] and p.at[b] < p.till[b]]
        while True:
            grown = [(a, b) for a, b in edges if t.unsure[a] != p.unsure[b]]
            if not grown:
                break
            for a, b in grown:
                t.unsure[a] = p.unsure[b] = True
        edges = [(a, b) for a, b in edges if not t.unsure[a]]
        if len({a for a, _ in edges}) == len(edges) == len({b for _, b in edges}):
            for a, b in edges:
                meet(a, b, iou)
            return
        of: dict[int, list[int]] = {}
        for a, b in edges:
            of.setdefault(a, []).append(b)
        members = sorted(((t_ids[t.members[k]], a) for a in of for k in range(t.at[a], t.till[a])), reverse=True)
        for _, a in members:
            free = [b for b in of[a] if p.at[b] < p.till[b]]
            if free:
                b = max(free, key=lambda k: p_ids[p.members[p.at[k]]])
                made.append((a, t.at[a], b, p.at[b], 1, iou))
                t.at[a] += 1
                p.at[b] += 1

    while done > least:
        x, y = t.live(), p.live()
        if not len(x) or not len(y):
            break
        while True:
            level = max(least, done - step)
            sure = []
            for c, k in ((t, x), (p, y)):
                reach = (c.end[k] - c.start[k]) * (1 / level - 1) * (1 + 1e-9) + 1e-6
                sure.append(~(np.array(c.unsure, bool)[k] | (c.start[k] - reach < lo) | (c.start[k] + reach >= hi)))
            budget = np.inf if step < 1e-9 or done - step >= done else max(FEW, 8 * (len(x) + len(y)))
            one = pairs_at(t, p, x[sure[0]], y, level, budget)
            two = one and pairs_at(t, p, x[~sure[0]], y[sure[1]], level, budget)
            if one is not None and two is not None:
                break
            step /= 2
        for c, k, ok in ((t, x, sure[0]), (p, y, sure[1])):
            for i in k[~ok].tolist():
                c.unsure[i] = True
        a, b, iou = (np.concatenate([u, v]) for u, v in zip(one, two, strict=True))
        order = np.argsort(-iou, kind="stable")
        a, b, iou = a[order].tolist(), b[order].tolist(), iou[order]
        cuts = [0, *(np.flatnonzero(iou[1:] != iou[:-1]) + 1).tolist(), len(iou)] if len(iou) else [0]
        iou = iou.tolist()
        for k, till in zip(cuts, cuts[1:], strict=False):
            if till == k + 1:
                meet(a[k], b[k], iou[k])
            else:
                meet_equal(list(zip(a[k:till], b[k:till], strict=True)), iou[k])
        done, step = level, step * 2
    return made


def matched_block(rows: pa.Table, keys: list[str], least: float, width: float, margin: float) -> pa.Table:
    """Of the intervals (keys, block, truth, id, start, end, home, torn) of a stretch of time and its margins: kind 0, the matches that
    are sure with a side at home here; kinds 1 and 2, true and predicted intervals at home here of which nothing is sure."""
    block = rows["block"][0].as_py()
    lo, hi = block * width - margin + 1e-6, (block + 1) * width + margin - 1e-6
    sides = []
    for is_true in (True, False):
        own = rows.filter(pc.equal(rows["truth"], is_true)).combine_chunks()
        ids = pc.rank(own["id"], sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) if own.num_rows else np.zeros(0, np.int64)
        sides.append((own, ids, Classes(*(own[c].to_numpy() for c in ("start", "end")), ids, *(own[c].to_numpy() for c in ("home", "torn")))))
    (true, t_ids, t), (said, p_ids, p) = sides
    made = settle(t, p, least, lo, hi, t_ids, p_ids)
    a, i, b, j, n, iou = (np.array(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 6
    here = t.home[a] | p.home[b] if len(a) else np.zeros(0, bool)
    i, j, n, iou = i[here], j[here], n[here], iou[here].astype(float)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at_t, at_p, iou = t.members[np.repeat(i, n) + within], p.members[np.repeat(j, n) + within], np.repeat(iou, n)

    def left(c: Classes) -> np.ndarray:
        k = [c.members[c.at[x] : c.till[x]] for x in range(len(c.at)) if c.unsure[x] and c.home[x]]
        return np.concatenate(k) if k else np.zeros(0, np.int64)

    open_t, open_p = left(t), left(p)
    none = lambda n, of: pa.nulls(n, of)
    parts = [(0, true["id"].take(at_t), said["id"].take(at_p), pa.array(iou), none(len(iou), pa.float64()), none(len(iou), pa.float64()))]
    parts += [(1, true["id"].take(open_t), none(len(open_t), said["id"].type), none(len(open_t), pa.float64()), true["start"].take(open_t), true["end"].take(open_t))]
    parts += [(2, none(len(open_p), true["id"].type), said["id"].take(open_p), none(len(open_p), pa.float64()), said["start"].take(open_p), said["end"].take(open_p))]
    out = []
    for kind, *columns in parts:
        m = len(columns[0])
        named = {k: pa.array([rows[k][0].as_py()] * m, rows[k].type) for k in keys}
        out.append(pa.table(named | {"kind": pa.array(np.full(m, kind, np.int32))} | dict(zip(("truth_id", "pred_id", "iou", "start", "end"), columns, strict=True))))
    return pa.concat_tables(out).combine_chunks()
