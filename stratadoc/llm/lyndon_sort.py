"""Linear suffix sorting by grouping on Lyndon prefixes, for many short texts in step.

The construction has two phases. First, suffixes are grouped by first symbol and the groups are
processed from the highest down: each suffix of a group finds its previous smaller one, the nearest
earlier suffix of a lower group, by following pointers over what is higher; the suffixes found are
taken out of their groups and put right behind them, those found more often further up. In the end
a group holds the suffixes with one Lyndon prefix. Second, the suffixes are emitted from the
smallest up: each sorted suffix emits the one before it and then that one's chain of previous
smaller suffixes, each to the next place of its group. No names are given to ranks and nothing is
sorted again.

Every text has its own groups, so all texts take a step at once and a step is a few array
operations over one group of each.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts symbols[bounds[k] : bounds[k + 1]], one behind the other, as places in symbols.

    Each text ends with a symbol that is smaller than all its others.
    """
    n, low, high = len(symbols), bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    text = np.repeat(np.arange(len(low)), high - low)
    coded = text * (int(symbols.max(initial=0)) + 1) + symbols.astype(np.int64)
    order = np.argsort(coded, kind="stable")
    held = coded[order]
    fresh = np.r_[True, held[1:] != held[:-1]] if n else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    group = np.full(n + 1, -1, np.int64)  # of each suffix: where its group starts; n stands for no suffix
    group[order] = starts[np.cumsum(fresh) - 1]
    end = np.zeros(n + 1, np.int64)  # of each group by its start
    end[starts] = np.r_[starts[1:], n]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    link = np.arange(-1, n)
    link[low] = n
    _group_by_lyndon_prefix(order, place, group, end, link, low, high)
    return _emit(group, link, low, high)


def _group_by_lyndon_prefix(order, place, group, end, link, low, high) -> None:
    none, moving = len(order), np.zeros(len(order) + 1, bool)
    top, floor = high.copy(), low + 1  # the end symbol alone stays
    active = np.flatnonzero(top > floor)
    while len(active):
        upto = top[active]
        at = group[order[upto - 1]]
        size = upto - at
        first = np.cumsum(size) - size
        suffixes = order[np.repeat(at - first, size) + np.arange(size.sum())]
        own = np.repeat(at, size)
        found = link[suffixes]
        todo = np.flatnonzero(group[found] >= own)
        while len(todo):
            found[todo] = link[found[todo]]
            link[suffixes[todo]] = found[todo]
            todo = todo[group[found[todo]] >= own[todo]]
        link[suffixes] = found
        found = np.sort(found[found != none])
        if len(found):
            fresh = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            movers, times = found[fresh], np.diff(np.r_[fresh, len(found)])
            old = group[movers]
            sort = np.lexsort((times, old))
            movers, times, old = movers[sort], times[sort], old[sort]
            lead = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            many = np.diff(np.r_[lead, len(old)])
            cut = end[old[lead]] - many  # where the movers of each old group begin
            slots = np.repeat(cut - lead, many) + np.arange(len(old))
            moving[movers] = True
            there = order[slots]
            stay = there[~moving[there]]
            holes = place[movers]
            holes = holes[holes < np.repeat(cut, many)]
            order[holes], place[stay] = stay, holes
            order[slots], place[movers] = movers, slots
            moving[movers] = False
            new = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            end[old[lead]] = cut
            end[slots[new]] = np.r_[slots[new[1:] - 1], slots[-1]] + 1
            group[movers] = np.repeat(slots[new], np.diff(np.r_[new, len(old)]))
        top[active] = at
        active = active[at > floor[active]]


def _emit(group, link, low, high) -> np.ndarray:
    n = len(group) - 1
    out = np.empty(n, np.int64)
    done = np.zeros(n + 1, bool)
    done[n] = True
    free = np.arange(n + 1)
    out[low] = high - 1
    done[high - 1] = True
    free[group[high - 1]] += 1
    begin = np.zeros(n + 1, bool)
    begin[low] = True
    ranked = np.argsort(low - high, kind="stable")  # the longest first, so that those still running are a prefix
    low, size = low[ranked], (high - low)[ranked]
    running = len(low)
    for step in range(int(size.max(initial=0))):
        while running and size[running - 1] <= step:
            running -= 1
        at = out[low[:running] + step]
        at = (at - 1)[~begin[at]]
        at = at[~done[at]]
        while len(at):
            g = group[at]
            out[free[g]] = at
            free[g] += 1
            done[at] = True
            at = link[at]
            at = at[~done[at]]
    return out
