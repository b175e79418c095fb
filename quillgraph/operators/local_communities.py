"""The levels of ``community.hierarchy`` on arrays, for graphs of bounded size that one task can hold.

The rules are those of the distributed rounds: the same halves of the nodes move
in the same rounds, ties go to the same labels.
"""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _turns(h: np.ndarray, j: int) -> np.ndarray:
    """``pmod(xxhash64(node, j), 2)`` for nodes with ``h = xxhash64(node)``."""
    with np.errstate(over="ignore"):
        x = (h + _P5 + np.uint64(4)) ^ (np.uint64(j) * _P1)
        x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * _P2 + _P3
        x = (x ^ (x >> np.uint64(33))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P3
        x = x ^ (x >> np.uint64(32))
    return (x & np.uint64(1)).astype(np.int64)


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    if not len(key):
        return key, w
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(w[order], first)


def _parts(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part."""
    lab = np.arange(n)
    while len(s):
        a, b = lab[s], lab[t]
        apart = a != b
        s, t, a, b = s[apart], t[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := lab[lab], lab):
            lab = up
    return lab


def _moves(s, t, w, k, lab, m2: float, gamma: float, rounds: int, h) -> np.ndarray:
    n, lab = len(k), lab.copy()
    apart = s != t
    s, t, w = s[apart], t[apart], w[apart]
    moved = False
    for r in range(rounds):
        if r % 2 == 0:
            turn, moved = _turns(h, r // 2), False
        mine = turn[s] == r % 2
        key, to_w = _summed(s[mine] * n + lab[t[mine]], w[mine])
        if len(key):
            tot = np.bincount(lab, k, n)
            node, to = key // n, key % n
            stays = to == lab[node]
            own = np.zeros(n)
            own[node[stays]] = to_w[stays]
            node, to, to_w = node[~stays], to[~stays], to_w[~stays]
        if len(key) and len(node):
            gain = np.round(to_w - gamma * k[node] * tot[to] / m2, 10)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            top = np.maximum.reduceat(gain, first)
            at = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(node)])))
            at = at[np.r_[True, node[at[1:]] != node[at[:-1]]]]  # the smallest label of the best ones
            x = node[at]
            stay = np.round(own[x] - gamma * k[x] * (tot[lab[x]] - k[x]) / m2, 10)
            go = top > stay + 1e-9
            lab[x[go]] = to[at][go]
            moved |= bool(go.any())
        if r % 2 and not moved:
            break
    return lab


def _connected(n, s, t, lab) -> np.ndarray:
    inner = lab[s] == lab[t]
    return _parts(n, s[inner], t[inner])


def levels(s, t, w, h, start, m2: float, gamma: float, rounds: int, most: int, fresh: bool) -> list[np.ndarray]:
    """A label per node for each level, from fine to coarse.

    ``s <= t`` are positions of nodes in the order of their ids, an edge given
    once; ``h`` their ``xxhash64``; ``start`` the positions that name the first
    communities. Connected parts do not touch each other, so each of them stops
    where its own modularity gains no more; its last labels stand in later
    levels. Unless ``fresh``, ``start`` is a level that has been given already.
    """
    n = len(h)
    whole = _parts(n, s, t)
    loop = s == t
    s, t, w = np.r_[s, t[~loop]], np.r_[t, s[~loop]], np.r_[w, w[~loop]]
    k0 = np.bincount(s, w, n)

    def quality(lab):
        """Modularity's share of each connected part, at the position of its smallest node."""
        same, tot = lab[s0] == lab[t0], np.bincount(lab, k0, n) / m2
        return np.bincount(whole[s0[same]], w0[same], n) / m2 - gamma * np.bincount(whole, tot * tot, n)

    s0, t0, w0 = s, t, w
    base, lab, flat, out = np.arange(n), start, start, []
    best = np.full(n, -np.inf) if fresh else quality(flat)
    going = np.ones(n, bool)  # by connected part
    k = k0
    for _ in range(most):
        part = _connected(n, s, t, _moves(s, t, w, k, lab, m2, gamma, rounds, h))
        new = part[base]
        q = quality(new)
        going &= q > best + 1e-9
        if not going[whole].any():
            break
        flat = np.where(going[whole], new, flat)
        best = np.where(going, q, best)
        out.append(flat)
        merges = np.zeros(n, bool)
        merges[whole[np.flatnonzero(part != np.arange(n))]] = True
        going &= merges
        keep = going[whole[s]]
        s, t, w = s[keep], t[keep], w[keep]
        if not len(s):
            break
        inside = part[s] == part[t]
        fine = _connected(n, s[inside], t[inside], _moves(s[inside], t[inside], w[inside], k, np.arange(n), m2, gamma, rounds, h))
        base = fine[base]
        # a refined part starts where its members are; a community is called by its smallest part
        name = np.full(n, n)
        np.minimum.at(name, part, fine)
        lab = np.arange(n)
        lab[fine] = name[part]
        key, w = _summed(fine[s] * n + fine[t], w)
        s, t = key // n, key % n
        k = np.bincount(s, w, n)
    return out
