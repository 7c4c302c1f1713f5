"""Pairs of keys by difflib's ratio, in blocks: bounds by letters and common subsequences first, then the ratio itself for many pairs at a time."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a key that the array forms hold; longer ones are compared one by one. Keys of a group, and pairs that are looked at together.
WIDE, GROUP, CHUNK = 63, 256, 1 << 16
#: Characters of a second sequence from which on difflib passes over frequent ones.
JUNK = 200
#: Last characters of a key, by which keys are compared that are the same before them, and the most of them that may be left out for that.
TAIL, LEFT_OUT = 8, 3
#: Bits of a third word that are not for digits, and the most bits in which groups around a middle one differ from it.
NO_DIGITS, NEAR = ~np.uint64((1 << 40) - 1), 3


class Keys:
    """Keys as arrays, sorted so that those of the same letters lie together; a joint `alphabet` and `rank` by order make two of them comparable.

    words has how often characters occur, as bits: for each of 32 buckets of letters (two words) and of 16 buckets of others one bit for each of the first
    four. The bits in which two keys differ are at most the characters that they do not share.
    """

    def __init__(self, keys: list[str], alphabet: np.ndarray, rank: dict[str, int] | None = None):
        flat = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(k) for k in keys], np.int64)
        row = np.repeat(np.arange(len(keys)), size)
        letter = ((flat >= 97) & (flat <= 122)) | (flat >= 128)
        other = np.where((flat >= 48) & (flat <= 57), flat - 48, np.where(flat == 32, 10, 11 + flat % 5))
        counts = np.bincount(row * 48 + np.where(letter, flat & 31, 32 + other), minlength=len(keys) * 48).reshape(len(keys), 48)
        words = np.packbits((counts[:, :, None] > np.arange(4)).reshape(len(keys), 192), axis=1).view(np.uint64)
        order = np.lexsort((words[:, 1], words[:, 0]))
        self.keys, self.size, self.words, self.at = [keys[i] for i in order], size[order], words[order], order
        self.rank = np.array([rank[k] for k in self.keys], np.int64) if rank else None
        self.long = self.size > WIDE
        fits = size[row] <= WIDE
        codes = np.full((len(keys), WIDE + 1), len(alphabet), np.uint16 if len(alphabet) < 2**16 - 2 else np.uint32)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        codes[row[fits], place[fits]] = np.searchsorted(alphabet, flat[fits])
        self.codes = codes[order]
        # Groups of the same letters, of at most GROUP keys.
        new = np.flatnonzero(np.r_[True, (self.words[1:, :2] != self.words[:-1, :2]).any(1)]) if keys else np.zeros(0, np.int64)
        ends = np.r_[new[1:], len(keys)]
        self.first = np.concatenate([np.arange(a, b, GROUP) for a, b in zip(new, ends)]) if keys else new
        self.many = np.diff(np.r_[self.first, len(keys)])
        self.widest = np.maximum.reduceat(self.size, self.first) if keys else new

    def places(self) -> np.ndarray:
        """For each key and each of 64 buckets of characters the places where it stands, as bits; the last column is empty."""
        out = np.zeros((len(self.keys), 65), np.uint64)
        every = np.arange(len(self.keys))
        for j in range(min(WIDE, int(self.size.max(initial=0)))):
            some = every[(self.size > j) & ~self.long]
            out[some, self.codes[some, j] % 64] |= np.uint64(1 << j)
        return out


def apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The number of bits in which rows of words differ, 192 at most."""
    c = np.bitwise_count(u ^ v)
    out = c[:, 0] + c[:, 1]
    return out + c[:, 2] if c.shape[1] > 2 else out


def both(left: list[str], right: list[str] | None) -> tuple[Keys, Keys]:
    """The keys of two sides, the same ones if there is no right one."""
    alphabet = np.unique(np.frombuffer("".join([*left, *(right or [])]).encode("utf-32-le", "surrogatepass"), np.uint32))
    rank = {k: i for i, k in enumerate(sorted({*left, *(right or [])}))}
    x = Keys(left, alphabet, rank)
    return x, x if right is None else Keys(right, alphabet, rank)


def common(x: Keys, places: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """At least the length of the longest common subsequence of each pair, none of them long (bit-parallel, after Hyyro)."""
    v = np.full(len(p), ~np.uint64(0))
    flat, base = places.reshape(-1), q.astype(np.int64) * 65
    size = x.size[p]
    for i in range(int(size.max(initial=0))):
        c = np.where(size > i, x.codes[p, i] % 64, 64)
        u = v & flat[base + c]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def matched(x: Keys, y: Keys, p: np.ndarray, q: np.ndarray, need: np.ndarray, decide: bool) -> np.ndarray:
    """Characters in the matching blocks of each pair, x the first sequence: the longest block, earliest in x, then in y, and those on both its sides.

    Pairs that cannot have the needed number are left with a smaller one; if only that is to be decided, pairs that have it with what was met so far.
    """
    out = np.zeros(len(p), np.int64)
    work = np.stack([np.arange(len(p)), np.zeros_like(p), x.size[p], np.zeros_like(p), y.size[q]]).astype(np.int64)
    while work.shape[1]:
        wide = np.minimum(work[2] - work[1], work[4] - work[3])
        alive = out + np.bincount(work[0], wide, len(p)).astype(np.int64) >= need
        if decide:
            alive &= out < need
        work = work[:, alive[work[0]]]
        work = work[:, np.lexsort((work[2] - work[1], work[4] - work[3]))]
        more = []
        for at in range(0, work.shape[1], 4096):
            n, al, ah, bl, bh = work[:, at : at + 4096]
            k, i, j = _longest(x.codes, y.codes, p[n], q[n], al, ah, bl, bh)
            np.add.at(out, n, k)
            ok = k > 0
            for side in ((n, al, i, bl, j), (n, i + k, ah, j + k, bh)):
                some = ok & (side[2] > side[1]) & (side[4] > side[3])
                more.append(np.stack(side)[:, some])
        work = np.concatenate(more, axis=1) if more else work[:, :0]
    return out


def _longest(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, place in a, place in b) of the longest common block of a[p, al:ah] and b[q, bl:bh], the earliest in a, then in b."""
    tall, wide = int((ah - al).max()), int((bh - bl).max())

    def cut(codes: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, none: int) -> np.ndarray:
        at = lo + np.arange(n)[:, None]
        return np.where(at < hi, codes[row, np.minimum(at, WIDE)], np.uint32(none))

    x, y = cut(a, p, al, ah, tall, 2**32 - 1), cut(b, q, bl, bh, wide, 2**32 - 2)
    if a.dtype == b.dtype == np.uint16:
        x, y = x.astype(np.uint16), y.astype(np.uint16)
    # A run ending at j counts 64 for each character; the earlier j wins among runs of one length.
    tie = (WIDE - np.arange(wide)).astype(np.uint16)[:, None]
    run, new = np.zeros((wide + 1, len(p)), np.uint16), np.zeros((wide + 1, len(p)), np.uint16)
    equal, code = np.empty((wide, len(p)), bool), np.empty((wide, len(p)), np.uint16)
    best, end_i, end_j = (np.zeros(len(p), np.int64) for _ in range(3))
    for i in range(tall):
        np.equal(y, x[i], out=equal)
        np.add(run[:-1], 64, out=new[1:])
        np.multiply(new[1:], equal, out=new[1:])
        np.add(new[1:], tie, out=code)
        most = code.max(axis=0)
        better = np.flatnonzero((most >> 6) > best)
        m = most[better].astype(np.int64)
        best[better], end_i[better], end_j[better] = m >> 6, i, WIDE - (m & 63)
        run, new = new, run
    return best, al + end_i - best + 1, bl + end_j - best + 1


def rectangles(x: Keys, y: Keys, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, a chunk at a time, of all groups whose letters allow the ratio; the groups in no order, so that early chunks meet all kinds of them."""
    rng, g = np.random.default_rng(0), len(y.first)
    rows = rng.permutation(len(x.first))
    wx, wy = x.words[x.first], y.words[y.first]
    step = max(1, (1 << 22) // max(1, g))
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        apart = np.bitwise_count(wx[r, None, 0] ^ wy[None, :, 0]) + np.bitwise_count(wx[r, None, 1] ^ wy[None, :, 1])
        s, t = np.nonzero(apart <= (1 - least) * (x.widest[r][:, None] + y.widest) + 1e-9)
        s = r[s]
        if same:
            s, t = s[s <= t], t[s <= t]
        mix = rng.permutation(len(s))
        s, t = s[mix], t[mix]
        count = x.many[s] * y.many[t]
        part = np.cumsum(count) // CHUNK
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(s)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            n = count[lo:hi]
            which = np.repeat(np.arange(lo, hi), n)
            off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            across = y.many[t[which]]
            p = x.first[s[which]] + off // across
            q = y.first[t[which]] + off % across
            if same:
                p, q = p[p < q], q[p < q]
            yield p, q


def decided(x: Keys, y: Keys, places: np.ndarray, p: np.ndarray, q: np.ndarray, least: float, decide: bool, x_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, ratio) of those of the given pairs that have the ratio, which is at least what is given if only that is to be decided. The smaller key is the first sequence, or that of x."""
    total = x.size[p] + y.size[q]
    lost = (1 - least) * total + 1e-9
    ok = apart(x.words[p], y.words[q]) <= lost
    p, q, total = p[ok], q[ok], total[ok]
    slow = x.long[p] | y.long[q]
    singly = [(i, j, r) for i, j in zip(p[slow].tolist(), q[slow].tolist()) if (r := _ratio(x.keys[i], y.keys[j], least, x_first)) >= least]
    p, q, total = p[~slow], q[~slow], total[~slow]
    need = np.ceil(least * total / 2 - 1e-9).astype(np.int64)
    ok = common(x, places, p, q) >= need
    p, q, total, need = p[ok], q[ok], total[ok], need[ok]
    n = np.zeros(len(p), np.int64)
    first = np.ones(len(p), bool) if x_first else x.rank[p] < y.rank[q]
    n[first] = matched(x, y, p[first], q[first], need[first], decide)
    n[~first] = matched(y, x, q[~first], p[~first], need[~first], decide)
    ratio = 2.0 * n / total
    ok = ratio >= least
    more = np.array([s[:2] for s in singly], np.int64).reshape(-1, 2)
    return np.r_[p[ok], more[:, 0]], np.r_[q[ok], more[:, 1]], np.r_[ratio[ok], np.array([s[2] for s in singly])]


def _ratio(a: str, b: str, least: float, x_first: bool) -> float:
    matcher = difflib.SequenceMatcher(None, *((a, b) if x_first else sorted((a, b))))
    return matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0


def contained_alike(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    """Whether pairs, a < b and one within the other, have a ratio of at least `least`: the shorter one is the longest block, unless difflib passes over frequent characters."""
    m, n = (pc.utf8_length(c).to_numpy(zero_copy_only=False) for c in (a, b))
    out = 2.0 * np.minimum(m, n) / (m + n) >= least
    for i in np.flatnonzero(n >= JUNK).tolist():
        out[i] = _ratio(a[i].as_py(), b[i].as_py(), least, False) >= least
    return out


def alike(left: list[str], right: list[str] | None, least: float, decide: bool = False) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(a, b, ratio), a < b, a chunk at a time: all pairs of a ratio of at least `least`, of the left keys with the right ones or among themselves."""
    x, y = both(left, right)
    places, x_names, y_names = y.places(), pa.array(x.keys, pa.string()), pa.array(y.keys, pa.string())
    for p, q in rectangles(x, y, right is None, least):
        p, q, r = decided(x, y, places, p, q, least, decide)
        for some, low, high in ((x.rank[p] < y.rank[q], (x_names, p), (y_names, q)), (x.rank[p] > y.rank[q], (y_names, q), (x_names, p))):
            if some.any():
                yield low[0].take(pa.array(low[1][some])), high[0].take(pa.array(high[1][some])), r[some]


class Groups:
    """Keys in groups of the same letters, marks, label and class, these in groups of the same letters, these around a middle one; each lie together in `order`.

    many, first: how many of the next finer parts each has, and the first of them; widest, words: their largest size and their bits.
    """

    def __init__(self, k: Keys, label: np.ndarray, kind: np.ndarray):
        bags, of = _distinct(k.words[:, 0], k.words[:, 1])
        middle, far = _middles(bags)
        marks = k.words[:, 2] & NO_DIGITS
        self.order = np.lexsort((kind, label, marks, of, middle[of]))
        part = np.stack([middle[of], of, marks.view(np.int64), label, kind])[:, self.order]
        new = (part[:, 1:] != part[:, :-1]) if part.shape[1] else np.zeros((5, 0), bool)
        starts = [np.flatnonzero(np.r_[True, new[:n].any(0)]) if part.shape[1] else np.zeros(0, np.int64) for n in (1, 2, 5)]
        self.first = [np.searchsorted(fine, coarse) for coarse, fine in zip(starts, [*starts[1:], np.arange(part.shape[1])])]
        self.many = [np.diff(np.r_[f, n]) for f, n in zip(self.first, [len(starts[1]), len(starts[2]), part.shape[1]])]
        self.widest = [np.maximum.reduceat(k.size[self.order], f) if len(f) else f for f in starts]
        at = self.order[starts[2]]
        self.words, self.label, self.kind = np.c_[k.words[at, :2], marks[at]], label[at], kind[at]
        at = part[0][starts[0]]
        self.middle, self.far = bags[at], far[at]
        self.bags = bags[part[1][starts[1]]]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of two words, and the place of each row's pair among them."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return np.c_[a, b][order[new]], of


def _middles(bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bits the place of one from which it differs by NEAR at most, and how far the rows of each are from it."""
    middle, far, left = np.full(len(bags), -1), np.zeros(len(bags), np.int64), np.arange(len(bags))
    while len(left):
        n = apart(bags[left], bags[left[0]])
        near = n <= NEAR
        middle[left[near]], far[left[0]] = left[0], n[near].max()
        left = left[~near]
    return middle, far


def _crossed(s: np.ndarray, t: np.ndarray, a: Groups, b: Groups, level: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of the finer parts of a's groups s and b's groups t, some `most` at a time."""
    count = a.many[level][s] * b.many[level][t]
    part = np.cumsum(count) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(s)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        n = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.divmod(off, b.many[level][t[which]])
        yield a.first[level][s[which]] + i, b.first[level][t[which]] + j


def unlike(x: Keys, y: Keys, label_x: np.ndarray, label_y: np.ndarray, kind_x: np.ndarray, kind_y: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, a chunk at a time, of all groups of another label and class whose letters and marks allow the ratio; in no order (see rectangles)."""
    rng = np.random.default_rng(0)
    a = Groups(x, label_x, kind_x)
    b = a if same else Groups(y, label_y, kind_y)
    rows = rng.permutation(len(a.middle))
    step = max(1, (1 << 20) // max(1, len(b.middle)))
    lost = lambda level, s, t: (1 - least) * (a.widest[level][s] + b.widest[level][t]) + 1e-9
    for at in range(0, len(rows), step):
        s, t = np.repeat(rows[at : at + step], len(b.middle)), np.tile(np.arange(len(b.middle)), len(rows[at : at + step]))
        if same:
            s, t = s[s <= t], t[s <= t]
        ok = apart(a.middle[s], b.middle[t]) <= a.far[s] + b.far[t] + lost(0, s, t)
        mix = rng.permutation(np.flatnonzero(ok))
        for i, j in _crossed(s[mix], t[mix], a, b, 0, 1 << 20):
            ok = apart(a.bags[i], b.bags[j]) <= lost(1, i, j)
            if same:
                ok &= i <= j
            for g, h in _crossed(i[ok], j[ok], a, b, 1, 1 << 20):
                ok = (a.label[g] != b.label[h]) & (a.kind[g] != b.kind[h])
                if same:
                    ok &= g < h
                g, h = g[ok], h[ok]
                ok = apart(a.words[g], b.words[h]) <= lost(2, g, h)
                mix = rng.permutation(np.flatnonzero(ok))
                for p, q in _crossed(g[mix], h[mix], a, b, 2, CHUNK):
                    yield a.order[p], b.order[q]


def _kinds(x: Keys, y: Keys, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, left out) of the keys of both sides: keys of a class are the same but for their last TAIL characters, of which left out ones may be without a partner.

    A key of which more may be left out than LEFT_OUT has a class of its own on either side, and 0 of them.
    """
    ids: dict[str, int] = {}
    out = []
    for k, own in ((x, 1), (y, 2)):
        kind = np.array([ids.setdefault(key[:-TAIL], len(ids)) for key in k.keys], np.int64) if k.keys else np.zeros(0, np.int64)
        some = k.size - np.ceil(least * k.size - 1e-9).astype(np.int64)
        alone = k.long | (some > LEFT_OUT) | (k.size < TAIL)
        kind[alone] = -2 * np.flatnonzero(alone) - own
        some[alone] = 0
        out += [kind, some]
    return tuple(out)


def _tails(codes: np.ndarray, size: np.ndarray, kind: np.ndarray, some: int) -> np.ndarray:
    """A row for each key: hashes of its class and of what is left of its tail without `some` characters, in all ways."""
    tail = codes[np.arange(len(size))[:, None], size[:, None] - TAIL + np.arange(TAIL)].astype(np.uint64)
    ways = [*combinations(range(TAIL), TAIL - some)]
    out = np.empty((len(size), len(ways)), np.uint64)
    for n, kept in enumerate(ways):
        h = kind.astype(np.uint64)
        for j in kept:
            h = (h ^ tail[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, n] = h
    return out


def close_tails(x: Keys, y: Keys, kind_x: np.ndarray, kind_y: np.ndarray, some_x: np.ndarray, some_y: np.ndarray, same: bool, labels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, among them all those of one class but different labels whose tails have the common subsequence that the ratio needs.

    labels() gives the labels of both sides as they are by then.
    """
    shared = np.intersect1d(kind_x, kind_y) if not same else (lambda u: u[0][u[1] > 1])(np.unique(kind_x, return_counts=True))
    for some in range(1, LEFT_OUT + 1):
        i = np.flatnonzero((some_x == some) & np.isin(kind_x, shared))
        j = np.zeros(0, np.int64) if same else np.flatnonzero((some_y == some) & np.isin(kind_y, shared))
        if not len(i) or not (same or len(j)):
            continue
        h = _tails(x.codes[i], x.size[i], kind_x[i], some)
        ways = h.shape[1]
        h = np.r_[h.ravel(), _tails(y.codes[j], y.size[j], kind_y[j], some).ravel()]
        row = np.r_[np.repeat(i, ways), np.repeat(len(x.keys) + j, ways)]
        order = np.argsort(h)
        h, row, gap = h[order], row[order], 0
        while len(row):
            gap += 1
            # Those of one hash whose labels are the same need no look; the others are met one place apart, then two, and so on.
            lx, ly = labels()
            label = (lx if same else np.r_[lx, ly])[row]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[start, len(h)])
            keep = np.repeat((np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start)) & (n > gap), n)
            h, row = h[keep], row[keep]
            meet = h[gap:] == h[:-gap]
            p, q = row[:-gap][meet], row[gap:][meet]
            if not same:
                p, q = np.minimum(p, q), np.maximum(p, q)
                ok = (p < len(x.keys)) & (q >= len(x.keys))
                p, q = p[ok], q[ok] - len(x.keys)
            ok = (p != q) if same else np.ones(len(p), bool)
            pairs = np.unique(p[ok] * len(y.keys) + q[ok])
            yield pairs // len(y.keys), pairs % len(y.keys)


def _forest(a: list[int], b: list[int]) -> np.ndarray:
    """Whether each of the pairs of labels would join what those before it have left apart."""
    up: dict[int, int] = {}
    out = np.zeros(len(a), bool)
    for n, (i, j) in enumerate(zip(a, b)):
        while (k := up.get(i, i)) != i:
            i = up[i] = up.get(k, k)
        while (k := up.get(j, j)) != j:
            j = up[j] = up.get(k, k)
        if i != j:
            up[i], out[n] = j, True
    return out


def linked(left: list[str], right: list[str] | None, lab_left: np.ndarray, lab_right: np.ndarray | None, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(parent, links): as a forest over the labels what pairs of a ratio of at least `least` connect, and the pairs of labels that were joined.

    Only pairs that are not connected so far are compared, so that a dense group costs little more than its links: neighbours in order first, then
    those of the same beginning by what their ends have in common, then all others whose letters and marks allow the ratio.
    """
    x, y = both(left, right)
    same = right is None
    places, parent = y.places(), np.arange(max(lab_left.max(initial=-1), -1 if lab_right is None else lab_right.max(initial=-1)) + 1)
    lx = lab_left[x.at].copy()
    ly = lx if same else lab_right[y.at].copy()
    links = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def meet(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Decides pairs whose characters allow the ratio, many at a time, as the steps of decided cost much for a few."""
        held, many = [], 0
        for p, q in pairs:
            some = np.flatnonzero(lx[p] != ly[q])
            p, q = p[some], q[some]
            ok = apart(x.words[p], y.words[q]) <= (1 - least) * (x.size[p] + y.size[q]) + 1e-9
            held.append((p[ok], q[ok]))
            many += len(held[-1][0])
            if many >= CHUNK // 4:
                join(*map(np.concatenate, zip(*held)))
                held, many = [], 0
        if many:
            join(*map(np.concatenate, zip(*held)))

    def join(p: np.ndarray, q: np.ndarray) -> None:
        for at in range(0, len(p), CHUNK // 4):
            a, b = p[at : at + CHUNK // 4], q[at : at + CHUNK // 4]
            # First as many as could connect all of them, then those that this has left apart.
            first = _forest(lx[a].tolist(), ly[b].tolist())
            decide(a[first], b[first])
            rest = np.flatnonzero((lx[a] != ly[b]) & ~first)
            decide(a[rest], b[rest])

    def decide(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal lx, ly
        i, j, _ = decided(x, y, places, p, q, least, True)
        before = len(links)
        for a, b in {*zip(lx[i].tolist(), ly[j].tolist())}:
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((a, b))
        if len(links) > before:
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            lx = parent[lx]
            ly = lx if same else parent[ly]

    if same:
        for turn in (0, TAIL):
            order = np.array(sorted(range(len(x.keys)), key=[k[turn:] + k[:turn] for k in x.keys].__getitem__), np.int64)
            meet(iter([(order[:-1], order[1:])]))
    kinds_x, some_x, kinds_y, some_y = _kinds(x, y, least)
    if same:
        kinds_y = kinds_x
    meet(close_tails(x, y, kinds_x, kinds_y, some_x, some_y, same, lambda: (lx, ly)))
    meet(unlike(x, y, lx, ly, kinds_x, kinds_y, same, least))
    return parent, links
