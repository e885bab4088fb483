"""External induced sorting: the suffixes of a shard in order, with common prefixes, in bounded memory.

The shard is a string of strings, each ended by the symbol 0. A suffix is of
the smaller type (S) or the larger type (L) than the one behind it; S* suffixes
are those of type S behind one of type L.

1. S* substrings (from one S* position to the next) are sorted: dealt to runs on
   disk by their first symbols until a run fits in memory, then ordered word by
   word. Equal ones get one name.
2. The names, in text order, are a string one level down, a third as long. Its
   suffixes are sorted in the same way, recursively, until all names differ;
   that is the order of the S* suffixes.
3. From the S* suffixes, the L suffixes and then the S suffixes are induced:
   whatever stands in front of a popped suffix is pushed for its own symbol.

Tuples wait in disk-backed FIFO queues, one for each range of symbols (``Queues``);
strings, positions, names and sums beyond a bound are memory-mapped files whose
pages are given back as it goes, and which are deleted when done (``Scratch``). A level of few symbols (the text) pops symbol by
symbol, where arrival is the order. A level of many symbols (names) pops ranges
of them: what a range induces within itself is collected, then ordered by the
chains of parents, whose ranks are refined by pointer doubling.

At the top level, tuples are (position, common prefix with the entry before).
The common prefix of two induced suffixes is one more than the least value
popped between the entries that induced them; a running least for each queue
carries it over batches. Those of the S* suffixes, from which it starts, are
found bit by bit by 64-bit hashes. Values are clamped at ``limit``: suffixes that
share that many symbols count as tied, which is all that repeats of at least
``limit`` symbols need.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Callable, Iterator

import numpy as np

from .common import U, mix

#: Entries of a batch; bytes of queues held in memory before they go to disk; bytes of arrays that are held in memory, beyond which new ones are files.
BATCH = 1 << 17
SPILL_BYTES = 8 << 20
MEMORY_BYTES = 24 << 20
#: Symbols within which most neighbours part.
FEW = 16
#: Ranges of symbols that are counted apart.
BINS = 1 << 16
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_BASE), -1, 1 << 64))


class Scratch:
    """Arrays of one task: in memory up to a bound, then on its own disk, gone with it."""

    def __init__(self, folder: str):
        self.folder, self.files, self.maps, self.used, self.held = folder, 0, {}, 0, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"run{self.files}")

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.held + size <= MEMORY_BYTES:
            self.held += size
            return np.zeros(n, kind)
        return self.mapped(self.path(), kind, n, "w+")

    def mapped(self, path: str, kind, n: int, mode: str = "r") -> np.ndarray:
        if not n:
            return np.zeros(0, kind)
        x = np.memmap(path, kind, mode, shape=(n,))
        self.maps[id(x)] = (x, path)
        return x

    def free(self, x: np.ndarray) -> None:
        """Give an array of ``array`` or a writer back; it is not used again."""
        if id(x) in self.maps:
            os.unlink(self.maps.pop(id(x))[1])
        else:
            self.held -= x.nbytes

    def relax(self, entries: int = 0) -> None:
        """Give mapped pages back after every few batches; they stay in their files."""
        self.used += entries or BATCH
        if self.used >= 4 * BATCH:
            self.used = 0
            for x, _ in self.maps.values():
                x._mmap.madvise(mmap.MADV_DONTNEED)


class _Writer:
    """Positions as they come: in memory while there is room, else to a file."""

    def __init__(self, scratch: Scratch, kind):
        self.scratch, self.kind, self.n, self.parts, self.path, self.f = scratch, np.dtype(kind), 0, [], "", None

    def add(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.kind)
        if self.f is None and self.scratch.held + x.nbytes > MEMORY_BYTES:
            self.path = self.scratch.path()
            self.f = open(self.path, "wb")  # noqa: SIM115
            for y in self.parts:
                self.f.write(y.tobytes())
                self.scratch.held -= y.nbytes
            self.parts = []
        if self.f is None:
            self.scratch.held += x.nbytes
            self.parts.append(x.copy())
        else:
            self.f.write(x.tobytes())
        self.n += len(x)

    def array(self) -> np.ndarray:
        if self.f is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        self.f.close()
        return self.scratch.mapped(self.path, self.kind, self.n)


def _kind(n: int):
    """The type of positions in a string."""
    return np.int32 if n < 1 << 30 else np.int64


class Queues:
    """A FIFO of tuples of arrays for each range of symbols, on disk beyond ``SPILL_BYTES``."""

    def __init__(self, ranges: int, scratch: Scratch):
        self.items: list[list] = [[] for _ in range(ranges)]
        self.at = [0] * ranges
        self.held, self.scratch, self.spills = 0, scratch, 0

    def push(self, c: int, *arrays: np.ndarray) -> None:
        self.items[c].append(arrays)
        self.held += sum(x.nbytes for x in arrays)
        if self.held > SPILL_BYTES:
            self.spill()

    def push_by(self, to: np.ndarray, pos: np.ndarray) -> None:
        """Positions to the queues ``to``, in their order."""
        if not len(to):
            return
        o = np.argsort(to, kind="stable")
        to, pos = to[o], pos[o]
        heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        for c, a, b in zip(to[heads].tolist(), heads.tolist(), np.append(heads[1:], len(to)).tolist(), strict=True):
            self.push(c, pos[a:b])

    def spill(self) -> None:
        path = self.scratch.path()
        with open(path, "wb") as f:
            for items in self.items:
                for k, x in enumerate(items):
                    if isinstance(x[0], np.ndarray):
                        items[k] = (path, f.tell(), len(x[0]), [y.dtype for y in x])
                        for y in x:
                            f.write(y.tobytes())
        self.held = 0
        self.spills += 1

    @staticmethod
    def _get(x) -> tuple[np.ndarray, ...]:
        if isinstance(x[0], np.ndarray):
            return x
        path, at, n, kinds = x
        with open(path, "rb") as f:
            f.seek(at)
            return tuple(np.frombuffer(f.read(n * k.itemsize), k) for k in kinds)

    def pop(self, c: int) -> tuple[np.ndarray, ...] | None:
        """What was pushed and not yet popped, about a batch at most; None if nothing is left."""
        got, n = [], 0
        while self.at[c] < len(self.items[c]) and n < BATCH:
            got.append(self._get(self.items[c][self.at[c]]))
            n += len(got[-1][0])
            self.at[c] += 1
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None

    def drop(self, c: int) -> None:
        """Forget a queue that is not asked again."""
        self.held -= sum(y.nbytes for x in self.items[c] if isinstance(x[0], np.ndarray) for y in x)
        self.items[c], self.at[c] = [], 0

    def backwards(self, c: int) -> Iterator[tuple[np.ndarray, ...]]:
        """All entries of a queue from the last to the first, in pieces."""
        got, n = [], 0
        for x in reversed(self.items[c]):
            got.append(tuple(y[::-1] for y in self._get(x)))
            n += len(got[-1][0])
            if n >= BATCH:
                yield tuple(np.concatenate(y) for y in zip(*got, strict=True))
                got, n = [], 0
        if got:
            yield tuple(np.concatenate(y) for y in zip(*got, strict=True))


# ---------------------------------------------------------------- types and names


def _types(text: np.ndarray, a: int, b: int, after: bool) -> np.ndarray:
    """Whether the suffixes from [a, b) are smaller than the next one; ``after``: that of b (the end counts as larger than all)."""
    x = text[a : min(b + 1, len(text))]
    change = np.flatnonzero(x[1:] != x[:-1])  # the last of each run of equal symbols
    up = np.append(x[change] < x[change + 1], after)
    return np.repeat(up, np.diff(np.concatenate(([-1], change, [len(x) - 1]))))[: b - a]


def star_positions(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """S* positions, ascending."""
    n, borders = len(text), list(range(0, len(text), 4 * BATCH))
    after = [True] * (len(borders) + 1)
    for k in range(len(borders) - 1, 0, -1):  # the type at each border, from the right
        after[k] = bool(_types(text, borders[k], min(n, borders[k] + 4 * BATCH), after[k + 1])[0])
    out, before = _Writer(scratch, _kind(n)), True
    for k, a in enumerate(borders):
        small = _types(text, a, min(n, a + 4 * BATCH), after[k + 1])
        out.add(np.flatnonzero(small & ~np.concatenate(([before], small[:-1]))) + a)
        before = bool(small[-1])
        scratch.relax(4 * BATCH)
    return out.array()


class _Substrings:
    """The S* substrings of a level: from each S* position to the next one, both included."""

    def __init__(self, text: np.ndarray, stars: np.ndarray, scratch: Scratch):
        self.text, self.stars, self.n = text, stars, len(text)
        self.bits = 9 if text.dtype == np.uint16 else 32
        self.pad, self.fit = (1 << self.bits) - 1, 63 // self.bits  # beyond its end, a substring is larger than one that goes on
        self.ids = scratch.array(len(stars), np.uint64)
        a = 0
        while a < len(stars):  # hashes, a run of substrings at a time, a longer one in pieces
            b = a + max(1, int(np.searchsorted(stars[a : a + BATCH], stars[a] + 4 * BATCH)))
            at, end = stars[a:b].astype(np.int64), self.ends(np.arange(a, b))
            if b == a + 1:
                lo, hi = int(at[0]), int(end[0])
                total = sum(int(_sums(text[x : min(hi, x + 4 * BATCH)])[-1]) * pow(int(_BASE), x - lo, 1 << 64) for x in range(lo, hi, 4 * BATCH))
                x = np.array([total % (1 << 64)], np.uint64)
            else:
                h = _sums(text[at[0] : end[-1]])
                x = (h[end - at[0]] - h[at - at[0]]) * _powers(_BACK, int(at[-1] - at[0]) + 1)[at - at[0]]
            self.ids[a:b] = mix(x + (end - at).astype(np.uint64) * U(0x9FB21C651E98DF25))
            a = b
            scratch.relax()

    def ends(self, i: np.ndarray) -> np.ndarray:
        """Where the substrings end (after the last symbol)."""
        nxt = np.minimum(i + 1, len(self.stars) - 1)
        return np.where(i + 1 < len(self.stars), self.stars[nxt].astype(np.int64) + 1, self.n)

    def symbols(self, i: np.ndarray, k: int) -> np.ndarray:
        """The k-th symbol of each substring."""
        at = self.stars[i].astype(np.int64) + k
        inside = at < self.ends(i)
        return np.where(inside, self.text[np.where(inside, at, 0)].astype(np.int64), self.pad)

    def word(self, i: np.ndarray, k: int) -> np.ndarray:
        """The k-th run of ``fit`` symbols of each substring, as one number."""
        out, at, end = np.zeros(len(i), np.uint64), self.stars[i].astype(np.int64) + k * self.fit, self.ends(i)
        for _ in range(self.fit):
            inside = at < end
            out <<= U(self.bits)
            out |= np.where(inside, self.text[np.where(inside, at, 0)], self.pad).astype(np.uint64)
            at += 1
        return out

    def ordered(self, i: np.ndarray) -> np.ndarray:
        """The substrings in order; equal ones as they come."""
        w, k, at, group = self.word(i, 0), 0, np.arange(len(i)), np.zeros(len(i), np.int64)
        while len(at):  # groups of equal words whose substrings differ are ordered by the next word
            o = np.lexsort((w, group)) if k else np.argsort(w, kind="stable")
            i[at], w, group = i[at][o], w[o], group[o]
            begin = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (group[1:] != group[:-1]))))
            size, ids = np.diff(np.append(begin, len(at))), self.ids[i[at]]
            mixed = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
            at, group, k = at[np.repeat(mixed, size)], np.repeat(np.flatnonzero(mixed), size[mixed]), k + 1
            w = self.word(i[at], k)
        return i

    def digit(self, i: np.ndarray, r: int) -> np.ndarray:
        """The r-th digit of each substring: a symbol, or 16 bits of it."""
        if self.bits < 16:
            return self.symbols(i, r)
        return (self.symbols(i, r // 2) >> (0 if r % 2 else 16)) & 0xFFFF

    def runs(self, source: Callable[[], Iterator[np.ndarray]], n: int, scratch: Scratch, r: int = 0) -> Iterator[np.ndarray]:
        """All substrings of ``source`` in order, a batch or so at a time: dealt by digits until a run fits."""
        if n <= 4 * BATCH:
            got = list(source())
            if got:
                yield self.ordered(np.concatenate(got))  # a copy: sorted in place
            return
        count, least, most = np.zeros(1 << 16, np.int64), U(0), U(0)
        for k, i in enumerate(source()):
            count += np.bincount(self.digit(i, r), minlength=1 << 16)
            ids = self.ids[i]
            least, most = (ids.min(), ids.max()) if not k else (min(least, ids.min()), max(most, ids.max()))
            scratch.relax()
        if least == most:  # one substring, over and over
            yield from source()
            return
        to, runs, held = np.zeros(1 << 16, np.int64), [], 0
        for d in np.flatnonzero(count).tolist():
            if not runs or held + count[d] > 4 * BATCH:
                runs.append([])
                held = 0
            runs[-1].append(d)
            held += int(count[d])
            to[d] = len(runs) - 1
        dealt = Queues(len(runs), scratch)
        for i in source():
            dealt.push_by(to[self.digit(i, r)], i)
            scratch.relax()
        for c, digits in enumerate(runs):
            def again(c: int = c) -> Iterator[np.ndarray]:
                dealt.at[c] = 0
                while (got := dealt.pop(c)) is not None:
                    yield got[0]

            yield from self.runs(again, int(count[digits].sum()), scratch, r + 1)
            dealt.drop(c)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers of the base below the n-th."""
    p = np.full(n, base)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _sums(text: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over symbols, mod 2**64."""
    out = np.empty(len(text) + 1, np.uint64)
    out[0] = 0
    np.multiply(mix(np.asarray(text).astype(np.uint64) + U(1)), _powers(_BASE, len(text)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


# ---------------------------------------------------------------- order of all suffixes of a string of many symbols


class _Ranges:
    """Ranges of symbols with a batch of suffixes each at most, or of one symbol; ``down``: counted from the greatest."""

    def __init__(self, text: np.ndarray, scratch: Scratch):
        top, n = 0, len(text)
        for a in range(0, n, 4 * BATCH):
            top = max(top, int(text[a : a + 4 * BATCH].max()))
        self.top, shift = top, max(0, (top + 1).bit_length() - BINS.bit_length() + 1)
        count = np.zeros((top >> shift) + 1, np.int64)
        for a in range(0, n, 4 * BATCH):
            count += np.bincount(text[a : a + 4 * BATCH] >> shift, minlength=len(count))
            scratch.relax(4 * BATCH)
        big = np.flatnonzero(count > BATCH)  # n / BATCH at most: their symbols are counted apart
        fine = {b: np.zeros(1 << shift, np.int64) for b in big.tolist()} if shift else {}
        for a in range(0, n if fine else 0, 4 * BATCH):
            x = np.asarray(text[a : a + 4 * BATCH]).astype(np.int64)
            for b in np.intersect1d(big, x >> shift).tolist():
                fine[b] += np.bincount(x[(x >> shift) == b] - (b << shift), minlength=1 << shift)
        edges, held = [0], 0
        for b in np.flatnonzero(count).tolist():
            parts = [((b << shift) + int(k), int(fine[b][k]), 1) for k in np.flatnonzero(fine[b])] if b in fine else [(b << shift, int(count[b]), 1 << shift)]
            for symbol, size, width in parts:
                if held and held + size > BATCH:
                    edges.append(symbol)
                    held = 0
                held += size
                if held > BATCH:  # one symbol (or bin of one) alone
                    edges.append(symbol + width)
                    held = 0
        self.edges = np.unique(np.array([*edges, top + 1], np.int64))

    def of(self, down: bool) -> np.ndarray:
        """Borders of the ranges in the order in which they are popped."""
        return self.top + 1 - self.edges[::-1] if down else self.edges


def _chains(sym: np.ndarray, kind: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Order of a range's entries: by symbol; what came from outside (0), then from inside (1) by its parent's place, then seeds (2)."""
    n = len(sym)
    root = kind != 1
    second = np.where(root, np.arange(n), 0)
    o = np.lexsort((second, kind, sym))
    new = np.concatenate(([True], (sym[o][1:] != sym[o][:-1]) | (kind[o][1:] != kind[o][:-1]) | (second[o][1:] != second[o][:-1])))
    rank = np.empty(n, np.int64)
    rank[o] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    up = np.where(root, np.arange(n), parent)
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = o[np.repeat(size, size) > 1]
    while len(tied):  # ranks by chains twice as long
        k1, k2 = rank[tied], rank[up[tied]]
        t = np.lexsort((k2, k1))
        tied, k1, k2 = tied[t], k1[t], k2[t]
        at, g = np.arange(len(tied)), np.concatenate(([True], k1[1:] != k1[:-1]))
        h = g | np.concatenate(([True], k2[1:] != k2[:-1]))
        up = up[up]
        rank[tied] = k1 + np.maximum.accumulate(np.where(h, at, 0)) - np.maximum.accumulate(np.where(g, at, 0))
        size = np.diff(np.append(np.flatnonzero(h), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _induce(text: np.ndarray, seeds: Iterator[np.ndarray], ranges: _Ranges, down: bool, scratch: Scratch, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Pops seeds and what they induce in order; ``emit`` gets (positions, whether induced).

    ``down``: from the greatest suffix to the least; then a position induces the
    one in front of it if that has a smaller symbol, or the same and the former
    is induced itself. Else the mirror image.
    """
    top, edges = ranges.top, ranges.of(down)
    symbol = (lambda p: top - text[p].astype(np.int64)) if down else (lambda p: text[p].astype(np.int64))
    queues, n = Queues(len(edges) - 1, scratch), len(text)
    if down:  # the end counts as the greatest suffix: it induces the last position
        queues.push(int(np.searchsorted(edges, top - int(text[n - 1]), "right")) - 1, np.array([n - 1]))

    def front(pos: np.ndarray, sym: np.ndarray, induced: np.ndarray) -> np.ndarray:
        """The symbol in front of each position if that is induced, else -1."""
        d = symbol(np.maximum(pos - 1, 0))
        return np.where((pos > 0) & ((d > sym) | ((d == sym) & induced)), d, -1)

    def push(pos: np.ndarray, d: np.ndarray) -> None:
        f = np.flatnonzero(d >= 0)
        queues.push_by(np.searchsorted(edges, d[f], "right") - 1, pos[f] - 1)

    held = np.zeros(0, np.int64)

    def seeds_below(c: int) -> Iterator[np.ndarray]:
        nonlocal held
        while True:
            k = int(np.searchsorted(symbol(held), c)) if len(held) else 0
            got, held = held[:k], held[k:]
            if len(got):
                yield got
            if len(held):
                return
            held = next(seeds, np.zeros(0, np.int64))
            if not len(held):
                return

    for r, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if hi == lo + 1:  # one symbol: arrival is the order
            while (got := queues.pop(r)) is not None:
                pos, yes = got[0], np.ones(len(got[0]), bool)
                emit(pos, yes)
                push(pos, front(pos, np.full(len(pos), lo), yes))
                scratch.relax(len(pos))
            for pos in seeds_below(hi):
                emit(pos, np.zeros(len(pos), bool))
                push(pos, front(pos, np.full(len(pos), lo), np.zeros(len(pos), bool)))
                scratch.relax(len(pos))
        else:
            came = []
            while (got := queues.pop(r)) is not None:
                came.append(got[0])
            own = list(seeds_below(hi))
            pos = [np.concatenate(came) if came else np.zeros(0, np.int64), np.concatenate(own) if own else np.zeros(0, np.int64)]
            kind, parent = [np.zeros(len(pos[0]), np.int8), np.full(len(pos[1]), 2, np.int8)], [np.zeros(len(pos[0]) + len(pos[1]), np.int64)]
            p, first = np.concatenate(pos), 0
            pos, sym, ahead = [p], [symbol(p)], []
            k = np.concatenate(kind)
            kinds = [k]
            while len(p):  # what the range induces within itself
                ahead.append(d := front(p, sym[-1], k != 2))
                f = np.flatnonzero((d >= 0) & (d < hi))
                parent.append(first + f)
                first += len(p)
                p, k = p[f] - 1, np.ones(len(f), np.int8)
                pos.append(p)
                sym.append(d[f])
                kinds.append(k)
            p, y, k, d = np.concatenate(pos), np.concatenate(sym), np.concatenate(kinds), np.concatenate(ahead) if ahead else np.zeros(0, np.int64)
            if len(p):
                o = _chains(y, k, np.concatenate(parent))
                p, d = p[o], d[o]
                emit(p, k[o] != 2)
                push(p, np.where(d >= hi, d, -1))
            scratch.relax(len(p))
        queues.drop(r)


def _chunks(x: np.ndarray, scratch: Scratch, back: bool = False) -> Iterator[np.ndarray]:
    for a in reversed(range(0, len(x), BATCH)) if back else range(0, len(x), BATCH):
        part = np.asarray(x[a : a + BATCH]).astype(np.int64)
        yield part[::-1] if back else part
        scratch.relax()


def suffix_order(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of a string of names by falling suffixes; the end of the string counts as larger than all."""
    ranges, stars, kind = _Ranges(text, scratch), sorted_stars(text, scratch), _kind(len(text))
    large, all_ = _Writer(scratch, kind), _Writer(scratch, kind)
    _induce(text, _chunks(stars, scratch), ranges, False, scratch, lambda pos, induced: large.add(pos[induced]))
    scratch.free(stars)
    seeds = large.array()
    _induce(text, _chunks(seeds, scratch, True), ranges, True, scratch, lambda pos, _: all_.add(pos))
    scratch.free(seeds)
    return all_.array()


def sorted_stars(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """S* positions in the order of their suffixes."""
    stars = star_positions(text, scratch)
    if len(stars) < 2:
        return stars
    subs = _Substrings(text, stars, scratch)
    names, order, name, last = scratch.array(len(stars), np.uint32), _Writer(scratch, _kind(len(stars))), -1, None
    for i in subs.runs(lambda: (np.arange(a, min(len(stars), a + BATCH)) for a in range(0, len(stars), BATCH)), len(stars), scratch):
        ids = subs.ids[i]
        new = np.concatenate(([last is None or ids[0] != last], ids[1:] != ids[:-1]))
        names[i] = name + np.cumsum(new)
        name, last = name + int(new.sum()), ids[-1]
        order.add(i)
        scratch.relax(len(i))
    scratch.free(subs.ids)
    by, back = order.array(), name + 1 < len(stars)
    if back:
        scratch.free(by)
        by = suffix_order(names, scratch)
    scratch.free(names)
    out = _Writer(scratch, _kind(len(text)))
    for i in _chunks(by, scratch, back):
        out.add(stars[i])
    scratch.free(by)
    scratch.free(stars)
    return out.array()


# ---------------------------------------------------------------- the text: order with common prefixes


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo..hi]) for each pair, by a sparse table."""
    if not len(lo):
        return np.zeros(0, x.dtype)
    width = hi - lo + 1
    k = (np.frexp(width.astype(np.float64))[1] - 1).astype(np.int64)
    rows = [x]
    for j in range(int(k.max())):
        y = rows[-1].copy()
        h = 1 << j
        np.minimum(rows[-1][:-h], rows[-1][h:], out=y[:-h])
        rows.append(y)
    t = np.stack(rows)
    return np.minimum(t[k, lo], t[k, hi - (1 << k) + 1])


class _Induction:
    """One direction over the text: takes popped batches of one symbol, pushes what they induce."""

    def __init__(self, text: np.ndarray, queues: Queues, limit: int, down: bool):
        self.text, self.q, self.limit, self.down = text, queues, limit, down
        self.carry = np.full(len(queues.items), limit, np.int16)
        self.begun = np.zeros(len(queues.items), bool)

    def take(self, c: int, pos: np.ndarray, lcp: np.ndarray, induced: bool) -> None:
        """Entries whose first symbol is c; ``induced``: they were pushed here, not seeds."""
        front = self.text[np.maximum(pos - 1, 0)].astype(np.int64)
        wanted = (front < c) if self.down else (front > c)
        if induced:
            wanted |= front == c
        ix = np.flatnonzero(wanted & (pos > 0))
        low = np.minimum.accumulate(lcp)
        if not len(ix):
            np.minimum(self.carry, low[-1], out=self.carry)
            return
        to = front[ix]
        o = np.argsort(to, kind="stable")
        ix, to = ix[o], to[o]
        first = np.concatenate(([True], to[1:] != to[:-1]))
        least = np.empty(len(ix), np.int16)
        least[first] = np.minimum(self.carry[to[first]], low[ix[first]])
        rest = np.flatnonzero(~first)
        least[rest] = _range_min(lcp, ix[rest - 1] + 1, ix[rest])
        value = np.minimum(least + np.int16(1), np.int16(self.limit))
        heads = np.flatnonzero(first)
        new = heads[~self.begun[to[heads]]]
        value[new] = 0
        # carries: what was popped after the last entry that went to a queue
        np.minimum(self.carry, low[-1], out=self.carry)
        tails = np.append(heads[1:], len(ix)) - 1
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(self.limit))
        self.carry[to[tails]] = after[ix[tails] + 1]
        self.begun[to[heads]] = True
        made = pos[ix] - 1
        for a, b in zip(heads.tolist(), (tails + 1).tolist(), strict=True):
            self.q.push(int(to[a]), made[a:b], value[a:b])


def _run(text: np.ndarray, i: int, limit: int) -> int:
    """Equal symbols from i on, ``limit`` at most."""
    part = text[i : i + limit]
    differ = np.flatnonzero(part != part[0])
    return int(differ[0]) if len(differ) else len(part)


def star_prefixes(text: np.ndarray, order: np.ndarray, limit: int, scratch: Scratch) -> np.ndarray:
    """Each position's common prefix with the one before it in the order (clamped; 0 for the first)."""
    n, out = len(text), scratch.array(len(order), np.int16)
    sums, lead = scratch.array(n + 1, np.uint64), 1
    for a in range(0, n, 4 * BATCH):
        part = _sums(text[a : a + 4 * BATCH])[1:]
        sums[a + 1 : a + 1 + len(part)] = part * U(lead) + sums[a]
        lead = lead * pow(int(_BASE), len(part), 1 << 64) % (1 << 64)
        scratch.relax(4 * BATCH)
    low = _powers(_BASE, 1 << 16)
    high = _powers(U(pow(int(_BASE), 1 << 16, 1 << 64)), (n >> 16) + 1)
    for at in range(1, len(order), BATCH):
        x, y = order[at - 1 : at - 1 + BATCH][: len(order) - at], order[at : at + BATCH]
        a, b = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
        shift = low[(b - a) & 0xFFFF] * high[(b - a) >> 16]
        lcp, step, live = np.zeros(len(a), np.int64), 1 << (limit.bit_length() - 1), np.arange(len(a))
        if step > FEW:  # neighbours that part within FEW symbols need no longer steps
            fits = np.flatnonzero(b + FEW <= n)
            u, v = a[fits], b[fits]
            live = fits[(sums[u + FEW] - sums[u]) * shift[fits] == sums[v + FEW] - sums[v]]
        while step:  # the longest equal prefix, bit by bit
            if step == FEW // 2:
                live = np.arange(len(a))
            f = live[(lcp[live] + step <= limit) & (b[live] + lcp[live] + step <= n)]
            u, v = a[f] + lcp[f], b[f] + lcp[f]
            same = (sums[u + step] - sums[u]) * shift[f] == sums[v + step] - sums[v]
            lcp[f[same]] += step
            step >>= 1
        out[at : at + len(lcp)] = lcp
        scratch.relax(4 * BATCH)
    scratch.free(sums)
    return out


def repeated_starts(text: np.ndarray, limit: int, scratch: Scratch) -> np.ndarray:
    """Whether the next ``limit`` symbols from each position occur from another position too.

    ``text``: uint16, strings of symbols 1..256 each ended by 0.
    """
    n = len(text)
    hit = scratch.array(n, bool)
    if n < 2:
        return hit
    order = sorted_stars(text, scratch)
    star_lcp = star_prefixes(text, order, limit, scratch)
    symbols = 257
    count = np.zeros(symbols, np.int64)
    for pos in _chunks(order, scratch):
        count += np.bincount(text[pos], minlength=symbols)
    bounds = np.concatenate(([0], np.cumsum(count))).tolist()
    kind = np.int32 if n < 2**31 else np.int64
    large = Queues(symbols, scratch)
    up = _Induction(text, large, limit, False)
    for c in range(symbols):
        last = -1
        while (got := large.pop(c)) is not None:
            up.take(c, *got, True)
            last = int(got[0][-1])
            scratch.relax(len(got[0]))
        for k in range(bounds[c], bounds[c + 1], BATCH):
            pos, lcp = (np.asarray(x[k : min(bounds[c + 1], k + BATCH)]) for x in (order, star_lcp))
            pos, lcp = pos.astype(kind), lcp.copy()
            if k == bounds[c]:
                lcp[0] = 0 if last < 0 else min(_run(text, last, limit), _run(text, int(pos[0]), limit))
            up.take(c, pos, lcp, False)
            scratch.relax()
    few = Queues(symbols, scratch)
    down = _Induction(text, few, limit, True)
    before = -1

    def seen(c: int, pos: np.ndarray, lcp: np.ndarray, induced: bool) -> None:
        nonlocal before
        long = lcp >= limit
        hit[pos[long]] = True
        hit[pos[np.flatnonzero(long[1:])]] = True
        if long[0] and before >= 0:
            hit[before] = True
        before = int(pos[-1])
        down.take(c, pos, lcp, induced)
        scratch.relax(len(pos))

    for c in range(symbols - 1, -1, -1):
        last, shift = -1, None
        while (got := few.pop(c)) is not None:
            last = int(got[0][-1])
            seen(c, *got, True)
        few.drop(c)
        for pos, lcp in large.backwards(c):
            # backwards, an entry's value belongs to the entry that follows it
            lead = shift if shift is not None else 0 if last < 0 else min(_run(text, last, limit), _run(text, int(pos[0]), limit))
            shift = int(lcp[-1])
            seen(c, np.ascontiguousarray(pos), np.concatenate(([lead], lcp[:-1])).astype(np.int16), False)
        large.drop(c)
    scratch.free(order)
    scratch.free(star_lcp)
    return hit
