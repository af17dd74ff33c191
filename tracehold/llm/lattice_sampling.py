"""SentencePiece lattices: distinct sampled segmentations by Gumbel top-k, and decoding.

A text's segmentations are the paths of its lattice of vocabulary pieces, with probabilities from piece
weights. Gumbel top-k draws k of them without replacement: give every path a Gumbel-perturbed
log-probability and keep the k largest. A perturbed A-star search finds those without listing paths. A
node is a set of paths (a prefix whose next piece is none of some); its bound is the largest perturbed
value in it, drawn from its total mass, which backward sums give exactly. The best node is taken from
the queue, its best path is completed by sampling, and the sets that branch off that path are queued
with bounds drawn below its value. Bounds are kept as times exp(-value), where the largest of a set of
mass m below a bound t is t + Exp(1)/m; they are logarithms throughout, as m falls below any double.

No piece crosses a word border, nor a place between two bytes that no piece has next to each other. A
text is cut at all of these, so its lattice is a chain of short lattices, each worked out once per task
and remembered; all parts of a slice of texts are walked at once with numpy. Every draw is a hash of the
row key, the sample's number and the place in the text: it depends on no batch, partition or retry.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import partial
from itertools import compress, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, kept, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Edges of word lattices that a task remembers, and bytes of text walked at once.
REMEMBERED, WALKED = 2_000_000, 1 << 20
#: Words met at most so many times are not remembered. How often is counted by hash: counters as a power of two, and
#: how many are used before all start again.
SELDOM, MET_BITS, MET = 2, 22, 500_000
_BLOCK = 512
#: Low bits that the buckets of the prefix table leave out.
_TOP = 46
_UNIT = re.compile(r" *[^ ]+| +$")
_SPACE = "▁"


def weights(processor) -> tuple[dict[str, tuple[int, float]], np.ndarray, np.ndarray]:
    """Piece to id and log-weight, the ids of the 256 byte pieces, and their log-weights. Merge ranks
    become probabilities by Zipf's law; bytes stand under every other piece."""
    n = processor.get_piece_size()
    plain = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
    order = sorted(plain, key=lambda i: (-processor.get_score(i), i))
    rank = {i: r for r, i in enumerate(order)}
    total = np.log(sum(1.0 / (r + 2) for r in rank.values()))
    pieces = {processor.id_to_piece(i): (i, float(-np.log(rank[i] + 2) - total)) for i in plain}
    low = float(-np.log(len(plain) + 2) - total) - 1.0
    return pieces, np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]), np.full(256, low)


def units(text: str) -> list[str]:
    """The words of a text, each with the spaces before it; the model puts one space before a text. The parts that
    ``Lattices.cut`` gives are these words, or parts of them."""
    if not text:
        return []
    if "  " in text or "\0" in text or text[0] == " " or text[-1] == " ":
        return _UNIT.findall(" " + text)
    return f" {text}".replace(" ", "\0 ").split("\0")[1:]  # one space before each word: the same, sooner


class Lattices:
    """Word lattices as arrays. State s has the edges start[s]..start[s+1], the likeliest first, whose
    running probabilities plus s are ``upto``: one sorted array to draw from for all states at once.
    ``lead`` is the probability of a state's first edge, ``rest`` the log of what its state has besides
    an edge, and ``next`` is -1 at the end of a word."""

    _BY_STATE = {"start": np.int64, "offset": np.int32, "lead": float}
    _BY_EDGE = {"upto": float, "logp": float, "rest": float, "piece": np.int32, "next": np.int32}

    def __init__(self, pieces, byte_ids, byte_weights):
        self.byte_ids, self._byte_weight = byte_ids, byte_weights.tolist().__getitem__
        self.longest = max(map(len, pieces), default=1)
        prefixes: dict[str, tuple[int, float]] = {}
        for p, (i, w) in pieces.items():
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], (-1, 0.0))
            prefixes[p] = (i, w)
        size = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        codes, h = np.frombuffer("".join(prefixes).encode("utf-32-le"), np.uint32).astype(np.uint64), np.zeros(len(prefixes), np.uint64)
        at, start = np.arange(len(prefixes)), np.cumsum(size) - size
        for k in range(self.longest):
            at = at[size[at] > k]
            h[at] = self._mix(h[at], codes[start[at] + k])
        order = np.argsort(h)
        self._prefix = h[order]
        self._piece, self._weight = [np.array(x)[order] for x in zip(*prefixes.values())]
        starts = np.searchsorted(self._prefix >> np.uint64(_TOP), np.arange(1 << 64 - _TOP, dtype=np.uint64))
        self._bucket = np.minimum(starts, len(order) - 1).astype(np.int32)
        self._joined = np.zeros(1 << 16, bool)
        for raw in (p.replace(_SPACE, " ").encode() for p in pieces):
            self._joined[[a << 8 | b for a, b in zip(raw, raw[1:])]] = True
        self._joined.reshape(256, 256)[:, 0x80:0xC0] = True  # never within a character
        self._met, self._marks = np.zeros(1 << MET_BITS, np.uint8), 0
        for n, t in (self._BY_STATE | self._BY_EDGE).items():
            setattr(self, n, np.zeros(1 << 12, t))
        self.forget()

    def _prefixes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes among those of all prefixes of pieces, and which are there."""
        k = self._bucket[(h >> np.uint64(_TOP)).astype(np.int64)]
        less = np.flatnonzero(self._prefix[k] < h)
        while len(less):
            less = less[k[less] + 1 < len(self._prefix)]
            k[less] += 1
            less = less[self._prefix[k[less]] < h[less]]
        return k, self._prefix[k] == h

    @staticmethod
    def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (codes + np.uint64(0x51ED))) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(29))

    def forget(self) -> None:
        """How often words were met is still known, so that those that come again are remembered at once."""
        self._known: dict[bytes, int] = {}
        self._passing: tuple[list[bytes], np.ndarray] = [], np.zeros(0, np.int64)
        self.states = self.edges = 0
        self._kept = 0, 0

    @property
    def first(self) -> dict[str, int]:
        """The first state of every word that is known until the next call of ``learn``."""
        return {w.decode("utf-8", "surrogatepass"): s for w, s in [*self._known.items(), *zip(self._passing[0], self._passing[1].tolist())]}

    def _append(self, names, count: int, n: int, spare: int, **new) -> int:
        for name in names:
            x = getattr(self, name)
            if n + count + spare > len(x):
                x = np.concatenate([x[:n], np.zeros(max(len(x), count + spare), x.dtype)])
                setattr(self, name, x)
            x[n:n + count] = new[name]
        return n + count

    def cut(self, raws: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
        """The parts of some texts, each text with the space that the model puts before it: what is cut at word borders
        and wherever two bytes meet that no piece has next to each other. Then how many parts each text has, and
        how many characters of its text come before each part."""
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        size += size > 0
        data = b"".join([b" " + x for x in raws if x])
        if not data:
            return pa.array([], pa.binary()), np.zeros(len(raws), np.int64), np.zeros(0, np.int64)
        code, begin = np.frombuffer(data, np.uint8), np.cumsum(size) - size
        new = np.ones(len(code), bool)
        np.logical_not(self._joined[code[:-1].astype(np.uint16) << 8 | code[1:]], out=new[1:])
        space = code == ord(" ")
        new[1:] |= space[1:] & ~space[:-1]
        new[begin[size > 0]] = True
        start = np.flatnonzero(new)
        parts = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(code)).astype(np.int32)), pa.py_buffer(data)])
        count = np.diff(np.searchsorted(start, np.append(begin, len(code))))
        before = start - np.repeat(begin, count)
        late = np.flatnonzero((code & 0xC0) == 0x80)  # a character has one byte that is not one of these
        if len(late):
            before -= np.searchsorted(late, start) - np.repeat(np.searchsorted(late, begin), count)
        return parts, count, before

    def learn(self, units: list[str]) -> np.ndarray:
        """The first state of each word."""
        return self.states_of(pa.array([as_bytes(u) for u in units], pa.binary()))

    def states_of(self, parts: pa.BinaryArray) -> np.ndarray:
        """The first state of each part; the lattices of parts that are not remembered are worked out. One met
        seldom is known until the next call only: most such parts never come again."""
        self.states, self.edges = self._kept
        self.start[self.states] = self.edges
        parts = parts.dictionary_encode()
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = np.fromiter(map(self._known.get, words, repeat(-1)), np.int64, len(words))
        new = first < 0
        fresh, names = np.flatnonzero(new), list(compress(words, new.tolist()))
        marks = np.fromiter(map(hash, names), np.int64, len(names)) & (1 << MET_BITS) - 1
        times = self._met[marks]
        self._marks += int(np.count_nonzero(times == 0))
        if self._marks > MET:
            self._met[:], self._marks = 0, 0
        often = times >= SELDOM
        self._met[marks] = np.minimum(times, SELDOM) + 1
        known, passing = (list(compress(names, x.tolist())) for x in (often, ~often))
        first[fresh[often]] = starts = self._add(known)
        self._known.update(zip(known, starts.tolist()))
        self._kept = self.states, self.edges
        first[fresh[~often]] = starts = self._add(passing)
        self._passing = passing, starts
        return first[parts.indices.to_numpy()]

    def _add(self, fresh: list[bytes]) -> np.ndarray:
        """Work out the lattices of the words, and give their first states."""
        if not fresh:
            return np.zeros(0, np.int64)
        raw = b"".join(fresh)
        text = raw.decode("utf-8", "surrogatepass")
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        if len(text) < len(raw):
            size = np.add.reduceat((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        # the mark for spaces is a character too: where a text holds it, it goes as bytes
        codes[codes == ord(_SPACE)] = 0
        codes[codes == ord(" ")] = ord(_SPACE)
        n, ends = len(codes), np.cumsum(size)
        end, begin = np.repeat(ends, size), np.repeat(ends - size, size)
        src, dst, piece, weight = [], [], [], []
        at, h, alone = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, bool)
        for length in range(1, self.longest + 1):
            fits = at + length <= end[at]
            at, h = at[fits], self._mix(h[fits], codes[at[fits] + length - 1])
            k, known = self._prefixes(h)
            at, h, k = at[known], h[known], k[known]
            ids = self._piece[k]
            whole = np.flatnonzero(ids >= 0)
            here = at[whole]
            src.append(here), dst.append(here + length), piece.append(ids[whole]), weight.append(self._weight[k[whole]])
            if length == 1:
                alone[here] = True
        chains = [(i, as_bytes(text[i])) for i in np.flatnonzero(~alone).tolist()]  # no piece for the character alone: its bytes, one path
        src.append(np.array([i for i, _ in chains], np.int64))
        dst.append(src[-1] + 1)
        piece.append(np.array([self.byte_ids[raw[0]] for _, raw in chains], np.int64))
        weight.append(np.array([sum(map(self._byte_weight, raw)) for _, raw in chains], float))
        by_bytes = np.repeat([False, True], [sum(map(len, src[:-1])), len(chains)])
        src, dst, piece, weight = map(np.concatenate, (src, dst, piece, weight))
        order = np.argsort(src, kind="stable")
        src, dst, piece, weight, by_bytes = (x[order] for x in (src, dst, piece, weight, by_bytes))
        # backward sums, by the distance to the word's end
        far = end[src] - src
        longest = int(size.max())
        order = np.argsort(far.astype(np.uint16) if longest < 1 << 16 else far, kind="stable")
        near, score = src[order], weight[order]
        beta, to = np.zeros(n + 1), np.where(dst == end[src], n, dst)[order]  # nothing is left after a word's last state
        bounds = np.searchsorted(far[order], np.arange(1, longest + 2))
        head = np.flatnonzero(np.diff(near, prepend=-1))
        begins, owner = np.searchsorted(head, bounds).tolist(), near[head]
        bounds = bounds.tolist()
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            if lo < hi:
                x, y = begins[i], begins[i + 1]
                score[lo:hi] += beta[to[lo:hi]]
                beta[owner[x:y]] = np.logaddexp.reduceat(score[lo:hi], head[x:y] - lo)
        score -= beta[near]
        logp = np.empty(len(src))
        logp[order] = score
        # the likeliest edge of a state comes first
        head = np.flatnonzero(np.diff(src, prepend=-1))
        degree = np.diff(head, append=len(src))
        top = np.flatnonzero(logp == np.repeat(np.maximum.reduceat(logp, head), degree))
        top = top[np.diff(src[top], prepend=-1) > 0]
        for x in (dst, piece, by_bytes, logp):
            x[head], x[top] = x[top], x[head]
        p = np.exp(logp)
        total = np.repeat(np.add.reduceat(p, head), degree)
        tailed = p.copy()
        tailed[head] = 0.0
        others = total - p
        others[head] = np.add.reduceat(tailed, head)
        run = np.cumsum(p)
        run -= np.repeat(run[head] - p[head], degree)
        base, state = self.states, self.states + src
        run /= total
        upto = state + np.minimum(run, 1.0, out=run)
        final = head + degree - 1
        upto[final] = state[final] + 1.0
        to = np.where(dst == end[src], -1, base + dst)
        extra = base + n
        tail = {k: [] for k in ("offset", "upto", "piece", "next")}
        place = dict(zip(src[by_bytes].tolist(), np.flatnonzero(by_bytes).tolist()))
        for i, raw in chains:
            after = int(to[place[i]])
            for k in range(1, len(raw)):
                if k == 1:
                    to[place[i]] = extra
                tail["offset"].append(4 * (i - int(begin[i])) + k)
                tail["upto"].append(extra + 1.0), tail["piece"].append(int(self.byte_ids[raw[k]])), tail["next"].append(extra + 1 if k + 1 < len(raw) else after)
                extra += 1
        more = extra - base - n
        rest = np.log(np.maximum(others, 1e-300, out=others))
        rest[head[degree == 1]] = -np.inf
        starts = self.edges + np.concatenate([head, len(src) + np.arange(more)])
        self.states = self._append(self._BY_STATE, n + more, base, 1, start=starts, offset=np.concatenate([4 * (np.arange(n) - begin), np.array(tail["offset"], np.int64)]),
                                   lead=np.concatenate([(p / total)[head] + (degree == 1), np.full(more, 2.0)]))
        self.edges = self._append(self._BY_EDGE, len(src) + more, self.edges, 0, upto=np.concatenate([upto, tail["upto"]]), logp=np.concatenate([logp, np.zeros(more)]),
                                  rest=np.concatenate([rest, np.full(more, -np.inf)]), piece=np.concatenate([piece, np.array(tail["piece"], np.int64)]), next=np.concatenate([to, np.array(tail["next"], np.int64)]))
        self.start[self.states] = self.edges
        return base + ends - size

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state, by a uniform number below one."""
        e = self.start[state]
        more = np.flatnonzero(u >= self.lead[state])
        if len(more):
            e[more] = np.searchsorted(self.upto[:self.edges], state[more] + np.minimum(u[more], 1 - 2.0 ** -29), side="right")
        return e


def uniform(seed: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a hash of their three arguments."""
    with np.errstate(over="ignore"):
        x = place.astype(np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += seed
        x += np.uint64(stream) * np.uint64(0xD1342543DE82EF95)
        high = np.empty_like(x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=high)
            x ^= high
            x *= np.uint64(factor)
        np.right_shift(x, np.uint64(31), out=high)
        x ^= high
        x >>= np.uint64(12)
    u = x.astype(float)
    u += 0.5
    u *= 1 / (1 << 52)
    return u


def uniform_one(seed: int, stream: int, place: int) -> float:
    """The same number for a single place."""
    mask = (1 << 64) - 1
    x = (place * 0x9E3779B97F4A7C15 + seed + stream * 0xD1342543DE82EF95) & mask
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return ((x ^ x >> 31) >> 12) / (1 << 52) + 0.5 / (1 << 52)


def walk_one(net: Lattices, state: int, at: int, seed: int, stream: int) -> tuple[list[int], list[int]]:
    """A sampled path from one state to its word's end: edges and places."""
    edges, places = [], []
    while state >= 0:
        place = at + int(net.offset[state])
        u = uniform_one(seed, stream, place)
        e = int(net.start[state]) if u < net.lead[state] else int(np.searchsorted(net.upto[:net.edges], state + min(u, 1 - 2.0 ** -29), side="right"))
        edges.append(e)
        places.append(place)
        state = int(net.next[e])
    return edges, places


def walk(net: Lattices, first: np.ndarray, at: np.ndarray, seed: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sampled path of each word from its state ``first``: edges in order, their words, their places."""
    word, state, parts = np.arange(len(first)), first, []
    while len(word):
        place = at[word] + net.offset[state]
        e = net.draw(state, uniform(seed[word], stream, place))
        parts.append((e, word, place))
        state = net.next[e]
        word, state = word[state >= 0], state[state >= 0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(np.concatenate([w for _, w, _ in parts]), minlength=len(first))
    start = np.cumsum(count) - count
    edges, places = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    for step, (e, word, place) in enumerate(parts):
        to = start[word] + step
        edges[to], places[to] = e, place
    return edges, np.repeat(np.arange(len(first)), count), places


def top_k(net: Lattices, paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: np.ndarray, at: np.ndarray, seed: int) -> list[tuple[float, float, float, np.ndarray]]:
    """Up to len(paths) distinct segmentations of one text, best perturbed value first: log-probability,
    perturbed value, log of the inclusion probability, piece ids. ``paths`` are sampled paths of all its
    words, used to complete a prefix."""
    k, key = len(paths), np.uint64(seed)
    t0 = math.log(-math.log(uniform_one(seed, 1 << 20, 0)))
    if not len(first):
        return [(0.0, -t0, 0.0, np.zeros(0, np.int32))]
    queue, found, serial = [(t0, 0, None)], [], 0

    def push(logt: float, before: float, edges: np.ndarray, place: np.ndarray, stream: int, node) -> None:
        """Queue the branches off a path, whose mass up to here is exp(before) and shrinks along it. Only k + 1
        of them can be reached; a block none of which can be among them (no wait is under exp(-37)) ends the
        search."""
        nonlocal serial
        best = []
        for a in range(0, len(place), _BLOCK):
            if len(best) > k and -37.0 - before > best[k][0]:
                break
            block = edges[a:a + _BLOCK]
            logp, mass = net.logp[block], net.rest[block]
            upto = before + np.cumsum(logp)
            mass += upto
            mass -= logp
            good = np.flatnonzero(mass > -np.inf)
            before = float(upto[-1])
            wait = np.log(-np.log(uniform(key, (1 << 20) + stream, place[a + good])))
            wait -= mass[good]
            if len(wait) > k + 1:
                least = np.argpartition(wait, k)[:k + 1]
                wait, good = wait[least], good[least]
            best = sorted([*best, *zip(np.logaddexp(logt, wait).tolist(), (a + good).tolist())])[:k + 1]
        for t, i in best:
            serial += 1
            heapq.heappush(queue, (t, serial, node(i)))

    while queue and len(found) < k:
        logt, _, node = heapq.heappop(queue)
        e, word, place = paths[len(found)]
        stream = 2 * len(found) + 1
        if node is None:
            edges, words, places, done = e, word, place, 0
        else:
            old, i, barred = node
            oe, ow, op = old
            state = int(np.searchsorted(net.start[:net.states + 1], oe[i], side="right")) - 1
            rest = [x for x in range(net.start[state], net.start[state + 1]) if x not in barred]
            p = np.exp(net.logp[rest])
            # the place of a branch is the old path's, so that its draw does not depend on the queue
            u = uniform_one(seed, (1 << 21) + len(found), int(op[i]))
            pick = rest[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), len(rest) - 1)]
            here, nxt = int(ow[i]), int(net.next[pick])
            tail, tail_at = walk_one(net, nxt, int(at[here]), seed, stream)
            later = np.searchsorted(word, here, side="right")
            edges = np.concatenate([oe[:i], [pick, *tail], e[later:]])
            words = np.concatenate([ow[:i], [here] * (1 + len(tail)), word[later:]])
            places = np.concatenate([op[:i + 1], np.array(tail_at, np.int64), place[later:]])
            done = i + 1
            others = [x for x in rest if x != pick]
            if others:
                mass = float(net.logp[oe[:i]].sum() + np.log(np.exp(net.logp[others]).sum()))
                serial += 1
                heapq.heappush(queue, (float(np.logaddexp(logt, math.log(-math.log(uniform_one(seed, (1 << 20) + stream + 1, int(op[i])))) - mass)), serial, (old, i, barred | {pick})))
        logp = net.logp[edges]
        path = (edges, words, places)
        push(logt, float(logp[:done].sum()), edges[done:], places[done:], stream, lambda j, path=path, done=done: (path, done + j, frozenset([int(path[0][done + j])])))
        found.append((float(logp.sum()), -logt, net.piece[edges]))
    nxt = queue[0][0] if queue else None

    def inclusion(lp: float) -> float:
        if nxt is None:
            return 0.0
        x = lp + nxt  # log of the expected number of arrivals before the first path left out
        return float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))

    return [(lp, value, inclusion(lp), ids) for lp, value, ids in found]


class Sampler:
    def __init__(self, model: str, samples: int):
        import sentencepiece
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.net, self.samples = Lattices(*weights(processor)), samples

    def sample(self, keys: list, texts: list[str | None]) -> Iterator[tuple[int, int, tuple[float, float, float, np.ndarray]]]:
        """(row, rank, segmentation) for each text; a few texts are walked together."""
        held, weight = [], 0
        for i, (key, text) in enumerate(zip(keys, texts)):
            held.append((i, key, text or ""))
            weight += len(text or "")
            if weight > WALKED:
                yield from self._walk(held)
                held, weight = [], 0
        if held:
            yield from self._walk(held)

    def _walk(self, held) -> Iterator[tuple[int, int, tuple]]:
        net = self.net
        if net.edges > REMEMBERED:
            net.forget()
        seeds = np.array([xxhash.xxh64_intdigest(str(k).encode(), seed=7) for _, k, _ in held], np.uint64)
        parts, count, at = net.cut([as_bytes(t) for _, _, t in held])
        ends = np.cumsum(count)
        first = net.states_of(parts)
        at *= 4  # a character is four bytes at most
        row = np.repeat(np.arange(len(held)), count)
        seed = seeds[row]
        paths = [walk(net, first, at, seed, 2 * j + 1) for j in range(self.samples)]
        borders = [np.searchsorted(word, np.concatenate([[0], ends])).tolist() for _, word, _ in paths]
        for r, (i, _, _) in enumerate(held):
            a, b = int(ends[r] - count[r]), int(ends[r])
            own = [(e[x:y], word[x:y] - a, place[x:y]) for (e, word, place), (x, y) in zip(paths, (by[r:r + 2] for by in borders))]
            for rank, s in enumerate(top_k(net, own, first[a:b], at[a:b], int(seeds[r])), 1):
                yield i, rank, s


_FIELDS = [("sample", pa.int32()), ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("ids", pa.list_(pa.int32()))]
_COLUMNS = "doc_id long, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids array<int>"


def _sampler(model: str, samples: int) -> tuple[Sampler, pa.LargeBinaryArray]:
    """Kept by a Python worker from task to task, with the lattices it knows, until a task of another
    operator comes; no draw depends on them."""
    return kept(_kept_as(model, samples), lambda: (Sampler(model, samples), pa.array(byte_table(model), pa.large_binary())))


def _kept_as(model: str, samples: int) -> str:
    return f"lattices {samples} {model}"


def _encode(model: str, samples: int, check: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler, of = _sampler(model, samples)
    for b in slices(batches, 128, _kept_as(model, samples)):
        texts = b.column("text").to_pylist()
        got = list(sampler.sample(b.column("doc_id").to_pylist(), texts))
        ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s[3]) for _, _, s in got])]).astype(np.int32), np.concatenate([s[3] for _, _, s in got]).astype(np.int32))
        cols = [[r for _, r, _ in got], [len(s[3]) for _, _, s in got], *[[s[c] for _, _, s in got] for c in range(3)]]
        out = [b.column("doc_id").take(pa.array([i for i, _, _ in got])), *[pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], ids]
        names = ["doc_id", *[n for n, _ in _FIELDS]]
        if check:
            raws = [as_bytes(t) for t in texts]
            out.append(pa.array([x == raws[i] for x, (i, _, _) in zip(spelled(of, ids), got)], pa.bool_()))
            names.append("round_trip")
        yield pa.record_batch(out, names)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """doc_id, sample (1 is the largest perturbed value), n_pieces, log_prob, perturbed, log_inclusion and
    ids: ``samples`` distinct segmentations of every whole text, fewer where it has fewer. log_inclusion
    is the log of the probability that the segmentation is drawn, given the first one left out.

    Null and empty texts have one segmentation, without pieces. The draws of a row come from its doc_id
    (a null one is a key like any other), so rows that repeat an id and text repeat its samples. An
    empty table gives no rows."""
    return columns(docs, doc_id=doc_id, text=text).mapInArrow(partial(_encode, model, samples, False), _COLUMNS)


def round_trips(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """The rows of ``encode`` and round_trip, whether the pieces decode to the very text."""
    return columns(docs, doc_id=doc_id, text=text).mapInArrow(partial(_encode, model, samples, True), _COLUMNS + ", round_trip boolean")


def byte_table(model: str) -> list[bytes]:
    """The bytes each piece stands for."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(_SPACE, " ").encode()
            for i in range(p.get_piece_size())]


def decoded(of: list[bytes], ids: list[int] | None) -> str:
    """The text of pieces; the space that the model puts before a text goes."""
    raw = b"".join(itemgetter(*ids)(of)) if ids and len(ids) > 1 else b"".join(map(of.__getitem__, ids or ()))
    return raw[1:].decode("utf-8", "replace")


def spelled(of: pa.LargeBinaryArray, ids: pa.ListArray) -> list[bytes]:
    """The bytes that lists of pieces stand for, all looked up at once, without the space before a text."""
    pieces = of.take(ids.values)
    data = pieces.buffers()[2]
    raw = data.to_pybytes() if data else b""
    border = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy())])[ids.offsets.to_numpy()].tolist()
    return [raw[a + 1:b] for a, b in zip(border[:-1], border[1:])]


def _decode(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = byte_table(model)
    for b in slices(batches, 64):
        texts = [decoded(of, ids) for ids in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with ``decoded``, the text that the pieces of ``ids`` stand for; null and empty lists
    stand for the empty text."""
    return encoded.mapInArrow(partial(_decode, model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded string")
