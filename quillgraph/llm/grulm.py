"""Gated recurrent language model in numpy.

A word is `<head>` (the most frequent words of the training fold, each with an output of its own) or tail. Outputs are
class-factored: P(word | state) = P(class | state) P(word | class, state) for head words, whose classes are runs of
`per_class` words by frequency; tail words fall into classes by their last letters, and inside such a class
P(word | class) = (c + 0.5) / (T + 0.5 (V + 1)) with the class's tokens T and distinct words V. Inputs are head words,
or buckets of first and last letters. Training is truncated backpropagation over windows with Adagrad.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import xxhash

F32 = np.float32


class Hashed(dict):
    """Short byte string -> its hash modulo n; remembers at most 100,000."""

    def __init__(self, n: int, seed: int = 0):
        super().__init__()
        self.n, self.seed = n, seed

    def __missing__(self, key: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        out = self[key] = xxhash.xxh3_64_intdigest(key, seed=self.seed) % self.n
        return out


_classes: dict[int, Hashed] = {}
_inputs: dict[int, Hashed] = {}


def tail_classes(words: list[bytes], n: int) -> list[int]:
    """The tail class of each word, by its last letters."""
    known = _classes.setdefault(n, Hashed(n))
    return [known[w[-3:]] for w in words]


def input_buckets(words: list[bytes], n: int) -> list[int]:
    """The input bucket of each word, by its first and last letters."""
    known = _inputs.setdefault(n, Hashed(n, 1))
    return [known[w[:2] + b" " + w[-2:]] for w in words]


@dataclass(frozen=True)
class Shape:
    head: int
    per_class: int
    tail_classes: int
    buckets: int
    hidden: int

    @property
    def head_classes(self) -> int:
        return -(-self.head // self.per_class)

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes


Params = dict[str, np.ndarray]


def start_params(shape: Shape, head_counts: np.ndarray, tail_tokens: np.ndarray, seed: int = 7) -> Params:
    """Small random weights; output biases are the log frequencies, so training starts from a unigram model."""
    rng = np.random.default_rng(seed)
    h, padded = shape.hidden, shape.head_classes * shape.per_class
    counts = np.zeros(padded)
    counts[: len(head_counts)] = head_counts
    by_class = np.concatenate((counts.reshape(-1, shape.per_class).sum(1), tail_tokens)) + 0.5
    inside = np.where(np.arange(padded) < shape.head, np.log(counts + 0.5), -30.0)
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(F32)
    return {
        "E": normal(shape.head + shape.buckets, 3 * h, scale=0.3),
        "U": normal(h, 3 * h, scale=h**-0.5),
        "b": np.concatenate((np.full(h, 1.0), np.zeros(2 * h))).astype(F32),
        "Wc": normal(h, shape.classes, scale=0.02),
        "bc": np.log(by_class).astype(F32),
        "Wo": normal(padded, h, scale=0.02),
        "bo": inside.astype(F32),
    }


def _exp_sums(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """Takes x to exp(x - shift) in its place; returns the rows' sums and shifts. safe: nothing over- or underflows as it is."""
    shift = 0.0
    if not safe:
        top = x.max(axis=1, keepdims=True)
        x -= top
        shift = top[:, 0]
    np.exp(x, out=x)
    return (x @ np.ones((x.shape[1], 1), x.dtype))[:, 0], shift


def _safe(w: np.ndarray) -> bool:
    """Whether all logits of states within -1..1 and 1 for the bias are small enough for plain exponentials."""
    return bool(np.abs(w).sum(axis=1).max(initial=0.0) < 60)


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def outputs(p: Params, shape: Shape, hs: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: Params | None = None):
    """Natural log P of each target; with grads, also adds the gradients of -log P and returns that of hs.

    cls: output class of each target; word: its place inside the class, 0 for tail classes. Targets are sorted by class and
    word once, so that classes are slices; probabilities are never normalised, their sums divide the narrow states.
    """
    key = cls.astype(np.int32) * shape.per_class + word
    order = np.argsort(key, kind="stable")
    key, cls = key[order], cls[order]
    x = np.concatenate((hs[order], np.ones((len(hs), 1), hs.dtype)), axis=1)
    rows = np.arange(len(x))
    wc = np.concatenate((p["Wc"], p["bc"][None]))
    safe, logp = _safe(wc.T), np.empty(len(x), x.dtype)
    dh = None if grads is None else np.empty_like(hs)
    wide = 0.0
    for i in range(0, len(x), 2048):  # pieces whose logits stay in a core's cache
        piece = x[i : i + 2048]
        logits = piece @ wc
        logp[i : i + 2048] = logits[rows[: len(piece)], cls[i : i + 2048]]
        sums, shift = _exp_sums(logits, safe)
        logp[i : i + 2048] -= np.log(sums) + shift
        if grads is not None:
            sums = sums[:, None]
            wide = wide + (piece / sums).T @ logits
            np.divide(logits @ p["Wc"].T, sums, out=dh[i : i + 2048])
    n_head = int(np.searchsorted(cls, shape.head_classes))
    if grads is not None and len(x):
        at = _edges(cls)
        wide[:, cls[at]] -= np.add.reduceat(x, at).T
        grads["Wc"] += wide[:-1]
        grads["bc"] += wide[-1]
        dh -= p["Wc"].T[cls]
        dh[:n_head] -= p["Wo"][key[:n_head]]
        at = _edges(key[:n_head])
        if len(at):
            chosen = np.add.reduceat(x[:n_head], at)
            grads["Wo"][key[at]] -= chosen[:, :-1]
            grads["bo"][key[at]] -= chosen[:, -1]
    w1 = np.concatenate((p["Wo"], p["bo"][:, None]), axis=1)
    safe, inside = _safe(w1), np.ones(len(x), x.dtype)
    edges = _edges(cls[:n_head])
    for s, e in zip(edges.tolist(), [*edges.tolist(), n_head][1:], strict=True):
        lo = int(cls[s]) * shape.per_class
        hi = lo + shape.per_class
        mine = x[s:e]
        inner = mine @ w1[lo:hi].T
        logp[s:e] += inner[rows[: e - s], key[s:e] - lo]
        sums, shift = _exp_sums(inner, safe)
        inside[s:e] = sums
        logp[s:e] -= shift
        if grads is not None:
            sums = sums[:, None]
            part = inner.T @ (mine / sums)
            grads["Wo"][lo:hi] += part[:, :-1]
            grads["bo"][lo:hi] += part[:, -1]
            dh[s:e] += (inner @ p["Wo"][lo:hi]) / sums
    logp -= np.log(inside)
    back = np.empty(len(order), np.int64)
    back[order] = rows
    return logp[back], None if dh is None else dh[back]


def unroll(p: Params, e: np.ndarray, counts: list[int], h: np.ndarray, resets: dict[int, np.ndarray]):
    """States of all steps of a window from state h, and what the way back needs.

    e: input gates with their bias, step after step; counts: lanes of each step, never growing; resets: lanes of a step that start
    a sequence.
    """
    k, n = h.shape[1], len(e)
    before, out, q, cand = (np.empty((n, k), h.dtype) for _ in range(4))
    zr = np.empty((n, 2 * k), h.dtype)
    at = 0
    for t, m in enumerate(counts):
        s = slice(at, at + m)
        at += m
        was = before[s]
        was[:] = h[:m]
        if t in resets:
            was[resets[t]] = 0
        hu = was @ p["U"]
        gate, c, h = zr[s], cand[s], out[s]
        np.add(e[s, : 2 * k], hu[:, : 2 * k], out=gate)
        gate *= 0.5  # the logistic function by tanh
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        q[s] = hu[:, 2 * k :]
        np.multiply(gate[:, k:], hu[:, 2 * k :], out=c)
        c += e[s, 2 * k :]
        np.tanh(c, out=c)
        np.subtract(was, c, out=h)
        h *= gate[:, :k]
        h += c
    return out, (before, zr, q, cand)


def unroll_back(p: Params, dh: np.ndarray, counts: list[int], saved, resets: dict[int, np.ndarray], grads: Params) -> np.ndarray:
    """Adds the gradients of U and b and returns that of the input gates; dh is used up."""
    before, zr, q, cand = saved
    n, k = dh.shape
    z, r = zr[:, :k], zr[:, k:]
    into = (1 - z) * (1 - cand * cand)
    local = np.stack(((before - cand) * z * (1 - z), into * q * r * (1 - r), into * r), axis=1)
    mixed = np.empty((n, 3, k), dh.dtype)
    flat, ut = mixed.reshape(n, 3 * k), np.ascontiguousarray(p["U"].T)
    back, at = dh[:0], n
    for t in range(len(counts) - 1, -1, -1):
        at -= counts[t]
        s = slice(at, at + counts[t])
        d = dh[s]
        d[: len(back)] += back
        np.multiply(d[:, None, :], local[s], out=mixed[s])
        back = flat[s] @ ut
        back += d * z[s]
        if t in resets:
            back[resets[t]] = 0
    grads["U"] += before.T @ flat
    flat[:, 2 * k :] = dh * into
    grads["b"] += flat.sum(0)
    return flat


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Deals sequences, longest first, to the lane that is free first; lanes by falling length."""
    heap = [(0, i) for i in range(min(most, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable"):
        size, i = heapq.heappop(heap)
        dealt[i].append(int(d))
        heapq.heappush(heap, (size + int(lengths[d]), i))
    sizes = [sum(int(lengths[d]) for d in x) for x in dealt]
    return [dealt[i] for i in sorted(range(len(dealt)), key=lambda i: -sizes[i])]


class Stream:
    """Sequences side by side in lanes: inp, cls, word and seq are flat, a lane's tokens together; new marks starts."""

    def __init__(self, seqs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int):
        lengths = np.array([len(s[0]) for s in seqs])
        dealt = lanes(lengths, most)
        order = [d for lane in dealt for d in lane]
        self.sizes = np.array([sum(int(lengths[d]) for d in lane) for lane in dealt])
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.inp, self.cls, self.word = (np.concatenate([seqs[d][i] for d in order]) for i in range(3))
        self.seq = np.repeat(np.array(order), lengths[order])
        self.new = np.zeros(len(self.seq), bool)
        self.new[np.concatenate(([0], np.cumsum(lengths[order])[:-1]))] = True

    def windows(self, steps: int, most: int = 0):
        """(flat positions step after step, lanes of each step, lanes of each step that start a sequence) of each window.

        most: where few lanes run, so many steps at most, as far as the window stays as large as one of all lanes.
        """
        start, end = 0, int(self.sizes.max(initial=0))
        while start < end:
            running = int(np.searchsorted(-self.sizes, -start, side="left"))
            n = min(end - start, max(steps, min(most, steps * len(self.sizes) // running)))
            counts = np.searchsorted(-self.sizes, -np.arange(start, start + n), side="left")
            ends = np.cumsum(counts)
            step = np.repeat(np.arange(n), counts)
            lane = np.arange(ends[-1]) - (ends - counts)[step]
            flat = self.offsets[lane] + (start + step)
            at = np.flatnonzero(self.new[flat])
            by = step[at]
            edges = _edges(by)
            yield flat, counts.tolist(), {int(by[s]): lane[at[s:e]] for s, e in zip(edges, np.append(edges, len(at))[1:], strict=True)}
            start += n


def score(p: Params, shape: Shape, seqs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 64, most: int = 1024) -> np.ndarray:
    """Natural log-likelihood of each complete sequence; states are carried across windows."""
    out = np.zeros(len(seqs))
    if not seqs:
        return out
    stream = Stream(seqs, most)
    h = np.zeros((len(stream.sizes), shape.hidden), p["U"].dtype)
    for flat, counts, resets in stream.windows(steps, 8 * steps):
        hs, _ = unroll(p, p["E"][stream.inp[flat]] + p["b"], counts, h, resets)
        h = hs[len(hs) - counts[-1] :]
        # Outputs in pieces that stay in a core's cache.
        logp = [outputs(p, shape, hs[i : i + 8192], stream.cls[flat[i : i + 8192]], stream.word[flat[i : i + 8192]])[0] for i in range(0, len(flat), 8192)]
        out += np.bincount(stream.seq[flat], weights=np.concatenate(logp), minlength=len(seqs))
    return out


def window_grads(p: Params, shape: Shape, stream: Stream, window, h: np.ndarray):
    """One window from state h: log P of its tokens, gradients of -log P (E's by its rows), and the next state."""
    flat, counts, resets = window
    ids = stream.inp[flat]
    hs, saved = unroll(p, p["E"][ids] + p["b"], counts, h, resets)
    grads = {x: np.zeros_like(p[x]) for x in ("U", "b", "Wc", "bc", "Wo", "bo")}
    logp, dh = outputs(p, shape, hs, stream.cls[flat], stream.word[flat], grads)
    gates = unroll_back(p, dh, counts, saved, resets, grads)
    # Sums over equal rows, a column at a time: many times faster than reduceat over wide rows.
    rows = np.flatnonzero(np.bincount(ids, minlength=len(p["E"])))
    sums = np.stack([np.bincount(ids, weights=g, minlength=len(p["E"]))[rows] for g in np.ascontiguousarray(gates.T)], axis=1)
    return logp, grads, (rows, sums.astype(gates.dtype)), hs[len(hs) - counts[-1] :]


def train(
    p: Params, shape: Shape, seqs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 16, most: int = 512, rate: float = 0.1
) -> Params:
    """One pass of truncated backpropagation over whole sequences; states are carried across windows."""
    if not seqs:
        return p
    p = {k: v.copy() for k, v in p.items()}
    mem = {k: np.full(v.shape if k != "E" else (len(v), 1), 1e-6, v.dtype) for k, v in p.items()}
    stream = Stream(seqs, most)
    h = np.zeros((len(stream.sizes), shape.hidden), p["U"].dtype)
    for window in stream.windows(steps, 8 * steps):
        _, grads, (rows, g), h = window_grads(p, shape, stream, window, h)
        scale = F32(1 / max(len(window[0]), steps * len(stream.sizes)))  # a token weighs the same in a window of few lanes
        for x, d in grads.items():
            d *= scale
            mem[x] += d * d
            p[x] -= F32(rate) * d / np.sqrt(mem[x])
        g *= scale
        mem["E"][rows] += (g * g).mean(axis=1, keepdims=True)
        p["E"][rows] -= F32(rate) * g / np.sqrt(mem["E"][rows])
    return p
