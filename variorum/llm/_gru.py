"""A gated recurrent language model in numpy, with a softmax over classes and one within the class.

Sequences are symbols; each is predicted from those before it, the first from
``end``.  Sequences follow one another in rows of a table, with a new state for
each, so every step works on full rows.  Training backpropagates through windows
of ``WINDOW`` steps and carries the state from window to window; scoring carries
it to the end, so a score is the log-likelihood of the whole sequence.

Classes are runs of symbols by falling counts, with equal sums of the roots of
their counts: frequent symbols share a class with few others or none, so the
softmax within a class is short for most steps.
"""

from __future__ import annotations

import ctypes
import heapq
from pathlib import Path

import numpy as np

HIDDEN, WINDOW, CLASSES = 16, 32, 32
#: Rows of a table in training and in scoring, at most; in training fewer, where there would be less than UPDATES windows.
TRAIN_ROWS, SCORE_ROWS, UPDATES = 512, 512, 16
#: Adagrad's rate, and the sums of squares that it begins with: small ones, as a learner makes few updates in a round.
RATE, SQUARES = 0.16, 1e-9
F32 = np.float32
Params = dict[str, np.ndarray]


def one_thread() -> None:
    """Products in one thread, where numpy brings its own OpenBLAS: the matrices are small, and idle threads spin."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("libscipy_openblas64_*"):
        ctypes.CDLL(str(path)).scipy_openblas_set_num_threads64_(1)


def by_gate(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(inputs' parts with b, state's parts), the gates z, r and n apart: slices of rows would be short loops in numpy.

    Signs and the 2 of tanh(x) = 2 / (1 + exp(-2 * x)) - 1 are in them: exp is a fast loop in numpy everywhere, tanh is not.
    """
    scale = np.array([-1, -1, -2], F32)[:, None, None]
    apart = lambda m: np.ascontiguousarray(m.reshape(len(m), 3, HIDDEN).swapaxes(0, 1))
    x, u = apart(p["x"]), apart(p["u"])
    x += p["b"].reshape(3, 1, HIDDEN)
    x *= scale
    u *= scale
    return x, u


def _logistic(x: np.ndarray, out: np.ndarray, top: float = 1) -> np.ndarray:
    """top / (1 + exp(x)); x is overwritten, and where it overflows, the result is 0 as it should be."""
    np.exp(x, out=x)
    x += F32(1)
    return np.divide(F32(top), x, out=out)


def steps(gates: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, h: np.ndarray, anew: list[np.ndarray], kept: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """States of each step for symbols inputs [step, row] from the state h, which is 0 before step t in rows anew[t].

    kept are arrays that take what backpropagation needs: the states before, z and r, n, and the state's part of n (by -2).
    """
    x, u = gates
    count, rows = inputs.shape
    states = np.empty((count, rows, HIDDEN), x.dtype)
    g, hu, gate, n = (np.empty((*k, rows, HIDDEN), x.dtype) for k in ((3,), (3,), (2,), ()))
    with np.errstate(over="ignore"):
        for t in range(count):
            if len(anew[t]):
                h = h.copy()
                h[anew[t]] = 0
            np.matmul(h, u, out=hu)
            np.take(x, inputs[t], axis=1, out=g, mode="clip")
            if kept is not None:
                before, zr, ns, hn = kept
                before[t], hn[t] = h, hu[2]
                gate, n = zr[:, t], ns[t]
            add = g[:2]
            add += hu[:2]
            _logistic(add, gate)
            new = np.multiply(gate[1], hu[2], out=states[t])
            new += g[2]
            _logistic(new, n, 2)
            n -= F32(1)
            np.subtract(h, n, out=new)
            new *= gate[0]
            new += n
            h = new
    return states


def _anew(keep: np.ndarray) -> list[np.ndarray]:
    """Of each step, the rows that keep [step, row, 1] makes 0."""
    step, row = np.nonzero(keep[..., 0] == 0)
    return np.split(row, np.searchsorted(step, np.arange(1, len(keep))))


def start(counts: np.ndarray) -> Params:
    """Parameters before training, and in cut the first symbol of each class; symbols are sorted by falling counts."""
    rng, v, h = np.random.default_rng(7), len(counts), HIDDEN
    mass = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.concatenate([[0], np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES) + 1, [v]])
    for c in range(1, CLASSES):  # a symbol each at least
        cut[c] = min(max(cut[c], cut[c - 1] + 1), v - CLASSES + c)
    sums = np.add.reduceat(counts + 1.0, cut[:-1])
    return {
        "x": rng.normal(0, 0.1, (v, 3 * h)).astype(F32),
        "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(F32),
        "b": np.zeros(3 * h, F32),
        "wc": rng.normal(0, 0.05, (h, CLASSES)).astype(F32),
        "bc": np.log(sums / sums.sum()).astype(F32),
        "wo": rng.normal(0, 0.05, (v, h)).astype(F32),
        "bo": np.log((counts + 1.0) / np.repeat(sums, np.diff(cut))).astype(F32),
        "cut": cut.astype(F32),
    }


def pack(p: Params) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def unpack(data: bytes, like: Params) -> Params:
    flat, at, out = np.frombuffer(data, F32), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def table(rows: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, lengths) of rows of symbols, longest first; a row's first input is end."""
    rows = sorted(rows, key=len, reverse=True)
    lengths = np.array([len(r) for r in rows])
    targets = np.full((len(rows), lengths[0]), end, np.int32)
    for to, own in zip(targets, rows, strict=True):
        to[: len(own)] = own
    return _shifted(targets, end), targets, lengths


def _shifted(targets: np.ndarray, end: int) -> np.ndarray:
    inputs = np.full_like(targets, end)
    inputs[:, 1:] = targets[:, :-1]
    return inputs


def windows(inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, end: int):
    """(first step, rows that are left, inputs, targets, whether inside, keep) of each window, by step and row."""
    for t0 in range(0, inputs.shape[1], WINDOW):
        live = int(np.searchsorted(-lengths, -t0, side="left"))
        t1 = min(t0 + WINDOW, inputs.shape[1])
        x = np.ascontiguousarray(inputs[:live, t0:t1].T, np.intp)
        yield t0, live, x, targets[:live, t0:t1].T, np.arange(t0, t1)[:, None] < lengths[None, :live], (x != end)[..., None].astype(F32)


def log_likelihoods(p: Params, sequences: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each whole sequence and its end."""
    out, sizes = np.zeros(len(sequences)), np.array([len(s) + 1 for s in sequences], np.int64)
    if not len(sizes):
        return out
    count = int(min(SCORE_ROWS, -(-sizes.sum() // sizes.max())))
    held: list[list[int]] = [[] for _ in range(count)]
    heap = [(0, i) for i in range(count)]
    for j in np.argsort(-sizes, kind="stable").tolist():  # the longest first, each to the shortest row
        n, i = heap[0]
        held[i].append(j)
        heapq.heapreplace(heap, (n + int(sizes[j]), i))
    held = sorted((own for own in held if own), key=lambda own: -int(sizes[own].sum()))
    lengths = np.array([sizes[own].sum() for own in held])
    targets = np.full((len(held), lengths[0]), end, np.int32)
    owner = np.zeros_like(targets)
    for i, own in enumerate(held):
        at = 0
        for j, n in zip(own, sizes[own].tolist(), strict=True):
            targets[i, at : at + n - 1], owner[i, at : at + n] = sequences[j], j
            at += n
    inputs = _shifted(targets, end)
    h = np.zeros((len(inputs), HIDDEN), F32)
    gates, likely = by_gate(p), _Outputs(p)
    found: list[tuple[np.ndarray, ...]] = []
    size = 0
    for t0, live, x, y, inside, keep in windows(inputs, targets, lengths, end):
        states = steps(gates, x, h[:live], _anew(keep))
        h = states[-1]
        at = inside.ravel()
        found.append((states.reshape(-1, HIDDEN)[at], y.ravel()[at], owner[:live, t0 : t0 + len(x)].T.ravel()[at]))
        size += len(found[-1][1])
        if size >= 1 << 14 or t0 + WINDOW >= inputs.shape[1]:
            states, y, own = (np.concatenate(c) for c in zip(*found, strict=True))
            out += np.bincount(own, likely.log_probs(states, y), len(out))
            found, size = [], 0
    return out


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable, by radix."""
    return np.argsort(symbols.astype(np.uint16), kind="stable")


class _Outputs:
    """Both softmaxes with their biases as a last column, beside states with a last 1."""

    #: Logits within this need no shift: exponentials and their sums stay far from the ends of float32.
    SAFE = 60

    def __init__(self, p: Params) -> None:
        self.first = np.rint(p["cut"]).astype(np.int64)
        self.wc, self.wo = np.concatenate([p["wc"], p["bc"][None]]).T, np.concatenate([p["wo"], p["bo"][:, None]], 1)
        self.most = [(np.abs(w[:, :-1]).sum(1), np.abs(w[:, -1])) for w in (self.wc, self.wo)]

    @staticmethod
    def states(states: np.ndarray) -> np.ndarray:
        out = np.empty((len(states), HIDDEN + 1), states.dtype)
        out[:, :-1], out[:, -1] = states, 1
        return out

    def classes(self, symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The class of each of sorted symbols; for classes of several symbols that occur, their places and their symbols."""
        at = np.searchsorted(symbols, self.first)
        several = np.flatnonzero((np.diff(at) > 0) & (np.diff(self.first) > 1)).tolist()
        return np.repeat(np.arange(CLASSES), np.diff(at)), [(slice(at[c], at[c + 1]), slice(self.first[c], self.first[c + 1])) for c in several]

    def safe(self, s: np.ndarray) -> tuple[bool, np.ndarray]:
        """Whether the logits of classes, and those of each symbol, are within SAFE for all of states s."""
        largest = np.abs(s[:, :-1]).max() if len(s) else 0
        cls, own = (w * largest + b <= self.SAFE for w, b in self.most)
        return bool(cls.all()), own

    def log_probs(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        order = _order(symbols)
        s, symbols = self.states(states[order]), symbols[order]
        cls, several = self.classes(symbols)
        safe, own_safe = self.safe(s)
        logits = s @ self.wc.T
        found = logits[np.arange(len(cls)), cls] - _logsumexp(logits, safe)
        for at, own in several:
            logits = s[at] @ self.wo[own].T
            found[at] += logits[np.arange(at.stop - at.start), symbols[at] - own.start] - _logsumexp(logits, own_safe[own].all())
        out = np.empty(len(found))
        out[order] = found
        return out


def _log_probs(p: Params, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return _Outputs(p).log_probs(states, symbols)


def _exp(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(top, sums): x becomes exp(x - top) in place; top is 0 if that is safe, else the largest of all, or each row's where they are far apart."""
    top = x.dtype.type(0)
    if not safe and x.size:
        top = x.max()
        if x.min() < top - 40:
            top = x.max(1)
            x -= top[:, None]
        else:
            x -= top
    np.exp(x, out=x)
    return top, x @ np.ones(x.shape[1], x.dtype)


def _logsumexp(x: np.ndarray, safe: bool) -> np.ndarray:
    """Of each row; x is overwritten."""
    top, sums = _exp(x, safe)
    return top + np.log(sums)


def train(p: Params, sequences: list[np.ndarray], end: int, rate: float = RATE) -> Params:
    """Parameters after one pass over the sequences, by Adagrad; a sequence that two rows share starts anew in the second."""
    p = {k: v.copy() for k, v in p.items()}
    squares = {k: np.full_like(v, SQUARES) for k, v in p.items()}
    if not sequences:
        return p
    tail = np.array([end], sequences[0].dtype)
    whole = np.concatenate([x for s in sequences for x in (s, tail)])
    inputs, targets, lengths = table([x for x in np.array_split(whole, min(TRAIN_ROWS, -(-len(whole) // (WINDOW * UPDATES)))) if len(x)], end)
    h = np.zeros((len(inputs), HIDDEN), F32)
    for _, live, x, y, inside, keep in windows(inputs, targets, lengths, end):
        h, grads = _window(p, x, y, inside, h[:live], keep)
        for k, gr in grads.items():
            at, gr = gr if isinstance(gr, tuple) else (slice(None), gr)
            np.clip(gr, -1, 1, out=gr)
            squares[k][at] += gr * gr
            p[k][at] -= F32(rate) * gr / np.sqrt(squares[k][at])
    return p


def _window(p: Params, inputs: np.ndarray, targets: np.ndarray, inside: np.ndarray, h: np.ndarray, keep: np.ndarray):
    """The state after a window, and the gradients of its mean loss; sparse ones as (rows, gradient)."""
    count, rows = inputs.shape
    size, gates, anew, out = HIDDEN, by_gate(p), _anew(keep), _Outputs(p)
    kept = before, zr, n, hn = [np.empty((*k, count, rows, size), h.dtype) for k in ((), (2,), (), ())]
    states = steps(gates, inputs, h, anew, kept)
    at = np.flatnonzero(inside.ravel())
    y = targets.ravel()[at]
    order = _order(y)
    at, y = at[order], y[order]
    s = out.states(states.reshape(-1, size)[at])
    weight = s.dtype.type(1 / len(y))
    cls, several = out.classes(y)
    safe, own_safe = out.safe(s)
    ds, dc = _back(s @ out.wc.T, safe, cls, s, p["wc"].T, weight)
    do = np.zeros_like(out.wo)
    for a, own in several:
        more, do[own] = _back(s[a] @ out.wo[own].T, own_safe[own].all(), y[a] - own.start, s[a], p["wo"][own], weight)
        ds[a] += more
    back = np.zeros((count * rows, size), s.dtype)
    back[at] = ds
    back = back.reshape(count, rows, size)

    z, r = zr
    one = s.dtype.type(1)
    to_z, to_n, to_r = (before - n) * z, one - n * n, hn * r
    rest = one - z
    to_z *= rest
    to_n *= rest
    to_r *= one - r
    to_r *= s.dtype.type(-0.5)
    dg, dhn = np.empty((3, count, rows, size), s.dtype), np.empty((count, rows, size), s.dtype)
    u = np.ascontiguousarray(p["u"].reshape(size, 3, size).transpose(1, 2, 0))
    dh, dhu, turned = np.zeros((rows, size), s.dtype), np.empty((3, rows, size), s.dtype), np.empty((3, rows, size), s.dtype)
    for t in reversed(range(count)):
        dh += back[t]
        dn = np.multiply(dh, to_n[t], out=dg[2, t])
        np.multiply(dh, to_z[t], out=dhu[0])
        np.multiply(dn, to_r[t], out=dhu[1])
        np.multiply(dn, r[t], out=dhu[2])
        dg[:2, t], dhn[t] = dhu[:2], dhu[2]
        dh *= z[t]
        np.matmul(dhu, u, out=turned)
        for part in turned:
            dh += part
        dh[anew[t]] = 0
    flat, long = before.reshape(-1, size).T, dg.reshape(3, -1, size)
    du = np.concatenate([flat @ long[0], flat @ long[1], flat @ dhn.reshape(-1, size)], 1)
    flat = inputs.ravel()
    order = _order(flat)
    own = flat[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    pairs = f"c{2 * dg.itemsize}"  # two numbers in one sum: reduceat takes its time by sums, not by bytes
    dx = np.concatenate([np.add.reduceat(np.take(part, order, 0).view(pairs), first, 0).view(dg.dtype) for part in long], 1)
    return states[-1], {"wc": dc[:, :-1].T, "bc": dc[:, -1], "wo": do[:, :-1], "bo": do[:, -1], "u": du, "b": dx.sum(0), "x": (own[first], dx)}


def _back(logits: np.ndarray, safe: bool, targets: np.ndarray, s: np.ndarray, w: np.ndarray, weight: np.generic) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by states and by weights, of weight times each row's loss; logits are overwritten.

    Rows of exponentials stay undivided, and their sums divide the narrower states.
    """
    sums = _exp(logits, safe)[1]
    logits[np.arange(len(targets)), targets] -= sums
    by = (weight / sums)[:, None]
    ds = logits @ w
    ds *= by
    return ds, logits.T @ (s * by)
