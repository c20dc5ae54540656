"""A small causal self-attention model over subword ids, in numpy.

A token is predicted as its class from the context and as itself from its class: P(id | context) = P(class | context) *
P(id | class). Classes are runs of ids in order of frequency with about equal shares of the training tokens; the class
given the context comes from one attention head over at most LENGTH earlier ids and a hidden layer. Frequent ids have
their own input vectors, the others share that of their class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

CLASSES, OWN, DIM, HIDDEN = 64, 2048, 16, 32
#: A window holds LENGTH context ids and scores its last SCORED ones; successive windows overlap, so each token is scored
#: once with at least LENGTH - SCORED + 1 ids before it (the text's begin counting as such).
LENGTH, SCORED = 47, 40
FIRST = LENGTH - SCORED
MASK = np.where(np.arange(LENGTH)[None, :] <= np.arange(FIRST, LENGTH)[:, None], 0, -np.inf).astype(np.float32)
SCALE = np.float32(1 / np.sqrt(DIM))
#: Between these, sums of plain float32 exponentials lost nothing; beyond them the row's maximum is taken off first.
LEAST, MOST = 1e-18, 1e18


@dataclass
class Vocabulary:
    """What the id counts of the training texts determine; the last two ids are the end and the begin of a text."""

    symbol: np.ndarray  # id -> input row
    klass: np.ndarray  # id -> class
    within: np.ndarray  # id -> ln P(id | class)
    prior: np.ndarray  # class -> ln share


def vocabulary(counts: np.ndarray) -> Vocabulary:
    mass = counts + 0.1
    order = np.lexsort((np.arange(len(mass)), -mass))
    upto = np.cumsum(mass[order]) - mass[order]
    klass = np.empty(len(mass), np.intp)
    klass[order] = np.minimum(CLASSES - 1, upto * CLASSES / mass.sum()).astype(np.intp)
    total = np.bincount(klass, mass, CLASSES)
    rank = np.empty(len(mass), np.intp)
    rank[order] = np.arange(len(mass))
    symbol = np.where(rank < OWN, rank, OWN + klass)
    return Vocabulary(symbol, klass, np.log(mass / total[klass]), np.log(np.maximum(total, 1e-9) / mass.sum()).astype(np.float32))


def initial(vocab: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shapes = {"E": (OWN + CLASSES, DIM), "P": (LENGTH, DIM), "Wq": (DIM, DIM), "Wk": (DIM, DIM), "Wv": (DIM, DIM), "W1": (2 * DIM, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, CLASSES)}
    params = {k: (r.standard_normal(s) * (0.5 if k == "E" else 0.1 if k == "P" else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
    params["W2"] *= np.float32(0.1)
    params["b2"] = vocab.prior.copy()
    return params


def windows(ids: np.ndarray, begin: int) -> np.ndarray:
    """(n, LENGTH + 1) ids: row k predicts its last SCORED columns from those before; -1 fills up the last row."""
    n = -(-len(ids) // SCORED)
    flat = np.full(FIRST + 1 + n * SCORED, -1, np.int32)
    flat[: FIRST + 1] = begin
    flat[FIRST + 1 : FIRST + 1 + len(ids)] = ids
    return np.ndarray((n, LENGTH + 1), np.int32, flat, 0, (SCORED * flat.itemsize, flat.itemsize))


def window_blocks(texts: Iterable[np.ndarray], begin: int, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, window) rows of all texts in blocks of at most so many windows."""
    part, held = [], 0
    for i, ids in enumerate(texts):
        w = windows(ids, begin)
        for at in range(0, len(w), most):
            part.append((np.full(len(w[at : at + most]), i), w[at : at + most]))
            held += len(part[-1][0])
            if held >= most:
                yield tuple(np.concatenate(c) for c in zip(*part))
                part, held = [], 0
    if part:
        yield tuple(np.concatenate(c) for c in zip(*part))


def safe(total: np.ndarray) -> bool:
    return bool(LEAST < total.min() <= total.max() < MOST)


def exp_rows(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, each row up to a factor, and the rows' sums."""
    ones = np.ones(t.shape[-1], np.float32)
    with np.errstate(over="ignore"):
        e = np.exp(t)
        total = e @ ones
    if not safe(total):
        t -= t.max(-1, keepdims=True)
        total = np.exp(t, out=e) @ ones
    return e, total


def log_softmax_at(z: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ln of the share of one column a row under exp(z + bias). The bias is kept out of the rows, whose small numbers round less."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.exp(z) @ np.exp(bias)
    if not safe(total):
        z += bias
        z -= z.max(-1, keepdims=True)
        total, bias = np.exp(z).sum(-1), np.zeros_like(bias)
    chosen = z.ravel().take(np.arange(0, z.size, z.shape[-1]) + at)
    return chosen.astype(np.float64) + bias.take(at) - np.log(total, dtype=np.float64)


def attend(q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights up to a factor a row, and the rows' sums."""
    a = q @ k.transpose(0, 2, 1)
    a += MASK
    e, total = exp_rows(a)
    return e, total[..., None]


def with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For a product with rows that end with a 1."""
    return np.concatenate([w, b[None]])


class Scorer:
    """ln P(class) with the products of the input vectors and the first matrices taken once."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        keys, asks = np.concatenate([p["Wk"], p["Wv"]], 1), np.concatenate([p["Wq"] * SCALE, p["W1"][:DIM]], 1)
        self.p, self.kv, self.qu = p, p["E"] @ keys, p["E"] @ asks
        self.place_kv, self.place_qu = p["P"] @ keys, p["P"][FIRST:] @ asks
        self.place_qu[:, DIM:] += p["b1"]

    def class_log_probs(self, symbols: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """ln P(class) of each scored place of each window."""
        kv, qu = self.kv.take(symbols, 0), self.qu.take(symbols[:, FIRST:], 0)
        kv += self.place_kv
        qu += self.place_qu
        a, total = attend(qu[..., :DIM], kv[..., :DIM])
        context = a @ kv[..., DIM:]
        context /= total
        h = context.reshape(-1, DIM) @ self.p["W1"][DIM:]
        h += qu[..., DIM:].reshape(-1, HIDDEN)
        return log_softmax_at(np.maximum(h, 0, out=h) @ self.p["W2"], self.p["b2"], klass.ravel()).reshape(klass.shape)


def gradient(p: dict[str, np.ndarray], symbols: np.ndarray, klass: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean of -ln P(class) over the places of weight 1."""
    n = len(symbols)
    x = p["E"].take(symbols, 0)
    x += p["P"]
    flat, own = x.reshape(-1, DIM), np.ascontiguousarray(x[:, FIRST:]).reshape(-1, DIM)
    keys, asks = np.concatenate([p["Wk"], p["Wv"]], 1), p["Wq"] * SCALE
    kv = (flat @ keys).reshape(n, LENGTH, 2 * DIM)
    k, v = kv[..., :DIM], kv[..., DIM:]
    q = (own @ asks).reshape(n, SCORED, DIM)
    a, total = attend(q, k)
    context = a @ v
    context /= total
    seen = np.concatenate([own, context.reshape(-1, DIM), np.ones((len(own), 1), np.float32)], 1)
    h = np.ones((len(own), HIDDEN + 1), np.float32)
    np.maximum(seen @ with_bias(p["W1"], p["b1"]), 0, out=h[:, :HIDDEN])
    dz, sums = exp_rows(h @ with_bias(p["W2"], p["b2"]))
    share = weight.ravel() / np.float32(max(1.0, weight.sum()))
    dz *= (share / sums)[:, None]
    dz.ravel()[np.arange(0, dz.size, CLASSES) + klass.ravel()] -= share
    dh = dz @ p["W2"].T
    dh *= h[:, :HIDDEN] > 0
    down = dh @ p["W1"].T
    dcontext = down[:, DIM:].reshape(n, SCORED, DIM) / total
    da = dcontext @ v.transpose(0, 2, 1)
    da -= np.einsum("nij,nij->ni", dcontext, context)[..., None]
    da *= a
    dq = (da @ k).reshape(-1, DIM)
    dkv = np.empty((n, LENGTH, 2 * DIM), np.float32)
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[..., :DIM])
    np.matmul(a.transpose(0, 2, 1), dcontext, out=dkv[..., DIM:])
    dkv = dkv.reshape(-1, 2 * DIM)
    dx = (dkv @ keys.T).reshape(n, LENGTH, DIM)
    dx[:, FIRST:] += (down[:, :DIM] + dq @ asks.T).reshape(n, SCORED, DIM)
    dkeys, dw1, dw2 = flat.T @ dkv, seen.T @ dh, (dz.T @ h[:, :HIDDEN]).T
    return {
        "E": summed_rows(symbols.ravel(), dx.reshape(-1, DIM), len(p["E"])), "P": dx.sum(0), "Wq": own.T @ dq * SCALE, "Wk": dkeys[:, :DIM], "Wv": dkeys[:, DIM:],
        "W1": dw1[:-1], "b1": dw1[-1], "W2": dw2, "b2": np.ones(len(dz), np.float32) @ dz,
    }


def summed_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sums of the rows of each number."""
    width = rows.shape[1]
    return np.bincount(((at * width)[:, None] + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width).astype(np.float32)


class Trainer:
    """Adam from the given parameters, which lie one after another in one array; the rate falls with the square root of the steps."""

    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary, rate: float = 0.01, batch: int = 32) -> None:
        self.vocab, self.rate, self.batch, self.steps = vocab, rate, batch, 0
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        ends = np.cumsum([v.size for v in p.values()])
        self.p = {k: part.reshape(p[k].shape) for k, part in zip(p, np.split(self.flat, ends[:-1]))}
        self.m, self.s, self.g, self.t = (np.zeros_like(self.flat) for _ in range(4))

    def learn(self, rows: np.ndarray) -> None:
        """One pass over window rows, in an order that their number fixes."""
        rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))]
        target = rows[:, -SCORED:]
        symbols, klass, there = self.vocab.symbol[np.maximum(rows[:, :-1], 0)], self.vocab.klass[np.maximum(target, 0)], (target >= 0).astype(np.float32)
        for at in range(0, len(rows), self.batch):
            part = slice(at, at + self.batch)
            g = gradient(self.p, symbols[part], klass[part], there[part])
            self.step(np.concatenate([g[k].ravel() for k in self.p], out=self.g))

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        rate = np.float32(self.rate / np.sqrt(1 + self.steps / 200) / (1 - 0.9**self.steps))
        m, s, t = self.m, self.s, self.t
        m *= np.float32(0.9)
        m += np.multiply(g, np.float32(0.1), out=t)
        s *= np.float32(0.99)
        s += np.multiply(np.multiply(g, g, out=t), np.float32(0.01), out=t)
        np.sqrt(np.divide(s, np.float32(1 - 0.99**self.steps), out=t), out=t)
        t += np.float32(1e-6)
        np.divide(m, t, out=t)
        t *= rate
        self.flat -= t


def log_probs(scorer: Scorer, vocab: Vocabulary, rows: np.ndarray, batch: int = 32) -> np.ndarray:
    """ln P of each window row's scored ids, summed; filling counts nothing."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), batch):
        w = rows[i : i + batch]
        target = w[:, -SCORED:]
        there, target = target >= 0, np.maximum(target, 0)
        got = scorer.class_log_probs(vocab.symbol[np.maximum(w[:, :-1], 0)], vocab.klass[target]) + vocab.within[target]
        out[i : i + batch] = np.where(there, got, 0).sum(1)
    return out
