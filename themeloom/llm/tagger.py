"""A bidirectional LSTM over signs with CRF transitions over tags, in numpy."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

HIDDEN = 20
BARRED = -1e4

Weights = dict[str, np.ndarray]


def initial(symbols: int, tags: int, hidden: int = HIDDEN, seed: int = 42) -> Weights:
    """Random weights; index 0 of ``table`` and ``inner`` reads forward, 1 backward."""
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 0.2, (2, symbols, 4 * hidden))
    table[:, :, hidden:2 * hidden] += 0.5                       # what is kept, at first
    return {"table": table.astype(np.float32),
            "inner": draw.normal(0, hidden ** -0.5, (2, hidden, 4 * hidden)).astype(np.float32),
            "out": draw.normal(0, 0.2, (2 * hidden, tags)).astype(np.float32),
            "bias": np.zeros(tags, np.float32),
            "trans": np.zeros((tags, tags), np.float32)}


def barred(tags: int) -> np.ndarray:
    """Barrier of each step between tags: an inner tag (even) follows its own first or inner one."""
    out = np.zeros((tags, tags), np.float32)
    for after in range(2, tags, 2):
        out[:, after] = BARRED
        out[[after - 1, after], after] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def emissions(w: Weights, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Scores of each tag at each place, (rows, places, tags), for symbols x (rows, places)."""
    rows, places = x.shape
    hidden = w["inner"].shape[1]
    both = np.stack([x, x[:, ::-1]])
    h = np.zeros((2, rows, hidden), w["inner"].dtype)
    c = np.zeros_like(h)
    states = np.empty((places, 2, rows, hidden), h.dtype)
    ways = np.arange(2)[:, None]
    for t in range(places):
        z = w["table"][ways, both[:, :, t]] + h @ w["inner"]
        gates = _sigmoid(z[:, :, :3 * hidden])
        take, keep, show = gates[..., :hidden], gates[..., hidden:2 * hidden], gates[..., 2 * hidden:]
        new = np.tanh(z[:, :, 3 * hidden:])
        before = c
        c = keep * before + take * new
        bent = np.tanh(c)
        if trace is not None:
            trace.append((h, before, take, keep, show, new, bent))
        h = show * bent
        states[t] = h
    ahead, back = states[:, 0], states[::-1, 1]
    joined = np.concatenate([ahead, back], axis=2).transpose(1, 0, 2)
    if trace is not None:
        trace.append((both, joined))
    return joined @ w["out"] + w["bias"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _first(em: np.ndarray) -> np.ndarray:
    first = em[:, 0].copy()
    first[:, 2::2] += BARRED
    return first


def marginals(em: np.ndarray, steps: np.ndarray, inside: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition of each row, chance of each tag at each place, expected steps between tags.

    ``inside`` says which places belong to a row; they are its first ones.
    """
    rows, places, tags = em.shape
    alpha = np.empty_like(em)
    alpha[:, 0] = _first(em)
    for t in range(1, places):
        ahead = _log_sum(alpha[:, t - 1, :, None] + steps, 1) + em[:, t]
        alpha[:, t] = np.where(inside[:, t, None], ahead, alpha[:, t - 1])
    total = _log_sum(alpha[:, -1], 1)
    beta = np.zeros_like(em)
    expected = np.zeros((tags, tags), em.dtype)
    for t in range(places - 1, 0, -1):
        rest = (em[:, t] + beta[:, t])[:, None, :] + steps
        pair = np.exp(alpha[:, t - 1, :, None] + rest - total[:, None, None])
        expected += (pair * inside[:, t, None, None]).sum(0)
        beta[:, t - 1] = np.where(inside[:, t, None], _log_sum(rest, 2), beta[:, t])
    chance = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
    return total, chance, expected


def decode(em: np.ndarray, steps: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Best tags of each row, (rows, places); tag 0 outside."""
    rows, places, _ = em.shape
    best = _first(em)
    back = np.zeros(em.shape, np.int8)
    for t in range(1, places):
        ways = best[:, :, None] + steps
        back[:, t] = ways.argmax(1)
        best = np.where(inside[:, t, None], ways.max(1) + em[:, t], best)
    tags = np.zeros((rows, places), np.int8)
    at = best.argmax(1)
    for t in range(places - 1, -1, -1):
        tags[:, t] = np.where(inside[:, t], at, 0)
        if t:
            at = np.where(inside[:, t], back[np.arange(rows), t, at], at)
    return tags


def loss(w: Weights, x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[float, Weights]:
    """Mean negative log chance of the tags y of each row, and its gradient."""
    rows, places = x.shape
    trace: list = []
    em = emissions(w, x, trace)
    both, joined = trace.pop()
    tags = em.shape[2]
    steps = w["trans"] + barred(tags)
    total, chance, expected = marginals(em, steps, inside)
    row, place = np.nonzero(inside)
    gold = np.zeros_like(em)
    gold[row, place, y[row, place]] = 1
    follows = inside[:, 1:]
    seen = np.zeros_like(expected)
    np.add.at(seen, (y[:, :-1][follows], y[:, 1:][follows]), 1)
    value = float(total.sum() - (em * gold).sum() - (seen * steps).sum()) / rows
    d_em = (chance - gold) / rows
    grad = {"trans": (expected - seen) / rows * (barred(tags) == 0),
            "bias": d_em.sum((0, 1)),
            "out": np.einsum("rph,rpk->hk", joined, d_em, optimize=True)}
    d_joined = (d_em @ w["out"].T).transpose(1, 0, 2)
    hidden = w["inner"].shape[1]
    d_states = np.stack([d_joined[:, :, :hidden], d_joined[::-1, :, hidden:]], axis=1)
    grad["table"], grad["inner"] = np.zeros_like(w["table"]), np.zeros_like(w["inner"])
    d_h = np.zeros((2, rows, hidden), em.dtype)
    d_c = np.zeros_like(d_h)
    for t in range(places - 1, -1, -1):
        h, before, take, keep, show, new, bent = trace[t]
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * show * (1 - bent ** 2)
        d_z = np.concatenate([
            d_c * new * take * (1 - take), d_c * before * keep * (1 - keep),
            d_h * bent * show * (1 - show), d_c * take * (1 - new ** 2)], axis=2)
        grad["inner"] += h.transpose(0, 2, 1) @ d_z
        for way in range(2):
            np.add.at(grad["table"][way], both[way, :, t], d_z[way])
        d_h = d_z @ w["inner"].transpose(0, 2, 1)
        d_c = d_c * keep
    return value, grad


def train(w: Weights, x: np.ndarray, y: np.ndarray, inside: np.ndarray, epochs: int,
          batch: int = 128, rate: float = 0.01, seed: int = 42) -> Iterator[float]:
    """Adam over shuffled batches; changes ``w`` and gives the mean loss of each epoch."""
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order, losses = draw.permutation(len(x)), []
        speed = rate * (1 - epoch / epochs) + 0.05 * rate
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            value, grad = loss(w, x[some], y[some], inside[some])
            losses.append(value)
            step += 1
            size = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g ** 2 - second[k])
                w[k] -= (speed * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(w[k].dtype)
        yield float(np.mean(losses))


def pack(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def unpack(data: bytes) -> Weights:
    with np.load(io.BytesIO(data), allow_pickle=False) as stored:
        return {k: stored[k] for k in stored.files}
