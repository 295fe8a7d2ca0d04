"""A one-layer causal self-attention model over subword ids, in numpy.

The next id's probability is that of its class given the context times that of the id given its class and the id
before. The second factor, and a first guess of the classes, come from pair counts over the whole training corpus; the
attention layer learns what the wider context adds to the classes' log odds. So an untrained layer scores like the pair
model, and the table sizes follow the subword vocabulary alone.
"""

from __future__ import annotations

import numpy as np

from .hashing import places

WIDTH, OVERLAP = 32, 8
DIM, HIDDEN, CLASSES = 16, 32, 32
#: Weight of single-id shares in the pair model.
PRIOR = 20.0


def classes_of(pairs: np.ndarray, n: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """A class for each id, by k-means over what comes before it. Seeded, so equal counts give equal classes."""
    rng, n = np.random.default_rng(0), min(n, len(pairs))
    total = pairs.sum(axis=0, dtype=np.float64)
    x = np.sqrt(pairs, dtype=np.float32).T @ rng.normal(0, 1, (pairs.shape[0], 48)).astype(np.float32)
    x /= np.sqrt(np.maximum(1, total))[:, None].astype(np.float32)
    centre = x[np.argsort(-total, kind="stable")[:n]]
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)).argmin(axis=1)
        centre = np.array([x[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(n)])
    return own.astype(np.int64)


class PairModel:
    """Log shares of ids and classes given the id before, from counts pairs[before, next] (32-bit floats, reused in place)."""

    def __init__(self, pairs: np.ndarray):
        self.own = classes_of(pairs)
        total = pairs.sum(axis=0, dtype=np.float64)
        single = ((total + 0.5) / (total.sum() + 0.5 * len(total))).astype(np.float32)
        share = np.asarray(pairs, np.float32)
        bottom = (share.sum(axis=1, keepdims=True, dtype=np.float64) + PRIOR).astype(np.float32)
        share += np.float32(PRIOR) * single
        share /= bottom
        of = np.full((len(share), CLASSES), 1e-30, np.float32)
        for c in range(CLASSES):
            of[:, c] += share[:, self.own == c].sum(axis=1)
        self.odds, self.of = of, np.log(of)
        np.log(share, out=share)
        for c in range(CLASSES):
            share[:, self.own == c] -= self.of[:, c : c + 1]
        self.within = share


def fresh(ids: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    put = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    return {"E": rng.normal(0, 0.5, (ids, DIM)).astype(np.float32), "P": rng.normal(0, 0.5, (WIDTH, DIM)).astype(np.float32), "Q": put(DIM, DIM), "K": put(DIM, DIM), "V": put(DIM, DIM), "O": put(DIM, DIM), "A": put(DIM, HIDDEN), "B": put(HIDDEN, DIM), "U": np.zeros((DIM, CLASSES), np.float32)}


MASK = np.triu(np.full((WIDTH, WIDTH), -1e9, np.float32), 1)
SEEN = np.tril(np.ones((WIDTH, WIDTH), np.float32))
#: Logits that exp takes as they are; those of classes come on top of log shares down to -69. Windows of one lot in training
#: and in scoring.
FAR, NEAR, LOT, SCORED = 60.0, 15.0, 64, 128


def largest(a: np.ndarray) -> np.ndarray:
    """The maximum over the last axis, which stays with length 1, by halves: a reduction along a short axis is slow."""
    while (n := a.shape[-1]) > 1:
        half = (n + 1) // 2
        a = np.maximum(a[..., :half], a[..., n - half :])
    return a


def total(a: np.ndarray) -> np.ndarray:
    """The sum over the last axis, which stays with length 1."""
    return (a @ np.ones(a.shape[-1], a.dtype))[..., None]


def turned(a: np.ndarray) -> np.ndarray:
    """Each matrix transposed, as a view that products take as it is."""
    return a.transpose(0, 2, 1)


def folded(w: dict) -> np.ndarray:
    """What turns an input into its query, to be held against inputs themselves, and into what it adds to places that see
    it: Q times K transposed, scaled, beside V times O. Products with four matrices become products with two."""
    return np.concatenate((w["Q"] @ w["K"].T * np.float32(DIM**-0.5), w["V"] @ w["O"]), axis=1)


def attend(s: np.ndarray, skip: int = 0) -> np.ndarray:
    """exp of the logits s of places from skip on, in place, 0 for what a place doesn't see; rows aren't divided by their sums.

    Rows are set against their largest only where exp could leave the range of 32-bit floats.
    """
    if s.size and max(s.max(), -s.min()) > FAR:
        s += MASK[skip:]
        s -= largest(s)
        return np.exp(s, out=s)
    np.exp(s, out=s)
    s *= SEEN[skip:]
    return s


def odds(y: np.ndarray, pair: PairModel, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """In place: from what the layer adds to the log odds of classes behind the ids, numbers in proportion to the classes'
    shares; and the logs by which they are too small."""
    if y.size and max(y.max(), -y.min()) > NEAR:
        y += pair.of.take(ids, axis=0)
        top = largest(y)
        y -= top
        return np.exp(y, out=y), top[..., 0]
    np.exp(y, out=y)
    y *= pair.odds.take(ids, axis=0)
    return y, 0.0


def class_logs(w: dict, pair: PairModel, ids: np.ndarray) -> np.ndarray:
    """Log shares of the next id's class at every place of windows ids (n, WIDTH); a place sees itself and those before."""
    x = w["E"].take(ids, axis=0) + w["P"]
    both = x @ folded(w)
    a = attend(both[:, :, :DIM] @ turned(x))
    h = x + a @ both[:, :, DIM:] / total(a)
    y = (h + np.maximum(h @ w["A"], 0) @ w["B"]) @ w["U"] + pair.of.take(ids, axis=0)
    y -= largest(y)
    return y - np.log(total(np.exp(y)))


def gradients(w: dict, pair: PairModel, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, tell: bool = True) -> tuple[dict, float]:
    """Of the weighted mean negative log share of the target classes, which comes with them if tell is set.

    Windows are taken LOT at a time, so that what one step makes is still at hand for the next.
    """
    both_w, kind = folded(w), w["E"].dtype
    a_w, b_w, u_w, one = w["A"], w["B"], w["U"], weight / weight.sum()
    out = {k: np.zeros_like(w[k]) for k in "ABU"}
    d_both, dx, loss = np.zeros_like(both_w), np.empty((*ids.shape, DIM), kind), 0.0
    for k in range(0, len(ids), LOT):
        own, part = ids[k : k + LOT], one[k : k + LOT].ravel().astype(np.float32)
        n = len(own)
        deep = lambda m: m.reshape(n, WIDTH, -1)  # noqa: E731, B023
        x = w["E"].take(own.ravel(), axis=0)
        deep(x)[:] += w["P"]
        both = x @ both_w
        query, adds = deep(both)[:, :, :DIM], deep(both)[:, :, DIM:]
        # Rows of a stay as they are; what is made of them is divided by their sums, which is half as wide.
        a = attend(query @ turned(deep(x)))
        by = np.reciprocal(total(a)).reshape(-1, 1)
        o = (a @ adds).reshape(-1, DIM)
        o *= by
        h = x + o
        r = h @ a_w
        on = (r > 0).astype(kind)
        r *= on
        g = r @ b_w
        g += h
        d = g @ u_w
        at = np.arange(0, len(d) * CLASSES, CLASSES) + target[k : k + LOT].ravel()
        said = d.ravel()[at] if tell else None
        d, top = odds(d, pair, own.ravel())
        z = total(d)
        if tell:
            loss -= float(((said + pair.of.ravel()[own.ravel() * CLASSES + target[k : k + LOT].ravel()] - np.log(z[:, 0]) - top) * part).sum())
        d *= part[:, None] / z
        d.ravel()[at] -= part
        out["U"] += g.T @ d
        dg = d @ u_w.T
        out["B"] += r.T @ dg
        dz = dg @ b_w.T
        dz *= on
        out["A"] += h.T @ dz
        dh = dz @ a_w.T
        dh += dg
        mine = dx[k : k + LOT].reshape(-1, DIM)
        mine[:] = dh
        dh *= by
        ds = deep(dh) @ turned(adds)
        # A row's sum of ds times a is what its gradient makes with its own output.
        o *= dh
        ds -= deep(total(o))
        ds *= a
        d_in = np.empty_like(both)
        np.matmul(ds, deep(x), out=deep(d_in)[:, :, :DIM])
        np.matmul(turned(a), deep(dh), out=deep(d_in)[:, :, DIM:])
        d_both += x.T @ d_in
        mine += (turned(ds) @ query).reshape(-1, DIM)
        mine += d_in @ both_w.T
    scale, dn, dm = np.float32(DIM**-0.5), d_both[:, :DIM], d_both[:, DIM:]
    out |= {"Q": dn @ w["K"] * scale, "K": dn.T @ w["Q"] * scale, "V": dm @ w["O"].T, "O": w["V"].T @ dm, "P": dx.sum(axis=0)}
    out["E"] = np.zeros_like(w["E"])
    # Two numbers of a row are added at once, as the parts of a complex one.
    two = np.result_type(kind, np.complex64)
    np.add.at(out["E"].view(two).ravel(), (ids.reshape(-1, 1) * (DIM // 2) + np.arange(DIM // 2)).ravel(), dx.view(two).ravel())
    return out, loss


def train(w: dict, pair: PairModel, windows: np.ndarray, steps: int, batch: int = 64, rate: float = 8e-3) -> dict:
    """Adam over windows (n, WIDTH + 1); ids under 0 are padding behind the end. The rate falls to 0 in a straight line.

    Windows are taken in a random order, each once before any again, so n / batch steps see them all.
    """
    names = list(w)
    flat = np.concatenate([w[k].ravel() for k in names])
    edges = np.cumsum([0, *(w[k].size for k in names)])
    w = {k: flat[a:e].reshape(w[k].shape) for k, a, e in zip(names, edges, edges[1:], strict=False)}
    m, s, g, now = (np.zeros_like(flat) for _ in range(4))
    rng = np.random.default_rng(2)
    order, at = rng.permutation(len(windows)), 0
    for step in range(steps):
        if at >= len(order):
            order, at = rng.permutation(len(windows)), 0
        own = windows[order[at : at + batch]].astype(np.int64)
        at += batch
        target, weight = own[:, 1:], (own[:, 1:] >= 0).astype(np.float32)
        grad, _ = gradients(w, pair, np.maximum(own[:, :-1], 0), pair.own[np.maximum(target, 0)], weight, False)
        for k, a, e in zip(names, edges, edges[1:], strict=False):
            g[a:e] = grad[k].ravel()
        # All in place: m and s are running means of g and of its square, now is the step.
        m *= np.float32(0.9)
        s *= np.float32(0.99)
        np.multiply(g, np.float32(0.1), out=now)
        m += now
        np.multiply(g, g, out=now)
        now *= np.float32(0.01)
        s += now
        np.multiply(s, np.float32(1 / (1 - 0.99 ** (step + 1))), out=now)
        np.sqrt(now, out=now)
        now += np.float32(1e-8)
        np.divide(m, now, out=now)
        now *= np.float32(rate * (1 - step / steps) / (1 - 0.9 ** (step + 1)))
        flat -= now
    return w


def cuts(n: np.ndarray) -> np.ndarray:
    """How many windows score texts of n ids: each but the first repeats OVERLAP places for context alone."""
    return np.maximum(1, -(-(n - OVERLAP) // (WIDTH - OVERLAP)))


def tables(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """For every id, and for every place of a window, its part of the input and of what folded makes of that."""
    both = folded(w)
    return tuple(np.concatenate((w[k], w[k] @ both), axis=1) for k in "EP")


def target_logs(w: dict, made: tuple, pair: PairModel, ids: np.ndarray, target: np.ndarray, skip: int) -> np.ndarray:
    """Log probabilities of the targets (n, WIDTH - skip) at the places from skip on; made is what tables makes of w."""
    f = made[0].take(ids, axis=0)
    f += made[1]
    a = attend(f[:, skip:, DIM : 2 * DIM] @ turned(f[:, :, :DIM]), skip)
    h = a @ f[:, :, 2 * DIM :]
    h *= np.reciprocal(total(a))
    h += f[:, skip:, :DIM]
    h = h.reshape(-1, DIM)
    r = h @ w["A"]
    r *= (r > 0).astype(r.dtype)
    h += r @ w["B"]
    y = h @ w["U"]
    own, target = ids[:, skip:].ravel(), target.ravel()
    group = pair.own[target]
    said = y.ravel()[np.arange(len(y)) * CLASSES + group] + pair.of.ravel()[own * CLASSES + group]
    y, top = odds(y, pair, own)
    said -= np.log(total(y)[:, 0]) + top
    said += pair.within.ravel()[own * len(pair.within) + target]
    return said.reshape(len(ids), -1)


def score_stream(w: dict, pair: PairModel, ids: np.ndarray, ends: np.ndarray, chunk: int = SCORED) -> np.ndarray:
    """Natural log probability of every id but the first, given those before it in its text; every one scored once.

    ids are texts one after another with an end before the first and behind each; ends are the places of the ends.
    """
    flat = np.concatenate((ids, np.zeros(WIDTH + 1, np.int64)))
    n = np.diff(ends)
    of = cuts(n)
    begin, size = np.repeat(ends[:-1], of), np.repeat(n, of)
    local = places(of) * (WIDTH - OVERLAP)
    out, place, made = np.empty(len(ids), np.float64), np.arange(WIDTH), tables(w)
    for skip in (0, OVERLAP):
        mine = np.flatnonzero((local > 0) == (skip > 0))
        for k in range(0, len(mine), chunk):
            some = mine[k : k + chunk]
            at = (begin + local)[some, None] + place
            logs = target_logs(w, made, pair, flat[at], flat[at[:, skip:] + 1], skip)
            live = place[: WIDTH - skip] < (size[some] - local[some] - skip)[:, None]
            out[at[:, skip:][live]] = logs[live]
    return out[:-1]


def score(w: dict, pair: PairModel, texts: list[np.ndarray], end: int) -> np.ndarray:
    """As score_stream, for separate texts of ids: of every id and of the end after each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    stream = np.concatenate([np.array([end]), *(np.append(t, end) for t in texts)]).astype(np.int64)
    return score_stream(w, pair, stream, np.concatenate(([0], np.cumsum(sizes))))
