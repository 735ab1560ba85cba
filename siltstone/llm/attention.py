"""A small causal self-attention model over subword classes, in numpy.

A class is one of the most frequent ids, the end of a text, or all other ids
together.  Classes form GROUPS groups; a class is predicted as its group, then
itself within the group, so the two softmaxes are short.  Their logits start
from smoothed counts of class pairs, and so do the classes' places; one attention layer and one hidden layer
over a window of classes add to them.  The layer has one head as wide as the
places, so keys times queries, and values times output, are one full matrix
each: A and B.  Any four matrices come to such two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

GROUPS = 32
BITS = 5
SIZE = 1 << BITS
CLASSES = GROUPS * SIZE
OTHER, END = CLASSES - 2, CLASSES - 1
START = CLASSES  # stands before a text; never a target
VOCABULARY = 50_257
WIDTH = 24
HIDDEN = 48
WINDOW = 64
STRIDE = 48
PRIOR = 5.0
NAMES = ("E", "P", "A", "B", "W1", "W2", "U", "T")


def shapes() -> dict[str, tuple[int, int]]:
    d = WIDTH
    return {"E": (CLASSES + 1, d), "P": (WINDOW, d), "A": (d, d), "B": (d, d), "W1": (d, HIDDEN), "W2": (HIDDEN, d), "U": (GROUPS, d), "T": (CLASSES, d)}


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    # with U and T at zero an untrained network adds nothing to the counts
    scale = {"E": 0.3, "P": 0.1, "B": 0.05, "W2": 0.05, "U": 0.0, "T": 0.0}
    return {k: rng.normal(0, scale.get(k, s[0] ** -0.5), s).astype(np.float32) for k, s in shapes().items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in NAMES])


def views(values: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as parts of one array."""
    out, at = {}, 0
    for k, s in shapes().items():
        out[k] = values[at : at + s[0] * s[1]].reshape(s)
        at += s[0] * s[1]
    return out


@dataclass
class Model:
    class_of: np.ndarray  # of each id
    other: np.ndarray  # log probability of each id among the other ids
    group_bias: np.ndarray  # (CLASSES + 1, GROUPS)
    class_bias: np.ndarray  # (GROUPS, CLASSES + 1, SIZE)
    weights: dict[str, np.ndarray] = field(default_factory=initial)

    def __post_init__(self) -> None:
        self.group_factor, self.class_factor = np.exp(self.group_bias), np.exp(self.class_bias).reshape(-1, SIZE)


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id by how often it occurs, and the log probability of each id within the class of the others."""
    order = np.argsort(-counts, kind="stable")
    out = np.full(VOCABULARY, OTHER, dtype=np.int16)
    out[order[:OTHER]] = np.arange(OTHER)
    rest = np.where(out == OTHER, counts + 0.5, 0.0)
    with np.errstate(divide="ignore"):
        return out, np.log(rest / rest.sum()).astype(np.float32)


def biases(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the next group after each class, and of the next class within its group, from counts of pairs."""

    def smooth(part: np.ndarray) -> np.ndarray:
        over = part.sum(axis=-2, keepdims=True) + 0.5
        over /= over.sum(axis=-1, keepdims=True)
        return np.log((part + PRIOR * over) / (part.sum(axis=-1, keepdims=True) + PRIOR)).astype(np.float32)

    by_group = pairs.reshape(CLASSES + 1, GROUPS, SIZE)
    return smooth(by_group.sum(axis=2)), smooth(np.ascontiguousarray(by_group.transpose(1, 0, 2)))


def start_embedding(pairs: np.ndarray, scale: float = 0.4) -> np.ndarray:
    """Places of the classes by what follows them and what they follow: leading singular vectors of the pairs' log ratios."""
    expected = (pairs.sum(axis=1, keepdims=True) + 1) * (pairs.sum(axis=0, keepdims=True) + 1) / max(pairs.sum(), 1)
    u, s, v = np.linalg.svd(np.log1p(pairs / expected), full_matrices=False)
    half = WIDTH // 2
    out = np.zeros((CLASSES + 1, WIDTH))
    out[:, :half] = u[:, :half] * np.sqrt(s[:half])
    out[:CLASSES, half:] = v[: WIDTH - half].T * np.sqrt(s[: WIDTH - half])
    out -= out.mean(axis=0)
    # the sign of a singular vector is arbitrary; the largest entry is taken to be positive
    out *= np.where(out[np.abs(out).argmax(axis=0), np.arange(WIDTH)] < 0, -1, 1) * scale / np.maximum(out.std(axis=0), 1e-9)
    return out.astype(np.float32)


MASK = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
MOST = 60.0
AT_ONCE = 32  # windows whose attention is in memory at once


def bound(w: dict[str, np.ndarray]) -> float:
    """No score of one place by another is larger than this."""
    longest = sum(float(np.sqrt(np.einsum("ij,ij->i", w[k], w[k]).max())) for k in ("E", "P"))
    return longest**2 * float(np.linalg.norm(w["A"], 2)) * WIDTH**-0.5


@dataclass
class Ready:
    """What scoring looks up instead of multiplying: queries of each class and each position, and their places with a one behind."""

    asks: tuple[np.ndarray, np.ndarray]
    tells: tuple[np.ndarray, np.ndarray]
    bounded: bool


def prepare(model: Model) -> Ready:
    w = model.weights
    kind = w["E"].dtype
    ask = lambda x: x @ (w["A"] * kind.type(WIDTH**-0.5))
    tell = lambda x, one: np.concatenate([x, np.full((len(x), 1), one, kind)], axis=1)
    return Ready((ask(w["E"]), ask(w["P"])), (tell(w["E"], 1), tell(w["P"], 0)), bound(w) < MOST)


def _hidden(w: dict[str, np.ndarray], ready: Ready, x_in: np.ndarray, first: int) -> np.ndarray:
    """The last layer's output from position ``first`` on; positions before it are only attended to."""
    n, size = x_in.shape
    q = np.take(ready.asks[0], x_in[:, first:], axis=0)
    q += ready.asks[1][first:size]
    ones = np.take(ready.tells[0], x_in, axis=0)
    ones += ready.tells[1][:size]
    turned = np.ascontiguousarray(ones[:, :, :WIDTH].transpose(0, 2, 1))
    sums = np.empty((n, size - first, WIDTH + 1), ones.dtype)
    # in two parts, so that the first queries do not meet the last keys, which they must not see
    for a, b in ((first, (first + size) // 2), ((first + size) // 2, size)):
        seen = np.matmul(q[:, a - first : b - first], turned[:, :, :b])
        if not ready.bounded:
            np.clip(seen, -MOST, MOST, out=seen)
        np.exp(seen, out=seen)
        seen *= np.ascontiguousarray(MASK[a:b, :b])
        np.matmul(seen, ones[:, :b], out=sums[:, a - first : b - first])
    m = sums[:, :, :WIDTH] * (1 / sums[:, :, WIDTH:])
    h = m.reshape(-1, WIDTH) @ w["B"]
    h.reshape(m.shape)[:] += ones[:, first:, :WIDTH]
    z = h @ w["W1"]
    np.maximum(z, 0, out=z)
    h += z @ w["W2"]
    return h


def _log_share(logits: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Log of the softmax of logits plus log of factors at one entry of each row."""
    if logits.max() > MOST:
        np.minimum(logits, MOST, out=logits)
    mine = np.arange(0, logits.size, logits.shape[1]) + at
    own = logits.ravel()[mine] + np.log(factors.ravel()[mine])
    np.exp(logits, out=logits)
    logits *= factors
    return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def log_probabilities(model: Model, x_in: np.ndarray, x_out: np.ndarray, first: int = 0, ready: Ready | None = None) -> np.ndarray:
    """Natural log of the probability of each target class of a batch of windows, from position ``first`` on."""
    w, ready = model.weights, ready or prepare(model)
    n, size = x_in.shape
    if not n:
        return np.zeros((0, size - first), w["E"].dtype)
    before, target = x_in[:, first:].ravel(), x_out[:, first:].ravel()
    group, place, rows = target >> BITS, target & (SIZE - 1), AT_ONCE * (size - first)
    g, out = np.empty((len(target), WIDTH), w["E"].dtype), np.empty(len(target), w["E"].dtype)
    for i in range(0, n, AT_ONCE):
        own = slice(i * (size - first), i * (size - first) + rows)
        g[own] = _hidden(w, ready, x_in[i : i + AT_ONCE], first)
        out[own] = _log_share(g[own] @ w["U"].T, group[own], np.take(model.group_factor, before[own], axis=0))
    # rows of one group stand together, so each group is one product
    order, cuts = by_group(target)
    g, place, row = np.take(g, order, axis=0), place[order], (group * (CLASSES + 1) + before)[order]
    more, logits, done = np.empty_like(out), np.empty_like(g, shape=(len(g), SIZE)), 0
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            np.matmul(g[a:b], w["T"][k * SIZE : (k + 1) * SIZE].T, out=logits[a:b])
        if b - done >= rows or (k == GROUPS - 1 and b > done):
            own, done = slice(done, b), b
            more[own] = _log_share(logits[own], place[own], np.take(model.class_factor, row[own], axis=0))
    out[order] += more
    return out.reshape(n, size - first)


def by_group(target: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rows ordered by the group of their target, and where each group starts."""
    group = (target >> BITS).astype(np.int8)
    return np.argsort(group, kind="stable"), [0, *np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()]


def gradients(model: Model, x_in: np.ndarray, x_out: np.ndarray, out: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch and its gradients (written to ``out``); negative entries are padding and are not predicted."""
    w, d = model.weights, WIDTH
    n, size = x_in.shape
    kind = w["E"].dtype
    out = out or {k: np.empty_like(v) for k, v in w.items()}
    seen, target = x_in.ravel(), x_out.ravel()
    weight = (target >= 0).astype(kind)
    weight /= weight.sum()
    seen, target = np.where(seen < 0, END, seen), np.where(target < 0, END, target)
    # forwards; a one stands behind each place, so a sum over places also gives what it is to be divided by
    flat_x = np.take(w["E"], seen, axis=0)
    x = flat_x.reshape(n, size, d)
    x += w["P"][:size]
    ones = np.empty((n, size, d + 1), kind)
    ones[:, :, :d], ones[:, :, d] = x, 1
    to_ask = w["A"] * kind.type(d**-0.5)
    q = (flat_x @ to_ask).reshape(n, size, d)
    turned = np.ascontiguousarray(ones.transpose(0, 2, 1))
    sums, bounded = np.empty((n, size, d + 1), kind), bound(w) < MOST
    # in two parts, so that the first queries do not meet the last keys, which they must not see
    parts = [(a, b, np.empty((n, 2, b - a, b), kind)) for a, b in ((0, size // 2), (size // 2, size)) if a < b]
    for a, b, held in parts:
        e = held[:, 1]
        np.matmul(q[:, a:b], turned[:, :d, :b], out=e)
        if not bounded:
            np.clip(e, -MOST, MOST, out=e)
        np.exp(e, out=e)
        e *= np.ascontiguousarray(MASK[a:b, :b])
        np.matmul(e, ones[:, :b], out=sums[:, a:b])
    over = 1 / sums[:, :, d:]
    m = (sums[:, :, :d] * over).reshape(-1, d)
    h = m @ w["B"]
    h += flat_x
    z = h @ w["W1"]
    np.maximum(z, 0, out=z)
    g = z @ w["W2"]
    g += h

    # the two softmaxes, and back through them
    def shares(p: np.ndarray, factors: np.ndarray, own: np.ndarray, weight: np.ndarray) -> float:
        """Turns logits into what the loss loses by them; gives the loss."""
        if p.max() > MOST:
            np.minimum(p, MOST, out=p)
        np.exp(p, out=p)
        p *= factors
        total, entries, at = p @ np.ones(p.shape[1], kind), p.ravel(), np.arange(0, p.size, p.shape[1]) + own
        share = entries[at] / total
        p *= (weight / total)[:, None]
        entries[at] -= weight
        return -float(np.log(share + kind.type(1e-30)) @ weight)

    group, place = target >> BITS, target & (SIZE - 1)
    p = g @ w["U"].T
    loss = shares(p, np.take(model.group_factor, seen, axis=0), group, weight)
    np.matmul(p.T, g, out=out["U"])
    dg = p @ w["U"]
    order, cuts = by_group(target)
    ordered, back = np.take(g, order, axis=0), np.empty_like(g)
    blocks = [(slice(a, b), slice(k * SIZE, (k + 1) * SIZE)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
    for rows, own in blocks:
        np.matmul(ordered[rows], w["T"][own].T, out=p[rows])
    loss += shares(p, np.take(model.class_factor, (group * (CLASSES + 1) + seen)[order], axis=0), place[order], weight[order])
    out["T"][:] = 0
    for rows, own in blocks:
        np.matmul(p[rows].T, ordered[rows], out=out["T"][own])
        np.matmul(p[rows], w["T"][own], out=back[rows])
    dg[order] += back
    # back through the layers
    np.matmul(z.T, dg, out=out["W2"])
    dz = dg @ w["W2"].T
    dz *= z > 0
    np.matmul(h.T, dz, out=out["W1"])
    dg += dz @ w["W1"].T
    np.matmul(m.T, dg, out=out["B"])
    dm = dg @ w["B"].T
    ds = sums  # what the loss loses by the sums
    np.multiply(dm.reshape(n, size, d), over, out=ds[:, :, :d])
    ds[:, :, d] = np.einsum("ij,ij->i", dm, m).reshape(n, size)
    ds[:, :, d] *= -over[:, :, 0]
    dq, dx = np.empty_like(q), dg.reshape(n, size, d)
    for a, b, held in parts:
        np.matmul(ds[:, a:b], turned[:, :, :b], out=held[:, 0])
        held[:, 0] *= held[:, 1]
        np.matmul(held[:, 0], x[:, :b], out=dq[:, a:b])
        # by the scores' keys and by the means, in one product
        sides = np.empty((n, 2, b - a, d), kind)
        sides[:, 0], sides[:, 1] = q[:, a:b], ds[:, a:b, :d]
        dx[:, :b] += np.matmul(held.reshape(n, -1, b).transpose(0, 2, 1), sides.reshape(n, -1, d))
    dq = dq.reshape(-1, d)
    np.matmul(flat_x.T, dq, out=out["A"])
    out["A"] *= kind.type(d**-0.5)
    dg += dq @ to_ask.T
    out["P"][:] = 0
    out["P"][:size] = dx.sum(axis=0)
    out["E"][:] = 0
    small = seen.astype(np.int16)
    order = np.argsort(small, kind="stable")
    small = small[order]
    starts = np.flatnonzero(np.diff(small, prepend=-1))
    out["E"][small[starts]] = np.add.reduceat(np.take(dg, order, axis=0), starts, axis=0)
    return loss, out


def train(model: Model, windows: np.ndarray, rate: float, batch: int = 64) -> None:
    """One pass of Adam over rows of WINDOW + 1 classes; updates ``model.weights``."""
    every = flat(model.weights)
    model.weights, grad = views(every), np.zeros_like(every)
    grads, mean, square, step_of = views(grad), np.zeros_like(every), np.zeros_like(every), np.empty_like(every)
    for step, at in enumerate(range(0, len(windows), batch), 1):
        own = windows[at : at + batch].astype(np.int64)
        gradients(model, own[:, :-1], own[:, 1:], grads)
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad /= np.float32(norm)
        mean += np.float32(0.1) * (grad - mean)
        np.multiply(grad, grad, out=step_of)
        step_of -= square
        step_of *= np.float32(0.01)
        square += step_of
        np.sqrt(square, out=step_of)
        step_of += np.float32(1e-6 * np.sqrt(1 - 0.99**step))
        np.divide(mean, step_of, out=step_of)
        step_of *= np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        every -= step_of


def text_score(model: Model, found: np.ndarray, bounds: np.ndarray, batch: int = 192) -> np.ndarray:
    """Natural log probability of each text: classes with END after each, joined; bounds: where each text starts.

    Windows of one text overlap by WINDOW - STRIDE classes; each class is scored once.
    """
    size = np.diff(bounds)
    out = np.zeros(len(size))
    more = np.maximum(0, -(-(size - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(size)), 1 + more)
    number = np.arange(len(text)) - np.repeat(np.cumsum(1 + more) - 1 - more, 1 + more)
    start = bounds[text] + number * STRIDE
    room = bounds[text + 1] - start  # classes from the window's first on
    targets = np.concatenate([found, np.full(WINDOW, END)]).astype(np.int64)
    padded = np.concatenate([[START], targets])
    padded[bounds[:-1]] = np.where(size > 0, START, padded[bounds[:-1]])  # END of the text before is not seen
    every_in, every_out = (np.lib.stride_tricks.sliding_window_view(x, WINDOW) for x in (padded, targets))
    ready = prepare(model)
    for first, chosen in ((0, np.flatnonzero(number == 0)), (WINDOW - STRIDE, np.flatnonzero(number > 0))):
        # short windows with short ones, as long as the longest of them
        chosen = chosen[np.argsort(np.minimum(room[chosen], WINDOW), kind="stable")]
        for at in range(0, len(chosen), batch):
            own = chosen[at : at + batch]
            width = int(min(room[own[-1]], WINDOW))
            scored = log_probabilities(model, every_in[start[own], :width], every_out[start[own], :width], first, ready)
            scored[np.arange(first, width) >= room[own][:, None]] = 0  # of the text behind
            np.add.at(out, text[own], scored.sum(axis=1, dtype=np.float64))
    return out
