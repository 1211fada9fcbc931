"""A small causal self-attention model on subword ids, trained and run in numpy inside Spark tasks.

Every subword id has its own embedding. One attention layer looks from each place at the last CONTEXT to 2 * CONTEXT - 1
inputs; its result and the last input's embedding give the next subword's class by a low-rank output, and the subword
inside its class follows corpus counts. Windows of 2 * CONTEXT places overlap by half: each reads all its places and
scores its last CONTEXT, so every token is scored once, with batched masked attention.

Defined cases: an empty sequence has no window; a text's first token is predicted from a start mark alone.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

CLASSES, WIDTH, CONTEXT = 32, 8, 16
#: Windows that are computed at once: few, so that they stay in the processor's cache.
BATCH = 128
SMALL = {"qkv": (WIDTH, 3 * WIDTH), "query_at": (CONTEXT, WIDTH), "key_at": (2 * CONTEXT, WIDTH), "out": (2 * WIDTH + 1, CLASSES)}
_place = np.arange(2 * CONTEXT)
_CAUSAL = np.where(_place[None, :] <= _place[CONTEXT:, None], 0.0, -1e9).astype(np.float32)
_SCALE = np.float32(WIDTH**-0.5)
#: Sums along rows are products with ones: many times as fast as sum().
_ONES = np.ones(max(CLASSES, 2 * CONTEXT), np.float32)

Weights = dict[str, np.ndarray]


def first_weights(ids: int, class_counts: np.ndarray, seed: int = 11) -> Weights:
    """Weights for that many subword ids; the row after them is the start mark's, the last one padding's."""
    rng = np.random.default_rng(seed)
    w = {n: (rng.standard_normal(s) * 0.2).astype(np.float32) for n, s in SMALL.items()}
    w["embed"] = (rng.standard_normal((ids + 2, WIDTH)) * 0.3).astype(np.float32)
    w["out"][-1] = np.log((class_counts + 1) / (class_counts.sum() + CLASSES))
    return w


def layout(tokens: np.ndarray, bounds: np.ndarray, classes: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, place of each token) of documents laid out in blocks of CONTEXT, a block of padding before each.

    An input is the token before; targets are classes, -1 where there is none.
    """
    size = np.diff(bounds)
    blocks = -(-size // CONTEXT) + (size > 0)
    start = (np.cumsum(blocks) - blocks) * CONTEXT
    inputs = np.full(int(blocks.sum()) * CONTEXT, ids + 1, np.int32)
    targets = np.full(len(inputs), -1, np.int16)
    at = np.arange(len(tokens)) + np.repeat(start + CONTEXT - bounds[:-1], size)
    targets[at] = classes[tokens]
    inputs[at[1:]] = tokens[:-1]
    inputs[(start + CONTEXT)[size > 0]] = ids
    return inputs, targets, at


def forward(w: Weights, inputs: np.ndarray):
    """Class logits after each input but the first CONTEXT, their exponentials and sums, and what the backward pass needs.

    The last row of "out" is a bias. Scores and logits stay far from the limits of exp, so nothing is taken off before it.
    """
    n = len(inputs) // CONTEXT - 1
    x = w["embed"].take(inputs, 0, mode="clip")
    q, k, v = np.matmul(x, w["qkv"].reshape(WIDTH, 3, WIDTH).transpose(1, 0, 2))
    # Rows lie one after another, so a window is one run of numbers.
    block = CONTEXT * WIDTH
    q = q[CONTEXT:].reshape(n, block) + w["query_at"].ravel()
    q *= _SCALE
    q = q.reshape(n, CONTEXT, WIDTH)
    keys = (as_strided(k, (n, 2 * block), (block * k.itemsize, k.itemsize)) + w["key_at"].ravel()).reshape(n, 2 * CONTEXT, WIDTH)
    v = as_strided(v, keys.shape, (block * v.itemsize, *v.strides))
    a = np.matmul(q, keys.transpose(0, 2, 1))
    a += _CAUSAL
    padding = inputs == len(w["embed"]) - 1
    if padding.any():
        blank = as_strided(padding, (n, 2 * CONTEXT), (CONTEXT * padding.strides[0], padding.strides[0]))
        some = np.flatnonzero(blank.any(1))
        a[some] += np.where(blank[some], np.float32(-1e9), np.float32(0))[:, None, :]
    np.exp(a, out=a)
    weight = np.float32(1) / np.maximum(a.reshape(-1, 2 * CONTEXT) @ _ONES[: 2 * CONTEXT], np.float32(1e-30))
    mixed = np.matmul(a, v).reshape(-1, WIDTH)
    mixed *= weight.repeat(WIDTH).reshape(-1, WIDTH)
    z = np.empty((n * CONTEXT, 2 * WIDTH + 1), np.float32)
    z[:, :WIDTH] = mixed
    z[:, WIDTH:-1] = x[CONTEXT:]
    z[:, -1] = 1
    logits = z @ w["out"]
    e = np.exp(logits)
    return logits, e, e @ _ONES[:CLASSES], (x, q, keys, v, a, weight, mixed, z)


def score(w: Weights, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of the target class at each place, 0 where there is none."""
    out = np.zeros(len(targets), np.float32)
    for a in range(0, len(inputs) - CONTEXT, BATCH * CONTEXT):
        b = min(len(inputs), a + (BATCH + 1) * CONTEXT)
        logits, _, total, _ = forward(w, inputs[a:b])
        t = targets[a + CONTEXT : b]
        found = logits.ravel().take(np.arange(0, len(t) * CLASSES, CLASSES) + np.maximum(t, 0)) - np.log(total)
        out[a + CONTEXT : b] = np.where(t < 0, 0, found)
    return out


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray]:
    """Gradients of the mean cross entropy: of the small weights, then of embedding rows with their ids."""
    _, d, total, (x, q, keys, v, a, weight, mixed, z) = forward(w, inputs)
    n = len(q)
    t = targets[CONTEXT:]
    use = np.flatnonzero(t >= 0)
    share = np.float32(1 / max(1, len(use)))
    d *= np.where(t >= 0, share / total, np.float32(0))[:, None]
    d.ravel()[use * CLASSES + t[use]] -= share
    g = {"out": z.T @ d}
    dz = d @ w["out"][:-1].T
    # Weights of places are a * weight; the second factor goes to the rows, which are shorter.
    own = dz[:, :WIDTH] * weight[:, None]
    s = np.matmul(own.reshape(n, CONTEXT, WIDTH), v.transpose(0, 2, 1))
    mixed *= own
    s -= (mixed @ _ONES[:WIDTH]).reshape(n, CONTEXT, 1)
    s *= a
    own = own.reshape(n, CONTEXT, WIDTH)
    dq = np.matmul(s, keys)
    dq *= _SCALE
    dk, dv = np.matmul(s.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), own)
    g["query_at"], g["key_at"] = dq.sum(0), dk.sum(0)
    # A row of keys or values is in two windows: the later half of one, the earlier half of the next.
    dh = [np.zeros((n + 1, CONTEXT * WIDTH), np.float32) for _ in range(3)]
    dh[0][1:] = dq.reshape(n, -1)
    for part, both in ((dh[1], dk.reshape(n, -1)), (dh[2], dv.reshape(n, -1))):
        part[1:] = both[:, CONTEXT * WIDTH :]
        part[:-1] += both[:, : CONTEXT * WIDTH]
    dh = np.concatenate([part.reshape(-1, WIDTH) for part in dh], axis=1)
    g["qkv"] = x.T @ dh
    dx = dh @ w["qkv"].T
    dx[CONTEXT:] += dz[:, WIDTH:]
    # Ids with their places sort as whole numbers, which is faster than to sort places by ids.
    ids = np.sort(inputs.astype(np.int64) << 32 | np.arange(len(inputs)))
    order = ids & 0xFFFFFFFF
    ids >>= 32
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return g, ids[first], np.add.reduceat(dx.take(order, 0), first)


class Trainer:
    """Adam steps for the small weights, steps scaled by their own size so far for embedding rows."""

    def __init__(self, w: Weights, rate: float = 0.01):
        self.rate, self.steps = rate, 0
        # The small weights are views of one vector, so that a step is a few operations.
        self.small = np.concatenate([w[n].ravel() for n in SMALL])
        cuts = np.cumsum([0] + [int(np.prod(s)) for s in SMALL.values()])
        self.w = {n: self.small[i:j].reshape(s) for (n, s), i, j in zip(SMALL.items(), cuts[:-1], cuts[1:], strict=True)} | {"embed": w["embed"].copy()}
        self.mean, self.square = (np.zeros(len(self.small), np.float32) for _ in range(2))
        self.rows = np.full(len(w["embed"]), 1e-8, np.float32)

    def step(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        self.steps += 1
        g, ids, rows = gradients(self.w, inputs, targets)
        x = np.concatenate([g[n].ravel() for n in SMALL])
        self.mean = 0.9 * self.mean + 0.1 * x
        self.square = 0.99 * self.square + 0.01 * x * x
        self.small -= self.rate * self.mean / (1 - 0.9**self.steps) / (np.sqrt(self.square / (1 - 0.99**self.steps)) + 1e-8)
        seen = self.rows.take(ids) + (rows * rows) @ _ONES[:WIDTH] / WIDTH
        self.rows[ids] = seen
        self.w["embed"][ids] = self.w["embed"].take(ids, 0) - 5 * self.rate * rows / np.sqrt(seen)[:, None]

    def learn(self, inputs: np.ndarray, targets: np.ndarray) -> int:
        """Steps over all windows in order; returns the number of targets."""
        for a in range(0, len(inputs) - CONTEXT, BATCH * CONTEXT):
            b = min(len(inputs), a + (BATCH + 1) * CONTEXT)
            self.step(inputs[a:b], targets[a:b])
        return int((targets >= 0).sum())
