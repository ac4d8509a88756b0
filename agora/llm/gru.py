"""A bidirectional gated recurrent network over bytes, in numpy.

One step reads ``STRIDE`` bytes, each through a table of its own, and labels each
of these positions, so every byte of a text gets a distribution over the labels.
Both directions run in one loop.  Training is backpropagation through time with
Adam on windows of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRIDE = 4
PAD = 256


@dataclass
class Gru:
    """Parameters; ``table`` is (stride, 257, 2 directions * 3 gates * hidden)."""

    labels: list[str]
    table: np.ndarray
    within: np.ndarray  # (2, hidden, 3 * hidden)
    out: np.ndarray  # (2 * hidden, stride * labels)
    bias: np.ndarray  # (stride * labels,)

    @property
    def hidden(self) -> int:
        return self.within.shape[1]

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.within, self.out, self.bias]


def fresh(labels: list[str], hidden: int, seed: int) -> Gru:
    rng = np.random.default_rng(seed)
    wide = 6 * hidden
    return Gru(
        labels,
        (0.1 * rng.standard_normal((STRIDE, 257, wide))).astype(np.float32),
        (rng.standard_normal((2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        (0.1 * rng.standard_normal((2 * hidden, STRIDE * len(labels)))).astype(np.float32),
        np.zeros(STRIDE * len(labels), dtype=np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _inputs(net: Gru, codes: np.ndarray) -> np.ndarray:
    """(steps, 2, windows, 3 * hidden) of codes (windows, steps, stride); direction 1 is reversed in time."""
    n, steps, _ = codes.shape
    flat = codes.transpose(1, 0, 2)
    total = net.table[0][flat[:, :, 0]]
    for k in range(1, STRIDE):
        total += net.table[k][flat[:, :, k]]
    both = total.reshape(steps, n, 2, -1).transpose(2, 0, 1, 3)
    return np.stack((both[0], both[1][::-1]), axis=1)


def forward(net: Gru, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Label probabilities (windows, steps * stride, labels).

    A step of padding alone leaves the states as they are.
    """
    n, steps, _ = codes.shape
    h = net.hidden
    inputs = _inputs(net, codes)
    real = codes[:, :, 0] != PAD
    full = bool(real.all())
    state = np.zeros((2, n, h), dtype=net.within.dtype)
    states = np.empty((steps, 2, n, h), dtype=net.within.dtype)
    for t in range(steps):
        a, hu = inputs[t], state @ net.within
        gates = _sigmoid(a[..., : 2 * h] + hu[..., : 2 * h])
        z, r = gates[..., :h], gates[..., h:]
        new = np.tanh(a[..., 2 * h :] + r * hu[..., 2 * h :])
        after = new + z * (state - new)
        if not full:
            live = np.stack((real[:, t], real[:, steps - 1 - t]))[..., None]
            after = np.where(live, after, state)
        if keep is not None:
            keep.append((state, hu[..., 2 * h :], z, r, new))
        state = states[t] = after
    joined = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)
    logits = (joined.reshape(steps * n, 2 * h) @ net.out + net.bias).reshape(steps, n, STRIDE, len(net.labels))
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    if keep is not None:
        keep.append(joined)
    return logits.transpose(1, 0, 2, 3).reshape(n, steps * STRIDE, len(net.labels))


def gradients(net: Gru, codes: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss over all real positions, and its gradient for each parameter."""
    n, steps, _ = codes.shape
    h, labels = net.hidden, len(net.labels)
    keep: list = []
    probs = forward(net, codes, keep).reshape(n, steps, STRIDE, labels)
    joined = keep.pop()
    real = codes != PAD
    count = max(1, int(real.sum()))
    right = np.take_along_axis(probs, truth[:, None, None, None] + np.zeros((n, steps, STRIDE, 1), dtype=np.int64), axis=-1)
    loss = float(-(np.log(right[..., 0] + 1e-12) * real).sum() / count)
    d = probs.copy()
    d[np.arange(n), :, :, truth] -= 1
    d *= real[..., None] / count
    d = d.transpose(1, 0, 2, 3).reshape(steps * n, STRIDE * labels)
    d_out = joined.reshape(steps * n, 2 * h).T @ d
    back = (d @ net.out.T).reshape(steps, n, 2 * h)
    towards = np.stack((back[:, :, :h], back[::-1, :, h:]), axis=1)
    d_within = np.zeros_like(net.within)
    d_inputs = np.empty((steps, 2, n, 3 * h), dtype=net.within.dtype)
    carried = np.zeros((2, n, h), dtype=net.within.dtype)
    for t in range(steps - 1, -1, -1):
        before, hn, z, r, new = keep[t]
        carried = carried + towards[t]
        live = np.stack((real[:, t, 0], real[:, steps - 1 - t, 0]))[..., None]
        dh = carried * live
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dhu = np.concatenate((dz, dr, dn * r), axis=-1)
        d_inputs[t] = np.concatenate((dz, dr, dn), axis=-1)
        d_within += before.transpose(0, 2, 1) @ dhu
        carried = carried * ~live + dh * z + dhu @ net.within.transpose(0, 2, 1)
    d_both = np.stack((d_inputs[:, 0], d_inputs[::-1, 1]), axis=2).reshape(steps * n, 6 * h)
    d_table = np.zeros_like(net.table)
    flat = codes.transpose(1, 0, 2).reshape(steps * n, STRIDE)
    for k in range(STRIDE):
        np.add.at(d_table[k], flat[:, k], d_both)
    return loss, [d_table, d_within, d_out, d.sum(axis=0)]


def windows(text: bytes, steps: int) -> np.ndarray:
    """The whole text as codes (windows, steps, stride), the last window padded."""
    data = np.frombuffer(text, dtype=np.uint8)
    size = steps * STRIDE
    count = -(-len(data) // size)
    codes = np.full(count * size, PAD, dtype=np.int16)
    codes[: len(data)] = data
    return codes.reshape(count, steps, STRIDE)


def train(
    texts: list[tuple[bytes, str]], hidden: int = 12, steps: int = 48, batch: int = 96, rounds: int = 300, rate: float = 0.012, seed: int = 11
) -> Gru | None:
    """Fit a network to texts and their labels; None without any.

    Each round takes windows at random places of random texts, each label as often
    as the others.
    """
    texts = [(t, y) for t, y in texts if t]
    labels = sorted({y for _, y in texts})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    net = fresh(labels, hidden, seed)
    of_label = [[t for t, y in texts if y == label] for label in labels]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for k in range(1, rounds + 1):
        truth = rng.integers(len(labels), size=batch)
        codes = np.full((batch, steps, STRIDE), PAD, dtype=np.int16)
        for row, label in enumerate(truth):
            text = of_label[label][rng.integers(len(of_label[label]))]
            at = int(rng.integers(max(1, len(text) - steps * STRIDE // 2)))
            piece = text[at : at + steps * STRIDE]
            codes[row].reshape(-1)[: len(piece)] = np.frombuffer(piece, dtype=np.uint8)
        _, grads = gradients(net, codes, truth)
        size = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - k / (rounds + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (size + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(p.dtype)
    return net


def pooled(net: Gru, texts: list[bytes], steps: int = 96, most: int = 384) -> np.ndarray:
    """The mean label probabilities over all positions of each text; zeros for an empty one."""
    cut = [windows(t, steps) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    total = np.zeros((len(texts), len(net.labels)))
    if not len(owner):
        return total
    codes = np.concatenate(cut)
    used = (codes[:, :, 0] != PAD).sum(axis=1)
    order = np.argsort(used, kind="stable")
    for at in range(0, len(order), most):
        rows = order[at : at + most]
        part = codes[rows, : used[rows[-1]]]
        probs = forward(net, part)
        probs *= (part.reshape(len(rows), -1) != PAD)[..., None]
        np.add.at(total, owner[rows], probs.sum(axis=1, dtype=np.float64))
    return total / np.maximum([[len(t)] for t in texts], 1)
