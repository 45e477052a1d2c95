"""A character tagger in numpy: bidirectional LSTM, linear-chain CRF, trained by Adam on labelled windows.

Texts are arrays of character codes, windows of one length; position 0 of the alphabet fills them up.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import ship

ship(__name__)

#: ASCII characters have codes of their own; other letters, digits, blanks and the rest one each.
FILL, LETTER, DIGIT, SPACE, REST = 0, 1, 2, 3, 4
ALPHABET = 5 + 128


class Tagger(NamedTuple):
    """Embedding, per direction input and recurrent weights and bias, output weights and bias, transitions, first tags."""

    emb: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    ob: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def codes(text: str) -> np.ndarray:
    """Codes of a text's characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = (points + 5).astype(np.int64)
    for i in np.flatnonzero(points >= 128):
        c = text[i]
        out[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else REST
    return out


def fresh(tags: int, embed: int = 16, hidden: int = 24, seed: int = 7) -> Tagger:
    rng = np.random.default_rng(seed)
    u = lambda *shape, fan: rng.uniform(-1, 1, shape) / np.sqrt(fan)
    b = np.zeros((2, 4 * hidden))
    b[:, hidden : 2 * hidden] = 1.0  # remember at first
    return Tagger(u(ALPHABET, embed, fan=embed), u(2, embed, 4 * hidden, fan=embed), u(2, hidden, 4 * hidden, fan=hidden), b, u(2 * hidden, tags, fan=2 * hidden), np.zeros(tags),
                  np.zeros((tags, tags)), np.zeros(tags))


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _gates(z, n):
    """Input, forget and output gates and candidate, in place of their sums."""
    z[:, : 3 * n] = _sigmoid(z[:, : 3 * n])
    z[:, 3 * n :] = np.tanh(z[:, 3 * n :])
    return z


def _run(projected: np.ndarray, ids: np.ndarray, wh: np.ndarray, backwards: bool, keep: bool):
    """Hidden states (length, windows, hidden); with `keep` also gates and cells."""
    size, length = ids.shape
    n = wh.shape[0]
    h, c = np.zeros((size, n), wh.dtype), np.zeros((size, n), wh.dtype)
    hs = np.empty((length, size, n), wh.dtype)
    gs, cs = (np.empty((length, size, 4 * n)), np.empty((length, size, n))) if keep else (None, None)
    for t in range(length - 1, -1, -1) if backwards else range(length):
        z = _gates(projected[ids[:, t]] + h @ wh, n)
        c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
        h = z[:, 2 * n : 3 * n] * np.tanh(c)
        hs[t] = h
        if keep:
            gs[t], cs[t] = z, c
    return hs, gs, cs


def unaries(m: Tagger, ids: np.ndarray) -> np.ndarray:
    """Tag scores (length, windows, tags)."""
    sides = [_run(m.emb @ m.wx[d] + m.b[d], ids, m.wh[d], d == 1, False)[0] for d in (0, 1)]
    return np.concatenate(sides, axis=2) @ m.out + m.ob


def viterbi(m: Tagger, scores: np.ndarray) -> np.ndarray:
    """Best tags (windows, length)."""
    length, size, k = scores.shape
    best, back = scores[0] + m.start, np.empty((length, size, k), np.int8)
    for t in range(1, length):
        step = best[:, :, None] + m.trans
        back[t] = step.argmax(axis=1)
        best = step.max(axis=1) + scores[t]
    tags = np.empty((size, length), np.int8)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(size), tags[:, t]]
    return tags


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf(m: Tagger, scores: np.ndarray, tags: np.ndarray):
    """Negative log-likelihood per window, with gradients of scores, transitions and first tags."""
    length, size, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + m.start
    for t in range(1, length):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + m.trans, 1) + scores[t]
    for t in range(length - 2, -1, -1):
        beta[t] = _logsum(m.trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - z[None, :, None])
    d_start = d_scores[0].sum(axis=0)
    d_trans = np.zeros_like(m.trans)
    for t in range(1, length):
        d_trans += np.exp(alpha[t - 1][:, :, None] + m.trans + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(size)
    loss = z - m.start[tags[:, 0]]
    np.add.at(d_start, tags[:, 0], -1.0)
    for t in range(length):
        loss = loss - scores[t, rows, tags[:, t]]
        d_scores[t, rows, tags[:, t]] -= 1.0
        if t:
            loss = loss - m.trans[tags[:, t - 1], tags[:, t]]
            np.add.at(d_trans, (tags[:, t - 1], tags[:, t]), -1.0)
    return loss.sum() / size, d_scores / size, d_trans / size, d_start / size


def _back(ids, wh, hs, gs, cs, d_hs, backwards):
    """Gradients of the gate sums (length, windows, 4 hidden) and of the recurrent weights."""
    length, size, n = hs.shape
    d_z, d_wh = np.empty_like(gs), np.zeros_like(wh)
    d_h, d_c = np.zeros((size, n)), np.zeros((size, n))
    for t in range(length) if backwards else range(length - 1, -1, -1):
        before = t + 1 if backwards else t - 1
        first = not 0 <= before < length
        g = gs[t]
        i, f, o, a = g[:, :n], g[:, n : 2 * n], g[:, 2 * n : 3 * n], g[:, 3 * n :]
        squashed = np.tanh(cs[t])
        d_h = d_h + d_hs[t]
        d_c = d_c + d_h * o * (1 - squashed**2)
        z = d_z[t]
        z[:, :n] = d_c * a * i * (1 - i)
        z[:, n : 2 * n] = 0.0 if first else d_c * cs[before] * f * (1 - f)
        z[:, 2 * n : 3 * n] = d_h * squashed * o * (1 - o)
        z[:, 3 * n :] = d_c * i * (1 - a**2)
        if not first:
            d_wh += hs[before].T @ z
        d_h, d_c = z @ wh.T, d_c * f
    return d_z, d_wh


def gradients(m: Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Tagger]:
    """Loss of labelled windows and its gradient by every parameter."""
    projected = [m.emb @ m.wx[d] + m.b[d] for d in (0, 1)]
    runs = [_run(projected[d], ids, m.wh[d], d == 1, True) for d in (0, 1)]
    hidden = np.concatenate([r[0] for r in runs], axis=2)
    loss, d_scores, d_trans, d_start = _crf(m, hidden @ m.out + m.ob, tags)
    flat = d_scores.reshape(-1, d_scores.shape[2])
    d_out, d_ob = hidden.reshape(-1, hidden.shape[2]).T @ flat, flat.sum(axis=0)
    d_hidden = d_scores @ m.out.T
    n = m.wh.shape[1]
    d_emb, d_wx, d_wh, d_b = np.zeros_like(m.emb), np.zeros_like(m.wx), np.zeros_like(m.wh), np.zeros_like(m.b)
    for d in (0, 1):
        d_z, d_wh[d] = _back(ids, m.wh[d], *runs[d], d_hidden[:, :, d * n : (d + 1) * n], d == 1)
        by_code = np.zeros_like(projected[d])
        np.add.at(by_code, ids.T.ravel(), d_z.reshape(-1, 4 * n))
        d_emb += by_code @ m.wx[d].T
        d_wx[d], d_b[d] = m.emb.T @ by_code, by_code.sum(axis=0)
    return loss, Tagger(d_emb, d_wx, d_wh, d_b, d_out, d_ob, d_trans, d_start)


def train(ids: np.ndarray, tags: np.ndarray, n_tags: int, steps: int = 600, batch: int = 32, rate: float = 0.012, seed: int = 7) -> Tagger:
    """The tagger that a fixed order of batches, `steps` or a few more of them, leads to; weights come as float32."""
    m = fresh(n_tags, seed=seed)
    rng = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in m], [np.zeros_like(p) for p in m], 0
    while step < steps:
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, grad = gradients(m, ids[some], tags[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad))
            step += 1
            pace = rate * max(0.05, 1 - step / steps)
            for p, g, a, b in zip(m, grad, first, second, strict=True):
                g = g * min(1.0, 5.0 / (norm + 1e-12))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Tagger(*(p.astype(np.float32) for p in m))
