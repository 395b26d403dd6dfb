"""A small causal self-attention model over subwords, in numpy.

One layer: embeddings plus positions, one attention head over a window, a
rectified layer, and a softmax in two steps: over groups of classes, then over
the members of the target's group, so a target costs the root of what one step
over all classes would.  Each input adds a row of its own, ``direct``, to the
logits of either step: what a table of counts says follows it.
"""

from __future__ import annotations

import numpy as np

CONTEXT, STRIDE, WIDTH, HIDDEN = 20, 14, 8, 24
#: Classes in a group; the number of classes is a multiple.
MEMBERS = 8
WINDOWS_AT_ONCE = 512
#: Logits of attention are held within these bounds, so that a row's sum needs no maximum first.
BOUND = 60
SEEN = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
ONES = np.ones(CONTEXT, np.float32)

Params = dict[str, np.ndarray]
#: Logits of the groups, (rows, groups), and of each group's members, (rows, groups, MEMBERS).
Direct = tuple[np.ndarray, np.ndarray]


def shapes(inputs: int, classes: int) -> dict[str, tuple[int, ...]]:
    d, h, g = WIDTH, HIDDEN, classes // MEMBERS
    return {"emb": (inputs, d), "pos": (CONTEXT, d), "wq": (d, d), "wk": (d, d), "wv": (d, d), "w1": (d, h), "b1": (h,), "w2": (h, g), "b2": (g,), "w3": (g, h, MEMBERS), "b3": (g, MEMBERS)}


def start(inputs: int, classes: int, seed: int) -> Params:
    """Random weights, almost none at the output: an untrained model says what the direct rows say."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(size=s) * (0.1 if k in ("emb", "pos") else s[-2] ** -0.5 if len(s) > 1 else 0)).astype(np.float32) for k, s in shapes(inputs, classes).items()}
    p["w2"] *= 0.01
    p["w3"] *= 0.01
    p["b3"][:] = 0
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes(len(p["emb"]), p["b3"].size)])


def unflat(values: np.ndarray, inputs: int, classes: int) -> Params:
    out, at = {}, 0
    for k, s in shapes(inputs, classes).items():
        n = int(np.prod(s))
        out[k] = np.asarray(values[at : at + n], np.float32).reshape(s)
        at += n
    return out


def direct_rows(mass: np.ndarray) -> Direct:
    """From the mass of each class for each row, what the two steps add to their logits."""
    parts = mass.reshape(len(mass), -1, MEMBERS)
    groups = parts.sum(2)
    return np.log(groups / groups.sum(1, keepdims=True)).astype(np.float32), np.log(parts / groups[..., None]).astype(np.float32)


def segments(group: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that brings targets of equal groups together, and (group, first, end) of each."""
    ends = np.cumsum(np.bincount(group, minlength=groups)).tolist()
    return np.argsort(group.astype(np.min_scalar_type(groups)), kind="stable"), [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities down each column, in place of the logits."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def attended(logits: np.ndarray, seen: np.ndarray = SEEN) -> np.ndarray:
    """Shares of attention along the last axis, in place of the logits."""
    np.exp(np.clip(logits, -BOUND, BOUND, out=logits), out=logits)
    logits *= seen
    logits /= (logits.reshape(-1, CONTEXT) @ ONES).reshape(*logits.shape[:-1], 1)
    return logits


def rows(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def projections(p: Params) -> np.ndarray:
    """The weights of queries, keys and values side by side."""
    return np.concatenate([p["wq"] * np.float32(WIDTH**-0.5), p["wk"], p["wv"]], 1)


def attention(p: Params, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """x: (windows, CONTEXT) inputs.  Embeddings; queries, keys and values side by side; shares of attention; and the values they take."""
    e = p["emb"][x]
    e += p["pos"]
    qkv = (rows(e) @ projections(p)).reshape(*x.shape, -1)
    q, k, v = (qkv[..., at : at + WIDTH] for at in (0, WIDTH, 2 * WIDTH))
    a = attended(q @ k.transpose(0, 2, 1))
    return e, qkv, a, a @ v


def forward(p: Params, x: np.ndarray, direct: Direct) -> np.ndarray:
    """Log probabilities of all classes at each position; the slow and plain way."""
    e, _, _, taken = attention(p, x)
    h = np.maximum((taken + e) @ p["w1"] + p["b1"], 0)
    groups, members = h @ p["w2"] + p["b2"] + direct[0][x], np.einsum("nth,ghm->ntgm", h, p["w3"]) + p["b3"] + direct[1][x]
    groups, members = (t - np.log(np.exp(t).sum(-1, keepdims=True)) for t in (groups, members))
    return (groups[..., None] + members).reshape(*x.shape, -1)


def rectified(p: Params, o: np.ndarray) -> np.ndarray:
    """The rectified layer, a column for each row of ``o``, and a last row of ones, which the biases of the next layer meet."""
    h = np.ones((HIDDEN + 1, len(o)), o.dtype)
    np.matmul(p["w1"].T, o.T, out=h[:HIDDEN])
    h[:HIDDEN] += p["b1"][:, None]
    np.maximum(h[:HIDDEN], 0, out=h[:HIDDEN])
    return h


def with_biases(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the two steps of the softmax with their biases as a last row."""
    return np.concatenate([p["w2"], p["b2"][None]]), np.concatenate([p["w3"], p["b3"][:, None]], 1)


def direct_of(direct: Direct, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column for each input: what is added to the logits of the groups, and of the members of its target's group."""
    groups = direct[0].shape[1]
    return np.take(direct[0], row, 0).T, np.ascontiguousarray(np.take(direct[1].reshape(-1, MEMBERS), row * groups + group, 0).T)


def slopes(p: Params, x: np.ndarray, direct: Direct, y: np.ndarray, w: np.ndarray, with_loss: bool = True) -> tuple[float, Params, np.ndarray]:
    """Mean cross-entropy (0 without ``with_loss``) of targets y where w is 1, its gradient but for the embeddings, and that at each input.

    What follows attention has a column for each target, so that maxima and sums go
    along the memory, and targets of equal groups together.
    """
    e, qkv, a, taken = attention(p, x)
    q, k, v = (qkv[..., at : at + WIDTH] for at in (0, WIDTH, 2 * WIDTH))
    order, parts = segments((y // MEMBERS).ravel(), len(p["b2"]))
    y, share = y.ravel()[order], (w / max(1.0, float(w.sum()))).ravel()[order]
    group, member, each = y // MEMBERS, y % MEMBERS, np.arange(len(y))
    o = rows(taken + e)[order]
    h, (w2, w3) = rectified(p, o), with_biases(p)
    groups, members = direct_of(direct, x.ravel()[order], group)
    g2, below = w2.T @ h, np.empty(members.shape, h.dtype)
    g2 += groups
    for g, s, t in parts:
        np.matmul(w3[g].T, h[:, s:t], out=below[:, s:t])
    below += members
    loss = 0.0
    for at, target in ((g2, group), (below, member)):
        softmax(at)
        seat = target * np.int64(len(y)) + each
        if with_loss:
            loss -= float(np.log(at.ravel()[seat] + 1e-20) @ share)
        at.ravel()[seat] -= 1
        at *= share
    own, many = h @ g2.T, np.zeros_like(w3)
    gh = np.empty_like(h[:HIDDEN])
    for g, s, t in parts:
        many[g] = h[:, s:t] @ below[:, s:t].T
        np.matmul(p["w3"][g], below[:, s:t], out=gh[:, s:t])
    gh += p["w2"] @ g2
    gh *= h[:HIDDEN] > 0
    out = {"w1": o.T @ gh.T, "b1": gh.sum(1), "w2": own[:-1], "b2": own[-1], "w3": many[:, :-1], "b3": many[:, -1]}
    go = np.empty_like(e)
    rows(go)[order] = (p["w1"] @ gh).T
    gs = go @ v.transpose(0, 2, 1)
    # The sum of a row's slopes by its shares is that of what it took.
    gs -= np.einsum("nti,nti->nt", go, taken)[..., None]
    gs *= a
    back = np.concatenate([gs @ k, gs.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ go], -1)
    to = rows(e).T @ rows(back)
    out |= {"wq": to[:, :WIDTH] * np.float32(WIDTH**-0.5), "wk": to[:, WIDTH : 2 * WIDTH], "wv": to[:, 2 * WIDTH :]}
    ge = rows(back) @ projections(p).T
    ge += rows(go)
    return loss, out | {"pos": ge.reshape(e.shape).sum(0)}, ge


def gradient(p: Params, x: np.ndarray, direct: Direct, y: np.ndarray, w: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy of targets y where w is 1, and its gradient."""
    loss, out, at_inputs = slopes(p, x, direct, y, w)
    emb = np.zeros_like(p["emb"])
    np.add.at(emb, x.ravel(), at_inputs)
    return loss, out | {"emb": emb}


def windows(sequence_starts: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """First input position of every window, and its sequence.  A sequence of n inputs has windows at 0, ``stride``, ... until its end is covered."""
    many = 1 + np.maximum(0, -(-(lengths - CONTEXT) // stride))
    owner = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return sequence_starts[owner] + k * stride, owner


def train(p: Params, direct: Direct, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, rate: float, batch: int = 256) -> Params:
    """One pass of Adam over windows, in the order given.

    A step moves the embeddings of its own inputs only, so its cost doesn't depend on how many inputs there are.
    """
    names = [k for k in p if k != "emb"]
    sizes = np.cumsum([p[k].size for k in names])
    # All but the embeddings lie in one vector, which a step moves at once.
    rest = np.concatenate([p[k].ravel() for k in names])
    p = {"emb": p["emb"].copy()} | {k: part.reshape(p[k].shape) for k, part in zip(names, np.split(rest, sizes[:-1]), strict=True)}
    m, s = np.zeros_like(rest), np.zeros_like(rest)
    m_emb, s_emb = np.zeros_like(p["emb"]), np.zeros_like(p["emb"])
    seen, seats = np.zeros(len(p["emb"]), bool), np.zeros(len(p["emb"]), np.int64)

    def moved(g: np.ndarray, m: np.ndarray, s: np.ndarray, t: int) -> np.ndarray:
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        return np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s / np.float32(1 - 0.99**t)) + np.float32(1e-8))

    for t, at in enumerate(range(0, len(inputs), batch), 1):
        x = inputs[at : at + batch].astype(np.int64)
        _, g, at_inputs = slopes(p, x, direct, targets[at : at + batch], mask[at : at + batch], with_loss=False)
        rest -= moved(np.concatenate([g[k].ravel() for k in names]), m, s, t)
        seen[x] = True
        own = np.flatnonzero(seen)
        seen[own], seats[own] = False, np.arange(len(own))
        seat = seats[x.ravel()]
        g = np.stack([np.bincount(seat, column, len(own)) for column in at_inputs.T], 1).astype(at_inputs.dtype)
        m_own, s_own = m_emb[own], s_emb[own]
        p["emb"][own] -= moved(g, m_own, s_own, t)
        m_emb[own], s_emb[own] = m_own, s_own
    return p


class Scorer:
    """Log probabilities of the inputs' successors.  Products of embeddings with weights are made once."""

    def __init__(self, p: Params, direct: Direct):
        self.p, self.direct = p, direct
        self.w1 = np.concatenate([p["w1"], p["b1"][None]]).T.copy()
        w2, w3 = with_biases(p)
        self.w2, self.w3 = w2.T.copy(), w3.transpose(0, 2, 1).copy()
        # Queries, keys, values and a one beside them, embeddings and a zero beside them.
        spot = np.zeros((WIDTH, 1), np.float32)
        weights = np.concatenate([projections(p), spot, np.eye(WIDTH, dtype=np.float32), spot], 1)
        self.table, self.place = p["emb"] @ weights, p["pos"] @ weights
        self.place[:, 3 * WIDTH] = 1

    def picked(self, logits: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(y) of each column."""
        logits -= logits.max(0)
        out = logits[y, np.arange(len(y))]
        return out - np.log(np.exp(logits, out=logits).sum(0))

    def block(self, x: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
        """log P(y) for the window positions from ``first`` on; y has these positions only."""
        t = np.take(self.table, x, 0)
        t += self.place
        d = WIDTH
        a = t[:, first:, :d] @ t[:, :, d : 2 * d].transpose(0, 2, 1)
        np.exp(np.clip(a, -BOUND, BOUND, out=a), out=a)
        a *= SEEN[first:]
        # The ones sum the shares, and are ones again for the biases of the next layer.
        o = a @ t[:, :, 2 * d : 3 * d + 1]
        o /= o[..., d:].copy()
        o += t[:, first:, 3 * d + 1 :]
        order, parts = segments((y // MEMBERS).ravel(), len(self.p["b2"]))
        target = y.ravel()[order]
        h = np.ones((HIDDEN + 1, len(target)), np.float32)
        np.maximum(self.w1 @ np.take(rows(o), order, 0).T, 0, out=h[:HIDDEN])
        groups, members = direct_of(self.direct, x[:, first:].ravel()[order], target // MEMBERS)
        below = np.empty_like(members)
        for g, s, e in parts:
            np.matmul(self.w3[g], h[:, s:e], out=below[:, s:e])
        below += members
        logits = self.w2 @ h
        logits += groups
        out = np.empty(len(target), np.float32)
        out[order] = self.picked(logits, target // MEMBERS) + self.picked(below, target % MEMBERS)
        return out.reshape(y.shape)

    def totals(self, sequence: np.ndarray, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each sequence (at starts, with ``lengths`` inputs and one more target) the sum of its targets' log probabilities.

        ``sequence`` has inputs, ``classes`` what they are as targets.

        A sequence's first window scores all its positions, later ones the last
        STRIDE, so each target is scored once.
        """
        out = np.zeros(len(starts))
        sequence, classes = (np.concatenate([a, np.zeros(CONTEXT + 1, a.dtype)]) for a in (sequence.astype(np.int64), classes))
        at, owner = windows(starts, lengths)
        for lead in (True, False):
            pick = np.flatnonzero((at == starts[owner]) == lead)
            first = 0 if lead else CONTEXT - STRIDE
            for b in range(0, len(pick), WINDOWS_AT_ONCE):
                w = pick[b : b + WINDOWS_AT_ONCE]
                place = at[w, None] + np.arange(CONTEXT)
                inside = place[:, first:] < (starts + lengths)[owner[w]][:, None]
                scores = self.block(sequence[place], classes[place[:, first:] + 1], first)
                out += np.bincount(owner[w], np.where(inside, scores, 0).sum(1, dtype=float), minlength=len(out))
        return out
