"""A gated recurrent language model with a class-factored output softmax, in numpy.

Tokens are codes of a small closed set: `head` codes (frequent words) in classes of `per_class`, then `tail` codes, each a
class of its own. P(code | state) = P(class | state) * P(code | class, state). Documents run side by side in lanes; the
state is carried from window to window and set back where a document begins, so windows bound memory and, in training,
how far gradients go back, but not what a state can have seen.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
BLOCK = 1 << 13  # weights that are updated at once


def sizes(head: int, tail: int, per_class: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights; head is a multiple of per_class."""
    n = head // per_class
    return {
        "x": (head + tail + 1, 3 * hidden),  # input part of the gates by code, the last row for the start of a document
        "u": (hidden, 3 * hidden),
        "bu": (hidden,),
        "c": (hidden, n + tail),
        "bc": (n + tail,),
        "w": (n, hidden, per_class),
        "bw": (n, per_class),
    }


def initial(shapes: dict[str, tuple[int, ...]], seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(s) * 0.1 if len(s) > 1 and k != "bw" else np.zeros(s)).astype(F32) for k, s in shapes.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def views(values: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The weights that lie in one vector."""
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = values[at : at + n].reshape(shapes[k])
        at += n
    return out


def unflat(values: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    return {k: v.astype(F32) for k, v in views(values, shapes).items()}


def lanes(docs: list[np.ndarray], most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, doc) of shape (steps, lanes), -1 beyond the end: documents laid end to end, the longest first; the fullest lane first."""
    total, longest = sum(map(len, docs)), max(map(len, docs), default=0)
    n = max(1, min(most, len(docs), total // max(1, longest) + 8))
    loads, rows = np.zeros(n, np.int64), [[] for _ in range(n)]
    for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        k = int(loads.argmin())
        rows[k].append(i)
        loads[k] += len(docs[i])
    steps = int(loads.max()) if total else 0
    codes, doc = np.full((steps, n), -1, np.int32), np.full((steps, n), -1, np.int32)
    for k, own in enumerate(rows[j] for j in np.argsort(-loads, kind="stable")):
        at = 0
        for i in own:
            codes[at : at + len(docs[i]), k] = docs[i]
            doc[at : at + len(docs[i]), k] = i
            at += len(docs[i])
    return codes, doc


class Model:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["u"].shape[0]
        self.per_class = weights["w"].shape[2]
        self.classes = weights["w"].shape[0]
        self.head = self.classes * self.per_class
        self.start = len(weights["x"]) - 1

    def windows(self, codes: np.ndarray, doc: np.ndarray, size: int):
        """(from, codes, inputs, fresh) of each window, of lanes that have not ended: a code's input is the one before it in its document."""
        before = np.vstack([np.full((1, codes.shape[1]), -1, doc.dtype), doc[:-1]])
        fresh = doc != before
        inputs = np.vstack([np.zeros((1, codes.shape[1]), codes.dtype), codes[:-1]])
        inputs = np.where(fresh | (inputs < 0), self.start, inputs)
        for at in range(0, len(codes), size):
            n = np.count_nonzero(codes[at] >= 0)
            yield at, codes[at : at + size, :n], inputs[at : at + size, :n], fresh[at : at + size, :n]

    def forward(self, inputs, fresh, state, keep: bool = True):
        """States after each step; with keep, all that a window's steps leave, each of shape (steps, lanes, n), gates (steps, 2, lanes, n): states after them, states
        before them, gates z and r, the inner part of the new state, the new state; and by step what holds back the states of other documents."""
        n, (steps, lanes) = self.hidden, inputs.shape
        u = np.ascontiguousarray(self.w["u"].reshape(n, 3, n).transpose(1, 0, 2))
        u[:2] *= -1  # gates are 1 / (1 + exp(-a))
        x = self.w["x"].reshape(-1, n).take(3 * inputs[:, None] + np.arange(3)[:, None], 0)
        bu = self.w["bu"]
        kept = steps if keep else 1
        states, product = np.empty((steps + 1, lanes, n), x.dtype), np.empty((3, lanes, n), x.dtype)
        inner, new, gates = np.empty((kept, lanes, n), x.dtype), np.empty((kept, lanes, n), x.dtype), np.empty((kept, 2, lanes, n), x.dtype)
        states[0] = state[:lanes]
        resets = {t: np.where(fresh[t][:, None], x.dtype.type(0), x.dtype.type(1)) for t in np.flatnonzero(fresh.any(1)).tolist()}
        for t, (part, now) in enumerate(zip(x, states[1:])):
            state = states[t] * resets[t] if t in resets else states[t]
            gate, mid, own = (a[t if keep else 0] for a in (gates, inner, new))
            np.matmul(state, u, product)
            np.subtract(product[:2], part[:2], gate)
            np.exp(gate, gate)
            gate += 1
            np.reciprocal(gate, gate)
            np.add(product[2], bu, mid)
            np.multiply(gate[1], mid, own)
            own += part[2]
            np.tanh(own, own)
            np.subtract(state, own, now)
            now *= gate[0]
            now += own
        if not keep:
            return states[1:]
        before = states[:-1].copy()
        for t, held in resets.items():
            before[t] *= held
        return states[1:], before, gates, inner, new, resets

    def class_of(self, codes):
        return np.where(codes < self.head, codes // self.per_class, codes - self.head + self.classes)

    def by_class(self, own):
        """(order, [(class, from, upto)]): places of the codes of head classes, by class, and where each class's lie among them."""
        order = np.argsort(own.astype(np.int16), kind="stable")  # by radix
        edges = np.searchsorted(own[order], np.arange(self.classes + 1)).tolist()
        return order[: edges[-1]], [(k, lo, hi) for k, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]

    def logits(self, h, codes):
        """(own classes, logits of classes, order, spans, h by class, logits within classes); logits have a column for each code."""
        own = self.class_of(codes)
        outer = self.w["c"].T @ h.T
        outer += self.w["bc"][:, None]
        order, spans = self.by_class(own)
        sorted_h = h[order]
        inner = np.empty((self.per_class, len(order)), h.dtype)
        for k, lo, hi in spans:
            np.matmul(self.w["w"][k].T, sorted_h[lo:hi].T, inner[:, lo:hi])
        inner += np.repeat(self.w["bw"].T[:, [k for k, _, _ in spans]], [hi - lo for _, lo, hi in spans], 1)
        return own, outer, order, spans, sorted_h, inner

    def log_probs(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of codes (n) after states (n, hidden)."""
        own, outer, order, _, _, inner = self.logits(states, codes)
        out = taken(outer, own)[0]
        out[order] += taken(inner, codes[order] % self.per_class)[0]
        return out

    def score(self, docs: list[np.ndarray], size: int = 0) -> np.ndarray:
        """Natural log-probability of each whole document; windows of 4,096 codes, if size does not give their steps."""
        total = np.zeros(len(docs))
        codes, doc = lanes(docs)
        state = np.zeros((codes.shape[1], self.hidden), F32)
        for at, own, inputs, fresh in self.windows(codes, doc, size or -(-4096 // codes.shape[1])):
            states = self.forward(inputs, fresh, state, False)
            state, real = states[-1], own >= 0
            logs = self.log_probs(states[real], own[real])
            total += np.bincount(doc[at : at + len(own), : own.shape[1]][real], logs, len(docs))
        return total

    def gradients(self, inputs, fresh, codes, state, g=None):
        """Truncated backpropagation through one window: gradients of the mean loss (into g, if given), the next state, the loss."""
        w, n = self.w, self.hidden
        states, before, gates, inner, new, resets = self.forward(inputs, fresh, state)
        g = g or {k: np.empty_like(v) for k, v in w.items()}
        real = codes >= 0
        whole = real.all()
        h, code = (states.reshape(-1, n), codes.ravel()) if whole else (states[real], codes[real])
        count = max(1, len(code))
        own, outer, order, spans, sorted_h, within = self.logits(h, code)
        logs, d = taken(outer, own, 1 / count)
        loss = -float(logs.sum())
        np.matmul(h.T, d.T, g["c"])
        d.sum(1, out=g["bc"])
        dh = d.T @ w["c"].T
        logs, d = taken(within, code[order] % self.per_class, 1 / count)
        loss -= float(logs.sum())
        g["w"][:], g["bw"][:] = 0, 0
        sorted_dh = np.empty_like(sorted_h)
        for k, lo, hi in spans:
            np.matmul(sorted_h[lo:hi].T, d[:, lo:hi].T, g["w"][k])
            np.matmul(d[:, lo:hi].T, w["w"][k].T, sorted_dh[lo:hi])
        if spans:
            g["bw"][[k for k, _, _ in spans]] = np.add.reduceat(d, [lo for _, lo, _ in spans], 1).T
        dh[order] += sorted_dh
        # ds: by states after steps; du: by the products with u, which are ds times what follows from the step alone
        ds = dh.reshape(states.shape) if whole else np.zeros_like(states)
        if not whole:
            ds[real] = dh
        z, r = gates[:, 0], gates[:, 1]
        by_new = (1 - z) * (1 - new * new)
        times, du = np.empty((len(inputs), 3, *states.shape[1:]), states.dtype), np.empty((*inputs.shape, 3, n), states.dtype)
        by_z, by_r, by_inner = times[:, 0], times[:, 1], times[:, 2]
        np.subtract(before, new, by_z)
        by_z *= z
        by_z *= 1 - z
        np.multiply(by_new, r, by_inner)
        np.subtract(1, r, by_r)
        by_r *= by_inner
        by_r *= inner
        ut, flat_du, by_gate = np.ascontiguousarray(w["u"].T), du.reshape(*inputs.shape, 3 * n), du.transpose(0, 2, 1, 3)
        back, through = np.zeros_like(states[0]), np.empty_like(states[0])
        for t in range(len(inputs) - 1, -1, -1):
            own = ds[t]
            own += back
            np.multiply(own, times[t], by_gate[t])
            np.matmul(flat_du[t], ut, back)
            np.multiply(own, z[t], through)
            back += through
            if t in resets:
                back *= resets[t]
        np.matmul(before.reshape(-1, n).T, flat_du.reshape(-1, 3 * n), g["u"])
        g["bu"][:] = np.ones(inputs.size, du.dtype) @ du[:, :, 2].reshape(-1, n)
        np.multiply(ds, by_new, du[:, :, 2])  # from here on by the input's part, where r does not come in
        g["x"][:] = 0
        places = inputs.reshape(-1, 1).astype(np.int64) * (3 * n) + np.arange(3 * n)
        np.add.at(g["x"].reshape(-1), places.ravel(), du.ravel())  # quick for one dimension alone
        return g, states[-1], loss / count

    def train(self, docs: list[np.ndarray], size: int = 32, rate: float = 0.01, most: int = 64) -> list[float]:
        """One pass of Adam over documents; returns the loss of each window."""
        codes, doc = lanes(docs, most)
        state = np.zeros((codes.shape[1], self.hidden), F32)
        shapes = {k: v.shape for k, v in self.w.items()}
        w = flat(self.w)
        m, v, grad, step = (np.zeros_like(w) for _ in range(4))
        self.w, g = views(w, shapes), views(grad, shapes)
        blocks = [tuple(x[at : at + BLOCK] for x in (w, m, v, grad, step)) for at in range(0, len(w), BLOCK)]
        losses = []
        for i, (_, own, inputs, fresh) in enumerate(self.windows(codes, doc, size), 1):
            _, state, loss = self.gradients(inputs, fresh, own, state, g)
            scale = 0.1 * min(1.0, 1.0 / (float(np.sqrt(np.vdot(grad, grad))) + 1e-9))
            by = (1 - 0.9**i) / rate
            for w, m, v, x, step in blocks:  # that stay in the cache meanwhile
                x *= F32(scale)
                m *= F32(0.9)
                m += x
                x *= x  # a hundredth of the gradient's square
                v *= F32(0.99)
                v += x
                np.sqrt(v, step)
                step *= F32(by * (1 - 0.99**i) ** -0.5)
                step += F32(by * 1e-8)
                np.divide(m, step, step)
                w -= step
            losses.append(loss)
        return losses


def taken(logits: np.ndarray, own: np.ndarray, share: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probabilities of row own[i] in column i, and share times their losses' gradients by logits, which take their place."""
    at = np.arange(logits.shape[1])
    logits -= logits.max(0, initial=-np.inf)
    out = logits[own, at]
    np.exp(logits, logits)
    sums = logits.sum(0)
    out -= np.log(sums)
    if share:
        logits *= share / sums
        logits[own, at] -= share
    return out, logits
