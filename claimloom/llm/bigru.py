"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words: each has an embedding of its own (if the training sample
holds it often enough) next to the mean embedding of its character trigrams.
Windows of words run through a GRU in both directions; attention weighs the
states; a document scores as its highest window.  Training back-propagates by
hand through the highest window of each sampled document, with Adam.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

WINDOW, STRIDE = 48, 36
H, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 12, 12, 4096
#: Words of more bytes are read in parts, each half of which the next one has too.
PART = 64
STRIP = "\"'.,;:!?()[]{}<>*#$%&|-_=+~/\\"


def normal(chunk: str) -> str:
    return chunk.lower().strip(STRIP)


def chunks(text: str) -> list[str]:
    """What stands between white space; of more than PART bytes, overlapping parts that cover all of it."""
    words = text.split()
    if max(map(len, words), default=0) * 4 <= PART:
        return words
    out = []
    for word in words:
        raw = normal(word).encode("utf-8", "replace") if len(word) * 4 > PART else b""
        if len(raw) <= PART:
            out.append(word)
            continue
        at = 0
        while True:
            end = _boundary(raw, at + PART)
            out.append(raw[at:end].decode())
            if end == len(raw):
                break
            at = _boundary(raw, end - PART // 2)
    return out


def _boundary(raw: bytes, at: int) -> int:
    """The last start of a code point up to ``at``."""
    if at >= len(raw):
        return len(raw)
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of overlapping windows that cover n words; the last one ends at the last word."""
    if n <= size:
        return [0]
    return [*range(0, n - size, stride), n - size]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams (of UTF-8 bytes, with marked ends) of all words, and each word's first."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03\x03" for w in words]
    lengths = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    code = (b[:-2] * 69069 + b[1:-1] * 1327217 + b[2:] * 7919 + 12345) % 1000003 % TRIGRAMS
    ends = np.cumsum(lengths)
    starts = ends - lengths
    keep = np.ones(len(b), dtype=bool)
    keep[ends - 1] = keep[ends - 2] = False
    return code[keep[:-2]], starts - 2 * np.arange(len(raw))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters and vocabulary; ``scorer()`` gives what a worker needs."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        n = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": n(len(vocabulary) + 1, WORD_DIM, k=0.3), "char": n(TRIGRAMS, CHAR_DIM, k=0.3),
            "Wf": n(d, 3 * H, k=d**-0.5), "Wb": n(d, 3 * H, k=d**-0.5), "bf": np.zeros(3 * H, np.float32), "bb": np.zeros(3 * H, np.float32),
            "Uf": n(H, 3 * H, k=H**-0.5), "Ub": n(H, 3 * H, k=H**-0.5),
            "A": n(2 * H, 2 * H, k=(2 * H) ** -0.5), "v": n(2 * H, k=0.5), "c": n(2 * H, k=0.5), "b": np.zeros(1, np.float32) - 1,
        }
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        ids = np.array([self.vocabulary.get(w, 0) for w in words])
        grams, starts = trigrams(words)
        count = np.diff(np.append(starts, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], starts, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1), (ids, grams, count)

    def project(self, words: list[str]) -> np.ndarray:
        """Both directions' input gates of words: (n, 2, 3H), row-major."""
        x, _ = self.inputs(words)
        return np.stack([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)


def run_gru(gates: np.ndarray, mask: np.ndarray | None, U: np.ndarray, backward: bool, keep: bool = False):
    """Hidden states (T, B, H) of one direction over gates (T, B, 3H); with ``keep`` also what the gradient needs."""
    T, B, _ = gates.shape
    h = np.zeros((B, H), np.float32)
    out = np.empty((T, B, H), np.float32)
    store = []
    for t in range(T - 1, -1, -1) if backward else range(T):
        x, u = gates[t], h @ U
        zr = sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            store.append((t, h, z, r, n, u[:, 2 * H :]))
        h = out[t] = new
    return (out, store) if keep else out


def pool(p: dict, states: np.ndarray, mask: np.ndarray | None):
    a = np.tanh(states @ p["A"])
    s = a @ p["v"]
    if mask is not None:
        s = np.where(mask, s, np.float32(-1e9))
    e = np.exp(s - s.max(axis=0))
    w = e / e.sum(axis=0)
    context = np.einsum("tb,tbh->bh", w, states)
    return context @ p["c"] + p["b"][0], (a, w, context)


def forward(p: dict, gates: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Logits of windows, from gates (T, B, 2, 3H)."""
    states = np.concatenate([run_gru(gates[:, :, 0], mask, p["Uf"], False), run_gru(gates[:, :, 1], mask, p["Ub"], True)], axis=2)
    return pool(p, states, mask)[0]


def gradients(model: Model, words: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Loss gradients of windows ``at`` (T, B; positions in ``words``)."""
    p = model.p
    x, (ids, grams, count) = model.inputs(words)
    gates = np.stack([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], axis=1)[at]
    f, kf = run_gru(gates[:, :, 0], mask, p["Uf"], False, True)
    b, kb = run_gru(gates[:, :, 1], mask, p["Ub"], True, True)
    states = np.concatenate([f, b], axis=2)
    logit, (a, w, context) = pool(p, states, mask)
    d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    g = {"c": context.T @ d, "b": np.array([d.sum()], np.float32)}
    dcontext = d[:, None] * p["c"]
    dstates = w[:, :, None] * dcontext
    dw = np.einsum("bh,tbh->tb", dcontext, states)
    ds = w * (dw - (w * dw).sum(axis=0))
    g["v"] = np.einsum("tb,tbh->h", ds, a)
    da = ds[:, :, None] * p["v"] * (1 - a * a)
    g["A"] = np.einsum("tbi,tbj->ij", states, da)
    dstates = dstates + da @ p["A"].T
    dx = np.zeros_like(x)
    for name, store, grad, W, U, k in (("f", kf, dstates[:, :, :H], "Wf", "Uf", 0), ("b", kb, dstates[:, :, H:], "Wb", "Ub", 1)):
        dgates = np.zeros((*at.shape, 3 * H), np.float32)
        dU, dh = np.zeros_like(p[U]), np.zeros((at.shape[1], H), np.float32)
        for t, h, z, r, n, un in reversed(store):
            dh = dh + grad[t]
            live = mask[t][:, None]
            dn = np.where(live, dh * (1 - z), 0) * (1 - n * n)
            dz = np.where(live, dh * (h - n), 0) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            dgates[t] = np.concatenate([dz, dr, dn], axis=1)
            dU += h.T @ du
            dh = np.where(live, dh * z, dh) + du @ p[U].T
        per = np.zeros((len(words), 3 * H), np.float32)
        np.add.at(per, at.ravel(), dgates.reshape(-1, 3 * H))
        g[U], g[W], g["b" + name] = dU, x.T @ per, per.sum(axis=0)
        dx += per @ p[W].T
    gw, gc = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(gw, ids, dx[:, :WORD_DIM])
    gw[0] = 0
    np.add.at(gc, grams, np.repeat(dx[:, WORD_DIM:] / count[:, None], count, axis=0))
    g["word"], g["char"] = gw, gc
    return g


def layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts laid end to end: positions (T, B), mask (T, B), owner (B)."""
    starts, owner, size = [], [], []
    base = 0
    for k, n in enumerate(lengths):
        for s in windows(n):
            starts.append(base + s), owner.append(k), size.append(min(n, WINDOW))
        base += n
    size = np.array(size)
    T = int(size.max()) if len(size) else 0
    t = np.arange(T)[:, None]
    mask = t < size[None, :]
    return np.where(mask, np.array(starts)[None, :] + t, 0), mask, np.array(owner)


def fit(texts: list[str], y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Trains on whole texts; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    split = [[normal(c) for c in chunks(t)] or [""] for t in texts]
    often = Counter(w for s in split for w in set(s))
    model = Model({w: k + 1 for k, w in enumerate(sorted(w for w, c in often.items() if c >= 3))})
    share = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    weight = np.where(y == 1, np.minimum(0.5 / share, 3.0), 1.0).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(split))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            flat: list[str] = []
            number: dict[str, int] = {}
            for k in chosen:
                flat.extend(split[k])
            ids = np.array([number.setdefault(w, len(number)) for w in flat])
            words = list(number)
            pos, mask, owner = layout([len(split[k]) for k in chosen])
            gates = model.project(words)
            logits = forward(model.p, gates[ids[pos]], mask) + rng.standard_normal(len(owner)) * (0.5 if epoch < 2 else 0)
            best = np.lexsort((-logits, owner))
            best = best[np.append(True, owner[best][1:] != owner[best][:-1])]
            g = gradients(model, words, ids[pos[:, best]], mask[:, best], y[chosen[owner[best]]], weight[chosen[owner[best]]])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                model.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class Scorer:
    """Scores whole texts by a fitted model, with input gates cached by word."""

    def __init__(self, model: Model, keep: int = 250_000):
        self.model, self.keep = model, keep
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.gates = np.empty((4096, 2, 3 * H), np.float32)
        self.n = 0

    def _learn(self, chunks: set[str]) -> None:
        by = {c: normal(c) for c in chunks}
        new = sorted({w for w in by.values() if "\0" + w not in self.row})
        if new:
            while self.n + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.empty_like(self.gates)])
            self.gates[self.n : self.n + len(new)] = self.model.project(new)
            for w in new:
                self.row["\0" + w] = self.n
                self.n += 1
        for c, w in by.items():
            self.row[c] = self.row["\0" + w]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Highest window probability of each text; a text without words is one window of the empty word."""
        split = [chunks(t) or [""] for t in texts]
        need = {c for s in split for c in s}
        if len(self.row) + 2 * len(need) > 2 * self.keep:  # bounds memory, not results
            self._reset()
        if new := {c for c in need if c not in self.row}:
            self._learn(new)
        ids = np.fromiter((self.row[c] for s in split for c in s), dtype=np.int64)
        lengths = [len(s) for s in split]
        pos, mask, owner = layout(lengths)
        best = np.full(len(texts), -np.inf)
        short = ~mask.all(axis=0)
        for group, masked in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
            for at in range(0, len(group), 1024):
                some = group[at : at + 1024]
                logits = forward(self.model.p, self.gates[ids[pos[:, some]]], mask[:, some] if masked else None)
                np.maximum.at(best, owner[some], logits)
        return 1 / (1 + np.exp(-best))
