"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded to a vector; gated attention (tanh times sigmoid) weighs the passages;
the weighted sum gives the document's score. Only documents carry labels. The model has a few thousand numbers and is fitted on the
driver from a bounded sample; every whole text is scored in the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import crc_mod, labelled_sample, map_text

PASSAGE, LONG = 64, 1000  # words of a passage, characters of a word
COUNTED = 1 << 18  # bytes of passages whose characters are counted at a time
PER_CLASS, MAX_CHARS = 1500, 20_000  # bounds of the training sample: texts of each class, characters of a text


def _classes() -> np.ndarray:
    kind = np.full(256, 24, np.int64)  # bytes of characters beyond ASCII
    for i, group in enumerate(("etaoin", "shrdlu", "cmfwyp", "vbgkjqxz", "ETAOINSHRDLU", "CMFWYPVBGKJQXZ", "0123456789", " ", "\n\t\r", ".", ",", "!", "?", ":;", "'\"", "()[]{}", "*", "$", "%", "&", "#", "|", "-_=+", "@/<>\\^`~")):
        for c in group:
            kind[ord(c)] = i
    kind[:32][kind[:32] == 24] = 23
    return kind


KIND = _classes()
N_KINDS = 25
N_FEATURES = N_KINDS + 6


WHITE = "\n\t\r\x0b\x0c\x85\u00a0\u2028\u2029\u3000"


def _words(text: str) -> list[str]:
    """The text cut after each white space character but the blank, and at blanks; words beyond LONG characters in parts of so many."""
    for c in WHITE:
        if c in text:
            text = text.replace(c, c + " ")
    words = text.split(" ")
    if len(text) > LONG * len(words) or max(map(len, words)) > LONG:
        words = [w[k : k + LONG] for w in words for k in range(0, max(1, len(w)), LONG)]
    return words


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the index of each text's first passage. An empty text is one empty passage."""
    starts, parts, extra, counts = [], [], [], []
    size = first = 0

    def count():
        nonlocal size, first
        n = np.fromiter(map(len, parts[first:]), np.int64, len(parts) - first)
        kinds = KIND[np.frombuffer(b"".join(parts[first:]), np.uint8)]
        counts.append(np.sqrt(np.bincount(np.repeat(np.arange(len(n)) * N_KINDS, n) + kinds, minlength=len(n) * N_KINDS).reshape(-1, N_KINDS) / np.maximum(n, 1)[:, None]))
        parts[first:] = [b""] * len(n)
        size, first = 0, len(parts)

    for text in texts:
        starts.append(len(parts))
        words = _words(text)
        for at in range(0, len(words), PASSAGE):
            p = words[at : at + PASSAGE]
            n, alone = len(p), len(set(p))
            twice = sum(map(str.__eq__, p, p[1:]))
            parts.append(" ".join(p).encode("utf-8", "replace"))
            size += len(parts[-1])
            extra.append((alone / n, twice / n, min(2.0, len(parts[-1]) / n / 8), float(n == PASSAGE), sum(map(str.isupper, p)) / n, float(at == 0 and n < 12)))
            if size > COUNTED:
                count()
    if len(parts) > first or not counts:
        count()
    return np.hstack([np.concatenate(counts), np.asarray(extra, np.float64).reshape(-1, 6)]), np.asarray(starts, np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionMIL:
    """Gated-attention pooling over encoded passages, with one hidden layer."""

    def __init__(self, features: int = N_FEATURES, hidden: int = 24, attention: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(features, hidden), "b": np.zeros(hidden), "V": g(hidden, attention), "U": g(hidden, attention), "w": g(attention), "c": g(hidden), "c0": np.zeros(1)}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return x, h, t, g, alpha, bag, z, _sigmoid(z @ p["c"] + p["c0"])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, the attention of each text's most attended passage, and that passage's number (the first of equal ones)."""
        if not texts:
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        x, starts = encode(texts)
        *_, alpha, bag, _, y = self.forward(x, starts)
        most = np.maximum.reduceat(alpha, starts)
        at = np.where(alpha == most[bag], np.arange(len(alpha)), len(alpha))
        return y, most, np.minimum.reduceat(at, starts) - starts

    def gradients(self, x, starts, y):
        p = self.p
        x, h, t, g, alpha, bag, z, out = self.forward(x, starts)
        d = (out - y) / len(y)
        dz = d[:, None] * p["c"]
        inner = (dz[bag] * h).sum(1)
        da = alpha * (inner - np.add.reduceat(alpha * inner, starts)[bag])
        dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "c0": d.sum(keepdims=True)}

    def fit(self, rows: list[tuple[str, int]], epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionMIL:
        """Adam on the log loss; both classes weigh the same in a batch. Without rows of both classes the scores stay near 0.5."""
        texts, y = [t for t, _ in rows], np.array([v for _, v in rows], np.float64)
        if len(set(y)) < 2:
            self.p["c"][:] = 0
            self.p["c0"][:] = 1.0 if len(y) and y[0] else 0.0
            return self
        x, starts = encode(texts)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        ends = np.append(starts[1:], len(x))
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        groups = [np.flatnonzero(y == k) for k in (0, 1)]
        for epoch in range(epochs):
            for _ in range(max(1, len(y) // batch)):
                pick = np.concatenate([r.choice(g, batch // 2) for g in groups])
                rows_ = np.concatenate([np.arange(starts[i], ends[i]) for i in pick])
                at = np.concatenate([[0], np.cumsum(ends[pick] - starts[pick])[:-1]])
                step += 1
                for k, g in self.gradients(x[rows_], at, y[pick]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> AttentionMIL:
    """Learns from labels.quality of documents outside the held-out fold (crc32 of the id mod 3 = 1)."""
    return AttentionMIL().fit(labelled_sample(docs, labels, "quality", crc_mod("id", 3) != 1, per_class, max_chars))


def score_quality(docs: DataFrame, model: AttentionMIL, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score: str = "score", attention: str = "attention", passage: str = "passage") -> DataFrame:
    """keep columns, score, the largest attention weight of a passage and that passage's number.

    Null text: as empty, which is one empty passage. Repeated rows each give a row. Names of the new columns must not be among the kept
    ones. One Arrow pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, text_col, lambda texts: list(shared.value.score(texts)), [(score, "double"), (attention, "double"), (passage, "bigint")], list(keep), rows=128)
