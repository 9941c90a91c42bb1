"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own embedding and the mean embedding of its hashed character n-grams. A run of more than 24 letters (unspaced
scripts, joined words) enters whole, as overlapping pieces that are inputs of their own. All overlapping windows of a whole text are run; attention pools each window's states into a logit, and the document's score is that of its highest
window. Training takes a bounded sample of labelled rows on the driver and learns from each document's highest window.
Inference runs on the executors, in batches of windows of many documents.

Nulls and texts without words get the score of an empty window. A long text's windows are run in batches, so only its words are held at
once. Without labelled rows of both classes nothing is toxic (score 0). Repeated rows get equal scores, and a labelled id that repeats
counts once; an empty table gives an empty result. The score is a column expression, so other columns and their names don't matter; a
null id is scored as any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm._common import labelled_sample

WORD = re.compile(r"\w+")


#: Characters of the longest word that is one input; longer ones become pieces that share OVERLAP characters, so no n-gram is lost.
LONGEST, OVERLAP = 24, 4


def units(text: str | None) -> list[str]:
    """Words of a text, in lower case. Longer ones than LONGEST are pieces of the word with its ends marked."""
    found = []
    for w in WORD.findall((text or "").lower()):
        if len(w) <= LONGEST:
            found.append(w)
        else:
            marked = f"<{w}>"
            found += [marked[i : i + LONGEST + 2] for i in range(0, len(marked) - OVERLAP, LONGEST + 2 - OVERLAP)]
    return found


def char_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 3 to 5 characters of units with their words' ends marked, a row for each unit; which of them are there."""
    marked = [w if len(w) > LONGEST or w.endswith(">") else f"<{w}>" for w in words]
    codes = np.array(marked, f"U{LONGEST + 2}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])[:, None]
    found, there = [], []
    for n in (3, 4, 5):
        places = codes.shape[1] - n + 1
        total = np.full((len(words), places), n, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x100000001B3) + codes[:, k : k + places]
        found.append(((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets))
        there.append(np.arange(places) + n <= sizes)
    return np.concatenate(found, axis=1).astype(np.int64), np.concatenate(there, axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of the network. Direction 0 reads forwards and direction 1 backwards."""

    def __init__(self, vocabulary: dict[str, int], buckets: int = 1 << 15, word_dim: int = 8, char_dim: int = 8, hidden: int = 8, window: int = 48, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.vocabulary, self.buckets, self.hidden, self.window = vocabulary, buckets, hidden, window
        inputs = word_dim + char_dim
        self.weights = {
            "words": 0.1 * small(len(vocabulary) + 1, word_dim),
            "chars": 0.1 * small(buckets, char_dim),
            "W": small(2, inputs, 3 * hidden),
            "b": np.zeros((2, 1, 3 * hidden), np.float32),
            "U": small(2, hidden, 3 * hidden),
            "A": small(2 * hidden, hidden),
            "a": np.zeros(hidden, np.float32),
            "v": small(hidden, 1)[:, 0],
            "o": small(2 * hidden, 1)[:, 0],
            "c": np.zeros(1, np.float32),
        }
        self.weights["words"][0] = 0  # a word that the vocabulary lacks

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words])

    def embed(self, words: list[str]) -> np.ndarray:
        grams, there = char_grams(words, self.buckets)
        sums = np.einsum("ngd,ng->nd", self.weights["chars"][grams], there.astype(np.float32))
        return np.hstack([self.weights["words"][self.numbers(words)], sums / np.maximum(there.sum(1), 1)[:, None]]).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates, both directions: (n, 2, 3 hidden)."""
        return (np.matmul(x[None], self.weights["W"]) + self.weights["b"]).transpose(1, 0, 2)

    def states(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, length, batch, hidden) for gates (length, batch, 2, 3 hidden); masked steps leave a state as it is."""
        n, batch, h = gates.shape[0], gates.shape[1], self.hidden
        out = np.zeros((2, n, batch, h), np.float32)
        state = np.zeros((2, batch, h), np.float32)
        U_zr, U_n = self.weights["U"][:, :, : 2 * h], self.weights["U"][:, :, 2 * h :]
        for t in range(n):
            at = (t, n - 1 - t)
            x = np.stack([gates[at[0], :, 0], gates[at[1], :, 1]])
            m = np.stack([mask[at[0]], mask[at[1]]])[:, :, None]
            zr = sigmoid(x[:, :, : 2 * h] + state @ U_zr)
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + (r * state) @ U_n)
            before, step = state, m * (1 - z)
            state = before + step * (new - before)
            out[0, at[0]], out[1, at[1]] = state[0], state[1]
            if keep is not None:
                keep.append((before, z, r, new, m))
        return out

    def pool(self, out: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of windows, by attention over their states."""
        w = self.weights
        both = np.concatenate([out[0], out[1]], axis=2)  # (length, batch, 2 hidden)
        u = np.tanh(both @ w["A"] + w["a"])
        e = np.where(mask > 0, u @ w["v"], -30.0)
        e = np.exp(e - e.max(0))
        attention = e / e.sum(0)
        context = (attention[:, :, None] * both).sum(0)
        return context @ w["o"] + w["c"], (both, u, attention, context)

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Loss, logits, gradients of the dense weights and of the inputs x (length, batch, inputs)."""
        w, h, n, batch = self.weights, self.hidden, x.shape[0], x.shape[1]
        keep: list = []
        gates = self.project(x.reshape(n * batch, -1)).reshape(n, batch, 2, 3 * h)
        out = self.states(gates, mask, keep)
        logit, (both, u, attention, context) = self.pool(out, mask)
        p = sigmoid(logit)
        loss = float(-(weight * (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))).mean())
        d = weight * (p - target) / batch
        g = {"o": context.T @ d, "c": d.sum(keepdims=True)}
        d_context = d[:, None] * w["o"]
        d_both = attention[:, :, None] * d_context
        d_attention = (both * d_context).sum(2)
        d_e = attention * (d_attention - (attention * d_attention).sum(0))
        d_u = d_e[:, :, None] * w["v"] * (1 - u * u)
        g["v"] = (d_e[:, :, None] * u).sum((0, 1))
        g["A"] = both.reshape(n * batch, -1).T @ d_u.reshape(n * batch, -1)
        g["a"] = d_u.sum((0, 1))
        d_both = d_both + d_u @ w["A"].T
        d_out = np.stack([d_both[:, :, :h], d_both[:, :, h:]])
        d_gates = np.zeros((n, batch, 2, 3 * h), np.float32)
        g["U"] = np.zeros_like(w["U"])
        U_zr, U_n = w["U"][:, :, : 2 * h], w["U"][:, :, 2 * h :]
        d_state = np.zeros((2, batch, h), np.float32)
        for t in range(n - 1, -1, -1):
            at = (t, n - 1 - t)
            before, z, r, new, m = keep[t]
            d_state = d_state + np.stack([d_out[0, at[0]], d_out[1, at[1]]])
            d_step = m * d_state
            d_new = d_step * (1 - z) * (1 - new * new)
            d_z = d_step * (before - new) * z * (1 - z)
            d_rs = d_new @ U_n.transpose(0, 2, 1)
            d_r = d_rs * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=2)
            g["U"][:, :, : 2 * h] += before.transpose(0, 2, 1) @ d_zr
            g["U"][:, :, 2 * h :] += (r * before).transpose(0, 2, 1) @ d_new
            full = np.concatenate([d_zr, d_new], axis=2)
            d_gates[at[0], :, 0], d_gates[at[1], :, 1] = full[0], full[1]
            d_state = d_state * (1 - m * (1 - z)) + d_rs * r + d_zr @ U_zr.transpose(0, 2, 1)
        flat = d_gates.reshape(n * batch, 2, 3 * h).transpose(1, 0, 2)
        g["W"] = x.reshape(n * batch, -1).T[None] @ flat
        g["b"] = flat.sum(1, keepdims=True)
        d_x = (flat @ w["W"].transpose(0, 2, 1)).sum(0).reshape(n, batch, -1)
        return loss, logit, g, d_x


def window_starts(n: int, window: int) -> range:
    """Starts of windows that overlap by half and reach over all n words."""
    return range(0, max(1, n - window // 2), window // 2)


class Scorer:
    """Runs a network over whole texts. Gates of words are remembered, up to a number of words."""

    def __init__(self, network: Network, words: int = 150_000):
        self.network, self.limit = network, words
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.gates = np.zeros((1024, 2, 3 * self.network.hidden), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            n = len(self.row)
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                while n + len(some) > len(self.gates):
                    self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
                self.gates[n : n + len(some)] = self.network.project(self.network.embed(some))
                self.row.update(zip(some, range(n, n + len(some))))
                n += len(some)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the gates (-1: none) and owners of all windows."""
        size = self.network.window
        found, owners = [], []
        for i, text in enumerate(texts):
            if len(self.row) > self.limit and not found:
                self.reset()
            rows = self.rows(units(text))
            for start in window_starts(len(rows), size):
                part = rows[start : start + size]
                found.append(np.pad(part, (0, size - len(part)), constant_values=-1) if len(part) < size else part)
                owners.append(i)
        return np.array(found), np.array(owners)

    def logits(self, windows: np.ndarray, batch: int = 1024) -> np.ndarray:
        out = np.empty(len(windows), np.float32)
        for i in range(0, len(windows), batch):
            some = windows[i : i + batch].T
            mask = (some >= 0).astype(np.float32)
            out[i : i + batch] = self.network.pool(self.network.states(self.gates[np.maximum(some, 0)], mask), mask)[0]
        return out

    def document_logits(self, texts: list[str | None]) -> np.ndarray:
        """Each text's highest window's logit."""
        best = np.full(len(texts), -np.inf, np.float32)
        some, size = [], 0
        for i, text in enumerate(texts):
            some.append(i)
            size += len(text or "")
            if size > 1 << 19 or i == len(texts) - 1:
                windows, owners = self.windows([texts[k] for k in some])
                np.maximum.at(best, np.array(some)[owners], self.logits(windows))
                some, size = [], 0
        return best


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def fit(texts: list[str | None], toxic: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, vocabulary: int = 20_000, seed: int = 5) -> Network:
    """A network trained on documents: each epoch finds the highest window of every document and learns from those."""
    tokens = [units(t) for t in texts]
    seen = Counter(w for words in tokens for w in set(words))
    words = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:vocabulary]
    network = Network({w: i + 1 for i, w in enumerate(words)}, seed=seed)
    rng, w, size = np.random.default_rng(seed), network.weights, network.window
    adam = Adam(w, rate)
    share = toxic.mean()
    weight_of = np.where(toxic == 1, np.float32(0.5 / share), np.float32(0.5 / (1 - share))).astype(np.float32) ** 0.5
    starts = [list(window_starts(len(t), size)) for t in tokens]
    for epoch in range(epochs):
        if epoch:
            scorer = Scorer(network, words=1 << 30)
            best = []
            for i in range(0, len(texts), 256):
                windows, owners = scorer.windows(texts[i : i + 256])
                logits = scorer.logits(windows)
                for k in range(min(256, len(texts) - i)):
                    own = np.flatnonzero(owners == k)
                    best.append(starts[i + k][int(np.argmax(logits[own]))])
        else:
            best = [s[rng.integers(len(s))] for s in starts]
        order = rng.permutation(len(texts))
        adam.rate = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            parts = [tokens[r][best[r] : best[r] + size] or [""] for r in rows]
            mask = np.array([[1.0 if k < len(p) else 0.0 for p in parts] for k in range(size)], np.float32)
            flat = [p[k] if k < len(p) else "" for k in range(size) for p in parts]
            unique = list(dict.fromkeys(flat))
            place = {x: j for j, x in enumerate(unique)}
            where = np.array([place[x] for x in flat])
            grams, there = char_grams(unique, network.buckets)
            counts = there.sum(1)
            x = network.embed(unique)[where].reshape(size, len(rows), -1)
            _, _, g, d_x = network.gradients(x, mask, toxic[rows].astype(np.float32), weight_of[rows])
            d_unique = np.zeros((len(unique), d_x.shape[2]), np.float32)
            np.add.at(d_unique, where, d_x.reshape(len(where), -1))
            dim = w["words"].shape[1]
            g["words"] = np.zeros_like(w["words"])
            np.add.at(g["words"], network.numbers(unique), d_unique[:, :dim])
            g["words"][0] = 0
            g["chars"] = np.zeros_like(w["chars"])
            np.add.at(g["chars"], grams[there], np.repeat(d_unique[:, dim:] / np.maximum(counts, 1)[:, None], counts, axis=0))
            adam.step(g)
    return network


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 100_000_000, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """A network fitted on the driver on labelled documents outside the held-out fifth, at most max_rows with max_chars characters in all; None without both classes."""
    learned_from = F.when(F.crc32(labels[id_col].cast("string")) % 5 != 0, labels["toxic"])
    rows = labelled_sample(docs, labels, learned_from, max_rows, max_chars, id_col, text_col).toPandas().sort_values([id_col], kind="stable")
    toxic = rows["label"].to_numpy()
    return fit(rows[text_col].tolist(), toxic) if len(set(toxic)) > 1 else None


def toxicity(network: Network | None, docs: DataFrame, text: Column) -> Column:
    """Score from 0 to 1 of a text column of docs."""
    if network is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(sigmoid(scorer.document_logits(texts.tolist())).astype(float))

    return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)(text)
