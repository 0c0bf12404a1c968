"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a step is a word: a vector of its hash (word input) and the scaled sum of vectors of its runs of
three to five characters, edges included (character input). A forward and a backward gated recurrent layer
read WINDOW words; attention weighs their states into one vector and a logit. A text's windows overlap
(STRIDE words apart, the last one ends with the text) and cover all of it; its logit is the largest one.

Labels belong to texts, not to windows, so training goes in two parts: first each window has its text's label;
then, again and again, toxic texts give only the windows that the network finds toxic (the top one at
least), and clean texts also their worst windows. A logistic curve fitted on texts kept out of training
turns the largest logit into a score from 0 to 1.

Learned from a sample of at most about SAMPLE toxic texts and twice as many others, chosen by the hash of their id, at most
TEXT_WINDOWS windows of each; scoring reads whole texts of any length. A text without words (null, empty, digits only)
has score 0. Where labels are missing or all alike, no network is learned and each score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import alone, fresh, slices, whole

SAMPLE, TEXT_WINDOWS, KEPT_OUT = 1_500, 64, 5
WINDOW, STRIDE = 40, 28
WORD_BUCKETS, WORD_SIZE, RUN_BUCKETS, RUN_SIZE, HIDDEN, ATTENTION = 4_096, 8, 32_768, 12, 8, 8
ROUNDS, STEPS, BATCH, RATE, SEED = 4, 80, 192, 0.01, 11
#: Windows of clean texts that are looked through for the worst ones, each round.
LOOKED_AT = 10_000
THRESHOLD, CACHE = 0.3, 150_000
WORDS = re.compile(r"[^\W\d_]+")
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Inputs:
    """Buckets of words and of their character runs."""

    def __init__(self, words: list[str]):
        self.word = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words), np.int64, len(words))
        letters = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.cumsum(sizes) - sizes
        place = np.arange(len(letters)) - np.repeat(self.starts, sizes)
        grow, h = (letters + np.uint64(1)) * MIX, np.zeros(len(letters), np.uint64)
        self.runs = []
        for n in range(1, 6):
            h = (h ^ np.r_[np.zeros(n - 1, np.uint64), grow][: len(grow)]) * STEP
            h ^= h >> np.uint64(29)
            if n >= 3:
                bucket = (h >> np.uint64(40)).astype(np.int64) % RUN_BUCKETS
                self.runs.append(np.where(place >= n - 1, bucket, RUN_BUCKETS))  # the last row stays zero
        self.scale = (1 / np.sqrt(np.maximum(3 * sizes - 9, 1)))[:, None].astype(np.float32)
        self.sizes = sizes

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        runs = sum(np.add.reduceat(p["run"][r], self.starts, axis=0) for r in self.runs) * self.scale
        return np.concatenate([p["word"][self.word], runs], axis=1)

    def spread(self, grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Adds the gradient of the vectors to that of the tables."""
        for j in range(WORD_SIZE):
            out["word"][:, j] += np.bincount(self.word, grad[:, j], WORD_BUCKETS)
        each = np.repeat(grad[:, WORD_SIZE:] * self.scale, self.sizes, axis=0)
        for r in self.runs:
            for j in range(RUN_SIZE):
                out["run"][:, j] += np.bincount(r, each[:, j], RUN_BUCKETS + 1)
        out["run"][-1] = 0


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        size, h = WORD_SIZE + RUN_SIZE, HIDDEN
        self.p = {"word": draw(WORD_BUCKETS, WORD_SIZE) * 8, "run": draw(RUN_BUCKETS + 1, RUN_SIZE) * 40, "A": draw(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}
        self.p["run"][-1] = 0
        for d in "fb":
            self.p |= {"W" + d: draw(size, 3 * h), "U" + d: draw(h, 3 * h), "B" + d: np.zeros(3 * h, np.float32)}
        self.curve = np.array([1.0, 0.0])

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions; a last row of zeros for the space behind a text."""
        p = self.p
        both = np.concatenate([vectors @ p["Wf"] + p["Bf"], vectors @ p["Wb"] + p["Bb"]], axis=1).astype(np.float32)
        return np.concatenate([both, np.zeros((1, 6 * HIDDEN), np.float32)])

    def _layer(self, gates: np.ndarray, held: np.ndarray, u: np.ndarray, order: range, keep: list | None) -> np.ndarray:
        """gates (time, window, 3 x hidden) -> states (time, window, hidden)."""
        k = HIDDEN
        states = np.zeros((*gates.shape[:2], k), np.float32)
        h = np.zeros((gates.shape[1], k), np.float32)
        for t in order:
            x, hu = gates[t], h @ u
            zr = 1 / (1 + np.exp(-(x[:, : 2 * k] + hu[:, : 2 * k])))
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * k :]))
            h = (n + z * (h - n)) * held[t][:, None]
            states[t] = h
        return states

    def forward(self, table: np.ndarray, places: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """table: gates of words; places (window, time), -1 behind the end -> logits."""
        p, k = self.p, HIDDEN
        x = table[places.T]
        held = (places.T >= 0).astype(np.float32)
        fore, back = ([], []) if keep is not None else (None, None)
        time = places.shape[1]
        states = np.concatenate([self._layer(x[:, :, : 3 * k], held, p["Uf"], range(time), fore), self._layer(x[:, :, 3 * k :], held, p["Ub"], range(time - 1, -1, -1), back)], axis=2)
        told = np.tanh(states @ p["A"] + p["a"])
        weight = np.exp(np.clip(told @ p["v"], -30, 30)) * held
        weight /= weight.sum(axis=0) + 1e-9
        pooled = (states * weight[:, :, None]).sum(axis=0)
        if keep is not None:
            keep |= {"fore": fore, "back": back, "states": states, "told": told, "weight": weight, "pooled": pooled, "held": held}
        return pooled @ p["o"] + p["c"][0]

    def backward(self, keep: dict, error: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
        """error: of the logits; fills grad, returns that of the gates (time, window, 6 x hidden)."""
        p, k = self.p, HIDDEN
        states, told, weight = keep["states"], keep["told"], keep["weight"]
        grad["o"] += keep["pooled"].T @ error
        grad["c"] += error.sum()
        pooled = error[:, None] * p["o"]
        d_states = weight[:, :, None] * pooled
        d_weight = (states * pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["v"] += np.tensordot(d_score, told, 2)
        d_told = d_score[:, :, None] * p["v"] * (1 - told**2)
        grad["A"] += np.tensordot(states, d_told, ([0, 1], [0, 1]))
        grad["a"] += d_told.sum(axis=(0, 1))
        d_states += d_told @ p["A"].T
        out = np.zeros((*states.shape[:2], 6 * k), np.float32)
        for name, trail, lo in (("Uf", keep["fore"], 0), ("Ub", keep["back"], 1)):
            u, back = p[name], np.zeros_like(states[0][:, :k])
            for t, h, z, r, n, hun in reversed(trail):
                dh = (back + d_states[t][:, lo * k : (lo + 1) * k]) * keep["held"][t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                grad[name] += h.T @ du
                back = dh * z + du @ u.T
                out[t][:, 3 * k * lo : 3 * k * (lo + 1)] = np.concatenate([dz, dr, dn], axis=1)
        return out


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, network: Network):
        self.net, self.step = network, 0
        self.m = {n: np.zeros_like(x) for n, x in network.p.items()}
        self.s = {n: np.zeros_like(x) for n, x in network.p.items()}

    def batch(self, windows: list[list[str]], labels: np.ndarray) -> None:
        net, p = self.net, self.net.p
        vocabulary = sorted({w for x in windows for w in x})
        at = {w: i for i, w in enumerate(vocabulary)}
        places = np.full((len(windows), WINDOW), -1)
        for i, x in enumerate(windows):
            places[i, : len(x)] = [at[w] for w in x]
        inputs = Inputs(vocabulary)
        vectors, keep, grad = inputs.vectors(p), {}, {n: np.zeros_like(x) for n, x in p.items()}
        logits = net.forward(net.gates(vectors), places, keep)
        gates = net.backward(keep, ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32), grad)
        flat, of = gates.reshape(-1, 6 * HIDDEN), places.T.ravel()
        on = of >= 0
        words = np.stack([np.bincount(of[on], flat[on, j], len(vocabulary)) for j in range(6 * HIDDEN)], axis=1).astype(np.float32)
        d_vectors = 0
        for d, lo in (("f", 0), ("b", 3 * HIDDEN)):
            mine = words[:, lo : lo + 3 * HIDDEN]
            grad["W" + d] += vectors.T @ mine
            grad["B" + d] += mine.sum(axis=0)
            d_vectors = d_vectors + mine @ p["W" + d].T
        inputs.spread(d_vectors, grad)
        self.step += 1
        for n, x in p.items():
            g = grad[n]
            self.m[n] += 0.1 * (g - self.m[n])
            self.s[n] += 0.01 * (g * g - self.s[n])
            x -= RATE * (self.m[n] / (1 - 0.9**self.step)) / (np.sqrt(self.s[n] / (1 - 0.99**self.step)) + 1e-8) + (1e-4 * RATE) * x


def starts(words: int) -> list[int]:
    """Where the windows of a text of so many words start."""
    return [*range(0, max(words - WINDOW, 0), STRIDE), max(words - WINDOW, 0)]


class Places(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Reader:
    """Scores whole texts; keeps the gates of up to CACHE words."""

    def __init__(self, network: Network):
        self.net, self.place, self.table = network, Places(), np.zeros((1, 6 * HIDDEN), np.float32)

    def logits(self, split: list[list[str]], block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows of all texts, and which text each belongs to."""
        if len(self.place) > CACHE:
            self.place, self.table = Places(), self.table[-1:]
        get = self.place.__getitem__
        read = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
        new = list(islice(self.place, len(self.table) - 1, None))
        if new:  # the last row stays that of no word
            parts = [new[i : i + 20_000] for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table[:-1], *[self.net.gates(Inputs(x).vectors(self.net.p))[:-1] for x in parts], self.table[-1:]])
        table = self.table
        text = np.repeat(np.arange(len(split)), np.array([len(starts(len(w))) if w else 0 for w in split], np.int64))
        span = np.arange(WINDOW)
        out, done, todo, held = np.zeros(len(text), np.float32), 0, [], 0

        def flush() -> None:
            nonlocal done, todo, held
            rows = np.concatenate(todo) if todo else np.zeros((0, WINDOW), np.int64)
            for lo in range(0, len(rows), block):
                part = rows[lo : lo + block]
                out[done : done + len(part)] = self.net.forward(table, part)
                done += len(part)
            todo, held = [], 0

        for ids in read:
            if len(ids):
                if len(ids) <= WINDOW:
                    todo.append(np.r_[ids, np.full(WINDOW - len(ids), -1)][None])
                else:
                    todo.append(ids[np.array(starts(len(ids)))[:, None] + span])
                held += len(todo[-1])
                if held >= 8 * block:
                    flush()
        flush()
        return out, text

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._scores(some) for some in slices(texts)])

    def _scores(self, texts: list[str]) -> np.ndarray:
        logits, of = self.logits([WORDS.findall(t.lower()) for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, of, logits)
        slope, shift = self.net.curve
        return np.where(np.isfinite(best), _sigmoid(slope * np.where(np.isfinite(best), best, 0) + shift), 0.0)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve by damped Newton steps; a small ridge keeps it finite where x parts the labels."""
    mean, spread = x.mean(), x.std() + 1e-9
    at, w = np.stack([(x - mean) / spread, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(at @ w)
        move = np.linalg.solve((at * (p * (1 - p))[:, None]).T @ at + np.diag([0.05, 0.05]), at.T @ (p - y) + 0.05 * w)
        w = w - move / max(1.0, np.abs(move).max())
    slope = max(w[0], 0.05) / spread
    return np.array([slope, w[1] - slope * mean])


def train(texts: list[str], labels: np.ndarray, folds: np.ndarray, seed: int = SEED) -> Network | None:
    """folds: 0 is kept out for the curve."""
    split = [WORDS.findall(t.lower()) for t in texts]
    rng, net = np.random.default_rng(seed), Network(seed)
    windows: list[list[str]] = []
    of: list[int] = []
    for i, words in enumerate(split):
        if words and folds[i]:
            at = starts(len(words))
            for s in at if len(at) <= TEXT_WINDOWS else rng.choice(at, TEXT_WINDOWS, replace=False).tolist():
                windows.append(words[s : s + WINDOW])
                of.append(i)
    of_text = np.array(of, np.int64)
    toxic = labels[of_text] == 1 if len(of_text) else np.zeros(0, bool)
    if not toxic.any() or toxic.all():
        return None
    trainer, bad, good = Trainer(net), np.flatnonzero(toxic), np.flatnonzero(~toxic)
    positives, hard = bad, good
    for round_ in range(ROUNDS):
        if round_:
            seen = np.r_[bad, rng.permutation(good)[:LOOKED_AT]]
            best: dict[int, int] = {}
            logit = np.full(len(windows), -np.inf)
            logit[seen] = Reader(net).logits([windows[i] for i in seen])[0]
            for i in bad:
                if of[i] not in best or logit[i] > logit[best[of[i]]]:
                    best[of[i]] = i
            positives = np.array(sorted({*best.values(), *bad[logit[bad] > 0].tolist()}))
            hard = good[np.argsort(-logit[good], kind="stable")[: max(BATCH, LOOKED_AT // 20)]]
        for _ in range(STEPS):
            third = BATCH // 3
            pick = np.r_[rng.choice(positives, third), rng.choice(good, third), rng.choice(hard, third)]
            trainer.batch([windows[i] for i in pick], toxic[pick].astype(np.float32))
    out = np.flatnonzero(folds == 0)
    if len(set(labels[out].tolist())) == 2:
        logits, which = Reader(net).logits([split[i] for i in out])
        best = np.full(len(out), -np.inf)
        np.maximum.at(best, which, logits)
        some = np.isfinite(best)
        net.curve = _fit_curve(best[some].astype(float), labels[out][some].astype(float))
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """From docs(doc_id, text) and labels(doc_id, toxic), toxic 0 or 1; an id counts once for each label it has."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("id"), "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, 2 * sample / sizes[0]))
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000))
    # About three times `sample` ids at most, so they may be broadcast; texts of others are never moved.
    chosen = F.broadcast(known.where(draw < F.ceil(share * 1_000_000)))
    some = docs.where("text is not null").join(chosen, F.col("doc_id") == F.col("id"))
    got = some.groupBy("id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    folds = np.array([zlib.crc32(str(i).encode()) % KEPT_OUT for i in got["id"]])
    return train(got["text"].tolist(), got["toxic"].to_numpy(int), folds)


def scored(docs: DataFrame, network: Network | None) -> Column:
    """The score of the column text of docs."""
    if network is None:
        return F.lit(0.0)
    held = docs.sparkSession.sparkContext.broadcast(network)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = alone(held.value, lambda: Reader(held.value))
        for texts in batches:
            yield pd.Series(reader.scores(texts.tolist()))

    return F.pandas_udf(read, "double")(whole(F.col("text")))


def judge(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, predicted."""
    rows = docs.select("doc_id", "text")
    told = rows.select("doc_id", scored(rows, network).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with the columns they have, that score below the threshold."""
    score = fresh(docs, "score_of")
    return docs.withColumn(score, scored(docs, network)).where(F.col(score) < threshold).drop(score)
