"""Language identification by interpolated Kneser-Ney character models, one per language.

A model gives the chance of each letter of a word, and of its end, from up to ORDER - 1 letters
before it in the same word. Lower orders use continuation counts, every order is discounted and
interpolated with the next lower one, the lowest with a uniform alphabet. Log-chances and backoff
weights lie in arrays sorted by the hash of the n-gram, one column per language.

A text gets the language of the lowest cross-entropy per letter over the words of the whole text.
Rejection is calibrated on texts the counts have not seen: per language, the mean of the
cross-entropy, its spread between texts and the spread of a single word say how high that of a
text with so many different words may be. A text without letters (null, empty, digits only) is `und`, with score
0, and rejected. Ties go to the language first in alphabetical order.

Learned from a sample: about SAMPLE documents per language (all, if there are fewer), chosen by
the hash of their id, whole texts. Words are counted by Spark; the driver gets distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import alone, fresh, slices, whole

ORDER, SAMPLE, ALPHABET = 5, 1_500, 1_000
#: Of the sample, every CALIBRATE-th document only calibrates; DEVIATIONS above the mean are rejected.
CALIBRATE, DEVIATIONS = 10, 6.0
#: Scores: chances of languages from nats per letter over this many letters.
SHARPNESS = 8.0
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
CACHE = 200_000
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words with an edge before and after each; the place of each in its word; where words start."""
    letters = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    return letters, np.arange(len(letters)) - np.repeat(starts, sizes), starts


def _hashes(letters: np.ndarray) -> list[np.ndarray]:
    """hashes[n][i]: of the n letters up to i."""
    out, grow = [np.zeros(len(letters), np.uint64)], (letters + np.uint64(1)) * MIX
    for n in range(1, ORDER + 1):
        before = np.r_[np.zeros(n - 1, np.uint64), grow][: len(grow)]
        h = (out[-1] ^ before) * STEP
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _lookup(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)


def _model(words: list[str], counts: np.ndarray) -> tuple[list, list]:
    """Per order: (n-gram hashes, log-chances) and (history hashes, log backoff weights) of one language."""
    letters, place, _ = _spell(words)
    weight = np.repeat(counts, np.fromiter(map(len, words), np.int64, len(words)) + 2)
    hashes = _hashes(letters)
    grams: list = [None] * (ORDER + 1)
    for n in range(ORDER, 0, -1):
        at = np.flatnonzero(place >= max(n - 1, 1))  # the edge before a word is given, never predicted
        key, first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        total = np.bincount(inverse, weight[at], len(key))
        first = at[first]
        if n < ORDER:
            wider = grams[n + 1][1]
            extended = np.bincount(np.searchsorted(key, hashes[n][wider]), minlength=len(key)).astype(float)
            total = np.where((place[first] == n - 1) | (extended == 0), total, extended)
        grams[n] = key, first, total
    chances, backoffs = [None], [None]
    lower_key, lower = None, None
    for n in range(1, ORDER + 1):
        key, first, total = grams[n]
        ones, twos = (total == 1).sum(), (total == 2).sum()
        discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5
        history = hashes[n - 1][first - 1] if n > 1 else np.zeros(len(first), np.uint64)
        known, of = np.unique(history, return_inverse=True)
        mass, kinds = np.bincount(of, total), np.bincount(of)
        free = discount * kinds / mass
        below = 1 / ALPHABET if n == 1 else lower[np.searchsorted(lower_key, hashes[n - 1][first])]
        chance = np.maximum(total - discount, 0) / mass[of] + free[of] * below
        chances.append((key, np.log(chance)))
        backoffs.append((known, np.log(free)))
        lower_key, lower = key, chance
    return chances, backoffs


class Models:
    """The models of all languages: per order one sorted hash array, with a column per language."""

    def __init__(self, words: dict[str, tuple[list[str], np.ndarray]]):
        self.langs = sorted(words)
        built = [_model(*words[x]) for x in self.langs]
        side = len(self.langs)
        self.unseen = np.array([b[1][1][1][0] - np.log(ALPHABET) for b in built])
        self.grams, self.back = [None], [None]
        for n in range(1, ORDER + 1):
            for out, which, empty in ((self.grams, 0, np.nan), (self.back, 1, 0.0)):
                keys = np.unique(np.concatenate([b[which][n][0] for b in built]))
                values = np.full((len(keys), side), empty, np.float32)
                for j, b in enumerate(built):
                    values[np.searchsorted(keys, b[which][n][0]), j] = b[which][n][1]
                out.append((keys, values))
        self.limits = np.zeros((side, 3))

    def nbytes(self) -> int:
        return sum(a.nbytes for t in (self.grams, self.back) for pair in t[1:] for a in pair)

    def words(self, words: list[str]) -> np.ndarray:
        """For each word: the log-chance in each language, and the number of letters it is over."""
        letters, place, starts = _spell(words)
        hashes = _hashes(letters)
        at, found = _lookup(self.grams[1][0], hashes[1])
        logs = np.where(found[:, None], self.grams[1][1][at], np.float32(np.nan))
        logs = np.where(np.isnan(logs), self.unseen.astype(np.float32), logs)
        for n in range(2, ORDER + 1):
            i = np.flatnonzero(place >= n - 1)
            at, found = _lookup(self.grams[n][0], hashes[n][i])
            own = np.where(found[:, None], self.grams[n][1][at], np.float32(np.nan))
            at, found = _lookup(self.back[n][0], hashes[n - 1][i - 1])
            less = np.where(found[:, None], self.back[n][1][at], np.float32(0))
            logs[i] = np.where(np.isnan(own), logs[i] + less, own)
        logs[place == 0] = 0
        sums = np.add.reduceat(logs, starts, axis=0) if len(words) else logs
        return np.c_[sums, np.fromiter(map(len, words), np.float32, len(words)) + 1].astype(np.float32)

    def calibrate(self, texts: pd.DataFrame) -> None:
        """texts(lang, text): mean, spread between texts and spread of a word of the cross-entropy."""
        for j, lang in enumerate(self.langs):
            means, spreads = [], []
            for text in texts.loc[texts["lang"] == lang, "text"]:
                if len(words := WORDS.findall(text.lower())) >= 20:
                    told = self.words(words)
                    each = -told[:, j] / told[:, -1]
                    means.append(-told[:, j].sum() / told[:, -1].sum())
                    spreads.append(each.std())
            self.limits[j] = (np.mean(means), np.std(means), np.mean(spreads)) if len(means) >= 5 else (np.inf, 0, 0)


class Reader:
    """Scores whole texts; keeps what it knows of up to CACHE words."""

    def __init__(self, models: Models):
        self.models, self.place, self.rows = models, {}, np.zeros((0, len(models.langs) + 1), np.float32)

    def read(self, texts: list[str]) -> pd.DataFrame:
        return pd.concat([self._read(some) for some in slices(texts)], ignore_index=True)

    def _read(self, texts: list[str]) -> pd.DataFrame:
        split = [WORDS.findall(t.lower()) for t in texts]
        new = list({w for words in split for w in words if w not in self.place})
        if len(self.place) + len(new) > CACHE:
            new = list({w for words in split for w in words})
            self.place, self.rows = {}, self.rows[:0]
        if new:
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *[self.models.words(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]])
        get, limits = self.place.__getitem__, self.models.limits
        langs, scores, rejected = [], [], []
        for words in split:
            if not words:
                langs.append("und"), scores.append(0.0), rejected.append(True)
                continue
            sums = self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=float)
            entropy = -sums[:-1] / sums[-1]
            best = int(np.argmin(entropy))
            mean, between, within = limits[best]
            langs.append(self.models.langs[best])
            scores.append(float(1 / np.exp(SHARPNESS * (entropy[best] - entropy)).sum()))
            rejected.append(bool(entropy[best] > mean + DEVIATIONS * np.sqrt(between**2 + within**2 / len(set(words)))))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Models | None:
    """From labelled(doc_id, text, lang); None where no language can be learned."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(4)), F.lit(1_000_000))
    chosen = labelled.where(draw < F.ceil(share[F.col("lang")] * 1_000_000)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CALIBRATE)))
    words = chosen.where("fold <> 0").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toPandas()
    if not len(counted):
        return None
    models = Models({lang: (part["word"].tolist(), part["n"].to_numpy(float)) for lang, part in counted.groupby("lang")})
    models.calibrate(chosen.where("fold = 0").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text").toPandas())
    return models


RESULT = "lang_pred string, score double, rejected boolean"
#: Bytes of models that may be broadcast; about 60 languages at the default sample.
MODEL_BYTES = 1 << 28


def identified(docs: DataFrame, models: Models | None) -> Column:
    """A struct (lang_pred, score, rejected) for the column text of docs."""
    if models is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if models.nbytes() > MODEL_BYTES:
        raise ValueError(f"the models take {models.nbytes()} bytes; learn from a smaller sample or fewer languages")
    held = docs.sparkSession.sparkContext.broadcast(models)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = alone(held.value, lambda: Reader(held.value))
        for texts in batches:
            yield reader.read(texts.tolist())

    return F.pandas_udf(read, RESULT)(whole(F.col("text")))


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, rejected."""
    rows = docs.select("doc_id", "text")
    return rows.select("doc_id", identified(rows, models).alias("told")).select("doc_id", "told.*")


def accepted(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows of docs, with the columns they have, whose language is not rejected."""
    told = fresh(docs, "told")
    return docs.withColumn(told, identified(docs, models)).where(~F.col(told)["rejected"]).drop(told)
