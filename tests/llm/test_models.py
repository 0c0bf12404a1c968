"""Language models and toxicity scores against plain versions."""

import collections
import math

import numpy as np
import pytest

from tallyloom.llm import embedding_dedup, language_id, toxicity


class PlainKneserNey:
    """Interpolated Kneser-Ney over dictionaries of letter tuples, from the counts of whole words."""

    def __init__(self, words, order):
        self.order = order
        raw = collections.Counter()
        for word, count in words.items():
            letters = " " + word + " "
            for i in range(1, len(letters)):
                for n in range(1, min(order, i + 1) + 1):
                    raw[letters[i - n + 1 : i + 1], i == n - 1] += count
        counts = collections.Counter()
        for (gram, _), count in raw.items():
            counts[gram] += count
        starts = {gram for gram, at_start in raw if at_start}
        before = collections.defaultdict(set)
        for gram in counts:
            before[gram[1:]].add(gram[0])
        self.total = {}
        for gram, count in counts.items():
            continued = len(before[gram]) if len(gram) < order else 0
            self.total[gram] = count if gram in starts or not continued else continued
        self.discount, self.mass, self.kinds = {}, collections.Counter(), collections.Counter()
        for n in range(1, order + 1):
            mine = [t for g, t in self.total.items() if len(g) == n]
            ones, twos = mine.count(1), mine.count(2)
            self.discount[n] = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
        for gram, total in self.total.items():
            self.mass[len(gram), gram[:-1]] += total
            self.kinds[len(gram), gram[:-1]] += 1

    def chance(self, history, letter):
        n = len(history) + 1
        below = self.chance(history[1:], letter) if history else 1 / language_id.ALPHABET
        if not self.mass[n, history]:
            return below
        d = self.discount[n]
        return max(self.total.get(history + letter, 0) - d, 0) / self.mass[n, history] + d * self.kinds[n, history] / self.mass[n, history] * below

    def word(self, word):
        letters = " " + word + " "
        return sum(math.log(self.chance(letters[max(0, i - self.order + 1) : i], letters[i])) for i in range(1, len(letters)))


def test_kneser_ney_from_raw_counts():
    rng = np.random.default_rng(3)
    draw = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 9)), p=[0.4, 0.3, 0.15, 0.1, 0.05]))
    words = {draw(): int(rng.integers(1, 6)) for _ in range(200)}
    models = language_id.Models({"x": (list(words), np.array(list(words.values()), float))})
    plain = PlainKneserNey(words, language_id.ORDER)
    asked = [*list(words)[:60], *(draw() for _ in range(60)), "zzz", "a", "bébé", "é" * 30]
    told = models.words(asked)
    for word, (log, letters) in zip(asked, told, strict=True):
        assert letters == len(word) + 1 and log == pytest.approx(plain.word(word), abs=2e-3), word


def test_toxicity_scores_every_window():
    rng = np.random.default_rng(5)
    network = toxicity.Network(3)
    network.curve = np.array([1.5, -0.25])
    vocabulary = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 12)))) for _ in range(80)]
    sizes = [0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 3 * toxicity.WINDOW + 7, 500]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in sizes] + ["12 _ 34", ""]
    got = toxicity.Reader(network).scores(texts)
    for text, score in zip(texts, got, strict=True):
        words = toxicity.WORDS.findall(text.lower())
        if not words:
            assert score == 0
            continue
        first = range(0, max(len(words) - toxicity.WINDOW, 0), toxicity.STRIDE)
        windows = [words[s : s + toxicity.WINDOW] for s in [*first, max(len(words) - toxicity.WINDOW, 0)]]
        assert {i for s in [*first, max(len(words) - toxicity.WINDOW, 0)] for i in range(s, s + toxicity.WINDOW)} >= set(range(len(words)))
        logits = []
        for window in windows:  # each by itself, its words numbered anew
            known = sorted(set(window))
            table = network.gates(toxicity.Inputs(known).vectors(network.p))
            logits.append(float(network.forward(table, np.array([[known.index(w) for w in window]]))[0]))
        assert score == pytest.approx(1 / (1 + math.exp(-(1.5 * max(logits) - 0.25))), abs=1e-4)


def test_recall_by_band_of_cosine(spark):
    """Pairs at given cosines, with the projections and tables of the production plan: recall rises with the cosine."""
    rng = np.random.default_rng(9)
    rows, pairs = [], {}
    for band, (low, high) in enumerate(((0.9305, 0.94), (0.94, 0.96), (0.96, 0.999))):
        for i in range(400):
            a = rng.standard_normal(64)
            a /= np.linalg.norm(a)
            b = rng.standard_normal(64)
            b -= (a @ b) * a
            b /= np.linalg.norm(b)
            cosine = rng.uniform(low, high)
            n = 2 * (band * 400 + i)
            pairs[n] = band
            rows += [(n, [float(x) for x in a], 1), (n + 1, [float(x) for x in cosine * a + math.sqrt(1 - cosine**2) * b], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"] for r in embedding_dedup.near_duplicates(df).where("n_links > 0").collect()}
    recall = [sum(n in found for n, b in pairs.items() if b == band) / 400 for band in range(3)]
    print("recall by band", recall)
    assert recall[0] >= 0.98 and recall[1] >= 0.99 and recall[2] >= 0.995
