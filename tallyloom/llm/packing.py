"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Documents are tokenised once; pieces of at most `capacity` tokens are packed. A superstep takes all
documents and all gaps in order of size, sweeps over both from the smallest size up, and gives each gap the
largest document below it that no gap has taken (the successor match: seen from the documents, the
largest first, each takes the smallest gap that holds it). Of documents of one length, and of gaps of one size,
those of lower rank win. Gaps shrink, and the next superstep follows; when no gap holds any document, as many
sequences as the rest needs at least are opened with the largest ones.

Lengths are whole numbers up to `capacity`, so both sorted lists are kept as runs: (length, how many), at
most `capacity` of them, whatever the number of documents. A sweep works on runs, and what it decides
is a table of runs too: documents of this length with ranks from r to r + n go to sequences s to s + n at this
offset. Ranking the documents and joining them to that table is done by Spark; no document passes the driver.

Null texts count as empty and are packed as the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import alone, slices, staged, whole

CAPACITY, END, CACHE = 4096, 1, 800_000
#: Characters that are encoded at once, about; a longer text by itself.
SLICE = 4_000_000
#: Documents of one length that are ranked in one task, about.
RANKED = 2_000
#: Placings, five numbers each, up to which they are broadcast; 15,830 were seen for 10^7 pieces.
BROADCAST_RUNS = 200_000
#: White space to Python, but not to the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; words between white space are looked up, new ones tokenised together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        #: Ids of words, and of those asked for before the cache turned.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.comma = self.tokenizer.encode(",", add_special_tokens=False).ids[-1]

    def _learn(self, words: list[str]) -> None:
        """Words of letters are tokenised in one text, parted by commas, which the vocabulary's pattern always sets apart."""
        plain, other = [], []
        for w in words:
            (plain if _letters(w) else other).append(w)
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for some, e in zip(groups, self._ids([",".join(g) for g in groups], 20), strict=True):
            ids = np.array(e, "<u4")
            ends = [*(4 * np.flatnonzero(ids == self.comma)).tolist(), 4 * len(ids)]
            if len(ends) != len(some):
                other += some
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                self.known[w] = data[start:end]
                start = end + 4
        for w, e in zip(other, self._ids(other), strict=True):
            self.known[w] = np.array(e, "<u4").tobytes()

    def _ids(self, texts: list[str], at_once: int = 10_000) -> Iterator[list[int]]:
        for i in range(0, len(texts), at_once):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield e.ids

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Of distinct words; what has been asked for since the last two turns of the cache is known."""
        if len(self.known) > CACHE // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        held = list(map(known.get, words))
        new = {w for w, h in zip(words, held, strict=True) if h is None}
        back = new & before.keys()
        known.update((w, before[w]) for w in back)
        new -= back
        # Most new words are letters and one mark; the letters are looked up or learned by themselves.
        marked = {w for w in new if w and w[-1] in ",." and _letters(w[:-1])}
        bare = {w[:-1] for w in marked}
        self._learn([w for w in (new - marked) | bare | {",", "."} if w not in known])
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]
        return [known[w] if h is None else h for w, h in zip(words, held, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The vocabulary's pattern never joins what white space parts, nor does its normaliser; it also cuts letters from marks."""
        return [ids for some in slices(texts, SLICE) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Each distinct word is looked up once, and its ids copied to wherever it stands."""
        low = [_lowered(t) for t in texts]
        if any(c in t for t in low for c in ODD_SPACE):
            split = pa.array([re.split("[ \t\n\r]+", t) for t in low], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(pa.array(low, pa.string()))
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1), ids.buffers()[2]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [data[lo:hi].to_pybytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _lowered(text: str) -> str:
    """In lower case, where that is sure to be what the normaliser does and no special token can come of it: Latin-1 without `<|`."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _letters(word: str) -> bool:
    """Latin letters that stay letters in lower case; of others some become a letter and a mark, which joins a comma behind it."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0370" and word.lower().isalpha()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32; a document's ids are followed by `end`."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = alone(("packing", tokenizer), lambda: Encoder(tokenizer))
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], encoder.encode(b["text"].tolist()), strict=True):
                ids += tail
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # As text an id keeps all its digits beside null ones.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole(F.col("text")).alias("text"))
    cut = rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))


class Supersteps:
    """The runs of documents and gaps, and the placings decided so far."""

    def __init__(self, lengths: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.opened = capacity, 0
        self.left, self.rank = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for length, n in lengths.items():
            self.left[length] = n
        #: size -> runs (first sequence, how many), in order
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        #: (length, first rank, how many, first sequence, offset)
        self.placed: list[tuple[int, int, int, int, int]] = []

    def _place(self, length: int, n: int, sequence: int, size: int) -> tuple[int, int, int]:
        """n documents into n sequences with gaps of this size; returns the new gaps."""
        self.placed.append((length, int(self.rank[length]), n, sequence, self.capacity - size))
        self.rank[length] += n
        self.left[length] -= n
        return size - length, sequence, n

    def _keep(self, gaps: list[tuple[int, int, int]]) -> None:
        for size, sequence, n in gaps:
            if size:
                self.gaps.setdefault(size, []).append((sequence, n))

    def open(self, most: int) -> None:
        """New sequences for the `most` largest documents."""
        for length in np.flatnonzero(self.left)[::-1].tolist():
            n = int(min(self.left[length], most))
            if n:
                self._keep([self._place(length, n, self.opened, self.capacity)])
                self.opened, most = self.opened + n, most - n

    def sweep(self) -> bool:
        """One superstep; whether anything was placed."""
        waiting: list[list[int]] = []  # documents below the sweep that no gap has taken yet, the largest on top
        sizes = sorted({*np.flatnonzero(self.left).tolist(), *self.gaps})
        shrunk: list[tuple[int, int, int]] = []
        for size in sizes:
            if self.left[size]:
                waiting.append([size, int(self.left[size])])
            runs = self.gaps.get(size)
            if not runs or not waiting:
                continue
            kept = []
            for sequence, n in runs:
                while n and waiting:
                    length, free = waiting[-1]
                    take = min(n, free)
                    shrunk.append(self._place(length, take, sequence, size))
                    sequence, n = sequence + take, n - take
                    if take == free:
                        waiting.pop()
                    else:
                        waiting[-1][1] -= take
                if n:
                    kept.append((sequence, n))
            self.gaps[size] = kept
        self.gaps = {s: r for s, r in self.gaps.items() if r}
        self._keep(shrunk)
        return bool(shrunk)

    def run(self) -> list[tuple[int, int, int, int, int]]:
        sizes = np.arange(self.capacity + 1)
        self.open(int(self.left[self.capacity // 2 + 1 :].sum()))  # no two of these share a sequence
        while self.left.any():
            if not self.sweep():
                self.open(max(1, -(-int(self.left @ sizes) // self.capacity)))
        return self.placed


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, capacity, end))
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    placed = pd.DataFrame(Supersteps(lengths, capacity).run(), columns=["length", "first", "n", "sequence", "offset"])
    runs = spark.createDataFrame(placed, "length long, first long, n long, sequence long, offset long")
    if len(placed) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)  # pieces of a length that many have are then not moved to one task
    # Pieces of a length that many have are ranked in shares of some RANKED pieces; one row per length says in how many.
    shares = spark.createDataFrame([(size, n // RANKED + 1) for size, n in lengths.items()], "length long, shares long")
    dealt = cut.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("shares")))
    order = Window.partitionBy("length", "share").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("own", F.row_number().over(order) - 1)
    if max(lengths.values(), default=0) >= RANKED:
        counts = dealt.groupBy("length", "share").count()
        before = counts.select("length", "share", (F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).alias("before"))
        ranked = ranked.join(before, ["length", "share"]).withColumn("own", F.col("own") + F.col("before"))
    fits = (F.col("own") >= F.col("first")) & (F.col("own") < F.col("first") + F.col("n"))
    joined = ranked.join(runs, (ranked["length"] == runs["length"]) & fits)
    return joined.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.col("own") - F.col("first")).alias("sequence_id"), "offset")
