"""Stupid-backoff scores of documents from n-gram counts over the whole corpus.

A word's score is c(u v w) / c(u v) if the trigram occurs, else BACKOFF times c(v w) / c(v), else BACKOFF^2
times c(w) / N, else BACKOFF^3 / max(N, 1); a document's score is the sum of the logarithms. Counts are those of
all other documents: a document's own occurrences are taken off, else every n-gram would be known.

1. Documents are dealt into buckets by hash, in compressed blocks of texts, and each bucket's distinct n-grams of 0 to 3
   words (the one of no word counts all words) become packets, one for each hash partition: their 64-bit hashes, sorted,
   as differences from the partition's first possible hash on, and how often the bucket has them.
2. A hash partition holds its part of the count tables: packets are joined on the key, counts summed,
   and each packet goes back to its bucket with the sums in the place of its own counts.
3. A bucket's documents, from the same exchange as in 1, meet the returned packets; scores are summed per document.

The count tables are thus rows of many n-grams each, not one row an n-gram, which would take some 10 x the input.

An n-gram is known by its 64-bit hash, however many partitions there are: of n distinct n-grams, n^2 / 2^65 pairs
are expected to share one, 0.1 for 2e9 n-grams. An n-gram costs one entry per bucket however often it occurs, so common ones are no hot keys. Nothing is dropped
or capped: counts of any size are kept. Work and memory of a task are those of a bucket or partition: their number is
spark.sql.shuffle.partitions, or more where a partition would hold the n-grams of over `PART_BYTES` of text. Packets are
at most as many as the buckets' n-grams, so they never are more rows than one an n-gram.

Words are runs of letters, digits and underscores in lower case. Null and empty texts have no words, log_score 0 and mean_log null.
Repeated rows are documents of their own. A null id is kept; ids pass through Python as text, so they keep all their digits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import whole, whole_keys

BACKOFF, CACHE = 0.4, 300_000
#: Buckets of documents for each hash partition; a task holds one at a time.
BUCKETS = 4
#: Bytes of text for each hash partition.
PART_BYTES = 16_000_000
#: Bytes of text that a task deals out at once.
DEAL_BYTES = 64_000_000
DEALT = "key int, ids array<string>, sizes array<int>, block binary"
WORDS = re.compile(r"\w+")
#: High bits of a hash choose the partition, so hashes in order are in order of partitions too.
HIGH = 24
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[1]
    return x ^ (x >> np.uint64(29))


class Grams:
    """The n-grams of a bucket: distinct ones in order of their hashes, and for each word of each document where they are."""

    def __init__(self, texts: list[str], partitions: int):
        if len(_hashes) > CACHE:
            _hashes.clear()
        get = _hashes.__getitem__
        read = [np.fromiter(map(get, words), np.uint64, len(words)) for words in (WORDS.findall(t.lower()) for t in texts)]
        self.sizes = np.array([len(r) for r in read], np.int64)
        one = np.concatenate(read) if read else np.zeros(0, np.uint64)
        self.n = len(one)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        place = np.arange(self.n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        s, t = self.second, self.third
        two = _mixed(one[s - 1] * ODD[0] + one[s] * ODD[1] + np.uint64(2))
        three = _mixed(one[t - 2] * ODD[0] + one[t - 1] * ODD[1] + one[t] * ODD[2] + np.uint64(3))
        every = np.concatenate([np.zeros(1, np.uint64), _mixed(one + np.uint64(1)), two, three])
        self.keys, self.at, self.own = np.unique(every, return_inverse=True, return_counts=True)
        self.own[self.at[0]] = self.n
        self.starts = np.array([-(-(p << HIGH) // partitions) << (64 - HIGH) for p in range(partitions)], np.uint64)
        self.cuts = np.append(np.searchsorted(self.keys, self.starts), len(self.keys))

    def scores(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """counts: of all documents, for the distinct n-grams in order -> per document: words, log-score."""
        docs = len(self.sizes)
        of = np.concatenate([self.doc, self.doc[self.second], self.doc[self.third]])
        # What a document has itself of each of its n-grams.
        _, inverse, own = np.unique(self.at[1:] * np.int64(docs) + of, return_inverse=True, return_counts=True)
        other = counts[self.at[1:]] - own[inverse]
        n, second, third = self.n, self.second, self.third
        one = other[:n]
        two, three = np.zeros(n, np.int64), np.zeros(n, np.int64)
        two[second], three[third] = other[n : n + len(second)], other[n + len(second) :]
        total = np.maximum(counts[self.at[0]] - self.sizes[self.doc], 0)
        out = np.full(n, 3 * np.log(BACKOFF)) - np.log(np.maximum(total, 1))
        some = one > 0
        out[some] = 2 * np.log(BACKOFF) + np.log(one[some] / total[some])
        i = np.flatnonzero(two > 0)
        out[i] = np.log(BACKOFF) + np.log(two[i] / one[i - 1])
        i = np.flatnonzero(three > 0)
        out[i] = np.log(three[i] / two[i - 1])
        return self.sizes, np.bincount(self.doc, out, docs)


def _coded(data: bytes, strategy: int) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, strategy)
    return coder.compress(data) + coder.flush()


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys as differences in as few bytes as the largest takes, byte by byte of all of them; the high bytes in Huffman code."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max((int(steps.max()).bit_length() + 7) // 8, 1) if len(steps) else 1
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(keys).to_bytes(8, "little") + planes[:-1].tobytes() + _coded(planes[-1].tobytes(), zlib.Z_HUFFMAN_ONLY)


def unpack_keys(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    low = (width - 1) * n
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : width - 1] = np.frombuffer(data, np.uint8, low, 9).reshape(width - 1, n).T
    steps[:, width - 1] = np.frombuffer(zlib.decompress(data[9 + low :], -15), np.uint8)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, in Huffman code; 255 for those whose 8 bytes follow at the end."""
    return _coded(np.minimum(counts, 255).astype(np.uint8).tobytes(), zlib.Z_RLE) + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    coder = zlib.decompressobj(-15)
    counts = np.frombuffer(coder.decompress(data), np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(coder.unused_data, "<i8")
    return counts


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, text in bytes) -> one row for each key of some MB: its ids, the texts' sizes, the texts compressed together."""
    held: list[pa.RecordBatch] = []

    def blocks() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        ids, texts, keys = rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(0).to_numpy()
        order = np.argsort(keys, kind="stable")
        coder, out = zstandard.ZstdCompressor(level=3), []
        for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            own = [texts[i] for i in part]
            out.append((int(keys[part[0]]), [ids[i] for i in part], [len(t) for t in own], coder.compress(b"".join(own))))
        kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "ids", "sizes", "block"])

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= DEAL_BYTES:
            yield blocks()
            size = 0
    if held:
        yield blocks()


def _texts(rows: pd.DataFrame) -> list[str]:
    """The texts of a bucket's blocks, in order."""
    out: list[str] = []
    for sizes, block in zip(rows["sizes"], rows["block"], strict=True):
        ends = np.cumsum(sizes)
        data = zstandard.ZstdDecompressor().decompress(block, max_output_size=int(ends[-1]))
        out += [data[e - n : e].decode("utf-8", "replace") for e, n in zip(ends.tolist(), sizes, strict=True)]
    return out


def _packets(partitions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts, ends in whole_keys(batches):
            for lo, hi in zip(starts, ends, strict=True):
                g = Grams(_texts(part.iloc[lo:hi]), partitions)
                rows = [(part["key"].iloc[lo], p, b - a, pack_keys(g.keys[a:b] - g.starts[p]), pack_counts(g.own[a:b])) for p, (a, b) in enumerate(zip(g.cuts, g.cuts[1:], strict=False)) if b > a]
                yield pd.DataFrame(rows, columns=["bucket", "part", "n", "keys", "counts"])

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All packets of some hash partitions -> the same with the sums of their keys."""
    for rows, starts, ends in whole_keys(b.rename(columns={"part": "key"}) for b in batches):
        for lo, hi in zip(starts, ends, strict=True):
            own = rows.iloc[lo:hi]
            keys = np.concatenate([unpack_keys(k) for k in own["keys"]])
            counts = np.concatenate([unpack_counts(c, n) for c, n in zip(own["counts"], own["n"], strict=True)])
            _, at = np.unique(keys, return_inverse=True)
            sums = np.bincount(at, counts).astype(np.int64)[at]
            ends_of = np.cumsum(own["n"].to_numpy())
            yield pd.DataFrame({"bucket": own["bucket"], "part": own["key"], "n": own["n"], "sums": [pack_counts(sums[e - n : e]) for e, n in zip(ends_of, own["n"], strict=True)]})


def scored(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, log_score, mean_log."""
    given = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(given, -(-size // PART_BYTES))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS * partitions)).cast("int")
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("string").alias("id"), whole(F.col("text")).cast("binary").alias("text"))
    dealt = rows.mapInArrow(_dealt, DEALT).repartition(partitions, "key")
    packets = dealt.sortWithinPartitions("key").mapInPandas(_packets(partitions), "bucket int, part int, n long, keys binary, counts binary")
    sums = packets.repartition(partitions, "part").sortWithinPartitions("part").mapInPandas(_summed, "bucket int, part int, n long, sums binary")

    def score(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        g = Grams(_texts(blocks), partitions)
        told = told.sort_values("part")
        counts = np.concatenate([unpack_counts(s, n) for s, n in zip(told["sums"], told["n"], strict=True)])
        words, logs = g.scores(counts)
        ids = [i for some in blocks["ids"] for i in some]
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.DataFrame({"id": pd.Series(ids, dtype=object), "n_words": words, "log_score": logs, "mean_log": pd.Series(logs / words).where(words > 0)})

    both = dealt.groupBy("key").cogroup(sums.repartition(partitions, "bucket").withColumnRenamed("bucket", "key").groupBy("key"))
    told = both.applyInPandas(score, "id string, n_words long, log_score double, mean_log double")
    return told.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "log_score", "mean_log")
