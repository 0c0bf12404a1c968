"""Ranked lexical search with exact integer scores, by per-term geometric blocking.

A document's score for an item sums, over the item's terms with repeats, w * ((10^9 tf) div (1000 tf + 12 m)), where w is a
term's weight from its document frequency and m grows with the document's length. All counts cover all documents.

1. Items are taken in blocks of bounded size (`ITEMS`, `TERMS`), so that what each task is given is bounded. Texts are
   read once for each block; a document keeps the terms that items ask for, with their counts, and its number of all terms.
2. Counts give the weights, and each document its impacts, one number for each term. Signs of random projections of the
   weighted impacts, in Gray order, are its place in a geometric order. Documents are range-partitioned by place; a
   row number behind the place splits groups of equal documents.
3. A partition is read in segments of bounded size. In a segment each term's posting list is clustered by document
   similarity: spaced members of the list are its representatives, and every document joins the one it is most similar to.
   Each such block stores the coordinatewise maximum of its documents' impacts.
4. An item looks at the blocks of its terms' lists, best bound first. A block's bound is the score of its summary, never less
   than that of any of its documents; it is skipped only if that bound is below the score of the item's last place so far.
   All other blocks' documents get their exact score once.
5. Scores of a small share of the documents (`SEED`) are taken first. Their last place starts all tasks; as it is the score
   of a real document, no document of the result can be below it.

Nothing is dropped: equal scores are never skipped. Null and empty texts have no terms. Each row is a document (or item) of
its own, repeated ids included; ranks are by score, then id, null ids last. Items without a scored document have no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import staged

#: Items and distinct terms of one pass over the documents; an item of more terms comes by itself.
ITEMS, TERMS = 256, 8192
#: Documents of a segment, cells of its tables and aimed documents of a block.
SEGMENT, CELLS, BLOCK = 2048, 2**24, 64
#: One in so many documents gives the scores to start from.
SEED = 32
PLANES = 16
#: Bytes of a text that are looked at together.
SLICE = 1_000_000

#: Every byte that is no part of a term becomes a blank, A-Z become a-z.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in runs of bounded size."""
    clean, at = text.translate(_BYTES), 0
    while at < len(clean):
        end = len(clean) if at + SLICE >= len(clean) else clean.rfind(b" ", at, at + SLICE)
        if end <= at:  # a term, or the blank before it, fills the slice
            end = clean.find(b" ", at + SLICE)
            end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _counting(numbers: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, number of terms, the asked terms' numbers and counts; documents without a term have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sizes, asked, counts = [], [], [], []
            for i, text in enumerate(b.column(1)):
                size, found = 0, Counter()
                for words in terms(text.as_py() or b""):
                    size += len(words)
                    found.update(map(numbers.get, words))
                found.pop(None, None)
                if size:
                    rows.append(i)
                    sizes.append(size)
                    asked.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                    counts.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(asked, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return run


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and where each row starts."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4"), np.cumsum([0, *(len(r) // 4 for r in rows)])


def _frequencies(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's document frequencies by term number, then its number of documents and of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 2, dtype=np.int64)
        for b in batches:
            seen[:size] += np.bincount(_joined(b.column(1))[0], minlength=size)
            seen[size:] += [b.num_rows, sum(b.column(0).to_pylist())]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["term", "seen"])

    return run


def _sketches(numbers: np.ndarray, starts: np.ndarray, weighted: np.ndarray, size: int) -> np.ndarray:
    """Random projections of the documents' weighted impacts, of length one."""
    planes = np.random.default_rng(7).choice(np.array([-1.0, 1.0], dtype=np.float32), (size, PLANES))
    sums = np.zeros((len(starts) - 1, PLANES))
    full = starts[1:] > starts[:-1]
    if full.any():
        sums[full] = np.add.reduceat(planes[numbers] * weighted[:, None], starts[:-1][full])
    return sums / np.maximum(np.sqrt((sums**2).sum(axis=1)), 1e-9)[:, None]


def _placing(weights: np.ndarray, documents: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, terms, impacts, place in the geometric order and a row number, of the documents that have an asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            numbers, starts = _joined(b.column(2))
            counts = _joined(b.column(3))[0].astype(np.int64)
            m = 100 - 25 + (25 * b.column(1).to_numpy() * documents) // length
            impacts = (1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(m, np.diff(starts)))
            signs = _sketches(numbers, starts, impacts * weights[numbers].astype(float), len(weights)) > 0
            gray = (signs << np.arange(PLANES)).sum(axis=1)
            for shift in (8, 4, 2, 1):
                gray = gray ^ (gray >> shift)
            packed = impacts.astype("<i4")
            keep = pa.array(np.flatnonzero(np.diff(starts)))
            columns = [b.column(0), b.column(2), pa.array([packed[s:e].tobytes() for s, e in zip(starts, starts[1:], strict=False)], pa.binary())]
            columns += [pa.array(gray.astype(np.int32)), pa.array(np.arange(row, row + b.num_rows))]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], ["doc_id", "terms", "impacts", "place", "row"])

    return run


class Segment:
    """Documents in memory with each term's posting list in blocks of similar documents and their summaries."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, starts: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        self.ids = ids
        self.asked, local = np.unique(numbers, return_inverse=True)
        self.impacts = np.zeros((len(ids), len(self.asked)), dtype=np.int32)
        owners = np.repeat(np.arange(len(ids)), np.diff(starts))
        self.impacts[owners, local] = impacts
        sketches = _sketches(numbers, starts, impacts * weights[numbers].astype(float), len(weights))
        by_term = np.argsort(local, kind="stable")
        lists = np.searchsorted(local[by_term], np.arange(len(self.asked) + 1))
        members, sizes, summaries, of_term = [], [], [], [0]
        for t in range(len(self.asked)):
            posting = owners[by_term[lists[t] : lists[t + 1]]]
            blocks = -(-len(posting) // BLOCK)
            heads = np.zeros(1, dtype=np.int64)
            if blocks > 1:
                representatives = posting[(np.arange(blocks) * len(posting)) // blocks]
                joins = (sketches[posting] @ sketches[representatives].T).argmax(axis=1)
                order = np.argsort(joins, kind="stable")
                posting, joins = posting[order], joins[order]
                heads = np.flatnonzero(np.r_[True, joins[1:] != joins[:-1]])
            members.append(posting)
            sizes.append(np.diff(np.r_[heads, len(posting)]))
            summaries.append(np.maximum.reduceat(self.impacts[posting], heads, axis=0))
            of_term.append(of_term[-1] + len(heads))
        self.of_term = np.array(of_term)
        self.members, self.ends = np.concatenate(members), np.cumsum(np.concatenate(sizes))
        self.summaries = np.concatenate(summaries)

    def search(self, item_terms: np.ndarray, item_weights: np.ndarray, best: "Best") -> None:
        here = np.isin(item_terms, self.asked)
        if not here.any():
            return
        columns, weights = np.searchsorted(self.asked, item_terms[here]), item_weights[here]
        blocks = np.concatenate([np.arange(self.of_term[c], self.of_term[c + 1]) for c in columns])
        bounds = self.summaries[np.ix_(blocks, columns)].astype(np.int64) @ weights
        order = np.argsort(-bounds, kind="stable")
        seen = np.zeros(len(self.ids), dtype=bool)
        at, step = 0, 8
        while at < len(order) and bounds[order[at]] >= best.least:
            ahead = order[at : at + step]
            chosen = blocks[ahead[bounds[ahead] >= best.least]]
            found = np.concatenate([self.members[self.ends[c - 1] if c else 0 : self.ends[c]] for c in chosen])
            found = np.unique(found[~seen[found]])
            seen[found] = True
            best.add(self.impacts[np.ix_(found, columns)].astype(np.int64) @ weights, self.ids[found])
            at, step = at + step, min(64, step * 2)


class Best:
    """An item's best documents so far; `least` is the score that a document needs to be looked at."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        self.scores, self.ids = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]]
        missing = np.array([i is None for i in self.ids])
        order = np.lexsort((np.array([0 if i is None else i for i in self.ids], dtype=np.int64), missing, -self.scores))[: self.k]
        self.scores, self.ids = self.scores[order], self.ids[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _segments(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[Segment]:
    """Segments of documents that lie next to each other; one that would be too large is halved, down to one document."""

    def cut(ids: list, held: list, given: list) -> Iterator[Segment]:
        numbers = np.frombuffer(b"".join(held), "<i4")
        width = len(np.unique(numbers))
        if len(ids) > 1 and width * max(len(ids), width + len(numbers) // BLOCK) > CELLS:
            half = len(ids) // 2
            yield from cut(ids[:half], held[:half], given[:half])
            yield from cut(ids[half:], held[half:], given[half:])
            return
        starts = np.cumsum([0, *(len(h) // 4 for h in held)])
        own = np.empty(len(ids), dtype=object)
        own[:] = ids
        if len(ids) == 1:  # its terms' lists are all the document itself: one block is enough
            yield Single(own, numbers, starts, np.frombuffer(given[0], "<i4"), weights)
        else:
            yield Segment(own, numbers, starts, np.frombuffer(b"".join(given), "<i4"), weights)

    ids, held, given = [], [], []
    for b in batches:
        ids, held, given = ids + b.column(0).to_pylist(), held + b.column(1).to_pylist(), given + b.column(2).to_pylist()
        while len(ids) >= SEGMENT:
            yield from cut(ids[:SEGMENT], held[:SEGMENT], given[:SEGMENT])
            ids, held, given = ids[SEGMENT:], held[SEGMENT:], given[SEGMENT:]
    if ids:
        yield from cut(ids, held, given)


class Single(Segment):
    """A segment of one document, whose only block is its own summary."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, starts: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        self.ids, self.asked = ids, np.sort(numbers)
        self.impacts = impacts[np.argsort(numbers)][None, :]
        self.summaries, self.members, self.ends = self.impacts, np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def search(self, item_terms: np.ndarray, item_weights: np.ndarray, best: Best) -> None:
        here = np.isin(item_terms, self.asked)
        columns = np.searchsorted(self.asked, item_terms[here])
        best.add(self.summaries[:, columns].astype(np.int64) @ item_weights[here], self.ids)


def _searching(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, least: list[int], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k best documents of each item: item number, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(k, x) for x in least]
        for segment in _segments(batches, weights):
            for (item_terms, counts), best in zip(items, bests, strict=True):
                segment.search(item_terms, counts * weights[item_terms], best)
        for i, best in enumerate(bests):
            if len(best.ids):
                columns = [pa.array(np.full(len(best.ids), i, dtype=np.int32)), pa.array(best.ids.tolist(), pa.int64()), pa.array(best.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list[tuple[Row, Counter]]]:
    """Items with the counts of their terms, in blocks of bounded size."""
    block: list[tuple[Row, Counter]] = []
    known: set[bytes] = set()
    for row in items.toLocalIterator():
        counts: Counter = Counter()
        for words in terms(bytes(row["text"] or b"")):
            counts.update(words)
        if block and (len(block) >= ITEMS or len(known | counts.keys()) > TERMS):
            yield block
            block, known = [], set()
        block.append((row, counts))
        known |= counts.keys()
    if block:
        yield block


def _block(docs: DataFrame, block: list[tuple[Row, Counter]], k: int, schema: str) -> DataFrame:
    spark = docs.sparkSession
    words = sorted(set().union(*(counts for _, counts in block)))
    numbers = {w: i for i, w in enumerate(words)}
    counted = staged(docs.mapInArrow(_counting(numbers), "doc_id bigint, n bigint, terms binary, counts binary"))
    seen = counted.select("n", "terms").mapInArrow(_frequencies(len(words)), "term int, seen bigint").groupBy("term").agg(F.sum("seen").alias("seen"))
    counts = {r["term"]: r["seen"] for r in seen.collect()}  # one row per term of the block, and two
    documents, length = counts.get(len(words), 0), counts.get(len(words) + 1, 0)
    if not documents:
        return spark.createDataFrame([], schema)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(words))], dtype=np.int64)
    placed = counted.mapInArrow(_placing(weights, documents, length), "doc_id bigint, terms binary, impacts binary, place int, row bigint")
    ordered = staged(placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row").drop("place"))
    asked = [(np.array([numbers[w] for w in sorted(c)], dtype=np.int64), np.array([c[w] for w in sorted(c)], dtype=np.int64)) for _, c in block]
    find = lambda rows, least: _ranked(rows.select("doc_id", "terms", "impacts").mapInArrow(_searching(asked, weights, least, k), "item int, doc_id bigint, score bigint"), k)
    first = find(ordered.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(SEED)) == 0), [0] * len(block))
    least = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one row per item of the block
    found = find(ordered, [least.get(i, 0) for i in range(len(block))])
    names = spark.createDataFrame([(i, row["item_id"]) for i, (row, _) in enumerate(block)], f"item int, {schema.split(', ')[0]}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most ITEMS names


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs(doc_id, text) and items(item_id, text) -> item_id, rank, doc_id, score of each item's k best documents."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    result = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(asked):
        result = result.unionByName(_block(texts, block, k, schema))
    return result
