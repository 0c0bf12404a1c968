"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprints: majority bits of the XXH64 of all word shingles (`fingerprints`).
2. Equal fingerprints become one, named by the smallest document.
3. Candidates: two fingerprints that differ in at most BITS bits are equal in at least one of
   BITS + 1 blocks of bits, so each goes to one group per block. Groups of one are dropped
   before any Python runs. A group of more than GROUP fingerprints is dealt anew, without loss:
   two that differ in at most 2 bits become equal to a common third one by turning at most one
   bit of each, so each goes to the 65 groups of what it is one turned bit away from, and those
   hold 65 at most.
4. In a group the fingerprints are sorted by Gray rank and stacked into a tree: a node keeps the
   mask of bits that all below share, and their pattern; what a parent shares is factored out of
   its children. A search adds up differing bits from the root and drops a node with all it holds
   once they exceed BITS (`GrayIndex`). Links are kept as a spanning forest: as many rows as
   fingerprints at most, with the same components.
5. Connected components of the forests.

Null texts count as empty; a text without words has fingerprint zero, which links like any
other. Rows with a null id get a fingerprint and component_id null. Repeated ids keep one row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh, staged, whole, whole_keys
from tallyloom.llm.components import components

WORDS, SHINGLE, BITS, SEED = re.compile(r"[^\x20\x09-\x0D]+"), 3, 2, 42
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: Fingerprints in a group before it is dealt anew, and children of a node of the index.
GROUP, FAN = 2_000, 16
#: Hashes taken into the bit counts at a time.
BLOCK = 1 << 15


def simhash(text: str) -> int:
    """The fingerprint as an unsigned number."""
    words = WORDS.findall(text.translate(UPPER_TO_LOWER))
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(" ".join(r).encode("utf-8", "surrogatepass"), SEED) for r in runs), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprint_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As signed longs."""
    for batch in texts:
        yield pd.Series(np.array([simhash(t) for t in batch], np.uint64).view(np.int64))


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (mask, pattern) nodes over codes in Gray order; level 0 holds the codes themselves."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")].astype(np.uint64)
        self.fan, full = fan, np.uint64(2**64 - 1)
        mask, bits = np.full(len(self.codes), full), self.codes
        levels = [(mask, bits)]
        while len(bits) > fan:
            starts = np.arange(0, len(bits), fan)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(np.bitwise_or.reduceat(bits & mask, starts) ^ np.bitwise_and.reduceat(bits | ~mask, starts))
            levels.append((shared, bits[starts] & shared))
            mask, bits = shared, bits[starts] & shared
        # What a parent shares is compared there once; a child keeps the rest of its mask.
        self.levels = [(m & ~np.repeat(up[0], fan)[: len(m)], b) for (m, b), up in zip(levels, levels[1:], strict=False)] + levels[-1:]

    def pairs(self, most: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i < j in Gray order of codes that differ in at most `most` bits, in pieces."""
        for lo in range(0, len(self.codes), block):
            ask = self.codes[lo : lo + block]
            top = len(self.levels[-1][0])
            who, node = np.repeat(np.arange(len(ask)), top), np.tile(np.arange(top), len(ask))
            gone = np.zeros(len(who), np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                mask, bits = self.levels[level]
                if level < len(self.levels) - 1:
                    who, gone = np.repeat(who, self.fan), np.repeat(gone, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    held = node < len(mask)
                    who, node, gone = who[held], node[held], gone[held]
                gone = gone + np.bitwise_count((ask[who] ^ bits[node]) & mask[node])
                near = gone <= most
                if level == 0:
                    near &= node > who + lo
                who, node, gone = who[near], node[near], gone[near]
            yield who + lo, node


def _roots(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    root = list(range(size))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    return np.array([top(i) for i in range(size)])


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, fp, id) with the rows of a key together -> edges (a, b) of ids."""

    for part, starts, ends in whole_keys(batches):
        out_a, out_b = [], []
        codes, ids = part["fp"].to_numpy(np.int64).view(np.uint64), part["id"].to_numpy()
        two = starts[ends - starts == 2]  # by far the most groups; compared all at once
        near = np.bitwise_count(codes[two] ^ codes[two + 1]) <= BITS
        out_a.append(ids[two[near]]), out_b.append(ids[two[near] + 1])
        more = ends - starts > 2
        for lo, hi in zip(starts[more], ends[more], strict=True):
            index, named = GrayIndex(codes[lo:hi]), ids[lo:hi][np.argsort(gray_rank(codes[lo:hi]), kind="stable")]
            root = _roots(hi - lo, index.pairs(BITS))
            hung = root != np.arange(hi - lo)
            out_a.append(named[hung]), out_b.append(named[root[hung]])
        yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _blocks(fp: Column) -> list[Column]:
    """The bits of each of BITS + 1 blocks, marked with the block."""
    cuts = [64 * i // (BITS + 1) for i in range(BITS + 2)]
    return [F.struct(F.lit(i).alias("block"), fp.bitwiseAND(F.lit(_signed(((1 << hi) - 1) ^ ((1 << lo) - 1)))).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(codes: DataFrame, group: int = GROUP) -> DataFrame:
    """codes(fp, id), fp distinct -> edges (a, b) of ids whose components are those of all pairs within BITS bits."""
    keyed = codes.select("fp", "id", F.explode(F.array(*_blocks(F.col("fp")))).alias("at")).select("fp", "id", F.col("at.block").alias("block"), F.col("at.bits").alias("bits"))
    sizes = staged(keyed.groupBy("block", "bits").count().where("count > 1"))
    some = keyed.join(sizes, ["block", "bits"])
    plain = some.where(F.col("count") <= group).select(F.xxhash64("block", "bits").alias("key"), "fp", "id")
    if sizes.where(F.col("count") > group).isEmpty():
        dealt = plain
    else:
        hot = some.where(F.col("count") > group).select("fp", "id").distinct()
        turned = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
        # Marked off from block keys; 65 fingerprints at most share one.
        dealt = plain.unionByName(hot.select(F.explode(turned).alias("near"), "fp", "id").select(F.xxhash64(F.lit(-1), "near").alias("key"), "fp", "id"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(_forest, "a long, b long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (signed long)."""
    return docs.select("doc_id", F.pandas_udf(_fingerprint_batches, "long")(whole(F.col("text"))).alias("fp"))


def _components(prints: DataFrame) -> DataFrame:
    """prints(fp, id) -> fp and the smallest id reachable from it, for all that have an id."""
    codes = staged(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    groups = components(links(codes))
    return codes.join(groups, codes["id"] == groups["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = staged(fingerprints(docs))
    named = _components(prints.withColumnRenamed("doc_id", "id"))
    return prints.join(named, "fp", "left").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the columns it has: one row of each component of near copies, that of the smallest doc_id.

    Rows are what is compared, whatever their ids: where an id repeats with other texts, each text is in its own
    component; of rows of one id in one component that of the smallest text hash stays, and rows without an id
    count as copies of those with one.
    """
    mark = fresh(docs, "text_hash")
    text = whole(F.col("text"))
    prints = staged(docs.select("doc_id", F.pandas_udf(_fingerprint_batches, "long")(text).alias("fp"), F.xxhash64(text).alias("hash")))
    # Fingerprints are the nodes, so that an id that repeats ties nothing together.
    nodes = _components(prints.select("fp", F.col("fp").alias("id")).distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    # The first row of each fingerprint, then of each component: large groups of copies are collapsed before the join.
    first = prints.groupBy("fp").agg(F.min(order).alias("row")).join(nodes, "fp").groupBy("component_id").agg(F.min("row").alias("row"))
    chosen = first.select(F.col("row.hash").alias(mark), F.col("row.doc_id").alias("kept_id"))
    marked = docs.withColumn(mark, F.xxhash64(text)).alias("d")
    kept = marked.join(chosen.alias("c"), (F.col(f"d.{mark}") == F.col(f"c.{mark}")) & F.col("d.doc_id").eqNullSafe(F.col("c.kept_id"))).select("d.*")
    # Whole repeats of the chosen row are told apart by nothing: one of them stays.
    return kept.dropDuplicates(["doc_id", mark]).drop(mark)
