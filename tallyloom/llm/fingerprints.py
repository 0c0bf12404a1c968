"""Document fingerprints that are homomorphic multiset hashes of paragraphs.

A fingerprint is a sum of wide vectors, one per paragraph, so paragraphs may come in any
order, and one may be inserted or deleted by adding or subtracting its vector:

* EXACT lanes of 64 bits, summed modulo 2^64: hashes of the whole paragraph. Equal multisets
  of paragraphs have equal sums, others with a chance of 2^-256.
* NEAR lanes of 16 bits, summed modulo 2^16: every run of SHINGLE words of the paragraph (all
  its words, if fewer) adds +1 or -1 to one lane chosen by its hash; so does, in a paragraph of
  fewer than LETTERS_BELOW words, every run of three characters. Read as signed numbers,
  their inner products estimate how much two texts share, with an error near 1/sqrt(NEAR).

Paragraphs are the lines of a text without the white space around them; blank lines count as
nothing. A null text is an empty one; its fingerprint is all zeros. Two empty fingerprints
have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh, whole

EXACT, NEAR, SHINGLE, LETTERS_BELOW = 4, 256, 3, 8
#: Rows in one range of ids, and ranges at most: their bounds are all that the driver sees.
RANGE_ROWS, MOST_RANGES = 1_000, 20_000


class Fingerprint:
    """The sum of the vectors of the paragraphs put in and not taken out."""

    def __init__(self):
        self.exact, self.near = np.zeros(EXACT, np.uint64), np.zeros(NEAR, np.int64)

    def add(self, paragraphs: Iterable[str], times: int = 1) -> Fingerprint:
        whole_hashes, places = [], []
        for p in paragraphs:
            if words := p.split():
                raw = p.strip().encode("utf-8", "surrogatepass")
                whole_hashes.append([xxhash.xxh64_intdigest(raw, lane) for lane in range(EXACT)])
                pieces = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
                if len(words) < LETTERS_BELOW:
                    line = f"\n{' '.join(words)}"
                    pieces += [line[i : i + 3] for i in range(len(line) - 2)]
                places += [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in pieces]
        if whole_hashes:
            self.exact += np.array(whole_hashes, np.uint64).sum(axis=0, dtype=np.uint64) * np.uint64(times % 2**64)
            at = np.array(places, np.uint32)
            self.near += times * np.bincount(at >> 1 & NEAR - 1, np.where(at & 1, 1.0, -1.0), NEAR).astype(np.int64)
        return self

    def copy(self) -> Fingerprint:
        other = Fingerprint()
        other.exact, other.near = self.exact.copy(), self.near.copy()
        return other

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + (self.near % 2**16).astype("<u2").tobytes()).decode()


def signed(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<i2", NEAR, EXACT * 8).astype(float)


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = signed(a), signed(b)
    size = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / size, 0, 1)) if size else 0.0


def of_text(text: str) -> Fingerprint:
    return Fingerprint().add(text.split("\n"))


def of_edit(before: Fingerprint, text: str, kept: int, tail: str) -> Fingerprint:
    """The fingerprint of text[:kept] + tail: only the paragraphs behind the last one left whole are taken out and put in."""
    cut = text.rfind("\n", 0, kept) + 1
    return before.copy().add(text[cut:].split("\n"), -1).add((text[cut:kept] + tail).split("\n"))


def next_in_order(docs: DataFrame, id_col: str, value_col: str, into: str) -> DataFrame:
    """Adds the value of the row with the next larger id; the last row gets the first one's.

    Ids are cut into ranges of like size. A range is put into order by itself; the first row of each
    range also goes to the end of the range before it, the very first one to the end of all. Rows of
    one id keep together, in order of their value; null ids come first.
    """
    ranges = min(MOST_RANGES, docs.count() // RANGE_ROWS + 1)
    bounds = docs.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left"), dtype="int32")

    part, halo = fresh(docs, "part"), fresh(docs, "halo")
    rows = docs.withColumn(part, F.when(F.col(id_col).isNull(), 0).otherwise(range_of(F.coalesce(F.col(id_col), F.lit(0)))))
    # At most one row per range comes to the driver: its smallest id.
    firsts = rows.groupBy(part).agg(F.min(F.coalesce(F.col(id_col), F.lit(-(2**63)))).alias("first")).orderBy(part).collect()
    first = {r[part]: r["first"] for r in firsts}
    before = {r[part]: firsts[i - 1][part] for i, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(parts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([[p, before[p]] if i == first[p] else [p] for p, i in zip(parts, ids, strict=True)])

    dealt = rows.select("*", F.posexplode(places(part, F.coalesce(F.col(id_col), F.lit(-(2**63))))).alias(halo, part + "_")).drop(part)
    order = Window.partitionBy(part + "_").orderBy(halo, F.col(id_col).asc_nulls_first(), value_col)
    return dealt.withColumn(into, F.lead(value_col).over(order)).where(F.col(halo) == 0).drop(halo, part + "_")


def fingerprints(docs: DataFrame, tail_share: int = 4) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit replaces the last floor(n_chars / tail_share) code points by the first as many (or all)
    of the next document. A table of one document has itself as the next.
    """
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    both = next_in_order(rows, "doc_id", "text", "after")
    size = F.char_length("text")
    cut = (size / tail_share).cast("int")
    both = both.select("doc_id", "text", "after", size.cast("long").alias("n_chars"), (size - cut).alias("kept"), F.substring(F.col("after"), F.lit(1), cut).alias("tail"))
    both = both.withColumn("edited_sha256", F.sha2(F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), F.col("tail")).cast("binary"), 256))
    both = both.withColumn("doc_id", F.col("doc_id").cast("string"))  # as text an id keeps all its digits beside null ones
    told = both.mapInPandas(_fingerprint_rows, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return told.withColumn("doc_id", F.col("doc_id").cast("long"))


def _fingerprint_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known: dict[str, Fingerprint] = {}  # a document is mostly the next one of the row before

        def of(text: str) -> Fingerprint:
            if text not in known:
                known.clear()
                known[text] = of_text(text)
            return known[text]

        prints, edits, near_edited, near_next = [], [], [], []
        for text, after, kept, tail in zip(b["text"], b["after"], b["kept"], b["tail"], strict=True):
            own = of(text)
            prints.append(own.text())
            edits.append(of_edit(own, text, kept, tail).text())
            near_edited.append(likeness(prints[-1], edits[-1]))
            near_next.append(likeness(prints[-1], of(after).text()))
        yield pd.DataFrame({"doc_id": b["doc_id"], "n_chars": b["n_chars"], "edited_sha256": b["edited_sha256"], "fingerprint": prints, "edited_fingerprint": edits, "near_edited": near_edited, "near_next": near_next})
