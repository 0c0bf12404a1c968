"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding cuts a text into pieces by the vocabulary's pattern and merges each piece's bytes. A
long piece is read in windows: of a window's tokens, those that end at least `lookahead` bytes
before its end are the same whatever follows, so they are emitted, and reading goes on behind them.
Memory stays constant: a window, and a cache of at most CACHE short pieces.

`lookahead` is computed from the merge list. Compare a text with any longer one, merge after merge:
left of a frontier both are cut alike. Merge (a, b) can move the frontier left only by taking
the token a just before it, because the token behind it is b in one of the two; b then lies on the left
spine of whatever an earlier move left there. So far(a, b) = |a| + max(0, far(s) for earlier merges s whose
left part is b, b's left part, its left part and so on), and the largest far is enough for every text.
It holds where each merge comes after those that make its parts, which is checked.

Decoding looks up each id's bytes and turns them into text by an incremental UTF-8 state machine, with a
replacement character for each invalid part.

Null texts count as empty: no ids, and the decoded text is empty. Text that spells a special token becomes
that token, as the library does by default.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import whole

#: The pattern that byte-level vocabularies of this kind cut texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, SHORT, WINDOW = 700_000, 48, 4096


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token boundary that settle it."""
    far: dict[bytes, int] = {}  # by left part, of the merges so far
    lefts: dict[bytes, set[bytes]] = {}
    used: set[bytes] = set()
    most = 0
    for a, b in merges:
        if a + b in used:
            raise ValueError(f"{a + b!r} is merged further before it is made")
        used |= {a, b}
        reach, todo, seen = 0, [b], set()
        while todo:
            t = todo.pop()
            if t not in seen:
                seen.add(t)
                reach = max(reach, far.get(t, 0))
                todo += lefts.get(t, ())
        mine = len(a) + reach
        far[a], most = max(far.get(a, 0), mine), max(most, mine)
        lefts.setdefault(a + b, set()).add(a)
    return most


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = told["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes_of = {i: raw(t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead((raw(a), raw(b)) for a, b in pairs)
        self.window = max(WINDOW, 2 * self.lookahead) + max(map(len, self.bytes_of.values()))
        self.pieces = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merges all of data, the earliest merge first, from the left."""
        ids = [self.byte_id[b] for b in data]
        get = self.merge.get
        if len(ids) <= 64:
            while len(ids) > 1:
                best, at = min(((get(p, _NONE)[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False))), default=(_LAST, 0))
                if best == _LAST:
                    break
                ids[at : at + 2] = [get((ids[at], ids[at + 1]))[1]]
            return ids
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (m := get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue  # one of them is gone
            ids[i], ids[j], after[i] = get(pair)[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, (ids[left], ids[right])))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """The tokens of one piece of any length, as soon as they are settled."""
        at = 0
        while len(data) - at > self.window:
            ids, end, out = self.merged(data[at : at + self.window]), 0, []
            for i in ids:
                end += len(self.bytes_of[i])
                if end > self.window - self.lookahead:
                    break
                out.append(i)
            at += sum(len(self.bytes_of[i]) for i in out)
            yield out
        yield self.merged(data[at:])

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merged(piece.encode("utf-8")))
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[piece] = ids
        return ids

    def encode(self, text: str, block: int = 1 << 14) -> Iterator[list[int]]:
        """The ids of a text, in blocks."""
        out: list[int] = []
        known, own = self.known, self.piece
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for p in self.pieces.findall(part) if len(part) < 1 << 20 else (m[0] for m in self.pieces.finditer(part)):
                if (ids := known.get(p)) is not None:
                    out += ids
                elif len(p) <= SHORT:
                    out += own(p)
                else:
                    for ids in self.stream(p.encode("utf-8")):
                        out += ids
                if len(out) >= block:
                    yield out
                    out = []
        yield out

    def decode(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """The text of blocks of ids, as far as it is settled."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        look = self.bytes_of.__getitem__
        for ids in blocks:
            yield state.decode(b"".join(map(look, ids)))
        yield state.decode(b"", final=True)


_LAST = 1 << 60
_NONE = (_LAST, 0)
_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per file and Python process."""
    return _made.get(path) or _made.setdefault(path, Transducer(path))


def digest(machine: Transducer, text: str) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text), in constant memory."""
    ids_hash, text_hash, size = hashlib.sha256(), hashlib.sha256(), 0
    name = machine.names.__getitem__

    def seen() -> Iterator[list[int]]:
        nonlocal size
        for ids in machine.encode(text):
            if ids:
                ids_hash.update((("," if size else "") + ",".join(map(name, ids))).encode())
                size += len(ids)
                yield ids

    for part in machine.decode(seen()):
        text_hash.update(part.encode("utf-8"))
    return size, ids_hash.hexdigest(), text_hash.hexdigest()


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for texts in batches:
            yield pd.DataFrame([digest(machine, t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    told = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(whole(F.col("text")))
    return docs.select("doc_id", told.alias("told")).select("doc_id", "told.*")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for texts in batches:
            yield pd.Series([[i for ids in machine.encode(t) for i in ids] for t in texts])

    return docs.select("doc_id", F.pandas_udf(run, "array<int>")(whole(F.col("text"))).alias("ids"))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows(doc_id, ids) -> doc_id, text; null ids give an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for each in batches:
            yield pd.Series(["".join(machine.decode([[] if ids is None else list(ids)])) for ids in each])

    return rows.select("doc_id", F.pandas_udf(run, "string")(F.col("ids")).alias("text"))
