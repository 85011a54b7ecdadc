"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item's windows (13 consecutive words, or all of a shorter item) are sets to be contained
whole, so the necessary prefix of a window is its rarest shingle of three words. One pass over
the corpus counts how often each benchmark shingle occurs; with the rarest of each window as its
prefix token, a second pass meets documents and windows there, bounds where the window would
start and end, and compares all its words. Texts are not shuffled. The benchmark travels in parts
of bounded size; more parts mean more passes, not more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, without, written

WINDOW, SHINGLE = 13, 3
#: Candidates compared at a time.
AT_ONCE = 1 << 15
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "n_words long, hits array<struct<lo:int,hi:int>>, items array<int>"


def _words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Index:
    """Windows, words and shingles of one part of the benchmark."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        self.ids = sorted({i or "" for i, _ in items})
        at = {i: k for k, i in enumerate(self.ids)}
        self.words: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            seq = [self.words.setdefault(w, len(self.words) + 1) for w in _words(text or b"")]
            size = min(WINDOW, len(seq))
            for k in range(len(seq) - size + 1) if size else ():
                windows.setdefault(tuple(seq[k : k + size]), set()).add(at[item or ""])
        self.windows = sorted(windows)
        self.items = [sorted(windows[w]) for w in self.windows]
        self.base = len(self.words) + 1
        codes: dict[int, set[int]] = {1: set(), 2: set(), SHINGLE: set()}
        for w in self.windows:
            size = min(SHINGLE, len(w))
            codes[size] |= {self._code(w[k : k + size]) for k in range(len(w) - size + 1)}
        self.codes = {size: np.array(sorted(c), np.int64) for size, c in codes.items() if c}
        #: Where the shingles of each size begin among all.
        self.first, n = {}, 0
        for size, c in self.codes.items():
            self.first[size], n = n, n + len(c)
        self.n_shingles = n
        self.prefix = self.offset = self.start = None
        self.by_size = {size: np.array([w for w in self.windows if len(w) == size], np.int64) for size in {len(w) for w in self.windows}}
        place = {w: i for size in self.by_size for i, w in enumerate([x for x in self.windows if len(x) == size])}
        self.size_of = np.array([len(w) for w in self.windows], np.int64)
        self.row_of = np.array([place[w] for w in self.windows], np.int64)

    def _code(self, words: tuple[int, ...]) -> int:
        code = 0
        for w in words:
            code = code * self.base + w
        return code

    def order(self, counts: dict[int, int]) -> None:
        """Takes each window's rarest shingle as its prefix; one that the corpus lacks needs no look-up."""
        entries = []
        for i, w in enumerate(self.windows):
            size = min(SHINGLE, len(w))
            best = min((counts.get(s, 0), s, k) for k in range(len(w) - size + 1) for s in [self.first[size] + int(np.searchsorted(self.codes[size], self._code(w[k : k + size])))])
            if best[0]:
                entries.append((best[1], i, best[2]))
        entries.sort()
        shingles = np.array([e[0] for e in entries], np.int64)
        self.start = np.searchsorted(shingles, np.arange(self.n_shingles + 1))
        self.prefix = np.array([e[1] for e in entries], np.int64)
        self.offset = np.array([e[2] for e in entries], np.int64)

    def numbers(self, text: bytes) -> np.ndarray:
        """The document's words as numbers, 0 for those no item has."""
        get = self.words.get
        return np.array([get(w, 0) for w in _words(text)], np.int64)

    def shingles(self, seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of benchmark shingles in a document, and which they are."""
        for size, codes in self.codes.items():
            if len(seq) < size:
                continue
            at = np.flatnonzero(np.logical_and.reduce([seq[k : len(seq) - size + 1 + k] > 0 for k in range(size)]))
            code = np.zeros(len(at), np.int64)
            for k in range(size):
                code = code * self.base + seq[at + k]
            spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            ok = codes[spot] == code
            yield at[ok], spot[ok] + self.first[size]

    def find(self, seq: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [lo, hi) of hit words, and the items whose windows occur."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at, which in self.shingles(seq):
            per = self.start[which + 1] - self.start[which]
            at, which, per = at[per > 0], which[per > 0], per[per > 0]
            for lo, hi in _groups(per):
                n = per[lo:hi]
                entry = np.repeat(self.start[which[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = self.prefix[entry]
                begin = np.repeat(at[lo:hi], n) - self.offset[entry]
                size = self.size_of[window]
                fits = (begin >= 0) & (begin + size <= len(seq))
                for s, rows in self.by_size.items():
                    k = np.flatnonzero(fits & (size == s))
                    same = (seq[begin[k, None] + np.arange(s)] == rows[self.row_of[window[k]]]).all(1)
                    found.append((begin[k[same]], window[k[same]]))
        if not sum(len(b) for b, _ in found):
            return [], set()
        begin, window = (np.concatenate(x) for x in zip(*found))
        hit = np.zeros(len(seq) + 1, np.int64)
        np.add.at(hit, begin, 1)
        np.add.at(hit, begin + self.size_of[window], -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
        return list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())), {i for w in set(window.tolist()) for i in self.items[w]}


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places whose candidates together are about AT_ONCE."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def _counted(docs: DataFrame, text: str, index: Index) -> dict[int, int]:
    """Occurrences of the part's shingles in all texts; as many numbers as the part has shingles at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(index.n_shingles, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            raw = data.tobytes()
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for _, which in index.shingles(index.numbers(raw[lo:hi])):
                    total += np.bincount(which, minlength=index.n_shingles)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(some), "n": pa.array(total[some])})

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).mapInArrow(count, "shingle long, n long")
    return {r[0]: r[1] for r in rows.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = 4 << 20
) -> DataFrame:
    """Adds decon_words, decon_hits (merged word ranges) and decon_items (sorted ids) to every row.

    Words are runs of ASCII digits and letters, case aside, and of all that is not ASCII. A null text
    has none, here and in items; a null item id counts as an empty one; an item given twice
    counts once. Empty tables, of documents or items, hit nothing. part_bytes bounds the text of
    the items that travel at once. Columns of docs named like those added are left out.
    """
    docs = without(docs, "decon_words", "decon_hits", "decon_items", "decon_hit_words", "contaminated", "_f")
    whole = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    n_parts = 1 + (whole.agg(F.sum(F.length("t") + 16)).first()[0] or 0) // part_bytes
    out = docs.withColumns({"decon_words": F.lit(None).cast("long"), "decon_hits": F.array().cast("array<struct<lo:int,hi:int>>"), "decon_items": F.array().cast("array<string>")})
    for part in range(n_parts):
        index = Index([(r[0], r[1] and bytes(r[1])) for r in whole.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_parts)) == part).collect()])
        index.order(_counted(docs, text, index) if index.windows else {})
        ids = F.array(*map(F.lit, index.ids)) if index.ids else F.array().cast("array<string>")
        found = _finder(index)(F.coalesce(F.col(text), F.lit("")).cast("binary"))
        out = out.withColumn("_f", found).withColumns(
            {
                "decon_words": F.col("_f.n_words"),
                "decon_hits": F.concat("decon_hits", "_f.hits"),
                "decon_items": F.concat("decon_items", F.transform("_f.items", lambda k: F.get(ids, k))),
            }
        )
        out = out.drop("_f")
        if n_parts > 1:
            out = written(out)
    return out.withColumn("decon_items", F.array_sort(F.array_distinct("decon_items")))


def _finder(index: Index):
    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            data, offsets = buffers(batch)
            raw = data.tobytes()
            n_words, hits, items = [], [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                seq = index.numbers(raw[lo:hi])
                spans, which = index.find(seq) if index.windows else ([], set())
                n_words.append(len(seq))
                hits.append([{"lo": a, "hi": b} for a, b in spans])
                items.append(sorted(which))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.int32()))], ["n_words", "hits", "items"])

    return find


def hit_words(hits: str = "decon_hits"):
    """How many words the ranges cover; ranges of several parts may overlap."""
    step = lambda a, r: F.struct(
        (a["n"] + F.greatest(r["hi"] - F.greatest(r["lo"], a["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["to"], r["hi"]).alias("to")
    )
    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step)["n"]


def judged(scanned: DataFrame) -> DataFrame:
    """Adds decon_hit_words and contaminated: at least a twentieth of the words is hit."""
    n = F.col("decon_hit_words")
    return scanned.withColumn("decon_hit_words", hit_words()).withColumn("contaminated", (n > 0) & (20 * n >= F.col("decon_words")))
