"""Language ID by prediction by partial matching.

Each language gets a byte context tree of order 3 with frozen statistics. A text's code
length under a language is the exact sum over its bytes of the code lengths of method C
with exclusions: a symbol seen in the longest known context costs log2((n + d) / c) bits
(n symbols, d distinct, c of this one), else an escape of log2((n + d) / d) and the same
in the next shorter context, without the symbols already ruled out; below order 0 all
bytes left are equally likely. The language with the shortest code wins.

Counting is a Spark job: tasks count 4-grams, a shuffle adds them up. Prediction is
one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, without

ORDER = 3
#: Bytes scored or counted at once: a worker holds some 150 bytes for each, however long a text is.
SLICE = 1 << 18
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double, bits_per_byte double"


def _grams(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The 4-gram that ends at each byte of data[lo:hi]; before a text's first byte stand zeros."""
    at = max(0, lo - ORDER)
    wide = data[at:hi].astype(np.uint32)
    pad = np.concatenate([np.zeros(ORDER - (lo - at), np.uint32), wide])
    n = hi - lo
    back = [pad[ORDER - k : ORDER - k + n] for k in range(ORDER + 1)]
    starts = offsets[np.searchsorted(offsets, lo - ORDER + 1) : np.searchsorted(offsets, hi)] - lo
    for k in range(1, ORDER + 1):  # the k-th byte back is another text's for the first k bytes
        back[k] = back[k].copy()
        for j in range(k):
            x = starts + j
            back[k][x[(x >= 0) & (x < n)]] = 0
    return back[0] | back[1] << 8 | back[2] << 16 | back[3] << 24


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ContextTree:
    """Frozen counts of one language, as sorted arrays for each order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts, self.contexts, self.total, self.distinct, self.above = [], [], [], [], [], []
        for k in range(ORDER + 1):
            keys, inverse = np.unique(grams & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, weights=counts, minlength=len(keys))
            context, inverse = np.unique(keys >> np.uint32(8), return_inverse=True)
            self.grams.append(keys)
            self.counts.append(c)
            self.contexts.append(context)
            self.total.append(np.bincount(inverse, weights=c, minlength=len(context)))
            self.distinct.append(np.bincount(inverse, minlength=len(context)).astype(float))
            shorter = c if not k else self.counts[k - 1][_find(self.grams[k - 1], keys & np.uint32((1 << 8 * k) - 1))[0]]
            self.above.append(np.bincount(inverse, weights=shorter, minlength=len(context)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each 4-gram's last byte after its first three."""
        out, left = np.zeros(len(grams)), np.ones(len(grams), bool)
        ruled_n, ruled_d = np.zeros(len(grams)), np.zeros(len(grams))
        for k in range(ORDER, -1, -1):
            context, known = _find(self.contexts[k], (grams >> np.uint32(8)) & np.uint32((1 << 8 * k) - 1))
            gram, seen = _find(self.grams[k], grams & np.uint32((1 << 8 * (k + 1)) - 1))
            n, d = self.total[k][context] - ruled_n, self.distinct[k][context] - ruled_d
            hit = left & known & seen
            out[hit] += np.log2((n + d)[hit] / self.counts[k][gram][hit])
            left &= ~hit
            escape = left & known & (d > 0)
            out[escape] += np.log2((n + d)[escape] / d[escape])
            ruled_n = np.where(known, self.above[k][context], 0.0)
            ruled_d = np.where(known, self.distinct[k][context], 0.0)
        out[left] += np.log2(np.maximum(256.0 - ruled_d[left], 1.0))
        return out


class Model:
    """The context trees of all languages, and a table of the code lengths of all 4-grams seen."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        which = np.array([at[lang] for lang, _, _ in counts], np.int64)
        grams = np.array([gram for _, gram, _ in counts], np.uint32)
        n = np.array([c for _, _, c in counts], float)
        self.trees = [ContextTree(grams[which == i], n[which == i]) for i in range(len(self.langs))]
        self.known = np.unique(grams)
        self.table = self._bits(self.known)

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(grams) for t in self.trees], 1) if self.trees else np.zeros((len(grams), 0))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language, by slices of a fixed number of bytes."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for lo in range(0, len(data), SLICE):
            hi = min(lo + SLICE, len(data))
            grams = _grams(data, offsets, lo, hi)
            at, seen = _find(self.known, grams)
            bits = self.table[at]
            if not seen.all():
                rare, inverse = np.unique(grams[~seen], return_inverse=True)
                bits[~seen] = self._bits(rare)[inverse]
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(bits, 0, dtype=float)])
            first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
            edge = np.clip(offsets[first : last + 1], lo, hi) - lo
            out[first:last] += sums[edge[1:]] - sums[edge[:-1]]
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_texts: int = 1500) -> Model:
    """Learns the context trees from labelled rows.

    A language with more than max_texts unlike texts is learnt from a sample of about so many whole texts, those with
    the smallest hashes, so the model depends on nothing but texts and labels; this bounds the model and what reaches the
    driver. Copies of a text under one label count once. Rows with a null text or label are left out. No rows at all
    give a model that knows no language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: max(1, r[1]) for r in rows.groupBy(lang).agg(F.approx_count_distinct(F.xxhash64(text))).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_texts / n))])
    spot = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(spot < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text")).distinct()
    chosen = chosen.select("lang", F.lower("text").cast("binary").alias("data"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = buffers(batch.column(1))
            for name in sorted(set(langs)):
                parts = [data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(langs == name)]
                ends = np.cumsum([0, *map(len, parts)])
                joined = np.concatenate(parts)
                for lo in range(0, len(joined), SLICE):
                    grams, n = np.unique(_grams(joined, ends, lo, min(lo + SLICE, len(joined))), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counted.collect()])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to every row.

    score is the winner's share of 2^-bits over all languages (equal priors); ties go to the
    smaller name. A null text, and one without a letter, is `und` with score 0, as is
    every text when no language is known. Case does not matter. Empty tables stay empty.
    Columns of docs named so, or _letter or _s, are left out.
    """
    docs = without(docs, "lang_pred", "score", "bits_per_byte", "_letter", "_s")
    @F.arrow_udf(SCHEMA)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = model  # Spark broadcasts what a function carries
        for batch in batches:
            data, offsets = buffers(batch)
            n = np.diff(offsets)
            if not known.langs:
                names, score, mean = [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n))
            else:
                bits = known.lengths(data, offsets)
                best = bits.argmin(1)
                least = bits[np.arange(len(n)), best]
                score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
                names, mean = [known.langs[i] for i in best], least / np.maximum(n, 1)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(mean)], ["lang_pred", "score", "bits_per_byte"])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kept = docs.columns
    marked = docs.select(*kept, has_letter.alias("_letter"), scored(F.coalesce(F.lower(text), F.lit("")).cast("binary")).alias("_s"))
    return marked.select(
        *kept,
        F.when(F.col("_letter"), F.col("_s.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letter"), F.col("_s.score")).otherwise(0.0).alias("score"),
        F.when(F.col("_letter"), F.col("_s.bits_per_byte")).alias("bits_per_byte"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
