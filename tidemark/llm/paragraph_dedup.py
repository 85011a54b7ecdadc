"""Substring dedup by paragraph MinHash banding.

Paragraphs are all lines with a word, of any length. A line of over LONG words is besides cut into passages where
the words themselves say so, at word pairs whose hash is the least around, so that a shared passage is cut alike
wherever it stands, into passages of about 30 words. MinHash signatures over 5-word shingles fall into bands;
paragraphs that share a band meet in a bucket, are compared by exact Jaccard similarity of their shingles, and
links become clusters by connected components. Equal paragraphs are one throughout. A line of fewer than 5 words is
its own only shingle, so it is like its equals alone and needs no band.

Paragraphs miss a passage that stands within unlike ones. So the runs of 16 words whose hash is the least of 35 in a
row are compared too, for equality only: two documents that share any 50 words in a row, whatever
surrounds them and wherever lines break, share such a run.

Buckets from several bands with the same members are one bucket. A bucket crowded by members or words is dealt to
pairs of blocks, and each group hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, split_join, written
from tidemark.llm.components import components

SHINGLE, LONG, LEAST, REACH = 5, 64, 16, 16
#: Words of a run, and runs in a row of which the least is taken.
RUN, ROW = 16, 35
#: Words for each member that a bucket may hold before it is dealt.
WEIGHT = 256
#: Bands and rows a band: at a similarity of 0.8, 99.4 % of pairs share a band.
BANDS, ROWS = 5, 2
SEGMENT = "doc_id long, par int, word int, n int, fine boolean, hash long, keys array<long>, body binary"
_RNG = np.random.default_rng(20240229)
FACTOR = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
OFFSET = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _cuts(pair: np.ndarray, reach: int) -> np.ndarray:
    """Places whose value is less than all within reach before and no more than all after."""
    n = len(pair)
    wide = np.full(n + 2 * reach, np.iinfo(np.uint64).max, np.uint64)
    wide[reach : n + reach] = pair
    around = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)
    return np.flatnonzero((around[:, :reach].min(1) > pair) & (around[:, reach + 1 :].min(1) >= pair))


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each `width` values in a row, by doubling."""
    span = 1
    while 2 * span <= width:
        x, span = op(x[:-span], x[span:]), 2 * span
    return x if span == width else op(x[: len(x) - (width - span)], x[width - span :])


def runs(h: np.ndarray) -> np.ndarray:
    """First words of the runs that are the least of a row; of runs alike one after another the first."""
    n = len(h) - RUN + 1
    g = np.zeros(n, np.uint64)
    for k in range(RUN):
        g += h[k : n + k] * PLACE[16 + k]
    g = _mix(g)
    if n <= ROW:
        return np.array([int(g.argmin())])
    least = _sliding(g, ROW, np.minimum)
    most = _sliding(np.concatenate([np.zeros(ROW - 1, np.uint64), least, np.zeros(ROW - 1, np.uint64)]), ROW, np.maximum)
    taken = g == most
    taken[1:] &= g[1:] != g[:-1]
    return np.flatnonzero(taken)


def segments(text: bytes, h: np.ndarray) -> list[tuple[int, int, bool]]:
    """(first word, end, fine) of the paragraphs and (fine) runs of a lower-cased text with word hashes h; a long line comes before its passages."""
    found = []
    at = 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            found.append((at, at + n, False))
        if n > LONG:
            pair = _mix(h[at : at + n - 1] * PLACE[0] + h[at + 1 : at + n])
            edge = [0, *(_cuts(pair, REACH) + 1).tolist(), n]
            found += [(at + a, at + b, False) for a, b in zip(edge, edge[1:]) if LEAST <= b - a < n]
        at += n
    return found + ([(i, i + RUN, True) for i in runs(h).tolist()] if len(h) >= RUN else [])


def _signed(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, banded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word ranges, and band keys of those that are banded, which have SHINGLE words or more."""
    n = hi - lo
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    power = np.cumprod(np.full(int(n.max()), PLACE[1], np.uint64))
    first = np.cumsum(n) - n
    whole = _mix(np.add.reduceat(_mix(h[np.repeat(lo, n) + within]) * power[within], first))
    lo, hi = lo[banded], hi[banded]
    keys = np.zeros((BANDS, len(lo)), np.uint64)
    if not len(lo):
        return whole, keys
    s = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        s += h[k : len(h) - SHINGLE + 1 + k] * PLACE[2 + k]
    s = _mix(s)
    edge = np.stack([lo, hi - SHINGLE + 1], 1).ravel()
    s = np.concatenate([s, np.zeros(SHINGLE, np.uint64)])
    for i in range(BANDS * ROWS):
        least = np.minimum.reduceat(_mix(s * FACTOR[i] + OFFSET[i]), edge)[::2]
        keys[i // ROWS] = _mix(keys[i // ROWS] * PLACE[10] + least + np.uint64(i // ROWS + 1))
    return whole, keys


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(0)
        data, offsets = buffers(batch.column(1))
        raw = data.tobytes().lower()
        held: list[tuple[int, int, int, int, bool]] = []
        hashes: list[np.ndarray] = []
        bodies: list[bytes | None] = []
        size = 0
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            words = text.split()
            if words:
                h = np.fromiter(map(digest, words), np.uint64, len(words))
                for par, (a, b, fine) in enumerate(segments(text, h)):
                    held.append((i, par, a, size + a, size + b, fine))
                    bodies.append(None if fine or b - a < SHINGLE else b" ".join(words[a:b]))
                hashes.append(h)
                size += len(words)
            if held and (size > 200_000 or i == batch.num_rows - 1):
                at, par, word, lo, hi, fine = (np.array(x) for x in zip(*held))
                banded = ~fine & (hi - lo >= SHINGLE)
                whole, keys = _signed(np.concatenate(hashes), lo, hi, banded)
                fresh = np.zeros(len(banded), bool)  # what the task has lately handed on needs no bands and no body again
                for k in np.flatnonzero(banded).tolist():
                    if (x := int(whole[k])) in seen:
                        bodies[k] = None
                    else:
                        seen.add(x)
                        fresh[k] = True
                if len(seen) > 500_000:
                    seen.clear()
                keys = keys[:, fresh[banded]]
                n_keys = np.where(fresh, BANDS, 0)
                flat = np.ascontiguousarray(keys.T).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)),
                        pa.array(par.astype(np.int32)),
                        pa.array(word.astype(np.int32)),
                        pa.array((hi - lo).astype(np.int32)),
                        pa.array(fine),
                        pa.array(np.where(fine, whole ^ np.uint64(1), whole).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)), pa.array(flat)),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=[x.split()[0] for x in SEGMENT.split(", ")],
                )
                held, hashes, bodies, size = [], [], [], 0


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash, n) of paragraphs with bands; what a task has lately handed on it does not repeat."""
    seen: set[int] = set()
    for batch in batches:
        h = np.asarray(batch.column(0))
        fresh = np.array([x not in seen for x in h.tolist()], bool)
        _, first = np.unique(h, return_index=True)
        fresh &= np.isin(np.arange(len(h)), first)
        if len(seen) > 500_000:
            seen.clear()
        seen.update(h[fresh].tolist())
        keys = np.asarray(batch.column(1).flatten()).reshape(len(h), BANDS)[fresh]
        n = np.asarray(batch.column(2))[fresh]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(h[fresh], BANDS)), pa.array(np.repeat(n, BANDS))], names=["key", "hash", "n"])


def _buckets(crowd: int):
    """From rows sorted by key and hash: (bucket, hash) of keys that unlike paragraphs share.

    A block holds about crowd members or WEIGHT * crowd words, whichever is less."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_hash, rest_words = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

        def whole(key: np.ndarray, h: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h, weight = key[new], h[new], np.maximum(words[new], WEIGHT)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.append(starts, len(key)))
            if not (n > 1).any():
                return
            bucket = _mix(np.add.reduceat(_mix(h.view(np.uint64)), starts))
            heavy = (n > 1) & (np.add.reduceat(weight, starts) > WEIGHT * crowd)
            small = np.repeat((n > 1) & ~heavy, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, n)[small].view(np.int64)), pa.array(h[small])], names=["bucket", "hash"])
            for s, size in zip(starts[heavy].tolist(), n[heavy].tolist()):
                member, w = h[s : s + size], weight[s : s + size]
                own = np.unique((np.cumsum(w) - w) // (WEIGHT * crowd), return_inverse=True)[1]
                blocks = int(own[-1]) + 1
                base = bucket[np.searchsorted(starts, s)]
                for b in range(blocks):  # a row goes to all pairs with its own block
                    low, high = np.minimum(own, b), np.maximum(own, b)
                    pair = _mix(base + (low * blocks + high + 1).astype(np.uint64) * PLACE[11])
                    yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(member)], names=["bucket", "hash"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, h, words = (np.concatenate([rest, np.asarray(batch.column(k))]) for k, rest in enumerate((rest_key, rest_hash, rest_words)))
            cut = int(np.searchsorted(key, key[-1]))
            yield from whole(key[:cut], h[:cut], words[:cut])
            rest_key, rest_hash, rest_words = key[cut:], h[cut:], words[cut:]
        if len(rest_key):
            yield from whole(rest_key, rest_hash, rest_words)

    return met


def similar(bodies: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose 5-word shingles have a Jaccard similarity of threshold or more."""
    names: dict[tuple[bytes, ...], int] = {}
    sets = []
    for body in bodies:
        w = body.split()
        sets.append({names.setdefault(g, len(names)) for g in zip(*(w[k:] for k in range(SHINGLE)))})
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    links = []
    parts = len(sets)
    if len(sets) <= 6:
        for i in range(len(sets)):
            for j in range(i):
                if find(i) != find(j) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
                    links.append((i, j))
        return links
    size = np.array([len(s) for s in sets])
    flat = np.fromiter((x for s in sets for x in s), np.int64, int(size.sum()))
    first = np.cumsum(size) - size
    mark = np.zeros(len(names), np.int64)
    for i in range(len(sets)):
        if parts == 1:
            break
        own = flat[first[i] : first[i] + size[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], first)
        mark[own] = 0
        for j in np.flatnonzero(common >= threshold * (size + size[i] - common) - 1e-9).tolist():
            if find(i) != find(j):
                root[find(i)] = find(j)
                links.append((i, j))
                parts -= 1
    return links


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, hashes, bodies = None, [], []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            for i, j in similar(bodies, threshold) if len(bodies) > 1 else ():
                a.append(hashes[i])
                b.append(hashes[j])

        for batch in batches:
            for x, h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if x != bucket:
                    close()
                    bucket, hashes, bodies = x, [], []
                hashes.append(h)
                bodies.append(body)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
        close()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return verify


def _sieve(hashes: DataFrame, column: str, most_bits: int = 28):
    """A test for rows whose column may be among the given hashes: a table of bits, 16 for each hash up to 2^most_bits (32 MB) in all.

    It lets pass what it should not (more the fuller it is), so a join follows; it only spares that join's shuffle."""
    size = min(most_bits, max(10, (16 * hashes.count()).bit_length()))
    spot = F.col("hash").bitwiseAND((1 << size) - 1)
    words = hashes.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def may(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            h = np.asarray(batch).view(np.uint64)
            yield pa.array((bits[(h & np.uint64((1 << size) - 1)) >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool))

    return may(F.col(column))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, crowd: int = 1000) -> DataFrame:
    """One row for each paragraph that is repeated, or nearly, in another document.

    (doc_id, paragraph, first_word, n_words, exact_only, cluster_doc, members, kept): cluster_doc is the
    smallest document of the cluster, kept marks the first paragraph there, to be left when
    the others go. exact_only marks runs of 16 words. Every line with a word is a paragraph,
    the shortest too, so a common short line gives a row in each of its documents; passages of lines over 64 words have
    rows of their own. Texts without a word give no row, nor do repeats within one document alone; rows that share an id are one document, null ids are one as well.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).mapInArrow(_cut, SEGMENT))
    fresh = cut.where("body IS NOT NULL")
    banded = fresh.select("hash", "keys", "n").mapInArrow(_once, "key long, hash long, n int")
    bucketed = banded.repartition(n, "key").sortWithinPartitions("key", "hash").mapInArrow(_buckets(crowd), "bucket long, hash long")
    shared = written(bucketed.distinct())
    wanted = written(shared.select("hash").distinct())
    bodies = fresh.select("hash", "body").where(_sieve(wanted, "hash")).join(wanted, "hash", "left_semi").groupBy("hash").agg(F.first("body").alias("body"))
    met = shared.join(bodies, "hash").select("bucket", "hash", "body")
    links = met.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_verify(threshold), "a long, b long")
    found = components(links)
    # what is known of each hash, added up before the shuffle; most stand in one document alone and go no further
    per = cut.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("n"))
    several = (F.col("least") != F.col("most")) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))
    per = per.join(found, F.col("hash") == F.col("node"), "left").where(several | F.col("root").isNotNull())
    per = written(per.select("hash", F.coalesce("root", "hash").alias("cluster"), "least", "most", "known", "n"))
    clusters = per.groupBy("cluster").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("known").alias("known"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("hashes"))
    clusters = clusters.where(several).select("cluster", F.col("least").alias("cluster_doc"), F.col("n").alias("members"), F.col("hashes").alias("n"))
    wanted = split_join(per.select("hash", "cluster", F.col("n").alias("rows")), clusters, ["cluster"], per.count(), ["hash"])
    wanted = written(wanted.select("hash", "cluster", "cluster_doc", "members", F.col("rows").alias("n")))
    total = cut.count()
    rows = split_join(cut.select("doc_id", "par", "word", F.col("n").alias("n_words"), "fine", "hash").where(_sieve(wanted, "hash")), wanted, ["hash"], total, ["doc_id", "par"])
    first = F.min("par").over(Window.partitionBy("cluster", "doc_id"))
    return rows.select(
        "doc_id",
        F.col("par").alias("paragraph"),
        F.col("word").alias("first_word"),
        "n_words",
        F.col("fine").alias("exact_only"),
        "cluster_doc",
        "members",
        (F.col("doc_id").eqNullSafe(F.col("cluster_doc")) & (F.col("par") == first)).alias("kept"),
    )
