"""SimHash near-duplicates by anchor-point covering.

The 64 bits fall in three parts of 21, 21 and 22 bits; two fingerprints at distance 4 or less
differ by at most one bit in one of them. The anchors of a part are the words of a covering code of
radius 1: six (or seven) free bits beside 15 bits of the perfect Hamming code. Every fingerprint has
one home anchor within the radius, and a copy goes to all anchors within radius + 1, so each
linked pair meets where one of them is at home. Homes and copies are compared per anchor, in
blocks of bounded size where an anchor is crowded, and a task hands on a spanning forest of
what it has linked, never all pairs. Exact copies of a fingerprint are one point throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, split_join, written
from tidemark.llm.components import components, forest

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: First bit and width of each part; the lowest 15 bits of a part are coded, the others free.
PARTS = ((0, 21), (21, 21), (42, 22))
CODED = 15


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of 15 bits under the Hamming code: 0 for a code word, else which bit (from 1) to turn for one."""
    out = np.zeros(len(x), np.int64)
    for bit in range(CODED):
        out ^= np.where(x >> bit & 1, bit + 1, 0)
    return out


def _nearest(x: np.ndarray) -> np.ndarray:
    s = _syndrome(x)
    return x ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)


def _around() -> list[tuple[int, ...]]:
    """For each syndrome, what to add to 15 bits to reach the code words within distance 2."""
    found: list[set[int]] = [set() for _ in range(16)]
    for a in [0, *(1 << i for i in range(CODED))]:
        for b in [0, *(1 << i for i in range(CODED))]:
            if a != b or a == 0:
                found[int(_syndrome(np.array([a ^ b]))[0])].add(a ^ b)
    return [tuple(sorted(f)) for f in found]


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home): each fingerprint's anchors in all parts. An anchor's number holds its part."""
    rows, keys, homes = [], [], []
    around = _around()
    for p, (first, width) in enumerate(PARTS):
        part = (fingerprints >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        coded, free = part & ((1 << CODED) - 1), part >> CODED
        home = _nearest(coded)
        every = np.arange(len(part))

        def put(row: np.ndarray, f: np.ndarray, c: np.ndarray, own: bool) -> None:
            rows.append(row)
            keys.append(np.int64(p) << 40 | f << CODED | c)
            homes.append(np.full(len(row), own))

        put(every, free, home, True)
        syndrome = _syndrome(coded)
        for s in range(16):  # all free bits equal
            at = np.flatnonzero(syndrome == s)
            for add in around[s]:
                put(at, free[at], coded[at] ^ add, False)
        for i in range(width - CODED):  # one free bit turned: the code word within distance 1
            put(every, free ^ (1 << i), home, False)
            exact = np.flatnonzero(syndrome == 0)
            for j in range(i):  # two turned: only where the coded bits are a code word
                put(exact, free[exact] ^ (1 << i) ^ (1 << j), coded[exact], False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def fingerprint(text: bytes) -> int:
    """Majority of the bits of XXH64 (seed 42) over 4-word shingles, repeats included.

    Words are runs of non-space ASCII-wise, A-Z in lower case; fewer than four words are one
    shingle, none give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(length)])
    ends = (starts[np.minimum(np.arange(n) + SHINGLE, len(words))] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    first = starts[:n].tolist()
    for lo in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * total > n).astype(np.uint64)).sum(dtype=np.uint64)) if (2 * total > n).any() else 0


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of each text as a signed long; a null text has no words."""

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, offsets = buffers(batch)
            raw = data.tobytes()
            out = np.array([fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.array(out.view(np.int64))

    return hashed(F.coalesce(text, F.lit("")).cast("binary"))


def _linked(home: np.ndarray, copy: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike fingerprints (places in home and copy) within the threshold, by tiles."""
    a, b = [], []
    step = max(1, (1 << 21) // max(1, len(copy)))
    for lo in range(0, len(home), step):
        near = np.bitwise_count(home[lo : lo + step, None] ^ copy[None, :])
        i, j = np.nonzero((near <= threshold) & (near > 0))
        a.append(i + lo)
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _by_anchor(key: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the links within each run of equal keys of one task's rows.

    Small anchors are compared together: each home against the copies of its anchor."""
    order = np.lexsort((fp, key))
    key, home, fp = key[order], home[order], fp[order]
    copies, homes = fp[~home], fp[home]
    copy_key, home_key = key[~home], key[home]
    lo, hi = np.searchsorted(copy_key, home_key), np.searchsorted(copy_key, home_key, "right")
    large = hi - lo > 256
    small = np.flatnonzero(~large & (hi > lo))
    for s in range(0, len(small), 1 << 14):
        i = small[s : s + (1 << 14)]
        n = hi[i] - lo[i]
        left = np.repeat(homes[i], n)
        right = copies[np.repeat(lo[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        near = np.bitwise_count(left ^ right)
        ok = (near <= threshold) & (near > 0)
        if ok.any():
            yield forest(left[ok].view(np.int64), right[ok].view(np.int64))
    for k in np.unique(home_key[large]):
        h = homes[home_key == k]
        c = copies[np.searchsorted(copy_key, k) : np.searchsorted(copy_key, k, "right")]
        for s in range(0, len(h), 512):  # one tile's links are a forest before the next
            i, j = _linked(h[s : s + 512], c, threshold)
            if len(i):
                yield forest(h[s + i].view(np.int64), c[j].view(np.int64))


def links(points: DataFrame, threshold: int = THRESHOLD, crowd: int = 4096) -> DataFrame:
    """(a, b): links of unlike fingerprints that connect all that lie within the threshold (4 at most).

    points has one column, fp, of distinct longs. Where more than `crowd` homes or copies meet
    at an anchor, both are dealt to blocks of about that size and each pair of blocks is a
    group of its own. There are 2^19 anchors at most, which bounds the list of crowded ones.
    """
    if threshold > 4:
        raise ValueError("this covering holds for 4 bits or fewer")
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = points.select("fp").repartition(n, F.xxhash64("fp"))  # few bytes, but each becomes many copies

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                part = fps[lo : lo + 4096]
                row, key, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(part[row].view(np.int64))], names=["anchor", "home", "fp"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                _, key, home = anchors(fps[lo : lo + 4096])
                both, n = np.unique(key * 2 + home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(np.where(both & 1, n, 0)), pa.array(np.where(both & 1, 0, n))], names=["anchor", "homes", "copies"])

    crowded = (
        points.select("fp")
        .mapInArrow(tally, "anchor long, homes long, copies long")
        .groupBy("anchor")
        .agg(F.sum("homes").alias("homes"), F.sum("copies").alias("copies"))
        .where((F.col("homes") > 0) & ((F.col("homes") > crowd) | (F.col("copies") > crowd)))
        .select("anchor", F.ceil(F.col("homes") / crowd).cast("int").alias("h"), F.ceil(F.col("copies") / crowd).cast("int").alias("c"))
    )
    rows = points.select("fp").mapInArrow(spread, "anchor long, home boolean, fp long").join(F.broadcast(crowded), "anchor", "left")
    h, c = F.coalesce("h", F.lit(1)), F.coalesce("c", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), h).otherwise(c)).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("home"), c).otherwise(h) - 1)
    block = F.explode(F.transform(every, lambda x: F.when(F.col("home"), own * c + x).otherwise(x * c + own)))
    rows = rows.select("anchor", "home", "fp", block.alias("block"))
    dealt = rows.repartition(n, "anchor", "block").select((F.col("anchor") * 4096 + F.col("block")).alias("key"), "home", "fp")
    dealt = dealt.sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def done(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            key, home, fp = (np.concatenate(x) for x in zip(*rows))
            for a, b in _by_anchor(key, home, fp.view(np.uint64), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key, home, fp = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            if not len(key):
                continue
            if size > 1 << 18 and held and key[-1] != held[-1][0][-1]:  # all but the last key's rows are whole
                cut = int(np.searchsorted(key, key[-1]))
                held.append((key[:cut], home[:cut], fp[:cut].astype(np.int64)))
                yield from done(held)
                held, size = [], 0
                key, home, fp = key[cut:], home[cut:], fp[cut:]
            held.append((key, home, fp.astype(np.int64)))
            size += len(key)
        if held:
            yield from done(held)

    return dealt.mapInArrow(compare, "a long, b long")


def named(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, least, root, n) of each fingerprint of prints (doc_id, fp): its smallest id and its rows, and the fingerprint that
    stands for its component."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = components(links(points.select("fp"), threshold))
    return points.join(found, points["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id that links reach.

    Texts without words have fingerprint zero, linked like any other. Rows alike keep a row each; a
    null id is the component of documents whose ids are all null. Empty tables stay empty.
    """
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")))
    of_point = written(named(prints, threshold))
    roots = of_point.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    own = split_join(of_point.select("fp", "root", F.col("n").alias("_rows")), roots, ["root"], of_point.count(), ["fp"])
    sized = own.select("fp", "component_id", F.col("_rows").alias("n"))
    both = split_join(prints, sized, ["fp"], prints.count(), ["doc_id"])
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _identity(doc_id: str) -> list[Column]:
    """An id that may be null as two columns that are not."""
    return [F.isnull(doc_id).alias("absent"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id")]


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay when of each component one row is kept, that with the smallest doc_id.

    Of rows that share that id the one whose text has the smallest hash stays, of rows alike in id and text the one whose columns
    have; a null id comes after all others. Rows that share an id but lie in unlike components do not touch each other. Texts are
    shuffled once, copies of one row are brought down to one before. Columns keep their names and order.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    hashable = [f"c{i}" for i, f in enumerate(docs.schema.fields) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = plain.select(*_identity(at[doc_id]), F.xxhash64(at[text]).alias("hash"), F.struct(*plain.columns).alias("row"), F.xxhash64(*hashable).alias("order"))
    prints = written(plain.select(F.col(at[doc_id]).alias("doc_id"), F.xxhash64(at[text]).alias("hash"), fingerprint_of(F.col(at[text])).alias("fp")))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "hash")).alias("first"))
    best = named(prints, threshold).join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = best.select(*_identity("first.doc_id"), F.col("first.hash").alias("hash"))
    single = row.groupBy("absent", "id", "hash").agg(F.min_by("row", "order").alias("row"))
    kept = single.join(chosen, ["absent", "id", "hash"], "left_semi")  # by the columns that rows are grouped by: no second shuffle
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])
