"""LM scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders, P(w | context) = sum over k of l_k * c(gram k) / c(its context), and
an even share l_0 / (V + 1). The weights l depend on the longest context that is known and on the logarithm of its
frequency; expectation-maximisation learns them from the grams of a held-out part of the training documents against the
counts of the rest. The counts that score are those of all training documents.

Texts are cut into blocks of about half a million tokens. A block asks for each gram once, in packed rows dealt by the gram's hash to
buckets; a bucket adds up its grams' counts over all blocks and answers every block's row in the same order. So each distinct gram of a
block travels once, in some seven bytes, and its count comes back in one or two; no token is a row. Everything grows with
the corpus but the mixture's weights, which are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import buffers, lower_ascii, shared_folder, written
from tidemark.shared import removed

#: Tokens of a block, of a piece of one text, and grams that blocks ask of a bucket.
BLOCK, PIECE, BUCKET = 1 << 19, 1 << 19, 1 << 21
#: Parts of the table: what counts are taken from, what weights are learned from, and what is only scored.
KEPT, DEV, TEST = 0, 1, 2
#: Token numbers of a text's start and end, beside the hashes of words; the order of a gram stands in its last three bits.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, so that a shuffle's compression leaves the empty ones out; each column as wide as its values."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _unpacked(body: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8")[:, :, 0]


class Block:
    """Tokens of several texts or pieces, one after another, each with the tokens before it that are context only."""

    def __init__(self, words: np.ndarray, at: np.ndarray, starts: np.ndarray, lead: np.ndarray, order: int):
        tokens = words[at]
        self.first = np.zeros(len(tokens), np.int32)  # where each token's piece begins
        self.first[starts] = starts
        self.first = np.maximum.accumulate(self.first)
        place = np.arange(len(tokens), dtype=np.int32) - self.first
        self.starts, self.scored = starts, place >= np.repeat(lead, np.diff(np.append(starts, len(tokens))))
        self.end_of_lead = starts + lead
        grams, h = [], np.zeros(len(tokens), np.uint64)
        for k in range(1, order + 1):
            back = np.concatenate([np.zeros(k - 1, np.uint64), tokens[: len(tokens) - k + 1]])
            h = _mix(h * _FACTOR + back + np.uint64(k))
            key = h & ~np.uint64(7) | np.uint64(k)
            key[place < k - 1] = 0  # no such gram here
            grams.append(key)
        self.is_start = tokens == START
        del h, tokens, back, key, place  # before the sort
        self.keys, where = np.unique(np.concatenate(grams), return_inverse=True)
        self.where = where.astype(np.int32).reshape(order, -1)

    def counted(self, part: np.ndarray) -> np.ndarray:
        """Occurrences of each key in (kept, dev) texts, scored places and starts alone; part: of each piece."""
        of_token = np.repeat(part, np.diff(np.append(self.starts, len(self.scored))))
        out = np.zeros((2, len(self.keys)), np.int64)
        for p in (KEPT, DEV):
            for k, where in enumerate(self.where):
                use = (of_token == p) & (self.scored | self.is_start if k == 0 else self.scored)
                out[p] += np.bincount(where[use], minlength=len(self.keys))
        out[:, self.keys == 0] = 0
        return out

    def events(self, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot, estimates) of each scored token: an estimate a column, the first for single words. A slot tells the longest known context's
        length and the logarithm of its frequency."""
        i = np.flatnonzero(self.scored)
        f, level = np.zeros((len(i), len(self.where))), np.zeros(len(i), np.int64)
        log = np.zeros(len(i), np.int64)
        for k, where in enumerate(self.where):
            if k:
                j = np.maximum(i - 1, 0)
                context = np.where(i > self.first[i], counts[self.where[k - 1][j]], 0)
            else:
                context = np.full(len(i), total)
            known = context > 0
            np.divide(counts[where[i]], context, out=f[:, k], where=known)
            level[known] = k + 1
            log[known] = np.frexp(context[known].astype(float))[1] - 1 if k else 0
        return level * SLOTS + np.minimum(log, SLOTS - 1), f


def _blocks(order: int):
    """Packs rows (row, doc_id, text, part) to blocks; a task's dev texts have blocks of their own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(dev: bool) -> pa.RecordBatch:
            tokens = [x[3] for x in held[dev]]
            words, at = np.unique(np.concatenate(tokens), return_inverse=True)
            lengths = np.array([len(x) for x in tokens], np.int64)
            starts = np.cumsum(lengths) - lengths
            parts = np.array([x[2] for x in held[dev]], np.int32)
            lead = np.array([x[4] for x in held[dev]], np.int32)
            n = [int((lengths - lead)[parts == p].sum()) for p in (KEPT, DEV)]
            columns = {
                "block": pa.array([held[dev][0][0]], pa.int64()),
                "piece": pa.array([held[dev][0][5]], pa.int32()),
                "dev": pa.array([dev]),
                "n_kept": pa.array([n[0]], pa.int64()),
                "n_dev": pa.array([n[1]], pa.int64()),
                "n_all": pa.array([int((lengths - lead).sum())], pa.int64()),
                "words": pa.array([words.tobytes()], pa.large_binary()).cast(pa.binary()),
                "at": pa.array([at.astype("<i4").tobytes()], pa.binary()),
                "rows": pa.array([[x[0] for x in held[dev]]], pa.list_(pa.int64())),
                "ids": pa.ListArray.from_arrays([0, len(tokens)], pa.concat_arrays([x[1] for x in held[dev]])),
                "parts": pa.array([parts], pa.list_(pa.int32())),
                "starts": pa.array([starts], pa.list_(pa.int64())),
                "lead": pa.array([lead], pa.list_(pa.int32())),
            }
            held[dev], size[dev] = [], 0
            _given_back()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            rows, ids, parts = batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist()
            data, offsets = buffers(batch.column(2))
            for i, (row, part) in enumerate(zip(rows, parts)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                tokens = np.concatenate([[START], np.fromiter(map(digest, words), np.uint64, len(words)), [END]])
                dev = part == DEV
                for a in range(1, len(tokens), PIECE):
                    lo = max(0, a - order + 1)
                    piece = tokens[lo : a + PIECE]
                    held[dev].append((row, ids.slice(i, 1), part, piece, a - lo, a // PIECE))
                    size[dev] += len(piece)
                    if size[dev] >= BLOCK:
                        yield flush(dev)
        for dev in (False, True):
            if held[dev]:
                yield flush(dev)

    return pack


def _block(row: dict, order: int) -> Block:
    return Block(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["at"], "<i4"), np.array(row["starts"], np.int64), np.array(row["lead"], np.int64), order)


def _asks(order: int, buckets: int):
    """A row for each bucket of each block: its grams in order, and how often they stand in the block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _block(row, order)
                n = block.counted(np.array(row["parts"], np.int64))
                bucket = (block.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edge))
                bodies = [_packed(np.diff(block.keys[a:b], prepend=np.uint64(0)), n[0, a:b], n[1, a:b]) for a, b in zip(edge[full].tolist(), edge[full + 1].tolist())]
                for lo in range(0, len(full), 256):
                    some = full[lo : lo + 256]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array(some.astype(np.int32)),
                            "block": pa.array([row["block"]] * len(some), pa.int64()),
                            "piece": pa.array([row["piece"]] * len(some), pa.int32()),
                            "dev": pa.array([row["dev"]] * len(some)),
                            "body": pa.array(bodies[lo : lo + 256], pa.binary()),
                        }
                    )
                del row, block, n, bodies
                _given_back()

    return ask


ANSWER = "bucket int, block long, piece int, dev boolean, body binary, kept_words long, all_words long"


def _answers(asked: pa.Table) -> pa.Table:
    """Each row's grams' counts in (kept, dev) texts of all blocks; the bucket's own row, without a block, tells its distinct words."""
    bodies = [b.as_buffer() for b in asked.column("body").combine_chunks()]
    sizes = np.array([b.size // 24 for b in bodies])
    ends = np.cumsum(sizes)
    distinct, where = np.unique(np.concatenate([np.cumsum(_unpacked(b, 3)[0], dtype=np.uint64) for b in bodies]), return_inverse=True)
    where = where.astype(np.int32)
    n = np.zeros((2, len(distinct)), np.int64)
    for b, lo, hi in zip(bodies, ends - sizes, ends):
        for k, x in enumerate(_unpacked(b, 3)[1:]):
            n[k, where[lo:hi]] += x.astype(np.int64)  # a block asks for a gram once
    out = [_packed(n[0][where[a:b]], n[1][where[a:b]]) for a, b in zip(ends - sizes, ends)]
    start = _mix(np.array([START]) + np.uint64(1)) & ~np.uint64(7) | np.uint64(1)
    word = (distinct & np.uint64(7) == 1) & (distinct != start[0])
    rows = asked.num_rows
    del where, distinct, bodies
    _given_back()
    return pa.table(
        {
            "bucket": pa.array(asked.column("bucket").to_pylist() + [asked.column("bucket")[0].as_py()], pa.int32()),
            "block": pa.array(asked.column("block").to_pylist() + [None], pa.int64()),
            "piece": pa.array(asked.column("piece").to_pylist() + [None], pa.int32()),
            "dev": pa.array(asked.column("dev").to_pylist() + [None], pa.bool_()),
            "body": pa.array([*out, None], pa.binary()),
            "kept_words": pa.array([None] * rows + [int((word & (n[0] > 0)).sum())], pa.int64()),
            "all_words": pa.array([None] * rows + [int((word & (n[0] + n[1] > 0)).sum())], pa.int64()),
        }
    )


def _given_back() -> None:
    """Arrow keeps what it has freed; two workers and an executor share their memory."""
    pa.default_memory_pool().release_unused()


def _read(block: pa.Table, answers: pa.Table, order: int) -> tuple[dict, Block, np.ndarray]:
    """A block's row, its tokens, and the (kept, dev) counts of its keys."""
    row = block.to_pylist()[0]
    got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()))
    counts = np.concatenate([_unpacked(b, 2) for _, b in got], axis=1).astype(np.int64)
    tokens = _block(row, order)
    if counts.shape[1] != len(tokens.keys):
        raise ValueError(f"block {row['block']} has {len(tokens.keys)} grams and {counts.shape[1]} answers")
    return row, tokens, counts


def _event_schema(order: int) -> str:
    return "slot int, n long, " + ", ".join(f"f{k} double" for k in range(order))


def _held_out_events(order: int, total: int):
    """The distinct events of a block's dev texts under the counts of the kept ones."""

    def found(block: pa.Table, answers: pa.Table) -> pa.Table:
        row, tokens, counts = _read(block, answers, order)
        slot, f = tokens.events(counts[KEPT], total)
        h = slot.astype(np.uint64)
        for k in range(order):
            h = _mix(h * _FACTOR + f[:, k].copy().view(np.uint64))
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        return pa.table({"slot": pa.array(slot[first].astype(np.int32)), "n": pa.array(n), **{f"f{k}": pa.array(f[first, k]) for k in range(order)}})

    return found


def weights(events: DataFrame, order: int, even: float, rounds: int = 20, close: float = 1e-5) -> np.ndarray:
    """The mixture's weights by slot: a column for the even share, then one for each order.

    Expectation-maximisation from even weights, until the mean logarithm gains less than `close` or after `rounds`. One event is added for each
    estimate that a slot can have, so none is ever ruled out; a slot without events keeps even weights. An estimate whose context is not
    known has no weight, so the mixture sums to 1 over all words."""
    slots = (order + 1) * SLOTS
    can = np.arange(order + 1) <= np.arange(slots)[:, None] // SLOTS
    lam = can / can.sum(1, keepdims=True)
    schema = "slot int, gain double, " + ", ".join(f"r{k} double" for k in range(order + 1))
    last = -np.inf
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], lam: np.ndarray = lam) -> Iterator[pa.RecordBatch]:
            total = np.zeros((slots, order + 2))
            for batch in batches:
                slot, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                share = lam[slot] * np.stack([np.full(len(slot), even), *[batch.column(2 + k).to_numpy() for k in range(order)]], 1)
                p = share.sum(1)
                for k, x in enumerate([n * np.log(p), *(n * share[:, j] / p for j in range(order + 1))]):
                    total[:, k] += np.bincount(slot, weights=x, minlength=slots)
            at = np.flatnonzero(total[:, 1:].any(1))
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at.astype(np.int32)), "gain": pa.array(total[at, 0]), **{f"r{k}": pa.array(total[at, k + 1]) for k in range(order + 1)}})

        sums = events.mapInArrow(expect, schema).groupBy("slot").agg(F.sum("gain"), *[F.sum(f"r{k}") for k in range(order + 1)]).collect()
        taken = np.zeros((slots, order + 1))
        for r in sums:
            taken[r[0]] = r[2:]
        lam = (taken + can) / (taken + can).sum(1, keepdims=True)
        gain, n = sum(r[1] for r in sums), taken.sum()
        if not n or gain - last < close * n:
            break
        last = gain
    return lam


def score(docs: DataFrame, part: Column, doc_id: str = "doc_id", text: str = "text", order: int = 2, rounds: int = 20) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    part is KEPT, DEV or TEST for each row: counts are taken from the first two, the mixture's weights are learned from DEV texts
    against KEPT counts. Tokens are a text's words (runs of anything but ASCII white space, A-Z in lower case) and one end; a null text is
    empty. n_known counts tokens that training texts hold, base_score is the add-a-half single-word model's log10 probability, score
    the mixture's. A text of any length is scored whole, in pieces of PIECE tokens. Repeated rows count and are scored as often as they
    stand, a null id is an id like any other, other columns stay behind whatever their names. Without a training text all is even and
    scores are 0. An empty table gives an empty one. Words and grams are told apart by 64-bit hashes (61 bits for grams).
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    data = F.coalesce(lower_ascii(F.col(f"`{text}`")), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("id"), data.alias("data"), part.cast("int").alias("part"))
    schema = f"block long, piece int, dev boolean, n_kept long, n_dev long, n_all long, words binary, at binary, rows array<long>, ids array<{kind}>, parts array<int>, starts array<long>, lead array<int>"
    blocks = written(rows.mapInArrow(_blocks(order), schema), folder := shared_folder(spark))
    kept, dev, everything = (x or 0 for x in blocks.agg(F.sum("n_kept"), F.sum("n_dev"), F.sum("n_all")).first())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), everything * order // BUCKET)
    asked = blocks.mapInArrow(_asks(order, buckets), "bucket int, block long, piece int, dev boolean, body binary")
    answers = written(asked.groupBy("bucket").applyInArrow(_answers, ANSWER), answer_folder := shared_folder(spark))
    kept_words, all_words = (x or 0 for x in answers.where("block IS NULL").agg(F.sum("kept_words"), F.sum("all_words")).first())
    answers = answers.where("block IS NOT NULL").select("bucket", "block", "piece", "dev", "body")
    keys = ("block", "piece")
    events = blocks.where("dev").groupBy(*keys).cogroup(answers.where("dev").groupBy(*keys)).applyInArrow(_held_out_events(order, kept), _event_schema(order))
    events = written(events, event_folder := shared_folder(spark))
    lam = weights(events, order, 1 / (kept_words + 1), rounds)

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        row, tokens, counts = _read(block, answers, order)
        counts, n = counts.sum(0), kept + dev
        slot, f = tokens.events(counts, n)
        p = lam[slot, 0] / (all_words + 1)
        for k in range(order):
            p += lam[slot, k + 1] * f[:, k]
        c = counts[tokens.where[0][tokens.scored]]
        base = np.log10((c + 0.5) / (n + 0.5 * (all_words + 1)))
        lead = np.array(row["lead"], np.int64)
        sizes = np.diff(np.append(tokens.starts, len(tokens.scored))) - lead
        at = np.cumsum(sizes) - sizes
        return pa.table(
            {
                "row": pa.array(row["rows"], pa.int64()),
                "id": block.column("ids").combine_chunks().flatten(),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(np.log10(p), at)),
            }
        )

    pieces = blocks.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(scored, f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double")
    found = pieces.groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    found = written(found)
    for x in (folder, answer_folder, event_folder):
        removed(spark, x)
    return found.select(F.col("id").alias(doc_id), "n_tokens", "n_known", F.lit(kept + dev).cast(T.LongType()).alias("train_tokens"), "base_score", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether CRC-32 of the id as text leaves 1 on division by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def part_of(doc_id: str = "doc_id", dev_of: int = 8) -> Column:
    """TEST for held-out ids; of the others, DEV where another part of the checksum says so (one in dev_of), else KEPT."""
    spot = F.coalesce(F.floor(F.crc32(F.col(doc_id).cast("string")) / 5) % dev_of, F.lit(1))
    return F.when(held_out(doc_id), TEST).when(spot == 0, DEV).otherwise(KEPT)
