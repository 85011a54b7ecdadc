"""Token-ID shards as sorted string tables.

A shard holds documents in ascending order of their key, in blocks. A block is compressed as a
whole and lists its entries: the bytes a key shares with the one before, the rest of the key, the
number of ids, then all ids. After the blocks come a Bloom filter of the keys, a sparse index
(first key, place and count of each block) and a footer of fixed size, so a key is found by a
binary search in the index and one block. Keys are 8 bytes big-endian with the sign bit turned, a
byte 1 before (0 alone for a null key), so their order as bytes is that of the numbers, nulls first.

Spark deals documents to shards by ranges of the key and sorts them; a task encodes and writes
one shard block by block. Tokens come from the tokenizers library, piece by piece: no token
reaches across the border of a non-space and a following space or line feed, so a piece
met before need not be encoded again.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_files, arrow_uri, one_a_task, per_process, written

MAGIC = b"TIDESST1"
#: Bloom filter place, index place, index size, blocks, documents, ids, the width of an id in bytes, magic.
FOOTER = "<QQQQQQI8s"
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Pieces remembered by a worker, and the longest piece in a batch that adds to them.
REMEMBERED, LONGEST = 400_000, 4096
#: New pieces strung together for one call of the tokenizer.
STRUNG = 100
#: White space that is neither a space nor a line feed.
RARE = re.compile(r"[^\S \n]")
#: A stop that does not follow a letter or digit, so that a token may hold both.
ODD_STOP = re.compile(r"[.,](?<=[\W_].)\s")
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
SPACED, SOLID = re.compile(r" \S+"), re.compile(r"\S+")


class Encoder:
    """Ids of texts, as little-endian numbers of 2 or 4 bytes.

    A byte-level tokenizer is fed pieces of texts that no token crosses, each once; new pieces go
    to it strung together, and the lengths of the tokens in bytes tell where each ends. The ids of
    all pieces known lie in one array, so a text is put together by places in it. Any other tokenizer is fed whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character is one byte
            self.length[i] = len(token)
        #: Numbers of the pieces known; where each one's ids begin in the pool, and how many they are.
        self.known: dict[str, int] = {"": 0}
        self.first, self.count, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, self.kind)

    @staticmethod
    def is_plain(text: str) -> bool:
        return not (any(pair in text for pair in ("  ", " \n", "\n ", "\n\n", "\0")) or RARE.search(text) or ODD_STOP.search(text))

    @classmethod
    def pieces(cls, texts: list[str], plain: list[bool]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts, the plain ones' first, and how many each text in that order has."""
        marked = pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())
        for old, new in ((", ", "\0, "), (". ", "\0. "), (".\n", "\0.\n"), ("\n", "\0\n\0"), (" ", "\0 ")):
            marked = pc.replace_substring(marked, old, new)
        lists = [pc.split_pattern(marked, "\0"), pa.array([SAFE_CUT.split(t) for t, p in zip(texts, plain) if not p], pa.large_list(pa.large_string()))]
        return pa.concat_arrays([x.flatten() for x in lists]), np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists])

    def _strung(self, pieces: list[str], between: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of pieces strung together, and how many each has."""
        parts = [pieces[lo : lo + STRUNG] for lo in range(0, len(pieces), STRUNG)]
        ids, n = [], []
        # this call computes no offsets, and short strings are cheaper than long ones
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False)):
            own = np.array(found.ids, self.kind)
            at = np.concatenate([[0], np.cumsum(self.length[own])])
            size = np.array([len(p.encode()) for p in part]) + len(between)
            ends = np.searchsorted(at, np.cumsum(size) - len(between))
            starts = np.searchsorted(at, np.cumsum(size) - size)
            n.append(ends - starts)
            ids.append(own[_spans(starts, n[-1])] if between else own)
        return ids, n

    def _alone(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids = []
        for lo in range(0, len(texts), 200):
            ids += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 200], add_special_tokens=False)]
        return ids, [np.array([len(x)]) for x in ids]

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of pieces into the pool, in order of the numbers after those so far."""
        kinds: list[list[str]] = [[], [], []]
        which = np.array([0 if SPACED.fullmatch(p) else 1 if SOLID.fullmatch(p) else 2 for p in pieces])
        for p, k in zip(pieces, which.tolist()):
            kinds[k].append(p)
        ids, n = (sum(x, []) for x in zip(self._strung(kinds[0], ""), self._strung(kinds[1], "\n"), self._alone(kinds[2])))
        order = np.argsort(which, kind="stable")
        flat, n = np.concatenate(ids), np.concatenate(n)
        first, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        first[order], count[order] = np.cumsum(n) - n + len(self.pool), n
        self.pool, self.first, self.count = np.concatenate([self.pool, flat]), np.concatenate([self.first, first]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [ids.tobytes() for ids in self._alone(texts)[0]]
        plain = [self.is_plain(t) for t in texts]
        flat, per_text = self.pieces(texts, plain)
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        held = (self.pool, self.first, self.count)
        if len(new):
            number[new] = len(self.first) + np.arange(len(new))
            fresh = [names[i] for i in new.tolist()]
            self._learn(fresh)
        places = number[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.count[places]
        ids = self.pool[_spans(self.first[places], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per_text)])].tolist()
        out: list[bytes] = [b""] * len(texts)
        order = [i for i, p in enumerate(plain) if p] + [i for i, p in enumerate(plain) if not p]
        for i, a, b in zip(order, ends, ends[1:]):
            out[i] = ids[a:b].tobytes()
        if len(new) and (len(self.known) > REMEMBERED or max(map(len, fresh)) > LONGEST):
            # the first met are the most frequent ones; they stay, others are forgotten
            self.pool, self.first, self.count = held
        elif len(new):
            self.known.update(zip(fresh, number[new].tolist()))
        return out


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each span, strung together."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def key_bytes(key: int | None) -> bytes:
    return b"\0" if key is None else b"\1" + struct.pack(">Q", (key + (1 << 63)) & ((1 << 64) - 1))


def key_number(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _spots(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class Writer:
    """One shard, to a stream; entries must come in ascending order of key."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.head, self.body, self.size, self.previous, self.first, self.n = [], [], 0, b"", None, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[tuple[int, int]] = []
        self.docs = self.ids = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.n:
            while shared < min(len(key), len(self.previous)) and key[shared] == self.previous[shared]:
                shared += 1
        else:
            self.first = key
        self.head.append(struct.pack("<BBI", shared, len(key) - shared, len(ids) // self.width) + key[shared:])
        self.body.append(ids)
        self.size += len(ids)
        self.previous, self.n = key, self.n + 1
        self.keys.append((zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1))
        self.docs, self.ids = self.docs + 1, self.ids + len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        head = b"".join(self.head)
        block = self.packer.compress(struct.pack("<II", self.n, len(head)) + head + b"".join(self.body))
        self.out.write(block)
        self.index.append((self.first, self.at, len(block), self.n))
        self.at += len(block)
        self.head, self.body, self.size, self.n = [], [], 0, 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8 * 8, np.uint8)
        if self.keys:
            ab = np.array(self.keys, np.int64)
            for i in range(BLOOM_HASHES):
                bloom[(ab[:, 0] + i * ab[:, 1]) % bits] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QII", at, size, n) for k, at, size, n in self.index)
        self.out.write(packed)
        self.out.write(index)
        self.out.write(struct.pack(FOOTER, self.at, self.at + len(packed), len(index), len(self.index), self.docs, self.ids, self.width, MAGIC))


class Reader:
    """One shard from a seekable stream: entries in order, and look-up by key."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, io.SEEK_END)
        stream.seek(end - struct.calcsize(FOOTER))
        self.bloom_at, self.index_at, size, self.blocks, self.docs, self.ids, self.width, magic = struct.unpack(FOOTER, stream.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        stream.seek(self.index_at)
        raw, at, self.index = stream.read(size), 0, []
        while at < len(raw):
            n = raw[at]
            self.index.append((raw[at + 1 : at + 1 + n], *struct.unpack_from("<QII", raw, at + 1 + n)))
            at += 17 + n

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _ = self.index[k]
        self.stream.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(size))
        n, head = struct.unpack_from("<II", raw)
        at, body, key = 8, 8 + head, b""
        for _ in range(n):
            shared, rest, ids = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + rest]
            at += 6 + rest
            yield key, np.frombuffer(raw, f"<u{self.width}", ids, body)
            body += ids * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(self.blocks):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        self.stream.seek(self.bloom_at)
        bits = struct.unpack("<Q", self.stream.read(8))[0]
        for s in _spots(key, bits):
            self.stream.seek(self.bloom_at + 8 + s // 8)
            if not self.stream.read(1)[0] >> s % 8 & 1:
                return False
        return True

    def get(self, key: bytes) -> list[np.ndarray]:
        """All entries of a key, by the Bloom filter, a binary search in the index and the blocks that may hold it."""
        if not self.may_have(key):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for k in range(max(0, lo - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [ids for at, ids in self.block(k) if at == key]
        return found


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Writes shards below folder and returns (shard, file, docs, ids), a table in the folder.

    A null text is an empty one. Ids that repeat stand next to each other, by hash of the text; null
    ids come first. Each document ends with end_id. An empty table gives no shard. `shards` is
    spark.sql.shuffle.partitions unless given. A shard appears whole under a name of its own
    for each attempt, and the table names those that counted.
    """
    arrow_uri(folder)
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("_tie").asc(), F.col("text").asc()]
    dealt = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select("key", "text")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo in range(0, len(keys), 256):
                texts = batch.column(1).slice(lo, 256).to_pylist()
                if encoder is None:
                    encoder = per_process(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
                    end = np.array([end_id], encoder.kind).tobytes()
                    target, base = arrow_files(folder)
                    target.create_dir(base, recursive=True)
                    shard = TaskContext.get().partitionId()
                    short = f"shard-{shard:05d}-{uuid.uuid4().hex[:12]}.sst"
                    out = target.open_output_stream(f"{base}/{short}.part", buffer_size=1 << 20)
                    writer = Writer(out, encoder.width)
                for key, ids in zip(keys[lo : lo + 256], encoder.encode(texts)):
                    writer.add(key_bytes(key), ids + end)
        if writer is not None:
            writer.close()
            out.close()
            target.move(f"{base}/{short}.part", f"{base}/{short}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/{short}"], "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return written(dealt.mapInArrow(write_shard, "shard int, file string, docs long, ids long"), f"{folder}/manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards: start counts the ids before it
    in all shards, and the checksum is over its ids as little-endian unsigned 32-bit numbers."""
    before = F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")

    def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, path = arrow_files(name)
                with source.open_input_file(path) as stream:
                    rows = []
                    for key, ids in Reader(stream):
                        rows.append((key_number(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    files = one_a_task(manifest.withColumn("start", before), "shard").select("file", "start")
    return files.mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
