"""What the operators of this subpackage share: word rules and Arrow buffers, and tables in the shared folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import shared_folder, written

__all__ = ["LOWER", "PLAIN_GAP", "SPACE_WORD", "UPPER", "arrow_files", "arrow_uri", "buffers", "lower_ascii", "one_a_task", "per_process", "shared_folder", "split_join", "without", "written"]

#: Words are runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words are runs of ASCII digits, lower-case letters and all that is not ASCII.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null stays null."""
    return F.translate(text, UPPER, LOWER)


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a binary array; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"")
    wide = pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return raw[lo:hi], offsets - lo


#: Schemes that Arrow opens, and what it calls those that Hadoop knows by another name.
ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def arrow_uri(folder: str) -> str:
    """The folder's URI as Arrow names it; a store that Arrow cannot open is refused by name, before a task starts."""
    scheme, mark, rest = folder.partition("://")
    if not mark or scheme not in ARROW_SCHEMES:
        raise ValueError(f"files are written by Arrow, which has no file system for {folder!r}; it knows {', '.join(sorted(set(ARROW_SCHEMES)))}")
    return f"{ARROW_SCHEMES[scheme]}://{rest}"


def arrow_files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder or file of the shared store."""
    return pafs.FileSystem.from_uri(arrow_uri(folder))


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """One object for each Python worker, kept from task to task (what a task brings along is not)."""
    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def one_a_task(manifest: DataFrame, order: str) -> DataFrame:
    """The rows of a table of files, each in a task of its own, whatever their sizes: a row stands for a whole file."""
    at = F.row_number().over(Window.orderBy(order)) - 1  # as many rows as there are files
    return manifest.withColumn("_at", at).repartitionById(max(1, manifest.count()), F.col("_at")).drop("_at")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs but for columns of these names, whatever their case: those an operator adds."""
    taken = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def split_join(rows: DataFrame, sized: DataFrame, keys: list[str], total: int, tie: list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with `sized`, which has one row a key and a column n: how many of the `total` rows have the key.

    A key with more than a 1024th of all rows is dealt to as many parts as its share asks, by the hash of the columns `tie`, and
    its row in sized goes to each of them, so no task gets more of one key. There are fewer than 1024 such keys, which bounds
    the list that is broadcast. n is left out of the result.
    """
    limit = max(500, total // 1024)
    parts = F.greatest(F.ceil(F.col("n") / limit), F.lit(1)).cast("int")
    hot = sized.where(F.col("n") > limit).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*tie), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")
