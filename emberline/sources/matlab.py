"""Numeric matrices of MAT files (version 5) as tables, and back.

The format is public: a header of 128 bytes, then elements of a tag (type, length) and data
padded to eight bytes; a matrix is an element of elements (flags, sizes, name, values)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers of the element types with their number formats, and of the matrix classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
SPARSE, NUMERIC = 5, range(6, 16)


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: length and type in one number, data beside it
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def matrices(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, rows, columns, values) of each two-dimensional numeric matrix, entries that are 0
    left out. Cells, structures and texts are passed over; of complex values the real part counts."""
    order = "<" if data[126:128] == b"IM" else ">"
    todo = [data[128:]]
    while todo:
        for kind, body in _elements(todo.pop(), order):
            if kind == COMPRESSED:
                todo.append(zlib.decompress(body))
                continue
            if kind != MATRIX:
                continue
            parts = list(_elements(body, order))
            if len(parts) < 4:
                continue
            number = lambda p: np.frombuffer(p[1], order + TYPES[p[0]])
            cls, sizes, name = number(parts[0])[0] & 255, number(parts[1]), parts[2][1].decode()
            if len(sizes) != 2 or (cls != SPARSE and cls not in NUMERIC):
                continue
            if cls == SPARSE:
                rows, starts, v = number(parts[3]), number(parts[4]), number(parts[5]).astype(np.float64)
                cols = np.repeat(np.arange(sizes[1]), np.diff(starts))
                rows = rows[: len(cols)]
                v = v[: len(cols)]
            else:
                v = number(parts[3]).astype(np.float64)
                cols, rows = np.divmod(np.arange(len(v)), max(int(sizes[0]), 1))  # by columns
            on = v != 0
            yield name, rows[on].astype(np.int64), cols[on].astype(np.int64), v[on]


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, name, row, col (from 0), value of the entries that aren't 0 of all matrices of the MAT
    files below `path`, files in parallel. A file that is none has no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for file, content in zip(p["path"], p["content"]):
                if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
                    continue
                for name, rows, cols, values in matrices(content):
                    for lo in range(0, len(values), 100_000):
                        s = slice(lo, lo + 100_000)
                        yield pd.DataFrame({"file": file, "name": name, "row": rows[s], "col": cols[s], "value": values[s]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "file string, name string, row bigint, col bigint, value double")


def _tagged(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def packed(name: str, entries: np.ndarray, shape: tuple[int, int], sparse: bool = True, compressed: bool = False) -> bytes:
    """A MAT file with one matrix from (row, col, value) entries."""
    e = entries[np.lexsort((entries[:, 0], entries[:, 1]))]
    head = _tagged(6, struct.pack("<II", SPARSE if sparse else 6, len(e))) + _tagged(5, struct.pack("<ii", *shape)) + _tagged(1, name.encode())
    if sparse:
        starts = np.searchsorted(e[:, 1], np.arange(shape[1] + 1))
        body = _tagged(5, e[:, 0].astype("<i4").tobytes()) + _tagged(5, starts.astype("<i4").tobytes()) + _tagged(9, e[:, 2].astype("<f8").tobytes())
    else:
        full = np.zeros(shape)
        full[e[:, 0].astype(int), e[:, 1].astype(int)] = e[:, 2]
        body = _tagged(9, full.T.astype("<f8").tobytes())
    element = _tagged(MATRIX, head + body)
    if compressed:
        z = zlib.compress(element)
        element = struct.pack("<II", COMPRESSED, len(z)) + z
    return b"emberline".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM" + element


def edges(df: DataFrame, name: str) -> DataFrame:
    """src, dst, weight: a matrix of `read` as a graph's edges."""
    return df.where(F.col("name") == name).select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))
