"""Archives: fetched from an address, taken apart, and read as tables."""

from __future__ import annotations

import os
import shutil
import tarfile
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def fetch(address: str, folder: str) -> list[str]:
    """The members of the zip or tar archive (plain, gz, bz2 or xz) at `address` (http, https or
    file), written below `folder`; returns their paths in order.

    The archive is streamed to disk, not held in memory. A member that would land outside the
    folder, and a file that is neither kind of archive, raise."""
    os.makedirs(folder, exist_ok=True)
    root = os.path.realpath(folder)
    with tempfile.NamedTemporaryFile() as held:
        with urllib.request.urlopen(address) as source:  # noqa: S310
            shutil.copyfileobj(source, held)
        held.flush()
        if zipfile.is_zipfile(held.name):
            with zipfile.ZipFile(held.name) as z:
                members = [(m.filename, lambda m=m: z.open(m)) for m in z.infolist() if not m.is_dir()]
                return _written(root, members)
        if tarfile.is_tarfile(held.name):
            with tarfile.open(held.name) as t:
                members = [(m.name, lambda m=m: t.extractfile(m)) for m in t.getmembers() if m.isfile()]
                return _written(root, members)
    raise ValueError(f"{address} is neither a zip nor a tar archive")


def _written(root: str, members: list) -> list[str]:
    out = []
    for name, opened in members:
        path = os.path.realpath(os.path.join(root, name))
        if not path.startswith(root + os.sep):
            raise ValueError(f"member {name} lies outside the folder")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with opened() as source, open(path, "wb") as target:
            shutil.copyfileobj(source, target)
        out.append(path)
    return sorted(out)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, line_no, line of the text members of zip archives below `path`, archives in
    parallel and lines streamed. A file that isn't a zip archive has no rows."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for p in parts:
            for archive, content in zip(p["path"], p["content"]):
                held = io.BytesIO(content)
                if not zipfile.is_zipfile(held):
                    continue
                with zipfile.ZipFile(held) as z:
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        with z.open(m) as f:
                            rows: list = []
                            for i, line in enumerate(io.TextIOWrapper(f, "utf-8", errors="replace")):
                                rows.append((archive, m.filename, i, line.rstrip("\r\n")))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(read, "archive string, member string, line_no bigint, line string")
