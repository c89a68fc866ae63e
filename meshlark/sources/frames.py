"""Segmentation images (NumPy files) as pixel tables."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _image(content: bytes, path: str) -> np.ndarray:
    """The two-dimensional numbers of a file; anything else is an error."""
    data = np.squeeze(np.load(io.BytesIO(content), allow_pickle=False))
    if data.ndim != 2:
        raise ValueError(f"an image has 2 dimensions; {path} has shape {data.shape}")
    if not (np.issubdtype(data.dtype, np.number) or data.dtype == np.bool_) or np.issubdtype(data.dtype, np.complexfloating):
        raise TypeError(f"an image has numbers or flags; {path} has {data.dtype}")
    if np.issubdtype(data.dtype, np.floating) and not np.isfinite(data).all():
        raise ValueError(f"an image has finite numbers; {path} has others")
    return data


#: Stores whose files the tasks can open themselves; of others Spark reads whole files.
OPENED = ("file", "s3", "gs")
#: Bytes in which an image's header ends, but for very long ones.
HEAD = 4096


def _open(path: str) -> BinaryIO:
    """The file of a Hadoop path in one of the ``OPENED`` stores, to be read from its beginning."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb", buffering=0)
    system, inner = pyarrow.fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(inner)


class _Head(io.RawIOBase):
    """A file that is read in stretches, as far as somebody asks for it; ``taken`` counts the bytes."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.held, self.at, self.taken = file, b"", 0, 0

    def read(self, n: int = -1) -> bytes:
        while len(self.held) < self.at + n:
            more = self.file.read(HEAD)
            if not more:
                break
            self.taken += len(more)
            self.held += more
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def _header(file: BinaryIO, path: str) -> tuple[int, int, str, int]:
    """Height, width, type, and how many bytes were read for them."""
    head = _Head(file)
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, _, dtype = read(head)
    shape = [x for x in shape if x != 1]
    if len(shape) != 2:
        raise ValueError(f"an image has 2 dimensions; {path} has shape {tuple(shape)}")
    return shape[0], shape[1], str(dtype), head.taken


def inspect(files: DataFrame) -> DataFrame:
    """``timepoint, path, height, width, dtype, bytes_read`` from the headers of discovered files.

    Where tasks can open files themselves, the first few thousand bytes are all that is read, whatever the images' sizes, and
    ``content`` isn't asked of Spark; in other stores whole files are."""
    shape = "timepoint int, path string, height int, width int, dtype string, bytes_read long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, path, content in zip(pdf["timepoint"], pdf["path"], pdf["content"] if "content" in pdf else [None] * len(pdf)):
                with io.BytesIO(content) if content is not None else _open(path) as file:
                    height, width, dtype, taken = _header(file, path)
                rows.append((t, path, height, width, dtype, taken if content is None else len(content)))
            yield pd.DataFrame(rows, columns=["timepoint", "path", "height", "width", "dtype", "bytes_read"])

    opened = F.substring_index("path", ":", 1).isin(*OPENED)
    short = files.where(opened).select("timepoint", "path").mapInPandas(run, shape)
    whole = files.where(~opened).select("timepoint", "path", "content").mapInPandas(run, shape)
    return short.unionByName(whole)


def consistency(inspected: DataFrame) -> DataFrame:
    """One row: files, distinct shapes and types, and whether there is only one of each."""
    shape = F.struct("height", "width")
    return inspected.agg(
        F.count("*").alias("files"),
        F.sort_array(F.collect_set(shape)).alias("shapes"),
        F.sort_array(F.collect_set("dtype")).alias("dtypes"),
        (F.count_distinct("height", "width") == 1).alias("one_shape"),
        (F.count_distinct("dtype") == 1).alias("one_dtype"),
    )


def load_pixels(files: DataFrame, background: tuple[float, ...] = (0.0, 2.0)) -> DataFrame:
    """``frame, row, col`` of the foreground: pixels whose number is none of ``background``.  A frame is a file."""
    values = np.asarray(background, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, path, content in zip(pdf["timepoint"], pdf["path"], pdf["content"]):
                rows, cols = np.nonzero(~np.isin(_image(content, path), values))
                yield pd.DataFrame({"frame": np.full(len(rows), t, "int32"), "row": rows.astype("int32"), "col": cols.astype("int32")})

    return files.select("timepoint", "path", "content").mapInPandas(run, "frame int, row int, col int")
