"""Sorted hash arrays in files that all executors share.

Tasks write them below the folder in spark.checkpoint.dir and memory-map them
when reading.  A store that cannot be mapped is read through a temporary file
of the worker, unlinked as soon as it is mapped.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from sidelines.session import checkpoint_dir

U64 = np.uint64


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def new_folder(spark: SparkSession, name: str) -> str:
    uri = f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"
    fs, root = _store(uri)
    fs.create_dir(root)
    return uri


def save(uri: str, name: str, hashes: np.ndarray, values: np.ndarray) -> None:
    """Write under a name of this attempt, then rename: a repeated or speculative task replaces equal content."""
    fs, root = _store(uri)
    for part, x in (("h", hashes), ("v", values)):
        tmp = f"{root}/{name}.{part}.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as f:
            np.save(f, np.ascontiguousarray(x), allow_pickle=False)
        fs.move(tmp, f"{root}/{name}.{part}.npy")


def load(uri: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    fs, root = _store(uri)
    out = []
    for part in "hv":
        path = f"{root}/{name}.{part}.npy"
        if isinstance(fs, pafs.LocalFileSystem):
            out.append(np.load(path, mmap_mode="r", allow_pickle=False))
        else:
            with tempfile.NamedTemporaryFile() as local:
                with fs.open_input_stream(path) as f:
                    while block := f.read(1 << 22):
                        local.write(block)
                local.flush()
                out.append(np.load(local.name, mmap_mode="r", allow_pickle=False))
    return out[0], out[1]


class Lookup:
    """Values by hash from the files ``<kind>-<bucket>``, bucket = hash modulo ``buckets``."""

    def __init__(self, uri: str, buckets: int):
        self.uri, self.buckets, self.files = uri, buckets, {}
        fs, root = _store(uri)
        self.names = {f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))}

    def get(self, kind: str, hashes: np.ndarray, width: int, deal: np.ndarray | None = None) -> np.ndarray:
        """[hashes, width] values, 0 where absent; each bucket is read once, in order of its hashes.

        ``deal``: the hashes that choose the buckets, where they are not ``hashes``."""
        if deal is None:
            distinct, back = np.unique(hashes, return_inverse=True)
            deal = distinct
        else:
            distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            deal = deal[first]
        out = np.zeros((len(distinct), width))
        bucket = (deal % U64(self.buckets)).astype(np.min_scalar_type(self.buckets))
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            name = f"{kind}-{b}"
            if f"{name}.h.npy" not in self.names:
                continue
            if name not in self.files:
                self.files[name] = load(self.uri, name)
            known, values = self.files[name]
            if not len(known):
                continue
            rows = by[cut[b]:cut[b + 1]]
            at = np.minimum(np.searchsorted(known, distinct[rows]), len(known) - 1)
            hit = known[at] == distinct[rows]
            out[rows[hit]] = values[at[hit]]
        return out[back]
