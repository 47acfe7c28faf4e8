"""Numpy arrays as raw files in the shared folder, memory-mapped by workers.

On a POSIX path (file://, or a mounted share) workers map the shared files themselves. In another store a worker fetches a file into the
application's own folder on its node, which Spark removes at the end, and maps that copy; what falls out of the KEPT files is deleted. Files are written under another name and renamed, so a repeated task can't leave half a file."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np

_open: OrderedDict[str, np.ndarray] = OrderedDict()
#: Files that a worker keeps mapped.
KEPT = 16384


def _posix(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def save(uri: str, name: str, array: np.ndarray) -> None:
    at = _posix(uri)
    if at is None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        system.create_dir(base, recursive=True)
        new = f"{base}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        system.move(new, f"{base}/{name}")
        return
    os.makedirs(at, exist_ok=True)
    new = f"{at}/.{name}-{uuid.uuid4().hex}"
    with open(new, "wb") as out:
        out.write(np.ascontiguousarray(array).tobytes())
    os.replace(new, f"{at}/{name}")


def load(uri: str, name: str, kind) -> np.ndarray:
    key = f"{uri}/{name}"
    if key in _open:
        _open.move_to_end(key)
        return _open[key]
    at = _posix(uri)
    path = f"{at}/{name}"
    if at is None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        from pyspark import SparkFiles

        path = f"{SparkFiles.getRootDirectory()}/{uuid.uuid5(uuid.NAMESPACE_URL, key).hex}-{os.getpid()}"
        if not os.path.exists(path):
            with system.open_input_stream(f"{base}/{name}") as src, open(new := f"{path}-{uuid.uuid4().hex}", "wb") as out:
                while part := src.read(1 << 22):
                    out.write(part)
            os.replace(new, path)
    mapped = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
    _open[key] = mapped
    while len(_open) > KEPT:
        old, gone = _open.popitem(last=False)
        if _posix(old) is None and isinstance(gone, np.memmap):
            os.unlink(gone.filename)
    return mapped


def remove(spark, uri: str) -> None:
    """Deletes a folder of files that no task reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
