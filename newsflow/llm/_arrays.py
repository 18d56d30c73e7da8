"""Named arrays in one file of the shared folder, memory-mapped by the workers."""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid

import numpy as np

#: Bytes of a file before its arrays.
HEAD = 1024


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def store(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line that says what it holds, then the arrays, each at a multiple of 64 bytes."""
    at, head = HEAD, {}
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(head).encode()

    def write(f) -> None:
        f.write(line + b" " * (HEAD - len(line)))
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 64))

    own = _local(path)
    if own is not None:
        os.makedirs(own, exist_ok=True)
        temporary = f"{own}/.{name}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            write(f)
        os.replace(temporary, f"{own}/{name}")
    else:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(temporary := f"{base}/.{name}.{uuid.uuid4().hex}") as f:
            write(f)
        files.move(temporary, f"{base}/{name}")


def _map(file) -> dict[str, np.ndarray]:
    """The arrays of an open file, mapped; the map does not keep the file open where Python (3.13 or later) lets it."""
    try:
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    except TypeError:
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return {k: np.frombuffer(held, dtype, n, at) for k, (dtype, n, at) in json.loads(held[:HEAD]).items()}


def mapped(path: str, name: str) -> dict[str, np.ndarray]:
    own = _local(path)
    if own is not None:
        if not os.path.exists(f"{own}/{name}"):
            return {}
        with open(f"{own}/{name}", "rb") as f:
            return _map(f)
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(path)
    if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
        return {}
    with tempfile.TemporaryFile() as copy, files.open_input_stream(f"{base}/{name}") as f:
        while chunk := f.read(8 << 20):
            copy.write(chunk)
        copy.flush()
        return _map(copy)
