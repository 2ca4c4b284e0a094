"""Small files of arrays in the shared folder, written whole or not at all."""

from __future__ import annotations

import io

import numpy as np
from pyarrow import fs


def put(folder: str, name: str, raw: bytes) -> None:
    """Writes beside the place and renames, so that a task that runs twice leaves one whole file."""
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    token = np.random.default_rng().integers(1 << 62)
    with where.open_output_stream(f"{base}/.{name}-{token}") as out:
        out.write(raw)
    where.move(f"{base}/.{name}-{token}", f"{base}/{name}")


def get(folder: str, name: str) -> bytes | None:
    """The file's bytes, None where there is none."""
    where, base = fs.FileSystem.from_uri(folder)
    try:
        with where.open_input_file(f"{base}/{name}") as f:
            return f.readall()
    except FileNotFoundError:
        return None


def put_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put(folder, name, out.getvalue())


def get_arrays(folder: str, name: str) -> dict[str, np.ndarray] | None:
    raw = get(folder, name)
    if raw is None:
        return None
    with np.load(io.BytesIO(raw)) as found:
        return {k: found[k] for k in found.files}


def names(folder: str) -> list[str]:
    """The names of the files of a folder, sorted."""
    where, base = fs.FileSystem.from_uri(folder)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))
