"""Files in the shared folder, opened from executors through the file systems that Arrow knows (local, HDFS, S3, GCS …)."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


@lru_cache(maxsize=8)
def _resolve(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def make_folder(folder: str) -> None:
    system, path = _resolve(folder)
    system.create_dir(path, recursive=True)


def writer(folder: str, name: str):
    system, path = _resolve(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def reader(folder: str, name: str):
    """A seekable file."""
    system, path = _resolve(folder)
    return system.open_input_file(f"{path}/{name}")


def read_part(folder: str, part: int) -> pa.Table | None:
    """What a table written by ``common.by_part`` holds for a part; None where it holds nothing."""
    system, path = _resolve(folder)
    found = system.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    tables = []
    for name in files:
        with system.open_input_file(name) as f:
            tables.append(pq.ParquetFile(f).read())
    return pa.concat_tables(tables).combine_chunks() if tables else None
