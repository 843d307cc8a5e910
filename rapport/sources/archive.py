"""ZIP archives: entries become rows, nothing is written to disk."""

from __future__ import annotations

import io
import zipfile
from pathlib import PureWindowsPath

import pandas as pd
from pyspark.sql import DataFrame

from rapport import constants as K

ENTRIES = "archive string, path string, content binary, verdict string"


def _outside(name: str) -> bool:
    """Whether an entry's name leads out of its archive: from a root or drive, or upwards."""
    parts = PureWindowsPath(name).parts        # splits at both kinds of slash, and knows drives
    return bool(PureWindowsPath(name).anchor) or ".." in parts


def _problem(infos) -> str | None:
    """Why an archive is refused as a whole, judged from its directory alone."""
    outside = next((i.filename for i in infos if _outside(i.filename)), None)
    if outside is not None:
        return f"entry leaves the archive: {outside}"
    if len(infos) > K.ARCHIVE_MAX_ENTRIES:
        return f"more than {K.ARCHIVE_MAX_ENTRIES} entries"
    size = sum(i.file_size for i in infos)
    return f"{size} bytes unpacked, more than {K.ARCHIVE_MAX_BYTES}" if size > K.ARCHIVE_MAX_BYTES else None


def _entries(archive: str, prefix: str, content: bytes, depth: int):
    try:
        box = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in box.infolist() if not i.is_dir()]
        problem = _problem(infos)
        if problem:
            yield archive, prefix, None, problem
            return
        for info in infos:
            path, data = f"{prefix}/{info.filename}", box.read(info)
            if info.filename.lower().endswith(".zip"):
                if depth >= K.ARCHIVE_MAX_DEPTH:
                    yield archive, path, None, "archives nested too deeply"
                else:
                    yield from _entries(archive, path, data, depth + 1)
            else:
                yield archive, path, data, "ok"
    except (zipfile.BadZipFile, OSError, RuntimeError, EOFError) as e:
        yield archive, prefix, None, f"corrupt zip: {e}"


def expand_archives(files: DataFrame) -> DataFrame:
    """(archive, path, content, verdict) of ZIP files (path, content). A refused or
    corrupt archive gives one quarantined row; entries stream out one by one."""
    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for row in _entries(path, path, bytes(content), 1):
                    yield pd.DataFrame([row], columns=["archive", "path", "content", "verdict"])

    return files.select("path", "content").mapInPandas(parse, ENTRIES)
