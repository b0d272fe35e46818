"""Small files of the driver: by Hadoop's file systems where a path names one, else on its own disk."""

from __future__ import annotations

import json
import shutil
from pathlib import Path
from typing import Any


def _hadoop(path: str) -> tuple[Any, Any]:
    """(file system, path) of a path that names its file system, as Spark sees it."""
    from pyspark.sql import SparkSession

    sc = SparkSession.builder.getOrCreate().sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def save_text(path: str, text: str) -> None:
    """Writes a file, with its folders."""
    if "://" in path:
        fs, at = _hadoop(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text, "utf-8")


def load_text(path: str) -> str:
    if "://" not in path:
        return Path(path).read_text("utf-8")
    fs, at = _hadoop(path)
    stream = fs.open(at)
    try:
        raw = stream.readAllBytes()
    finally:
        stream.close()
    return bytes(raw).decode()


def exists(path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    fs, at = _hadoop(path)
    return fs.exists(at)


def names(folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    if not exists(folder):
        return []
    if "://" not in folder:
        return sorted(p.name for p in Path(folder).iterdir())
    fs, at = _hadoop(folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at))


def remove(path: str) -> None:
    """Deletes a file or a folder, if it is there."""
    if "://" in path:
        fs, at = _hadoop(path)
        fs.delete(at, True)
    elif Path(path).is_dir():
        shutil.rmtree(path, ignore_errors=True)
    else:
        Path(path).unlink(missing_ok=True)


def save_json(path: str, data: Any) -> None:
    save_text(path, json.dumps(data, indent=2, ensure_ascii=False) + "\n")


def load_json(path: str) -> Any:
    return json.loads(load_text(path))
