"""Small files on whatever file system a path names: local folders, or a store that only Spark's drivers reach.

With a session, paths go through Hadoop's file systems; without one they are local.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def _place(path: str):
    """(file system, path) of Hadoop, or (None, local path) where no session runs."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, Path(path.removeprefix("file://"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: str) -> bool:
    fs, at = _place(path)
    return at.exists() if fs is None else fs.exists(at)


def read_bytes(path: str) -> bytes:
    fs, at = _place(path)
    if fs is None:
        return at.read_bytes()
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(path: str, data: bytes) -> None:
    """Writes a whole file under a name of its own and then renames it, so that no reader sees half of it."""
    fs, at = _place(path)
    if fs is None:
        at.parent.mkdir(parents=True, exist_ok=True)
        new = at.with_name(f"_{at.name}.new")
        new.write_bytes(data)
        new.replace(at)
        return
    new = SparkSession.getActiveSession()._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"cannot write {path}")


def read_text(path: str) -> str:
    return read_bytes(path).decode("utf-8")


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode("utf-8"))


def listed(folder: str) -> list[str]:
    """Names in a folder, sorted; hidden and half-written ones left out. None there: no names."""
    fs, at = _place(folder)
    if fs is None:
        names = [p.name for p in at.iterdir()] if at.exists() else []
    else:
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n[0] not in "._")


def remove(path: str) -> None:
    fs, at = _place(path)
    if fs is None:
        at.unlink(missing_ok=True)
    else:
        fs.delete(at, False)
