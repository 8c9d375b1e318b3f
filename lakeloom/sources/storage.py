"""Small files and listings by URI: local paths directly, other stores through Hadoop's file systems.

Table metadata needs one primitive that a store must offer: creating a file only
if it is not there.  Local files have it (exclusive open).  For other schemes
the content is written under another name and renamed, which on HDFS is atomic
and fails if the name is taken; an object store without a conditional put is not
a safe home for concurrent writers.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_SCHEME = re.compile(r"^([a-z][a-z0-9+.-]*):", re.I)


@lru_cache(maxsize=4)
def _default_store(application: str) -> str:
    conf = SparkSession.getActiveSession().sparkContext._jsc.hadoopConfiguration()
    return (conf.get("fs.defaultFS") or "file:///").rstrip("/")


def normalise(uri: str) -> str:
    """One spelling for each location: no trailing slash, local paths absolute and without a scheme.

    A path without a scheme belongs to the cluster's default store, as for Spark.
    """
    m = _SCHEME.match(uri)
    spark = None if m else SparkSession.getActiveSession()
    if spark is not None:
        store = _default_store(spark.sparkContext.applicationId)
        if not store.startswith("file:"):
            return store + os.path.abspath(uri)
    if m and m[1].lower() != "file":
        return uri.rstrip("/")
    path = re.sub(r"^file:(//)?", "", uri, flags=re.I) if m else uri
    return os.path.abspath(path or "/")


def is_local(uri: str) -> bool:
    return not _SCHEME.match(uri) or uri.lower().startswith("file:")


def file_uri(path: str) -> str:
    """A path as Spark's ``_metadata.file_path`` spells it."""
    return "file:" + quote(path, safe="/:=@!$&'()*+,;~-._") if is_local(path) else path


def from_file_uri(uri: str) -> str:
    """The path that Spark's reader takes for a ``_metadata.file_path``."""
    return unquote(re.sub(r"^file:(//)?", "", uri)) if uri.startswith("file:") else uri


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs an active Spark session")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(path: str) -> str:
    if is_local(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    jvm, fs, p = _hadoop(path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(path: str, text: str) -> None:
    """Writes a file that must not exist; FileExistsError if another writer was first."""
    if is_local(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        # A reader never sees half a file: the content is linked to its name in one step.
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, path)
        finally:
            os.unlink(own)
        return
    jvm, fs, p = _hadoop(path)
    if fs.exists(p):
        raise FileExistsError(path)
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        won = fs.rename(own, p)
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        won = False
    if not won:
        fs.delete(own, False)
        raise FileExistsError(path)


def write_over(path: str, text: str) -> None:
    """Writes a file whatever was there."""
    if is_local(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(own, path)
        return
    _, fs, p = _hadoop(path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(path: str) -> bool:
    if is_local(path):
        return os.path.exists(path)
    _, fs, p = _hadoop(path)
    return fs.exists(p)


def delete(path: str) -> None:
    """Removes a file or a folder with all it holds; a missing one is fine."""
    if is_local(path):
        if os.path.isdir(path):
            import shutil

            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)
        return
    _, fs, p = _hadoop(path)
    fs.delete(p, True)


def list_files(folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified ms) of all files below a folder."""
    if is_local(folder):
        out = []
        for d, _, names in os.walk(folder):
            for n in names:
                st = os.stat(os.path.join(d, n))
                out.append((os.path.join(d, n), st.st_size, int(st.st_mtime * 1000)))
        return sorted(out)
    _, fs, p = _hadoop(folder)
    if not fs.exists(p):
        return []
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def working_folder(spark: SparkSession, what: str) -> str:
    """A new folder for tables that a query builds: in the cluster's shared folder, or a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="lakeloom-")
    folder = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # frames may still read it, so it goes when the application ends
    return normalise(fs.makeQualified(p).toString())
