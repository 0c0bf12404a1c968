"""File names and scratch space, through Hadoop's file system so object stores work."""

import re
import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, SparkSession, functions as F

MAGIC = re.compile(r"[*?\[]")


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_name() -> Column:
    """Base name of the scanned file; Spark reports it URL-encoded (but leaves plus signs)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def is_absolute(name: str) -> bool:
    return name.startswith("/") or "://" in name or name.startswith("file:")


def _pattern(glob: str) -> re.Pattern:
    """Regular expression of a shell pattern; ``**/`` stands for any number of folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out + r"\Z")


def list_files(spark: SparkSession, name: str) -> list[str]:
    """Files a path or glob stands for, sorted; folders are left out."""
    fs = _fs(spark, name)
    if "**" in name:
        root = name[: MAGIC.search(name).start()].rpartition("/")[0] or "/"
        if not fs.exists(_path(spark, root)):
            return []
        wanted = _pattern(_path(spark, root).toUri().getPath().rstrip("/") + name[len(root.rstrip("/")) :])
        found, it = [], fs.listFiles(_path(spark, root), True)
        while it.hasNext():
            status = it.next()
            if wanted.match(status.getPath().toUri().getPath()):
                found.append(status)
    elif MAGIC.search(name):
        found = [s for s in (fs.globStatus(_path(spark, name)) or []) if s.isFile()]
    else:
        path = _path(spark, name)
        found = [s for s in [fs.getFileStatus(path)] if s.isFile()] if fs.exists(path) else []
    return sorted(s.getPath().toString() for s in found)


def exists(spark: SparkSession, name: str) -> bool:
    return _fs(spark, name).exists(_path(spark, name))


def matches_something(spark: SparkSession, name: str) -> bool:
    if "**" in name:
        return bool(list_files(spark, name))
    if MAGIC.search(name):
        return bool(_fs(spark, name).globStatus(_path(spark, name)))
    return exists(spark, name)


def canonical_uri(spark: SparkSession, name: str) -> str:
    """Fully qualified, encoded name, as a scan reports it (``file:/`` with one slash)."""
    return re.sub("^file:/+", "file:/", _fs(spark, name).makeQualified(_path(spark, name)).toUri().toString())


def _first_sign(spark: SparkSession, name: str) -> str:
    path = _path(spark, name)
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()
    ).getCodec(path)
    opened = _fs(spark, name).open(path)
    stream = codec.createInputStream(opened) if codec else opened
    try:
        byte = stream.read()
        while byte >= 0 and byte in b" \t\r\n\xef\xbb\xbf":  # white space and a byte-order mark
            byte = stream.read()
        return chr(byte) if byte >= 0 else ""
    finally:
        stream.close()


def first_signs(spark: SparkSession, names: list[str]) -> list[str]:
    """First sign of each file that is no white space; ``""`` if there is none. Reads a few bytes of each."""
    with ThreadPool(min(32, len(names) or 1)) as pool:
        return pool.map(lambda name: _first_sign(spark, name), names)


def move(spark: SparkSession, name: str, to: str) -> bool:
    return _fs(spark, name).rename(_path(spark, name), _path(spark, to))


def delete(spark: SparkSession, name: str) -> bool:
    return _fs(spark, name).delete(_path(spark, name), True)


#: Folders of sessions without a checkpoint folder, by application.
_own_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name in the shared checkpoint folder of the cluster.

    Only a local session without one gets a folder of its own; elsewhere
    executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        root = _own_roots[app]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
