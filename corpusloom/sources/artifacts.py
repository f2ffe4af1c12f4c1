"""Artifacts as files: one text file for each run at its key, written, listed and read by the tasks themselves.

`write_files` hands rows (key, text) to a data source writer. Keys are checked before any file is written, then rows are
dealt out by key. A task stages each file under `_staging` beside the target
and moves its files to their keys when it has read all its rows, so a task that fails leaves none and a task that is run
again, or twice at once, leaves the same files. The driver gets a count from each task, never keys or texts.

`list_files` walks the folders in tasks too, in rounds: a task stops after `WALK` entries, and the folders that it has not
opened are dealt out again. Spark's own readers would list millions of files on the driver.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import cut

FORMAT = "artifact_files"
STAGING = "_staging"
# Entries that a task looks at in one round of a listing, and files and bytes that a reader hands over at once.
WALK, READ_FILES, READ_BYTES = 20_000, 1_000, 16_000_000
_BAD_KEY = rf"(?:^|/)(?:|\.|\.\.|{STAGING})(?:/|$)"


@dataclass
class Written(WriterCommitMessage):
    files: int


def key_problem(key: str | None) -> str | None:
    """Why a key names no file below the target."""
    if not key:
        return "an artifact needs a key"
    if re.search(_BAD_KEY, key):
        return f"not a key below the target: {key!r}"
    return None


def _checked(key: Column) -> Column:
    """The key, or the error that `key_problem` names."""
    bad = F.concat(F.lit("not a key below the target: "), key)
    return (F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("an artifact needs a key")).cast("string"))
            .when(key.rlike(_BAD_KEY), F.raise_error(bad).cast("string")).otherwise(key))


def _store(path: str):
    """The file system of a path and the path in it; one without a scheme is a local one."""
    from pyarrow import fs

    path = path.rstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        own = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        keys: list[str] = []
        store.create_dir(own, recursive=True)
        try:
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if problem := key_problem(key):
                        raise ValueError(problem)
                    with store.open_output_stream(f"{own}/{len(keys)}") as out:
                        out.write((text or "").encode())
                    keys.append(key)
            for folder in {k.rpartition("/")[0] for k in keys} - {""}:
                store.create_dir(f"{root}/{folder}", recursive=True)
            for i, key in enumerate(keys):
                store.move(f"{own}/{i}", f"{root}/{key}")
        finally:
            store.delete_dir(own)
        return Written(len(keys))

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")


class ArtifactFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArtifactWriter(self.options["path"])


def _tasks(spark: SparkSession) -> int:
    """Files cost by their number, not by their bytes, so their rows are dealt out to all partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_files(df: DataFrame, path: str, key: str, text: str) -> None:
    """Write each row's text to `path`/key in UTF-8; a null text is an empty file, a key that leaves the target an error.
    Rows that share a key write one file, any of their texts."""
    df.sparkSession.dataSource.register(ArtifactFiles)
    rows = df.select(_checked(F.col(key).cast("string")).alias("key"), F.col(text).cast("string").alias("text"))
    rows.repartition(_tasks(df.sparkSession), "key").write.format(FORMAT).mode("append").save(path)


def _name_pattern(pattern: str) -> re.Pattern:
    """A file name pattern with *, ?, [] and {a,b}."""
    parts = re.split(r"\{([^{}]*)\}", pattern)  # every second one stood in braces
    plain = [fnmatch.translate(p.replace("[^", "[!")).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") for p in parts]
    either = ["(?:" + "|".join(map(re.escape, p.split(","))) + ")" for p in parts]
    return re.compile("(?s:" + "".join(either[i] if i % 2 else plain[i] for i in range(len(parts))) + ")")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _walk(path: str, pattern: str, most: int, batches: Iterator) -> Iterator:
    """The files below the folders of a task, and the folders that are left after `most` entries."""
    import pyarrow as pa
    from pyarrow import fs

    (store, root), wanted, seen = _store(path), _name_pattern(pattern), 0
    left = deque(f for batch in batches for f in batch.column(0).to_pylist())
    rows: list[tuple] = []
    types = [("key", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64()), ("modified", pa.int64())]

    def found() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])

    while left and seen < most:
        below = left.popleft()
        entries = store.get_file_info(fs.FileSelector(f"{root}/{below}" if below else root))
        seen += len(entries) + 1
        for e in entries:
            if _hidden(e.base_name):
                continue
            key = f"{below}/{e.base_name}" if below else e.base_name
            if e.type == fs.FileType.Directory:
                left.append(key)
            elif e.size and wanted.fullmatch(e.base_name):
                rows.append((key, False, e.size, e.mtime_ns // 1_000_000))
        if len(rows) >= READ_FILES:
            yield found()
            rows = []
    rows += [(f, True, None, None) for f in left]
    yield found()


def list_files(spark: SparkSession, path: str, pattern: str = "*", walk: int = WALK) -> DataFrame:
    """(key, bytes, modified) of the files below `path` whose name matches `pattern` (*, ?, [] and {a,b}), contents unread.
    Files without a byte are not listed, nor names that start with . or _. The entries of one folder are held by one task."""
    rounds, folders = [], spark.range(1).select(F.lit("").alias("key"))
    while True:
        listed = cut(folders.mapInArrow(lambda batches: _walk(path, pattern, walk, batches), "key string, folder boolean, bytes bigint, modified bigint"))
        rounds.append(listed.where(~F.col("folder")))
        rest = listed.where("folder").select("key")
        if rest.isEmpty():
            break
        folders = rest.repartition(_tasks(spark), "key")
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files.select("key", "bytes", F.timestamp_millis("modified").alias("modified"))


def _read(path: str, batches: Iterator) -> Iterator:
    """(key, bytes) of the files that the rows name, some at a time."""
    import pyarrow as pa

    store, root = _store(path)
    keys: list[str] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key in batch.column(0).to_pylist():
            with store.open_input_file(f"{root}/{key}") as file:
                texts.append(file.read())
            keys.append(key)
            size += len(texts[-1])
            if len(keys) >= READ_FILES or size >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.binary())], names=["key", "bytes"])
                keys, texts, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.binary())], names=["key", "bytes"])


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, text) of the files that `list_files` names, each a row; files without a byte have none."""
    named = list_files(spark, path, pattern).select("key").repartition(_tasks(spark), "key")
    return named.mapInArrow(lambda batches: _read(path, batches), "key string, bytes binary").select("key", F.col("bytes").cast("string").alias("text"))


def file_path() -> Column:
    """The path of a row's file, as the file system spells it; the metadata column holds it encoded as an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def list_data(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The columns of `list_files` by Spark's own reader, for tables in any store that Spark reads. It lists on the driver."""
    root = path.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(_below(F.col("path"), root).alias("key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _below(path: Column, root: str) -> Column:
    """The part of a file's path below `root`, which may be given with or without a scheme."""
    name = root.partition("://")[2] or root.removeprefix("file:")
    name = "/" + name.lstrip("/").rstrip("/") + "/"
    return F.substring_index(path, name, -1)
