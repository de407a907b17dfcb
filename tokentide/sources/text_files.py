"""A directory tree of text files as (path, text) rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokentide.functions.paths import ascii_lower
from tokentide.operators.ordering import with_running_total
from tokentide.session import materialize, ship_package


def normal_extensions(extensions: Sequence[str]) -> list[str]:
    """Extensions without leading dots, in ASCII lowercase."""
    return [
        "".join(c.lower() if c.isascii() else c for c in extension.lstrip(".")) for extension in extensions
    ]


def normal_path(path: str) -> str:
    """A relative path without ``.``, ``..``, empty or root components."""
    parts = PurePosixPath(path).parts
    return "/".join(part for part in parts if part not in ("/", ".", ".."))


_LOCATED = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/]*)?(.*)", re.DOTALL)


def _located(root: str) -> tuple[str, str, str]:
    """Scheme, authority (with its slashes) and path of a root; a local path is made absolute."""
    scheme, authority, path = _LOCATED.fullmatch(root).groups(default="")
    return scheme, authority, (path if scheme else os.path.abspath(root)).rstrip("/")


def relative_path(path: Column, root: str) -> Column:
    """``path`` of a scanned file below ``root``, with the scheme and authority removed."""
    base = re.escape(_located(root)[2])
    return F.regexp_replace(path, rf"^(?:[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?)?{base}/+", "")


def outside(path: Column, excludes: Sequence[str]) -> Column:
    """Whether a relative path is none of the excluded paths and lies below none of them."""
    kept = F.lit(True)
    for excluded in map(normal_path, excludes):
        kept = kept & (path != excluded) & ~F.startswith(path, F.lit(f"{excluded}/"))
    return kept


def keep_path(path: Column, extensions: Sequence[str], excludes: Sequence[str]) -> Column:
    """Whether a relative path has one of the extensions and lies below no excluded path.

    A name with only a leading dot has no extension; an empty list accepts all files.
    """
    kept = outside(path, excludes)
    if extensions:
        suffix = F.regexp_extract(ascii_lower(path), r"[^/]\.([^./]*)\z", 1)
        dotted = path.rlike(r"[^/]\.[^./]*\z")
        kept = kept & dotted & suffix.isin(normal_extensions(extensions))
    return kept


def is_hidden(path: Column) -> Column:
    """Whether a name on a relative path begins with ``.`` or ``_``, as Spark's own readers see it."""
    return path.rlike(r"(?:^|/)[._]")


def decoded(content: Column, path: Column) -> Column:
    """File content as text; invalid UTF-8 fails the job and names the file."""
    bad = F.raise_error(F.concat(F.lit("not valid UTF-8: "), path)).cast("string")
    return F.when(F.is_valid_utf8(content), content.cast("string")).otherwise(bad)


def read_text_files(
    spark: SparkSession, root: str, extensions: Sequence[str] = (), excludes: Sequence[str] = (), hidden: bool = True
) -> DataFrame:
    """All regular files below ``root`` as (path relative to it, text).

    Folders are listed in tasks, level by level, excluded ones are not entered, and files are
    read in tasks of like size, so the driver holds neither paths nor contents. Links, pipes and
    the like of a local tree are left out. Names that begin with ``.`` or ``_`` (``__init__.py``,
    say) are files like others; ``hidden=False`` leaves them out, below any root. A root of a
    scheme that only Spark can open never shows them, so it is refused unless ``hidden`` is False.
    """
    try:
        _open_root(root)
    except (pa.ArrowInvalid, OSError) as error:
        if hidden:
            raise ValueError(f"{root} can only be opened by Spark, which leaves out names with '.' or '_': pass hidden=False") from error
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        found = reader.load(root).select(relative_path(F.col("path"), root).alias("path"), "content")
        kept = found.where(keep_path(F.col("path"), extensions, excludes) & ~is_hidden(F.col("path")))
    else:
        listed = list_tree(spark, root, excludes).where(keep_path(F.col("path"), extensions, excludes))
        kept = _read_listed(listed if hidden else listed.where(~is_hidden(F.col("path"))), root)
    return kept.select("path", decoded(F.col("content"), F.col("path")).alias("text"))


def _open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and base path of a root given as a URI or a local path."""
    scheme, authority, path = _located(root)
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), path
    system, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}:{authority or '//'}/")
    return system, f"{base.rstrip('/')}{path}"


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(name, size, whether a folder) of the regular files and the folders in a folder."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, 0, True
                elif entry.is_file(follow_symlinks=False):
                    yield entry.name, entry.stat(follow_symlinks=False).st_size, False
        return
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            yield info.base_name, info.size or 0, info.type == fs.FileType.Directory


LISTED_ROWS = 10_000  # entries of a folder that are handed on at once


def list_tree(spark: SparkSession, root: str, excludes: Sequence[str] = ()) -> DataFrame:
    """(path relative to ``root``, size) of every file below it, one job per level of folders.

    Excluded folders are dropped between the levels, so nothing below them is asked for.
    """
    ship_package(spark)
    tasks = 4 * spark.sparkContext.defaultParallelism

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_root(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                entries = _entries(system, f"{base}/{folder}")
                while found := list(islice(entries, LISTED_ROWS)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{folder}/{name}".lstrip("/") for name, _, _ in found], pa.string()),
                            pa.array([size for _, size, _ in found], pa.int64()),
                            pa.array([is_folder for _, _, is_folder in found], pa.bool_()),
                        ],
                        ["path", "size", "folder"],
                    )

    folders, files = spark.range(1).select(F.lit("").alias("path")), None
    while files is None or not folders.isEmpty():
        dealt = folders.repartition(tasks, "path")
        level = materialize(dealt.mapInArrow(children, "path string, size long, folder boolean"), "folders")
        here = level.where("NOT folder").select("path", "size")
        files = here if files is None else files.unionByName(here)
        folders = level.where("folder").select("path").where(outside(F.col("path"), excludes))
    return files


# Bytes of files that one task reads, beside what the cores call for. A file costs a task a
# little whatever its size.
TASK_BYTES, FILE_BYTES = 128 << 20, 64 << 10


def _packed(listed: DataFrame, total: int, tasks: int) -> DataFrame:
    """Listed files with the number of the task that reads each, consecutive ones in a task.

    Files are cut into runs of an equal part of all bytes, so a task reads at most that and
    the file that the cut falls into.
    """
    weighed = with_running_total(listed, ["path"], F.col("size") + FILE_BYTES, name="_before")
    return weighed.withColumn("_task", F.least(F.floor(F.col("_before") * tasks / total), F.lit(tasks - 1)).cast("int"))


def _read_listed(listed: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files, read in tasks of about equal numbers of bytes."""
    spark = listed.sparkSession

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_root(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path], pa.string()), pa.array([stream.read()], pa.binary())], ["path", "content"]
                    )

    total, files = listed.agg(F.sum(F.col("size") + FILE_BYTES), F.count(F.lit(1))).first()
    tasks = max(1, min(files, max(2 * spark.sparkContext.defaultParallelism, (total or 0) // TASK_BYTES)))
    dealt = _packed(listed, total or 1, tasks).repartitionById(tasks, F.col("_task"))
    return dealt.select("path").mapInArrow(contents, "path string, content binary")
