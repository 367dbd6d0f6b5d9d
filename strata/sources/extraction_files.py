"""Extraction files, one JSON-lines file ``<stem>_gemini.jsonl`` for each source, as a Spark data source
(SRC1, SNK2).

Reading gives every non-blank line with its file name and line number; files are packed into partitions
by size. Writing streams the lines of a task, sorted by stem, into files under the name of the attempt
and renames them when the task is done: a reader never sees half a file, a repeated attempt
replaces a file by the same content, and what a failed attempt left lies outside the glob and is
removed at the end. The job's commit adds ``_SUCCESS``.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import constants as K

FORMAT = "strata_extraction_files"
SCHEMA = "file_name string, line_no long, line string"
PARTITION_BYTES = 64 << 20
FILE_BYTES = 1 << 15            # what opening a file counts as, at least: a task takes up to 2,048 small files
ROWS = 1024                     # lines of one Arrow batch
ATTEMPTS = "_attempts"

_LINES = pa.schema([("file_name", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    names: list


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, glob: str):
        self.path, self.glob = path, glob

    def partitions(self):
        from pyarrow import fs
        files, root = _open(self.path)
        found = sorted((f.base_name, f.size or 0) for f in files.get_file_info(fs.FileSelector(root))
                       if f.is_file and fnmatch.fnmatchcase(f.base_name, self.glob))
        out, size = [], 0
        for name, n in found:
            if not out or size >= PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(name)
            size += max(n, FILE_BYTES)
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition):
        files, root = _open(self.path)
        rows = []
        for base in partition.names:
            with files.open_input_stream(f"{root}/{base}") as raw:
                for n, line in enumerate(io.BufferedReader(raw), 1):
                    text = line.decode("utf-8", "replace").rstrip("\r\n")
                    if text.strip():
                        rows.append((base, n, text))
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LINES.types)], schema=_LINES)


class _Writer(DataSourceArrowWriter):
    """Rows (stem, line), the rows of a stem one after the other."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext
        files, root = _open(self.path)
        mine = f"{root}/{ATTEMPTS}/{self.job}/{TaskContext.get().taskAttemptId()}"
        done, stem, out = [], None, None
        for batch in iterator:
            for s, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != stem:
                    if out:
                        out.close()
                    else:
                        files.create_dir(mine, recursive=True)
                    stem = s
                    done.append(f"{stem}{K.EXTRACTION_SUFFIX}")
                    out = files.open_output_stream(f"{mine}/{done[-1]}")
                out.write(line.encode("utf-8") + b"\n")
        if out:
            out.close()
        for name in done:  # whole files from here on; a name belongs to one task
            if files.get_file_info(f"{root}/{name}").is_file:
                files.delete_file(f"{root}/{name}")
            files.move(f"{mine}/{name}", f"{root}/{name}")
        return _Written(len(done))

    def _clean(self):
        from pyarrow import fs
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{ATTEMPTS}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")

    def commit(self, messages):
        self._clean()
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        self._clean()


class ExtractionFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("glob", K.EXTRACTION_GLOB))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are replaced source by source: use mode append")
        return _Writer(self.options["path"])


def read_lines(spark: SparkSession, path: str, glob: str = K.EXTRACTION_GLOB) -> DataFrame:
    """(file_name, line_no, line) of the matching files directly under ``path``."""
    spark.dataSource.register(ExtractionFiles)
    return spark.read.format(FORMAT).option("glob", glob).load(path)


def write_files(lines: DataFrame, path: str, stem_col: str = "stem", line_col: str = "line",
                order_col: str | None = None) -> str:
    """SNK2: write ``line_col`` into one file for each stem (a null one is ``unnamed``), ordered by
    ``order_col``. A file that is there already is replaced."""
    lines.sparkSession.dataSource.register(ExtractionFiles)
    order = [F.col(order_col)] if order_col else []
    rows = lines.select(F.coalesce(F.col(stem_col), F.lit("unnamed")).alias("stem"), F.col(line_col).alias("line"), *order)
    (rows.repartition("stem").sortWithinPartitions("stem", *order).select("stem", "line")
     .write.format(FORMAT).mode("append").save(path))
    return path
