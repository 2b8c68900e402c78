"""Two data source formats: ``page_dump`` reads dumps of pages by byte ranges, ``result_lines`` streams results to NDJSON files.

``register(spark)`` makes them known to a session; then ``spark.read.format("page_dump")`` and
``df.writeStream.format("result_lines")`` work as any other. Paths may be on any file system that pyarrow reaches (local and
mounted disks, HDFS, object stores), from the driver and the executors alike.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a range, bytes read at once, rows of a batch.
RANGE_BYTES, STEP_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 512
PAGE = "url string, html string, text string, title string, http_status int, status string, crawled_at string, error string"


def _place(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


@dataclass
class ByteRange(InputPartition):
    """Lines that begin at ``start`` or later, and before ``end``, belong to the range."""

    path: str
    start: int
    end: int


def lines_of(file, start: int, end: int) -> Iterator[bytes]:
    """The lines of a seekable file that begin in [start, end), whole; the last may go on beyond it."""
    at = start
    if start:
        file.seek(start - 1)  # a line begins at ``start`` if the byte before ends one
        at = start - 1
    else:
        file.seek(0)
    held, first = b"", bool(start)
    while True:
        more = file.read(STEP_BYTES)
        held += more
        *whole, rest = held.split(b"\n")
        for line in whole:
            begins, at = at, at + len(line) + 1
            if first:
                first = False
                continue
            if begins >= end:
                return
            yield line
        held = rest
        if not more:
            if held and not first and at < end:
                yield held
            return


class PageDumpReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields, self.path, self.size = [f.name for f in schema], options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.schema = schema

    def partitions(self):
        system, path = _place(self.path)
        told = system.get_file_info(path)
        found = system.get_file_info(afs.FileSelector(path, recursive=True)) if told.type == afs.FileType.Directory else [told]
        if told.type == afs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        kept = [i for i in found if i.type == afs.FileType.File and not i.base_name.startswith((".", "_"))]
        return [ByteRange(i.path, a, min(i.size, a + self.size)) for i in sorted(kept, key=lambda i: i.path) for a in range(0, i.size, self.size)]

    def read(self, partition):
        system, _ = _place(self.path)
        shape, rows = to_arrow_schema(self.schema), []
        with system.open_input_file(partition.path) as file:
            for line in lines_of(file, partition.start, partition.end):
                if line.strip():
                    rows.append(self._page(line))
                if len(rows) == BATCH_ROWS:
                    yield self._batch(rows, shape)
                    rows = []
        if rows:
            yield self._batch(rows, shape)

    def _bad(self) -> dict:
        return {f: {"status": "error", "error": "bad_line"}.get(f) for f in self.fields}

    def _page(self, line: bytes) -> dict:
        """A line's fields by the schema; a line that is no object is an error row."""
        try:
            said = json.loads(line)
        except ValueError:
            said = None
        return {f: said.get(f) for f in self.fields} if isinstance(said, dict) else self._bad()

    def _batch(self, rows: list[dict], shape: pa.Schema) -> pa.RecordBatch:
        """The rows as the schema has them; one whose fields don't fit it is an error row."""
        try:
            return pa.RecordBatch.from_pylist(rows, shape)
        except (ValueError, TypeError, pa.ArrowException):
            if len(rows) == 1:
                return pa.RecordBatch.from_pylist([self._bad()], shape)
            parts = [self._batch([r], shape) for r in rows]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class PageDump(DataSource):
    """NDJSON dumps of pages, a file or a folder, cut in ranges of ``rangeBytes``; the schema is the fetch envelope's unless one is given."""

    @classmethod
    def name(cls):
        return "page_dump"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return PageDumpReader(schema, self.options)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, and what the summaries need of it."""

    name: str
    counts: dict


class ResultLinesWriter(DataSourceStreamWriter):
    """Each task writes its lines aside; a batch's commit moves the files of the tasks that counted to their place and adds the summaries.

    A file of a task that failed, or ran twice, is named by no message and never gets there; a batch that is committed again
    (after a restart) gives the same file names, and what is there already stays.
    """

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        system, path = _place(self.path)
        system.create_dir(f"{path}/_aside", recursive=True)
        name, counts = uuid.uuid4().hex, {}
        with system.open_output_stream(f"{path}/_aside/{name}") as out:
            for r in iterator:
                out.write(r["value"].encode() + b"\n")
                counts.setdefault(r["query"], Counter()).update(["attempted", {"ok": "success", "blocked": "blocked"}.get(r["status"], "other")])
        return Written(name, counts)

    def commit(self, messages, batchId) -> None:
        system, path = _place(self.path)
        folder, told = f"{path}/batch={batchId}", [m for m in messages if m is not None]
        if system.get_file_info(f"{folder}/_SUCCESS").type == afs.FileType.File:
            self._forget(system, path, told)
            return
        if system.get_file_info(folder).type == afs.FileType.Directory:  # a commit that did not end
            system.delete_dir(folder)
        system.create_dir(folder, recursive=True)
        total: dict[str, Counter] = {}
        for k, m in enumerate(told):
            if m.counts:
                system.copy_file(f"{path}/_aside/{m.name}", f"{folder}/part-{k:05d}.ndjson")
            for query, n in m.counts.items():
                total.setdefault(query, Counter()).update(n)
        with system.open_output_stream(f"{folder}/summary.ndjson") as out:
            for query in sorted(total, key=str):
                line = {"type": "summary", "data": {k: total[query][k] for k in ("attempted", "success", "blocked")}}
                out.write(json.dumps(line, separators=(",", ":")).encode() + b"\n")
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass
        self._forget(system, path, told)

    def abort(self, messages, batchId) -> None:
        system, path = _place(self.path)
        self._forget(system, path, [m for m in messages if m is not None])

    def _forget(self, system, path, told) -> None:
        for m in told:
            aside = f"{path}/_aside/{m.name}"
            if system.get_file_info(aside).type == afs.FileType.File:
                system.delete_file(aside)


class ResultLines(DataSource):
    """Lines (query, status, value) to ``path``: a folder for each batch, with the lines in parts and a summary line for each query."""

    @classmethod
    def name(cls):
        return "result_lines"

    def streamWriter(self, schema, overwrite):
        return ResultLinesWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageDump)
    spark.dataSource.register(ResultLines)


def result_rows(results: DataFrame, query_col: str = "query") -> DataFrame:
    """query, status, value of each result (query, retailer_key, status, ...): what ``result_lines`` writes. Nothing is shuffled or sorted."""
    line = F.to_json(F.struct(F.lit("retailer").alias("type"), F.struct(*results.columns).alias("data")))
    return results.select(F.col(query_col).alias("query"), "status", line.alias("value"))
