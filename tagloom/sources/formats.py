"""Data sources: response files and number lists to read, trees of text files to write.

``register_formats(spark)`` makes them known to ``spark.read.format``, ``readStream.format`` and ``write.format``:

* ``publication_xml``, ``search_page_xml``, ``fulltext_parts_xml``, ``description_xml``, ``claims_xml``, ``drawings_xml``: a file is
  one response. Columns: file, those of the parser, error. A response that can't be read is a row with its file and error
  (``mode`` PERMISSIVE), is left out (DROPMALFORMED) or ends the job (FAILFAST). ``lang`` chooses the language of texts.
* ``number_list``: the lines of text files that aren't blank, as a table or a stream of the files that arrive.
* ``text_files``: rows (path, text) to one file each, exactly at that path, all or none.

Paths are those that Arrow reads: local ones and file, hdfs, s3 and gs addresses. A partition is a group of
whole files of about ``partition_bytes``; hidden files are left out. A schema with some of the columns is read as such.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..operators.kept import kept
from . import files

PARTITION_BYTES = 16 << 20
OPEN_BYTES = 16 << 10  # that opening a file counts for
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        path = "file://" + posixpath.abspath(path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))


def listed(path: str) -> list[fs.FileInfo]:
    """Files at or under a path, by name."""
    system, place = file_system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    inside = len(place.rstrip("/")) + 1
    return sorted(
        (f for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[inside:].split("/"))), key=lambda f: f.path
    )


@dataclass
class Files(InputPartition):
    """Some files: the number of the first among all, and their places."""

    first: int
    places: list[str]


def grouped(found: list[fs.FileInfo], limit: int) -> list[Files]:
    out: list[Files] = []
    held = limit
    for i, f in enumerate(found):
        if held + f.size + OPEN_BYTES > limit:
            out.append(Files(i, []))
            held = 0
        out[-1].places.append(f.path)
        held += f.size + OPEN_BYTES
    return out


def _option(options: dict, name: str, default: str) -> str:
    return {k.lower(): v for k, v in options.items()}.get(name, default)


class _FileReader(DataSourceReader):
    """Rows of dictionaries from whole files."""

    def __init__(self, options: dict, schema: StructType, rows: Callable[[int, str, io.BufferedIOBase, dict], Iterator[dict]]):
        self.path = _option(options, "path", "")
        if not self.path:
            raise ValueError("a path is needed: load(path)")
        self.mode = _option(options, "mode", "PERMISSIVE").upper()
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        self.limit = int(_option(options, "partition_bytes", str(PARTITION_BYTES)))
        self.options, self.names, self.rows = dict(options), schema.names, rows

    def partitions(self) -> list[Files]:
        return grouped(listed(self.path), self.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for i, place in enumerate(partition.places):
            try:
                with system.open_input_stream(place) as source:
                    # a response is good as a whole or not at all
                    found = list(self.rows(partition.first + i, place, source, self.options))
            except (ET.ParseError, ValueError, TypeError) as e:
                if self.mode == "FAILFAST":
                    raise
                found = [{"error": str(e) or type(e).__name__}] if self.mode == "PERMISSIVE" else []
            for row in found:
                row["file"] = place
                yield tuple(row.get(n) for n in self.names)


class _Responses(DataSource):
    NAME, COLUMNS = "", ""

    @classmethod
    def name(cls) -> str:
        return cls.NAME

    def schema(self) -> str:
        return f"file string, {self.COLUMNS}, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FileReader(self.options, schema, self.rows)

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        raise NotImplementedError


class PublicationXml(_Responses):
    NAME = "publication_xml"
    COLUMNS = files._PUBLICATION.removeprefix("id bigint, ").removesuffix(", error string")

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        # element by element, so that a long response is never a whole tree
        for _, e in ET.iterparse(source):
            if files._name(e) == "exchange-document":
                yield files.publication(e)
                e.clear()


class SearchPageXml(_Responses):
    NAME, COLUMNS = "search_page_xml", "total bigint"

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        yield {"total": files.search_total(ET.parse(source).getroot())}


class FulltextPartsXml(_Responses):
    NAME, COLUMNS = "fulltext_parts_xml", "lang string, part string"

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        yield from files.fulltext_parts(ET.parse(source).getroot())


class DescriptionXml(_Responses):
    NAME, COLUMNS = "description_xml", "lang string, text string"

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        lang = _option(options, "lang", "en")
        yield {"lang": lang, "text": files.description_text(ET.parse(source).getroot(), lang)}


class ClaimsXml(_Responses):
    NAME, COLUMNS = "claims_xml", "lang string, text string"

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        lang = _option(options, "lang", "en")
        yield {"lang": lang, "text": files.claims_text(ET.parse(source).getroot(), lang)}


class DrawingsXml(_Responses):
    NAME, COLUMNS = "drawings_xml", "desc string, link string, pages bigint"

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        yield from files.images(ET.parse(source).getroot())


def _numbers(number: int, place: str, source, options: dict) -> Iterator[dict]:
    for line, text in enumerate(io.TextIOWrapper(source, "utf-8-sig", "replace")):
        if text.strip():
            yield {"line_no": (number << 33) + line, "input_raw": text.strip()}


class NumberList(DataSource):
    """file, line_no (by file name and line), input_raw."""

    @classmethod
    def name(cls) -> str:
        return "number_list"

    def schema(self) -> str:
        return "file string, line_no bigint, input_raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FileReader(self.options, schema, _numbers)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _NumberStream(self.options, schema)


class _NumberStream(DataSourceStreamReader):
    """Files as they arrive, each once, in the order of their times and names; files are moved in whole and not changed."""

    def __init__(self, options: dict, schema: StructType):
        self.own = _FileReader(options, schema, _numbers)

    def _found(self) -> list[tuple[int, str, fs.FileInfo]]:
        try:
            return sorted((f.mtime_ns or 0, f.path, f) for f in listed(self.own.path))
        except FileNotFoundError:
            return []

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._found()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return grouped([f for t, p, f in self._found() if after < (t, p) <= upto], self.own.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.own.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class TextFiles(DataSource):
    """Rows (path, text): a file at every path under the folder that is saved to; read back with whole paths."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FileReader(self.options, schema, self.rows)

    @staticmethod
    def rows(number: int, place: str, source, options: dict) -> Iterator[dict]:
        yield {"path": place, "text": source.read().decode("utf-8", "surrogatepass")}

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _TextFilesWriter(self.options, schema, overwrite)


class _TextFilesWriter(DataSourceWriter):
    """Tasks write into folders of their attempts; the commit moves what the successful ones wrote, an abort deletes all.

    A path that is absolute, leaves the folder, or is written twice by one task fails it; one that exists already, or that two tasks
    wrote, fails the commit before anything moves. The commit lists one task's files at a time.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.root = _option(options, "path", "").rstrip("/")
        if not self.root:
            raise ValueError("a path is needed: save(path)")
        if not {"path", "text"} <= set(schema.names):
            raise ValueError("the columns path and text are needed")
        self.at = (schema.names.index("path"), schema.names.index("text"))
        self.overwrite = overwrite
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        context = TaskContext.get()
        system, folder = file_system(f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}")
        made: set[str] = set()
        n = 0
        try:
            for row in iterator:
                path, text = row[self.at[0]], row[self.at[1]]
                clean = _clean(path)
                target = f"{folder}/{clean}"
                above = posixpath.dirname(target)
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    raise ValueError(f"two texts for {path}")
                with system.open_output_stream(target) as out:
                    out.write((text or "").encode("utf-8", "surrogatepass"))
                n += 1
        except BaseException:
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                system.delete_dir(folder)
            raise
        return Staged(folder, n)

    def _staged(self, message: Staged) -> list[str]:
        system, _ = file_system(self.root)
        if not message.files:
            return []
        found = system.get_file_info(fs.FileSelector(message.folder, recursive=True))
        return [f.path[len(message.folder) + 1 :] for f in found if f.type == fs.FileType.File]

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = file_system(self.root)
        done = [m for m in messages if m is not None]
        if self.overwrite and system.get_file_info(root).type != fs.FileType.NotFound:
            keep = posixpath.basename(self.staging)
            for info in system.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(info.path) != keep:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        with ThreadPoolExecutor(16) as pool:
            seen: set[int] = set()  # a number a file

            def free(name: str) -> bool:
                return system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound

            for m in done:
                names = self._staged(m)
                numbers = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=12).digest()) for n in names]
                taken = [n for n, k, ok in zip(names, numbers, pool.map(free, names), strict=True) if k in seen or not ok]
                if taken:
                    raise FileExistsError(f"{taken[0]} is there already")
                seen.update(numbers)
            made: set[str] = set()
            for m in done:
                names = self._staged(m)
                for above in {posixpath.dirname(n) for n in names} - made:
                    system.create_dir(f"{root}/{above}", recursive=True)
                    made.add(above)
                list(pool.map(lambda n, m=m: system.move(f"{m.folder}/{n}", f"{root}/{n}"), names))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = file_system(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


FORMATS = (PublicationXml, SearchPageXml, FulltextPartsXml, DescriptionXml, ClaimsXml, DrawingsXml, NumberList, TextFiles)


def register_formats(spark: SparkSession) -> None:
    for source in FORMATS:
        spark.dataSource.register(source)


def read_publications(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per publication of the response files at or under a path."""
    register_formats(spark)
    return spark.read.format("publication_xml").option("mode", mode).load(path)


def read_search_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, total, error; publications) of search response files."""
    register_formats(spark)
    return spark.read.format("search_page_xml").load(path), read_publications(spark, path)


def read_texts(spark: SparkSession, path: str, part: str, lang: str) -> DataFrame:
    """file, lang, text, error of full-text response files; ``part`` is description or claims."""
    register_formats(spark)
    return spark.read.format(f"{part}_xml").option("lang", lang).load(path)


def _clean(path: str | None) -> str:
    """The path inside the folder that is written to."""
    clean = posixpath.normpath(path or "")
    if clean in (".", "..") or clean.startswith(("/", "../", "_staging-")):
        raise ValueError(f"not a path inside the folder: {path}")
    return clean


def _stage(staging: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write each text to a numbered file of this attempt: path, and where its text lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, folder = file_system(f"{staging}/{context.partitionId()}-{context.taskAttemptId()}")
        n = 0
        for batch in batches:
            if not n and batch.num_rows:
                system.create_dir(folder, recursive=True)
            paths, places = [], []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                paths.append(_clean(path))
                places.append(f"{folder}/{n}")
                n += 1
                with system.open_output_stream(places[-1]) as out:
                    if text.is_valid:
                        out.write(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.string())], names=["path", "place"])

    return run


def _move(root: str, really: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The paths that can't be made as there is something already, or (``really``) move the texts to theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(root)
        made: set[str] = set()
        for batch in batches:
            there = []
            for path, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{folder}/{path}"
                if not really:
                    if system.get_file_info(target).type != fs.FileType.NotFound:
                        there.append(path)
                    continue
                above = posixpath.dirname(target)
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made = made if len(made) < 10_000 else set()
                    made.add(above)
                try:
                    system.move(place, target)
                except FileNotFoundError:
                    # an attempt before this one has moved it
                    if system.get_file_info(target).type != fs.FileType.File:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], names=["path"])

    return run


def write_text_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (path, text), each to its own file, all or none; paths that exist or come twice are an error.

    Tasks write numbered files; once all are there and no path is taken, tasks move them to their paths. The driver handles no file.
    """
    register_formats(rows.sparkSession)
    system, root = file_system(path)
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        staged = kept(rows.select("path", "text").repartition("path").mapInArrow(_stage(staging), "path string, place string"))
        taken = staged.groupBy("path").count().where("count > 1").select("path")
        if not overwrite and system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            taken = taken.unionByName(staged.mapInArrow(_move(path, False), "path string"))
        bad = taken.first()
        if bad is not None:
            raise PySparkException(f"{bad.path} is there already, or comes twice")
        if overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if posixpath.basename(info.path) != posixpath.basename(staging):
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        staged.mapInArrow(_move(path, True), "path string").foreach(lambda row: None)
    finally:
        _, place = file_system(staging)
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_dir(place)
