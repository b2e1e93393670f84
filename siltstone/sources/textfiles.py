"""A sink of texts as files, one a row (SNK-20, 27, 37): ``df.write.format("textfiles").mode("append").save(folder)``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship_code

SCHEMA = "name string, text string"
_PENDING = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder below the job's, the partition, and the number of files."""

    folder: str
    partition: int
    files: int


class TextFilesWriter(DataSourceArrowWriter):
    """Tasks write to folders of their own; the commit moves one folder a task, so its work doesn't grow with the rows."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root, f"{root}/{_PENDING}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, pending = self._places()
        context, attempt, n = TaskContext.get(), uuid.uuid4().hex, 0
        folder = f"{pending}/{attempt}"
        system.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for batch in iterator:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                name, text = name.as_py(), text.as_py()
                if not name or name[0] in "._" or "/" in name or "\0" in name:
                    raise ValueError(f"not the name of a file that readers see: {name!r}")
                if name in seen:
                    raise ValueError(f"two rows are named {name!r}")
                seen.add(name)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write((text or "").encode())
                n += 1
        return Written(attempt, context.partitionId() if context else 0, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, pending = self._places()
        for m in messages:
            if m is not None and m.files:
                system.move(f"{pending}/{m.folder}", f"{root}/part-{m.partition:05d}-{self.job}")
        self._forget(system, pending)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, pending = self._places()
        self._forget(system, pending)

    @staticmethod
    def _forget(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class TextFiles(DataSource):
    """Rows of ``name`` and ``text`` as UTF-8 files in folders ``part-*``, one folder a task.

    A task that fails, is repeated or is run twice leaves no file that a reader
    sees: only the folders that the commit names are moved out of ``_temporary``,
    and a job that fails removes its own. A null text is an empty file, an empty
    table writes none. A name that is null, empty, holds a slash or begins with a
    dot or underscore fails the job, and so do equal names in a task
    (``free_names.unique_names`` makes them unique). Files of earlier jobs stay;
    overwriting is refused. The folder is any that ``pyarrow.fs`` opens and all
    executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> TextFilesWriter:
        if overwrite:
            raise ValueError("textfiles only appends")
        return TextFilesWriter(self.options["path"])


def write_texts(rows: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """The texts of ``rows`` as files below ``folder``; other columns are dropped."""
    spark = rows.sparkSession
    spark.dataSource.register(TextFiles)
    rows.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text")).write.format("textfiles").mode("append").save(folder)


#: Tasks that read a folder of a writer's task, and bytes of texts that they hand on at once, about.
READERS, BATCH_BYTES = 4, 4 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each row's folder whose places among its names are ``nth`` modulo READERS."""
    schema = pa.schema([("name", pa.string()), ("text", pa.string())])
    for t in batches:
        for folder, nth in zip(t.column("folder").to_pylist(), t.column("nth").to_pylist(), strict=True):
            system, path = fs.FileSystem.from_uri(folder)
            files = sorted((f.base_name, f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.size)
            names, texts, held = [], [], 0
            for name, place in files[nth::READERS]:
                if name[0] in "._":
                    continue
                with system.open_input_stream(place) as f:
                    body = f.read()
                names.append(name)
                texts.append(body.decode("utf-8", "replace"))
                held += len(body)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"name": names, "text": texts}, schema)
                    names, texts, held = [], [], 0
            yield pa.RecordBatch.from_pydict({"name": names, "text": texts}, schema)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` and ``text`` of the files that ``write_texts`` left in a folder; files without a byte are left out.

    The driver lists the folders of the writer's tasks only, whose files are listed
    and read by tasks: Spark's own reader lists every file on the driver and puts
    few of them into a task, however small they are.
    """
    ship_code(spark)
    system, root = fs.FileSystem.from_uri(folder.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    parts = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("part-"))
    rows = [(f"{folder.rstrip('/')}/{p}", nth) for p in parts for nth in range(READERS)]
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "folder string, nth int").mapInArrow(_read, SCHEMA)
