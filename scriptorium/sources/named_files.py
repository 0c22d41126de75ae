"""Rows as files of their own, written by tasks through Spark's data source interface.

Spark's own writers choose names and contents of files themselves. This one writes each row's
bytes under the row's name. A task writes into a folder of its attempt below ``_staging-…``, which
no reader lists. When all tasks are done the driver moves one folder per task next to the others; a job
that fails, or a task that runs twice or is lost, leaves nothing behind that a reader would see.
"""

import sys
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# the writer travels with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "named_files"


def _store(path):
    """``(file system, path)`` of a local path or of the address of a shared store."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path):
        self.path = path
        self.job = uuid.uuid4().hex

    def staging(self, path):
        return f"{path}/_staging-{self.job}"

    def write(self, rows):
        store, path = _store(self.path)
        task = TaskContext.get()
        folder = f"part-{task.partitionId():05d}-{self.job}"
        own = f"{self.staging(path)}/{task.taskAttemptId()}/{folder}"
        names = set()
        for name, content in rows:
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"not a file name that readers list: {name!r}")
            if name in names:
                raise ValueError(f"two files of one name: {name!r}")
            if not names:
                store.create_dir(own)
            names.add(name)
            with store.open_output_stream(f"{own}/{name}") as out:
                out.write(content or b"")
        return Written(f"{task.taskAttemptId()}/{folder}" if names else "", len(names))

    def commit(self, messages):
        store, path = _store(self.path)
        store.create_dir(path)
        for message in messages:
            if message and message.folder:
                name = message.folder.rsplit("/", 1)[1]
                store.move(f"{self.staging(path)}/{message.folder}", f"{path}/{name}")
        self._clear(store, path)
        with store.open_output_stream(f"{path}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages):
        self._clear(*_store(self.path))

    def _clear(self, store, path):
        if store.get_file_info(self.staging(path)).type == fs.FileType.Directory:
            store.delete_dir(self.staging(path))


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(path)`` for ``(name, content)``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are only ever added; choose a new folder")
        return NamedFilesWriter(self.options["path"])


def write_named_files(rows, path):
    """Write ``rows(name, content)`` below ``path``, each row one file. Names are unique in a task."""
    rows.sparkSession.dataSource.register(NamedFiles)
    content = F.col("content").cast("binary").alias("content")
    rows.select("name", content).write.format(FORMAT).mode("append").save(path)
    return path
