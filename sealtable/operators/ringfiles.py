"""The files of a keyring: ids that are claimed, and few files however many keys.

A key id is claimed by creating a file of that name, which the file system lets only one
writer do, before the key is written.  Each added key is one small file; when there are
many, they are written as one again.  The new generation takes the place of the files it
was made from by a list of their names, put in place last, by renaming.  Those files stay
until the generation after, so plans that were made over them still run.

Everything goes through Hadoop's file system, as Spark's own reading and writing does.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

# A ring of more current files than this is compacted when a key is added.
MOST_FILES = 16
# Lists of replaced files, files of a generation, and claims.
_LIST, _MADE, _CLAIMS = "_gen-", "gen-", "_claims"


class RingFiles:
    """The folder of one keyring table."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self) -> bool:
        return bool(self._names())

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str = "") -> bool:
        """Create a file that is not there; whether this writer did."""
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        if self._fs.getScheme() == "file":
            # Hadoop's local files are looked for and then created, which two writers can
            # both do; the operating system creates in one step.
            nio, none = self._jvm.java.nio.file, self.spark.sparkContext._gateway.new_array
            local = nio.Paths.get(self._fs.makeQualified(path).toUri().getPath(), none(self._jvm.java.lang.String, 0))
            try:
                nio.Files.createFile(local, none(nio.attribute.FileAttribute, 0))
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
            if not text:
                return True
        try:
            out = self._fs.create(path, self._fs.getScheme() == "file")
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def claim(self, name: str) -> bool:
        """Whether the name was free; it is taken from now on, whatever happens to the writer."""
        return self._create(f"{_CLAIMS}/{name}")

    def claim_id(self, first: int, provider: str, app_id: str) -> int:
        """The smallest id from ``first`` on that no other writer of this application took."""
        owner = hashlib.sha256(f"{provider}\0{app_id}".encode()).hexdigest()[:16]
        while not self.claim(f"{owner}-{first}"):
            first += 1
        return first

    def _generation(self, names: list[str]) -> tuple[int, set[str]]:
        """The number of the generation in force, and the files that it replaced."""
        made = [int(n.removeprefix(_LIST)) for n in names if n.startswith(_LIST)]
        return (max(made), set(self._read(f"{_LIST}{max(made)}").split("\n"))) if made else (0, set())

    def _current(self, names: list[str]) -> list[str]:
        number, gone = self._generation(names)
        # A compacted file counts only while its own generation is in force.
        return [
            n for n in names
            if n.endswith(".parquet") and n not in gone and (not n.startswith(_MADE) or n.startswith(f"{_MADE}{number}-"))
        ]

    def current(self) -> list[str]:
        """Names of the files that make up the ring."""
        return self._current(self._names())

    def read(self) -> DataFrame:
        names, reader = self._names(), self.spark.read.schema(self.schema)
        if not any(n.startswith((_LIST, _MADE)) for n in names):
            return reader.parquet(self.folder)
        return reader.parquet(*[f"{self.folder}/{n}" for n in self._current(names)])

    def _written(self, rows: DataFrame, prefix: str) -> str:
        """Write rows into a folder of their own, since two Spark jobs cannot append to one folder
        at the same time, and move the files into the ring; the folder's name."""
        work = f"_work-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.folder}/{work}")
        for status in self._fs.listStatus(self._path(work)):
            name = status.getPath().getName()
            if name.endswith(".parquet"):
                self._fs.rename(status.getPath(), self._path(f"{prefix}{name}"))
        return work

    def add(self, rows: DataFrame) -> None:
        """Append rows as one file."""
        self._fs.delete(self._path(self._written(rows, "key-")), True)

    def compact(self) -> bool:
        """Write the current files as one; False if there is nothing to do.  Stopped anywhere,
        it leaves the ring as it was, and two writers may do it at once."""
        names = self._names()
        files = self._current(names)
        before, replaced = self._generation(names)
        if len(files) < 2:
            return False
        number = before + 1
        while not self.claim(f"{_LIST}{number}"):
            number += 1
        whole = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{n}" for n in files])
        work = self._written(whole, f"{_MADE}{number}-")
        self._create(f"{work}/list", "\n".join(files))
        self._fs.rename(self._path(f"{work}/list"), self._path(f"{_LIST}{number}"))
        self._fs.delete(self._path(work), True)
        # No plan made since the last generation reads what that one replaced.
        for name in replaced:
            self._fs.delete(self._path(name), False)
        return True
