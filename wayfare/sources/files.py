"""Files beside Spark's tables: stores by path or URI, and documents that tasks write in parts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are copied at once where parts are joined.
COPY = 8 << 20


def store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its file, and of each section in it how many bytes and fragments, in order."""

    number: int
    file: str
    sections: list[tuple[str, int, int]]


class DocumentWriter(DataSourceWriter):
    """Tasks write their fragments to files of their attempts; the commit joins those that count and swaps the document."""

    def __init__(self, options: dict):
        self.path, self.layout = options["path"], json.loads(options["layout"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        disk, where = store(self.parts)
        file, sections, out = f"{where}/{task.partitionId()}-{task.taskAttemptId()}", [], None
        try:
            for row in rows:
                if out is None:
                    disk.create_dir(where, recursive=True)
                    out = disk.open_output_stream(file, compression=None)
                more = bool(sections) and sections[-1][0] == row.section
                data = ("," if more else "").encode() + row.fragment.encode()
                out.write(data)
                if more:
                    sections[-1] = (row.section, sections[-1][1] + len(data), sections[-1][2] + 1)
                else:
                    sections.append((row.section, len(data), 1))
        finally:
            if out is not None:
                out.close()
        return Part(task.partitionId(), file, sections)

    def commit(self, messages: list[Part | None]) -> None:
        disk, target = store(self.path)
        places: dict[str, list[tuple[str, int, int]]] = {}
        counts: dict[str, int] = {}
        for part in sorted((m for m in messages if m and m.sections), key=lambda m: m.number):
            at = 0
            for section, size, n in part.sections:
                places.setdefault(section, []).append((part.file, at, size))
                counts[section] = counts.get(section, 0) + n
                at += size
        new = f"{target}.new-{uuid.uuid4().hex}"
        with disk.open_output_stream(new, compression=None) as out:
            for i, (name, kind) in enumerate(self.layout):
                out.write(("," if i else "{").encode() + json.dumps(name).encode() + b":")
                if kind.startswith("count:"):
                    out.write(str(counts.get(kind.removeprefix("count:"), 0)).encode())
                    continue
                out.write(b"{" if kind == "map" else b"[")
                for j, (file, at, size) in enumerate(places.get(name, [])):
                    if j:
                        out.write(b",")
                    with disk.open_input_file(file) as part:
                        part.seek(at)
                        while size:
                            data = part.read(min(size, COPY))
                            out.write(data)
                            size -= len(data)
                out.write(b"}" if kind == "map" else b"]")
            out.write(b"}")
        disk.move(new, target)  # the old document is there up to here
        self._drop()

    def abort(self, messages: list[Part | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        disk, where = store(self.parts)
        disk.delete_dir_contents(where, missing_dir_ok=True)
        if disk.get_file_info(where).type.name == "Directory":
            disk.delete_dir(where)


class Document(DataSource):
    """One JSON document of rows (section, fragment), in the order of partitions and of rows in them.

    Options: path; layout, a JSON list of [section, kind], kind being map, list or count:section.
    """

    @classmethod
    def name(cls) -> str:
        return "wayfare_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(rows: DataFrame, layout: list[tuple[str, str]], path: str) -> None:
    """rows (section, ord, fragment) as one document: sections in the order of the layout, fragments by ord.

    Rows are sorted by range partitions, so no task or aggregate holds them all. A failed task leaves the old document.
    A document may be written to the path that it is read from: it is swapped when all tasks are done.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Document)
    place = F.array_position(F.array(*(F.lit(name) for name, _ in layout)), F.col("section"))
    dealt = rows.withColumn("_place", place).repartitionByRange("_place", "ord").sortWithinPartitions("_place", "ord")
    dealt.select("section", "fragment").write.format("wayfare_document").mode("overwrite").option("path", path).option("layout", json.dumps(layout)).save()


def keyed(df: DataFrame, section: str, key: str) -> DataFrame:
    """Fragments `"key": {the other columns}` of a map; null fields are left out."""
    value = F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "true"})
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    return df.select(F.lit(section).alias("section"), F.struct(F.lit(0).cast("long").alias("n"), F.col(key).cast("string").alias("k")).alias("ord"), F.concat(name, F.lit(":"), value).alias("fragment"))


def listed(df: DataFrame, section: str, order: str | None = None) -> DataFrame:
    """Fragments `{columns}` of a list, in the order of a column of whole numbers, else as the rows come."""
    n = F.col(order) if order else F.monotonically_increasing_id()
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"})
    return df.select(F.lit(section).alias("section"), F.struct(n.cast("long").alias("n"), F.lit("").alias("k")).alias("ord"), value.alias("fragment"))
