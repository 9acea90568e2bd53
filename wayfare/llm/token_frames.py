"""Token ids in files of independent zstandard frames that can be read in part.

Each file of the format holds, in ascending order of the ids of documents, one frame for each document (several for one
of more than FRAME bytes), a skippable frame with the list of its documents, and the seek table of the public seekable
format: sizes and a checksum (low half of XXH64) of every frame. A reader takes the seek table from the end and
decompresses the frames of the documents that are asked for, and no others; any zstandard tool reads all ids.

Documents are sorted by range partitions, and each task writes one file under the name of its attempt. The index table
that Spark commits at the end names the files that count, so a lost executor or a task that runs twice leaves no mark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.common import read, shared_dir, slices, tidied
from wayfare.llm.tokens import default_path, encode

END = 2
#: Bytes of ids in a frame, at most, and the level of compression.
FRAME, LEVEL = 4 << 20, 3
#: Fixed values of the public format: skippable frames of the list and of the seek table, the mark at the end, the flag for checksums.
LIST_MAGIC, TABLE_MAGIC, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids that a reader gives at once.
BATCH = 1 << 20


def store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes documents one after the other; `close` adds list and seek table."""

    def __init__(self, out, kind: pa.DataType):
        self.out, self.kind = out, kind
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.entries: list[bytes] = []
        self.names: list[pa.Array] = []
        self.sizes: list[int] = []

    def _put(self, packed: bytes, raw: bytes) -> None:
        self.out.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, names: pa.Array, ids: list[bytes]) -> None:
        self.names.append(names.cast(self.kind))
        for raw in ids:
            self.sizes.append(len(raw) // 4)
            for low in range(0, len(raw), FRAME):
                part = raw[low : low + FRAME]
                self._put(self.packer.compress(part), part)

    def close(self) -> None:
        sink = pa.BufferOutputStream()
        rows = pa.table([pa.chunked_array(self.names, self.kind), pa.array(self.sizes, pa.int64())], ["doc_id", "n_tokens"])
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        listed = zstandard.compress(sink.getvalue().to_pybytes(), LEVEL)
        self._put(struct.pack("<II", LIST_MAGIC, len(listed)) + listed, b"")
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class FrameReader:
    """A file of the format; its documents by their place."""

    def __init__(self, file):
        self.file, self.unpacker, self.frames_read = file, zstandard.ZstdDecompressor(), 0
        size = file.size()
        n, flag, mark = struct.unpack("<IBI", self._at(size - 9, 9))
        if mark != SEEKABLE or flag != CHECKSUMS:
            raise ValueError("not a file of seekable frames with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.at = np.cumsum(self.packed) - self.packed
        head = 8
        listed = zstandard.decompress(self._at(int(self.at[-1]) + head, int(self.packed[-1]) - head))
        rows = pa.ipc.open_stream(listed).read_all()
        self.names, self.n_tokens = rows["doc_id"].combine_chunks(), rows["n_tokens"].to_numpy()
        frames = -(-4 * self.n_tokens // FRAME)
        self.first = np.cumsum(frames) - frames
        self.frames = frames

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, place: int) -> bytes:
        """The ids of one document; no other document's frames are read."""
        low = int(self.first[place])
        out = []
        for i in range(low, low + int(self.frames[place])):
            raw = self.unpacker.decompress(self._at(int(self.at[i]), int(self.packed[i])), max_output_size=int(self.raw[i]))
            if len(raw) != self.raw[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i}: checksum differs")
            out.append(raw)
            self.frames_read += 1
        return b"".join(out)


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text, each with the end token, to files in `folder`; gives the index (also at folder/index).

    index: doc_id, number and file of the file, place in it, start (ids of the file before), n_tokens. Null text counts
    as empty. Null ids come first; documents of one id are in the order of a hash of their texts, repeated rows as they
    come, so no id has to fit one task. A text and its ids are held whole, however long. An empty table gives an
    empty index. Further columns are not read.
    """
    end = np.array([END], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, place, start = TaskContext.get(), None, 0, 0
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    if out is None:
                        files, where = store(folder)
                        files.create_dir(where, recursive=True)
                        out = FrameWriter(files.open_output_stream(f"{where}/{name}", compression=None), part.column("doc_id").type)
                    ids = [x + end for x in encode([t or "" for t in part.column("text").to_pylist()], path)]
                    out.add(part.column("doc_id"), ids)
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    starts = start + np.cumsum(n) - n
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array([task.partitionId()] * len(n), pa.int32()), pa.array([name] * len(n)), pa.array(np.arange(place, place + len(n))), pa.array(starts), pa.array(n)],
                        ["doc_id", "number", "file", "place", "start", "n_tokens"],
                    )
                    place, start = place + len(n), start + int(n.sum())
        finally:
            if out is not None:
                out.close()

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("spread"))
    order = ["doc_id", "tie", "spread"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    index = dealt.mapInArrow(tidied(run, "tokens"), f"doc_id {kind}, number int, file string, place long, start long, n_tokens long")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def files_of(index: DataFrame) -> DataFrame:
    """number, file, documents, tokens, and before: the tokens of all files before. One row for each file."""
    each = index.groupBy("number", "file").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("before", F.coalesce(before, F.lit(0)))


def read_all(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of a folder's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    All but the list of files comes from the files; each frame is held against its checksum.
    """
    index = spark.read.parquet(f"{folder}/index")
    files = files_of(index)
    kind = index.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, where = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with disk.open_input_file(f"{where}/{row['file']}") as file:
                    reader = FrameReader(file)
                    if len(reader.names) != row["documents"]:
                        raise ValueError(f"{row['file']}: {len(reader.names)} documents, the index has {row['documents']}")
                    start = row["before"] + np.cumsum(reader.n_tokens) - reader.n_tokens
                    low, held = 0, []
                    size = 0
                    for i in range(len(reader.names)):
                        ids = reader.ids(i)
                        held.append((zlib.crc32(ids), ids if with_ids else None))
                        size += len(ids) if with_ids else 64
                        if size >= BATCH or i + 1 == len(reader.names):
                            part = slice(low, i + 1)
                            out = [reader.names[part], pa.array(start[part]), pa.array(reader.n_tokens[part]), pa.array([c for c, _ in held], pa.int64())]
                            if with_ids:
                                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for _, x in held], pa.list_(pa.int32())))
                            yield pa.RecordBatch.from_arrays(out, names)
                            low, held, size = i + 1, [], 0

    n = max(1, index.select("number").distinct().count())  # one task for each file
    dealt = files.select("number", "file", "documents", "before").repartitionByRange(n, "number")
    return dealt.mapInArrow(tidied(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents that `wanted` (doc_id, each once) asks for; only their frames are decompressed.

    The index finds them by a join; each task opens the files of its rows.
    """
    index = spark.read.parquet(f"{folder}/index")
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, where = store(folder)
        name, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, reader = row["file"], FrameReader(disk.open_input_file(f"{where}/{row['file']}"))
                ids = np.frombuffer(reader.ids(row["place"]), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([reader.names[row["place"] : row["place"] + 1], pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    found = index.join(wanted.select("doc_id"), "doc_id", "left_semi").select("file", "place")
    return found.repartitionByRange("file", "place").sortWithinPartitions("file", "place").mapInArrow(tidied(run), f"doc_id {kind}, ids array<int>")


def op13_token_frames(spark, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), default_path(), folder)
    return read_all(spark, folder, with_ids=False)
