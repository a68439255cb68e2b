"""Token ids in Arrow files of fixed-size lists.

Documents are put in ascending id order by one range exchange. Each task
encodes its documents into one stream of ids, cut into sequences of ``length``,
and writes an Arrow file: ``ids`` and ``mask``, both fixed-size lists, in
record batches of equal size. Sequence i is row ``i % rows`` of batch
``i // rows``, read from a memory map without copying. Beside it lies an Arrow
file with each document's place. Only the last sequence of a file is padded.

A file's name carries a random part and is taken up in the manifest, itself a
written table, only if its task succeeded: a lost or repeated task leaves a
file that nobody reads.

Defined cases: null or empty text has the end id alone; null ids come first;
repeated ids follow each other in order of their text; an empty table yields
no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import scratch_dir, trimmed, with_offsets, written
from .tokens import encoder

LENGTH = 2048
BATCH_SEQUENCES = 256


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def sequence_schema(width: int, length: int) -> pa.Schema:
    ids = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", ids, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Gathers ids and writes full record batches; memory holds one batch at most."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema = sequence_schema(dtype.itemsize, length)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.length, self.rows, self.dtype = length, rows, dtype
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        every = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        full = self.length * self.rows
        while len(every) >= full:
            self._write(every[:full], full)
            every = every[full:]
        if last and len(every):
            n = -(-len(every) // self.length) * self.length
            self._write(np.r_[every, np.zeros(n - len(every), self.dtype)].astype(self.dtype), len(every))
            every = every[:0]
        self.parts, self.held = [every], len(every)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class SequenceReader:
    """Random access to sequences, and to any run of ids, of one file."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.cached: tuple[int, np.ndarray] = (-1, np.empty(0))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        row = self.file.get_batch(i // self.rows).slice(i % self.rows, 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten()

    def _batch(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            self.cached = (k, self.file.get_batch(k).column(0).flatten().to_numpy())
        return self.cached[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        full, out = self.rows * self.length, []
        while n:
            part = self._batch(start // full)[start % full : start % full + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def _writer(path: str, folder: str, end_id: int, length: int, rows: int, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, root = _open(folder)
        enc = encoder(path, lead=True, specials=specials)
        end = np.array([end_id], enc.dtype)
        writer = places = sink = sink2 = None
        start = 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink, sink2 = fs.open_output_stream(f"{root}/{name}.arrow"), fs.open_output_stream(f"{root}/{name}.docs.arrow")
                writer, places = SequenceWriter(sink, enc.dtype, length, rows), pa.ipc.new_file(sink2, DOC_SCHEMA)
            starts, sizes = [], []
            for ids in enc.batch(b.column(1)):
                ids = np.concatenate([ids, end])
                writer.add(ids)
                starts.append(start)
                sizes.append(len(ids))
                start += len(ids)
            places.write_batch(pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOC_SCHEMA))
        if writer is not None:
            writer.close()
            places.close()
            sink.close()
            sink2.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": [name], "n": pa.array([start], pa.int64())})

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, rows: int = BATCH_SEQUENCES, specials: bool = False) -> DataFrame:
    """Writes the files into ``folder`` (any file system pyarrow opens) and returns the manifest: part, name, n. ``specials``: see ``tokens``."""
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(trimmed(_writer(tokenizer_path, folder, end_id, length, rows, specials)), "part long, name string, n long"))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
                with opened(f"{root}/{name}.arrow") as source, opened(f"{root}/{name}.docs.arrow") as docs:
                    ids, places = SequenceReader(source), pa.ipc.open_file(docs)
                    for k in range(places.num_record_batches):
                        p = places.get_batch(k)
                        start, n = p.column(1).to_numpy(), p.column(2).to_numpy()
                        crc = [zlib.crc32(ids.ids(s, m).astype("<u4").tobytes()) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([p.column(0), pa.array(start + first), p.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: id, global start, number of ids, their crc32."""
    files = manifest.join(with_offsets(manifest, "part", "n", "first"), "part").select("part", "name", "first")
    # Rows this small would be gathered in one task, were the number of tasks not given.
    dealt = files.repartitionByRange(max(1, manifest.count()), "part").select("name", "first")
    return dealt.mapInArrow(trimmed(_reader(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    folder = scratch_dir(docs.sparkSession)
    return read(write(docs, folder, tokenizer_path, **options), folder)
