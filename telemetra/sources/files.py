"""Spark data sources of our own: files of padded arrays, and tar shards of samples.

`padded_arrays` reads and writes `.npz` files. Each file is a part of the plan; its arrays are read side by side in blocks of rows, so a
file of any length needs little memory, and only the columns asked for are opened. The first axis of an array is the row; a second
one is padded to one width, and cut to the row's own length by the array that the option `length` names. `file` and `row` tell where a
row is from. An array that a file lacks is null. The option `pattern` is a regular expression of file names; where no
file has such a name, the one of the option `fallback` counts.

`tar_shards` writes rows (shard, place, files: array of name and data), sorted by shard, as `shard_000000.tar` and so on with
`manifest.jsonl`, and reads them as (shard, name, data). Both writers write under a folder of their own, `_temporary-` and the
job's number, out of which the commit moves files in place once all tasks have ended well; so a failed or repeated task leaves no
shard. Readers pass over such folders. One that a task still running at the abort makes anew goes with the next overwrite.

Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

import json
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are read at a time.
BLOCK = 4096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _listed(store: fs.FileSystem, at: str, suffix: str) -> list[fs.FileInfo]:
    one = store.get_file_info(at)
    if one.type == fs.FileType.File:
        return [one]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and "/_" not in f.path[len(at) :]]
    return sorted(kept, key=lambda f: f.path)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # where it is, its name, rows


def _rows_of(member, shape: tuple[int, ...], dtype: np.dtype) -> Iterator[np.ndarray]:
    """Blocks of rows of an array that is read from a stream."""
    width = int(np.prod(shape[1:], dtype=int)) * dtype.itemsize
    for at in range(0, shape[0], BLOCK):
        n = min(BLOCK, shape[0] - at)
        data = member.read(n * width)
        if len(data) < n * width:
            raise EOFError("an array ends before its last row")
        yield np.frombuffer(data, dtype).reshape(n, *shape[1:])


def _header(member) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(member)
    if by_column and len(shape) > 1:
        raise ValueError("arrays by columns can't be read in blocks of rows")
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    return shape, dtype


class _ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.schema, self.length = path, schema, options.get("length", "length")
        self.names = [options[k] for k in ("pattern", "fallback") if k in options]

    def partitions(self) -> list[_File]:
        store, at = _store(self.path)
        found = _listed(store, at, ".npz")
        for k, name in enumerate(self.names):
            kept = [f for f in found if re.fullmatch(name, f.base_name)]
            if kept or k == len(self.names) - 1:
                found = kept
                break
        return [_File(f.path) for f in sorted(found, key=lambda f: -(f.size or 0))]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        store, _ = _store(self.path)
        kinds = to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as z:
            there = {n.removesuffix(".npy") for n in z.namelist()}
            wanted = [n for n in kinds.names if n in there and n not in ("file", "row")]
            opened = {n: z.open(f"{n}.npy") for n in {*wanted, *({self.length} & there)}}
            if not opened and there:  # no column is asked for but where rows are from
                first = min(there)
                opened = {first: z.open(f"{first}.npy")}
            heads = {n: _header(m) for n, m in opened.items()}
            sizes = {h[0][0] for h in heads.values() if h[0]}
            if len(sizes) > 1:
                raise ValueError(f"arrays of different numbers of rows in {partition.path}: {sorted(sizes)}")
            blocks = {n: _rows_of(m, *heads[n]) for n, m in opened.items() if heads[n][0]}
            at = 0
            while blocks:
                now = {n: next(b, None) for n, b in blocks.items()}
                if any(b is None for b in now.values()):
                    break
                n = len(next(iter(now.values())))
                length = now.get(self.length)
                yield pa.RecordBatch.from_arrays([self._column(f, now.get(f.name), length, partition.path, at, n) for f in kinds], schema=kinds)
                at += n

    def _column(self, kind: pa.Field, x: np.ndarray | None, length: np.ndarray | None, path: str, at: int, n: int) -> pa.Array:
        if kind.name == "file":
            return pa.array([path] * n, kind.type)
        if kind.name == "row":
            return pa.array(np.arange(at, at + n)).cast(kind.type)
        if x is None:
            return pa.nulls(n, kind.type)
        if x.ndim == 1:
            return pa.array(x).cast(kind.type)
        x = x.reshape(n, -1)
        own = np.full(n, x.shape[1]) if length is None else np.clip(length, 0, x.shape[1])
        inside = np.arange(x.shape[1]) < own[:, None]
        flat = pa.array(x[inside]).cast(kind.type.value_type)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), flat).cast(kind.type)


class _Committed(DataSourceArrowWriter):
    """Writes under a folder of this job, whose files the commit moves in place."""

    def __init__(self, path: str, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix, self.job = path, overwrite, suffix, uuid.uuid4().hex
        store, at = _store(path)
        if not overwrite and _listed_or_none(store, at, suffix):
            raise FileExistsError(f"{path} has such files")

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, at = _store(self.path)
        return store, at, f"{at}/_temporary-{self.job}"

    def commit(self, messages: list[_Written | None]) -> None:
        store, at, temporary = self._folder()
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        names = [f[1] for f in files]
        if len({*names}) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote the same file: rows must be dealt by shard")
        if self.overwrite:
            for old in _listed_or_none(store, at, self.suffix):
                store.delete_file(old.path)
        store.create_dir(at)
        for where, name, _ in files:
            store.move(where, f"{at}/{name}")
        self.finish(store, at, files)
        self._clear(store, temporary)
        if self.overwrite:
            for left in store.get_file_info(fs.FileSelector(at)):
                if left.base_name.startswith("_temporary-"):
                    self._clear(store, left.path)

    def finish(self, store: fs.FileSystem, at: str, files: list[tuple[str, str, int]]) -> None:
        """What a commit adds."""

    def abort(self, messages: list[_Written | None]) -> None:
        store, _, temporary = self._folder()
        self._clear(store, temporary)

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def _listed_or_none(store: fs.FileSystem, at: str, suffix: str) -> list[fs.FileInfo]:
    return [] if store.get_file_info(at).type == fs.FileType.NotFound else _listed(store, at, suffix)


class _ArrayWriter(_Committed):
    """One file a task: its lists padded to the longest with NaN, or 0 for whole numbers, and their lengths."""

    def __init__(self, path: str, overwrite: bool, options: dict):
        super().__init__(path, overwrite, ".npz")
        self.length = options.get("length", "length")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        table = [b for b in iterator if len(b)]
        if not table:
            return _Written([])
        whole = pa.Table.from_batches(table)
        arrays, lengths = {}, None
        for name in whole.column_names:
            col = whole[name].combine_chunks()
            if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
                own = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
                if lengths is not None and (own != lengths).any():
                    raise ValueError(f"lists of a row differ in length: {name}")
                lengths, flat = own, col.flatten().to_numpy(zero_copy_only=False)
                out = np.full((len(own), own.max(initial=0)), np.nan if flat.dtype.kind == "f" else 0, flat.dtype)
                out[np.arange(out.shape[1]) < own[:, None]] = flat
                arrays[name] = out
            else:
                if col.null_count:
                    raise ValueError(f"a null in {name}, for which arrays have no place")
                arrays[name] = np.asarray(col.to_pylist()) if pa.types.is_string(col.type) else col.to_numpy(zero_copy_only=False)
        if lengths is not None:
            arrays[self.length] = lengths
        store, _, temporary = self._folder()
        store.create_dir(temporary)
        name = f"part-{uuid.uuid4().hex}.npz"
        with store.open_output_stream(f"{temporary}/{name}") as out:
            np.savez(out, **arrays)
        return _Written([(f"{temporary}/{name}", name, len(whole))])


class PaddedArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "padded_arrays"

    def schema(self) -> str:
        raise ValueError("padded_arrays needs a schema")

    def reader(self, schema: StructType) -> _ArrayReader:
        return _ArrayReader(self.options["path"], schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _ArrayWriter:
        return _ArrayWriter(self.options["path"], overwrite, dict(self.options))


class _ShardWriter(_Committed):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path, overwrite, ".tar")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _, temporary = self._folder()
        store.create_dir(temporary)
        task, done, now, tar, out, n = uuid.uuid4().hex, [], None, None, None, 0

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()
                done.append((f"{temporary}/{task}-{now}", f"shard_{now:06d}.tar", n))

        for batch in iterator:
            for shard, files in zip(batch.column("shard").to_pylist(), batch.column("files").to_pylist()):
                if shard != now:
                    close()
                    now, n = shard, 0
                    out = store.open_output_stream(f"{temporary}/{task}-{now}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                n += 1
                for f in files or []:
                    info = tarfile.TarInfo(f["name"])
                    info.size = len(f["data"])
                    tar.addfile(info, _Bytes(f["data"]))
        close()
        return _Written(done)

    def finish(self, store: fs.FileSystem, at: str, files: list[tuple[str, str, int]]) -> None:
        with store.open_output_stream(f"{at}/manifest.jsonl") as out:
            for _, name, n in files:
                out.write((json.dumps({"shard": name.removesuffix(".tar"), "num_sequences": n}) + "\n").encode())


class _Bytes:
    """Data as a file to read from."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def read(self, n: int) -> bytes:
        part = bytes(self.data[self.at : self.at + n])
        self.at += len(part)
        return part


class _ShardReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_File]:
        store, at = _store(self.path)
        return [_File(f.path) for f in _listed(store, at, ".tar")]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, _ = _store(self.path)
        shard = int(re.search(r"(\d+)\.tar$", partition.path)[1])
        with store.open_input_stream(partition.path) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    yield shard, member.name, tar.extractfile(member).read()


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return "shard long, name string, data binary"

    def reader(self, schema: StructType) -> _ShardReader:
        return _ShardReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _ShardWriter:
        return _ShardWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with both formats."""
    spark.dataSource.register(PaddedArrays)
    spark.dataSource.register(TarShards)
    return spark
