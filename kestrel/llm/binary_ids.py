"""Token ids as flat binary files with 64-bit document offsets.

Layout of a folder, one file of each kind per partition, partitions in
ascending order of document id:

* ``part-NNNNN.bin``  ids, little-endian, unsigned 16-bit when the vocabulary
  and end id fit, else unsigned 32-bit (``meta`` in the manifest says which);
* ``part-NNNNN.doc``  document ids, signed 64-bit (a null id: the least value);
* ``part-NNNNN.off``  global offsets of the documents' first ids, unsigned
  64-bit, and after the last document one more: the partition's end;
* ``manifest.json``   one entry per partition: documents, ids, base.

A range shuffle on the id and a sort within each partition fix the order;
every task encodes and writes its own partition.  The bases are prefix sums of
the partitions' counts (one number per partition reaches the driver).  Files
are written under a name of the attempt and then moved, so a repeated task
replaces equal bytes.  Reading maps the files into memory where the folder is
mounted; other stores are read by range.

Defined results: a null text is empty (the end id alone); null ids come
first; rows equal in id are ordered by text; repeated rows are kept; an empty
table gives empty files and an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kestrel.llm.text_tokens import encode_each, encoder
from kestrel.session import ensure_checkpoint_dir

NULL_ID = -(1 << 63)
READ_BYTES = 8 << 20


def open_store(uri: str):
    """A pyarrow file system and the path within it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _put(store, path: str, chunks) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for c in chunks:
            f.write(c)
    store.move(own, path)


def _get(store, path: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped when local."""
    from pyarrow import fs

    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
              id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        kind = np.dtype("<u2" if max(enc.tok.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
        here, top = open_store(folder)
        name = f"{top}/part-{TaskContext.get().partitionId():05d}"
        keys: list[np.ndarray] = []
        sizes: list[int] = []

        def chunks():
            for batch in batches:
                if batch.num_rows:
                    keys.append(batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                    for ids in encode_each(enc, (x.as_py() for x in batch.column(1))):
                        ids = np.append(ids, np.uint32(end_id))
                        sizes.append(len(ids))
                        yield ids.astype(kind).tobytes()

        _put(here, f"{name}.bin", chunks())
        _put(here, f"{name}.doc", [np.concatenate([np.zeros(0, np.int64), *keys]).astype("<i8").tobytes()])
        _put(here, f"{name}.len", [np.array(sizes, "<u8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "docs": [len(sizes)], "ids": [sum(sizes)], "width": [kind.itemsize]})

    ordered = docs.select(id_col, text_col).repartitionByRange(n, id_col).sortWithinPartitions(id_col, text_col)
    parts = sorted(ordered.mapInArrow(run, "part long, docs long, ids long, width long").collect())  # one row per partition
    bases = [0, *itertools.accumulate(p["ids"] for p in parts)]
    entries = [p.asDict() | {"base": b} for p, b in zip(parts, bases, strict=False)]

    def offsets(batches):
        here, top = open_store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name = f"{top}/part-{entries[k]['part']:05d}"
                sizes = _get(here, f"{name}.len", "<u8")
                off = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(entries[k]["base"])
                _put(here, f"{name}.off", [off.astype("<u8").tobytes()])
            yield pa.RecordBatch.from_pydict({"done": [batch.num_rows]})

    if entries:
        spark.range(0, len(entries), 1, len(entries)).mapInArrow(offsets, "done long").collect()  # one row per partition
    _put(store, f"{root}/manifest.json", [json.dumps(entries).encode()])


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens and ids
    (little-endian unsigned 32-bit).  One task per partition file."""
    store, root = open_store(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        entries = json.loads(f.read())

    def run(batches):
        here, top = open_store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name = f"{top}/part-{entries[k]['part']:05d}"
                ids = _get(here, f"{name}.bin", f"<u{entries[k]['width']}")
                docs, off = _get(here, f"{name}.doc", "<i8"), _get(here, f"{name}.off", "<u8")
                size = np.diff(off).astype(np.int64)
                group = np.cumsum(size * 4) // READ_BYTES  # documents that go out together
                for some in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(group)) + 1) if len(docs) else []:
                    base = entries[k]["base"]
                    blobs = [ids[int(off[i]) - base:int(off[i + 1]) - base].astype("<u4").tobytes() for i in some]
                    own = np.asarray(docs[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(off[some].astype(np.int64)), pa.array(size[some]), pa.array(blobs, pa.binary())],
                        [id_col, "start", "n_tokens", "ids"])

    tasks = spark.range(0, len(entries), 1, max(1, len(entries)))
    return tasks.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-files/{name}-{uuid.uuid4().hex[:12]}"
