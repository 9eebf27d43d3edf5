"""Token ids on disk: one grammar-compressed binary file per shard of documents.

``write_ids`` orders documents by id (null first, rows repeating an id by text), encodes
them and writes files below a folder; its result lists the files a task that ended well has
written, so files of lost or repeated tasks are never read. ``read_ids`` reads the listed
files back. A task holds one shard at a time: ``SHARD_IDS`` ids and one document. A null
text is empty and becomes the end id alone; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.grammar import Shard, compress
from recordlens.llm.store import fresh_path, open_store, stored
from recordlens.llm.token_ids import token_ids, utf8

SHARD_IDS = 1_000_000

_FILES = "part int, shard int, file string, documents long, n_tokens long"


def write_ids(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write ``docs`` as shards; one row per file, with ``start``, the ids before it."""
    folder = folder or fresh_path(docs.sparkSession, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = token_ids(tokenizer)
        terminals = max(encoder.whole.get_vocab_size(), end_id + 1)
        end = np.array([end_id], np.uint32)
        part, shard = TaskContext.get().partitionId(), 0
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:05d}-{shard:05d}-{uuid.uuid4().hex}.rpr"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(compress(keys, ids, end_id, terminals).to_bytes())
            return pa.RecordBatch.from_pydict(
                {"part": [part], "shard": [shard], "file": [f"{folder}/{name}"], "documents": [len(keys)], "n_tokens": [held]},
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("n_tokens", pa.int64())]),
            )

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                for key, found in zip(some.column(0).to_pylist(), encoder.encode(utf8(some.column(1)))):
                    keys.append(key)
                    ids.append(np.concatenate([found, end]))
                    held += len(found) + 1
                    if held >= SHARD_IDS:
                        yield flush()
                        keys, ids, held, shard = [], [], 0, shard + 1
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "text")
    )
    files = stored(ordered.mapInArrow(write, _FILES), "token-files")
    # Ids before each file: sums per task, then over tasks, so no window holds more than either.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return files.withColumn("inside", inside).join(before, "part").select(
        "part", "shard", "file", "documents", "n_tokens", (F.col("before") + F.col("inside")).alias("start")
    )


def read_ids(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the listed files: id, ``start``, ``n_tokens``, ``ids_crc32``,
    and the ids themselves if asked for."""
    kind = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_file(path) as f:
                    shard = Shard.from_bytes(f.read())
                documents = shard.documents()
                columns = {
                    id_col: [None if z else k for k, z in zip(shard.keys.tolist(), shard.nulls.tolist())],
                    "start": (row["start"] + shard.n_ids.cumsum() - shard.n_ids).tolist(),
                    "n_tokens": shard.n_ids.tolist(),
                    "ids_crc32": [zlib.crc32(d.astype("<u4").tobytes()) for d in documents],
                }
                fields = [(c, pa.int64()) for c in columns]
                if with_ids:
                    columns["ids"] = [d.tolist() for d in documents]
                    fields.append(("ids", pa.list_(pa.int64())))
                yield pa.RecordBatch.from_pydict(columns, pa.schema(fields))

    # A row stands for a whole file, so rows must not be gathered into few tasks for being small.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(tasks, "file").mapInArrow(read, kind)
