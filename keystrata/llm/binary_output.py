"""Operator 7: token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.shared import bounded_batches, shared_dir, stored
from keystrata.llm.tokens import encoder

#: Stands for a null document id in the id file.
NULL_ID = np.iinfo(np.int64).min
#: Documents and tokens that are read back at once; a longer document is read alone.
READ_DOCS, READ_TOKENS = 4096, 1 << 20
MANIFEST = "part long, file string, dtype string, n_docs long, n_tokens long"


def _place(uri: str):
    """File system and path of a URI; plain paths are local."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        parts = urlsplit(uri)
        if parts.scheme == "file":
            return fs.LocalFileSystem(), parts.path
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _slices(uri: str, dtype: str):
    """A function that gives any slice of a flat file: memory-mapped where it is local, else read by range."""
    from pyarrow import fs

    system, path = _place(uri)
    if isinstance(system, fs.LocalFileSystem):
        mapped = np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.empty(0, dtype)
        return lambda begin, end: mapped[begin:end]
    size, opened = np.dtype(dtype).itemsize, system.open_input_file(path)
    return lambda begin, end: np.frombuffer(opened.read_at((end - begin) * size, begin * size), dtype)


def write_tokens(
    docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode documents and write them in ascending id order; return the manifest of files.

    Rows are range-partitioned by id (ties by a hash of the text, so that one repeated id doesn't
    fill a task) and sorted within the partition. Each task writes three flat little-endian files:
    ``.bin`` (the ids, unsigned), ``.idx`` (n+1 unsigned 64-bit offsets within the file) and
    ``.ids`` (the documents' ids). Names hold a random part: a task that runs twice, after a lost
    executor or by speculation, writes other files, and only those of the attempt that Spark
    accepted are in the manifest. ``base``, the ids before a file, is a prefix sum over the
    manifest, which has one row for each partition.

    Null text: only the end id. Null id: sorted first. Repeated rows: each written. Empty
    table: an empty manifest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, offsets, keys, files = TaskContext.get().partitionId(), encoder(tokenizer_path), [0], [], None
        for batch in batches:
            if files is None:
                system, folder = _place(out_dir)
                system.create_dir(folder, recursive=True)
                name = f"{out_dir}/part-{part:07d}-{uuid.uuid4().hex}"
                files = system.open_output_stream(_place(f"{name}.bin")[1])
            for ids in enc.encode(batch.column(1).to_pylist(), end_id):
                files.write(ids.tobytes())
                offsets.append(offsets[-1] + len(ids))
            keys.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        if files is None:
            return
        files.close()
        for suffix, values in ((".idx", np.array(offsets, "<u8")), (".ids", np.concatenate(keys))):
            with system.open_output_stream(_place(name + suffix)[1]) as f:
                f.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "dtype": [enc.dtype.str], "n_docs": [len(offsets) - 1], "n_tokens": [offsets[-1]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    manifest = stored(rows.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from the files; ids as unsigned 32-bit little-endian binary.

    Each file is mapped, or read by range where it isn't local, and walked in slices, so a task's
    memory doesn't grow with the file.
    """
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, idx, keys = (_slices(row["file"] + s, t) for s, t in ((".bin", row["dtype"]), (".idx", "<u8"), (".ids", "<i8")))
                at = 0
                while at < row["n_docs"]:
                    cut = idx(at, min(at + READ_DOCS, row["n_docs"]) + 1).astype("i8")
                    cut = cut[: max(int(np.searchsorted(cut, cut[0] + READ_TOKENS, "right")), 2)]
                    end = at + len(cut) - 1
                    ids = tokens(cut[0], cut[-1]).astype("<u4").tobytes()
                    some = keys(at, end).astype("i8")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, mask=some == NULL_ID),
                            pa.array(cut[:-1] + row["base"]),
                            pa.array(np.diff(cut)),
                            pa.array([ids[4 * (a - cut[0]) : 4 * (b - cut[0])] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = end

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op7_binary_output(spark, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back: one row per document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
