"""Operator 5: hierarchical packing of documents into windows of several context sizes."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.shared import bounded_batches, stored
from keystrata.llm.tokens import encoder

#: Context sizes; each a power of two, so that a full window of any tier needs no padding.
TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group: every group holds as many, whatever its tier, but for the last of each.
STEP_TOKENS = 1 << 16
#: Tokens that wait in a task before they are packed; bounds its memory.
BUFFER_TOKENS = 1 << 20
#: Rows of (tier, task, tokens before) that are broadcast, 24 bytes each; more are joined by a shuffle.
BROADCAST_LINES = 1 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, context long, part long, tier long, before long, ids binary"
_LONGS = PIECES.count("long")


class _Packer:
    """Packs the rows of one task. An item is (length, doc id, start, doc tokens, ids)."""

    def __init__(self, part: int, tiers: tuple[int, ...]):
        self.tiers, self.part, self.base = tiers, part, part << 40
        self.waiting: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.held, self.done, self.of_tier = 0, 0, [0] * (len(tiers) + 1)
        self.pieces: list[tuple] = []

    def route(self, item: tuple) -> None:
        """To the smallest tier that holds the item whole."""
        bisect.insort(self.waiting[self.tiers[bisect.bisect_left(self.tiers, item[0])]], item, key=lambda x: x[0])
        self.held += item[0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Full longest windows are cut off a document at once; the rest is routed."""
        top, n = self.tiers[-1], len(ids)
        for at in range(0, n - n % top, top):
            self.emit([(top, doc_id, at, n, ids[at : at + top])], top)
        if n % top:
            self.route((n % top, doc_id, n - n % top, n, ids[n - n % top :]))
        if self.held >= BUFFER_TOKENS:
            self.pack(last=False)

    def emit(self, items: list[tuple], context: int) -> None:
        """One sequence, with its tier (0: shorter than all) and that tier's tokens before it in the task."""
        tier, offset = bisect.bisect_right(self.tiers, context), 0
        for length, doc_id, start, total, ids in items:
            self.pieces.append((doc_id, start, length, total, self.base + self.done, offset, context, self.part, tier, self.of_tier[tier], ids.astype("<u4").tobytes()))
            offset += length
        self.of_tier[tier] += context
        self.done += 1

    def take(self, room: int) -> tuple | None:
        """The largest waiting item that fits; else the smallest one, cut to the room, its rest routed anew."""
        for tier in reversed(self.tiers):
            queue = self.waiting[tier]
            at = bisect.bisect_right(queue, room, key=lambda x: x[0])
            if at:
                self.held -= queue[at - 1][0]
                return queue.pop(at - 1)
        for tier in self.tiers:
            if self.waiting[tier]:
                length, doc_id, start, total, ids = self.waiting[tier].pop(0)
                self.held -= length
                self.route((length - room, doc_id, start + room, total, ids[room:]))
                return room, doc_id, start, total, ids[:room]
        return None

    def pack(self, last: bool) -> None:
        """Fill windows of each tier, the longest first, from its own queue and from shorter tiers.

        A window opens with its own tier's largest item; gaps take the largest items that fit, at
        last a cut one, so that each window is full while anything waits. At the end of a task
        the remaining tokens make windows of falling powers of two.
        """
        for context in reversed(self.tiers):
            while self.waiting[context] and self.held >= context:
                window, room = [self.waiting[context].pop()], context
                self.held -= window[0][0]
                room -= window[0][0]
                while room:
                    window.append(self.take(room))
                    room -= window[-1][0]
                self.emit(window, context)
        while last and self.held:
            room = context = min(1 << (self.held.bit_length() - 1), self.tiers[-1])
            window = []
            while room:
                window.append(self.take(room))
                room -= window[-1][0]
            self.emit(window, context)

    def flush(self) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * _LONGS, pa.binary())
        names = [x.split()[0] for x in PIECES.split(", ")]
        for at in range(0, len(self.pieces), 1024):
            some = self.pieces[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
        self.pieces.clear()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pack every document; one row per piece, with its ids as unsigned 32-bit little-endian binary.

    Documents are routed by length to tiers of context sizes (powers of two) and packed tier by
    tier where they lie: each scan partition is packed on its own, without a shuffle, in a bounded
    buffer, so a lost task is repeated alone and a hot source or a very long document needs no
    special care. sequence_id holds the partition number in its upper bits.

    Step groups are balanced over all tasks: the packed pieces are written once, each task's tokens
    of a tier are summed, and a prefix sum over the tasks places every sequence in its tier's
    line, which is cut into groups of step_tokens. Only the last group of a tier is short.
    step_group holds the tier's number in its upper bits.

    ``context`` is the sequence's length: it equals the sum of its pieces, so nothing is padded.
    What is left at the end of a task makes windows of falling powers of two; those below the
    shortest tier, fewer tokens than that tier's window for each task, have groups of their own.
    Null text: only the end id. Null ids and repeated rows are packed as they come. Empty table:
    no rows.
    """
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, enc = _Packer(TaskContext.get().partitionId(), tiers), encoder(tokenizer_path)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist(), end_id), strict=True):
                packer.add(doc_id, ids)
            yield from packer.flush()
        packer.pack(last=True)
        yield from packer.flush()
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(pack, PIECES), "packed-pieces")
    lines = pieces.groupBy("tier", "part").agg(F.sum("length").alias("tokens"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = stored(lines.select("tier", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "packed-lines")
    if lines.count() <= BROADCAST_LINES:
        lines = F.broadcast(lines)
    group = F.shiftleft("tier", 40) + F.floor((F.col("base") + F.col("before")) / step_tokens)
    return pieces.join(lines, ["tier", "part"]).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "context", group.alias("step_group"), "ids")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents; one row per piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")
