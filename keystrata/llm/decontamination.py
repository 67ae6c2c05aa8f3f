"""Operator 2: benchmark decontamination by one Aho-Corasick automaton over word windows."""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import WORD_TABLE, bounded_batches, fresh, stored, words_of

#: Consecutive words of an item that count as an occurrence.
WINDOW = 13
#: Words and bytes of items that one automaton holds on average; a larger benchmark takes several passes.
AUTOMATON_WORDS, AUTOMATON_BYTES = 2_000_000, 16 << 20

_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_machines: dict[str, "ItemMachine"] = {}


class ItemMachine:
    """An Aho-Corasick automaton over numbered words of items; it has about one node for each item word.

    A window of w words holds a whole one of the item's blocks of (w + 1) / 2 words, laid end to end
    from its first word. So the automaton's patterns are these blocks, and items shorter than a
    window as a whole. Around a block that occurs in a text, its neighbours in the item are compared
    word by word, up to where the furthest window with this block ends: at least w words in a row
    are an occurrence. Blocks with the same neighbours are compared once for all their items.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.flat, self.starts, self.ids = array("i", [-1] * window), [], []
        patterns: dict[tuple, int] = {}
        #: Of each pattern: positions of blocks in flat, or for a whole item its number below zero.
        self.places: list[list[int]] = []
        self.sizes: list[int] = []
        #: Further items of a block's place.
        self.more: dict[int, list[int]] = {}
        around: dict[tuple[int, bytes], int] = {}
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not words:
                continue
            number, start = len(self.ids), len(self.flat)
            self.ids.append(item_id)
            self.starts.append(start)
            self.flat.extend(words)
            self.flat.extend([-1] * window)  # stands between items, equal to no word
            whole = len(words) < window
            size = len(words) if whole else self.block
            for at in range(0, len(words) - size + 1, size):
                key = tuple(words[at : at + size])
                k = patterns.setdefault(key, len(patterns))
                if k == len(self.places):
                    self.places.append([])
                    self.sizes.append(size)
                if whole:
                    self.places[k].append(-1 - number)
                    continue
                q = start + at
                same = (k, self.flat[q + size - window : q + window].tobytes())
                if same in around:
                    self.more.setdefault(around[same], []).append(number)
                else:
                    around[same] = q
                    self.places[k].append(q)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in patterns.items():
            self.machine.add_word(key, k)
        if patterns:
            self.machine.make_automaton()

    def scan(self, words: list[bytes], found: set) -> list[tuple[int, int]]:
        """Occurrences in a text as (first word, word after the last); ids of their items are added to found."""
        get = self.numbers.get
        text = tuple([get(w, 0) for w in words])
        out = []
        if not self.ids or not any(text):
            return out
        for end, k in self.machine.iter(text):
            size = self.sizes[k]
            first = end - size + 1
            for q in self.places[k]:
                if q < 0:
                    out.append((first, end + 1))
                    found.add(self.ids[-1 - q])
                    continue
                left = right = 0
                room = min(self.window - size, first)
                while left < room and text[first - left - 1] == self.flat[q - left - 1]:
                    left += 1
                room = min(self.window - size, len(text) - end - 1)
                while right < room and text[end + right + 1] == self.flat[q + size + right]:
                    right += 1
                if left + size + right >= self.window:
                    out.append((first - left, end + right + 1))
                    found.add(self.ids[bisect_right(self.starts, q) - 1])
                    found.update(self.ids[number] for number in self.more.get(q, ()))
        return out


def _machine(key: str, items: list, window: int) -> ItemMachine:
    """The worker's automaton; only the last one is kept."""
    if key not in _machines:
        _machines.clear()
        _machines[key] = ItemMachine(items, window)
    return _machines[key]


def _scan(texts: list[str | None], before: list[dict | None], machine: ItemMachine) -> list[dict]:
    """Of each text: words, hit words, ids of items found, and hit runs as words and in the original text.

    before holds what an earlier automaton has found.
    """
    out = []
    for text, old in zip(texts, before, strict=True):
        raw = (text or "").encode()
        flat = raw.translate(WORD_TABLE)
        words, items = flat.split(), set(old["items"] if old else ())
        at = machine.scan(words, items)
        runs = _merged([*at, *((r["first"], r["after"]) for r in (old["runs"] if old else ()))])
        n_hit = sum(after - first for first, after in runs)
        out.append(
            {
                "n_words": len(words), "n_hit": n_hit, "items": sorted(x for x in items if x is not None), "runs": [{"first": first, "after": after} for first, after in runs],
                "spans": _original(raw, flat, words, runs), "contaminated": n_hit > 0 and 20 * n_hit >= len(words),
            }
        )
    return out


def _merged(places: list[tuple[int, int]]) -> list[list[int]]:
    """Occurrences as disjoint runs of word numbers."""
    runs: list[list[int]] = []
    for first, after in sorted(places):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], after)
        else:
            runs.append([first, after])
    return runs


def _original(raw: bytes, flat: bytes, words: list[bytes], runs: list[list[int]]) -> list[dict]:
    """Runs of word numbers as code-point spans of the original text."""
    spans, pos, number, chars, last = [], 0, 0, 0, 0
    for first, after in runs:
        while number < first:
            pos = flat.index(words[number], pos) + len(words[number])
            number += 1
        begin = pos = flat.index(words[number], pos)
        while number < after:
            pos = flat.index(words[number], pos) + len(words[number])
            number += 1
        chars += len(raw[last:begin].decode())
        size = len(raw[begin:pos].decode())
        spans.append({"start": chars, "end": chars + size})
        chars, last = chars + size, pos
    return spans


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of docs and a struct column ``contamination`` (renamed if the name is taken).

    Fields: n_words, n_hit, items (ids of items with an occurring window, ascending), runs (hit
    passages as word numbers, the last one excluded), spans (the same as code points of the original
    text) and contaminated (n_hit > 0 and at least a twentieth of the words).

    The benchmark is measured first. If it has at most AUTOMATON_WORDS words and AUTOMATON_BYTES
    bytes, one automaton holds it and each text is scanned once where it lies. A larger one is dealt by a hash
    into as many parts as that takes; then each part is a pass over the documents, written in
    between, that adds its occurrences to those found before. So driver and workers hold one
    part at a time, and the result is the same. Documents are never shuffled.

    Null or wordless text: no words, nothing hit. Null item text: no windows. A null item id
    marks words, but isn't listed. Repeated items: once. Empty benchmark: nothing hit.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).distinct()
    n_words, n_bytes = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_ANY_WORD))), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n_words // AUTOMATON_WORDS), -(-n_bytes // AUTOMATON_BYTES), 1)
    run, span = (pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())])) for x, y in (("first", "after"), ("start", "end")))
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("runs", run), ("spans", span), ("contaminated", pa.bool_())])
    declared = "n_words long, n_hit long, items array<long>, runs array<struct<first:long,after:long>>, spans array<struct<start:long,end:long>>, contaminated boolean"
    into = fresh(docs, "contamination")[0]
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        sent, key = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()]), uuid.uuid4().hex  # a part, bounded above

        def scan(texts: pa.Array, before: pa.Array | None = None, sent=sent, key=key) -> pa.Array:
            old = before.to_pylist() if before is not None else [None] * len(texts)
            return pa.array(_scan(texts.to_pylist(), old, _machine(key, sent.value, window)), kind)

        if not part:
            first = F.arrow_udf(lambda texts, f=scan: f(texts), declared)
            out = docs.withColumn(into, first(F.col(text_col)))
        else:
            further = F.arrow_udf(lambda texts, before, f=scan: f(texts, before), declared)
            out = stored(out, "contamination-pass").withColumn(into, further(F.col(text_col), F.col(into)))
    return out


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.sort_array(items.cast("array<string>")), ","), 256)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's 13-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        items_digest(c["items"]).alias("items_sha256"),
        c["contaminated"].alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
