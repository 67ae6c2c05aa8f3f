"""Operator 3: near-duplicate documents by weighted MinHash (improved consistent weighted sampling)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.components import connected_components
from keystrata.llm.shared import bounded_batches, fresh, scratch, stored, words_of

#: Words of a shingle, and the least weighted Jaccard similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and samples in each: at a similarity of 0.8 a pair misses all bands with a chance of 0.1 %.
BANDS, ROWS = 13, 4
#: Pairs whose samples agree less than this aren't verified; a pair of similarity 0.8 does so once in a million.
LIKELY = 0.54
#: Hashed features whose counts tell which shingles may be frequent.
FEATURES = 1 << 20
#: Share of all documents from which on a shingle is frequent; it rises where documents are so long
#: that chance alone would fill the features.
FREQUENT = 0.001
_SLICES = 64
#: Members of a bucket up to which all its pairs are compared; larger ones go by pivots and blocks.
SMALL = 24
#: Rows and bytes of shingles that one side of a block holds on average.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: Up to so many buckets reach their rows by broadcast, 40 bytes each. Of more, the largest do, if above so
#: many rows; any other bucket holds at most one in HOT_BUCKETS of all rows and is joined by its key.
HOT_BUCKETS, HOT_ROWS = 1 << 16, 64
#: So many ids, 8 bytes each, may be broadcast to find their texts; more are joined.
BROADCAST_IDS = 1 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Words of a text that are hashed at once; a longer text goes piece by piece.
_PIECE = 1 << 14
#: Quantiles of gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x).
_GRID = np.linspace(0, 24, 1 << 18)
_GAMMA = np.interp((np.arange(1 << 12) + 0.5) / (1 << 12), 1 - (1 + _GRID) * np.exp(-_GRID), _GRID).astype(np.float32)
_powers = np.ones((2, 1), np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each; kept in the worker."""
    global _powers
    if _powers.shape[1] < n:
        base = int(_MIX[2])
        steps = np.full((2, 2 * n), [[base], [pow(base, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


def _piece_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each run of `size` words, from sums of bytes times powers: runs share one pass over the text."""
    line = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _powers_to(len(line) + 1)
    upto = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * power[: len(line)], out=upto[1:])
    gaps = np.flatnonzero(line == 32)
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    begins, ends = begins[: len(begins) - size + 1], ends[size - 1 :]
    return _mix((upto[ends] - upto[begins]) * inverse[begins])


def _run_hashes(words: list[bytes]) -> np.ndarray:
    size = min(SHINGLE, len(words))
    runs = range(0, len(words) - size + 1, _PIECE)
    return np.concatenate([_piece_hashes(words[i : i + _PIECE + size - 1], size) for i in runs])


def shingles_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text's words, ascending, and how often each occurs.

    A text of fewer words is one shingle; one without words has none.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(_run_hashes(words), return_counts=True)


def features_of(shingles: np.ndarray) -> np.ndarray:
    """Hashed feature of each shingle; ascending, as the shingles are."""
    return (shingles >> np.uint64(44)).astype(np.int64)


class Frequencies:
    """Inverse document frequencies: of frequent shingles from exact counts, the same for all others.

    A shingle in a share f of the documents weighs 1 + ln(f) / ln(share from which on it is frequent):
    1 if all documents have it, up to 2 for rare ones. Shares don't depend on the corpus's size, and a
    shingle of a given share weighs the same in any.
    """

    def __init__(self, shingles: np.ndarray, shares: np.ndarray, least: float):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.idf = (1 + np.clip(np.log(shares[order]) / np.log(least), 0, 1)).astype(np.float32)
        self.hot = np.zeros(FEATURES, bool)
        self.hot[features_of(self.shingles)] = True

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), 2, np.float32)
        at = np.flatnonzero(self.hot[features_of(shingles)])
        if len(at):
            place = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
            known = self.shingles[place] == shingles[at]
            out[at[known]] = self.idf[place[known]]
        return out


def weights_of(shingles: np.ndarray, counts: np.ndarray, frequencies: Frequencies) -> np.ndarray:
    """TF-IDF weights: 1 + ln(count), times the inverse document frequency."""
    return ((1 + np.log(counts)) * frequencies.of(shingles)).astype(np.float32)


def fingerprint_of(words: list[bytes]) -> str | None:
    """128 bits that stand for a text's sequence of words; null where it has none."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else None


def samples_of(shingles: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS consistent weighted samples of each document, as 32-bit hashes of (shingle, t).

    Of a shingle with weight w and sample k, r ~ gamma(2, 1), c ~ gamma(2, 1) and b ~ uniform come
    from its hash; t = floor(ln w / r + b), and the shingle of least ln c - r (t - b + 1) is taken.
    """
    sizes = np.array([len(s) for s in shingles])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat, log_w = np.concatenate(shingles), np.log(np.concatenate(weights))
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty((len(sizes), BANDS * ROWS), np.uint32)
    half, unit = np.float32(0.5), np.float32(1 / 65536)
    for k, seed in enumerate(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX[2]):
        h = flat ^ seed
        h *= _MIX[0]
        h ^= h >> np.uint64(32)
        h *= _MIX[1]
        parts = h.view(np.uint16).reshape(-1, 4)
        r = _GAMMA[parts[:, 3] >> 4]
        b = parts[:, 2] * unit
        t = np.floor(log_w / r + b)
        u = (parts[:, 0] + half) * unit
        u *= (parts[:, 1] + half) * unit
        a = np.log(-np.log(u))
        a -= r * (t - b + np.float32(1))
        least = np.flatnonzero(a == np.minimum.reduceat(a, begins)[of])
        first = least[np.searchsorted(of[least], np.arange(len(sizes)))]
        out[:, k] = (_mix(h[first] + t[first].astype(np.int64).view(np.uint64) * _MIX[1]) >> np.uint64(32)).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two documents' (shingles, weights)."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][at_a], b[1][at_b]).sum(dtype=np.float64))
    return shared / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared)


def _feature_counts(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that have each of FEATURES hashed shingles, all documents, and all their distinct shingles.

    Each task counts into one vector, which travels compressed in slices; slices are summed in two
    steps of bounded groups. The table's size doesn't depend on the corpus.
    """
    span = FEATURES // _SLICES

    def pack(values: np.ndarray) -> bytes:
        return zlib.compress(values.astype("<i8").tobytes(), 1)

    def count(batches):
        total, n, shingles = np.zeros(FEATURES, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = features_of(shingles_of(words_of(text))[0])
                if len(at):
                    total[at[np.append(True, at[1:] != at[:-1])]] += 1
                    shingles += len(at)
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "n": pa.array([n] * _SLICES), "shingles": pa.array([shingles] * _SLICES), "counts": pa.array([pack(x) for x in total.reshape(_SLICES, -1)])})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(span, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<i8")
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "n": [group["n"].sum()], "shingles": [group["shingles"].sum()], "counts": [pack(total)]})

    kind = "slice int, n long, shingles long, counts binary"
    found = docs.select("text").mapInArrow(count, kind).withColumn("part", F.spark_partition_id() % 64)
    for keys in (["slice", "part"], ["slice"]):
        found = found.groupBy(*keys).applyInPandas(add, kind)
    rows = {r["slice"]: r for r in found.collect()}  # _SLICES rows of a fixed table
    if not rows:
        return np.zeros(FEATURES, np.int64), 0, 0
    return np.concatenate([np.frombuffer(zlib.decompress(rows[k]["counts"]), "<i8") for k in range(_SLICES)]), rows[0]["n"], rows[0]["shingles"]


def document_frequencies(docs: DataFrame) -> Frequencies:
    """Frequent shingles of all documents with their exact counts.

    A first pass counts hashed features; only shingles of features that reach the least count can
    be frequent, so the second pass counts few shingles, exactly. A shingle is frequent from a share of
    FREQUENT on, or four times what an average feature has, so at most FEATURES / 4 are, whatever the corpus.
    """
    counts, n, total = _feature_counts(docs)
    least = max(FREQUENT, 4 * total / max(n, 1) / FEATURES)
    if least >= 1 or not n:
        return Frequencies(np.empty(0, np.uint64), np.empty(0), FREQUENT)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(counts >= least * n))

    def candidates(batches):
        hot = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            found = [s[hot[features_of(s)]] for s in (shingles_of(words_of(t))[0] for t in batch.column(0).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    found = docs.select("text").mapInArrow(candidates, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    rows = found.filter(F.col("df") >= least * n).toPandas()  # at most FEATURES / 4, see above
    return Frequencies(rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(float) / n, least)


def _signed(docs: DataFrame, sent) -> DataFrame:
    """Rows (id, fp, samples): the fingerprint and samples of each document; null where it has no words."""

    @F.arrow_udf("fp string, samples binary")
    def sign(texts: pa.Array) -> pa.Array:
        out: list[dict] = [{"fp": None, "samples": None}] * len(texts)
        held, at, room = [], [], 0
        todo = texts.to_pylist()
        for i, text in enumerate(todo):
            words = words_of(text)
            s, n = shingles_of(words)
            if len(s):
                held.append((s, weights_of(s, n, sent.value)))
                at.append((i, fingerprint_of(words)))
                room += len(s)
            if held and (room >= 1 << 15 or i + 1 == len(todo)):  # so many values fit the processor's cache
                for (j, fp), row in zip(at, samples_of(*map(list, zip(*held, strict=True))), strict=True):
                    out[j] = {"fp": fp, "samples": row.tobytes()}
                held, at, room = [], [], 0
        return pa.array(out, pa.struct([("fp", pa.string()), ("samples", pa.binary())]))

    return docs.select("id", sign("text").alias("s")).select("id", "s.fp", "s.samples")


def _key(samples: str, band: int) -> Column:
    """Hash of a band's samples, with its number."""
    size = 4 * ROWS
    return F.xxhash64(F.lit(band), F.substring(samples, band * size + 1, size))


def _vectors(docs: DataFrame, ids: DataFrame, n: int, sent) -> DataFrame:
    """Rows (id, shingles, weights) as binary of some documents; texts are only shuffled to more than BROADCAST_IDS of n ids."""
    docs = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.distinct(), "id", "left_semi")

    @F.arrow_udf("shingles binary, weights binary")
    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            s, n = shingles_of(words_of(text))
            out.append({"shingles": s.tobytes(), "weights": weights_of(s, n, sent.value).tobytes()})
        return pa.array(out, pa.struct([("shingles", pa.binary()), ("weights", pa.binary())]))

    return docs.select("id", weigh("text").alias("v")).select("id", "v.shingles", "v.weights")


def _agreement(a: str, b: str) -> Column:
    """Share of equal samples of two documents."""

    @F.arrow_udf("double")
    def equal(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in (a, b))
        return pa.array((x == y).mean(1))

    return equal(a, b)


def _similarities(*columns: str) -> Column:
    """Weighted Jaccard similarity of two documents' shingles and weights."""

    @F.arrow_udf("double")
    def compared(s: pa.Array, w: pa.Array, s2: pa.Array, w2: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in (s, w, s2, w2)), strict=True):
            x = [np.frombuffer(v, t) for v, t in zip(row, ("<u8", "<f4", "<u8", "<f4"), strict=True)]
            out.append(similarity((x[0], x[1]), (x[2], x[3])))
        return pa.array(out, pa.float64())

    return compared(*columns)


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, sent) -> DataFrame:
    """Those pairs (a, b) whose weighted Jaccard similarity reaches SIMILARITY.

    Pairs are first compared by their samples; only documents of likely pairs are weighed again.
    Joins are plain equi-joins, so a pivot in many pairs is a skewed key that Spark splits.
    """
    one = signed.select(F.col("id").alias("a"), F.col("samples").alias("samples_a"))
    two = signed.select(F.col("id").alias("b"), F.col("samples").alias("samples_b"))
    likely = pairs.join(one, "a").join(two, "b").filter(_agreement("samples_a", "samples_b") >= LIKELY)
    likely = stored(likely.select("a", "b"), "dedup-likely")
    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    vectors = stored(_vectors(docs, ends, 2 * likely.count(), sent), "dedup-vectors")
    one = vectors.select(F.col("id").alias("a"), F.col("shingles").alias("s"), F.col("weights").alias("w"))
    two = vectors.select(F.col("id").alias("b"), F.col("shingles").alias("s2"), F.col("weights").alias("w2"))
    found = likely.join(one, "a").join(two, "b").filter(_similarities("s", "w", "s2", "w2") >= SIMILARITY)
    return stored(found.select("a", "b"), "dedup-links")


def _with_buckets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows joined with their bucket (key, n rows, ...; a written table); a hot bucket's rows aren't dealt out by its key."""
    if buckets.count() <= HOT_BUCKETS:
        return rows.join(F.broadcast(buckets), "key")
    hot = stored(buckets.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "key").limit(HOT_BUCKETS), "dedup-hot")
    keys = F.broadcast(hot.select("key"))
    rest = rows.join(keys, "key", "left_anti").join(buckets.join(keys, "key", "left_anti"), "key")
    return rows.join(F.broadcast(hot), "key").unionByName(rest)


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs to verify among buckets' rows (key, id, component), the rows of large buckets, and these buckets.

    A bucket whose members hang together already needs nothing. In a small one all pairs of
    different components are compared. In a large one every member is compared with two pivots, the
    smallest id and a hashed one; and if only a few members hang apart from the first pivot, these
    are compared with all.
    """
    order = F.struct(F.xxhash64("id", "key").alias("h"), F.col("id"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("pivot"), F.min(order)["id"].alias("other"))
    buckets = stored(buckets.filter("low <> high").select("key", "n", "pivot", "other"), "dedup-buckets")
    small = rows.join(buckets.filter(F.col("n") <= SMALL).select("key"), "key").select("key", "id", "component")
    mate = small.select("key", F.col("id").alias("b"), F.col("component").alias("component_b"))
    pairs = small.join(mate, "key").filter("id < b and component <> component_b").select(F.col("id").alias("a"), "b")
    buckets = stored(buckets.filter(F.col("n") > SMALL), "dedup-large-buckets")
    large = stored(_with_buckets(rows.select("key", "id"), buckets), "dedup-large")
    starred = large.select("id", F.explode(F.array_distinct(F.array("pivot", "other"))).alias("p")).filter("id <> p")
    pairs = pairs.unionByName(starred.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")))
    return pairs.distinct(), large.select("key", "id"), buckets


def _rest(large: DataFrame, buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After the pivots: pairs of the few that hang apart in a large bucket, and rows of those where many do."""
    heads = labels.select(F.col("id").alias("pivot"), F.col("component").alias("main"))
    heads = stored(buckets.join(heads, "pivot", "left").select("key", "n", F.coalesce("main", "pivot").alias("main")), "dedup-heads")
    rows = _with_buckets(_labelled(large, labels), heads).withColumn("apart", F.col("component") != F.col("main"))
    rows = stored(rows.select("key", "id", "component", "apart"), "dedup-rest")
    count = rows.groupBy("key").agg(F.sum(F.col("apart").cast("long")).alias("n_apart"), F.count(F.lit(1)).alias("n")).filter("n_apart > 0")
    count = stored(count, "dedup-counts")
    rows = stored(_with_buckets(rows, count), "dedup-apart")
    few = rows.filter(F.col("n_apart") <= SMALL).select("key", "id", "component", "apart")
    alone = few.filter("apart").groupBy("key").agg(F.collect_list(F.struct(F.col("id").alias("b"), F.col("component").alias("component_b"))).alias("mates"))  # SMALL at most
    alone = stored(alone.join(count.select("key", "n"), "key"), "dedup-mates")
    pairs = _with_buckets(few, alone).select("id", "component", F.explode("mates").alias("m")).filter("component <> m.component_b")
    return pairs.select(F.least("id", "m.b").alias("a"), F.greatest("id", "m.b").alias("b")).distinct(), rows.filter(F.col("n_apart") > SMALL).select("key", "id", "component")


def _joined(block: pd.DataFrame) -> pd.DataFrame:
    """Of a block, links that connect what hangs together: pairs of two sides, likely by their samples, then verified.

    Rows that are connected already aren't compared again, so a block returns a forest, not its pairs.
    """
    block = block.drop_duplicates("id")
    ids, first = block["id"].to_numpy(), block["side"].to_numpy() < 1
    samples = np.frombuffer(b"".join(block["samples"]), np.uint32).reshape(len(block), -1)
    vectors = [(np.frombuffer(s, "<u8"), np.frombuffer(w, "<f4")) for s, w in zip(block["shingles"], block["weights"], strict=True)]
    root = np.unique(block["component"].to_numpy(), return_inverse=True)[1]
    other = np.flatnonzero(~first) if not first.all() else np.arange(len(block))
    links = []
    for i in np.flatnonzero(first):
        near = other[((samples[other] == samples[i]).mean(1) >= LIKELY) & (root[other] != root[i])]
        for j in near:
            if root[i] != root[j] and similarity(vectors[i], vectors[j]) >= SIMILARITY:
                root[root == root[j]] = root[i]
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _blocks(rows: DataFrame, signed: DataFrame, docs: DataFrame, sent) -> DataFrame:
    """Links within buckets of any size: each is cut into chunks by a hash, and each two chunks make a block.

    There are as many chunks as rows or bytes of shingles demand, so long documents make blocks of fewer rows.
    """
    vectors = stored(_vectors(docs, rows.select("id"), rows.count(), sent), "dedup-vectors")
    sized = stored(rows.join(vectors.select("id", (F.octet_length("shingles") + F.octet_length("weights")).alias("bytes")), "id"), "dedup-sized")
    chunks = sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).alias("chunks"))
    cut = _with_buckets(sized.drop("bytes"), stored(chunks, "dedup-chunks")).withColumn("chunk", F.pmod(F.xxhash64("id", "key"), F.col("chunks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    cut = cut.select("key", "id", "component", "chunk", every.alias("mate"))
    pair = {"x": F.least("chunk", "mate"), "y": F.greatest("chunk", "mate"), "side": (F.col("chunk") > F.col("mate")).cast("int")}
    full = cut.withColumns(pair).join(signed.select("id", "samples"), "id").join(vectors, "id")
    found = full.select("key", "x", "y", "side", "id", "component", "samples", "shingles", "weights").groupBy("key", "x", "y").applyInPandas(_joined, "a long, b long")
    return stored(found, "dedup-links")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, id, ...) with the id's component so far: its own id where it has no link."""
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id): the class of every row; class_id is its smallest id.

    Texts with the same words are copies and count once from then on. Every representative gets
    samples of its weighted shingles; equal bands make buckets, from which pairs are drawn and
    verified by exact weighted Jaccard similarity. Links make classes.

    Buckets of any size are worked off whole. Large ones are compared with pivots first, which
    settles a large group of copies in one go; where few members hang apart these meet all
    others; where many do, as with a passage that thousands of otherwise different documents
    share, the bucket is cut into blocks of a bounded size, and a block compares what isn't
    connected yet, by samples first. So within a bucket no link is lost that connects classes.

    Null, empty and wordless texts have no shingles: each is a class of its own. Null ids: class
    null, never a representative. Rows that repeat an id are judged each by its own text. Empty table: no rows.
    """
    found = near_duplicate_rows(docs, id_col, text_col)
    return found.select(F.col(id_col).cast("long").alias("id"), F.col(f"`{found.columns[-2]}`").alias("class_id"))


def _repeats(source: DataFrame) -> bool:
    """Whether rows repeat an id."""
    return not source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _classes(source: DataFrame) -> DataFrame:
    """Rows (id, class_id) of all texts with words; ids of source are there once each."""
    bounded_batches(source.sparkSession)
    with scratch(source.sparkSession):
        return stored(_linked_classes(source), "dedup-result", keep=True)


def _linked_classes(source: DataFrame) -> DataFrame:
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(document_frequencies(source))
    every = stored(_signed(source, sent), "dedup-samples")
    copies = every.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.min("samples").alias("samples"))
    signed = stored(copies.select("fp", F.col("rep").alias("id"), "samples"), "dedup-classes")
    alone = signed.select("id", F.col("id").alias("component")).limit(0)
    rows = signed.select("id", F.explode(F.array(*[_key("samples", band) for band in range(BANDS)])).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    rows = stored(rows.join(shared, "key"), "dedup-rows")
    pairs, large, buckets = _pairs(_labelled(rows, alone))
    links = _verified(pairs, signed, source, sent)
    labels = connected_components(links)
    if not large.isEmpty():
        pairs, many = _rest(large, buckets, labels)
        links = links.unionByName(_verified(pairs, signed, source, sent))
        labels = connected_components(links)
        if not many.isEmpty():
            links = links.unionByName(_blocks(_labelled(many.drop("component"), labels), signed, source, sent))
            labels = connected_components(links)
    of_class = signed.select("fp", "id").join(labels, "id", "left").select("fp", F.coalesce("component", "id").alias("class_id"))
    return every.select("id", "fp").join(of_class, "fp").select("id", "class_id")


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, ``class_id`` and ``kept`` (renamed if taken), each row judged by its own text.

    Classes are those of near_duplicate_classes over each distinct id and text: class_id is the
    smallest id of a class, and its representative is one text of that id, chosen by its digest. kept
    holds for rows of the representative, so the same id and text are kept or not together, and for
    all rows of null id, whose class is null.
    """
    own, digest, at, to = fresh(docs, "own_id", "text_digest", "class_id", "kept")
    rows = docs.withColumn(own, F.col(id_col).cast("long"))
    source = rows.filter(F.col(own).isNotNull()).select(F.col(own).alias("id"), F.col(text_col).alias("text"))
    key, named = fresh(docs.withColumns({c: F.lit(0) for c in (own, digest, at, to)}), "dedup_key", "dedup_id")
    if not _repeats(source):
        classes = _classes(source).select(F.col("id").alias(key), F.col("class_id").alias(at))
        found = rows.join(classes, F.col(own) == F.col(key), "left").withColumn(at, F.coalesce(at, own))
        return found.withColumn(to, F.coalesce(F.col(own) == F.col(at), F.lit(True))).select(*docs.columns, at, to)
    texts = source.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["id", "digest"])
    texts = stored(texts.withColumn("key", F.monotonically_increasing_id()), "dedup-documents")
    classes = _classes(texts.select(F.col("key").alias("id"), "text")).withColumnRenamed("id", "key")
    classes = texts.select("key", "id", "digest").join(classes, "key", "left").withColumn("class_id", F.coalesce("class_id", "key"))
    classes = stored(classes, "dedup-texts")
    first = F.min(F.struct("id", "digest", "key"))
    heads = classes.groupBy("class_id").agg(first.alias("head"))  # of each class one row: the least is combined before the shuffle
    heads = classes.join(heads, "class_id").select(F.col("id").alias(named), F.col("digest").alias(digest), F.col("head.id").alias(at), (F.col("key") == F.col("head.key")).alias(to))
    same = (F.col(own) == F.col(named)) & F.sha2(F.col(text_col), 256).eqNullSafe(F.col(digest))
    return rows.join(heads, same, "left").withColumn(to, F.coalesce(to, F.lit(True))).select(*docs.columns, at, to)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each class the representative of smallest id, and all of null id.

    A row goes only if its own text is a copy, whatever else has its id.
    """
    found = near_duplicate_rows(docs, id_col, text_col)
    return found.filter(F.col(found.columns[-1])).select(docs.columns)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "class_id", "kept")
