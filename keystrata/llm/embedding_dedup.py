"""Operator 8: near-duplicate embeddings by an exact metric range join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.components import connected_components
from keystrata.llm.shared import bounded_batches, scratch, stored

#: Least cosine of a link.
COSINE = 0.98
#: A label of n distinct vectors gets about sqrt(n) / 8 of them as pivots, PIVOTS at most.
PIVOTS_OF_ROOT, PIVOTS = 8, 128
#: So many labels, the largest of those above BLOCK_ROWS, have pivots; the others are one cell each.
PIVOT_LABELS = 64
#: Rows of one side of a block, and those that are multiplied at once.
BLOCK_ROWS, SLAB_ROWS = 2048, 256
#: What rounding may add to a distance.
SLACK = 1e-6


def _cells(pivots: dict[tuple[int, int], np.ndarray], radius: float):
    """Rows of each vector, with the distance to the cell's pivot: its own cell, and the cells of higher
    number that it visits since links may reach into them."""

    def place(batches):
        for rows in batches:
            for which, some in rows.groupby(["label", "dims"]):
                if which not in pivots:
                    yield some.assign(cell=0, own=True, away=0.0)
                    continue
                points, x = pivots[which], np.stack(some["v"].to_numpy())
                dots, every = x @ points.T, np.arange(len(x))
                away = np.sqrt(np.maximum(2 - 2 * dots, 0))
                home = away.argmin(1)
                # A linked y of cell j is at most radius away: d(x, j) <= d(y, j) + r <= d(y, i) + r <= d(x, i) + 2 r.
                reach = away <= away[every, home][:, None] + 2 * radius + SLACK
                # The same on the bisecting plane of both pivots, from which x is at most r away.
                gaps = np.sqrt(np.maximum(2 - 2 * (points @ points.T), 0))[home]
                reach &= dots[every, home][:, None] - dots <= radius * gaps + SLACK
                reach &= np.arange(len(points)) > home[:, None]  # the other cell's vectors visit this one else
                at, cell = np.nonzero(reach | (np.arange(len(points)) == home[:, None]))
                out = some.iloc[at].reset_index(drop=True)
                yield out.assign(cell=cell, own=cell == home[at], away=away[at, cell])

    return place


def _near(a: np.ndarray, away_a: np.ndarray, b: np.ndarray, away_b: np.ndarray, cosine: float) -> np.ndarray:
    """Which vectors of two sides are linked. Linked ones differ by at most the radius in their distance to the pivot."""
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    near = np.zeros((len(a), len(b)), bool)
    order_a, order_b = np.argsort(away_a), np.argsort(away_b)
    sorted_b = away_b[order_b]
    for at in range(0, len(a), SLAB_ROWS):
        some = order_a[at : at + SLAB_ROWS]
        low, high = np.searchsorted(sorted_b, [away_a[some[0]] - reach, away_a[some[-1]] + reach])
        others = order_b[low:high]
        near[np.ix_(some, others)] = a[some] @ b[others].T >= cosine
    return near


def _linked(cosine: float):
    """Of one block: links of each row, and, as a forest, how the block's rows hang together.

    A block of one side compares its rows with each other.
    """

    def join(block: pd.DataFrame) -> pd.DataFrame:
        sides = [block[block["first"]], block[~block["first"]]]
        one = bool(block["x"].iloc[0] == block["y"].iloc[0])
        if sides[0].empty or sides[1].empty and not one:
            return pd.DataFrame({"rep": [], "n_linked": [], "root": []}).astype("int64")
        (ids, weight, away, v), (others, weight_o, away_o, v_o) = (
            (x["rep"].to_numpy(), x["n"].to_numpy(), x["away"].to_numpy(), np.stack(x["v"].to_numpy())) for x in (sides[0], sides[0 if one else 1])
        )
        near = _near(v, away, v_o, away_o, cosine)
        if one:
            near &= ids[:, None] < others[None, :]
        rows, cols = near.any(1), near.any(0)
        ids, others, near = ids[rows], others[cols], near[np.ix_(rows, cols)]
        roots, roots_other = ids.copy(), others.copy()
        top = np.iinfo(np.int64).max
        while near.size:
            seen = np.minimum(roots, np.where(near, roots_other[None, :], top).min(1))
            seen_other = np.minimum(roots_other, np.where(near, seen[:, None], top).min(0))
            if (seen == roots).all() and (seen_other == roots_other).all():
                break
            roots, roots_other = seen, seen_other
        linked = [near @ weight_o[cols], near.T @ weight[rows]]
        return pd.DataFrame({"rep": np.concatenate([ids, others]), "n_linked": np.concatenate(linked), "root": np.concatenate([roots, roots_other])})

    return join


def find_near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept.

    Equal vectors of a label are first counted as one class. On the unit sphere a cosine of c is a
    distance of r = sqrt(2 - 2 c). A large label gets pivots, whose number grows with the root of its
    size; they cut the sphere into cells. Every vector lies in its nearest pivot's cell and visits
    each cell of higher number into which, by the triangle inequality, a link may reach, so each
    link is found in exactly one cell and cells are joined independently. Cells are cut into
    blocks of about block_rows by block_rows, so a hot label or cell becomes more tasks, not a
    larger one; within a block only vectors are multiplied whose distances to the pivot differ by
    r at most. A block returns counts for both ends and a forest of its links, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those of null
    label or null id, link with nothing.
    Vectors of different length never link. Repeated rows are copies. Empty table: no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.array_max(F.transform(v, F.abs))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & (most > 0), F.lit(False))
    rows = rows.withColumn("key", F.when(valid, F.xxhash64(v)))
    with scratch(spark):
        of_class = stored(_classes(rows, cosine, block_rows), "vector-result", keep=True)
    out = rows.join(of_class, ["label", "key", "v"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def _classes(rows: DataFrame, cosine: float, block_rows: int) -> DataFrame:
    """Rows (label, key, v, n_links, component_id): one for each distinct vector of a label."""
    most = F.array_max(F.transform("v", F.abs))
    classes = rows.filter(F.col("key").isNotNull()).groupBy("label", "key", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # Divided by its largest component first, a vector's square neither overflows nor vanishes.
    scaled = classes.withColumn("u", F.transform("v", lambda x: x / most))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x))
    scaled = scaled.withColumn("u", F.transform("u", lambda x: x / norm))
    classes = stored(scaled.select("label", "key", "v", "rep", "n", "u", F.size("u").alias("dims")), "vector-classes")
    same = classes.select("rep", "n", F.col("u").alias("v"), "label", "dims")
    large = same.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block_rows)
    large = large.orderBy(F.desc("size"), "label", "dims").limit(PIVOT_LABELS)
    wanted = F.least(F.ceil(F.sqrt("size") / PIVOTS_OF_ROOT), F.lit(PIVOTS))
    chosen = same.join(F.broadcast(large), ["label", "dims"]).filter(F.pmod(F.xxhash64("rep"), F.col("size")) < wanted)
    points: dict[tuple[int, int], list] = {}
    for r in chosen.select("label", "dims", "v").collect():  # about PIVOTS for each of PIVOT_LABELS labels
        points.setdefault((r["label"], r["dims"]), []).append(r["v"])
    shape = "rep long, n long, v array<double>, label long, dims int, cell int, own boolean, away double"
    cells = same.mapInPandas(_cells({k: np.array(x) for k, x in points.items()}, math.sqrt(2 - 2 * cosine)), shape)
    cells = stored(cells, "vector-cells")
    group = ["label", "dims", "cell"]
    sizes = cells.groupBy(*group).agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_guests")).filter("n_own > 0 and n_own + n_guests > 1")
    sizes = sizes.select(*group, F.ceil(F.col("n_own") / block_rows).alias("n_own"), F.ceil(F.col("n_guests") / block_rows).alias("n_guests"))
    # Chunks of a cell's own vectors come first, then those of guests; a block is a chunk x of own ones and any y from x on.
    some = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1)))
    chunk = F.when(F.col("own"), some("n_own")).otherwise(F.col("n_own") + some("n_guests"))
    cut = cells.join(sizes, group).withColumn("chunk", chunk)
    keep = [*group, "rep", "n", "v", "away"]
    first = cut.filter("own").select(*keep, F.col("chunk").alias("x"), F.explode(F.sequence("chunk", F.col("n_own") + F.col("n_guests") - 1)).alias("y"), F.lit(True).alias("first"))
    last = F.least(F.col("chunk"), F.col("n_own")) - 1
    second = cut.filter("chunk > 0").select(*keep, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("x"), F.col("chunk").alias("y"), F.lit(False).alias("first"))
    found = first.unionByName(second).groupBy(*group, "x", "y").applyInPandas(_linked(cosine), "rep long, n_linked long, root long")
    found = stored(found, "vector-links")
    counted = found.groupBy("rep").agg(F.sum("n_linked").alias("n_linked"))
    roots = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("label", "key", "v", "rep", "n").join(counted, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return of_class.select("label", "key", "v", (F.col("n") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return find_near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: coalesce(isfinite(x), false)), false)
       AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = c.a
"""
