"""#75: a stored inverted-file index over vectors, for approximate and for exact filtered neighbours.

Vectors are scaled to length one. Centroids come from a bounded sample (SAMPLE vectors, chosen by
a hash of their ids) by Lloyd's rounds in one task; then every vector is filed under its
nearest centroid together with its distance from it. A query probes the cells nearest to it;
joins are on filter columns and cell. The exact search takes the k-th distance of that first
probe as its reach: by the triangle inequality only cells whose border lies within reach, and in
these only vectors whose distance from the centroid differs by at most the reach, can hold
a nearer one.

Vectors of length zero have distance 1 from all others and a cell of their own. Null vectors are
not filed. All vectors have the same number of elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.durable import written
from lectern.functions.rules import cosine

#: Bounds of what one task fits and of what every task receives.
SAMPLE, MAX_CELLS, ROUNDS = 20_000, 1024, 8
PROBES = 4
#: The cell of vectors of length zero.
NOWHERE = -1
#: Distances are rounded to six places, so a vector may be this much farther than the k-th and still tie with it.
SLACK = 2e-6


def _unit(column: str) -> F.Column:
    """The vector in doubles, scaled to length one; zeros stay zeros."""
    x = F.transform(column, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(length == 0, x).otherwise(F.transform(x, lambda v: v / length))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apart(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows from all centroids."""
    square = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T
    return np.sqrt(np.maximum(square, 0))


def _lloyd(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, v) for b in batches for i, v in zip(b.column("id").to_pylist(), b.column("unit").to_pylist(), strict=True))
        if not rows:
            return
        x = np.array([v for _, v in rows])
        at = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(ROUNDS):
            near = _apart(x, at).argmin(1)
            total, n = np.zeros_like(at), np.bincount(near, minlength=len(at))
            np.add.at(total, near, x)
            at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(list(at), pa.list_(pa.float64()))], ["cell", "centroid"])

    return run


class VectorIndex:
    """Filed vectors (filter columns, id, unit, cell, away), and the centroids and radii of their cells."""

    def __init__(self, members: DataFrame, keys: list[str], centroids: np.ndarray, radii: np.ndarray):
        self.members, self.keys, self.centroids, self.radii = members, keys, centroids, radii


def build(vectors: DataFrame, keys: list[str], cells: int | None = None, keep: Callable[[DataFrame], DataFrame] = written) -> VectorIndex:
    """Files all rows (id, vector, filter columns) of `vectors`; `keep` writes the table of the index."""
    rows = vectors.filter("vector IS NOT NULL").select("id", *keys, _unit("vector").alias("unit"))
    n = rows.count()
    cells = cells or max(1, min(MAX_CELLS, int(n**0.5)))
    somewhere = F.exists("unit", lambda v: v != 0)
    drawn = rows.filter(somewhere & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))))
    found = drawn.select("id", "unit").coalesce(1).mapInArrow(_lloyd(cells), "cell int, centroid array<double>").collect()
    centroids = np.array([r["centroid"] for r in sorted(found, key=lambda r: r["cell"])])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("unit"))
            full = np.abs(x).max(1, initial=0) > 0
            cell, away = np.full(len(x), NOWHERE, dtype=np.int32), np.zeros(len(x))
            if len(centroids) and full.any():
                apart = _apart(x[full], centroids)
                cell[full], away[full] = apart.argmin(1), apart.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], [*b.schema.names, "cell", "away"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    members = keep(rows.mapInArrow(file, f"{shape}, cell int, away double"))
    radii = np.zeros(len(centroids))
    for r in members.filter(F.col("cell") >= 0).groupBy("cell").agg(F.max("away").alias("radius")).collect():
        radii[r["cell"]] = r["radius"]
    return VectorIndex(members, keys, centroids, radii)


def _probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """A row (query_id, filter columns, query, reach, cell, apart) for every cell to look at.

    Without a reach these are the nearest `probes` cells; with one, all others whose border lies within it.
    """
    centroids, radii, keys = index.centroids, index.radii, index.keys
    second = "reach" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows, cells, far = _matrix(b.column("query")), [], [], []
            apart = _apart(x, centroids) if len(centroids) else np.zeros((len(x), 0))
            order = np.argsort(apart, axis=1, kind="stable")
            reach = b.column("reach").to_numpy() if second else None
            for i in range(len(x)):
                mine = order[i, :probes]
                if second:
                    rest = order[i, probes:]
                    mine = rest[apart[i, rest] - radii[rest] <= reach[i] + SLACK]
                    if reach[i] * reach[i] >= 2 - 2 * SLACK:
                        mine = np.append(mine, NOWHERE)
                rows += [i] * len(mine)
                cells += mine.tolist()
                far += [0.0 if c == NOWHERE else float(apart[i, c]) for c in mine.tolist()]
            if rows:
                out = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells, pa.int32()), pa.array(far)], [*b.schema.names, "cell", "apart"])

    rows = queries.select("query_id", *keys, "query", *(["reach"] if second else []))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{shape}, cell int, apart double")


def _scored(index: VectorIndex, probed: DataFrame) -> DataFrame:
    met = index.members.join(probed, [*index.keys, "cell"])
    if "reach" in probed.columns:
        met = met.filter((F.col("cell") == NOWHERE) | (F.abs(F.col("away") - F.col("apart")) <= F.col("reach") + SLACK))
    dot = F.aggregate(F.zip_with("unit", "query", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return met.select("query_id", "id", F.round(1 - dot, 6).alias("distance"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "place", "id", "distance")


def _asked(queries: DataFrame, keys: list[str]) -> DataFrame:
    return queries.filter("query_vector IS NOT NULL").select("query_id", *keys, _unit("query_vector").alias("query"))


def probable_neighbours(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """The k nearest vectors with equal filter columns among those of the nearest cells: query_id, place, id, distance."""
    return _best(_scored(index, _probed(index, _asked(queries, index.keys), probes)), k)


def exact_neighbours(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """As `probable_neighbours`, but no nearer vector is missed: cells within reach of the first result are looked at too."""
    asked = _asked(queries, index.keys)
    first = written(_best(_scored(index, _probed(index, asked, probes)), k))
    reached = first.filter(F.col("place") == k).select("query_id", F.sqrt(2 * F.greatest("distance", F.lit(0.0))).alias("reach"))
    # Where less than k were found, everything is within reach: no two vectors of length one are farther apart than 2.
    again = asked.join(reached, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(2.0)))
    rest = _scored(index, _probed(index, again, probes))
    return _best(first.select("query_id", "id", "distance").unionByName(rest), k)


def nearest(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest vectors with equal `keys` where these leave few rows, such as the pieces of one slide; `build` is for all else."""
    joined = rows.filter("vector IS NOT NULL").join(queries, keys)
    scored = joined.select("query_id", "id", F.round(1 - cosine(F.col("vector"), F.col("query_vector")), 6).alias("distance"))
    return _best(scored, k)
