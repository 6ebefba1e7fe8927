"""Nearest neighbours by cosine, exactly and for any number of rows and queries.

Rows lie in cells around centres: each in the cell of the centre that it makes the smallest angle with, and a cell knows its largest angle. A query is
first compared with some rows of its own cell; its k-th best similarity so far then leaves out every cell that, by the triangle inequality
of angles, can't have a better row. What is left is searched in the cluster: rows are dealt in blocks of a bounded size, queries go to the blocks of the cells that are left for
them, and of every block a query's best k come back. Neither rows nor queries pass through the driver; it sees centres, and a row for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.storage import settle

#: Rows of a block, queries that one task compares with a block, queries that are compared at a time; centres at most, and how often they are moved to their cells' means.
BLOCK = 4096
QUERIES = 1 << 16
CHUNK = 512
CENTRES = 1024
MOVES = 2
#: Similarities are compared after rounding to DIGITS; bounds leave room for what arc cosines lose.
DIGITS = 12
SLACK = 1e-7
#: The cell of vectors without a direction, whose similarity to all others is 0.
NOWHERE = -1
FOUND = "query_id long, neighbour_id long, similarity double"


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


@dataclass(frozen=True)
class Index:
    """``rows(cell, blk, id, v)``, settled; ``centres``; by cell its largest angle and its number of blocks."""

    rows: DataFrame
    centres: np.ndarray
    radius: dict[int, float]
    blocks: dict[int, int]


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")


def _with_cell(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, angles = [], []
            for at in range(0, b.num_rows, BLOCK):
                units = _unit(_matrix(b.column(1).slice(at, BLOCK)))
                a = _angles(units, shared.value)
                cell = np.where((units != 0).any(axis=1), a.argmin(axis=1), NOWHERE)
                cells.append(cell)
                angles.append(np.where(cell == NOWHERE, 0.0, a.min(axis=1)))
            if cells:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(angles))], names=["id", "v", "cell", "angle"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, angle double")


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, centres: int = CENTRES, moves: int = MOVES) -> Index:
    """An index of all rows with a vector; vectors have one width. Centres begin as the square root of the rows' number, at most ``centres``, taken by the hash of their ids."""
    have = _vectors(rows, key, vector)
    n = have.count()
    some = have.orderBy(F.xxhash64("id"), "id").limit(max(1, min(centres, round(n**0.5)))).collect()
    at = _unit(np.array([r["v"] for r in some], dtype=np.float64)) if some else np.zeros((1, 1))
    for _ in range(moves if n else 0):
        means = _with_cell(have, at).where(F.col("cell") != NOWHERE).groupBy("cell").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m")).collect()  # a row for each centre
        at = _unit(np.array([r["m"] for r in sorted(means, key=lambda r: r["cell"])], dtype=np.float64)) if means else at
    placed = settle(_with_cell(have, at))
    cells = placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # a row for each cell
    blocks = {r["cell"]: -(-r["n"] // block) for r in cells}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for kv in (blocks or {0: 1}).items() for x in kv]), F.col("cell"))
    return Index(placed.select("cell", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("blk"), "id", "v"), at, {r["cell"]: r["r"] for r in cells}, blocks)


def _asked(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """``cell, blk, id, v`` for each block that a query is compared with: first one block of its nearest cell, then all of the cells left for it by its k-th similarity ``tau`` but that one."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, blocks = shared.value
        known = np.array(sorted(c for c in blocks if c != NOWHERE), dtype=np.int64)
        reach = np.array([radius[c] for c in known])
        names = ["cell", "blk", "id", "v"]
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                units = _unit(_matrix(b.column(1)))
                ids = b.column(0).to_numpy()
                angles = _angles(units, centres[known]) if len(known) else np.zeros((len(ids), 0))
                home = known[angles.argmin(axis=1)] if len(known) else np.full(len(ids), NOWHERE)
                started = [ids[q] % blocks[home[q]] for q in range(len(ids))] if blocks else []
                if first:
                    out = [(home[q], started[q], q) for q in range(len(started))]
                else:
                    tau = b.column(2).to_numpy(zero_copy_only=False)
                    open_ = np.cos(np.maximum(angles - reach, 0.0)) + SLACK >= tau[:, None]
                    open_ |= ~(units != 0).any(axis=1)[:, None]
                    pairs = [(c, q) for c, q in zip(known[np.nonzero(open_)[1]], np.nonzero(open_)[0])]
                    pairs += [(NOWHERE, q) for q in np.flatnonzero(tau <= SLACK)] if NOWHERE in blocks else []
                    out = [(c, k, q) for c, q in pairs for k in range(blocks[c]) if (c, k) != (home[q], started[q])]
                for i in range(0, len(out), BLOCK):
                    part = out[i : i + BLOCK]
                    take = pa.array([q for *_, q in part], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in part], pa.int32()), pa.array([k for _, k, _ in part], pa.int32()), b.column(0).take(take), b.column(1).take(take)], names=names)

    return queries.mapInArrow(run, "cell int, blk int, id long, v array<double>")


def _compare(asked: DataFrame, index: Index, k: int, skip_self: bool) -> DataFrame:
    """``FOUND``: of every block the best k rows for each query that asks it. A task holds one block and takes its queries one chunk after the other.

    Where many queries ask a cell's blocks they are dealt to salts, and the blocks sent to each.
    """
    asked = settle(asked)
    salts = asked.groupBy("cell", "blk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    told = index.rows.join(salts, ["cell", "blk"]).select("cell", "blk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("asks"), "id", "v")
    dealt = asked.join(salts, ["cell", "blk"]).select("cell", "blk", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, units = None, [], []
        for whole in batches:
            group = np.stack([whole.column(i).to_numpy().astype(np.int64) for i in range(4)])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1), whole.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                block = tuple(group[:3, low])
                if not group[3, low]:
                    if block != here:
                        here, ids, units = block, [], []
                    ids.append(whole.column(4).slice(low, high - low).to_numpy())
                    units.append(_unit(_matrix(whole.column(5).slice(low, high - low))))
                elif block == here:  # else the block has no rows
                    if len(ids) > 1:
                        ids, units = [np.concatenate(ids)], [np.concatenate(units)]
                    for at in range(low, high, CHUNK):
                        n = min(CHUNK, high - at)
                        yield _best(whole.column(4).slice(at, n).to_numpy(), _unit(_matrix(whole.column(5).slice(at, n))), ids[0], units[0], k, skip_self)

    rows = told.unionByName(dealt).repartition("cell", "blk", "salt").sortWithinPartitions("cell", "blk", "salt", "asks")
    return rows.mapInArrow(run, FOUND)


def _best(names: np.ndarray, q: np.ndarray, own: np.ndarray, units: np.ndarray, k: int, skip_self: bool) -> pa.RecordBatch:
    s = np.round(q @ units.T, DIGITS) + 0.0
    if skip_self:
        s[names[:, None] == own[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
    best = np.take_along_axis(s, order, 1)
    there = np.isfinite(best)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1]).reshape(best.shape)[there]), pa.array(own[order][there]), pa.array(best[there])], names=["query_id", "neighbour_id", "similarity"])


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """``query_id, neighbour_id, similarity, rank`` of the k most similar rows of an index for each query; ties go to the smaller id.

    Defined cases: rows and queries without a vector are left out; a vector of zeros has similarity 0 to all; rows that repeat an id are neighbours of their own, queries
    that repeat one are one query's rows; with ``skip_self`` rows with the query's id aren't its neighbours; fewer than k rows give fewer neighbours.
    """
    if not index.blocks:
        return queries.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    asked = settle(_vectors(queries, key, vector).dropDuplicates(["id"]))
    near = settle(_top(_compare(_asked(asked, index, True), index, k, skip_self), k))
    tau = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("tau"))
    rest = asked.join(tau, "id", "left").select("id", "v", F.coalesce("tau", F.lit(-2.0)).alias("tau"))
    return _top(near.drop("rank").unionByName(_compare(_asked(rest, index, False), index, k, skip_self)), k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """``search`` in an index of ``rows``."""
    return search(queries, build(rows, key, vector, block), k, key, vector, skip_self)


def share_compared(queries: DataFrame, index: Index, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> float:
    """Of all pairs of a query and a row, the share that ``search`` compares; the triangle inequality skips the others."""
    asked = settle(_vectors(queries, key, vector).dropDuplicates(["id"]))
    first = _asked(asked, index, True)
    near = _top(_compare(first, index, k, skip_self), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("tau"))
    rest = _asked(asked.join(near, "id", "left").select("id", "v", F.coalesce("tau", F.lit(-2.0)).alias("tau")), index, False)
    sizes = index.rows.groupBy("cell", "blk").agg(F.count("*").alias("n"))
    compared = first.unionByName(rest).join(sizes, ["cell", "blk"]).agg(F.sum("n")).first()[0] or 0
    return compared / max(1, asked.count() * index.rows.count())


def vote(neighbours: DataFrame, labelled: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``query_id, vote, n``: the most frequent label among a query's neighbours, the smallest of equally frequent ones."""
    named = neighbours.join(labelled.select(F.col(key).cast("long").alias("neighbour_id"), F.col(label).alias("label")), "neighbour_id")
    counted = named.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "label"))
    return counted.withColumn("r", best).where("r = 1").select("query_id", F.col("label").alias("vote"), "n")


def probe_accounting(df: DataFrame, truth: str, pred: str, voted: str, abstain) -> DataFrame:
    """``kind, outcome, n``: what following the vote would do to right, wrong-type and should-abstain rows."""
    kind = F.when(F.col(pred) == F.col(truth), "correct").when(F.col(truth) == abstain, "should_abstain").otherwise("wrong_type")
    outcome = F.when(F.col(voted) == F.col(pred), "confirm").when(F.col(voted) == F.col(truth), "fix").when(F.col(voted) == abstain, "to_abstain").otherwise("other")
    return df.groupBy(kind.alias("kind"), outcome.alias("outcome")).agg(F.count("*").alias("n"))
