"""Exact nearest neighbours inside classes by pivots.

Rows of a class go to the cell of their nearest pivot, a cell is cut into rings
by the distance to its pivot. Every asked vector is first compared with its own
block, which gives a bound of its k-th distance; by the triangle inequality only
rings that the bound reaches can hold anything nearer, and only they are visited.

Scale notes: rows are shuffled once for each phase, queries once per ring they
reach. Pivots are a bounded sample (at most PIVOTS rows of a class) that decides
how much work there is, never the result; they, and the reach of their cells,
are all that passes through the driver. Equal vectors are one query, and only
the k + 1 first of them can be neighbours of anything, so copies in any number
don't meet. Rings of more than BLOCK_ROWS rows, and the queries of a block, are
dealt over several groups.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4_000_000       # numbers in a block of distances
BLOCK_ROWS = 4096       # rows, or queries, in a group
PIVOTS = 1024           # at most, in a class
CELL_ROWS = 1024        # rows for each pivot, until there are PIVOTS
RINGS = 64              # at most, in a cell; larger rings are dealt by row number
SLACK = 1e-9            # relative, above the rounding of distances


def nearest(start: np.ndarray, own: np.ndarray, matrix: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int):
    """(place in ``start``, place in ``matrix``, squared distance) of the k rows
    nearest to each start but itself (``own`` and ``at`` number the rows),
    nearest first, ties by id and number."""
    query, row, dist = [], [], []
    step = max(1, BLOCK // max(1, matrix.size))
    for i in range(0, len(start), step):
        far = ((start[i:i + step][:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2)
        for j, d in enumerate(far):
            other = np.flatnonzero(at != own[i + j])
            if len(other) > k:
                other = other[~(d[other] > np.partition(d[other], k - 1)[k - 1])]
            other = other[np.lexsort((at[other], ids[other], d[other]))][:k]
            query.append(np.full(len(other), i + j))
            row.append(other)
            dist.append(d[other])
    if not query:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(query), np.concatenate(row), np.concatenate(dist)


def to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows to the pivots."""
    step = max(1, BLOCK // max(1, pivots.size))
    parts = [np.sqrt(((rows[i:i + step][:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(pivots)))


def _by_class(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        for c, own in frame.groupby("c", sort=False):
            yield c, own


def in_cells(rows: DataFrame, pivots: dict) -> DataFrame:
    """Adds ``cell`` (place of the nearest pivot) and ``d``, the distance to it."""
    def run(frames):
        for c, own in _by_class(frames):
            far = to_pivots(np.stack(own["v"].to_numpy()), pivots[c])
            cell = far.argmin(axis=1)
            yield own.assign(cell=cell.astype(np.int32), d=far[np.arange(len(far)), cell])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, cell int, d double")


def in_blocks(cells: DataFrame) -> DataFrame:
    """Adds ``ring`` and ``sub``: about BLOCK_ROWS rows have all three numbers
    in common. The tables of cuts and rings have at most classes x PIVOTS rows of
    RINGS numbers."""
    share = [i / RINGS for i in range(1, RINGS)]
    cuts = cells.groupBy("c", "cell").agg(F.percentile_approx("d", share, 1000).alias("cuts"), F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).alias("rings"))
    inside = F.size(F.filter("cuts", lambda x: x < F.col("d")))
    ring = cells.join(F.broadcast(cuts), ["c", "cell"]).withColumn("ring", F.floor(inside * F.col("rings") / RINGS).cast("int")).drop("cuts", "rings")
    size = ring.groupBy("c", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("subs"))
    return ring.join(F.broadcast(size), ["c", "cell", "ring"]).withColumn("sub", F.pmod("at", "subs").cast("int")).drop("subs")


def _home(kind: str, id_kind: str, k: int):
    """Of one block: its asked rows and their k nearest in it, and the bound
    (infinite where the block holds fewer than k rows)."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked = block[block["asked"]]
        if not len(asked):
            return pd.DataFrame({x: pd.Series(dtype=object) for x in ("c", "lead", "v", "bound", "cell", "ring", "sub", "best")})
        at, ids = block["at"].to_numpy(), block["id"].to_numpy()
        i, j, d = nearest(np.stack(asked["v"].to_numpy()), np.full(len(asked), -1), np.stack(block["v"].to_numpy()), at, ids, k)
        m = min(k, len(block))
        best = [[{"far": f, "id": x, "other": y} for f, x, y in zip(d[s:s + m].tolist(), ids[j[s:s + m]].tolist(), at[j[s:s + m]].tolist(), strict=True)] for s in range(0, len(i), m)]
        bound = np.sqrt(d[m - 1::m]) if m == k else np.full(len(asked), np.inf)
        return pd.DataFrame({"c": asked["c"].to_numpy(), "lead": asked["at"].to_numpy(), "v": asked["v"].to_numpy(), "bound": bound,
                             "cell": asked["cell"].to_numpy(), "ring": asked["ring"].to_numpy(), "sub": asked["sub"].to_numpy(), "best": best})
    return run, f"c {kind}, lead long, v array<double>, bound double, cell int, ring int, sub int, best array<struct<far: double, id: {id_kind}, other: long>>"


def reached(home: DataFrame, pivots: dict, reach: dict, kind: str) -> DataFrame:
    """The cells that a query's bound reaches: ``cell`` and ``d``, the distance
    of the query to its pivot; ``own_`` columns name its home block."""
    def run(frames):
        for c, own in _by_class(frames):
            far = to_pivots(np.stack(own["v"].to_numpy()), pivots[c])
            low, high = reach[c]
            slack = own["bound"].to_numpy()[:, None] * (1 + SLACK) + SLACK * (far + high)
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero(~((far - high > slack) | (low - far > slack)))
            out = own.iloc[i].assign(cell=j.astype(np.int32), d=far[i, j])
            yield out

    home = home.select("c", "lead", "v", "bound", F.col("cell").alias("own_cell"), F.col("ring").alias("own_ring"), F.col("sub").alias("own_sub"))
    return home.mapInPandas(run, f"c {kind}, lead long, v array<double>, bound double, own_cell int, own_ring int, own_sub int, cell int, d double")


def neighbours_in_class(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(c, base, best): the numbers of the k nearest other rows of its class, nearest
    first, ties by id and number, for every (c, base) of ``asked`` (distinct).

    ``rows`` holds c, at, id and v: the number of a row in its class (from 0, in
    random order: the first ones are the pivots), an id and a vector of finite
    numbers. A class of k rows or fewer gives all others."""
    kind, id_kind = (rows.schema[x].dataType.simpleString() for x in ("c", "id"))
    more = k + 1            # a row may find itself
    first = Window.partitionBy("c", "v").orderBy("id", "at")
    rank = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= more)
    bases = asked.join(rows.select("c", F.col("at").alias("base"), "v"), ["c", "base"])
    leads = rows.groupBy("c", "v").agg(F.min(F.struct("id", "at"))["at"].alias("lead"))
    bases = bases.join(leads, ["c", "v"]).select("c", "base", "lead").checkpoint()
    flags = bases.select("c", F.col("lead").alias("at"), F.lit(True).alias("asked")).distinct()
    able = rank.drop("r").join(flags, ["c", "at"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))

    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, min(PIVOTS, max(1, n // CELL_ROWS)))))
    held = rows.where(F.col("at") < most[F.col("c")]).select("c", "v").collect()      # at most PIVOTS rows a class
    pivots = {c: np.unique(np.array([r["v"] for r in held if r["c"] == c]), axis=0) for c in sizes}

    blocks = in_blocks(in_cells(able, pivots).checkpoint()).checkpoint()
    rings = blocks.groupBy("c", "cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), (F.max("sub") + 1).alias("subs")).checkpoint()
    ends = rings.groupBy("c", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()     # at most PIVOTS rows a class
    reach = {}
    for c, p in pivots.items():
        low, high = np.full(len(p), np.inf), np.full(len(p), -np.inf)
        for r in ends:
            if r["c"] == c:
                low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
        reach[c] = (low, high)

    key = ["c", "cell", "ring", "sub"]
    run, schema = _home(kind, id_kind, more)
    home = blocks.groupBy(*key).applyInPandas(run, schema).checkpoint()

    # other blocks within the bound
    slack = F.col("bound") * (1 + SLACK) + SLACK * (F.col("d") + F.col("high"))
    under, over = F.col("d") - F.col("high"), F.col("low") - F.col("d")
    visits = reached(home, pivots, reach, kind).join(rings, ["c", "cell"])
    visits = visits.where((F.isnan(under) | (under <= slack)) & (F.isnan(over) | (over <= slack)))
    visits = visits.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    visits = visits.where((F.col("cell") != F.col("own_cell")) | (F.col("ring") != F.col("own_ring")) | (F.col("sub") != F.col("own_sub")))
    visits = visits.select(*key, "lead", "v").checkpoint()
    parts = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    left = visits.join(parts, key).withColumn("part", F.pmod("lead", "parts").cast("int")).select(*key, "part", "lead", "v").toDF(*key, "part", "lead", "v")
    right = blocks.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "part", "at", "id", "v").toDF(*key, "part", "at", "id", "v")
    met = f"c {kind}, lead long, far double, id {id_kind}, other long"

    def visit(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({x: pd.Series(dtype=object) for x in ("c", "lead", "far", "id", "other")})
        at, ids = block["at"].to_numpy(), block["id"].to_numpy()
        i, j, d = nearest(np.stack(queries["v"].to_numpy()), np.full(len(queries), -1), np.stack(block["v"].to_numpy()), at, ids, more)
        return pd.DataFrame({"c": queries["c"].iloc[0], "lead": queries["lead"].to_numpy()[i], "far": d, "id": ids[j], "other": at[j]})
    found = left.groupBy(*key, "part").cogroup(right.groupBy(*key, "part")).applyInPandas(visit, met)
    found = found.unionByName(home.select("c", "lead", F.explode("best").alias("x")).select("c", "lead", "x.far", "x.id", "x.other"))
    best = found.groupBy("c", "lead").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id", "other"))), 1, more).alias("best"))
    # a row's own number goes; where it isn't among the first, the last does
    others = F.filter(F.transform("best", lambda x: x["other"]), lambda x: x != F.col("base"))
    return bases.join(best, ["c", "lead"]).select("c", "base", F.slice(others, 1, k).alias("best"))
