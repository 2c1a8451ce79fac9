"""Operator 12: near-duplicate embeddings by rotation codes, bounds and exact recomputation.

A unit vector o is turned by a seeded random rotation; its code is the sign of
every coordinate, the unit vector x nearest to o among the corners of a cube. Two
correction factors are stored with the code: a = <x, o>, and the part of o that the
code misses, sqrt(1 - a*a). For another vector q with b = <x, q>, b / a is an
unbiased estimate of <o, q>, and

    a*b - sqrt((1 - a*a) * (1 - b*b)) <= <o, q> <= a*b + sqrt((1 - a*a) * (1 - b*b))

holds for certain. Only pairs whose upper bound reaches the threshold are
computed again, in double precision, from the vectors themselves; so nothing below
the threshold is linked, and no compared pair is lost to an estimate. ``spread``
replaces the certain bound by the usual one in standard deviations.

Which pairs are compared: each vector falls into one cell of each of several random
rotations (the coordinate of largest size among the first few, with its sign), and
vectors that share a cell meet. The number of cells follows the number of vectors,
the number of rotations from the chance that a pair at the threshold itself shares
none (``recall``; closer pairs share one far more often). A pair is counted in the
first rotation whose cell it shares. Cells with many vectors are split into blocks,
and each pair of blocks is one group: a group returns the number of links of each
of its vectors and enough links to connect them, never a list of pairs.

Equal vectors are one class from the start. Defined cases: null, empty and zero
vectors and those with a null or non-finite component link with nothing, neither do
vectors of different length. Repeated rows are rows of their own and link with each
other. ``component_id`` is the smallest id in reach, nulls last; a row with a null
id has ``kept`` false. Other columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.components import components
from spanframe.llm.vectors import finite, matrices, not_zero
from spanframe.session import materialize, ship_package

#: Vectors that a cell should hold on average, and vectors of one block of a large cell.
CELL_ROWS, BLOCK_ROWS = 1024, 2048
#: Pairs whose bounds are held at once.
SIDE = 512


@lru_cache(maxsize=64)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever the size of their components."""
    out = matrix.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign codes packed into bytes, correction factor <code, vector>) of turned unit vectors."""
    ahead = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), np.minimum(ahead, 1.0)


def corners(codes: np.ndarray, dims: int) -> np.ndarray:
    """Unit vectors of packed codes."""
    return (np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dims))


def upper_bounds(a: np.ndarray, b: np.ndarray, dims: int, spread: float | None = None) -> np.ndarray:
    """Largest inner product that factors ``a`` and products ``b`` of code and vector allow."""
    rest = np.sqrt(np.maximum(0, 1 - a * a))
    if spread is not None and dims > 1:
        return b / a + spread * rest / a / math.sqrt(dims - 1)
    b = np.clip(b, -1, 1)
    return np.where(b >= a, 1.0, a * b + rest * np.sqrt(1 - b * b))


@lru_cache(maxsize=64)
def plan(dims: int, n: int, threshold: float, recall: float, seed: int) -> tuple[int, int, int]:
    """(coordinates of a cell's rotation that are looked at, rotations joined to one cell, number of cells a vector has).

    The chance that a pair at the threshold shares a cell comes from 4,096 random pairs of the same dimension.
    """
    wanted = max(1.0, n / CELL_ROWS)
    joined = max(1, math.ceil(math.log(wanted) / math.log(2 * dims))) if wanted > 1 else 1
    width = min(dims, max(1, math.ceil(wanted ** (1 / joined) / 2)))
    if wanted <= 1:
        return 0, 1, 1
    rng = np.random.default_rng([seed, dims, 7])
    x, z = (rng.normal(size=(4096, dims)) for _ in range(2))
    x = units(x)
    z = units(z - (z * x).sum(axis=1, keepdims=True) * x) if dims > 1 else x
    near = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z
    share = float((_corner(x, width) == _corner(near, width)).mean()) ** joined
    return width, joined, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - share)))) if share < 1 else 1


def _corner(turned: np.ndarray, width: int) -> np.ndarray:
    head = turned[:, :width]
    at = np.abs(head).argmax(axis=1)
    return at * 2 + (head[np.arange(len(head)), at] > 0)


def cells(vectors: np.ndarray, shape: tuple[int, int, int], seed: int) -> np.ndarray:
    """(vectors, cells) 32-bit names of the cells of unit vectors."""
    width, joined, count = shape
    out = np.zeros((len(vectors), count), np.int64)
    for t in range(count if width else 0):
        for j in range(joined):
            turned = vectors @ rotation(vectors.shape[1], seed + 1 + t * joined + j).T[:, :width]
            out[:, t] = (out[:, t] * (2 * width + 1) + _corner(turned, width)) % 0x7FFFFFFF
    return out.astype(np.int32)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row in reach of each of ``n`` rows over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None, table: int, threshold: float, spread: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right, or two rows of left) that link and share no earlier cell."""
    other = right or left
    dims = left["vectors"].shape[1]
    found = []
    for low in range(0, len(left["vectors"]), SIDE):
        part = slice(low, low + SIDE)
        b = corners(left["codes"][part], dims) @ other["turned"].T
        # room for the rounding of 32-bit sums
        open_pairs = upper_bounds(left["factors"][part][:, None], b, dims, spread) >= threshold - 1e-4
        i, j = np.nonzero(open_pairs)
        i += low
        if right is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            u, v = i[k: k + (1 << 16)], j[k: k + (1 << 16)]
            new = ~(left["cells"][u, :table] == other["cells"][v, :table]).any(axis=1)
            u, v = u[new], v[new]
            near = np.einsum("ij,ij->i", left["vectors"][u], other["vectors"][v]) >= threshold
            found.append((u[near], v[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def near_duplicates(rows: DataFrame, threshold: float = 0.9, recall: float = 0.9999, spread: float | None = None, seed: int = 12,
                    key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row; rows link at a cosine of ``threshold`` or more (over 0)."""
    spark = rows.sparkSession
    ship_package(spark)
    named = rows.select(F.col(key).alias("id"), F.when(finite(F.col(vector)) & not_zero(F.col(vector)), F.col(vector)).alias("v"))
    classes = named.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("low_id"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    total = classes.count()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in matrices(batch.column("v")):
                unit = units(matrix)
                dims = unit.shape[1]
                turned = unit @ rotation(dims, seed).T
                codes, factors = encode(turned)
                own = cells(unit, plan(dims, total, threshold, recall, seed), seed)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [some.column("class"), some.column("n"), some.column("v"), pa.array([dims] * len(at), pa.int32()),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors), pa.array(list(own), pa.list_(pa.int32()))],
                    ["class", "n", "v", "dims", "code", "factor", "cells"])

    kind = dict(classes.dtypes)["v"]
    coded = materialize(classes.select("class", "n", "v").mapInArrow(code, f"class bigint, n bigint, v {kind}, dims int, code binary, factor double, cells array<int>"), "codes")
    sized = coded.select("dims", F.posexplode("cells").alias("table", "cell")).groupBy("dims", "table", "cell").agg(F.count("*").alias("size"))
    sized = materialize(sized.where(F.col("size") > 1), "cells")
    at = coded.select("*", F.posexplode("cells").alias("table", "cell")).join(sized, ["dims", "table", "cell"])
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    at = at.withColumn("block", F.pmod(F.xxhash64("class"), blocks.cast("long")).cast("int")).withColumn("blocks", blocks)
    at = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.withColumn("first", F.least("block", "with")).withColumn("second", F.greatest("block", "with"))
    by = ["dims", "table", "cell", "first", "second"]

    def side(part: pa.Table, dims: int) -> dict[str, np.ndarray]:
        (_, matrix), = matrices(part["v"])
        unit = units(matrix)
        return {"vectors": unit, "turned": (unit @ rotation(dims, seed).T).astype(np.float32), "factors": np.asarray(part["factor"]),
                "codes": np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1),
                "cells": np.asarray(part["cells"].combine_chunks().flatten()).reshape(part.num_rows, -1)}

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        dims, table, _, first, second = (k.as_py() for k in key)
        part = part.combine_chunks()
        own = np.asarray(part["block"]) == first
        if first != second and (own.all() or not own.any()):
            part, u, v = part.slice(0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        elif first == second:
            u, v = linked(side(part, dims), None, table, threshold, spread)
        else:
            a, b = np.flatnonzero(own), np.flatnonzero(~own)
            u, v = linked(side(part.take(a), dims), side(part.take(b), dims), table, threshold, spread)
            u, v = a[u], b[v]
        times = np.asarray(part["n"])
        links = np.bincount(u, times[v], part.num_rows) + np.bincount(v, times[u], part.num_rows) if len(u) else np.zeros(part.num_rows)
        hit = np.flatnonzero(links)
        root = _roots(part.num_rows, u, v)[hit]
        names = np.asarray(part["class"])
        return pa.table({"u": names[hit], "v": names[root], "links": links[hit].astype(np.int64)})

    met = materialize(at.select(*by, "class", "n", "v", "code", "factor", "cells", "block").groupBy(*by).applyInArrow(meet, "u bigint, v bigint, links bigint"), "links")
    degree = met.groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    member = components(met.select("u", "v")).withColumnRenamed("node", "class")
    stand = classes.join(degree, "class", "left").join(member, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # the smallest id of a component may stand in any of its classes
    low = stand.groupBy("component").agg(F.min("low_id").alias("component_id"))
    done = stand.join(low, "component").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.join(done, "v", "left")
    whole = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"),
                      F.coalesce(F.col("id") == whole, F.lit(False)).alias("kept"))
