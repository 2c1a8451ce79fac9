"""Operator 13: hard negatives by exact integer scores from subset-sum tables.

Components become integers, floor(scale * x). A candidate is kept as bit planes:
for each bit of its components, in two's complement, one byte for eight
dimensions. For an anchor, the sums of all subsets of eight components are
computed once (256 for each eight dimensions), so a plane's byte looks up what
these eight dimensions add, and

    score = sum over planes p of 2**p * (sum over groups g of table[g][byte[p, g]])

with the top plane counted negative: the full integer inner product without a
multiplication of components.

Anchors are a stated query set. They and the candidates are dealt into blocks of
bounded size, and every (anchor block, candidate chunk) is one group: nothing is
collected or broadcast, and a group keeps its best few rows for each anchor, so no
list of pairs is ever written. The best rows of all groups meet by anchor.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; neither do rows with a component so large that a score
could leave 64 bits (|scale * x| above sqrt(2**62 / dimensions): over a million
for 64 dimensions at scale 256). Vectors of different length are never compared.
Empty vectors score 0 with each other. Rows with a null id can be positives and
negatives, after all others of their score; they can be anchors if ``is_anchor``
says so. Repeated rows are rows of their own. Ties go to the smaller id. Other
columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.vectors import finite, matrices
from spanframe.session import materialize, ship_package

#: Bounds of what one group holds: rows and bytes of a candidate chunk and of an anchor block.
CHUNK_ROWS, BLOCK_ROWS, GROUP_BYTES = 1 << 16, 1 << 14, 1 << 24
#: Anchors whose tables stand side by side, and candidates scored with them at once.
SIDE, RUN = 64, 2048


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups of eight) bytes of integers in two's complement."""
    n, dims = values.shape
    wide = np.zeros((n, -(-dims // 8) * 8), np.int64)
    wide[:, :dims] = values
    return np.stack([np.packbits(((wide >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], axis=1) if dims else np.zeros((n, planes, 0), np.uint8)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each eight dimensions, the sum of every subset of an anchor's components."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dims] = anchors
    parts = wide.reshape(n, groups, 8)
    small = dims == 0 or int(np.abs(wide).max(initial=0)) * dims < 1 << 31
    tables = np.zeros((groups, 256, n), np.int32 if small else np.int64)
    for bit in range(8):
        tables[:, 1 << bit: 2 << bit] = tables[:, : 1 << bit] + parts[:, :, bit].T[:, None, :].astype(tables.dtype)
    return tables


def lookup_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products from subset sums and packed planes."""
    n, count, groups = planes.shape
    out = np.zeros((n, tables.shape[2]), np.int64)
    for p in range(count):
        part = np.zeros(out.shape, tables.dtype)
        for g in range(groups):
            part += tables[g][planes[:, p, g]]
        out += part.astype(np.int64) * (-(1 << p) if p == count - 1 else 1 << p)
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, earlier places first among equals."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.argsort(-scores[near], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def _scored(anchors: pa.Table, rows: pa.Table, dims: int, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, its scores with all rows of the group)."""
    packed = np.frombuffer(b"".join(rows["planes"].to_pylist()), np.uint8).reshape(rows.num_rows, planes, -(-dims // 8))
    for _, matrix in matrices(anchors["parts"]):
        for low in range(0, len(matrix), SIDE):
            tables = subset_sums(matrix[low: low + SIDE])
            scores = np.concatenate([lookup_scores(tables, packed[a: a + RUN]) for a in range(0, len(packed), RUN)])
            for k in range(tables.shape[2]):
                yield low + k, scores[:, k]


def _codes(labels: pa.ChunkedArray, more: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as comparable integers, whatever their type."""
    names = pa.concat_arrays([*labels.chunks, *more.chunks]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return names[: len(labels)], names[len(labels):]


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels within a band of the positive's score.

    An anchor's positives are its ``positives`` best other rows of the same
    label. Negatives of a positive score p have low * p <= 100 * score <= high * p;
    the first ``negatives`` are returned as (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score).
    """
    spark = rows.sparkSession
    ship_package(spark)
    cells = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    base = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), cells.alias("cells"))
    reach = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("cells"), F.lit(1))) - 1
    base = base.where(F.col("label").isNotNull() & finite(F.col("cells"))).where(F.forall("cells", lambda x: F.abs(x) < reach))
    base = base.withColumn("cells", F.transform("cells", lambda x: F.floor(x)))

    most = base.agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(F.size("cells")).alias("dims"),
                    F.max(F.greatest(F.abs(F.array_max("cells")), F.abs(F.array_min("cells")))).alias("top")).first()
    planes = int(most["top"] or 0).bit_length() + 1
    groups = -(-int(most["dims"] or 0) // 8)
    spread = 8 * spark.sparkContext.defaultParallelism
    chunk = max(1, min(CHUNK_ROWS, GROUP_BYTES // max(1, planes * groups), max(1024, most["n"] // spread)))
    block = max(1, min(BLOCK_ROWS, GROUP_BYTES // max(1, groups * 64)))
    chunks, blocks = -(-most["n"] // chunk) or 1, -(-(most["anchors"] or 0) // block) or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list = [b""] * batch.num_rows
            for at, matrix in matrices(batch.column("cells")):
                for k, piece in zip(at, pack_planes(matrix, planes), strict=True):
                    packed[k] = piece.tobytes()
            anchor = np.asarray(batch.column("anchor"))
            parts = pa.compute.if_else(batch.column("anchor"), batch.column("cells"), pa.scalar(None, batch.column("cells").type)) if len(anchor) else batch.column("cells")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), batch.column("dims"), pa.array(packed, pa.binary()), parts],
                                             ["id", "label", "anchor", "dims", "planes", "parts"])

    sized = base.withColumn("dims", F.size("cells"))
    types = dict(sized.dtypes)
    fields = f"id {types['id']}, label {types['label']}, anchor boolean, dims int, planes binary, parts array<bigint>"
    held = materialize(sized.mapInArrow(pack, fields).withColumn("row", F.monotonically_increasing_id()), "vectors")
    dealt = F.xxhash64("row")
    right = held.select("row", "id", "label", "dims", "planes", F.pmod(dealt, F.lit(chunks)).cast("int").alias("chunk"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    anchors = held.where("anchor").select("row", "id", "label", "dims", "parts", F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    by = ["dims", "block", "chunk"]

    def nearest(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, theirs = mine.combine_chunks(), theirs.sort_by([("id", "ascending"), ("row", "ascending")])
        out = []
        if mine.num_rows and theirs.num_rows:
            own, other = _codes(mine["label"], theirs["label"])
            names, numbers = np.asarray(mine["row"]), np.asarray(theirs["row"])
            for code in np.unique(own):  # only rows of the anchors' label are scored
                at, same = np.flatnonzero(own == code), np.flatnonzero(other == code)
                for k, scores in _scored(mine.take(at), theirs.take(same), key[0].as_py(), planes) if len(same) else ():
                    free = np.flatnonzero(numbers[same] != names[at[k]])
                    best = free[_best(scores[free], positives)]
                    out += [(int(at[k]), int(same[b]), int(scores[b])) for b in best]
        a, b, s = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"row": mine["row"].take(a), "positive_id": theirs["id"].take(b), "positive_row": theirs["row"].take(b), "positive_score": pa.array(s)})

    pairs = anchors.withColumn("chunk", every).groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        nearest, f"row bigint, positive_id {types['id']}, positive_row bigint, positive_score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    found = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # at most ``positives`` entries each
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("targets"))
    aimed = materialize(anchors.join(lists, "row"), "anchors")

    def below(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, theirs = mine.combine_chunks(), theirs.sort_by([("id", "ascending"), ("row", "ascending")])
        out, ids = [], []
        if mine.num_rows and theirs.num_rows:
            own, other = _codes(mine["label"], theirs["label"])
            targets = mine["targets"].to_pylist()
            for k, scores in _scored(mine, theirs, key[0].as_py(), planes):
                free = np.flatnonzero(other != own[k])
                values = scores[free]
                for t in targets[k]:
                    p = t["positive_score"]
                    fit = np.flatnonzero((values >= -(-low * p // 100)) & (values <= high * p // 100))
                    best = fit[_best(values[fit], negatives)]
                    out += [(k, t["place"], p, int(free[b]), int(values[b])) for b in best]
                    ids += [t["positive_id"]] * len(best)
        k, place, p, b, s = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
        return pa.table({"row": mine["row"].take(k), "place": pa.array(place.astype(np.int32)), "anchor_id": mine["id"].take(k), "positive_id": pa.array(ids, mine["id"].type),
                         "positive_score": pa.array(p), "negative_id": theirs["id"].take(b), "negative_row": theirs["row"].take(b), "negative_score": pa.array(s)})

    kind = types["id"]
    fields = f"row bigint, place int, anchor_id {kind}, positive_id {kind}, positive_score bigint, negative_id {kind}, negative_row bigint, negative_score bigint"
    near = aimed.withColumn("chunk", every).groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(below, fields)
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
