"""Operator 3: exact duplicates against a minimal perfect hash over known digests.

What earlier loads have seen is kept as an index: distinct SHA-256 digests in
shards by hash, each shard one row with a minimal perfect hash (levels of bit
arrays), and by slot the full digest, the locator of the row that stays and the
number of rows. A perfect hash sends strangers to some slot too, so a lookup
counts only if all bytes of the slot's digest are equal. Repeats join the group
of their slot; the others are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import mix
from spanframe.session import materialize, ship_package

#: Digests in a shard, on average. A shard is what one call builds or searches.
SHARD_DIGESTS = 4096
MIN_SHARDS = 64
#: Bits of a level for each key that reaches it, and levels before the rest is listed.
ROOM, LEVELS = 1.7, 24

INDEX_SCHEMA = "shard int, level_bits array<int>, bits binary, digests binary, keep_ids array<bigint>, sizes array<bigint>"
GROUP_SCHEMA = "digest binary, keep_id bigint, group_size bigint, known boolean"


class PerfectHash:
    """Minimal perfect hash over 32-byte digests: level by level, keys alone on their bit get it."""

    def __init__(self, level_bits: list[int], bits: np.ndarray):
        self.level_bits, self.bits = level_bits, bits
        self.heads = np.cumsum([0, *level_bits])
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(words[:, 0] ^ (words[:, 1] + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> tuple["PerfectHash", np.ndarray]:
        """(hash, slot of each key); keys must differ in their first 16 bytes' hashes to end early, but need not."""
        left, levels, parts = np.arange(len(words)), [], []
        places = np.zeros(len(words), np.int64)
        head = 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(len(left) * ROOM))
            at = cls._place(words[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            places[left[own]] = at[own] + head
            left = left[~own]
            levels.append(size)
            parts.append(alone)
            head += size
        if len(left):  # what no level could tell apart gets one bit each, found by comparing digests
            places[left] = head + np.arange(len(left))
            levels.append(-len(left))
            parts.append(np.ones(len(left), bool))
        made = cls([abs(x) for x in levels], np.concatenate(parts) if parts else np.zeros(0, bool))
        made.level_bits = levels
        return made, made.rank[places]

    def slots(self, words: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Slot of each key (-1: certainly a stranger), and the slots that have to be compared one by one."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        head, listed = 0, []
        for level, size in enumerate(self.level_bits):
            if size < 0:
                listed = list(range(int(self.rank[head]), int(self.rank[head]) - size))
                break
            at = self._place(words[left], level, size) + head
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            head += size
        return out, listed


def _digest_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """n x 32 bytes of a binary column whose values all have 32 bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", normalised: Column | None = None) -> DataFrame:
    """(key, digest) of every row; ``normalised`` may replace the text that is compared. Null reads as empty."""
    value = F.coalesce(normalised if normalised is not None else F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(value, 256)).alias("digest"))


def group_digests(rows: DataFrame) -> DataFrame:
    """Largest id and number of rows by digest; counted before the shuffle, so a hot digest costs no more."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def shard_count(n: int) -> int:
    return max(MIN_SHARDS, -(-n // SHARD_DIGESTS))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """Index rows over distinct (digest, keep_id, group_size), one for each shard."""
    ship_package(groups.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        own = _digest_array(table.column("digest"))
        order = np.lexsort(_words(own).T)
        table, own = table.take(pa.array(order)), own[order]
        made, slot = PerfectHash.build(_words(own))
        back = np.empty(len(slot), np.int64)
        back[slot] = np.arange(len(slot))
        placed = table.take(pa.array(back))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "level_bits": pa.array([made.level_bits], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(made.bits).tobytes()], pa.binary()), "digests": pa.array([own[back].tobytes()], pa.binary()),
            "keep_ids": pa.array([placed.column("keep_id").to_pylist()], pa.list_(pa.int64())),
            "sizes": pa.array([placed.column("group_size").to_pylist()], pa.list_(pa.int64()))})

    return _sharded(groups, shards).groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


def apply_index(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """Groups after ``incoming`` (distinct digests with keep_id and group_size) has joined the index.

    ``known`` tells the index's digests from new ones. Every shard is searched
    by itself; no digest is sent anywhere but to its shard.
    """
    ship_package(index.sparkSession)

    def search(slots: pa.Table, probes: pa.Table) -> pa.Table:
        keep, size = np.zeros(0, object), np.zeros(0, np.int64)
        have = np.zeros((0, 32), np.uint8)
        mine = _digest_array(probes.column("digest")) if probes.num_rows else np.zeros((0, 32), np.uint8)
        new_keep = np.array(probes.column("keep_id").to_pylist(), object) if probes.num_rows else np.zeros(0, object)
        new_size = np.array(probes.column("group_size").to_pylist(), np.int64) if probes.num_rows else np.zeros(0, np.int64)
        member = np.zeros(len(mine), bool)
        if slots.num_rows:
            row = slots.slice(0, 1).to_pylist()[0]
            have = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            keep, size = np.array(row["keep_ids"], object), np.array(row["sizes"], np.int64)
            total = sum(abs(x) for x in row["level_bits"])
            table = PerfectHash([abs(x) for x in row["level_bits"]], np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:total].astype(bool))
            table.level_bits = row["level_bits"]
            at, listed = table.slots(_words(mine))
            member = (at >= 0) & (have[np.maximum(at, 0)] == mine).all(1)  # the byte check
            for slot in listed:
                same = ~member & (have[slot] == mine).all(1)
                at[same], member = slot, member | same
            for i in np.flatnonzero(member).tolist():
                ids = [x for x in (keep[at[i]], new_keep[i]) if x is not None]
                keep[at[i]] = max(ids) if ids else None
                size[at[i]] += new_size[i]
        stranger = ~member
        out = np.concatenate([have, mine[stranger]])
        return pa.table({"digest": pa.array([x.tobytes() for x in out], pa.binary()),
                         "keep_id": pa.array([*keep, *new_keep[stranger]], pa.int64()),
                         "group_size": pa.array(np.concatenate([size, new_size[stranger]]), pa.int64()),
                         "known": pa.array(np.arange(len(out)) < len(have))})

    return index.groupBy("shard").cogroup(_sharded(incoming, shards).groupBy("shard")).applyInArrow(search, GROUP_SCHEMA)


def dedup(docs: DataFrame, history: Column, key: str = "doc_id", text: str = "text", normalised: Column | None = None) -> DataFrame:
    """For every row: ``doc_id, keep_id, group_size, kept, known, text_sha256``.

    Rows where ``history`` (over ``key``, null counts as false) holds make up
    the index; the others are looked up in it. Texts are equal when their bytes
    are; null equals empty. The largest id of a group stays; a null id is below
    all others. Rows that repeat the winner's id and text cannot be told apart
    and are all ``kept``. An empty table gives an empty table.

    Ids and digests are written once to the shared folder; texts are read once
    and never shuffled. Groups are counted before each shuffle, and a hot digest
    meets its rows in a plain join that AQE can split.
    """
    rows = materialize(digests(docs, key, text, normalised).withColumn("old", F.coalesce(history, F.lit(False))), "digests")
    known = materialize(group_digests(rows.where("old")), "known-digests")
    shards = shard_count(known.count())
    index = materialize(build_index(known, shards), "digest-index")
    groups = materialize(apply_index(index, group_digests(rows.where("not old")), shards), "digest-groups")
    return (rows.join(groups, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "known",
                    F.lower(F.hex("digest")).alias("text_sha256")))
