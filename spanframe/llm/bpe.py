"""Operator 7: byte-level BPE encoding and decoding in length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanframe.llm.batches import SLICE_BYTES, kept, lean, texts, with_fields
from spanframe.llm.splitter import Splitter, distinct, pieces
from spanframe.session import ship_package

NO_RANK = np.int32(2**31 - 1)
#: Matrix widths; longer pieces go through a heap, one by one.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Matrix cells that are worked on at once.
CELLS = 1 << 18
#: Pieces whose result a worker keeps; when full, it starts anew. Speed only.
KEPT_PIECES = 120_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank of a ``.tiktoken`` file (base64 token, blank, rank)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        keys, values = [], []
        for token, i in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        left_k, left_v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(left_k)
        while len(left_k):  # all keys try their slot; losers move on by one
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left_k[free]
            won = self.keys[slot] == left_k
            self.values[slot[won]] = left_v[won]
            left_k, left_v, slot = left_k[~won], left_v[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where there is none or where an id is negative."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = keys[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & self.mask
        return out


class Encoder:
    """Encodes byte pieces as the rank file's merges do; decodes ids to bytes."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        self.byte_ids = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = PairTable(tokens)
        self.names = [str(i) for i in range(len(tokens))]
        self.kept: dict[bytes, tuple] = {}

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
        """(number of ids, their decimal text, decoded bytes) of each byte span."""
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        kept = self.kept
        new = np.array([i for i, k in enumerate(keys) if k not in kept], np.int64)
        for i, ids in zip(new.tolist(), self.encode_spans(data, starts[new], ends[new])):
            plain = self.decode(ids)
            kept[keys[i]] = len(ids), ",".join([self.names[x] for x in ids]), keys[i] if plain == keys[i] else plain
        return [kept[k] for k in keys]

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, ...]]:
        """Ids of each byte span."""
        out: list = [None] * len(starts)
        size = ends - starts
        raw = data.tobytes()
        rest = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            token = self.whole.get(raw[a:b])  # a piece that is a token is that token
            if token is None:
                rest.append(i)
            else:
                out[i] = (token,)
        rest = np.array(rest, np.int64)
        low = 0
        for width in WIDTHS:
            own = rest[(size[rest] > low) & (size[rest] <= width)] if len(rest) else rest
            low = width
            step = max(1, CELLS // width)
            for k in range(0, len(own), step):
                self._merge_matrix(data, starts, size, own[k: k + step], width, out)
        for i in rest[size[rest] > low] if len(rest) else rest:
            out[i] = self._merge_long(raw[starts[i]: ends[i]])
        return out

    def _merge_matrix(self, data, starts, size, own, width, out) -> None:
        column = np.arange(width, dtype=np.int32)
        there = column < size[own][:, None]
        at = np.minimum(starts[own][:, None] + column, len(data) - 1)
        ids = np.where(there, self.byte_ids[data[at]], np.int32(-1))
        rank = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(own), width - 1)
        length = size[own]
        while len(own):
            best = rank.argmin(axis=1).astype(np.int32) if ids.shape[1] > 1 else None  # the first of equal minima: the leftmost
            low = rank[np.arange(len(own)), best] if best is not None else np.full(len(own), NO_RANK)
            if (done := low == NO_RANK).any():
                for i, line, n in zip(own[done].tolist(), ids[done].tolist(), length[done].tolist()):
                    out[i] = tuple(line[:n])
                keep = ~done
                own, ids, rank, length, best, low = own[keep], ids[keep], rank[keep], length[keep], best[keep] if best is not None else None, low[keep]
                if not len(own):
                    break
            # compaction: what is right of the pair moves one to the left, so each round the matrix is a column narrower
            ids[np.arange(len(own)), best] = low
            right = column[: ids.shape[1] - 1] > best[:, None]
            ids = np.where(right, ids[:, 1:], ids[:, :-1])
            rank = np.where(right[:, :-1], rank[:, 1:], rank[:, :-1])
            length = length - 1
            for rows, first in ((np.flatnonzero(best > 0), -1), (np.flatnonzero(best < ids.shape[1] - 1), 0)):
                place = best[rows] + first
                rank[rows, place] = self.pairs.ranks(ids[rows, place], ids[rows, place + 1])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one very long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (got := known.get((a, b))) is None:
                got = known[a, b] = self.whole.get(self.tokens[a] + self.tokens[b], -1)
            return got

        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(r, ids[after[i]])) >= 0:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) >= 0:
                heapq.heappush(heap, (x, before[i]))
        return tuple(x for x in ids if x >= 0)

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def tiktoken_splitter(pattern: str) -> Splitter:
    """Character classes as the tiktoken library sees them under ``pattern``."""
    import tiktoken

    def together(strings: list[str]) -> list[bool]:
        ranks = {bytes([b]): b for b in range(256)} | {s.encode(): 256 + i for i, s in enumerate(strings)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(probe.encode_ordinary(s)) == 1 for s in strings]

    return Splitter(together)


def _encoder(key: str, tokens: list[bytes], pattern: str) -> tuple[Encoder, Splitter]:
    encoders = kept("bpe")
    if (key, pattern) not in encoders:
        encoders.clear()
        encoders[key, pattern] = Encoder(tokens), tiktoken_splitter(pattern)
    return encoders[key, pattern]


def encode_batch(batch: pa.RecordBatch, column: str, encoder: Encoder, splitter: Splitter, with_ids: bool):
    """(token counts, sha256 of the ids' text, sha256 of the decoded bytes, lists of ids or None) by row."""
    data, marks, _ = texts(batch, column)
    n = len(marks) - 1
    counts = np.zeros(n, np.int64)
    id_sums, text_sums = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
    lists: list[list[int]] | None = [[] for _ in range(n)] if with_ids else None
    for rows, body, starts, ends, _, _ in pieces(data, marks, splitter, SLICE_BYTES):
        if not len(starts):
            continue
        first, back = distinct(body, starts, ends)
        coded = encoder.pieces(body, starts[first], ends[first])
        sizes = np.array([c[0] for c in coded], np.int64)
        names, plain = np.empty(len(coded), object), np.empty(len(coded), object)
        names[:] = [c[1] for c in coded]
        plain[:] = [c[2] for c in coded]
        edges = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        per_row = np.add.reduceat(sizes[back], edges)
        names, plain = names[back].tolist(), plain[back].tolist()
        stops = np.append(edges[1:], len(rows)).tolist()
        for row, a, b, k in zip(rows[edges].tolist(), edges.tolist(), stops, per_row.tolist()):
            if counts[row]:
                id_sums[row].update(b",")  # a further part of a long text
            id_sums[row].update(",".join(names[a:b]).encode())
            text_sums[row].update(b"".join(plain[a:b]))
            counts[row] += k
            if lists is not None:
                for p in back[a:b].tolist():
                    lists[row].extend(map(int, coded[p][1].split(",")))
    return counts, [h.hexdigest() for h in id_sums], [h.hexdigest() for h in text_sums], lists


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and add the digests of both.

    All columns of ``docs`` stay except those named like a new one, which are
    replaced: ``n_tokens`` long, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256``, and with ``with_ids`` also ``token_ids`` array<int>.
    Null and empty texts have no tokens and the digest of the empty string.
    Repeated rows are encoded alike; an empty table gives an empty table.

    The rank file is read on the driver (its size is that of the vocabulary) and
    reaches tasks as a broadcast. One narrow pass, no shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["token_ids"] if with_ids else [])
    rows = docs.drop(*new)
    tokens = spark.sparkContext.broadcast(read_ranks(ranks_path))
    schema = with_fields(rows.schema, n_tokens="long", ids_sha256="string", decoded_sha256="string",
                         **({"token_ids": "array<int>"} if with_ids else {}))

    def run(batches):
        encoder, splitter = _encoder(ranks_path, tokens.value, pattern)
        for batch in batches:
            counts, id_sums, text_sums, lists = encode_batch(batch, text, encoder, splitter, with_ids)
            extra = [pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            extra += [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *new])

    return rows.mapInArrow(lean("bpe", run), schema)
