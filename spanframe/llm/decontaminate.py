"""Operator 9: benchmark decontamination with a broadcast set of test n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import lean, lower_ascii, row_slices, texts, window_hashes, with_fields, word_hashes, word_spans
from spanframe.session import materialize, ship_package

WINDOW = 13
#: Windows in one broadcast; a larger benchmark is scanned for in several passes.
BLOCK_WINDOWS = 1_000_000
#: Bits of the table that tells most strangers: for each window, and at most.
FILTER_SPARE, FILTER_BITS = 7, 24

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _words(data: np.ndarray, marks: np.ndarray):
    low = lower_ascii(data)
    starts, ends, first = word_spans(data, marks, _INSIDE)
    return low, starts, ends, first, word_hashes(low, starts, ends)


def _phrase(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: int, width: int) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(starts[at: at + width].tolist(), ends[at: at + width].tolist())])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, width, hash, phrase) of all items; an item shorter than ``window`` is one window."""
    ship_package(benchmark.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column("item").to_pylist()
            data, marks, _ = texts(batch, "text")
            low, starts, ends, first, hashes = _words(data[marks[0]: marks[-1]], marks - marks[0])
            raw, rows = low.tobytes(), {}
            for k, name in enumerate(ids):
                a, b = int(first[k]), int(first[k + 1])
                width = min(window, b - a)
                if width:
                    for i, h in enumerate(window_hashes(hashes[a:b], width).tolist()):
                        rows[name, width, h, _phrase(raw, starts, ends, a + i, width)] = None
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64), pa.int64()),
                                              pa.array([r[3] for r in rows], pa.binary())], names=["item", "width", "hash", "phrase"])

    chosen = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return chosen.mapInArrow(lean("contamination", run), "item string, width int, hash long, phrase binary").distinct()


class WindowSet:
    """Sorted hashes of windows of each width, with the phrases and items behind each hash."""

    def __init__(self, rows: list[tuple[str, int, int, bytes]]):
        self.widths: dict[int, np.ndarray] = {}
        self.behind: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for name, width, h, phrase in rows:
            self.behind.setdefault((width, h & (1 << 64) - 1), {}).setdefault(phrase, []).append(name)
        for width in sorted({w for w, _ in self.behind}):
            self.widths[width] = np.array(sorted(h for w, h in self.behind if w == width), np.uint64)
        bits = min(FILTER_BITS, max(1, len(self.behind).bit_length() + FILTER_SPARE))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        for hashes in self.widths.values():
            self.maybe[hashes >> self.shift] = True

    def hits(self, hashes: np.ndarray, row_of: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        """Yield (first word, width, items) of each verified occurrence."""
        for width, known in self.widths.items():
            windows = window_hashes(hashes, width)
            at = np.flatnonzero(self.maybe[windows >> self.shift])
            at = at[row_of[at] == row_of[at + width - 1]]
            place = np.minimum(np.searchsorted(known, windows[at]), len(known) - 1)
            for i in at[known[place] == windows[at]].tolist():
                items = self.behind[width, int(windows[i])].get(_phrase(raw, starts, ends, i, width))
                if items:
                    yield i, width, items


_SCHEMA = {"n_words": "long", "n_hit": "long", "hit_spans": "array<struct<first:int,last:int>>", "items": "array<string>"}


def _scan(docs: DataFrame, shared, text: str, more: bool) -> DataFrame:
    """One pass: count words, mark the words inside any known window, list the items. ``more``: add to an earlier pass."""
    names = [c for c in docs.columns if c not in _SCHEMA]
    schema = with_fields(docs.select(*names).schema, **_SCHEMA)

    def run(batches):
        known = shared.value
        known = known if isinstance(known, WindowSet) else WindowSet(known)
        for batch in batches:
            data, marks, _ = texts(batch, text)
            for low, high in row_slices(marks):
                part = batch.slice(low, high - low)
                n = high - low
                spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
                if more:
                    spans = [[(s["first"], s["last"]) for s in x] for x in part.column("hit_spans").to_pylist()]
                    items = [set(x) for x in part.column("items").to_pylist()]
                n_hit = np.zeros(n, np.int64)
                flat, starts, ends, first, hashes = _words(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low])
                row_of = np.repeat(np.arange(n), np.diff(first))
                for i, width, names_ in known.hits(hashes, row_of, flat.tobytes(), starts, ends):
                    row = int(row_of[i])
                    spans[row].append((i - int(first[row]), i - int(first[row]) + width))
                    items[row].update(names_)
                for row in range(n):
                    if spans[row]:
                        joined: list[list[int]] = []
                        for a, b in sorted(spans[row]):
                            if joined and a <= joined[-1][1]:
                                joined[-1][1] = max(joined[-1][1], b)
                            else:
                                joined.append([a, b])
                        spans[row] = joined
                        n_hit[row] = sum(b - a for a, b in joined)
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], span_type),
                     pa.array([sorted(s) for s in items], pa.list_(pa.string()))], names=[*names, *_SCHEMA])

    return docs.mapInArrow(lean("contamination", run), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                       window: int = WINDOW) -> DataFrame:
    """Mark what every document shares with the benchmark.

    Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z in lower case.
    A window is ``window`` successive words of an item (a shorter item is one
    window of its length). Adds ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``hit_spans`` (merged word ranges, last
    exclusive), ``items`` (sorted ids, as strings, with an occurring window;
    a null id is the empty string) and ``contaminated`` (n_hit > 0 and
    20 * n_hit >= n_words). All columns stay but those named like a new one.
    Null and empty texts have no words and are clean; an empty benchmark marks
    nothing; repeated rows are marked alike.

    The distinct windows are counted first. Up to BLOCK_WINDOWS go out as one
    broadcast; more are dealt by hash into blocks of that size and the documents
    are scanned once for each block, so no broadcast grows with the benchmark.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(*_SCHEMA, "contaminated")
    windows = materialize(benchmark_windows(benchmark, item, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    out = docs
    for k in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == k)
        got = own.toArrow().to_pydict()
        shared = spark.sparkContext.broadcast(WindowSet(list(zip(got["item"], got["width"], got["hash"], got["phrase"]))))
        out = _scan(out, shared, text, more=k > 0)
        if k + 1 < blocks:
            out = materialize(out, "scanned")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    """Cut the words of ``hit_spans``, with what stands between them, out of ``text``; other texts stay as they are.

    Only rows with a span go through Python, so ``marked``, a written table at best, is read twice.
    """
    spark = marked.sparkSession
    ship_package(spark)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            data, marks, _ = texts(batch, text)
            for low, high in row_slices(marks):
                part = batch.slice(low, high - low)
                spans, new = part.column("hit_spans").to_pylist(), []
                for row in range(low, high):
                    body = data[marks[row]: marks[row + 1]]
                    starts, ends, _ = word_spans(body, np.array([0, len(body)]), _INSIDE)
                    raw, parts, head = body.tobytes(), [], 0
                    for s in spans[row - low]:
                        parts.append(raw[head: starts[s["first"]]])
                        head = int(ends[s["last"] - 1])
                    new.append(b"".join([*parts, raw[head:]]).decode("utf-8"))
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    some = F.coalesce(F.size("hit_spans") > 0, F.lit(False))
    return marked.where(~some).unionAll(marked.where(some).mapInArrow(lean("contamination", run), marked.schema))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents without benchmark passages, in the columns of ``docs``.

    Contaminated documents go; from the others the hit spans are cut. The marked
    documents are written in between: two Python passes in one stage would keep
    twice as many workers on an executor.
    """
    marked = materialize(find_contamination(docs, benchmark, text, **options).where("not contaminated"), "marked")
    return remove_spans(marked, text).select(*docs.columns)


def items_digest(items) -> Column:
    """SHA-256 of the sorted ids, joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)
