"""Operator 6: cross-entropy difference of matched target and background models.

Both models are word bigrams over one vocabulary, all words of the corpus. Both
have the same order and the same smoothing (Witten-Bell over add-one unigrams),
so that their losses differ only by what the two corpora say. Counts cover every
document and every word, and grow with the corpus.

Texts are read once and written as blocks: one row each, with the hashes of the
distinct words, sorted, and every word as its rank among them. A block's distinct
pairs, sorted by the hashes of both words, are cut into cells at borders that all
blocks share; the cells between two borders meet in one group, which tells each
cell the counts of its pairs in all texts and in the target. So pairs go out as
packed hashes, and only small counts come back, in the order in which the pairs
went out. Words go the same way. Only ranks meet the counts in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import give_back, lean, lower_ascii, mix, row_slices, texts, word_hashes, word_spans
from spanframe.llm.topk import commonest
from spanframe.session import materialize, ship_package

#: Bytes of texts and rows of a block, about; the mark of a text's start.
BLOCK_BYTES, BLOCK_ROWS, START = 1 << 23, 1 << 16, np.uint64(0x5BD1E995A5A5A5A5)
#: Pairs, or words, that meet in one group, about; groups of a task; of so many pairs of a block one may become a border; blocks that are asked for them at most.
GROUP, EACH, STRIDE, ASKED = 600_000, 8, 1 << 14, 4096

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _word_hashes(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, marks, _INSIDE)
    return word_hashes(low, starts, ends), first


def vocabulary(docs: DataFrame, text: str = "text", words: int = 2000) -> np.ndarray:
    """Sorted hashes of the ``words`` commonest words (ties: the smaller hash), counted over all texts.

    Batches count first, so what is shuffled is one row for each distinct word of a batch.
    """

    def run(batches):
        for batch in batches:
            data, marks, _ = texts(batch, "text")
            found = [_word_hashes(data[marks[a]: marks[b]], marks[a: b + 1] - marks[a])[0] for a, b in row_slices(marks)]
            word, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = commonest(materialize(counts, "words"), "word", "n", words).toArrow().column("word").to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _ids(hashes: np.ndarray, known: np.ndarray | None, classes: int) -> np.ndarray:
    """The hashes themselves; with ``known``, numbers of the known words and of hash classes for the others."""
    if known is None:
        return hashes
    rest = np.uint64(len(known)) + hashes % np.uint64(classes)
    if not len(known):
        return rest
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at.astype(np.uint64), rest)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers as bytes: planes of equal significance, compressed."""
    planes = b"".join(np.ascontiguousarray(a).astype(np.int64 if a.dtype.kind == "i" else np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return np.array([len(arrays), *map(len, arrays)], np.int64).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as unsigned integers."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    planes = np.frombuffer(pa.decompress(data[8 + 8 * n:], decompressed_size=8 * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for size in sizes:
        out.append(np.ascontiguousarray(planes[at: at + 8 * size].reshape(8, size).T).view(np.uint64).reshape(size))
        at += 8 * size
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _fresh(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    n = len(sorted_keys[0])
    out = np.ones(n, bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return out


def _pairs(words: np.ndarray, n: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank before, number of the pair) of every word of a block: ``words`` are ranks below ``size``, ``n`` words of each row."""
    before = np.append(start, words[:-1])[: len(words)].astype(np.int64)
    before[(np.cumsum(n) - n)[n > 0]] = start
    return before, before * size + words


BLOCK = "block long, docs array<long>, n binary, ranks binary, words binary, start long, kinds long, pairs long, borders binary"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", known: np.ndarray | None = None, classes: int = 0) -> DataFrame:
    """One written row for each block of texts: ids, words of each text, ranks of the words, hashes, and pairs that may become borders."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            data, marks, _ = texts(batch, "text")
            for low, high in row_slices(marks):
                hashes, first = _word_hashes(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low])
                held.append((mix(_ids(hashes, shared.value, classes)), np.diff(first)))
                ids.append(batch.column("doc_id").slice(low, high - low))
                size += int(marks[high] - marks[low])
                if size >= BLOCK_BYTES or sum(map(len, ids)) >= BLOCK_ROWS:
                    yield out(block, ids, held)
                    block, ids, held, size = block + 1, [], [], 0
                    give_back()
        if ids:
            yield out(block, ids, held)

    def out(block, ids, held):
        n = np.concatenate([x[1] for x in held])
        words, ranks = np.unique(np.concatenate([*[x[0] for x in held], [START]]), return_inverse=True)
        held.clear()
        start, ranks = int(ranks[-1]), ranks[:-1]
        pairs = np.unique(_pairs(ranks, n, start, len(words))[1])
        borders = pairs[STRIDE // 2:: STRIDE]
        row = {"block": block, "docs": pa.concat_arrays(ids).to_pylist(), "n": pack(n.astype(np.int64)), "ranks": pack(ranks), "words": pack(_steps(words)),
               "start": start, "kinds": len(words), "pairs": len(pairs), "borders": pack(words[borders // len(words)], words[borders % len(words)])}
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, *[pa.int64()] * 3, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(named.mapInArrow(lean("lm", run), BLOCK), "blocks")


def _marked(coded: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks with the places of the rows whose id is in ``target``. Only ids are shuffled by id."""
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # null ids are in no target and would all meet in one task
    places = coded.select("block", F.posexplode("docs").alias("place", "doc_id")).where("doc_id is not null")
    chosen = materialize(places.join(wanted, "doc_id").groupBy("block").agg(F.collect_list("place").alias("chosen")), "chosen")
    return coded.select("block", "n", "ranks", "words", "start").join(chosen, "block", "left")


def _opened(batches):
    """(block, words of each row, ranks, hashes, start, whether the row is chosen) of every block, one after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            n, ranks, words = unpack(row["n"])[0].astype(np.int64), unpack(row["ranks"])[0].view(np.int64), _summed(unpack(row["words"])[0])
            own = np.zeros(len(n), bool)
            own[row["chosen"] or []] = True
            yield row["block"], n, ranks, words, row["start"], own
            del row, n, ranks, words, own
            give_back()


def _batch(names: str, kinds: list, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


_CELL = ("bucket block payload", [pa.int64(), pa.int64(), pa.binary()])
_CELLS = "bucket long, block long, payload binary"


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows dealt by ``key``, in a number of tasks that grows with the groups, where Spark's own number would put many into one."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if groups <= EACH * own else df.repartition(-(-groups // EACH), key)


def _borders(coded: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash before, hash) of the pairs that part the groups: as even as pairs of the asked blocks tell, which changes no result."""
    asked = [unpack(r["borders"]) for r in coded.select("borders", F.xxhash64("block").alias("h")).orderBy("h").limit(ASKED).collect()]
    before, word = (np.concatenate([np.zeros(0, np.uint64), *[x[k] for x in asked]]) for k in (0, 1))
    order = np.lexsort((word, before))
    at = order[np.arange(1, groups) * len(order) // groups] if len(order) else order
    return before[at], word[at]


def count_pairs(marked: DataFrame, borders: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(bucket, block, payload): times of each pair of a cell in all texts and in the target; without a block: words before, and kinds of words after them."""

    def cells(batches):
        for block, n, ranks, words, start, own in _opened(batches):
            key = _pairs(ranks, n, start, len(words))[1]
            some, often = np.unique(key[own.repeat(n)], return_counts=True)
            pairs, times = np.unique(key, return_counts=True)
            del key
            chosen = np.zeros(len(pairs), np.int64)
            chosen[np.searchsorted(pairs, some)] = often
            before, word = words[pairs // len(words)], words[pairs % len(words)]
            low, high = (np.searchsorted(before, borders[0], side) for side in ("left", "right"))
            inside = [a + int(np.searchsorted(word[a:b], w)) for a, b, w in zip(low.tolist(), high.tolist(), borders[1])]
            edges = np.array([0, *inside, len(pairs)])
            buckets = np.flatnonzero(np.diff(edges))
            payloads = []
            for a, b in zip(edges[buckets], edges[buckets + 1]):
                heads = np.flatnonzero(_fresh(before[a:b]))
                step = _steps(word[a:b])
                step[heads] = word[a:b][heads]
                payloads.append(pack(_steps(before[a:b][heads]), np.diff(np.append(heads, b - a)), step, times[a:b], chosen[a:b]))
            del pairs, some, often, times, chosen, before, word
            yield _batch(*_CELL, buckets, np.full(len(buckets), block), payloads)

    def total(rows):
        before, word, counts = [], [], ([], [])
        for payload in rows.column("payload"):
            steps, runs, step, *sums = unpack(payload.as_py())
            runs = runs.astype(np.int64)
            heads = np.cumsum(runs) - runs
            along = _summed(step)
            word.append(along - (along[heads] - step[heads]).repeat(runs))
            before.append(_summed(steps).repeat(runs))
            for k in range(2):
                counts[k].append(sums[k].astype(np.int64))
        edges = np.cumsum([0, *map(len, word)])
        before, word = np.concatenate(before), np.concatenate(word)
        order = np.lexsort((word, before))
        fresh = _fresh(before[order], word[order])
        heads = np.flatnonzero(fresh)
        sums = [np.add.reduceat(np.concatenate(c)[order], heads) for c in counts]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        payloads = [pack(*[s[place[a:b]] for s in sums]) for a, b in zip(edges[:-1], edges[1:])]
        firsts = before[order[heads]]
        tops = np.flatnonzero(_fresh(firsts))
        payloads.append(pack(_steps(firsts[tops]), np.diff(np.append(tops, len(firsts))), np.add.reduceat((sums[1] > 0).astype(np.int64), tops)))
        bucket = rows.column("bucket")[0].as_py()
        del before, word, counts, order, fresh, sums, place
        give_back()
        return pa.Table.from_batches([_batch(*_CELL, [bucket] * len(payloads), [*rows.column("block").to_pylist(), None], payloads)])

    return materialize(_dealt(marked.mapInArrow(lean("lm", cells), _CELLS), "bucket", len(borders[0]) + 1).groupBy("bucket").applyInArrow(total, _CELLS), "pairs")


def count_words(marked: DataFrame, pairs: DataFrame, groups: int) -> DataFrame:
    """(bucket, block, payload): six counts for each word of a block; without a block: number of words, and their times in all texts and in the target.

    The counts: times of the word, the same in the target, times before another, the same in the target, kinds of words after it, the same in the target.
    """
    bounds = np.array([(i << 64) // groups for i in range(1, groups)], np.uint64)

    def parted(block, words, *counts):
        edges = np.array([0, *np.searchsorted(words, bounds), len(words)])
        buckets = np.flatnonzero(np.diff(edges))
        payloads = [pack(_steps(words[a:b]), *[c[a:b] for c in counts]) for a, b in zip(edges[buckets], edges[buckets + 1])]
        return _batch(*_CELL, buckets, [block] * len(buckets), payloads)

    def cells(batches):
        for block, n, ranks, words, start, own in _opened(batches):
            before, mine = _pairs(ranks, n, start, len(words))[0], own.repeat(n)
            yield parted(block, words, *[np.bincount(x, minlength=len(words)) for x in (ranks, ranks[mine], before, before[mine])])

    def kinds(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                steps, *counts = unpack(payload)
                yield parted(None, _summed(steps), *counts)

    def total(rows):
        names = rows.column("block").to_pylist()
        found = [unpack(x) for x in rows.column("payload").to_pylist()]
        edges = np.cumsum([0, *[len(x[0]) for x in found]])
        words, place = np.unique(np.concatenate([_summed(x[0]) for x in found]), return_inverse=True)
        sums = np.zeros((6, len(words)), np.int64)
        for name, x, a, b in zip(names, found, edges[:-1], edges[1:]):
            for k, counts in zip((4, 5) if name is None else (0, 1, 2, 3), x[1:]):
                sums[k, place[a:b]] += counts.astype(np.int64)  # the words of a cell differ
        out = [(name, pack(*sums[:, place[a:b]])) for name, a, b in zip(names, edges[:-1], edges[1:]) if name is not None]
        bucket = rows.column("bucket")[0].as_py()
        give_back()
        cells = _batch(*_CELL, [bucket] * (len(out) + 1), [*[x[0] for x in out], None], [*[x[1] for x in out], None])
        totals = [[None] * len(out) + [int(x)] for x in ((sums[0] > 0).sum(), sums[0].sum(), sums[1].sum())]
        return pa.Table.from_arrays([*cells.columns, *[pa.array(x, pa.int64()) for x in totals]], names=[*cells.schema.names, "words", "n", "chosen"])

    both = marked.mapInArrow(lean("lm", cells), _CELLS).unionAll(pairs.where("block is null").select("payload").mapInArrow(lean("lm", kinds), _CELLS))
    return materialize(_dealt(both, "bucket", groups).groupBy("bucket").applyInArrow(total, f"{_CELLS}, words long, n long, chosen long"), "words")


def score(coded: DataFrame, pairs: DataFrame, words: DataFrame, n_blocks: int, size: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score): mean losses a word, and target minus background.

    The loss of a word is -log p(word | word before), Witten-Bell over add-one
    unigrams of ``size`` words; without ``size`` it is the number of distinct
    words and one. The lower the score, the more a text is like the target.
    Texts without words have null losses and a null score. What is collected is
    one row of totals.
    """
    total = words.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n", "chosen")]).first()
    size = total["words"] + 1 if size is None else size
    everywhere, chosen = float(total["n"] + size), float(total["chosen"] + size)
    told = pairs.where("block is not null").select("block", F.lit(0).alias("kind"), "bucket", "payload").unionAll(
        words.where("block is not null").select("block", F.lit(1).alias("kind"), "bucket", "payload"))

    def run(rows, told):
        told = sorted(told.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        counts = [[unpack(r["payload"]) for r in told if r["kind"] == kind] for kind in (0, 1)]
        # in the order of the buckets the cells are the sorted pairs, and words, of the block
        times, words = ([np.concatenate(x).astype(np.float64) for x in zip(*c)] for c in counts)
        names, n_words, mean = [], [], []
        for row in rows.to_pylist():
            n, ranks = unpack(row["n"])[0].astype(np.int64), unpack(row["ranks"])[0].view(np.int64)
            sums = np.zeros((2, len(n)))
            if n.any():
                pair, at = np.unique(_pairs(ranks, n, row["start"], row["kinds"])[1], return_inverse=True)
                before, word = pair // row["kinds"], pair % row["kinds"]
                del ranks, pair
                some = np.flatnonzero(n)
                heads = (np.cumsum(n) - n)[some]
                for k, (c, all_words) in enumerate(((1, chosen), (0, everywhere))):
                    one = (words[c][word] + 1) / all_words
                    seen, kinds = words[2 + c][before], words[4 + c][before]
                    loss = -np.log(np.where(seen > 0, (times[c] + kinds * one) / np.maximum(seen + kinds, 1), one))
                    sums[k, some] = np.add.reduceat(loss[at], heads)
            names += row["docs"]
            n_words.append(n)
            mean.append(np.where(n > 0, sums / np.maximum(n, 1), np.nan))
            give_back()
        n, mean = np.concatenate(n_words), np.concatenate(mean, axis=1)
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(n), *[pa.array(x, pa.float64(), from_pandas=True) for x in (*mean, mean[0] - mean[1])]],
                                    names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    texts_, told = (_dealt(x, "block", n_blocks) for x in (coded.select("block", "docs", "n", "ranks", "start", "kinds"), told))
    return texts_.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def score_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None, classes: int = 47) -> DataFrame:
    """Score every document by the difference of its mean word losses; ``target`` lists the ids of the target corpus.

    One row for each row of ``docs``; rows that repeat count as often in the
    models as they stand there. Null ids are never in the target. Null and empty
    texts have no words: 0 tokens and null losses. With an empty target both
    models keep their smoothing and scores only say how common a text's words
    are. With ``words`` only so many of the commonest words are modelled, and all
    others share ``classes`` hash classes. Texts are neither shuffled nor written:
    the ranks of their words are.
    """
    ship_package(docs.sparkSession)
    known = None if words is None else vocabulary(docs, text, words)
    coded = blocks(docs, key, text, known, classes)
    marked = _marked(coded, target)
    sizes = coded.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "kinds")]).first()
    pairs = count_pairs(marked, _borders(coded, sizes["pairs"] // GROUP + 1))
    words_ = count_words(marked, pairs, sizes["kinds"] // GROUP + 1)
    return score(coded, pairs, words_, sizes["n"], None if known is None else len(known) + classes + 1)
