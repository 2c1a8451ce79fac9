"""Operator 8: toxicity by a convolutional text classifier in numpy.

Words (runs of a-z, 0-9 and characters beyond ASCII, A-Z and Latin-1 capitals in
lower case) have hashed embeddings: one of the whole word and one of each of a
few beginnings, added up, so that inflected forms share what their stem says.
Filters over one, two and three successive words feed a maximum over the text
and a logistic output. Each table starts with the class log-odds of its buckets
in a dimension of its own. All labelled rows are trained on, in Spark tasks whose
models are averaged after each round. The cut on the output is calibrated for each
language, as told from the words themselves.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import lower_ascii, row_slices, texts, with_fields, word_hashes, word_spans
from spanframe.session import materialize, ship_package

BITS, SIZE, FILTERS, WIDTHS = 16, 8, 12, (1, 2, 3)
#: Bytes of the beginnings that have an embedding, beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
TABLES = 1 + len(BEGINNINGS)
CUT = 0.3
#: Tasks that train side by side at most, and rows each of them should have.
LEARNERS, ROWS = 8, 4000
#: Steps of an output of 1 in which held-back rows are counted for the cut.
GRAIN = 1024

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _features(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word and its beginnings, word offsets of the rows + 1)."""
    low = lower_ascii(data)
    capital = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)) + 1
    low[capital] += 0x20
    starts, ends, first = word_spans(low, marks, _INSIDE)
    out = np.empty((len(starts), TABLES), np.uint16)
    for t, k in enumerate((0, *BEGINNINGS)):
        out[:, t] = word_hashes(low, starts, np.minimum(starts + k, ends) if k else ends) >> np.uint64(64 - BITS)
    return out, first


def _laid_out(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each word, first place of each text + 1) with blank places after each text, so that no filter crosses."""
    gap = max(WIDTHS)
    heads = first + gap * np.arange(len(first))
    size = np.diff(first)
    return np.arange(int(first[-1])) + gap * np.repeat(np.arange(len(size)), size), heads


@dataclass
class Classifier:
    tables: list[np.ndarray]  # embeddings of the word and of each beginning, last row blank
    filters: list[np.ndarray]  # width x SIZE x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_words: np.ndarray  # log-probability of a bucket in each language
    cuts: np.ndarray  # by language, the last one for none

    def embed(self, words: np.ndarray, first: np.ndarray):
        place, heads = _laid_out(first)
        at = np.full((TABLES, int(heads[-1])), 1 << BITS, np.int64)
        at[:, place] = words.T
        x = self.tables[0][at[0]]
        for table, own in zip(self.tables[1:], at[1:]):
            x += table[own]
        return x, at, heads

    def maps(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter outputs of one width at every place, before the rectifier."""
        weights = self.filters[k]
        out = x @ weights[0]
        for j in range(1, WIDTHS[k]):
            out[:-j] += x[j:] @ weights[j]
        return out + self.bias[k]

    def logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Output of each text; ``first`` are the word offsets of the texts + 1."""
        x, _, heads = self.embed(words, first)
        pooled = [np.maximum(np.maximum.reduceat(self.maps(x, k), heads[:-1]), 0) for k in range(len(WIDTHS))] if len(heads) > 1 else []
        pooled = np.concatenate(pooled, 1) if pooled else np.zeros((0, len(self.out)))
        pooled[np.diff(first) == 0] = 0
        return pooled @ self.out + self.out_bias

    def language(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of the likeliest language of each text by its words; the last number if there are no words or languages."""
        size = np.diff(first)
        out = np.full(len(size), len(self.languages), np.int64)
        some = np.flatnonzero(size > 0)
        if len(some) and self.languages:
            out[some] = np.add.reduceat(self.language_words[words[:, 0]], first[:-1][some], axis=0).argmax(1)
        return out

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Between 0 and 1, CUT at the cut of the text's language."""
        over = self.logits(words, first) - self.cuts[self.language(words, first)]
        return 1 / (1 + np.exp(-np.clip(over + np.log(CUT / (1 - CUT)), -40, 40)))


def _untrained(times: np.ndarray, total: np.ndarray, languages: list[str], counts: np.ndarray, seed: int) -> Classifier:
    """The model before the first step: the class log-odds of each bucket, small random numbers beside them."""
    rng = np.random.default_rng(seed)
    tables = []
    for which in range(TABLES):
        odds = np.log((times[which, 1] + 0.5) / (total[1] + 1)) - np.log((times[which, 0] + 0.5) / (total[0] + 1))
        odds[times[which].sum(0) < 2] = 0
        table = rng.normal(0, 0.02, ((1 << BITS) + 1, SIZE)).astype(np.float32)
        table[:, which] = np.clip(odds, -4, 4) / 2
        table[-1] = 0
        tables.append(table)
    filters = [rng.normal(0, 0.2, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
    for f in filters:
        f[:, :TABLES] = np.abs(f[:, :TABLES]) + 0.5 / len(f)
    words = np.log((counts + 0.1) / (counts + 0.1).sum(0)).astype(np.float32) if languages else counts.astype(np.float32)
    return Classifier(tables, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.3, np.float32),
                      -2.0, languages, words, np.zeros(len(languages) + 1))


def _step(model: Classifier, params: list[np.ndarray], square: list[np.ndarray], scalars: np.ndarray, own: list[np.ndarray], labels: np.ndarray) -> None:
    """One step of AdaGrad over a few texts with words. ``scalars``: the output's bias and its squares."""
    rate = 0.05
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    x, at, heads = model.embed(np.concatenate(own), first)
    best, top = [], []
    for k in range(len(WIDTHS)):
        maps = model.maps(x, k)
        place = np.stack([maps[a:b].argmax(0) + a for a, b in zip(heads[:-1], heads[1:])])
        best.append(place)
        top.append(np.maximum(np.take_along_axis(maps, place, 0), 0))
    pooled = np.concatenate(top, 1)
    error = 1 / (1 + np.exp(-(pooled @ model.out + scalars[0]))) - labels
    error = (error / len(own)).astype(np.float32)
    grads = {len(params) - 1: pooled.T @ error}
    touched: list[tuple[np.ndarray, np.ndarray]] = []
    for k, width in enumerate(WIDTHS):
        g = error[:, None] * model.out[k * FILTERS: (k + 1) * FILTERS] * (top[k] > 0)
        grads[TABLES + len(WIDTHS) + k] = g.sum(0)
        grads[TABLES + k] = np.stack([np.einsum("if,ifd->df", g, x[np.minimum(best[k] + j, len(x) - 1)]) for j in range(width)])
        for j in range(width):
            touched.append((np.minimum(best[k] + j, len(x) - 1).ravel(), (g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, SIZE)))
    places = np.concatenate([t[0] for t in touched])
    pull = np.concatenate([t[1] for t in touched])
    for which in range(TABLES):
        rows, back = np.unique(at[which, places], return_inverse=True)
        total = np.zeros((len(rows), SIZE), np.float32)
        np.add.at(total, back, pull)
        total[rows == 1 << BITS] = 0
        square[which][rows] += total ** 2
        params[which][rows] -= rate * total / np.sqrt(square[which][rows])
    for i, g in grads.items():
        square[i] += g ** 2
        params[i] -= (rate * g / np.sqrt(square[i])).astype(np.float32)
    scalars[1] += float(error.sum()) ** 2
    scalars[0] -= rate * float(error.sum()) / np.sqrt(scalars[1])


def _cut(bins: np.ndarray, bad: np.ndarray, good: np.ndarray, least: int = 20) -> float | None:
    """The cut with the best F1 over counted outputs (ascending bins); none without enough rows of both classes."""
    if min(bad.sum(), good.sum()) < least:
        return None
    hit, above = np.cumsum(bad[::-1])[::-1], np.cumsum((bad + good)[::-1])[::-1]
    best = int(np.argmax(2 * hit / (above + bad.sum())))
    # in the middle of the gap below the best cut
    return float((bins[best] + bins[best - 1] + 1) / 2 / GRAIN) if best else float(bins[0] / GRAIN - 1)


def _words(batch: pa.RecordBatch):
    """(buckets of each text, labels, languages) of a batch, in slices."""
    data, marks, _ = texts(batch, "text")
    y, langs = np.asarray(batch.column("y")), batch.column("lang").to_pylist()
    for low, high in row_slices(marks):
        words, first = _features(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low])
        yield [words[a:b] for a, b in zip(first[:-1], first[1:])], y[low:high], langs[low:high]


def _counts(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts of each class that hold a bucket, by table; words in a bucket, by language) over all rows."""
    width, kinds = (1 << BITS) + 1, 2 * TABLES + len(languages)

    def run(batches):
        held = np.zeros((kinds, width), np.int64)
        for batch in batches:
            for samples, y, langs in _words(batch):
                for x, label, lang in zip(samples, y, langs):
                    for which in range(TABLES):
                        held[2 * which + label, np.unique(x[:, which])] += 1
                    if lang is not None:
                        np.add.at(held[2 * TABLES + languages.index(lang)], x[:, 0], 1)
        kind, bucket = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(held[kind, bucket])], names=["kind", "bucket", "n"])

    got = rows.mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((kinds, width))
    out[got.column("kind").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out[: 2 * TABLES].reshape(TABLES, 2, width), out[2 * TABLES:].T


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    """All numbers in rows of ``SIZE``."""
    flat = np.concatenate([x.ravel() for x in arrays]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % SIZE)).reshape(-1, SIZE)


def _epoch(rows: DataFrame, model: Classifier, square: list[np.ndarray], scalars: np.ndarray, seed: int) -> None:
    """Every task takes the model over all its rows; what each changed is averaged over the tasks that changed it.

    Changes are whole multiples of 2**-32, so that their sum knows no order.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, square, scalars))
    columns = [f"d{i}" for i in range(SIZE)]

    def run(batches):
        own, squares, numbers = copy.deepcopy(shared.value)
        params = [*own.tables, *own.filters, *own.bias, own.out]
        before = _flat([*params, *squares, numbers])
        rng = np.random.default_rng(seed)
        for batch in batches:
            for samples, y, _ in _words(batch):
                some = rng.permutation([i for i, x in enumerate(samples) if len(x)]).astype(np.int64)
                for low in range(0, len(some), 64):
                    at = some[low: low + 64]
                    _step(own, params, squares, numbers, [samples[i] for i in at], y[at])
        change = np.rint((_flat([*params, *squares, numbers]) - before) * 2.0 ** 32).astype(np.int64)
        place = np.flatnonzero(change.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(change[place, i]) for i in range(SIZE)]], names=["place", *columns])

    changes = rows.mapInArrow(run, "place long, " + ", ".join(f"{c} long" for c in columns))
    got = changes.groupBy("place").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
    params = [*model.tables, *model.filters, *model.bias, model.out]
    state = [*params, *square, scalars]
    flat = _flat(state)
    if len(got):
        moved = np.stack([got.column(c).to_numpy() for c in columns], 1) / 2.0 ** 32
        flat[got.column("place").to_numpy()] += moved / got.column("n").to_numpy()[:, None]
    flat, low = flat.ravel(), 0
    for x in state:
        x[...] = flat[low: low + x.size].reshape(x.shape)
        low += x.size
    shared.destroy()


def _calibrate(rows: DataFrame, model: Classifier) -> None:
    """The cut with the best F1 on all held-back rows, for each language with enough rows of both classes, else the common one.

    Outputs are counted in steps of 1 / GRAIN.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for samples, y, _ in _words(batch):
                first = np.concatenate([[0], np.cumsum([len(x) for x in samples])])
                words = np.concatenate(samples)
                step = np.floor(np.clip(shared.value.logits(words, first), -40, 40) * GRAIN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(shared.value.language(words, first)), pa.array(y.astype(np.int32))], names=["step", "lang", "y"])

    got = rows.mapInArrow(run, "step long, lang long, y int").groupBy("lang", "step").agg(
        F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).orderBy("step").toArrow()
    lang, step, bad, good = (got.column(c).to_numpy() for c in ("lang", "step", "bad", "good"))
    bins, back = np.unique(step, return_inverse=True)
    common = _cut(bins, np.bincount(back, bad, len(bins)), np.bincount(back, good, len(bins))) if len(bins) else None
    common = 0.0 if common is None else common
    for k in range(len(model.languages) + 1):
        own = lang == k
        cut = _cut(step[own], bad[own], good[own]) if own.any() else None
        model.cuts[k] = common if cut is None else cut
    shared.destroy()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "toxic",
        epochs: int = 6, seed: int = 7) -> Classifier:
    """Train on all labelled documents: log-odds and language words from counts over them, the
    model from rounds in which up to ``LEARNERS`` tasks take it over all their rows and their
    changes are averaged, the cuts from every fourth document by its id's hash, held back from the rest.

    Labels other than 0 and 1 and null texts are not used; of several labels of
    an id the highest counts, of several texts the one with the smallest hash.
    The driver sees counts by bucket and the model, whose sizes are fixed. ``lang`` serves
    only to tell languages by their words. With no labelled rows the score is
    that of an untrained model, below the cut for every text.
    """
    ship_package(docs.sparkSession)
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang")).where("text is not null")
    # one text an id, the one with the smallest hash
    one = F.min_by(F.struct("y", "lang", "text"), F.struct(F.xxhash64("text"), "text", "lang"))
    rows = named.join(marked, "id").groupBy("id").agg(one.alias("s")).select((F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("held"), "s.*")
    rows = materialize(rows, "labelled")
    used = rows.where("not held")
    sizes = {r["y"]: r["n"] for r in used.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = np.array([sizes.get(y, 0) for y in (0, 1)])
    languages = [r["lang"] for r in used.where("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    times, counts = _counts(used, languages)
    model = _untrained(times, total, languages, counts, seed)
    square = [np.full_like(p, 1e-3) for p in (*model.tables, *model.filters, *model.bias, model.out)]
    scalars = np.array([model.out_bias, 1e-3])
    few = used.coalesce(int(min(LEARNERS, max(1, -(-total.sum() // ROWS)))))
    for turn in range(epochs if total.sum() else 0):
        _epoch(few, model, square, scalars, seed + turn)
    model.out_bias = float(scalars[0])
    _calibrate(rows.where("held"), model)
    return model


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if the score is CUT or more).

    Only the text is read, and all of it. Null and empty texts get the score of
    a text without words. Equal texts score alike. All columns stay but those
    named like a new one. One narrow pass; the broadcast model has a fixed size.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kept = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, marks, _ = texts(batch, text)
            out = np.zeros(len(marks) - 1)
            for low, high in row_slices(marks):
                words, first = _features(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low])
                out[low:high] = model.scores(words, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= CUT).astype(np.int32))],
                                             names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, with_fields(kept.schema, score="double", predicted="int"))
