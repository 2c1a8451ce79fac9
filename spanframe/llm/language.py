"""Operator 2: language identification by interpolated Kneser-Ney character models.

A text is read as words (runs of letters, simple lower case). Each word is
predicted letter by letter, its end included, from up to four letters before;
word starts are visible to the model. Every language has its own model over the
n-grams of its sample; all models lie side by side in one sorted array of n-gram
hashes for each order, one column for each language. A text gets the language
with the lowest cross-entropy for each predicted symbol, and is rejected when
that cross-entropy is far above what held-back texts of the language show.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import kept, lean, mix, row_slices, texts, with_fields, word_hashes
from spanframe.session import ship_package

ORDER = 5
#: Symbols that a model without any knowledge holds equally likely.
ALPHABET = 4096
WORD_START, WORD_END = 1, 2
#: Slice of text that is worked on at once, and words whose scores a worker keeps (speed only).
SLICE_BYTES, KEPT_WORDS = 1 << 19, 100_000
UNDETERMINED = "und"



def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, simple lower case) by code point."""
    tables = kept("language")
    if not tables:
        chars = [chr(c) for c in range(0x110000)]
        letter = np.array([c.isalpha() for c in chars])
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero([c.isupper() or c.istitle() for c in chars]).tolist():
            if len(low := chars[i].lower()) == 1:
                lower[i] = ord(low)
        tables.update(letter=letter, lower=lower)
    return tables["letter"], tables["lower"]


def words_of(data: np.ndarray, marks: np.ndarray):
    """(lower-cased code points, word starts, word ends, row of each word)."""
    letter, lower = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    heads = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), marks) if len(data) else np.zeros(len(marks), np.int64)
    n = len(points)
    keep = np.zeros(n + 1, bool)
    keep[:n] = letter[points]
    before = np.zeros(n + 1, bool)
    before[1:] = keep[:n]
    edge = np.zeros(n + 1, bool)
    edge[heads] = True
    starts = np.flatnonzero(keep & (~before | edge))
    ends = np.flatnonzero(before & (~keep | edge))
    rows = np.searchsorted(heads, starts, side="right") - 1
    return lower[points], starts, ends, rows


def _symbol(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x51ED270B7A3F))


def _padded(words: list[np.ndarray] | tuple) -> tuple[np.ndarray, np.ndarray]:
    """Words given as (points, starts, ends) behind one another with start and end marks; place in word of each symbol."""
    points, starts, ends = words
    size = ends - starts + 2
    heads = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(heads, size)
    source = np.repeat(starts - 1, size) + place
    out = points[np.clip(source, 0, max(0, len(points) - 1))].astype(np.uint32) if len(points) else np.zeros(0, np.uint32)
    out[heads] = WORD_START
    out[heads + size - 1] = WORD_END
    return out, place


def gram_hashes(symbols: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each symbol (rubbish where a word is shorter)."""
    value = _symbol(symbols)
    out = [mix(value)]
    for n in range(1, ORDER):
        left = np.zeros_like(value)
        left[n:] = value[:-n] if n < len(value) else 0
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + left))
    return out


@dataclass
class Models:
    """For each order n: ``grams[n]`` sorted hashes with log-probabilities (NaN: not seen), and
    ``contexts[n]`` sorted hashes of what stands before, with log back-off weights (0: not seen)."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    centre: np.ndarray
    spread: np.ndarray

    def losses(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Negative log-likelihood of each word under each language."""
        if not self.languages:
            return np.zeros((len(starts), 0))
        symbols, place = _padded((points, starts, ends))
        hashes = gram_hashes(symbols)
        unknown = np.full((len(symbols), len(self.languages)), -np.log(ALPHABET), np.float32)
        log = self._level(0, hashes[0], None, unknown, np.ones(len(symbols), bool))
        for n in range(1, ORDER):
            before = np.zeros_like(hashes[0])
            before[1:] = hashes[n - 1][:-1]
            log = self._level(n, hashes[n], before, log, place >= n)
        log[place == 0] = 0  # the start of a word is given
        size = ends - starts + 2
        return -np.add.reduceat(log, np.cumsum(size) - size, axis=0) if len(size) else np.zeros((0, len(self.languages)))

    def _level(self, n, grams, before, lower, there):
        out = lower
        if n and len(self.contexts[n]):
            at = np.minimum(np.searchsorted(self.contexts[n], before), len(self.contexts[n]) - 1)
            hit = np.flatnonzero((self.contexts[n][at] == before) & there)
            out = out.copy()
            out[hit] += self.weights[n][at[hit]]
        elif not n:
            out = out + self.weights[0]
        if len(self.grams[n]):
            at = np.minimum(np.searchsorted(self.grams[n], grams), len(self.grams[n]) - 1)
            hit = np.flatnonzero((self.grams[n][at] == grams) & there)
            seen = self.logs[n][at[hit]]
            out[hit] = np.where(np.isnan(seen), out[hit], seen)
        return out


def fit_models(vocabulary: dict[str, tuple[list[str], np.ndarray]]) -> Models:
    """Kneser-Ney models from the word counts of each language."""
    languages = sorted(vocabulary)
    made = []
    for lang in languages:
        words, counts = vocabulary[lang]
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        symbols, place = _padded((points, ends - size, ends))
        made.append(_fit_one(symbols, place, np.repeat(np.asarray(counts, np.float64), size + 2)))
    grams, logs, contexts, weights = [], [], [], []
    for n in range(ORDER):
        for keys, values, out_keys, out_values, fill in (("grams", "logs", grams, logs, np.nan), ("contexts", "weights", contexts, weights, 0.0)):
            union = np.unique(np.concatenate([m[keys][n] for m in made])) if made else np.zeros(0, np.uint64)
            table = np.full((len(union), len(languages)), fill, np.float32)
            for k, m in enumerate(made):
                table[np.searchsorted(union, m[keys][n]), k] = m[values][n]
            out_keys.append(union)
            out_values.append(table)
    if made:
        weights[0] = np.array([m["weights"][0][0] for m in made], np.float32)
    return Models(languages, grams, logs, contexts, weights, np.zeros(len(languages)), np.full(len(languages), np.inf))


def _fit_one(symbols: np.ndarray, place: np.ndarray, weight: np.ndarray) -> dict:
    hashes = gram_hashes(symbols)
    before = [None] + [np.concatenate([np.zeros(1, np.uint64), h[:-1]]) for h in hashes[:-1]]
    counts: list = [None] * ORDER
    sample: list = [None] * ORDER
    # highest order and n-grams at a word's start: counts; all others: how many different symbols stand before them
    for n in range(ORDER - 1, -1, -1):
        own = np.flatnonzero((place >= n) & (place > 0))
        keys, first, back = np.unique(hashes[n][own], return_index=True, return_inverse=True)
        raw = np.bincount(back, weight[own], len(keys))
        sample[n] = own[first]
        if n < ORDER - 1:
            wider = sample[n + 1]
            more = np.zeros(len(keys))
            np.add.at(more, np.searchsorted(keys, hashes[n][wider]), 1)
            at_start = place[sample[n]] == n  # nothing can stand before these
            raw = np.where(at_start, raw, more)
        counts[n] = keys, raw
    out = {"grams": [], "logs": [], "contexts": [], "weights": []}
    lower_prob = None
    for n in range(ORDER):
        keys, c = counts[n]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        ctx = before[n][sample[n]] if n else np.zeros(len(keys), np.uint64)
        ctx_keys, ctx_back = np.unique(ctx, return_inverse=True)
        total = np.bincount(ctx_back, c, len(ctx_keys))
        kinds = np.bincount(ctx_back, np.minimum(c, discount), len(ctx_keys))
        gamma = kinds / total
        if n == 0:
            below = np.full(len(keys), 1 / ALPHABET)
        else:
            low_keys = counts[n - 1][0]
            below = lower_prob[np.searchsorted(low_keys, hashes[n - 1][sample[n]])]
        prob = np.maximum(c - discount, 0) / total[ctx_back] + gamma[ctx_back] * below
        out["grams"].append(keys)
        out["logs"].append(np.log(prob))
        out["contexts"].append(ctx_keys)
        out["weights"].append(np.log(gamma))
        lower_prob = prob
    return out


class Scorer:
    """Scores batches, keeping the losses of words seen lately."""

    def __init__(self, models: Models):
        self.models = models
        self.kept: dict[int, int] = {}
        self.loss = np.zeros((0, len(models.languages)), np.float32)

    def rows(self, data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed loss under each language, predicted symbols) of each row."""
        points, starts, ends, row = words_of(data, marks)
        n = len(marks) - 1
        total, symbols = np.zeros((n, len(self.models.languages))), np.zeros(n, np.int64)
        if not len(starts):
            return total, symbols
        keys = word_hashes(points.astype("<u4").view(np.uint8), starts * 4, ends * 4)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.loss = {}, self.loss[:0]
        names = distinct.tolist()
        new = [i for i, k in enumerate(names) if k not in self.kept]
        if new:
            base = len(self.loss)
            self.kept.update(zip([names[i] for i in new], range(base, base + len(new))))
            self.loss = np.concatenate([self.loss, self.models.losses(points, starts[first[new]], ends[first[new]]).astype(np.float32)])
        loss = self.loss[np.array([self.kept[k] for k in names])][back]
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        total[row[edges]] = np.add.reduceat(loss.astype(np.float64), edges, axis=0)
        symbols[row[edges]] = np.add.reduceat(ends - starts + 1, edges)
        return total, symbols


def judge(models: Models, total: np.ndarray, symbols: np.ndarray, sharpness: float):
    """(language number or -1, score, cross-entropy, rejected) of each row."""
    n = len(symbols)
    if not models.languages:
        return np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
    some = symbols > 0
    entropy = total / np.maximum(symbols, 1)[:, None]
    best = entropy.argmin(1)  # a tie goes to the first language by name
    low = entropy[np.arange(n), best]
    score = 1 / np.exp((low[:, None] - entropy) * sharpness).sum(1)
    far = (low - models.centre[best]) > models.spread[best] * (1 + 8 / np.sqrt(np.maximum(symbols, 1)))
    return np.where(some, best, -1), np.where(some, score, 0.0), np.where(some, low, np.nan), ~some | far


_WORDS_SCHEMA = "lang string, word string, n long"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1500,
        max_languages: int = 500) -> Models:
    """Fit the models and their rejection thresholds on a bounded sample of labelled rows.

    About ``per_language`` rows of each language are taken, those with the
    smallest hash of ``key`` and text, so null and repeated ids are sampled like
    others and repeated rows count once; a fifth of them is held back for the thresholds.
    Rows without text or language are not used. What reaches the driver is the
    sample's word counts, bounded by the sample. Without labelled rows the
    result has no languages, and every text is undetermined.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return fit_models({})
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    part = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)))
    # rows equal in id and text are one, so a row repeated millions of times adds one
    sample = rows.where(part < share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("back", F.pmod(F.xxhash64(F.col("h")), F.lit(5)) == 0)

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, marks, _ = texts(batch, "text")
            found: dict[tuple[str, str], int] = {}
            for low, high in row_slices(marks, SLICE_BYTES):
                points, starts, ends, row = words_of(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low])
                whole = points.astype("<u4").tobytes().decode("utf-32-le")
                for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist()):
                    at = langs[low + r], whole[a:b]
                    found[at] = found.get(at, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                                              pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.where("not back").select("lang", "text").mapInArrow(lean("language", count), _WORDS_SCHEMA).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    vocabulary: dict[str, tuple[list, list]] = {}
    got = words.toArrow()
    for name, word, n in zip(got.column("lang").to_pylist(), got.column("word").to_pylist(), got.column("n").to_pylist()):
        own = vocabulary.setdefault(name, ([], []))
        own[0].append(word)
        own[1].append(n)
    # one order of words on every run
    sorted_words = {}
    for name, (own, counts) in vocabulary.items():
        order = sorted(range(len(own)), key=own.__getitem__)
        sorted_words[name] = [own[i] for i in order], np.array([counts[i] for i in order], np.float64)
    models = fit_models(sorted_words)
    back = predict(sample.where("back"), models).where("n_symbols > 0").select("lang", "lang_pred", "cross_entropy", "n_symbols").toArrow().to_pydict()
    seen = list(zip(back["lang"], back["lang_pred"], back["cross_entropy"], back["n_symbols"]))
    for k, name in enumerate(models.languages):
        own = [(e, n) for want, had, e, n in seen if want == had == name]
        if own:
            entropy, size = np.array([e for e, _ in own]), np.array([n for _, n in own])
            models.centre[k] = np.median(entropy)
            # half as far again as the furthest held-back text, at least one nat
            models.spread[k] = max(1.0, 1.5 * float(np.max((entropy - models.centre[k]) / (1 + 8 / np.sqrt(size)))))
    return models


def predict(docs: DataFrame, models: Models, text: str = "text", sharpness: float = 20.0) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` (nats a symbol), ``n_symbols`` and ``rejected``.

    Only the text is read. Null texts and texts without letters are ``und``
    with score 0, null cross-entropy and rejected. All columns of ``docs`` stay
    but those named like a new one, which are replaced. Every whole text is
    read, by bounded slices of rows; an empty table gives an empty table. The
    models are broadcast; their size is that of the bounded sample.
    """
    spark = docs.sparkSession
    ship_package(spark)
    new = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "n_symbols": "long", "rejected": "boolean"}
    rows = docs.drop(*new)
    shared = spark.sparkContext.broadcast(models)

    def run(batches):
        models = shared.value
        scorer = Scorer(models)
        names = np.array([*models.languages, UNDETERMINED], object)
        for batch in batches:
            data, marks, _ = texts(batch, text)
            n = len(marks) - 1
            total, symbols = np.zeros((n, len(models.languages))), np.zeros(n, np.int64)
            for low, high in row_slices(marks, SLICE_BYTES):
                total[low:high], symbols[low:high] = scorer.rows(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low])
            best, score, entropy, rejected = judge(models, total, symbols, sharpness)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy, pa.float64(), from_pandas=True),
                 pa.array(symbols), pa.array(rejected)], names=[*batch.schema.names, *new])

    return rows.mapInArrow(lean("language", run), with_fields(rows.schema, **new))
