"""Operator 1: token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one after the other. The first marks where
pre-tokens start (see ``splitter``): chunks of text are reduced to state maps
and the maps are composed by a parallel prefix scan. The second reads the bytes
of a pre-token; each transition carries the number of tokens that it adds to
the encoding of the prefix read so far, so the sum along a path is the token
count. No token is ever materialised.

The states of the second transducer follow from a property of pair merging: a
sequence of tokens is the encoding of its bytes exactly if every two neighbours
encode to themselves. So the encoding of a prefix is the encoding of a shorter
prefix and one last token, and what later bytes can still change depends only
on the suffixes of the prefix that begin some token, and on the last token
before each of them. That is a state. States are compiled when a text first
reaches them, and the table starts anew when it is full.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanframe.llm.batches import SLICE_BYTES, kept, lean, texts, with_fields
from spanframe.llm.splitter import Splitter, distinct, pieces
from spanframe.session import ship_package

#: Rows of the transition table (1.5 kB each for 256 bytes); a full table starts anew.
STATES = 60_000
#: Pre-tokens whose count a worker keeps, and pairs of tokens it knows to fit; when full, they start anew. Speed only.
KEPT_PIECES, KEPT_PAIRS = 400_000, 600_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_model(path: str) -> dict:
    """Vocabulary, merges and special strings of a byte-level ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("expected a byte-level BPE without normaliser and prefix space")
    letters = byte_letters()
    special = [t["content"] for t in spec["added_tokens"]]
    if len(special) > 1:
        raise ValueError("expected one special string at most")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    tokens = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return {"tokens": tokens, "merges": [tuple(tokens[bytes(letters[c] for c in part)] for part in m) for m in merges],
            "special": special[0].encode() if special else b""}


class CountTransducer:
    """Deterministic automaton over bytes whose transitions add token counts."""

    def __init__(self, model: dict, states: int = STATES):
        self.ids: dict[bytes, int] = model["tokens"]
        self.bytes = {i: t for t, i in self.ids.items()}
        self.rank = {pair: i for i, pair in enumerate(model["merges"])}
        self.begins = {t[:k] for t in self.ids for k in range(len(t))}
        self.limit = states
        self.fits_known: dict[tuple[int, int], bool] = {}
        self.kept: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the last bytes that may begin a token, and (length of suffix, token before it, tokens less) for each such suffix
        start = (b"", ((0, -1, 0),))
        self.number = {start: 0}
        self.states = [start]
        self.follow = np.full((1024, 256), -1, np.int32)
        self.adds = np.zeros((1024, 256), np.int16)

    def encode(self, piece: bytes) -> list[int]:
        """Plain pair merging, for compiling only: the lowest pair first, the leftmost of equal ones."""
        ids = [self.ids[piece[i: i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.rank.get((ids[i], ids[i + 1]), 1 << 40))
            if (pair := (ids[best], ids[best + 1])) not in self.rank:
                break
            ids[best: best + 2] = [self.ids[self.bytes[pair[0]] + self.bytes[pair[1]]]]
        return ids

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens encode to themselves (``before`` -1: the token alone)."""
        if (known := self.fits_known.get((before, token))) is None:
            want = [token] if before < 0 else [before, token]
            known = self.fits_known[before, token] = self.encode(b"".join(self.bytes[t] for t in want)) == want
        return known

    def _compile(self, state: int, byte: int) -> None:
        suffix, places = self.states[state]
        text = suffix + bytes([byte])
        size = len(text) - 1
        tails = [text[size - k:] for k, _, _ in places]
        ids = self.ids
        for tail, (_, before, less) in zip(tails, places):
            if (token := ids.get(tail)) is not None and self.fits(before, token):
                break
        else:
            raise AssertionError("no token ends here")
        add = less + 1
        begins = self.begins
        open_places = [(k + 1, t, n - add) for tail, (k, t, n) in zip(tails, places) if tail in begins]
        open_places.append((0, token, 0))
        made = (text[size + 1 - open_places[0][0]:], tuple(open_places))
        to = self.number.get(made)
        if to is None:
            to = self.number[made] = len(self.states)
            self.states.append(made)
            if to >= len(self.follow):
                self.follow = np.concatenate([self.follow, np.full_like(self.follow, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        self.follow[state, byte], self.adds[state, byte] = to, add

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each byte span."""
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = np.array([i for i, k in enumerate(keys) if k not in self.kept], np.int64)
        self.kept.update(zip([keys[i] for i in new.tolist()], self.run(data, starts[new], ends[new]).tolist()))
        return np.array([self.kept[k] for k in keys], np.int64)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts summed along each span's path; all spans advance together, byte by byte."""
        if len(self.states) > self.limit:
            self._reset()
        if len(self.fits_known) > KEPT_PAIRS:
            self.fits_known.clear()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, longest = starts[order], size[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-longest, -np.arange(1, int(longest[0]) + 1 if len(order) else 1), side="right")
        for j, n in enumerate(alive.tolist()):
            key = state[:n] * 256 + data[at[:n] + j]
            to = self.follow.ravel()[key]
            if (missing := to < 0).any():
                for k in np.unique(key[missing]).tolist():
                    self._compile(k >> 8, k & 255)
                if len(self.states) > self.limit and len(order) > 1:  # too many states for one run: start again with half the spans
                    half = len(order) // 2
                    return np.concatenate([self.run(data, starts[:half], ends[:half]), self.run(data, starts[half:], ends[half:])])
                to = self.follow.ravel()[key]
            total[:n] += self.adds.ravel()[key]
            state[:n] = to
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def library_splitter() -> Splitter:
    """Character classes as the tokenizers library sees them."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True)
    return Splitter(lambda strings: [len(split.pre_tokenize_str(s)) == 1 for s in strings])


def _compiled(key: str, model: dict) -> tuple[CountTransducer, Splitter]:
    compiled = kept("tokens")
    if key not in compiled:
        compiled.clear()
        compiled[key] = CountTransducer(model), library_splitter()
    return compiled[key]


def count_batch(batch: pa.RecordBatch, column: str, transducer: CountTransducer, splitter: Splitter, special: bytes):
    """(UTF-8 bytes, tokens) of each row."""
    data, marks, _ = texts(batch, column)
    out = np.zeros(len(marks) - 1, np.int64)
    for rows, body, starts, ends, hit, times in pieces(data, marks, splitter, SLICE_BYTES, special):
        out[hit] += times  # a special string in a text is one token
        if len(starts):
            first, back = distinct(body, starts, ends)
            count = transducer.counts(body, starts[first], ends[first])[back]
            np.add.at(out, rows[edges := np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))], np.add.reduceat(count, edges))
    return np.diff(marks), out


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) to every row.

    Counts are those of the tokenizers library without begin, end or other
    added tokens; a special string inside a text counts as one token, which is
    the library's default. All columns stay but those named like a new one,
    which are replaced. Null and empty texts have 0 bytes and 0 tokens; equal
    texts have equal counts; an empty table gives an empty table.

    The vocabulary is read on the driver and broadcast (its size does not grow
    with the data). One narrow pass, no shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    new = ["n_bytes", "n_tokens", "over_limit"]
    plain = docs.drop(*new)
    model = spark.sparkContext.broadcast(read_model(tokenizer_path))

    def run(batches):
        transducer, splitter = _compiled(tokenizer_path, model.value)
        for batch in batches:
            size, count = count_batch(batch, text, transducer, splitter, model.value["special"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(count), pa.array(count > limit)],
                                             names=[*batch.schema.names, *new])

    return plain.mapInArrow(lean("tokens", run), with_fields(plain.schema, n_bytes="long", n_tokens="long", over_limit="boolean"))
