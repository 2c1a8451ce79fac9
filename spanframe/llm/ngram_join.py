"""Operator 4: n-gram Jaccard join on token-combination prefixes.

Tokens are the distinct word n-grams of a text. All tokens have one order: rare
ones first, then frequent ones, each class by hash. A set of n tokens that is to
reach Jaccard similarity t with another may miss d = floor((1-t) n) of its own.

* With more than d rare tokens, its first d + 1 rare tokens are its signature:
  a similar set lacks at most d of them.
* Otherwise all its r rare tokens and, of its first floor(2(1-t) n) - 2r + 2
  frequent tokens, every two neighbours in the order. A token that the other
  lacks breaks two such pairs and one that it has in addition breaks one, so the
  longer prefix leaves one pair whole. Below 76 percent the smallest sets have too
  few frequent tokens for that prefix; they and sets that could be similar to
  them list every token.

So similar sets share a signature; frequent tokens alone never make candidates.
Which tokens count as frequent changes the work and never the result.

Sets that share a rare token and list pairs of frequent ones meet in the list of
that token, for they list all their rare tokens. So in a list of a pair only sets
without a common rare token have to meet: none of the r rare tokens of either is
common, which leaves n - r at most, and t asks for t/(1+t) of both sizes. What the
rare ones leave of the differences also tells how many pairs can be broken, and so
how far from the start the first whole pair stands in either set; later pairs need
not bring the two together. Candidates pass these bounds (in lists of one token:
r = 0, a size filter), then a parity sketch whose differing bits bound the symmetric
difference from below, and are then compared exactly.

Sets that are equal are one class, and of signature lists with the same classes
one is kept. Leaders of each list are compared with all others in it, among them
the set with the largest reach: with the fewest rare tokens it is next to the text
that the others were copied from. What leaders link is contracted, and only lists
that still hold several parts are joined pairwise, across parts, without the sets
whose reach ends before all others. So components of a large group of near copies cost
its size and not its square. The number of links of each set is counted afterwards, among
the sets of each component, in matrix products over blocks of bounded size: a table of
pairs is never made, but a component of many sets does cost its square in arithmetic.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import byte_set, lean, lower_ascii, mix, row_slices, texts, window_hashes, word_hashes, word_spans
from spanframe.llm.components import components
from spanframe.session import materialize, ship_package

WORDS, PERCENT = 5, 80
#: Tokens held as frequent at most, and how often one has to stand in a stretch of LOCAL tokens and overall to be one. Speed only.
FREQUENT, LOCAL, LOCAL_TIMES, TIMES = 500_000, 1 << 22, 2, 8
#: Different leaders that the lists of one group of texts have, about; each member is compared with two of them in every list.
LEADERS = 8
#: Tokens and sets of a block of a large component when its links are counted, columns of one matrix product, places counted at once.
CELL_TOKENS, CELL_ROWS, COLUMNS, PLACES = 1 << 20, 2048, 1024, 1 << 22
#: Bits of a table of hashes that tells most strangers, for frequent tokens and for wanted ids.
FILTER_BITS, ID_BITS = 22, 20

_INSIDE = byte_set(" \t\n\x0b\x0c\r")


def shingles(data: np.ndarray, marks: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) sorted by both and distinct, and the number of words of each row."""
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, marks, _INSIDE)
    hashes = word_hashes(low, starts, ends)
    size = np.diff(first)
    row_of = np.repeat(np.arange(len(size)), size)
    full = window_hashes(hashes, words)
    at = np.flatnonzero(row_of[: len(full)] == row_of[words - 1: words - 1 + len(full)])
    rows, tokens = [row_of[at]], [full[at]]
    for width in range(1, words):  # shorter texts are one token
        own = np.flatnonzero(size == width)
        if len(own):
            rows.append(own)
            tokens.append(window_hashes(hashes, width)[first[own]])
    row, token = np.concatenate(rows), np.concatenate(tokens)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (token[1:] != token[:-1]))[: len(row)]
    return row[fresh], token[fresh], size


def _heads(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, row[1:] != row[:-1]))[: len(row)]


def parity_sketch(tokens: np.ndarray) -> bytes:
    """One bit for each residue of the tokens, as many as there are tokens (a power of two, 64 at least)."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference of the sets behind two sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # a longer sketch folds to a shorter one
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


_SCAN = "doc_id long, n_shingles long, class long, proof long, sketch binary, hot array<long>, times array<int>"


def _scan(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """Size, class key and sketch of each text's set; now and then a row lists tokens frequent in the last stretch."""
    salt, other = np.uint64(0x2545F4914F6CDD1D * (2 * seed + 1) & (1 << 64) - 1), np.uint64(0xA0761D6478BD642F)

    def frequent(seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, often = np.unique(np.concatenate(seen), return_counts=True)
        many = often >= LOCAL_TIMES
        return tokens[many].view(np.int64), often[many].astype(np.int32)

    def run(batches):
        for batch in batches:
            data, marks, _ = texts(batch, "text")
            seen: list[np.ndarray] = []
            for low, high in row_slices(marks):
                n = high - low
                size, key, proof = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sketch: list = [None] * n
                hot, times = [None] * n, [None] * n
                row, token, _ = shingles(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low], words)
                if len(row):
                    heads = _heads(row)
                    own = row[heads]
                    size[own] = np.diff(np.append(heads, len(row)))
                    key[own] = np.add.reduceat(mix(token ^ salt), heads)
                    proof[own] = np.add.reduceat(mix(token + other), heads)
                    for r, a, k in zip(own.tolist(), heads.tolist(), size[own].tolist()):
                        sketch[r] = parity_sketch(token[a: a + k])
                    seen.append(token)
                if seen and (high == len(marks) - 1 or sum(map(len, seen)) >= LOCAL):
                    hot[-1], times[-1] = frequent(seen)
                    seen = []
                key = mix(key + size.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, n), pa.array(size), pa.array(key), pa.array(proof.view(np.int64)), pa.array(sketch, pa.binary()),
                     pa.array(hot, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "class", "proof", "sketch", "hot", "times"])

    return docs.mapInArrow(lean("ngram", run), _SCAN)


def fewest_tokens(percent: int) -> int:
    """A set of fewer tokens is similar to no other, not even to one with a single token more."""
    return -(-percent // (100 - percent))


def short_sets(percent: int) -> int:
    """Largest size of a set similar to one whose tokens are fewer than the longer prefix asks for; 0 if there is none."""
    short = 199 // (2 * percent - 100)  # n tokens with n < 2(1-t) n + 2
    return 100 * short // percent if short >= fewest_tokens(percent) else 0


def signature(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signature hashes of one set: ``tokens`` by hash, ``frequent`` their class. Hashes of pairs are odd, those of single tokens even."""
    n = len(tokens)
    spare = (100 - percent) * n // 100
    rare = tokens[~frequent] & ~np.uint64(1)
    if len(rare) > spare:
        return rare[: spare + 1]
    if n <= short_sets(percent):
        return tokens & ~np.uint64(1)
    often = tokens[frequent][: 2 * (100 - percent) * n // 100 - 2 * len(rare) + 2]
    return np.concatenate([rare, mix(often[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(often[1:])) | np.uint64(1)])


def reach(size, rare, percent: int):
    """``percent`` times the size of the largest set similar to one of ``size`` tokens of which the ``rare`` ones are not common to both."""
    return 100 * size - (100 + percent) * rare


def meets(n, rare, place, other_n, other_rare, percent: int):
    """Whether a list may be the first that a set of ``n`` tokens shares with a similar one, as far as ``place`` of the pair in it tells.

    With f differences among frequent tokens, g more of them in this set than in the other, (f + g) / 2 tokens break two pairs and
    the others one: 2 place <= 3 f + g. Similar sets have (1-t)/(1+t) (n + other_n) - rare - other_rare such differences at most.
    """
    both = 100 + percent
    return both * (place + 2 * rare) - (200 - percent) * n <= (100 - 2 * percent) * other_n - both * other_rare


def _in_reach(x: str, y: str, percent: int) -> Column:
    """Whether rows of a list with columns {x}n, {x}rare and {y}n, {y}rare may be similar."""
    def one(a: str, b: str) -> Column:
        return reach(F.col(f"{a}n"), F.col(f"{a}rare"), percent) >= percent * F.col(f"{b}n")

    return one(x, y) & one(y, x)


def _meet_here(x: str, y: str, percent: int) -> Column:
    """Whether the list may be the first that both rows share, by {x}place and {y}place too."""
    def one(a: str, b: str) -> Column:
        return meets(*[F.col(f"{a}{c}") for c in ("n", "rare", "place")], F.col(f"{b}n"), F.col(f"{b}rare"), percent)

    return one(x, y) & one(y, x)


def _signatures(docs: DataFrame, words: int, percent: int, least: int, seed: int, frequent) -> DataFrame:
    """(sig, class, place) of every text with ``least`` tokens or more, pairs numbered from 0; one row of each text tells how many rare ones it has."""

    def run(batches):
        salt = np.uint64(0x2545F4914F6CDD1D * (2 * seed + 1) & (1 << 64) - 1)
        known = frequent.value
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[known >> np.uint64(64 - FILTER_BITS)] = True
        for batch in batches:
            data, marks, _ = texts(batch, "text")
            for low, high in row_slices(marks):
                row, token, _ = shingles(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low], words)
                if not len(row):
                    continue
                often = maybe[token >> np.uint64(64 - FILTER_BITS)]
                at = np.flatnonzero(often)
                if len(at):
                    place = np.minimum(np.searchsorted(known, token[at]), len(known) - 1)
                    often[at] = known[place] == token[at]
                heads = _heads(row)
                size = np.diff(np.append(heads, len(row)))
                key = mix(np.add.reduceat(mix(token ^ salt), heads) + size.astype(np.uint64)).view(np.int64)
                sigs, keys, rare = [], [], []
                for a, k, c in zip(heads.tolist(), size.tolist(), key.tolist()):
                    if k >= least:
                        sigs.append(signature(token[a: a + k], often[a: a + k], percent))
                        keys.append(c)
                        rare.append(k - int(often[a: a + k].sum()))
                if sigs:
                    n = np.array([len(s) for s in sigs])
                    told = np.full(n.sum(), -1, np.int32)
                    told[np.cumsum(n) - n] = rare
                    sig = np.concatenate(sigs)
                    place = np.zeros(len(sig), np.int32)
                    pairs = np.flatnonzero(sig & np.uint64(1))
                    place[pairs] = pairs - (np.cumsum(n) - [int((s & np.uint64(1)).sum()) for s in sigs]).repeat(n)[pairs]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig.view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), n)), pa.array(place), pa.array(told, mask=told < 0)],
                        names=["sig", "class", "place", "rare"])

    return docs.select("text").mapInArrow(lean("ngram", run), "sig long, class long, place int, rare int")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, tokens) of the wanted (class, doc_id), read from the texts again.

    A broadcast of at most 2**ID_BITS hash residues keeps most other texts out of the shuffle by id.
    """
    residue = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).cast("int")

    def run(batches):
        for batch in batches:
            data, marks, _ = texts(batch, "text")
            for low, high in row_slices(marks):
                row, token, _ = shingles(data[marks[low]: marks[high]], marks[low: high + 1] - marks[low], words)
                edges = np.searchsorted(row, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").slice(low, high - low), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(token.view(np.int64)))],
                    names=["class", "tokens"])

    residues = wanted.select(residue.alias("residue")).distinct()
    likely = docs.withColumn("residue", residue).join(F.broadcast(residues), "residue", "left_semi")
    return likely.join(wanted, "doc_id").select("class", "text").mapInArrow(lean("ngram", run), "class long, tokens array<long>").dropDuplicates(["class"])


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes that reach the similarity: sizes, sketches, then whole sets. With the sets (class, tokens)."""
    a = classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("class").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def sift(batches):
        for batch in batches:
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            least = np.array([fewest_differences(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())], np.int64)
            # similarity t leaves (1-t)/(1+t) of both sizes for differences at most
            keep = pa.array(least * (100 + percent) <= (100 - percent) * (na + nb))
            yield batch.select(["a", "b", "na", "nb"]).filter(keep)

    near = materialize(sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean("ngram", sift), "a long, b long, na long, nb long"), "near")
    wanted = near.select(F.col("a").alias("class")).unionAll(near.select(F.col("b").alias("class"))).distinct()
    wanted = materialize(wanted.join(classes.select("class", "rep"), "class").select("class", F.col("rep").alias("doc_id")), "wanted")
    sets = materialize(_sets(docs, wanted, words), "sets")
    both = (near.join(sets.withColumnsRenamed({"class": "b", "tokens": "tb"}), "b").join(sets.withColumnsRenamed({"class": "a", "tokens": "ta"}), "a")
            .withColumn("common", F.size(F.array_intersect("ta", "tb"))))
    return materialize(both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "linked"), sets


def intersections(row_a: np.ndarray, token_a: np.ndarray, a: int, row_b: np.ndarray, token_b: np.ndarray, b: int) -> np.ndarray:
    """Sizes of the intersections of ``a`` sets with ``b`` others, from (row, token) of both.

    Tokens that many pairs share are columns of matrix products, of the others each common place is counted.
    """
    tokens, back = np.unique(np.concatenate([token_a, token_b]), return_inverse=True)
    at_a, at_b = back[: len(token_a)], back[len(token_a):]
    times_a, times_b = (np.bincount(at, minlength=len(tokens)) for at in (at_a, at_b))
    pairs = times_a * times_b
    out = np.zeros((a, b), np.float32)
    often = np.flatnonzero((pairs > 0) & (32 * pairs >= a * b))
    column = np.full(len(tokens), -1)
    column[often] = np.arange(len(often))
    column_a, column_b = column[at_a], column[at_b]
    for low in range(0, len(often), COLUMNS):
        both = []
        for row, columns, n in ((row_a, column_a, a), (row_b, column_b, b)):
            held = np.flatnonzero((columns >= low) & (columns < low + COLUMNS))
            both.append(np.zeros((n, COLUMNS), np.float32))
            both[-1][row[held], columns[held] - low] = 1
        out += both[0] @ both[1].T
    seldom = np.flatnonzero((column_a < 0) & (times_b[at_a] > 0))
    by_token, first = row_b[np.argsort(at_b, kind="stable")], np.cumsum(times_b) - times_b
    ends = np.cumsum(times_b[at_a[seldom]])
    low = 0
    while low < len(seldom):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACES, side="right")))
        own = seldom[low:high]
        n = times_b[at_a[own]]
        other = by_token[np.arange(n.sum()) + (first[at_a[own]] - np.cumsum(n) + n).repeat(n)]
        out += np.bincount(row_a[own].repeat(n) * b + other, minlength=a * b).reshape(a, b)
        low = high
    return out.astype(np.int64)


def _degrees(links: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, n_links): with how many other classes each class of ``members`` (node, component) links.

    Links never leave a component. Where all its pairs are among the known ``links`` nothing is compared; else all sets of the component
    are, those of a large one in blocks of bounded size, by bands of set sizes of which only neighbours can hold similar sets.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("k"))
    known = links.join(members, links["a"] == members["node"]).groupBy("component").agg(F.count("*").alias("known"))
    sizes = materialize(sizes.join(known, "component"), "components")
    whole = 2 * F.col("known") == F.col("k") * (F.col("k") - 1)
    settled = members.join(sizes.where(whole), "component").select(F.col("node").alias("class"), (F.col("k") - 1).alias("n_links"))

    open_ = members.withColumnRenamed("node", "class").join(sizes.where(~whole).select("component"), "component")
    open_ = open_.join(sets.select("class", F.size("tokens").alias("n")), "class")
    # neighbours in the order of sizes: a set similar to one of n tokens has less than 100.0001 / percent times as many
    open_ = materialize(open_.withColumn("band", F.floor(F.log("n") / float(np.log(100.0001 / percent))).cast("long")), "open")
    weight = F.greatest(F.ceil(F.sum("n") / CELL_TOKENS), F.ceil(F.count("*") / CELL_ROWS)).cast("long")
    large = open_.groupBy("component").agg(weight.alias("blocks")).where("blocks > 1").select("component", F.lit(True).alias("large"))
    bands = open_.groupBy("component", "band").agg(weight.alias("blocks"))
    block = F.when(F.col("large"), F.shiftleft("band", 32) + F.pmod(F.xxhash64("class"), F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    placed = open_.join(bands, ["component", "band"]).join(large, "component", "left").select("component", "class", "n", block.alias("block"))
    placed = materialize(placed, "placed")
    all_blocks = placed.groupBy("component").agg(F.collect_set("block").alias("others"))
    near = F.filter("others", lambda x: F.abs(F.shiftright(x, 32) - F.shiftright("block", 32)) <= 1)
    cells = placed.join(all_blocks, "component").select("component", "class", "n", "block", F.explode(near).alias("other"))
    cells = cells.select("component", "class", "n", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    tokens = cells.agg(F.sum("n").alias("n")).first()["n"] or 0
    bundle = F.pmod(F.xxhash64("component", "x", "y"), F.lit(tokens // (2 * CELL_TOKENS) + 1)).alias("bundle")

    def run(rows):
        rows = rows.combine_chunks()
        names = {c: rows.column(c).to_numpy() for c in ("component", "x", "y", "block", "class")}
        order = np.lexsort([names[c] for c in ("block", "y", "x", "component")])
        key = np.stack([names[c][order] for c in ("component", "x", "y")])
        edges = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), len(order))
        lists = rows.column("tokens").combine_chunks()
        marks, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()

        def side(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = marks[at + 1] - marks[at]
            return np.arange(len(at)).repeat(n), flat[np.arange(n.sum()) + (marks[at] - np.cumsum(n) + n).repeat(n)], n

        found, n_links = [], []
        for low, high in zip(edges[:-1], edges[1:]):
            at = order[low:high]
            own = at[names["block"][at] == names["x"][at]]
            row, token, n = side(own)
            if names["x"][at[0]] == names["y"][at[0]]:
                common = intersections(row, token, len(own), row, token, len(own))
                linked = 100 * common >= percent * (n[:, None] + n[None] - common)
                np.fill_diagonal(linked, False)
                found.append(own)
                n_links.append(linked.sum(axis=1))
            else:
                rest = at[names["block"][at] == names["y"][at]]
                row_b, token_b, n_b = side(rest)
                common = intersections(row, token, len(own), row_b, token_b, len(rest))
                linked = 100 * common >= percent * (n[:, None] + n_b[None] - common)
                found += [own, rest]
                n_links += [linked.sum(axis=1), linked.sum(axis=0)]
        return pa.table({"class": names["class"][np.concatenate(found)], "n_links": np.concatenate(n_links).astype(np.int64)})

    held = cells.select(bundle, "component", "x", "y", "block", "class").join(sets, "class")
    counted = held.groupBy("bundle").applyInArrow(run, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    return settled.unionAll(counted)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                   count_links: bool = True) -> DataFrame:
    """For every row ``doc_id, n_shingles, component_id, n_links``.

    Two texts link when 100 * |A and B| >= ``percent`` * |A or B| for their sets
    of ``words``-word shingles (A-Z in lower case, words are runs of anything
    but blanks; a shorter text is one shingle; a text without words, or null,
    has none and links with nothing). ``component_id`` is the smallest id that
    links lead to. ``n_links`` is the number of different sets that link with
    that of the row (equal texts count once). Without ``count_links`` the column
    is left out.

    Ids name documents: rows equal in id and text are one. A row with a null id
    has its shingles counted and is alone, with a null component. An empty table
    gives an empty table.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50")
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = docs.where("doc_id is not null")
    least = fewest_tokens(percent)
    for seed in count():  # the class key is a hash of the set; a second hash proves that no two sets share it
        rows = materialize(_scan(docs, words, seed), "shingled")
        classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(
            F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.max("n_shingles").alias("n_high"),
            F.min("proof").alias("proof"), F.max("proof").alias("proof_high"), F.min("sketch").alias("sketch"))
        classes = materialize(classes, "classes")
        if classes.where("n_high <> n_shingles or proof <> proof_high").isEmpty():
            break
    hot = rows.where("hot is not null").select(F.explode(F.arrays_zip("hot", "times")).alias("t")).groupBy(F.col("t.hot").alias("token"))
    hot = hot.agg(F.sum("t.times").alias("times")).where(F.col("times") >= TIMES).orderBy(F.desc("times"), "token").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(hot.select("token").toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64)))

    sigs = materialize(_signatures(named, words, percent, least, seed, frequent), "signatures")
    ends = sigs.groupBy("sig").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    lists = materialize(sigs.join(ends, "sig").groupBy("sig", "class").agg(F.min("place").alias("place")), "lists")
    # lists with the same members are one: that of a token if there is one, else each member's first place
    members = lists.groupBy("sig").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"))
    paired = F.col("sig").bitwiseAND(1)
    same = members.groupBy("k", "x", "y").agg(F.min(F.struct(paired, "sig"))["sig"].alias("one"))
    one = members.join(same, ["k", "x", "y"]).select("sig", "one")
    lists = lists.join(one, "sig").groupBy(F.col("one").alias("sig"), "class").agg(F.min("place").alias("place"))
    sizes = classes.select("class", "n_shingles").join(sigs.where("rare is not null").groupBy("class").agg(F.max("rare").alias("rare")), "class")
    lists = lists.join(sizes, "class").select("sig", "class", F.col("n_shingles").alias("n"), (F.col("rare") * paired).alias("rare"), "place")
    lists = materialize(lists, "lists")
    # a set that reaches no other of its list, or that no other reaches, leaves it
    far = reach(F.col("n"), F.col("rare"), percent)
    spans = lists.groupBy("sig").agg(F.min("n").alias("small"), F.max(far).alias("far"))
    lists = materialize(lists.join(spans, "sig").where((far >= percent * F.col("small")) & (F.col("far") >= percent * F.col("n"))).drop("small", "far"), "lists")
    # the mask turns the order of the classes, so lists with nearly the same members have different leaders
    mask = F.xxhash64(F.pmod("sig", F.lit(LEADERS)))
    turned = F.col("class").bitwiseXOR(mask)
    row = F.struct("class", "n", "rare", "place")
    leaders = lists.groupBy("sig").agg(F.min(F.struct(turned, row.alias("row")))["row"].alias("low"), F.max(F.struct(far, turned, row.alias("row")))["row"].alias("far"))
    stars = lists.join(leaders, "sig").select("class", "n", "rare", "place", F.explode(F.array("low", "far")).alias("l"))
    # a leader is compared with all that reach it, wherever the pair stands: links found here are contracted
    stars = stars.where((F.col("class") != F.col("l.class")) & _in_reach("", "l.", percent))
    stars = materialize(stars.select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b")).distinct(), "stars")
    first, sets_a = _linked(stars, classes, named, words, percent)
    merged = materialize(components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "merged")

    # lists that still hold several components: pairs across them, apart from those compared already
    left = lists.join(merged.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = left.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("k"))
    # a leader is one of the two classes of a short list: compared already
    left = materialize(left.join(mixed.where("c0 <> c1 and k > 2").select("sig"), "sig"), "mixed")
    x, y = (left.select("sig", *[F.col(c).alias(f"{side}{c}") for c in ("class", "component", "n", "rare", "place")]) for side in ("a_", "b_"))
    cross = x.join(y, "sig").where((F.col("a_component") != F.col("b_component")) & (F.col("a_class") < F.col("b_class"))
                                   & _in_reach("a_", "b_", percent) & _meet_here("a_", "b_", percent))
    cross = cross.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()
    second, sets_b = _linked(cross.join(stars, ["a", "b"], "left_anti"), classes, named, words, percent)

    links = materialize(first.unionAll(second), "all-links")
    final = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "final")
    # every set with a link was fetched when it was found
    degree = _degrees(links, final, sets_a.unionAll(sets_b.join(sets_a, "class", "left_anti")), percent) if count_links else None
    labelled = classes.select("class", "rep").join(final.withColumnRenamed("node", "class"), "class", "left")
    columns = ["class", "component_id"]
    if count_links:
        labelled = labelled.join(degree, "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        columns.append("n_links")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "class")), "labelled")
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = labelled.join(smallest, "component").select(*columns)
    out = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "class").join(found, "class").select("doc_id", "n_shingles", *columns[1:])
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                                   *[F.lit(0).cast("long").alias(c) for c in columns[2:]])
    return out.unionAll(alone)
