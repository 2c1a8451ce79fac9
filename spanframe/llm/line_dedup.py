"""Operator 5: repeated passages by content-defined chunks of lines. DataFrame functions only.

A rolling hash over the hashes of two successive lines says where a chunk may
end. Every line starts a chunk for each of a few rolling hashes; the chunk ends
at the first line at or after the next where that hash is even (or after
``longest`` lines). So a chunk is settled by its own lines alone, wherever they
stand in a document. Chunks that stand at more than one place are compared byte
by byte with the first place, and then removed everywhere else.

With ``whole`` the chunks are instead the shortest runs of ``least_chars``
characters that start, and those that end, at each line; one line may do. Every
line of a repeated passage of that length lies in one that is inside the
passage, so the whole passage is found, whatever stands around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import free_names
from spanframe.session import materialize

ROLLING, LONGEST, LEAST_CHARS = 3, 8, 100

_KEY = ["doc_id", "text_hash"]
#: Hash residues that at most go out as a broadcast, to tell which texts need a join.
RESIDUES = 1 << 20


def _residue(text_hash: Column | str) -> Column:
    return F.pmod(F.xxhash64(text_hash), F.lit(RESIDUES)).cast("int")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _chunks(lines: Column, rolling: int, longest: int, least_chars: int) -> Column:
    """Array of (first, last, hash) over an array of lines; last is inclusive."""
    # arrays of one element: what stands in them is evaluated once, not again for each use
    hashed = F.array(F.struct(F.transform(lines, F.md5).alias("h"), F.transform(lines, F.length).alias("n")))

    def with_cuts(y: Column) -> Column:
        def cut(s: int) -> Column:  # for each line: does a chunk end there by rolling hash s
            return F.transform(y["h"], lambda h, j: F.substring(F.md5(F.concat(F.get(y["h"], j - 1), h, F.lit(str(s)))), 32, 1).isin(*"02468ace"))

        return F.struct(y["h"].alias("h"), y["n"].alias("n"), *[cut(s).alias(f"c{s}") for s in range(rolling)])

    def of(x: Column) -> Column:
        top = F.size(x["h"]) - 1

        def ends(i: Column) -> Column:
            edge = F.least(i + (longest - 1), top)
            reach = F.sequence(i + 1, edge)

            def end(s: int) -> Column:
                return F.coalesce(F.get(F.filter(reach, lambda j: F.get(x[f"c{s}"], j)), F.lit(0)), edge)

            return F.array_distinct(F.array(*[end(s) for s in range(rolling)]))

        def made(i: Column) -> Column:
            return F.transform(ends(i), lambda j: F.struct(
                i.alias("first"), j.alias("last"), F.xxhash64(F.slice(x["h"], i + 1, j - i + 1)).alias("hash"),
                F.aggregate(F.slice(x["n"], i + 1, j - i + 1), F.lit(0), lambda a, b: a + b).alias("chars")))

        every = F.when(top >= 1, F.flatten(F.transform(F.sequence(F.lit(0), top - 1), made)))
        return F.filter(every, lambda c: c["chars"] + c["last"] - c["first"] >= least_chars)

    return F.flatten(F.transform(F.transform(hashed, with_cuts), of))


def _runs(lines: Column, least_chars: int) -> Column:
    """Like ``_chunks``: for each line the shortest run of ``least_chars`` characters or more from it on, and the one up to it."""
    hashed = F.array(F.struct(F.transform(lines, F.md5).alias("h"), F.transform(lines, F.length).alias("n")))

    def of(x: Column) -> Column:
        top = F.size(x["h"]) - 1

        def steps(own: Column) -> Column:
            """How many of these lines it takes, their line ends between them counted; null if all are too few."""
            start = F.struct(F.lit(-1).alias("chars"), F.lit(0).alias("k"))
            done = F.aggregate(own, start, lambda a, n: F.when(a["chars"] >= least_chars, a).otherwise(
                F.struct((a["chars"] + n + 1).alias("chars"), (a["k"] + 1).alias("k"))))
            return F.transform(F.array(done), lambda d: F.when(d["chars"] >= least_chars, d["k"]))[0]

        # a line end counts as a character, so least_chars + 1 lines always do; mostly the first few do
        def forth(i: Column) -> Column:
            return F.coalesce(*[steps(F.slice(x["n"], i + 1, F.lit(w))) for w in (3, least_chars + 1)])

        def back(i: Column) -> Column:
            def own(w: int) -> Column:
                first = F.greatest(i - (w - 1), F.lit(0))
                return F.reverse(F.slice(x["n"], first + 1, i - first + 1))

            return F.coalesce(*[steps(own(w)) for w in (3, least_chars + 1)])

        def made(i: Column) -> Column:
            ends = F.array(F.struct(i.alias("first"), (i + forth(i) - 1).alias("last")), F.struct((i - back(i) + 1).alias("first"), i.alias("last")))
            some = F.array_distinct(F.filter(ends, lambda e: e["first"].isNotNull() & e["last"].isNotNull()))
            return F.transform(some, lambda e: F.struct(
                e["first"].alias("first"), e["last"].alias("last"), F.xxhash64(F.slice(x["h"], e["first"] + 1, e["last"] - e["first"] + 1)).alias("hash")))

        return F.flatten(F.transform(F.sequence(F.lit(0), top), made))

    return F.flatten(F.transform(hashed, of))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rolling: int = ROLLING, longest: int = LONGEST,
                   least_chars: int = LEAST_CHARS, whole: bool = True) -> DataFrame:
    """(doc_id, text_hash, gone): sorted numbers of the lines to remove, for the texts that lose any.

    Hashes and places of all chunks are written once. Counts per hash are made
    before the shuffle; a hot chunk's places meet its first place in a plain
    join. Only texts with repeated chunks are shuffled for the comparison: a
    broadcast of at most RESIDUES hash residues holds back most others.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    chunks = base.select(*_KEY, F.explode(_runs(_lines(F.col("text")), least_chars) if whole
                                            else _chunks(_lines(F.col("text")), rolling, longest, least_chars)).alias("c"))
    chunks = materialize(chunks.select(*_KEY, "c.first", "c.last", "c.hash").distinct(), "chunks")
    # a null id is the last of all
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "first")
    often = chunks.groupBy("hash").agg(F.min(place).alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    places = chunks.join(often, "hash").withColumn("won", place == F.col("winner"))
    wanted = places.groupBy(*_KEY).agg(F.collect_list(F.struct("hash", "first", "last", "won")).alias("own"))
    wanted = materialize(wanted, "repeats")
    k = wanted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "own")
    likely = base.withColumn("residue", _residue("text_hash")).join(F.broadcast(k.select(_residue("h").alias("residue")).distinct()), "residue", "left_semi")
    met = likely.select(*_KEY, "text").dropDuplicates(_KEY).join(k, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")))
    pieces = met.select(*_KEY, _lines(F.col("text")).alias("lines"), F.explode("own").alias("o")).select(
        *_KEY, "o.hash", "o.first", "o.last", "o.won",
        F.array_join(F.slice("lines", F.col("o.first") + 1, F.col("o.last") - F.col("o.first") + 1), "\n").alias("piece"))
    pieces = materialize(pieces, "pieces")
    originals = pieces.where("won").select("hash", F.col("piece").alias("original"))
    same = pieces.where("not won").join(originals, "hash").where(F.col("piece") == F.col("original"))
    return same.groupBy(*_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))).alias("gone"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", details: bool = False, **options) -> DataFrame:
    """``docs`` without the lines of repeated chunks, in the same columns.

    A chunk has ``least_chars`` characters or more; of equal chunks the one in
    the smallest id stays (a null id comes last; within a document, the first),
    so no line's first place is ever removed. Without ``whole`` a chunk also has
    two lines or more and ends at a cut, so that single lines, and parts of
    passages without a cut, stay. A text that loses all lines becomes empty;
    null stays null. Rows equal in id and text are one document and keep the
    same lines. With ``details``, ``n_lines`` and ``n_removed`` are added, and
    replace columns of these names. An empty table gives an empty table.
    """
    of, hashed, lost, own, residue = free_names(docs.columns, "_id", "_hash", "_gone", "_key", "_residue")
    gone = repeated_lines(docs, key, text, **options).select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed), F.col("gone").alias(lost))
    gone = materialize(gone, "gone")
    keyed = docs.withColumn(own, F.xxhash64(F.col(text))).withColumn(residue, _residue(own))
    # texts that lose nothing, all but a few of them, do not take part in the join
    some = F.broadcast(gone.select(_residue(hashed).alias(residue)).distinct())
    joined = keyed.join(some, residue, "left_semi").join(gone, F.col(key).eqNullSafe(F.col(of)) & (F.col(own) == F.col(hashed)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns] + [F.col(lost)]
    met = joined.select(*names).unionAll(keyed.join(some, residue, "left_anti").withColumn(lost, F.lit(None).cast("array<int>")).select(*names))
    lines = _lines(F.col(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    clean = F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = {text: clean}
    if details:
        out |= {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
                "n_removed": F.coalesce(F.size(lost), F.lit(0)).cast("long")}
    return met.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns], *[v.alias(c) for c, v in out.items() if c not in docs.columns])
