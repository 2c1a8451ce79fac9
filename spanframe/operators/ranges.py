"""Interval algebra. Intervals are 0-based, half-open: (keys, chrom, start, end).

Two building blocks carry everything here:

* ``range_join`` for operators whose result *is* pairs: both sides are cut into
  position bins and joined on (keys, chrom, bin), so Spark shuffles, sorts,
  broadcasts (below its own size limit) and splits skewed partitions as for any
  equi-join;
* ``prefix_scan`` for operators that only need unions, depths, counts or
  totals: those are answered from running sums over sorted boundaries, with no
  pairs at all, so piled-up intervals cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.scan import TILE_SHIFT, prefix_scan, tile_of
from spanframe.session import materialize

#: Bin width 16,384 for intervals below ``SPAN_BINS`` bins, 524,288 above.
BIN_SHIFT = 14
COARSE_SHIFT = BIN_SHIFT + 5
SPAN_BINS = 8
#: Rows that one task combines before a join, about.
PACKED_ROWS = 250_000


def _part(keys: Sequence[str]) -> list[str]:
    return [*keys, "chrom"]


# ---------------------------------------------------------------- pair joins

def _slots(start: Column, last: Column, shift: int, tag: int) -> Column:
    """Bin numbers from ``start`` to ``last``, with the join class in two low bits."""
    return F.sequence(F.shiftright(start, shift) * 4 + tag, F.shiftright(last, shift) * 4 + tag, F.lit(4).cast("bigint"))


def _overlap_slots(start: Column, last: Column, side: str, split_long: bool) -> Column:
    """Class 0 joins short with short in narrow bins; 1 and 2 join long left
    (right) rows with the other side in wide bins, so no row spans many bins."""
    fine = _slots(start, last, BIN_SHIFT, 0)
    if not split_long:
        return fine
    own, other = (1, 2) if side == "left" else (2, 1)
    is_long = F.shiftright(last, BIN_SHIFT) - F.shiftright(start, BIN_SHIFT) >= SPAN_BINS
    wide_own = _slots(start, last, COARSE_SHIFT, own)
    wide_other = _slots(start, last, COARSE_SHIFT, other)
    # long x long pairs meet once, in the left side's class
    long_slots = F.concat(wide_own, wide_other) if side == "right" else wide_own
    return F.when(is_long, long_slots).otherwise(F.concat(fine, wide_other))


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Rename every column but the keys and chrom."""
    same = {*keys, "chrom"}
    return df.select(*[F.col(c) if c in same else F.col(c).alias(prefix + c) for c in df.columns])


def range_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), *, rule: str = "overlap",
               prefix: str = "b_", split_long: bool = True, salt: int = 1, pack: tuple[Sequence[str], Sequence[Column]] | None = None) -> DataFrame:
    """Pairs of ``a`` and ``b`` rows on the same keys and chrom.

    ``rule``: ``overlap`` (at least one shared position; adds ``overlap_bp``),
    ``start`` (a.start in [b.start, b.end)) or ``start_closed`` (end included).
    ``b`` columns other than keys and chrom come out with ``prefix``.

    ``split_long=False`` skips the wide-bin classes: right when ``b`` is merged,
    since disjoint intervals fill at most rows + genome/bin slots per key, and
    when ``a`` holds points, so that the large side is not doubled. With the
    ``start`` rules a point has one bin always; a long ``b`` takes every bin it
    covers, each of which gives result rows where it holds points.
    ``salt`` > 1 spreads each bin of ``a`` over that many sub-keys and copies
    the ``b`` rows of the bin to each, for sessions without adaptive skew joins.
    ``pack`` (columns, aggregates) combines rows of ``a`` that are equal in these
    columns after they are dealt by bin: one exchange serves both, in a number of
    tasks that grows with the rows, so that the groups of a task do not.
    """
    part = _part(keys)
    right = prefixed(b, keys, prefix)
    bs, be = F.col(f"{prefix}start"), F.col(f"{prefix}end")
    start, end = F.col("start"), F.col("end")

    if rule == "overlap":
        left = a.withColumn("_slot", F.explode(_overlap_slots(start, end - 1, "left", split_long)))
        right = right.withColumn("_slot", F.explode(_overlap_slots(bs, be - 1, "right", split_long)))
        first = F.greatest(start, bs)
        home = F.when(F.col("l._slot").bitwiseAND(3) == 0, F.shiftright(first, BIN_SHIFT)) \
            .otherwise(F.shiftright(first, COARSE_SHIFT))
        hit = (start < be) & (bs < end) & (home == F.shiftright("l._slot", 2))
    else:
        last = be if rule == "start_closed" else be - 1
        hit = (bs <= start) & (start <= last)
        left = a.withColumn("_slot", F.shiftright(start, BIN_SHIFT) * 4)
        right = right.withColumn("_slot", F.explode(_slots(bs, last, BIN_SHIFT, 0)))

    on = [*part, "_slot"]
    columns = a.columns
    if pack:
        tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-a.count() // PACKED_ROWS))
        left = left.repartition(tasks, *on).groupBy(*pack[0], "_slot").agg(*pack[1])
        columns = [c for c in left.columns if c != "_slot"]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salt)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("_salt")
    l, r = left.alias("l"), right.alias("r")
    pairs = l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [hit])
    extra = [(F.least(end, be) - F.greatest(start, bs)).alias("overlap_bp")] if rule == "overlap" else []
    return pairs.select(*[F.col(f"l.{c}") for c in columns],
                        *[F.col(c) for c in right.columns if c.startswith(prefix)], *extra)


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """All overlapping pairs with ``overlap_bp``; duplicates on either side stay."""
    return range_join(a, b, keys, **options)


def intersect_pieces(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Clipped pieces a ∩ b, one per overlapping pair, with ``a``'s other columns."""
    pairs = range_join(a, b, keys, **options)
    rest = [c for c in a.columns if c not in ("start", "end")]
    return pairs.select(*rest, F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))


# ------------------------------------------------------- unions and coverage

def merge_intervals(df: DataFrame, keys: Sequence[str] = (), max_gap: int = 0,
                    shift: int = TILE_SHIFT) -> DataFrame:
    """Union per (keys, chrom): joins while ``start <= current_end + max_gap``.

    0 joins touching intervals, n > 0 bridges gaps up to n, -1 joins true
    overlaps only. Runs are found per tile, then joined across tiles: a run
    that starts within reach of earlier tiles belongs to their last open run.
    """
    part = _part(keys)
    starts = df.groupBy(*part, "start").agg(F.max("end").alias("end"))
    tiled = starts.withColumn("_tile", tile_of("start", shift)).repartition(*part, "_tile")
    within = Window.partitionBy(*part, "_tile").orderBy("start")
    reach = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    runs = (tiled
            .withColumn("_first", F.when(reach.isNull() | (F.col("start") > reach + max_gap), F.col("start")))
            .withColumn("_run", F.max("_first").over(within.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*part, "_tile", "_run").agg(F.max("end").alias("end")))

    earlier = Window.partitionBy(*part).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = (runs.groupBy(*part, "_tile").agg(F.max("_run").alias("_last"), F.max("end").alias("_end"))
             .withColumn("_reach", F.max("_end").over(earlier))
             .withColumn("_opened", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach") + max_gap),
                                           F.col("_last")))
             .withColumn("_open", F.max("_opened").over(earlier))
             .select(*part, "_tile", "_reach", "_open"))
    anchor = F.when(F.col("_reach").isNull() | (F.col("_run") > F.col("_reach") + max_gap), F.col("_run")) \
        .otherwise(F.col("_open"))
    return (runs.join(carry, [*part, "_tile"]).withColumn("start", anchor)
            .groupBy(*part, "start").agg(F.max("end").alias("end")))


def depth_segments(df: DataFrame, keys: Sequence[str] = (), counts: dict[str, Column] | None = None) -> DataFrame:
    """Maximal pieces with constant depth (> 0): (keys, chrom, start, end, counts...).

    ``counts`` gives, per output column, how much a row adds to that depth.
    Boundaries where every depth stays the same are dropped, so touching pieces
    of equal depth come out joined.
    """
    part = _part(keys)
    counts = counts or {"depth": F.lit(1)}
    names = list(counts)
    up = F.struct(F.col("start").alias("pos"), *[c.cast("bigint").alias(n) for n, c in counts.items()])
    down = F.struct(F.col("end").alias("pos"), *[(-c).cast("bigint").alias(n) for n, c in counts.items()])
    changes = (df.select(*part, F.explode(F.array(up, down)).alias("e")).select(*part, "e.*")
               .groupBy(*part, "pos").agg(*[F.sum(n).alias(n) for n in names])
               .where(" OR ".join(f"{n} <> 0" for n in names)))
    after = {n: F.col(f"{n}_before") + F.col(n) for n in names}
    return (prefix_scan(changes, part, sums=names, next_pos="end")
            .select(*part, F.col("pos").alias("start"), "end", *[after[n].alias(n) for n in names])
            .where(F.col("end").isNotNull())
            .where(" OR ".join(f"{n} > 0" for n in names)))


def tagged_depth(sets: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Depth pieces of several interval sets over a shared axis, one count each."""
    part = _part(keys)
    stacked = None
    for name, df in sets.items():
        rows = df.select(*part, "start", "end", F.lit(name).alias("_set"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return depth_segments(stacked, keys, {n: (F.col("_set") == n).cast("bigint") for n in sets})


def complement(excluded: DataFrame, domain: DataFrame, keys: Sequence[str] = (), min_length: int = 1) -> DataFrame:
    """Pieces of ``domain`` (disjoint, per keys and chrom) not covered by ``excluded``."""
    pieces = tagged_depth({"dom": domain, "cut": excluded}, keys).where("dom > 0 AND cut = 0")
    return pieces.where(F.col("end") - F.col("start") >= min_length).select(*_part(keys), "start", "end")


def whole_chroms(sizes: DataFrame) -> DataFrame:
    """(chrom, size) -> one interval per chromosome."""
    return sizes.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("end"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pieces of each ``a`` row that no ``b`` covers, with ``a``'s other columns.

    ``b`` is turned into the gaps it leaves in ``a``'s extent; each result row
    is one (a, gap) pair, so the join never makes more rows than the result.
    """
    part = _part(keys)
    extent = a.groupBy(*part).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inside = b.join(extent.select(*part), part, "left_semi")
    return intersect_pieces(a, complement(inside, extent, keys), keys)


def slop(df: DataFrame, bp: int, sizes: DataFrame) -> DataFrame:
    """Extend both ends, clipped to the genome; unknown chroms are dropped."""
    size = F.col("_size")
    return (df.join(sizes.select("chrom", F.col("size").alias("_size")), "chrom")
            .withColumn("start", F.greatest(F.col("start") - bp, F.lit(0).cast("bigint")))
            .withColumn("end", F.least(F.col("end") + bp, size)).select(*df.columns))


# -------------------------------------------------- membership without pairs

def mark_overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), *, name: str = "hit",
                  closed_gap: int | None = None) -> DataFrame:
    """``a`` with a flag: is there a ``b`` overlapping it?

    With M(x) the largest end of any b starting before x, a row is hit exactly
    when M(a.end) > a.start: one running maximum, no pairs, duplicates or
    nesting of b do not matter. ``closed_gap=p`` also accepts b up to p away,
    both comparisons closed.
    """
    part = _part(keys)
    if closed_gap is None:
        probe, enough, inclusive = F.col("end"), F.col("_reach") > F.col("start"), False
    else:
        probe, inclusive = F.col("end") + closed_gap, True
        enough = F.col("_reach") >= F.col("start") - closed_gap
    probed = a.withColumn("_pos", probe)
    marks = (b.select(*part, F.col("start").alias("pos"), F.col("end").alias("reach"), F.lit(0).alias("q"))
             .unionByName(probed.select(*part, F.col("_pos").alias("pos"),
                                        F.lit(None).cast("bigint").alias("reach"), F.lit(1).alias("q")))
             .groupBy(*part, "pos").agg(F.max("reach").alias("reach"), F.max("q").alias("q")))
    best = F.greatest("reach_before", "reach") if inclusive else F.col("reach_before")
    looked = (prefix_scan(marks, part, maxes=["reach"]).where("q = 1")
              .select(*part, F.col("pos").alias("_pos"), best.alias("_reach")))
    return (probed.join(looked, [*part, "_pos"])
            .select(*a.columns, F.coalesce(enough, F.lit(False)).alias(name)))


def overlaps_any(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return mark_overlaps(a, b, keys, name="_hit").where("_hit").drop("_hit")


def overlaps_none(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return mark_overlaps(a, b, keys, name="_hit").where("NOT _hit").drop("_hit")


def exclude_near(a: DataFrame, b: DataFrame, proximity: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a ``b`` within ``proximity``; touching counts even at 0."""
    marked = mark_overlaps(a, b, keys, name="_hit", closed_gap=proximity)
    return marked.where("NOT _hit").drop("_hit")


def first_covers(b: DataFrame, keys: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Merged ``b`` with the end of the interval before each (null for the first).

    An interval is the first that a row [s, e) overlaps exactly when the one
    before ends at s or earlier; so pairs that say so count each row once,
    however long it is.
    """
    merged = merge_intervals(b, keys).withColumnRenamed("start", "pos")
    return prefix_scan(merged, _part(keys), maxes=["end"]).select(*_part(keys), F.col("pos").alias("start"), "end", F.col("end_before").alias(name))


def is_first_cover(start: Column, before: Column) -> Column:
    return before.isNull() | (before <= start)


def _point_slots(points: DataFrame) -> DataFrame:
    return points.withColumn("_slot", F.shiftright("start", BIN_SHIFT))


def _longest(points: DataFrame) -> int:
    """Length of the longest row: how far left of an interval one can start and still overlap it."""
    return points.agg(F.max(F.col("end") - F.col("start")).alias("n")).first()["n"] or 1


def _cover_slots(b: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    return first_covers(b, keys, "_before").select(
        *_part(keys), F.col("start").alias("_bs"), F.col("end").alias("_be"), "_before",
        F.explode(_slots(F.col("start") - (longest - 1), F.col("end") - 1, BIN_SHIFT, 0)).alias("_s4")) \
        .withColumn("_slot", F.shiftright("_s4", 2)).drop("_s4")


def _meets(part: Sequence[str]) -> list[Column]:
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in [*part, "_slot"]]
    return [*same, F.col("p.start") < F.col("r._be"), F.col("r._bs") < F.col("p.end"), is_first_cover(F.col("p.start"), F.col("r._before"))]


def points_in(points: DataFrame, b: DataFrame, keys: Sequence[str] = (), how: str = "left_semi") -> DataFrame:
    """Points, of any length, that overlap some ``b`` (``left_semi``) or none
    (``left_anti``). Each point has one bin, so the big side is shuffled once and
    a bin holding many points is split by the adaptive skew join."""
    joined = _point_slots(points).alias("p").join(_cover_slots(b, keys, _longest(points)).alias("r"), _meets(_part(keys)), how)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns])


def flag_points(points: DataFrame, sets: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Points with one flag per interval set. All joins share the points' bins, so
    one shuffle of the points serves every set. A point meets the first interval
    it overlaps only, so no row is repeated, whatever its length."""
    out = _point_slots(points)
    longest = _longest(points)
    columns = list(points.columns)
    for name, b in sets.items():
        joined = out.alias("p").join(_cover_slots(b, keys, longest).alias("r"), _meets(_part(keys)), "left")
        out = joined.select(*[F.col(f"p.{c}") for c in [*columns, "_slot"]], F.col("r._bs").isNotNull().alias(name))
        columns.append(name)
    return out.drop("_slot")


def label_points(points: DataFrame, pieces: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 closed: bool = False) -> DataFrame:
    """Points with the ``columns`` of the piece holding their start, else null.
    ``pieces`` are disjoint; with ``closed`` their ends count as inside, and
    they must not touch."""
    slotted = points.withColumn("_slot", F.shiftright("start", BIN_SHIFT) * 4)
    return label_slotted(slotted, pieces, keys, columns, closed).drop("_slot")


def label_slotted(points: DataFrame, pieces: DataFrame, keys: Sequence[str], columns: Sequence[str], closed: bool = False) -> DataFrame:
    """``label_points`` for points that carry the bin of their start times four in ``_slot``: dealt by it already, they stay where they are."""
    part = _part(keys)
    last = F.col("end") if closed else F.col("end") - 1
    right = pieces.select(*part, F.col("start").alias("_bs"), last.alias("_be"), *columns,
                          F.explode(_slots(F.col("start"), last, BIN_SHIFT, 0)).alias("_slot"))
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in [*part, "_slot"]]
    inside = [F.col("r._bs") <= F.col("p.start"), F.col("p.start") <= F.col("r._be")]
    return points.alias("p").join(right.alias("r"), same + inside, "left").select(
        *[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in columns])


def overlap_totals(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), *, count: str = "n_overlaps",
                   bp: str = "overlap_bp") -> DataFrame:
    """``a`` with the number of overlapping ``b`` rows and the summed overlap.

    Exact integers from four running sums over b's boundaries:
    overlapping = starts before a.end minus ends up to a.start, and the summed
    overlap is G(a.end) - G(a.start), G(x) = Σ over b of its part left of x.
    """
    part = _part(keys)
    zero = F.lit(0).cast("bigint")

    def mark(pos, opened, open_at, closed, close_at):
        return F.struct(pos.alias("pos"), opened.cast("bigint").alias("opened"), open_at.alias("open_at"),
                        closed.cast("bigint").alias("closed"), close_at.alias("close_at"))

    s, e = F.col("start"), F.col("end")
    edges = F.array(mark(s, F.lit(1), s, zero, zero), mark(e, zero, zero, F.lit(1), e))
    probes = F.array(mark(s, zero, zero, zero, zero), mark(e, zero, zero, zero, zero))
    sums = ["opened", "open_at", "closed", "close_at"]
    marks = (b.select(*part, F.explode(edges).alias("m")).unionByName(a.select(*part, F.explode(probes).alias("m")))
             .select(*part, "m.*").groupBy(*part, "pos").agg(*[F.sum(c).alias(c) for c in sums]))
    at = prefix_scan(marks, part, sums=sums).select(
        *part, "pos", F.col("opened_before").alias("_o"),
        (F.col("closed_before") + F.col("closed")).alias("_c"),
        (F.col("pos") * F.col("opened_before") - F.col("open_at_before")
         - F.col("pos") * F.col("closed_before") + F.col("close_at_before")).alias("_g"))
    low = at.select(*part, F.col("pos").alias("start"), F.col("_c").alias("_c_low"), F.col("_g").alias("_g_low"))
    high = at.select(*part, F.col("pos").alias("end"), F.col("_o").alias("_o_high"), F.col("_g").alias("_g_high"))
    return (a.join(low, [*part, "start"]).join(high, [*part, "end"])
            .select(*a.columns, (F.col("_o_high") - F.col("_c_low")).alias(count),
                    (F.col("_g_high") - F.col("_g_low")).alias(bp)))


def count_points(regions: DataFrame, points: DataFrame, keys: Sequence[str] = (), name: str = "n_points") -> DataFrame:
    """``regions`` with the number of points whose start lies inside; no pairs.

    Only positions that regions ask for are joined back, by sorting: sizes of
    compressed or repeated rows are guessed far too low for a broadcast.
    """
    part = _part(keys)
    probes = regions.select(*part, F.explode(F.array("start", "end")).alias("pos"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("q"))
    marks = (points.select(*part, F.col("start").alias("pos"), F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("q"))
             .unionByName(probes).groupBy(*part, "pos").agg(F.sum("n").alias("n"), F.max("q").alias("q")))
    at = prefix_scan(marks, part, sums=["n"]).where("q = 1").select(*part, "pos", F.col("n_before").alias("_n"))
    low = at.select(*part, F.col("pos").alias("start"), F.col("_n").alias("_low")).hint("merge")
    high = at.select(*part, F.col("pos").alias("end"), F.col("_n").alias("_high")).hint("merge")
    return (regions.join(low, [*part, "start"]).join(high, [*part, "end"])
            .select(*regions.columns, (F.col("_high") - F.col("_low")).alias(name)))


# ------------------------------------------------------------ composed forms

def merge_with_provenance(df: DataFrame, keys: Sequence[str] = (), member: str = "sample_id",
                          max_gap: int = 1000) -> DataFrame:
    """Merged regions with their distinct members, sorted, and their number."""
    part = _part(keys)
    merged = merge_intervals(df, keys, max_gap)
    members = df.select(*part, "start", F.col(member).alias("_member")).distinct()
    found = range_join(members, merged, keys, rule="start", prefix="m_", split_long=False)
    return (found.groupBy(*part, F.col("m_start").alias("start"), F.col("m_end").alias("end"))
            .agg(F.array_sort(F.collect_set("_member")).alias("samples"))
            .withColumn("sample_count", F.size("samples").cast("bigint"))
            .withColumn("length", F.col("end") - F.col("start")))


def supported_spans(points: DataFrame, keys: Sequence[str] = (), min_gap: int = 20_000) -> DataFrame:
    """Spans of points, split where the gap reaches ``min_gap``."""
    return merge_intervals(points, keys, max_gap=min_gap - 1)


def overlap_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merged totals, intersection, union and their ratios, per key."""
    from spanframe.functions import safe_divide

    length = F.col("end") - F.col("start")
    pieces = tagged_depth({"a": a, "b": b}, keys)

    def total(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), length)), F.lit(0)).cast("bigint")

    sums = [total("a > 0").alias("a_bp"), total("b > 0").alias("b_bp"),
            total("a > 0 AND b > 0").alias("overlap_bp"), F.sum(length).alias("union_bp")]
    out = pieces.groupBy(*keys).agg(*sums) if keys else pieces.agg(*sums)
    return (out.withColumn("a_fraction", safe_divide("overlap_bp", "a_bp"))
            .withColumn("b_fraction", safe_divide("overlap_bp", "b_bp"))
            .withColumn("jaccard", safe_divide("overlap_bp", "union_bp")))


def genome_coverage_pct(df: DataFrame, sizes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percent of the genome covered at depth one or more, per key."""
    covered = depth_segments(df, keys).withColumn("_len", F.col("end") - F.col("start"))
    sums = F.sum("_len").alias("covered_bp")
    out = covered.groupBy(*keys).agg(sums) if keys else covered.agg(sums)
    genome = sizes.agg(F.sum("size").alias("genome_bp"))
    return out.crossJoin(F.broadcast(genome)).withColumn(  # one row: a global sum
        "coverage_pct", 100.0 * F.col("covered_bp") / F.col("genome_bp"))


def pairwise_matrices(df: DataFrame, keys: Sequence[str] = ("sample_id",), tool: str = "tool",
                      merge_first: bool = True) -> DataFrame:
    """Coverage of a by b and Jaccard for every tool pair of each key, in long form.

    ``merge_first=False`` sums the overlaps of the rows as given over the merged
    total, so a tool that overlaps itself can exceed 1.

    One scan over all tools' depths answers every pair: where a and b have
    depths x and y over n positions, their rows share x * y * n positions and
    their unions n. Rows that pile up are never paired. Tools are labels: their
    list is read once, and a position holds one depth for each.
    """
    from spanframe.functions import safe_divide

    names = sorted(r[tool] for r in df.select(tool).where(F.col(tool).isNotNull()).distinct().collect())
    other = f"b_{tool}"
    depths = {f"_d{i}": (F.col(tool) == F.lit(t)).cast("bigint") for i, t in enumerate(names)}
    if not names:
        depths = {"_d0": F.lit(0)}
    pieces = depth_segments(df.where(F.col(tool).isNotNull()), keys, depths)
    entries = [F.struct(F.lit(t).alias("t"), F.col(f"_d{i}").alias("d")) for i, t in enumerate(names)] or [F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("d"))]
    present = F.filter(F.array(*entries), lambda x: x["d"] > 0)
    length = F.col("end") - F.col("start")
    pairs = pieces.select(*keys, length.alias("_n"), present.alias("_p")).withColumn("_a", F.explode("_p")).withColumn("_b", F.explode("_p"))
    times = F.lit(1) if merge_first else F.col("_a.d") * F.col("_b.d")
    shared = pairs.groupBy(*keys, F.col("_a.t").alias(tool), F.col("_b.t").alias(other)).agg(
        F.sum(F.col("_n") * times).alias("overlap_bp"), F.sum("_n").alias("_merged_overlap"))
    # one entry for each pair of a key's tools that meet; a tool's own merged overlap is its size
    listed = shared.groupBy(*keys).agg(F.collect_list(F.struct(tool, other, "overlap_bp", "_merged_overlap")).alias("_s"))
    own = F.filter("_s", lambda x: x[tool] == x[other])
    grid = listed.select(*keys, F.map_from_entries(F.transform("_s", lambda x: F.struct(F.struct(x[tool].alias("a"), x[other].alias("b")), x))).alias("_m"), own.alias("_o"))
    grid = grid.select(*keys, "_m", "_o", F.explode("_o").alias("_a")).select(*keys, "_m", "_a", F.explode("_o").alias("_b"))
    met = F.element_at("_m", F.struct(F.col(f"_a.{tool}").alias("a"), F.col(f"_b.{tool}").alias("b")))
    out = grid.select(*keys, F.col(f"_a.{tool}").alias(tool), F.col(f"_b.{tool}").alias(other), F.col("_a._merged_overlap").alias("bp"), F.col("_b._merged_overlap").alias("b_bp"),
                      F.coalesce(met["overlap_bp"], F.lit(0)).cast("bigint").alias("overlap_bp"), F.coalesce(met["_merged_overlap"], F.lit(0)).alias("_merged_overlap"))
    union = F.col("bp") + F.col("b_bp") - F.col("_merged_overlap")
    return out.select(*keys, tool, other, "bp", "b_bp", "overlap_bp", safe_divide("overlap_bp", "bp").alias("pct_cover"),
                      safe_divide(F.col("_merged_overlap"), union).alias("jaccard"))


def consensus_regions(segments: DataFrame, keys: Sequence[str] = ("tool",), member: str = "sample_id") -> DataFrame:
    """Pieces with constant distinct-member support, equal neighbours joined.

    Members are merged first, so depth counts each once; depth pieces already
    come out joined where support does not change.
    """
    merged = merge_intervals(segments, [*keys, member])
    return depth_segments(merged, keys, {"n_supporting_samples": F.lit(1)})


def consensus_consistency(segments: DataFrame, member: str = "sample_id", tool: str = "tool") -> DataFrame:
    """Per member and tool: bp inside consensus and inside high-support consensus."""
    from spanframe.functions import safe_divide

    cutoff = segments.agg(F.greatest(F.lit(2), F.ceil(F.countDistinct(member) / 2)).cast("bigint")
                          .alias("high_support_cutoff"))
    consensus = consensus_regions(segments, (tool,), member).crossJoin(F.broadcast(cutoff))  # one row: a global count
    # consensus of a tool covers its own segments, so only the strong part needs measuring
    strong = materialize(consensus.where("n_supporting_samples >= high_support_cutoff")
                         .select(tool, "chrom", "start", "end"), "strong")
    rows = segments.select(member, tool, "chrom", "start", "end")
    measured = overlap_totals(rows, strong, (tool,), count="_n", bp="_strong_bp")
    return (measured.groupBy(member, tool)
            .agg(F.sum(F.col("end") - F.col("start")).alias("total_bp"),
                 F.sum("_strong_bp").alias("high_support_overlap_bp"))
            .withColumn("consensus_overlap_bp", F.col("total_bp"))
            .crossJoin(F.broadcast(cutoff))
            .withColumn("fraction_bp_in_consensus", safe_divide("consensus_overlap_bp", "total_bp"))
            .withColumn("fraction_bp_in_high_support_consensus", safe_divide("high_support_overlap_bp", "total_bp")))


def membership(df: DataFrame, sets: Sequence[str], set_column: str = "tool", keys: Sequence[str] = ()) -> DataFrame:
    """Loci by strict merge, with one 0/1 column and one bit of ``subset_key`` per set."""
    part = _part(keys)
    loci = merge_intervals(df, keys, max_gap=-1)
    members = df.select(*part, "start", F.col(set_column).alias("_set")).distinct()
    found = range_join(members, loci, keys, rule="start", prefix="m_", split_long=False)
    flags = [F.max((F.col("_set") == s).cast("int")).alias(f"in_{s}") for s in sets]
    return (found.groupBy(*part, F.col("m_start").alias("start"), F.col("m_end").alias("end")).agg(*flags)
            .withColumn("subset_key", F.concat(*[F.col(f"in_{s}").cast("string") for s in sets])))


def subset_counts(members: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Loci per subset key; every non-empty combination has a row."""
    n = len(sets)
    keys = (members.sparkSession.range(1, 2 ** n)
            .select(F.lpad(F.conv(F.col("id").cast("string"), 10, 2), n, "0").alias("subset_key")))
    label = F.concat_ws("&", *[F.when(F.substring("subset_key", i + 1, 1) == "1", s) for i, s in enumerate(sets)])
    counted = members.groupBy("subset_key").agg(F.count("*").alias("n_loci"))
    return (keys.join(counted, "subset_key", "left").na.fill(0, ["n_loci"])
            .withColumn("n_sets", F.length(F.regexp_replace("subset_key", "0", "")).cast("bigint"))
            .withColumn("label", label))


def annotate_with_sources(union: DataFrame, parts: DataFrame, keys: Sequence[str] = (), source: str = "tool") -> DataFrame:
    """Each region with the sorted distinct sources overlapping it, and their number."""
    part = _part(keys)
    # one merged set per source: a region meets a source's pieces, not its raw rows
    merged = merge_intervals(parts, [*keys, source])
    found = (range_join(union, merged, keys)
             .groupBy(*union.columns).agg(F.array_sort(F.collect_set(f"b_{source}")).alias("_sources")))
    return (union.join(found, union.columns, "left")
            .withColumn("tools", F.coalesce(F.concat_ws(", ", "_sources"), F.lit("")))
            .withColumn("n_tools", F.coalesce(F.size("_sources"), F.lit(0)).cast("bigint")).drop("_sources")
            .select(*union.columns, "tools", F.greatest("n_tools", F.lit(0)).cast("bigint").alias("n_tools")))


def split_signal_overlaps(signal: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overlapping value rows cut at every boundary, shared pieces get the mean of
    the values covering them, equal neighbours are joined.

    Values are summed as exact decimals of 18 places (below 1e20), so the running
    sum returns to zero.
    """
    part = _part(keys)
    exact = signal.withColumn("_v", F.col("value").cast("decimal(38,18)"))
    up = F.struct(F.col("start").alias("pos"), F.lit(1).cast("bigint").alias("n"), F.col("_v").alias("v"))
    down = F.struct(F.col("end").alias("pos"), F.lit(-1).cast("bigint").alias("n"), (-F.col("_v")).alias("v"))
    changes = (exact.select(*part, F.explode(F.array(up, down)).alias("e")).select(*part, "e.*")
               .groupBy(*part, "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where("n <> 0 OR v <> 0"))
    pieces = (prefix_scan(changes, part, sums=["n", "v"], next_pos="end")
              .select(*part, F.col("pos").alias("start"), "end",
                      (F.col("n_before") + F.col("n")).alias("_n"), (F.col("v_before") + F.col("v")).alias("_v"))
              .where("_n > 0")
              .withColumn("value", F.try_divide(F.col("_v").cast("double"), F.col("_n"))))
    # touching pieces with the same value can still differ in depth (1+1 over 2, then 1 over 1)
    joined = merge_intervals(pieces.withColumn("_key", F.col("value")), [*keys, "_key"])
    return joined.withColumnRenamed("_key", "value").select(*part, "start", "end", "value")


def binary_signal(df: DataFrame, value: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    return merge_intervals(df, keys).withColumn("value", F.lit(float(value)))


def end_windows(df: DataFrame, window_bp: int) -> DataFrame:
    """Start and end windows of each (merged) region; one ``merged`` row when they meet."""
    s, e = F.col("start"), F.col("end")
    first_end, last_start = F.least(e, s + window_bp), F.greatest(s, e - window_bp)

    def row(a, b, label):
        return F.struct(a.alias("win_start"), b.alias("win_end"), F.lit(label).alias("window_label"))

    windows = F.when(last_start <= first_end, F.array(row(s, e, "merged"))) \
        .otherwise(F.array(row(s, first_end, "start"), row(last_start, e, "end")))
    return (df.withColumn("_w", F.explode(windows)).select(*df.columns, "_w.*")
            .withColumn("length", F.col("win_end") - F.col("win_start")))


def boundaries(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct starts and ends of the merged regions, as ``pos``."""
    return (merge_intervals(df, keys)
            .select(*_part(keys), F.explode(F.array("start", "end")).alias("pos")).distinct())


def liftover(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Map intervals through a block table (chrom, start, end, dst_chrom,
    dst_start, strand); pieces per block, unmapped parts dropped."""
    pairs = range_join(df, blocks)
    low, high = F.greatest("start", "b_start"), F.least("end", "b_end")
    forward = F.col("b_strand") == "+"
    block_len = F.col("b_end") - F.col("b_start")
    new_start = F.when(forward, F.col("b_dst_start") + (low - F.col("b_start"))) \
        .otherwise(F.col("b_dst_start") + block_len - (high - F.col("b_start")))
    rest = [c for c in df.columns if c not in ("chrom", "start", "end")]
    return pairs.select(F.col("b_dst_chrom").alias("chrom"), new_start.alias("start"),
                        (new_start + (high - low)).alias("end"), *rest)


def pooled_regions(df: DataFrame, tool: str = "tool", settings: str = "settings", min_length: int = 1) -> DataFrame:
    """All samples' regions of a tool, merged and length filtered, with kept and
    excluded counts; a tool whose samples disagree on settings raises."""
    checked = df.groupBy(tool).agg(F.countDistinct(settings).alias("_n"), F.min(settings).alias(settings)) \
        .withColumn(settings, F.when(F.col("_n") == 1, F.col(settings)).otherwise(
            F.raise_error(F.concat(F.lit("samples disagree on settings of "), F.col(tool))).cast("string")))
    merged = merge_intervals(df, [tool]).withColumn("_len", F.col("end") - F.col("start"))
    keep = F.col("_len") >= min_length
    counts = merged.groupBy(tool).agg(F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_excluded"))
    return (merged.where(keep).drop("_len").join(counts, tool)
            .join(checked.select(tool, settings), tool))
