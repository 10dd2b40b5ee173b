"""Joins. Spark chooses the physical strategy; only tables of a checked size are broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str] | str


def join(left: DataFrame, right: DataFrame, on: Keys, how: str = "inner", coalesce_keys: bool = True) -> DataFrame:
    """Equi-join; null keys match nothing. how: inner, left, right, full, semi, anti.

    A full join keeps one key column (the left's, or else the right's), or both with coalesce_keys=False: the right's
    keys then end in _right.
    """
    keys = [on] if isinstance(on, str) else list(on)
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    if coalesce_keys or how in ("semi", "anti"):
        return left.join(right, keys, kind)
    renamed = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    cond = [F.col(k) == F.col(f"{k}_right") for k in keys]
    return left.join(renamed, cond, kind)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def broadcast_join(left: DataFrame, right: DataFrame, on: Keys, how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Broadcasts the right side if it has at most max_rows rows, else joins by shuffle."""
    small = right.limit(max_rows + 1).count() <= max_rows
    return join(left, F.broadcast(right) if small else right, on, how)


def join_where(left: DataFrame, right: DataFrame, predicate: Column, how: str = "inner") -> DataFrame:
    """By any predicate. Equalities in it become join keys; without any, use `range_join` for bounds on large inputs.

    Every pair is built: to count pairs between bounds, use `range_counts`.
    """
    return left.join(right, predicate, how)


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """left.value within [right.low, right.high], as an equi-join on bins of this width.

    A right row goes to each bin that it overlaps and a left row to one, so no pair is found twice. Every pair is built: to count
    pairs, use `range_counts`.
    """
    b = "__bin"
    l = left.withColumn(b, F.floor(F.col(value) / F.lit(width)))
    r = right.where(F.col(low) <= F.col(high)).withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / F.lit(width)), F.floor(F.col(high) / F.lit(width)))))
    return l.join(r, b).where(F.col(value).between(F.col(low), F.col(high))).drop(b)


def _part(t: Column, cuts: Sequence) -> Column:
    """The number of cuts below t, by binary search."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    above = _part(t, cuts[mid + 1 :])
    return F.when(t > F.lit(cuts[mid]), above + F.lit(mid + 1)).otherwise(_part(t, cuts[:mid]))


def range_counts(left: DataFrame, right: DataFrame, value: str, low: str | None, high: str | None, group: Keys, by: Sequence[str] = (), closed: str = "both", name: str = "count") -> DataFrame:
    """For each combination of right's `group` columns, its pairs with left.value between right.low and right.high and equal `by`, counted without being built; combinations without any are left out.

    Either bound may be missing; closed: both, left, right, neither. Left rows are counted by value, bounds are sorted in
    between, and running counts at both bounds are subtracted: work grows with the rows, not with the pairs. Values are cut
    at approximate quantiles within `by` and the parts run in parallel; only one row a part goes through a window of its
    `by`. Nulls match nothing, and NaN is the greatest value. Values are numbers or times.
    """
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError("closed is both, left, right or neither")
    if low is None and high is None:
        raise ValueError("a bound is needed")
    group = [group] if isinstance(group, str) else list(group)
    # A bound stands before (0) or after (2) the left rows (1) of its value. Without a high one, the order is descending.
    place = lambda after: F.lit(2 if after else 0).alias("__place")
    ends = []
    if high is not None:
        ends.append(F.struct(F.col(high).alias("__t"), place(closed in ("both", "right")), F.lit(1).alias("__sign")))
        if low is not None:
            ends.append(F.struct(F.col(low).alias("__t"), place(closed in ("right", "neither")), F.lit(-1).alias("__sign")))
    else:
        ends.append(F.struct(F.col(low).alias("__t"), place(closed in ("both", "left")), F.lit(1).alias("__sign")))
    l, r = left.where(F.col(value).isNotNull()), right
    for c in by:
        l, r = l.where(F.col(c).isNotNull()), r.where(F.col(c).isNotNull())
    if low is None or high is None:
        r = r.where(F.col(low or high).isNotNull())
    else:
        r = r.where(F.col(low) <= F.col(high) if closed == "both" else F.col(low) < F.col(high))
    bounds = r.select(*by, F.struct(*group).alias("__g"), F.inline(F.array(*ends)))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = l.select(F.col(value).alias("__t")).unionAll(bounds.select("__t")).select(F.percentile_approx("__t", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    counts = l.groupBy(*by, F.col(value).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    both = counts.withColumn("__place", F.lit(1)).unionByName(bounds, allowMissingColumns=True)
    both = both.withColumn("__p", _part(F.col("__t"), sorted(set(cuts))))
    t, p = F.col("__t"), F.col("__p")
    w = Window.partitionBy(*by, "__p").orderBy(t if high is not None else t.desc(), "__place").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(p if high is not None else p.desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*by, "__p").agg(F.sum("__n").alias("__n")).select(*by, "__p", F.sum("__n").over(ahead).alias("__carry"))
    at = both.withColumn("__n", F.sum("__n").over(w)).where("__sign IS NOT NULL").join(carry, [*by, "__p"])
    zero = F.lit(0)
    found = F.sum(F.col("__sign") * (F.coalesce("__n", zero) + F.coalesce("__carry", zero))).alias(name)
    return at.groupBy(*[F.col("__g")[c].alias(c) for c in group]).agg(found).where(F.col(name) > 0)


def is_sorted(df: DataFrame, on: str, by: Sequence[str], row: str) -> bool:
    """Whether `on` never falls along `row` within each group."""
    w = Window.partitionBy(*by).orderBy(row)
    return df.select((F.lag(on).over(w) > F.col(on)).alias("falls")).where("falls").limit(1).count() == 0


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), direction: str = "backward", tolerance: Column | int | float | None = None, tie: str | None = None, suffix: str = "_right") -> DataFrame:
    """Each left row with the last right row at or before it (backward), or the first at or after it (forward).

    One union and one window over (by, time): no pairs are built. `tie` orders right rows of equal time (the last one
    wins). A match further away than the tolerance counts as none. Inputs need no order; rows with null keys or times
    stay unmatched. Right columns that clash with left ones get the suffix. Without `by`, time is cut at approximate
    quantiles and the parts run in parallel; only one row a part goes through a single task.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    rest = [c for c in right.columns if c not in by]
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in rest}
    match = F.struct(*[F.col(c).alias(names[c]) for c in rest])
    r = right.where(F.col(right_on).isNotNull())
    for c in by:
        r = r.where(F.col(c).isNotNull())
    kind = F.struct(*left.columns)
    l_rows = left.select(*by, F.col(left_on).alias("__t"), kind.alias("__l"), F.lit(None).cast(r.select(match.alias("m")).schema[0].dataType).alias("__r"), F.lit(None).cast(r.schema[tie].dataType if tie else "int").alias("__tie"))
    r_rows = r.select(*by, F.col(right_on).alias("__t"), F.lit(None).cast(left.select(kind.alias("l")).schema[0].dataType).alias("__l"), match.alias("__r"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("__tie"))
    both = l_rows.unionByName(r_rows)
    keys = list(by)
    if not by:
        n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cuts = both.select(F.percentile_approx("__t", [i / n for i in range(1, n)] or [0.5], 1000)).first()[0] or []
        both = both.withColumn("__p", F.lit(0) if not cuts else sum((F.coalesce(F.lit(x) < F.col("__t"), F.lit(False)).cast("int") for x in sorted(set(cuts))), F.lit(0)))
        keys = ["__p"]
    side = F.col("__l").isNotNull().cast("int")  # at equal times right rows come first (backward) or last (forward)
    backward = direction == "backward"
    w = Window.partitionBy(*keys).orderBy(F.col("__t"), side if backward else side.desc(), F.col("__tie") if backward else F.col("__tie").desc())
    near = F.last("__r", True) if backward else F.first("__r", True)
    ahead, behind = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    out = both.withColumn("__m", near.over(w.rowsBetween(*(ahead if backward else behind))))
    if not by:
        edges = both.select("__p", near.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__edge")).groupBy("__p").agg(F.first("__edge").alias("__edge"))
        ends = Window.orderBy("__p").rowsBetween(*((Window.unboundedPreceding, -1) if backward else (1, Window.unboundedFollowing)))
        carry = F.last("__edge", True) if backward else F.first("__edge", True)
        out = out.join(edges.select("__p", carry.over(ends).alias("__carry")), "__p").withColumn("__m", F.coalesce("__m", "__carry"))
    out = out.where(F.col("__l").isNotNull())
    ok = F.col("__t").isNotNull()
    for c in by:
        ok = ok & F.col(c).isNotNull()
    if tolerance is not None:
        at = F.col(f"__m.{names[right_on]}")
        gap = F.col("__t") - at if direction == "backward" else at - F.col("__t")
        ok = ok & (gap <= (tolerance if isinstance(tolerance, Column) else F.lit(tolerance)))
    m = F.when(ok, F.col("__m"))
    return out.withColumn("__m", m).select("__l.*", *[F.col(f"__m.{names[c]}") for c in rest])
