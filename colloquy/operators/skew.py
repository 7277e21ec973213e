"""Joins and ordered windows that keep working when one key holds a large
share of all rows.

Two ideas carry everything here:

* `lookup_join` salts only the keys counted as hot, so their rows spread over
  many tasks while the other keys join as usual.
* `with_segments` cuts the ordered rows of a hot key into consecutive segments.
  A window then runs per (key, segment), and what a segment needs from the ones
  before it - a carried total, or the last few rows - is small.

The cuts are quantiles of a hash sample. The sample depends on the values alone,
so every retry of a task finds the same cuts. Hot keys and cuts are counted first
and written; where nothing is hot, the plain join or window is what runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import hot_rows, materialize

# Rows of a null key match nothing and are dealt to this many tasks' worth of salts.
NULL_SALTS = 1 << 20
SAMPLES_PER_CUT = 8
_SPLIT_MARK = "cut"


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows: int | None = None, sizes: DataFrame | None = None
) -> DataFrame | None:
    """Keys with more than `rows` rows and their count `_n`, or None if there are
    none. There are at most all rows over `rows` of them; they are written, so
    that the size of the table decides how it is joined."""
    limit = rows or hot_rows(df.sparkSession)
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = materialize(sizes.select(*keys, "_n").filter(F.col("_n") > limit), "hot-keys")
    return None if found.isEmpty() else found


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """`left.join(right, keys, how)` with the hot keys of `left` salted: as many
    salts as the key has `rows`. `sizes` (keys and their row count `_n` in `left`)
    saves counting where it is known. Without hot keys it is the plain join.

    `right` is expected to hold few rows per key (a lookup table); only its rows
    for hot keys are copied, once per salt, so any salt of a left row is right.
    Null keys never match, so their rows are spread too."""
    keys = list(keys)
    limit = rows or hot_rows(left.sparkSession)
    hot = hot_keys(left, keys, limit, sizes)
    if hot is None:
        return left.join(right, keys, how)
    hot = hot.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).alias("_salts"))
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    # equal rows must part, so their place counts, not their values
    place = F.xxhash64(F.monotonically_increasing_id())
    salted = left.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNotNull(), F.pmod(place, "_salts"))
        .when(null_key, F.pmod(place, F.lit(NULL_SALTS)))
        .otherwise(F.lit(0)),
    )
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    copies = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return salted.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def attach(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], rows: int | None = None
) -> DataFrame:
    """`df` plus aggregates of each row's key: what an unordered window would
    give, but aggregated map-side first and joined back with `lookup_join`."""
    return lookup_join(df, df.groupBy(*keys).agg(*aggregates), keys, "left", rows)


def keep_first(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], flag: str) -> DataFrame:
    """Flag the row with the least `row_id` of each key. Joined back on the row
    id, which is unique, so a key that repeats often costs no more than others."""
    least = F.min(F.struct(*row_id)).alias("_first")
    firsts = (
        df.groupBy(*keys)
        .agg(least)
        .select(*[F.col(f"_first.{c}").alias(c) for c in row_id], F.lit(True).alias(flag))
    )
    return df.join(firsts, list(row_id), "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def _cut_points(df: DataFrame, keys: list[str], order: Column, rows: int) -> DataFrame | None:
    """Per hot key the sorted values at which it is cut, one in SAMPLES_PER_CUT of
    a sample by hash, so about one per `rows` rows."""
    hot = hot_keys(df, keys, rows)
    if hot is None:
        return None
    stride = max(1, rows // SAMPLES_PER_CUT)
    cuts = (
        df.select(*keys, order.alias("_order"))
        .filter(F.pmod(F.xxhash64("_order"), F.lit(stride)) == 0)
        .join(hot.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_order")).alias("_sample"))
        .select(*keys, F.expr(f"filter(_sample, (v, i) -> (i + 1) % {SAMPLES_PER_CUT} = 0)").alias("_cuts"))
        .filter(F.size("_cuts") > 0)
    )
    return materialize(cuts, "cuts")


def with_segments(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], rows: int | None = None
) -> DataFrame:
    """Add `_seg` (consecutive along `order` inside a key) and `_split` (whether
    the key was cut at all). Only rows equal in all of `order` share a place, so
    ties in its first column are cut like any others."""
    keys = list(keys)
    tuple_ = F.struct(*([order] if isinstance(order, str) else order))
    cuts = _cut_points(df, keys, tuple_, rows or hot_rows(df.sparkSession))
    if cuts is None:
        return df.withColumns({"_split": F.lit(False), "_seg": F.lit(0)})
    # steps of powers of two, from the greatest that the cuts hold
    steps = "transform(sequence(0, CAST(floor(log2(size(_cuts))) AS INT)), b -> CAST(power(2, floor(log2(size(_cuts))) - b) AS INT))"
    position = F.expr(
        f"aggregate({steps}, 0, (p, s) -> if(coalesce(get(_cuts, p + s - 1) <= _place, false), p + s, p))"
    )
    return (
        df.withColumn("_place", tuple_)
        .join(cuts, keys, "left")
        .withColumn("_split", F.col("_cuts").isNotNull().alias("_split", metadata={_SPLIT_MARK: True}))
        .withColumn("_seg", F.when(F.col("_split"), position).otherwise(F.lit(0)))
        .drop("_cuts", "_place")
    )


def _is_split(segmented: DataFrame) -> bool:
    """Whether `with_segments` cut any key: if not, it added the constant false."""
    return _SPLIT_MARK in segmented.schema["_split"].metadata


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))),
}


def running(
    segmented: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum / max / min / xor up to each row (the row itself included or
    not), in `order` inside each key, on a frame from `with_segments`. Over no
    value a sum and an xor are 0, a maximum and a minimum are null, whether or not
    a key is split. The totals carried into a segment are one row per segment of
    the split keys."""
    keys = list(keys)
    plain = not _is_split(segmented)
    inside = (
        Window.partitionBy(*keys, "_seg")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    if plain:
        return segmented.withColumns(
            {
                out: _COMBINE[kind][1](_COMBINE[kind][0](col).over(inside), F.lit(None))
                for out, (kind, col) in measures.items()
            }
        )
    before = (
        Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        segmented.filter("_split")
        .groupBy(*keys, "_seg")
        .agg(*[_COMBINE[kind][0](col).alias(f"_t_{out}") for out, (kind, col) in measures.items()])
    )
    carried = totals.select(
        *keys,
        "_seg",
        *[
            _COMBINE[kind][0](F.col(f"_t_{out}")).over(before).alias(f"_c_{out}")
            for out, (kind, _) in measures.items()
        ],
    )
    result = segmented.withColumns(
        {f"_w_{out}": _COMBINE[kind][0](col).over(inside) for out, (kind, col) in measures.items()}
    ).join(carried, [*keys, "_seg"], "left")
    return result.withColumns(
        {
            out: _COMBINE[kind][1](F.col(f"_w_{out}"), F.col(f"_c_{out}"))
            for out, (kind, _) in measures.items()
        }
    ).drop(*[f"_w_{out}" for out in measures], *[f"_c_{out}" for out in measures])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    rows: int | None = None,
) -> DataFrame:
    """1-based position of each row in its key; no keys means in all rows."""
    if not keys:
        # one key for all rows, kept as an expression so that joins on it stay equi-joins
        whole = df.withColumn("_all", F.pmod(F.xxhash64(order[0]), F.lit(1)))
        return with_position(whole, ["_all"], order, out, rows).drop("_all")
    segmented = with_segments(df, keys, order, rows)
    return running(segmented, keys, order, {out: ("sum", F.lit(1).cast("long"))}).drop(
        "_seg", "_split"
    )


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    value: Column,
    out: str,
    rows: int | None = None,
) -> DataFrame:
    """`value` of the last `size` rows up to and including each row, as an array
    that keeps nulls."""
    kept = {out: F.collect_list(F.struct(value.alias("_v")))}
    return over_trailing(df, keys, order, size, kept, 0, rows).withColumn(out, F.col(out)["_v"])


def over_trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    aggregates: dict[str, Column],
    last: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """`aggregates` over the rows from `size - 1` before each row to `last` (0 for
    the row itself, -1 for the one before it).

    For split keys the last `size - 1` rows before a segment are copied into it,
    so its first rows see their full frame; the copies are dropped afterwards."""
    keys = list(keys)
    columns = df.columns
    segmented = with_segments(df, keys, order, rows)
    if not _is_split(segmented):
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, last)
        return df.select("*", *(column.over(frame).alias(out) for out, column in aggregates.items()))

    sizes = segmented.filter("_split").groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy(*keys).orderBy("_seg")
    ends = sizes.withColumn("_end", F.sum("_m").over(upto))
    later = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(1, size - 1)
    # every segment holds a row, so at most size - 1 later ones can reach back here
    ends = ends.withColumn(
        "_next", F.collect_list(F.struct("_seg", (F.col("_end") - F.col("_m")).alias("start"))).over(later)
    ).drop("_m")
    backwards = Window.partitionBy(*keys, "_seg").orderBy(*[F.desc(c) for c in order])
    copies = (
        segmented.filter("_split")
        .withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") < size)
        .join(ends, [*keys, "_seg"])
        .withColumn(
            "_to",
            F.explode(
                F.expr(f"filter(_next, s -> s.start - _end + _back - 1 <= {size - 2})")
            ),
        )
        .select(*columns, F.col("_to._seg").alias("_seg"), F.lit(True).alias("_copy"))
    )
    frame = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(1 - size, last)
    return (
        segmented.select(*columns, "_seg", F.lit(False).alias("_copy"))
        .unionByName(copies)
        .select("*", *(column.over(frame).alias(out) for out, column in aggregates.items()))
        .filter(~F.col("_copy"))
        .drop("_seg", "_copy")
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    rows: int | None = None,
) -> DataFrame:
    """`lag(value)` inside each key."""
    pair = trailing(df, keys, order, 2, F.col(value), "_pair", rows)
    return pair.withColumn(out, F.when(F.size("_pair") == 2, F.element_at("_pair", 1))).drop("_pair")
