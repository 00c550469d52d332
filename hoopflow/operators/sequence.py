"""Ordered operators: carry-forward, differences, runs, sessions, interpolation.

Everything is built from ``scan``, one pass of running windows per group. A group that
may be huge is first cut into blocks by ``split_hot``: bounds are quantiles of the whole
order tuple, from a mergeable sketch per key, so ties in the leading columns and outliers
don't matter. Windows then run per (group, block); the rows at block edges give the
totals that are carried over and joined back. Results are identical with and without the
cut, so a key that holds a third of the table spreads over many tasks. The input of a chain
is read twice, for the sketch and for the blocks; each scan goes on from what the one
before stored. Where no group is hot, scans are plain windows.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from hoopflow.session import cut_lineage

BLOCK, BLOCKS = "_block", "_blocks"
HOT_ROWS = 2_000_000
#: Block edges up to this number are joined by broadcast; more are left to a sorted join.
BROADCAST_BLOCKS = 100_000
#: Sketch: sampled tuples a block, parts whose samples are gathered apart, tuples kept of a part, most blocks of a key.
SAMPLES, PARTS, KEEP, MAX_BLOCKS, FAN = 512, 1024, 64, 1024, 32


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


@dataclass(frozen=True)
class Seq:
    """Grouping and total ascending order of a sequence; ``blocks`` is their number over all keys if it is cut."""

    by: tuple
    order: tuple
    blocks: int = 0

    @property
    def split(self) -> bool:
        return self.blocks > 0

    @property
    def keys(self) -> list[str]:
        return [*self.by, BLOCK] if self.split else list(self.by)

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*[_c(o).asc() for o in self.order])

    @property
    def reverse(self):
        return Window.partitionBy(*self.keys).orderBy(*[_c(o).desc() for o in self.order])

    @property
    def point(self) -> Column:
        return F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(self.order)])


def seq(by: Sequence[str], order: Sequence) -> Seq:
    return Seq(tuple(by), tuple(order))


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Left join on keys that may be NULL; the right side, with one row a key, is broadcast only if ``small``."""
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return left.join(F.broadcast(r) if small else r, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def hot_bounds(df: DataFrame, s: Seq, hot_rows: int, samples: int = SAMPLES) -> DataFrame:
    """(keys, _blocks, _bounds) of every key above ``hot_rows`` rows: where to cut it into equal blocks.

    The sketch of a key is a sample of its order tuples. A tuple is in it by its hash, about ``samples`` a block, and
    belongs to one of ``PARTS`` parts; of each part the ``KEEP`` smallest hashes stay. Two sketches merge by taking
    both and keeping the smallest again, and a part's sample is gathered apart, so no buffer
    holds more than a ``PARTS``-th of a key's sample.
    """
    keys = list(s.by)
    h = F.xxhash64(*keys, s.point)
    space = 1 << 24
    taken = F.pmod(h, F.lit(space)) < max(1, int(space * min(1.0, samples / hot_rows)))
    part = F.when(taken, F.pmod(F.shiftright(h, 24), F.lit(PARTS))).otherwise(F.lit(-1)).cast("long")
    order = F.xxhash64(s.point, F.lit(7))
    rows = df.select(*keys, part.alias("_part"), F.when(taken, F.struct(order.alias("h"), s.point.alias("p"))).alias("_x"))
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.slice(F.sort_array(F.collect_list("_x")), 1, KEEP).alias("_x"))
    merged = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.array_sort(F.transform(F.flatten(F.collect_list("_x")), lambda x: x["p"])).alias("_p"))
    hot = merged.where((F.col("_n") > hot_rows) & (F.size("_p") > 1))
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("_n") / hot_rows)).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.col("_want") - 1), lambda i: F.get(F.col("_p"), F.floor(i * F.size("_p") / F.col("_want")).cast("int")))
    return (hot.withColumn("_want", F.greatest(blocks, F.lit(2))).withColumn("_bounds", F.array_distinct(cut))
            .select(*keys, (F.size("_bounds") + 1).alias(BLOCKS), "_bounds"))


def split_hot(df: DataFrame, s: Seq, hot_rows: int = HOT_ROWS, broadcast_blocks: int = BROADCAST_BLOCKS) -> tuple[DataFrame, Seq]:
    """Cut groups above ``hot_rows`` rows into blocks of about equal size; without any, ``df`` and ``s`` as they are."""
    bounds = cut_lineage(hot_bounds(df, s, hot_rows))
    total = bounds.agg(F.sum(BLOCKS)).first()[0]
    if not total:
        return df, s
    keys = list(s.by)
    small = total <= broadcast_blocks
    d = df.withColumn("_point", s.point)
    if small:
        d = _join_keys(d, bounds, keys, True)
    else:
        # A hot key's rows meet copies of its bounds in several tasks.
        salted = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
        d = d.withColumn("_salt", F.pmod(F.xxhash64("_point"), F.lit(FAN)).cast("int"))
        d = _join_keys(d, salted, [*keys, "_salt"], False).drop("_salt")
    # Bounds at or below the row's tuple are counted in two steps, by every FAN-th one and then inside its run.
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("_point")))
    coarse = F.filter("_bounds", lambda b, i: (i + 1) % FAN == 0)
    d = d.withColumn("_run", below(coarse) * FAN)
    block = F.col("_run") + below(F.slice("_bounds", F.col("_run") + 1, F.lit(FAN)))
    d = d.withColumns({BLOCK: F.coalesce(F.when(F.col("_bounds").isNotNull(), block), F.lit(0)), BLOCKS: F.coalesce(BLOCKS, F.lit(1))})
    return cut_lineage(d.drop("_point", "_bounds", "_run")), Seq(s.by, s.order, int(total))


def unsplit(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK, BLOCKS)


def scan(df: DataFrame, s: Seq, *, lag: dict | None = None, lead: dict | None = None,
         ffill: dict | None = None, before: dict | None = None, bfill: dict | None = None,
         after: dict | None = None, total: dict | None = None, peak: dict | None = None,
         index: str | None = None) -> DataFrame:
    """Add running columns (name -> expression) to ``df``.

    lag / lead: value of the adjacent row. ffill / bfill: last / next non-null value,
    this row included. before / after: the same, this row excluded. total / peak:
    running sum / max, this row included. index: 1-based position in the group.
    """
    lag, lead, ffill, before = lag or {}, lead or {}, ffill or {}, before or {}
    bfill, after, total, peak = bfill or {}, after or {}, total or {}, peak or {}
    w, rw = s.window, s.reverse
    upto, prior = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    cols: dict[str, Column] = {}
    for n, e in lag.items():
        cols[n] = F.lag(_c(e)).over(w)
    for n, e in ffill.items():
        cols[n] = F.last(_c(e), True).over(w.rowsBetween(*upto))
    for n, e in before.items():
        cols[n] = F.last(_c(e), True).over(w.rowsBetween(*prior))
    for n, e in total.items():
        cols[n] = F.sum(_c(e)).over(w.rowsBetween(*upto))
    for n, e in peak.items():
        cols[n] = F.max(_c(e)).over(w.rowsBetween(*upto))
    if index:
        cols[index] = F.row_number().over(w).cast("long")
    # Backward looks run on the reversed order: a frame that ends at "unbounded following"
    # would be re-evaluated for every row.
    for n, e in lead.items():
        cols[n] = F.lead(_c(e)).over(w)
    for n, e in bfill.items():
        cols[n] = F.last(_c(e), True).over(rw.rowsBetween(*upto))
    for n, e in after.items():
        cols[n] = F.last(_c(e), True).over(rw.rowsBetween(*prior))
    if not s.split:
        return df.withColumns(cols)

    # What a block's last row hands to later blocks, and its first row to earlier ones. Running columns of the row
    # already hold the block's totals; the others carry the row's own value.
    ahead = {n: F.struct(_c(e).alias("v")) for n, e in lag.items()} | {n: _c(e) for n, e in before.items()}
    back = {n: F.struct(_c(e).alias("v")) for n, e in lead.items()} | {n: _c(e) for n, e in after.items()}
    own = {f"_own{i}": e for i, e in enumerate([*ahead.values(), *back.values()])}
    name = dict(zip([*ahead, *back], own))
    forward = [*lag, *ffill, *before, *total, *peak, *([index] if index else [])]
    backward = [*lead, *bfill, *after]
    flags = {}
    if forward:
        flags["_last"] = F.lead(F.lit(1)).over(w).isNull()
    if backward or lag:
        flags["_first"] = F.lag(F.lit(1)).over(w).isNull()
    if lead and "_last" not in flags:
        flags["_last"] = F.lead(F.lit(1)).over(w).isNull()
    local = cut_lineage(df.withColumns({**cols, **own, **flags}))
    small = s.blocks <= BROADCAST_BLOCKS
    out = local

    def edge(n: str) -> Column:
        if n in before or n in after:
            return F.coalesce(F.col(name[n]), F.col(n))
        return F.col(name.get(n, n))

    for names, flag, direction in ((forward, "_last", F.col(BLOCK).asc()), (backward, "_first", F.col(BLOCK).desc())):
        if not names:
            continue
        rows = local.where((F.col(BLOCKS) > 1) & F.col(flag)).select(*s.by, BLOCK, *[edge(n).alias(f"_e_{n}") for n in names])
        bw = Window.partitionBy(*s.by).orderBy(direction).rowsBetween(*prior)
        carry = []
        for n in names:
            e = F.col(f"_e_{n}")
            fn = F.sum if n in total or n == index else F.max if n in peak else lambda v: F.last(v, True)
            carry.append(fn(e).over(bw).alias(f"_c_{n}"))
        out = _join_keys(out, rows.select(*s.by, BLOCK, *carry), [*s.by, BLOCK], small)
    fix: dict[str, Column] = {}
    for n in [*forward, *backward]:
        here, there = F.col(n), F.col(f"_c_{n}")
        if n in lag:
            fix[n] = F.when(F.col("_first"), there["v"]).otherwise(here)
        elif n in lead:
            fix[n] = F.when(F.col("_last"), there["v"]).otherwise(here)
        elif n in total:
            fix[n] = F.when(there.isNull(), here).when(here.isNull(), there).otherwise(here + there)
        elif n == index:
            fix[n] = here + F.coalesce(there, F.lit(0))
        elif n in peak:
            fix[n] = F.greatest(here, there)
        else:
            fix[n] = F.coalesce(here, there)
    return out.withColumns(fix).drop("_first", "_last", *own, *[f"_c_{n}" for n in fix])


def rolling(df: DataFrame, s: Seq, back: int, ahead: int, cols: dict, part_rows: int = 1_000_000) -> DataFrame:
    """Aggregates over the rows [-back, +ahead]; ``cols`` maps name -> fn(window).

    A split sequence is re-cut by exact position, and rows near an edge are copied to the
    neighbouring part, so every frame is complete.
    """
    if not s.split:
        w = s.window.rowsBetween(-back, ahead)
        return df.withColumns({n: fn(w) for n, fn in cols.items()})
    d = scan(df, s, index="_rn")
    home = F.floor((F.col("_rn") - 1) / part_rows)
    reach = F.array_distinct(F.array(
        home, F.floor((F.col("_rn") - 1 + back) / part_rows),
        F.greatest(F.lit(0), F.floor((F.col("_rn") - 1 - ahead) / part_rows))))
    d = d.withColumn("_home", home).withColumn("_part", F.explode(reach))
    w = Window.partitionBy(*s.by, "_part").orderBy("_rn").rowsBetween(-back, ahead)
    d = d.withColumns({n: fn(w) for n, fn in cols.items()})
    return d.where(F.col("_part") == F.col("_home")).drop("_rn", "_home", "_part")


def forward_fill(df, s: Seq, value: str, out: str) -> DataFrame:
    return scan(df, s, ffill={out: value})


def sessionize(df, s: Seq, value: str, jump: float, out: str) -> DataFrame:
    """Number segments; a new one starts when ``value`` rises by more than ``jump``."""
    d = scan(df, s, lag={"_prev": value})
    d = d.withColumn("_cut", F.coalesce((_c(value) - F.col("_prev") > jump).cast("long"), F.lit(0)))
    return scan(d, s, total={out: "_cut"}).drop("_prev", "_cut")


def finite_diff(df, s: Seq, value: str, dt: Column | None, out: str, clock: str | None = None,
                fallback: float = 1 / 25, min_dt: float = 1e-4) -> DataFrame:
    """Backward difference per second; the first row is 0, tiny steps use ``fallback``."""
    d = scan(df, s, lag={"_pv": F.struct(_c(value).alias("v"), _c(clock).alias("t"))})
    step = F.abs(_c(clock) - F.col("_pv.t")) if dt is None else dt
    rate = (_c(value) - F.col("_pv.v")) / F.when(step > min_dt, step).otherwise(fallback)
    return d.withColumn(out, F.when(F.col("_pv").isNull(), F.lit(0.0)).otherwise(rate)).drop("_pv")


def run_bounds(df, s: Seq, value, start: str, end: str, index: str) -> DataFrame:
    """Start and end position of the run of equal values (NULL counts as a value)."""
    v = F.struct(_c(value).alias("v"))
    d = scan(df, s, lag={"_pl": v}, lead={"_pn": v}, index=index)
    d = d.withColumns({
        "_s": F.when(F.col("_pl").isNull() | ~F.col("_pl.v").eqNullSafe(_c(value)), F.col(index)),
        "_e": F.when(F.col("_pn").isNull() | ~F.col("_pn.v").eqNullSafe(_c(value)), F.col(index))})
    return scan(d, s, ffill={start: "_s"}, bfill={end: "_e"}).drop("_pl", "_pn", "_s", "_e")


def min_hold(df, s: Seq, value: str, hold: int, out: str) -> DataFrame:
    """Blank out runs shorter than ``hold`` rows; neighbours are not merged again."""
    d = run_bounds(df, s, value, "_rs", "_re", "_ri")
    keep = F.col("_re") - F.col("_rs") + 1 >= hold
    return d.withColumn(out, F.when(keep, _c(value))).drop("_rs", "_re", "_ri")


def rolling_mode(df, s: Seq, value: str, span: int, out: str) -> DataFrame:
    """Most common non-null value within +-span rows; a tie goes to the earliest."""
    d = rolling(df, s, span, span, {"_near": lambda w: F.collect_list(_c(value)).over(w)})
    near = F.col("_near")
    # Longest match first, then first position: order by (-count, position).
    ranked = F.transform(F.array_distinct(near), lambda v: F.struct(
        (-F.size(F.filter(near, lambda x: x == v))).alias("c"),
        F.array_position(near, v).alias("p"), v.alias("v")))
    return d.withColumn(out, F.array_min(ranked)["v"]).drop("_near")


def linear_fill(df, s: Seq, values: Sequence[str], at: str, outs: Sequence[str]) -> DataFrame:
    """Linear fill of NULL gaps along ``at``; both ends hold the nearest value."""
    point = F.when(_c(values[0]).isNotNull(), F.struct(_c(at).alias("_at"), *[_c(v) for v in values]))
    d = scan(df, s, ffill={"_a": point}, bfill={"_b": point})
    a, b = F.col("_a"), F.col("_b")
    frac = (_c(at) - a["_at"]) / (b["_at"] - a["_at"])
    cols = {}
    for v, o in zip(values, outs):
        cols[o] = (F.when(_c(v).isNotNull(), _c(v)).when(a.isNull(), b[v]).when(b.isNull(), a[v])
                   .otherwise(a[v] + frac * (b[v] - a[v])))
    return d.withColumns(cols).drop("_a", "_b")


def until_first(df, s: Seq, flag, keep_flagged: bool = False) -> DataFrame:
    """Rows before the first flagged row of each group."""
    d = scan(df, s, total={"_hits": _c(flag).cast("long")})
    seen = F.col("_hits") - (_c(flag).cast("long") if keep_flagged else 0)
    return d.where(seen == 0).drop("_hits")


def every_nth(df, s: Seq, n: int) -> DataFrame:
    return scan(df, s, index="_i").where((F.col("_i") - 1) % n == 0).drop("_i")


def _folded(keys: list[str], step, names: list[str] | None):
    """Rows of one group after the other through ``step``; ``names`` are the columns given out, without them the last states."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def end() -> pd.DataFrame:
            return pd.DataFrame([(*current, marshal.dumps(state, 2))], columns=[*keys, "_out"])

        for pdf in batches:
            if pdf.empty:
                continue
            here, before = pdf[keys], pdf[keys].shift()
            change = ((here != before) & ~(here.isna() & before.isna())).any(axis=1).to_numpy()
            change[0] = True
            cuts = [*change.nonzero()[0], len(pdf)]
            parts = []
            for lo, hi in zip(cuts, cuts[1:]):
                chunk = pdf.iloc[lo:hi]
                key = tuple(None if pd.isna(v) else v for v in chunk[keys].iloc[0])
                if key != current:
                    if names is None and current is not None:
                        parts.append(end())
                    given = chunk["_in"].iloc[0] if "_in" in chunk else None
                    current, state = key, None if given is None else marshal.loads(given)
                state, res = step(state, chunk)
                if names is not None and res is not None and len(res):
                    parts.append(res[names])
            if parts:
                yield pd.concat(parts, ignore_index=True)
        if names is None and current is not None:
            yield end()

    return run


def carried_state(df: DataFrame, by: Sequence[str], order: Sequence[str], step, schema: str) -> DataFrame:
    """Run a truly sequential state machine with constant memory.

    Rows are hash-partitioned by ``by`` and sorted on disk; each task then streams Arrow
    batches and carries one state per open group, so no group is ever held in memory.
    ``step(state, batch) -> (state, result)`` sees consecutive rows of one group.
    """
    keys = list(by)
    names = StructType.fromDDL(schema).names
    return (df.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(_folded(keys, step, names), schema=schema))


def carried_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], step, schema: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Seq]:
    """``carried_state`` where groups above ``hot_rows`` run as blocks in parallel; the result, and its sequence for scans.

    A block starts from a guess of the state that the block before hands over: none at first. All hand-overs are then
    compared, and only blocks that were given another state run again, until none changes. Then every block had
    the state that a single pass would give it, as the first one has none. A state machine that forgets its start
    within a block settles after the second round; one that never does takes a round a block. States are plain
    Python values.
    """
    s = seq(by, order)
    d, s = split_hot(df, s, hot_rows)
    if not s.split:
        return carried_state(df, by, order, step, schema), s
    keys = s.keys
    small = s.blocks <= BROADCAST_BLOCKS
    d = cut_lineage(d.repartition(*keys).sortWithinPartitions(*keys, *order))
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    cut = d.where(F.col(BLOCKS) > 1)
    ends_schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _out binary"
    before = Window.partitionBy(*s.by).orderBy(BLOCK)

    def run(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(_folded(keys, step, None), ends_schema)

    ends = cut_lineage(run(cut).withColumn("_in", F.lit(None).cast("binary")))
    while True:
        given = ends.withColumn("_new", F.lag("_out").over(before))
        stale = cut_lineage(given.where(~F.col("_in").eqNullSafe(F.col("_new"))).select(*keys, F.col("_new").alias("_in")))
        if stale.isEmpty():
            break
        again = run(_join_keys(cut, stale.withColumn("_stale", F.lit(True)), keys, small).where("_stale").drop("_stale"))
        fresh = _join_keys(again.withColumnRenamed("_out", "_fresh"), stale, keys, small).withColumnRenamed("_in", "_given").withColumn("_ran", F.lit(True))
        ends = cut_lineage(_join_keys(ends, fresh, keys, small).select(
            *keys, F.when(F.col("_ran"), F.col("_fresh")).otherwise(F.col("_out")).alias("_out"), F.when(F.col("_ran"), F.col("_given")).otherwise(F.col("_in")).alias("_in")))
    rows = _join_keys(d, ends.select(*keys, "_in"), keys, small)
    out = f"{schema}, {BLOCK} {types[BLOCK]}, {BLOCKS} {types[BLOCKS]}"
    names = StructType.fromDDL(out).names
    # The hash of the keys already is the partitioning of ``d``; only a sorted join deals the rows anew.
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(_folded(keys, step, names), out), s
