"""Operators over detections, keypoints, homographies and tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from hoopflow import fixed as K
from hoopflow.session import cut_lineage
from hoopflow.functions import geometry as G
from hoopflow.operators import aggregates as AG, joins as J, sequence as Q


def landmark_array() -> Column:
    """The fixed landmark list as a literal array, so no join is needed to use it."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("court_x"), F.lit(y).alias("court_y"))
                     for n, (x, y) in K.LANDMARKS.items()])


def place_landmarks(frames: DataFrame, h_court_to_px: str, img_w: int, img_h: int, margin: float) -> DataFrame:
    """Every landmark of every frame in pixels, with a visibility flag."""
    d = frames.withColumn("_lm", F.explode(landmark_array()))
    px, py = G.project(h_court_to_px, F.col("_lm.court_x"), F.col("_lm.court_y"))
    d = d.withColumns({"name": F.col("_lm.name"), "court_x": F.col("_lm.court_x"),
                       "court_y": F.col("_lm.court_y"), "px": px, "py": py}).drop("_lm")
    inside = ((F.col("px") >= -margin) & (F.col("px") < img_w + margin)
              & (F.col("py") >= -margin) & (F.col("py") < img_h + margin))
    return d.withColumn("visible", F.coalesce(inside, F.lit(False)))


def _sorted_quantile(a: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    pos = (F.size(a) - 1) * F.lit(q)
    lo = F.floor(pos).cast("int")
    lo_v = F.get(a, lo)
    hi_v = F.get(a, F.least(lo + 1, F.size(a) - 1))
    return F.when(F.size(a) > 0, lo_v + (hi_v - lo_v) * (pos - lo))


def plausible(frames: DataFrame, img_w: int, img_h: int, h: str = "h", lo: float = 8.0, hi: float = 150.0,
              ratio: float = 12.0, min_visible: int = 6) -> DataFrame:
    """Is a homography's scale that of a camera on a court? Row-local: 60 grid points."""
    grid = F.array(*[F.struct(F.lit(2.0 + 10 * i).alias("x"), F.lit(2.0 + 9.2 * j).alias("y"))
                     for i in range(10) for j in range(6)])

    def scale(p):
        ax, ay = G.project("_hi", p["x"], p["y"])
        bx, by = G.project("_hi", p["x"] + 5, p["y"])
        seen = (ax >= 0) & (ax < img_w) & (ay >= 0) & (ay < img_h)
        return F.when(seen, G.dist(bx, by, ax, ay) / 5)

    d = (frames.withColumn("_hi", G.invert_h(h))
         .withColumn("_s", F.array_sort(F.filter(F.transform(grid, scale), lambda v: v > 0))))
    s = F.col("_s")
    med = _sorted_quantile(s, 0.5)
    ok = ((F.size(s) >= min_visible) & med.between(lo, hi)
          & (_sorted_quantile(s, 0.95) / _sorted_quantile(s, 0.05) <= ratio))
    return (d.withColumns({"n_visible": F.greatest(F.size(s), F.lit(0)).cast("long"), "median_px_per_ft": med,
                           "plausible": F.coalesce(ok, F.lit(False))}).drop("_hi", "_s"))


def action_target(df: DataFrame, action: str, hx: str, hy: str, tx: str, ty: str, h_court_to_px: str) -> DataFrame:
    """Adds ``to_x, to_y``: the target player, the nearer rim, or nothing for a reset."""
    lx, ly = G.project(h_court_to_px, *map(F.lit, K.RIM))
    rx, ry = G.project(h_court_to_px, *map(F.lit, K.RIM_FAR))
    d = df.withColumns({"_lx": lx, "_ly": ly, "_rx": rx, "_ry": ry})
    d = d.withColumn("_left", G.dist("_lx", "_ly", hx, hy) <= G.dist("_rx", "_ry", hx, hy))
    to_player = F.col(action).isin("PASS_TO", "SCREEN_WITH")
    to_rim = F.col(action).isin("DRIVE", "SHOOT")
    end = lambda t, a, b: (F.when(to_player, F.col(t))
                           .when(to_rim, F.when(F.col("_left"), F.col(a)).otherwise(F.col(b))))
    return (d.withColumns({"to_x": end(tx, "_lx", "_rx"), "to_y": end(ty, "_ly", "_ry")})
            .drop("_lx", "_ly", "_rx", "_ry", "_left"))


def cut_distance(df: DataFrame, by: list[str], order: list[str], hist: str, out: str = "dist") -> DataFrame:
    """Histogram distance to the previous frame; NULL on the first."""
    d = Q.scan(df, Q.seq(by, order), lag={"_ph": hist})
    return d.withColumn(out, F.when(F.col("_ph").isNotNull(), G.hist_distance("_ph", hist))).drop("_ph")


def recommendation_at(pauses: DataFrame, recs: DataFrame, by: list[str], t: str, rec_id: str,
                      snap: float = K.SNAP_SECONDS, hot_rows: int | None = Q.HOT_ROWS) -> DataFrame:
    """The recommendation to show at a pause: the nearest that has actions within the snap
    window, else the nearest gated one within it, else none."""
    shown = F.when(F.col("has_actions"), F.col(rec_id))
    d = J.around(pauses, recs, by, t, t, {"shown": shown, "any": F.col(rec_id)}, [rec_id], hot_rows)
    a, b = J.nearest_of(t, "shown", snap), J.nearest_of(t, "any", snap)
    d = d.withColumns({"_a": a, "_b": b})
    return d.withColumns({rec_id: F.coalesce("_a.v", "_b.v"),
                          "has_actions": F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), F.col("_a").isNotNull())}
                         ).drop("_a", "_b", "prev_shown", "next_shown", "prev_any", "next_any")


def contiguous_velocity(df: DataFrame, by: list[str], frame: str, x: str, y: str, dt: float) -> DataFrame:
    """Velocity only where the track was also seen in the previous frame."""
    d = Q.scan(df, Q.seq(by, [frame]), lag={"_p": F.struct(F.col(frame).alias("f"), F.col(x).alias("x"), F.col(y).alias("y"))})
    near = F.col(frame) - F.col("_p.f") == 1
    return d.withColumns({"vx": F.when(near, (F.col(x) - F.col("_p.x")) / dt), "vy": F.when(near, (F.col(y) - F.col("_p.y")) / dt)}).drop("_p")


# Fixed values of the shot-clock reader check: reset targets, tolerance, highest value a
# reset may start from, slack up and drop down per frame.
CLOCK_RESETS, CLOCK_TOL, CLOCK_FROM, CLOCK_UP, CLOCK_DROP = (24.0, 14.0), 1.5, 8.0, 0.5, 2.0


def clock_accepts(last: float | None, r: float, dt: float) -> bool:
    if last is None:
        return True
    if last <= CLOCK_FROM and r > last and any(abs(r - t) <= CLOCK_TOL for t in CLOCK_RESETS):
        return True
    return last - dt - CLOCK_DROP <= r <= last + CLOCK_UP


def validate_clock(frames: DataFrame, by: list[str] = ("clip_id",), frame: str = "frame_idx", read: str = "clock_read",
                   dt: float = 0.2, out: str = "clock", hot_rows: int = Q.HOT_ROWS) -> DataFrame:
    """Drop impossible clock readings, then fill the gaps linearly with held ends.

    What is accepted depends on the last accepted value, so this is a carried state, which one
    reading accepted either way settles; the fill is a window pass again.
    """
    by = list(by)
    cols = frames.columns

    def step(last, batch):
        kept = []
        for r in batch[read]:
            good = r == r and r is not None and clock_accepts(last, r, dt)
            kept.append(r if good else None)
            last = r if good else last
        return last, batch.assign(_ok=pd.array(kept, dtype="Float64"))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    d, s = Q.carried_blocks(frames, by, [frame], step, f"{types}, _ok double", hot_rows)
    return Q.linear_fill(d, s, ["_ok"], frame, [out]).select(*cols, out)


# Fixed values of the ball tracker: share of the old velocity kept, share of the detection
# in the position, and the damping of the velocity while coasting.
VEL_KEEP, POS_DET, COAST = 0.4, 0.85, 0.7


def ball_step(state, det):
    """One frame of the constant-velocity tracker; state is (x, y, vx, vy, missed)."""
    if state is None:
        return None if det is None else (det[0], det[1], 0.0, 0.0, 0)
    x, y, vx, vy, missed = state
    px, py = x + vx, y + vy
    if det is not None and (math.hypot(det[0] - px, det[1] - py) <= K.BALL_GATE_PX or missed >= K.BALL_REACQUIRE):
        return (POS_DET * det[0] + (1 - POS_DET) * px, POS_DET * det[1] + (1 - POS_DET) * py,
                VEL_KEEP * vx + (1 - VEL_KEEP) * (det[0] - x), VEL_KEEP * vy + (1 - VEL_KEEP) * (det[1] - y), 0)
    return px, py, vx * COAST, vy * COAST, missed + 1


def track_ball(frames: DataFrame, by: list[str], frame: str, x: str, y: str, hot_rows: int = Q.HOT_ROWS) -> DataFrame:
    """Smoothed, gap-free ball path: outliers are gated, gaps coast, a leading gap is held.

    Every accepted detection leaves a fixed small share of the path before it, so a start is forgotten to
    the last digit within some dozens of frames.
    """
    def step(state, batch):
        xs, ys = [], []
        for a, b in zip(batch[x], batch[y]):
            state = ball_step(state, None if a is None or a != a else (a, b))
            xs.append(None if state is None else state[0])
            ys.append(None if state is None else state[1])
        return state, batch.assign(_bx=pd.array(xs, dtype="Float64"), _by=pd.array(ys, dtype="Float64"))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    d, s = Q.carried_blocks(frames, by, [frame], step, f"{types}, _bx double, _by double", hot_rows)
    d = Q.scan(d, s, bfill={"_f": F.when(F.col("_bx").isNotNull(), F.struct("_bx", "_by"))})
    return d.withColumns({"ball_x": F.coalesce("_bx", "_f._bx"), "ball_y": F.coalesce("_by", "_f._by")}).drop("_bx", "_by", "_f", Q.BLOCK, Q.BLOCKS)


def drift(df: DataFrame, s: Q.Seq, error: str, ends: str, hot_rows: int = Q.HOT_ROWS) -> DataFrame:
    """Median error of the first and second half of each group, and its first and last value."""
    by = list(s.by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min_by(ends, s.point).alias("first_v"), F.max_by(ends, s.point).alias("last_v"))
    d, sp = Q.split_hot(df, s, hot_rows)
    d = Q.unsplit(Q.scan(d, sp, index="_i")).join(n.select(*by, "n"), by)
    d = d.select(*by, (F.col("_i") <= F.floor(F.col("n") / 2)).alias("_early"), error)
    half = AG.quantiles(d, [*by, "_early"], error, {"_med": 0.5}, hot_rows)
    side = lambda c: G.r4(F.max(F.when(c, F.col("_med"))))
    half = half.groupBy(*by).agg(side(F.col("_early")).alias("first_half"), side(~F.col("_early")).alias("second_half"))
    return n.join(half, by, "left").select(*by, "n", "first_v", "last_v", "first_half", "second_half")


# Identity ------------------------------------------------------------------------
TRACK = ["clip_id", "track_id"]


def jersey_votes(points: DataFrame) -> DataFrame:
    """Voted jersey per track and the share of its detections that agree."""
    size = points.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_len"), F.first("team_label").alias("team_label"))
    vote = J.ordered_vote(points, TRACK, "jersey_read", F.col("frame_idx"), "jersey")
    return (size.join(vote, TRACK, "left")
            .withColumn("agreement", F.coalesce(F.col("jersey_n") / F.col("_len"), F.lit(0.0))).drop("_len", "jersey_n"))


def jersey_sets(votes: DataFrame) -> DataFrame:
    """Distinct voted jerseys per cluster: at most one per track of the clip."""
    return votes.where("jersey IS NOT NULL").groupBy("clip_id", "team_label").agg(F.array_sort(F.collect_set("jersey")).alias("jerseys"))


def jersey_hits(sets: DataFrame, roster: DataFrame) -> DataFrame:
    """How many jerseys of a cluster each team of the roster has; teams without one are absent."""
    known = roster.where("jersey IS NOT NULL").select("team_id", "jersey").distinct()
    seen = sets.select("clip_id", "team_label", F.explode("jerseys").alias("jersey"))
    return seen.join(known, "jersey").groupBy("clip_id", "team_label", "team_id").agg(F.count(F.lit(1)).alias("hits"))


def cluster_teams(sets: DataFrame, roster: DataFrame) -> DataFrame:
    """Map the two clusters of a clip to two different teams by jersey overlap; a tie goes to the smaller ids.

    Any number of teams. The best pair is among the two best teams of each cluster, where the
    two smallest ids stand for all teams without an overlap. With fewer than two teams both stay NULL.
    """
    pair = roster.where("jersey IS NOT NULL").select("team_id").distinct().orderBy("team_id").limit(2)
    smallest = pair.groupBy().agg(F.collect_list("team_id").alias("_ids"))
    labels = F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1)]))
    none = (sets.select("clip_id").distinct().withColumn("team_label", labels).join(F.broadcast(smallest))
            .select("clip_id", "team_label", F.explode("_ids").alias("team_id"), F.lit(0).cast("long").alias("hits")))
    hits = (jersey_hits(sets, roster).where("team_label IN (0, 1)").unionByName(none)
            .groupBy("clip_id", "team_label", "team_id").agg(F.sum("hits").alias("hits")))
    w = Window.partitionBy("clip_id", "team_label").orderBy(F.col("hits").desc(), "team_id")
    best = hits.withColumn("_rk", F.row_number().over(w)).where("_rk <= 2")
    of = lambda k: F.collect_list(F.when(F.col("team_label") == k, F.struct("hits", "team_id"))).alias(f"t{k}")
    c = sets.select("clip_id").distinct().join(best.groupBy("clip_id").agg(of(0), of(1)), "clip_id", "left")
    pairs = F.flatten(F.transform("t0", lambda a: F.transform("t1", lambda b: F.struct(
        (-a["hits"] - b["hits"]).alias("n"), a["team_id"].alias("a"), b["team_id"].alias("b")))))
    c = c.select("clip_id", F.get(F.array_sort(F.filter(pairs, lambda p: p["a"] != p["b"])), F.lit(0)).alias("p"))
    return (c.withColumn("team_label", labels)
            .select("clip_id", "team_label", F.when(F.col("team_label") == 0, F.col("p.a")).otherwise(F.col("p.b")).alias("team_id")))


def identities(points: DataFrame, roster: DataFrame) -> DataFrame:
    """Track -> player by (team of its cluster, voted jersey); unsure ones stay NULL."""
    votes = jersey_votes(points)
    teams = cluster_teams(jersey_sets(votes), roster)
    known = roster.where("jersey IS NOT NULL").select("team_id", "jersey", "player_id")
    d = votes.join(teams, ["clip_id", "team_label"], "left").join(known, ["team_id", "jersey"], "left")
    conf = F.when(F.col("player_id").isNotNull(), F.col("agreement")).otherwise(F.least(F.col("agreement"), F.lit(0.3)))
    return d.select(*TRACK, "team_label", "team_id", "jersey", "player_id", G.rnd(conf, 3).alias("confidence"))


def true_ids(points: DataFrame, value: str, out: str) -> DataFrame:
    return J.ordered_vote(points, TRACK, value, F.col("frame_idx"), out).select(*TRACK, out)


def weighted_jersey(points: DataFrame, top: int = 5, need: float = 1.0) -> DataFrame:
    """Confidence-weighted vote over a track's largest boxes; weak winners abstain."""
    w = Window.partitionBy(*TRACK).orderBy((F.col("y2") - F.col("y1")).desc(), "frame_idx")
    big = points.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= top)
    v = J.ordered_vote(big, TRACK, "jersey_read", F.col("_rk"), "jersey", F.col("conf"))
    return v.where(F.col("jersey_n") >= need).withColumnRenamed("jersey_n", "weight")


def on_floor_tracks(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Tracks present in a quarter of the clip whose median position is inside the lines."""
    n = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_frames"))
    t = points.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("mx"), F.median("y").alias("my"))
    return (t.join(n, "clip_id").where((F.col("n") / F.col("_frames") >= K.PRESENCE) & G.on_court("mx", "my", 3.0)
                                       & F.col("my").between(K.INSET, K.WIDTH - K.INSET)).select(*TRACK, "n", "mx", "my"))


def roster_override(players: DataFrame, link: DataFrame) -> DataFrame:
    """Relabel clusters of a frame with roster teams by the jerseys read in them.

    ``players``: clip_id, frame_idx, track_id, team_id, jersey; ``link``: jersey, team.
    Clusters without evidence take, one after the other, the teams no cluster took.
    """
    fr = ["clip_id", "frame_idx"]
    j = players.join(link.select("jersey", F.col("team").alias("_rt")), "jersey", "left")
    votes = J.ordered_vote(j, [*fr, "team_id"], "_rt", F.col("track_id"), "_won").drop("_won_n")
    clusters = players.select(*fr, "team_id").distinct().join(votes, [*fr, "team_id"], "left")
    w = Window.partitionBy(*fr)
    teams = link.groupBy().agg(F.array_sort(F.collect_set("team")).alias("_teams"))
    c = clusters.withColumn("_used", F.collect_set("_won").over(w)).join(F.broadcast(teams))
    # The n-th cluster without evidence takes the n-th team that is left.
    nth = F.count(F.when(F.col("_won").isNull(), 1)).over(w.orderBy("team_id"))
    c = c.withColumn("_nth", nth.cast("int"))
    left = F.get(F.array_except("_teams", "_used"), F.col("_nth") - 1)
    c = c.select(*fr, "team_id", F.when(F.size("_used") == 0, F.col("team_id").cast("string"))
                 .otherwise(F.coalesce("_won", left, F.get("_teams", F.lit(0)))).alias("team"))
    return players.join(c, [*fr, "team_id"])


# Homography ----------------------------------------------------------------------
def _fit(p):
    """Least-squares maps (normalised linear systems) from pixels to the court; ``p`` is (frames, landmarks, 4)."""
    def norm(q):
        c = q.mean(1)
        s = math.sqrt(2) / np.maximum(np.hypot(*(q - c[:, None]).transpose(2, 0, 1)).mean(1), 1e-9)
        t = np.zeros((len(q), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2] = -s[:, None] * c
        t[:, 2, 2] = 1
        return t, (q - c[:, None]) * s[:, None, None]
    (tp, uv), (tc, xy) = norm(p[..., :2]), norm(p[..., 2:])
    (u, v), (x, y) = uv.transpose(2, 0, 1), xy.transpose(2, 0, 1)
    z, o = np.zeros_like(u), np.ones_like(u)
    rows = np.concatenate([np.stack([u, v, o, z, z, z, -x * u, -x * v, -x], 2), np.stack([z, z, z, u, v, o, -y * u, -y * v, -y], 2)], 1)
    h = np.linalg.inv(tc) @ np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3) @ tp
    w = h[:, 2:, 2:]
    return h / np.where(np.abs(w) > 1e-12, w, 1.0)


def _residual(h, p):
    """Court error of every landmark under its frame's map."""
    q = np.concatenate([p[..., :2], np.ones((*p.shape[:2], 1))], 2) @ h.transpose(0, 2, 1)
    return np.hypot(q[..., 0] / q[..., 2] - p[..., 2], q[..., 1] / q[..., 2] - p[..., 3])


def _robust(p, inlier_ft):
    """Maps of frames with equally many landmarks, all solved together: map, median error, landmarks that agree.

    While a landmark of a frame disagrees, the one whose absence helps most is dropped: the trials of all such
    frames are one stack, so there are at most as many steps as landmarks. At the end every landmark
    that agrees with the final map counts, also one dropped on the way.
    """
    m, n = p.shape[:2]
    h, med, used = np.empty((m, 3, 3)), np.empty(m), np.empty(m, np.int64)
    at, cur, fit = np.arange(m), p, _fit(p)
    while len(at):
        bad = (_residual(fit, cur).max(1) > inlier_ft) & (cur.shape[1] > 4)
        done = at[~bad]
        h[done] = fit[~bad]
        agrees = _residual(fit[~bad], p[done])
        agrees[agrees > inlier_ft] = np.nan
        count = (~np.isnan(agrees)).sum(1)
        few = count < 4
        med[done[~few]], used[done[~few]] = np.nanmedian(agrees[~few], 1), count[~few]
        med[done[few]], used[done[few]] = np.median(_residual(fit[~bad][few], cur[~bad][few]), 1), cur.shape[1]
        at, cur = at[bad], cur[bad]
        if not len(at):
            break
        k = cur.shape[1]
        others = np.array([[j for j in range(k) if j != i] for i in range(k)])
        trials = cur[:, others].reshape(-1, k - 1, 4)
        fits = _fit(trials)
        best = (_residual(fits, trials) ** 2).sum(1).reshape(-1, k).argmin(1) + np.arange(len(at)) * k
        cur, fit = trials[best], fits[best]
    return h, med, used


def fit_homographies(keypoints: DataFrame, by: list[str], conf_floor: float = 0.5, inlier_ft: float = 8.0, max_ft: float = 2.0) -> DataFrame:
    """Pixel -> court map per frame from at least four confident landmarks.

    Landmarks are nested per frame (a fixed list bounds them). An Arrow batch is solved in stacks of frames with
    equally many landmarks, so work in Python doesn't depend on the number of frames.
    """
    nested = (keypoints.where(F.col("conf") >= conf_floor).groupBy(*by)
              .agg(F.sort_array(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("px", "py", "court_x", "court_y")]))).alias("_pts")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_pts")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            first = np.cumsum(n) - n
            h, med, used = np.zeros((len(n), 9)), np.full(len(n), np.nan), n.astype(np.int64)
            for k in np.unique(n[n >= 4]):
                at = np.flatnonzero(n == k)
                maps, med[at], used[at] = _robust(flat[first[at][:, None] + np.arange(k)], inlier_ft)
                h[at] = maps.reshape(-1, 9)
            none = n < 4
            ok = ~none & (med <= max_ft) & (used >= 4)
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 9, pa.int32()), pa.array(h.ravel()), mask=pa.array(none))
            yield pa.record_batch([*[b.column(c) for c in by], maps, pa.array(med, mask=none), pa.array(used, pa.int32()), pa.array(ok)], names=[*by, "h", "median_ft", "n_points", "ok"])

    keys = ", ".join(f"`{c}` {nested.schema[c].dataType.simpleString()}" for c in by)
    return nested.mapInArrow(solve, f"{keys}, h array<double>, median_ft double, n_points int, ok boolean")


CORNERS = [(0.0, 0.0), (94.0, 0.0), (94.0, 50.0), (0.0, 50.0)]


def four_point_map(points: list[tuple[Column, Column]]) -> Column:
    """Pixel -> court map through the four court corners, given their pixels in the order of ``CORNERS``; NULL if three are in line.

    The map of the unit square onto a quadrilateral has a closed form; its columns are scaled to the court and it is inverted.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = points
    ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    det = ax * by - bx * ay
    g, h = (sx * by - bx * sy) / det, (ax * sy - sx * ay) / det
    court = F.array((x1 - x0 + g * x1) / K.LENGTH, (x3 - x0 + h * x3) / K.WIDTH, x0,
                    (y1 - y0 + g * y1) / K.LENGTH, (y3 - y0 + h * y3) / K.WIDTH, y0, g / K.LENGTH, h / K.WIDTH, F.lit(1.0))
    return F.when(F.abs(det) > 1e-12, court)


def smooth_corners(fits: DataFrame, by: list[str], frame: str, window: int = 5, hold_first: bool = True) -> DataFrame:
    """Average the corners' pixels over the last valid frames and refit; gaps reuse the last.

    With ``hold_first``, frames before the first valid one keep their own map, else they have none.
    """
    valid = fits.where("ok").withColumn("_hi", G.invert_h("h"))
    px = {f"_c{i}{a}": v for i, (x, y) in enumerate(CORNERS) for a, v in zip("xy", G.project("_hi", F.lit(x), F.lit(y)))}
    valid = valid.withColumns(px)
    s = Q.seq(by, [frame])
    means = Q.rolling(valid, s, window - 1, 0, {c: (lambda w, c=c: F.avg(c).over(w)) for c in px})
    court = means.withColumn("_map", four_point_map([(F.col(f"_c{i}x"), F.col(f"_c{i}y")) for i in range(4)]))
    back = court.withColumn("_inv", G.invert_h("_map"))
    # Scaled so that the last entry is one, as fitted maps are.
    smooth = back.select(*by, frame, F.transform("_inv", lambda v: v / G.h_at("_inv", 8)).alias("_sm"))
    d = fits.join(smooth, [*by, frame], "left")
    d = Q.scan(d, s, ffill={"h_smooth": "_sm"})
    return (d.withColumn("h_smooth", F.coalesce("h_smooth", "h")) if hold_first else d).drop("_sm")


def pick_homography(model: DataFrame, calibration: DataFrame, by: list[str], img_w: int, img_h: int, min_points: int = 6, max_ft: float = 2.0) -> DataFrame:
    """Per frame: the model's map if it stands on its own, else the propagated one."""
    m = plausible(model, img_w, img_h)
    ok = (F.col("n_inliers") >= min_points) & (F.col("reproj_ft") <= max_ft) & F.col("plausible")
    d = m.withColumn("accepted", ok).join(calibration.select(*by, F.col("h").alias("_cal")), by, "left")
    return d.withColumns({"source": F.when(F.col("accepted"), "model").otherwise("calibration"),
                          "h": F.when(F.col("accepted"), F.col("h")).otherwise(F.col("_cal"))}).drop("_cal")


# Tracks and teams ------------------------------------------------------------------
def _greedy(state, xs, ys):
    """Match one frame's feet to live tracks; state is (next id, {id: [x, y, vx, vy, missed]})."""
    nxt, live = state if state else (0, {})
    ids, n = list(live), len(xs)
    got = [-1] * n
    if ids and n:
        t = np.array([live[i] for i in ids])
        cost = np.hypot(t[:, None, 0] + t[:, None, 2] - xs[None], t[:, None, 1] + t[:, None, 3] - ys[None])
        used = set()
        for flat in np.argsort(cost, axis=None, kind="stable"):
            a, b = divmod(int(flat), n)
            if cost[a, b] > K.TRACK_GATE_PX:
                break
            if a in used or got[b] >= 0:
                continue
            used.add(a)
            got[b] = ids[a]
    for b, i in enumerate(got):
        if i >= 0:
            x, y, vx, vy, _ = live[i]
            live[i] = [xs[b], ys[b], 0.5 * vx + 0.5 * (xs[b] - x), 0.5 * vy + 0.5 * (ys[b] - y), 0]
    for i in set(ids) - set(got):
        live[i][4] += 1
        if live[i][4] > K.TRACK_MISSED:
            del live[i]
    for b in range(n):
        if got[b] < 0:
            got[b], live[nxt] = nxt, [xs[b], ys[b], 0.0, 0.0, 0]
            nxt += 1
    return (nxt, live), got


def assign_tracks(dets: DataFrame, frames: DataFrame, hot_rows: int = Q.HOT_ROWS) -> DataFrame:
    """Track ids for player boxes: greedy nearest feet, restarted at every camera cut.

    One row per frame, streamed in order with only the live tracks as state; a camera shot
    is the unit, as ids never cross a cut.
    """
    cuts, s = Q.split_hot(frames.withColumn("_cut", F.col("cut").cast("long")), Q.seq(["clip_id"], ["frame_idx"]), hot_rows)
    shots = Q.scan(cuts, s, total={"shot": "_cut"}).select("clip_id", "frame_idx", "shot")
    foot = G.box_foot("x1", "y1", "x2", "y2")
    nested = (dets.where("cls = 'player'").groupBy("clip_id", "frame_idx")
              .agg(F.array_sort(F.collect_list(F.struct("det_no", foot[0].alias("x"), foot[1].alias("y")))).alias("d")))
    f = shots.join(nested, ["clip_id", "frame_idx"], "left").select(
        "clip_id", "shot", "frame_idx", F.transform("d", lambda v: v["det_no"]).alias("no"),
        F.transform("d", lambda v: v["x"]).alias("xs"), F.transform("d", lambda v: v["y"]).alias("ys"))

    def step(state, batch):
        out = []
        for xs, ys in zip(batch["xs"], batch["ys"]):
            state, got = _greedy(state, np.array(xs if xs is not None else [], float), np.array(ys if ys is not None else [], float))
            out.append(got)
        return state, batch[["clip_id", "shot", "frame_idx", "no"]].assign(ids=out)

    d = Q.carried_state(f, ["clip_id", "shot"], ["frame_idx"], step,
                        "clip_id long, shot long, frame_idx long, no array<long>, ids array<long>")
    z = d.select("clip_id", "shot", "frame_idx", F.explode(F.arrays_zip("no", "ids")).alias("z"))
    return z.select("clip_id", "frame_idx", F.col("z.no").alias("det_no"), "shot", (F.col("shot") * 1_000_000 + F.col("z.ids")).alias("track_id"))


def team_clusters(points: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Two appearance clusters per clip and the majority label of each track.

    Two-means with per-clip centres as a small table: each round is a map over the points
    and one partially aggregated sum per (clip, cluster, dimension). Starts from the two
    extreme points of the first dimension, so it is deterministic, and ends when no
    centre moves (two-means only ever lowers its error, so it ends).
    """
    d = points.where(F.col(embedding).isNotNull()).select("clip_id", "track_id", "frame_idx", F.col(embedding).alias("_e"))
    first = F.get("_e", F.lit(0))
    cen = d.groupBy("clip_id").agg(F.min_by("_e", F.struct(first, "track_id", "frame_idx")).alias("c0"), F.max_by("_e", F.struct(first, "track_id", "frame_idx")).alias("c1"))
    gap = lambda c: F.aggregate(F.zip_with("_e", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    label = lambda cs: d.join(cs, "clip_id").withColumn("label", F.when(gap("c0") <= gap("c1"), 0).otherwise(1).cast("long"))
    cen = cut_lineage(cen)
    while True:
        m = (label(cen).select("clip_id", "label", "c0", "c1", F.posexplode("_e").alias("_k", "_v"))
             .groupBy("clip_id", "label", "_k").agg(F.avg("_v").alias("_m"), F.first("c0").alias("c0"), F.first("c1").alias("c1")))
        m = m.groupBy("clip_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.struct("_k", "_m")))), lambda v: v["_m"]).alias(f"n{k}") for k in (0, 1)],
                                     F.first("c0").alias("c0"), F.first("c1").alias("c1"))
        keep = lambda k: F.when(F.size(f"n{k}") > 0, F.col(f"n{k}")).otherwise(F.col(f"c{k}")).alias(f"c{k}")
        new = cut_lineage(m.select("clip_id", keep(0), keep(1)))
        moved = F.exists(F.zip_with(F.concat("x.c0", "x.c1"), F.concat("y.c0", "y.c1"), lambda a, b: F.abs(a - b) > 1e-9), lambda v: v)
        done = cen.alias("x").join(new.alias("y"), "clip_id").where(moved).isEmpty()
        cen = new
        if done:
            break
    return J.ordered_vote(label(cen), TRACK, "label", F.col("frame_idx"), "team_label").select(*TRACK, "team_label")


def spread_top(df: DataFrame, by: list[str], rank: str, t: str, n: int = 4, gap: float = 8.0) -> DataFrame:
    """Greedy best-first picks at least ``gap`` apart; the state is the picks made so far."""
    def step(picks, batch):
        picks = picks or []
        keep = []
        for v in batch[t]:
            good = len(picks) < n and all(abs(v - p) >= gap for p in picks)
            keep.append(good)
            if good:
                picks = [*picks, v]
        return picks, batch[keep]

    return Q.carried_state(df, by, [rank], step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def probe_frames(dets: DataFrame) -> DataFrame:
    """Detections of the frames at 30, 50 and 70 % of each clip."""
    d = dets.join(dets.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("_len")), "clip_id")
    return d.where("frame_idx IN (3 * _len DIV 10, _len DIV 2, 7 * _len DIV 10)").drop("_len")


def placeholder_clips(dets: DataFrame, conf: float = 0.0) -> DataFrame:
    """A clip whose probe frames never show more than one player is a placeholder card."""
    hit = (F.col("cls") == "player") & (F.col("conf") >= conf)
    n = dets.groupBy("clip_id", "frame_idx").agg(F.count_if(hit).alias("n"))
    return n.groupBy("clip_id").agg((F.max("n") <= 1).alias("placeholder"))


def keypoint_residuals(d: DataFrame) -> DataFrame:
    """Pixel error against the label and court error under the map ``h`` per landmark."""
    x, y = G.project("h", "px", "py")
    return d.withColumns({"px_err": G.dist("px", "py", "true_px", "true_py"), "ft": G.dist(x, y, "court_x", "court_y")})


def keypoint_eval(res: DataFrame, conf: float = 0.5, min_points: int = 6, max_ft: float = 2.0) -> DataFrame:
    """Median pixel and court error, solve rate and points used over confident landmarks.

    The global pixel median is taken by rank, the per-frame ones over a landmark list.
    """
    good = F.col("conf") >= conf
    f = res.groupBy("clip_id", "frame_idx").agg(F.count_if(good).alias("used"), F.median(F.when(good, F.col("ft"))).alias("m"))
    usable = F.col("used") >= min_points
    tot = f.agg((F.count_if(usable & (F.col("m") <= max_ft)) / F.count(F.lit(1))).alias("solve_rate"), F.avg("used").alias("mean_used"))
    px = AG.quantiles(res.where(good), [], "px_err", {"px_median": 0.5})
    ft = AG.quantiles(f.where(usable), [], "m", {"ft_median": 0.5})
    return tot.join(F.broadcast(px)).join(F.broadcast(ft))


def diagnostics(frames: DataFrame, dets: DataFrame, by: list[str]) -> DataFrame:
    per = dets.groupBy(*by, "frame_idx").agg(F.count_if(F.col("cls") == "player").alias("_p"), F.count_if(F.col("cls") == "ball").alias("_b"))
    d = frames.join(per, [*by, "frame_idx"], "left")
    return d.groupBy(*by).agg(F.avg(F.col("homog_ok").cast("double")).alias("homog_valid_rate"), F.avg(F.coalesce("_p", F.lit(0))).alias("mean_players"),
                              F.avg((F.coalesce("_b", F.lit(0)) > 0).cast("double")).alias("ball_recall"))


def shot_quality(samples: DataFrame, min_frac: float, min_players: int) -> DataFrame:
    """Best (most court) sample per camera shot, gated and ranked for calibration."""
    w = Window.partitionBy("clip_id", "shot").orderBy(F.col("frac").desc(), "t")
    best = samples.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
    best = best.where((F.col("frac") >= min_frac) & (F.col("n_players") >= min_players))
    r = Window.partitionBy("clip_id").orderBy(-F.least(F.col("n_players"), F.lit(12)), -F.col("frac"), "t")
    return best.withColumn("rank", F.row_number().over(r))


def pause_context(pauses: DataFrame, rows: DataFrame, half: int) -> DataFrame:
    """Rows within +-half frames of each pause: the pause fans out to exact frame keys."""
    near = pauses.withColumn("frame_idx", F.explode(F.sequence(F.col("pause") - half, F.col("pause") + half)))
    return near.join(rows, ["clip_id", "frame_idx"]).select("clip_id", "pause", *[c for c in rows.columns if c != "clip_id"])


def seed_ball(dets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Replace the first frame's ball detections of a clip by a supplied point."""
    first_ball = (F.col("cls") == "ball") & (F.col("frame_idx") == 0)
    keep = dets.where(~first_ball).unionByName(dets.where(first_ball).join(seeds.select("clip_id"), "clip_id", "left_anti"))
    new = seeds.select("clip_id", F.lit(0).cast("long").alias("frame_idx"), F.lit(-2).cast("long").alias("det_no"), F.lit("ball").alias("cls"),
                       (F.col("sx") - 8).alias("x1"), (F.col("sy") - 8).alias("y1"), (F.col("sx") + 8).alias("x2"), (F.col("sy") + 8).alias("y2"), F.lit(1.0).alias("conf"))
    return keep.unionByName(new, allowMissingColumns=True)
