"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. Register i holds the truncated logarithm, to
base ``BASE``, of the smallest of exponentially distributed hashes: registers of a union are the
maxima of the registers (mergeable), and equal registers are at least as likely as the
Jaccard similarity (locality-sensitive). ``ROWS`` registers form a band; equal bands make
candidates. Their similarity is estimated from all registers jointly by maximum likelihood,
what is far below the threshold goes, the rest is confirmed on the full sets.

32 bands of 4 registers miss a pair of similarity 0.8 with a probability below 5e-8.

No group is expanded into pairs. Equal sets are one class first. Each band bucket compares
its members with its smallest and largest class, which then leave it; confirmed links make components.
Buckets whose other members are in two components or more go through an exact prefix join:
only classes of different components that share their rarest shingles often enough are
compared. So there are two confirmations and one search for components, or two, whatever
the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopflow.llm.graph import components, stored
from hoopflow.llm.repeats import LAST
from hoopflow.llm.text import gram_hashes, mix, row_slices, utf8, word_hashes

BASE, BANDS, ROWS = 1.05, 32, 4
REGISTERS = BANDS * ROWS
#: An estimate this far below the threshold excludes a pair (over 5 standard errors of 128 registers).
MARGIN = 0.2
#: Id lists up to this long (16 MB) are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_R = np.random.default_rng(1)
_MUL = _R.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _R.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and their offsets; fewer than ``n`` words are one shingle."""
    h, rows = word_hashes(data, offsets, lower=True)
    words = np.diff(rows)
    grams = gram_hashes(h, n)
    counts = np.where(words >= n, words - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), counts)
    values = grams[np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(rows[:-1], counts)]
    short = np.flatnonzero((words > 0) & (words < n))
    whole = np.array([mix(gram_hashes(h[rows[i]:rows[i + 1]], words[i]) + np.uint64(words[i]))[0] for i in short], np.uint64)
    owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[keep], values[keep]
    return values, np.searchsorted(owner, np.arange(len(words) + 1))


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of non-empty sets; 0 for an empty one."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    low = (values >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][full]
    least = np.empty((len(full), REGISTERS), np.uint32)
    for i in range(REGISTERS):
        x = (low ^ _XOR[i]) * _MUL[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        least[:, i] = np.minimum.reduceat(x, starts)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    out[full] = np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)) + 20, 1, 65535)
    return out


def bands(k: np.ndarray) -> np.ndarray:
    h = np.zeros((len(k), BANDS), np.uint64)
    for j in range(ROWS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + k[:, j::ROWS].astype(np.uint64) + np.uint64(1)
    return mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def estimate(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how often each register is larger, and the set sizes."""
    more, less = (ku > kv).sum(1), (ku < kv).sum(1)
    same = ku.shape[1] - more - less
    u, v = nu / (nu + nv), nv / (nu + nv)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(nu), -np.inf), np.zeros(len(nu))
    for j in np.linspace(0, 1, 101):
        a, b = p(u - v * j), p(v - u * j)
        like = more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))
        ok = (j <= np.minimum(u / v, v / u) + 0.01) & (like > best)
        best, at = np.where(ok, like, best), np.where(ok, j, at)
    return at


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            for i, j in row_slices(offsets):
                values, off = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], n)
                k, sizes = registers(values, off), np.diff(off)
                full = sizes > 0
                hi, lo = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                if full.any():
                    hi[full] = np.add.reduceat(mix(values), off[:-1][full])
                    lo[full] = np.bitwise_xor.reduceat(mix(values + np.uint64(77)), off[:-1][full])
                yield pa.record_batch({"_id": batch.column("_id").slice(i, j - i), "n": pa.array(sizes.astype(np.int64)), "hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)),
                                       "k": pa.array([r.tobytes() for r in k], pa.binary())})
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = bands(np.frombuffer(b"".join(b.column("k").to_pylist()), np.uint16).reshape(-1, REGISTERS))
        rep, n = (np.repeat(b.column(c).to_numpy(), BANDS) for c in ("rep", "n"))
        yield pa.record_batch({"rep": pa.array(rep), "n": pa.array(n), "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), "key": pa.array(keys.ravel().view(np.int64))})


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [np.frombuffer(x, np.int64) for x in b.column("s").to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        rep, v = (pa.array(np.repeat(b.column(c).to_numpy(), sizes)) for c in ("_id", "v"))
        yield pa.record_batch({"rep": rep, "v": v, "n": pa.array(np.repeat(sizes, sizes)), "s": pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))})


def _fit(percent: int):
    """The pairs that neither the likelihood estimate nor the 16-bit values exclude."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ku, kv = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ka", "kb"))
            e = estimate(ku, kv, b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
            yield from _possible(b.filter(pa.array(e >= percent / 100 - MARGIN, pa.bool_())), percent)
    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            for i, j in row_slices(offsets):
                values, off = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], n)
                yield pa.record_batch({"_id": batch.column("_id").slice(i, j - i), "s": pa.array([values[off[r]:off[r + 1]].tobytes() for r in range(j - i)], pa.binary()),
                                       "f": pa.array([np.sort(values[off[r]:off[r + 1]].astype(np.uint16)).tobytes() for r in range(j - i)], pa.binary())})
    return run


def common_at_most(p: np.ndarray, q: np.ndarray, p_rows: np.ndarray, q_rows: np.ndarray, rows: int) -> np.ndarray:
    """For each row, the size of the multiset intersection of its 16-bit values in p and q.

    Every common shingle has one value in both, so this is no less than the sets have in common.
    """
    (x, m), (y, n) = (np.unique((r.astype(np.int64) << 16) | v, return_counts=True) for v, r in ((p, p_rows), (q, q_rows)))
    keys, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(keys >> 16, np.minimum(m[i], n[j]), rows).astype(np.int64)


def _possible(batch: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([[len(x) // 2, len(y) // 2] for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())], np.int64).reshape(-1, 2)
    for i, j in row_slices(np.append(0, np.cumsum(sizes.sum(1)))):
        b, n, rows = batch.slice(i, j - i), sizes[i:j], np.arange(j - i)
        p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16) for c in ("fa", "fb"))
        both = common_at_most(p, q, np.repeat(rows, n[:, 0]), np.repeat(rows, n[:, 1]), j - i)
        keep = pa.array(100 * both >= percent * (n.sum(1) - both), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents by chains of links of Jaccard similarity ``percent`` / 100 or more.

    Returns per row doc_id, n_shingles, component_id (smallest id reachable, itself included),
    kept (doc_id = component_id) and n_links (links of its class to other classes that the
    search confirmed). Texts with fewer than ``words`` words are one shingle; null,
    empty and blank texts have an empty set and link with nothing. Rows with one id are one
    node; of these all are kept if the id is the component's. A null id counts as larger than
    any other and is returned as null, kept only where nothing else is in its component. An
    empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sketch = stored(plain.mapInArrow(_sketch(words), "_id long, n long, hi long, lo long, k binary"))
    filled = sketch.where("n > 0")
    classes = stored(filled.groupBy("n", "hi", "lo").agg(F.min("_id").alias("rep"), F.min_by("k", "_id").alias("k")))
    tied = stored(filled.select("_id", "n", "hi", "lo").join(classes.select("n", "hi", "lo", "rep"), ["n", "hi", "lo"]).select("_id", "rep"))
    # Rows of one id may have different sets: the id ties their classes.
    many = tied.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("_id", "a")
    own = tied.join(many, "_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    members = classes.select("rep", "n", "k").mapInArrow(_bands, "rep long, n long, band int, key long").select("key", "rep")
    # One order in all bands keeps the leads of a class few, and a minimum and a maximum are small in the shuffle.
    shared = members.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y")
    near = stored(members.join(shared, "key"))
    wanted = stored(near.select(F.col("rep").alias("_id")).distinct())
    sets = stored(_only(plain, wanted).mapInArrow(_full_sets(words), "_id long, s binary, f binary"))
    regs = stored(classes.select("rep", "n", "k").join(sets.select(F.col("_id").alias("rep"), "f"), "rep"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the sketches don't exclude and the full sets confirm."""
        a, b = regs.toDF("a", "na", "ka", "fa"), regs.toDF("b", "nb", "kb", "fb")
        sized = pairs.join(a, "a").join(b, "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")
        fit = stored(sized.mapInArrow(_fit(percent), "a long, b long").distinct())
        used = _only(sets.select("_id", "s"), fit.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
        sa, sb = (used.toDF(c, f"s{c}") for c in ("a", "b"))
        return stored(fit.join(sa, "a").join(sb, "b").mapInArrow(_confirm(percent), "a long, b long"))

    pairs = near.select("rep", F.explode(F.array("x", "y")).alias("lead")).where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    links = own.union(confirmed(pairs))
    comp = components(links)

    # The leads were compared with all of their bucket; a bucket whose others are one component has no more to find.
    others = near.where("rep <> x and rep <> y").select("key", "rep")
    placed = others.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    left = stored(placed.join(mixed, "key", "left_semi").select("rep", "component").distinct())
    more = confirmed(_rare_pairs(stored(_rare_shingles(sets, left, percent)), percent))
    if not more.isEmpty():
        links = links.union(more)
        comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    of_id = (tied.groupBy("_id").agg(F.min("rep").alias("rep")).join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
             .select("_id", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("n_links")))
    out = sketch.select("_id", F.col("n").alias("n_shingles")).join(of_id, "_id", "left")
    null = lambda c: F.nullif(c, F.lit(LAST))
    component = F.coalesce("component", "_id")
    return out.select(null(F.col("_id")).alias("doc_id"), "n_shingles", null(component).alias("component_id"), (F.col("_id") == component).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose _id is in ``ids`` (distinct)."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "_id", "left_semi")


def _rare_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose rarest shingles leave room for the overlap that their sizes need.

    Places in the common order grow together along common shingles, so the room behind them shrinks. Up to a
    pair's last common shingle that has room, all common ones are counted; behind it there are no more
    than the smaller rest.
    """
    x, y = rare.alias("x"), rare.alias("y")
    need = (F.col("x.n") + F.col("y.n")) * percent
    room = (1 + F.least(F.col("x.n") - F.col("x.r"), F.col("y.n") - F.col("y.r"))) * (100 + percent) >= need
    seen = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.component") < F.col("y.component")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & room)
    return (seen.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), "x.v", "y.v")
            .agg(F.count("*").alias("c"), F.max("x.r").alias("ra"), F.max("y.r").alias("rb"))
            .where(f"(c + least(na - ra, nb - rb)) * {100 + percent} >= (na + nb) * {percent}").select("a", "b").distinct())


def _rare_shingles(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(rep, v, n, s, r, component): the rarest shingles of each class, enough of them that two similar sets share one.

    Of n shingles in one common order, sets with a similarity of t share one of the first n - ceil(t n) + 1.
    r is the place of a shingle in that order, from 1; v tells apart different sets of one id.
    """
    each = _only(sets.select("_id", F.xxhash64("s").alias("v"), "s"), left.select(F.col("rep").alias("_id")).distinct()).mapInArrow(_explode_sets, "rep long, v long, n long, s long")
    counts = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    # Shingles of one class alone come first, so their number is n less the others.
    own = Window.partitionBy("rep", "n", "v")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "s"))
    first = each.join(counts, "s").withColumn("r", rank).where(f"r <= n - ceil(n * {percent} / 100) + 1").select("rep", "v", "n", "s", "r")
    return first.join(left, "rep")
