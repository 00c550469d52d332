"""Repeated windows of documents, found by content-defined anchors.

Every window of ``length`` symbols (bytes or words) has one anchor: the smallest hash among
its k-grams, leftmost first. Equal windows have equal anchors, so only windows of anchors
that occur more than once can repeat. The job is one plan over documents dealt into groups
of about ``GROUP_BYTES`` of text:

0. exact copies of texts with smaller ids are set aside: all their windows repeat;
1. each group sends its distinct anchors, packed by anchor bucket;
2. each bucket tells the groups which of their anchors occur elsewhere as well;
3. each group sends the fingerprint and first place of its distinct phrases (runs of windows
   with one anchor) of those anchors;
4. each bucket tells the groups which phrases start earlier elsewhere (all their windows repeat)
   and which are the first of their kind while other phrases share the anchor;
5. each group sends only these first phrases whole, a distinct phrase once in the corpus;
6. each bucket compares the windows of its phrases and returns the repeated runs;
7. each group turns the runs of its documents into result rows.

A phrase is known by 64 bits over all its symbols beside 32 bits and the bucket of its anchor. The
text is shuffled once (the exchange is reused). Groups and buckets both grow with the input, so
a message is kept large: buckets of anchors and fingerprints hold 16 MB of text. An anchor of very
many groups is dealt by fingerprint and then by window instead of by anchor, so that contexts
of one frequent anchor spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopflow.llm.text import gram_hashes, mix, utf8

GROUP_BYTES = 4_000_000
#: Text whose anchors, and whose whole phrases, meet in one bucket.
ANCHOR_BYTES, PHRASE_BYTES = 16_000_000, 3_000_000
#: Symbols worked on at once; longer documents are cut into overlapping pieces.
PIECE = 1 << 20
#: Anchors in more groups than this are dealt by window.
HOT_GROUPS = 256
LAST = np.iinfo(np.int64).max
_IDX = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Phrases:
    """Runs of windows that share an anchor: row, first window (symbol position in the row), windows, anchor."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:len(a) - (w - size)], a[w - size:]) if w > size else a


def _piece(h: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of some rows end to end; ``ends`` has the row end of every symbol."""
    g = gram_hashes(h, k)
    n = len(h) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    low = _sliding_min((g & ~_IDX) | np.arange(len(g), dtype=np.uint64), length - k + 1)
    at = (low & _IDX).astype(np.int64)
    s = np.flatnonzero(np.arange(n) + length <= ends[:n])
    if not len(s):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.ones(len(s), bool)
    new[1:] = (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    return s[first], np.diff(np.append(first, len(s))), g[at[s[first]]]


def phrases(h: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Phrases:
    """All phrases of the rows whose symbols are ``h[offsets[i]:offsets[i + 1]]``."""
    parts: list[tuple] = []
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > PIECE:
            for a in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, PIECE):
                b = min(a + PIECE + length - 1, int(offsets[i + 1]))
                s, c, x = _piece(h[a:b], np.full(b - a, b - a), length, k)
                parts.append((np.full(len(s), i), s + a - offsets[i], c, x))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        sizes = np.diff(offsets[i:j + 1])
        s, c, x = _piece(h[a:b], np.repeat(offsets[i + 1:j + 1] - a, sizes), length, k)
        row = np.searchsorted(offsets[i:j + 1], s + a, "right") - 1 + i
        parts.append((row, s + a - offsets[row], c, x))
        i = j
    if not parts:
        return Phrases(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    return Phrases(*(np.concatenate([p[m] for p in parts]) for m in range(4)))


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every entry, ``count`` each."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive positions of a row; input sorted by row and position."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], at[first], np.diff(np.append(first, len(row)))


@dataclass(frozen=True)
class Method:
    """What differs between the operators that look for repeated windows.

    symbols(data, offsets) -> (hash per symbol, symbol offsets of the rows)
    content(data, offsets, h, symbol offsets, phrases) -> bytes of all phrases end to end
    size(count) -> bytes of the content of phrases of so many windows
    repeated(doc, start, count, content, sizes) -> per window of every phrase, is it a repeat
    finish(table, covered) -> result rows; covered(row, n) is a mask over the row's n symbols
    """

    length: int
    k: int
    within: bool
    symbols: Callable
    content: Callable
    size: Callable
    repeated: Callable
    finish: Callable
    schema: str


def _sorted_rows(table: pa.Table) -> pa.Table:
    """The same order in every step; equal rows are interchangeable."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(bucket[part[0]]), part


def _pack(ids: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    """Phrases of a few rows: the rows and their ids once, then 7 bytes a phrase."""
    used, at = np.unique(row, return_inverse=True)
    return b"".join([np.array([len(used), len(row)], np.int32).tobytes(), ids[used].astype(np.int64).tobytes(), used.astype(np.int32).tobytes(),
                     at.astype(np.uint16 if len(used) < 65536 else np.int32).tobytes(), start.astype(np.int32).tobytes(), count.astype(np.uint16).tobytes()])


def _unpack(raw: bytes) -> np.ndarray:
    """doc, row, start, count."""
    (n, m), at = np.frombuffer(raw, np.int32, 2), 8
    parts = []
    for kind, size in ((np.int64, n), (np.int32, n), (np.uint16 if n < 65536 else np.int32, m), (np.int32, m), (np.uint16, m)):
        parts.append(np.frombuffer(raw, kind, size, at).astype(np.int64))
        at += size * np.dtype(kind).itemsize
    ids, used, which, start, count = parts
    return np.stack([ids[which], used[which], start, count])


def _pack_ids(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    if int(ids.max()) - low < 1 << 32:
        return np.int64(low).tobytes() + (ids - low).astype(np.uint32).tobytes()
    return np.int64(low).tobytes() + ids.tobytes()


def _unpack_ids(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 8 + 4 * n:
        return np.frombuffer(raw, np.uint32, n, 8).astype(np.int64) + np.frombuffer(raw, np.int64, 1)
    return np.frombuffer(raw, np.int64, n, 8)


def _bits(raw: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(raw, sizes)]).astype(bool)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("_id").to_numpy()


def repeated_windows(docs: DataFrame, method: Method, id_col: str = "doc_id", text_col: str = "text",
                     group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """One row of ``method.schema`` per row of ``docs``; a null id counts as larger than any other."""
    m, length, k = method, method.length, method.k
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n_groups = max(1, total // group_bytes)
    n_anchors, n_buckets = max(8, total // ANCHOR_BYTES), max(8, total // PHRASE_BYTES)
    weights = np.random.default_rng(51).integers(1, 2**63, 2 * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    dealt = plain.withColumn("_g", F.pmod(F.xxhash64("_id", "_h"), F.lit(n_groups)))
    grouped = dealt.groupBy("_g")
    same = ["_h", "_n", "_c"]
    narrow = dealt.select("_g", "_id", "_h", F.octet_length("_text").alias("_n"), F.hash("_text").alias("_c"))
    originals = narrow.groupBy(*same).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    copies = narrow.join(originals, same).where("_id > _first").select(F.col("_g").alias("_to"), F.lit(0).alias("k"), F.col("_id").alias("i"), F.col("_h").alias("_of"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("m")).toDF("_to", "k", "i", "_h", "a", "m").withColumnRenamed("_to", "_g")

    def own(table: pa.Table, messages: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The group's rows in order, and which of them are exact copies."""
        table = _sorted_rows(table)
        said = messages.filter(pa.array(messages.column("k").to_numpy() == 0)) if messages.num_rows else messages
        known = set(zip(said.column("i").to_pylist(), said.column("_h").to_pylist()))
        if not known:
            return table, np.zeros(table.num_rows, bool)
        return table, np.fromiter(map(known.__contains__, zip(table.column("_id").to_pylist(), table.column("_h").to_pylist())), bool, table.num_rows)

    def said(messages: pa.Table, column: str, kind: int = 1) -> list:
        return [x for k, x in zip(messages.column("k").to_pylist(), messages.column(column).to_pylist()) if k == kind]

    def found(table: pa.Table, copy: np.ndarray):
        texts = table.column("_text")
        data, offsets = utf8(pc.if_else(pa.array(copy), "", texts) if copy.any() else texts)
        h, rows = m.symbols(data, offsets)
        return data, offsets, h, rows, phrases(h, rows, length, k)

    def short(anchor: np.ndarray) -> np.ndarray:
        """Bucket and 32 bits of an anchor: this only selects candidates, so a rare clash costs time, not results."""
        return (anchor % np.uint64(n_anchors)) << np.uint64(32) | anchor >> np.uint64(32)

    def send_anchors(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"b": pa.array([], pa.int64()), "_g": pa.array([], pa.int64()), "a": pa.array([], pa.binary()), "m": pa.array([], pa.binary())})
        *_, p = found(*own(table, messages))
        key = short(p.anchor)
        if m.within:  # occurrences; a phrase cut at a piece's end only adds one
            a, c = np.unique(key, return_counts=True)
        else:
            order = np.lexsort((p.row, key))
            x, r = key[order], p.row[order]
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
            a, c = np.unique(x[keep], return_counts=True)
        out = [(b, a[i].astype(np.uint32).tobytes(), np.packbits(c[i] > 1).tobytes()) for b, i in _by_bucket((a >> np.uint64(32)).astype(np.int64))]
        g = table.column("_g")[0].as_py()
        return pa.table({"b": pa.array([o[0] for o in out], pa.int64()), "_g": pa.array([g] * len(out), pa.int64()),
                         "a": pa.array([o[1] for o in out], pa.binary()), "m": pa.array([o[2] for o in out], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(table.column("m").to_pylist(), lists)]
        every, inverse, groups = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = groups > 1
        twice[inverse[np.concatenate(many)]] = True
        hot = groups > hot_groups
        g, a, hots, i = [], [], [], 0
        for gid, x in zip(table.column("_g").to_pylist(), lists):
            at = inverse[i:i + len(x)]
            i += len(x)
            if (keep := twice[at]).any():
                g.append(gid)
                a.append(x[keep].tobytes())
                hots.append(np.packbits(hot[at[keep]]).tobytes())
        return message(g, a, hots, table.column("b")[0].as_py())

    def message(g: list, a: list, m: list, bucket: int = 0, kind: int = 1) -> pa.Table:
        n = len(g)
        return pa.table({"_g": pa.array(g, pa.int64()), "k": pa.array([kind] * n, pa.int32()), "i": pa.array([bucket] * n, pa.int64()), "_h": pa.array([0] * n, pa.int64()),
                         "a": pa.array(a, pa.binary()), "m": pa.array(m, pa.binary())})

    def fingerprints(h: np.ndarray, rows: np.ndarray, p: Phrases) -> np.ndarray:
        out = np.empty(len(p.row), np.uint64)
        for i in range(0, len(out), 1 << 15):
            part = slice(i, i + (1 << 15))
            sizes = p.count[part] + length - 1
            cut = np.cumsum(sizes) - sizes
            at = expand(rows[p.row[part]] + p.start[part], sizes)
            out[part] = np.add.reduceat(h[at] * weights[expand(np.zeros(len(sizes), np.int64), sizes)], cut)
        return mix(out)

    def shared(table: pa.Table, messages: pa.Table):
        """The group's rows, its phrases of anchors that occur elsewhere too, whether an anchor is hot, and the order of the distinct phrases.

        The order is by bucket, anchor, fingerprint and place; ``new`` marks the first, that is the earliest, of each."""
        lists = [np.uint64(b << 32) | np.frombuffer(x, np.uint32) for b, x in zip(said(messages, "i"), said(messages, "a"))]
        if not lists or not table.num_rows:
            return None
        hot = _bits(said(messages, "m"), [len(a) for a in lists])
        known_a = np.concatenate(lists)
        order = np.argsort(known_a)
        known_a, hot = known_a[order], hot[order]
        table, copy = own(table, messages)
        data, offsets, h, rows, p = found(table, copy)
        key = short(p.anchor)
        at = np.minimum(np.searchsorted(known_a, key), len(known_a) - 1)
        keep = known_a[at] == key
        p, hot = Phrases(p.row[keep], p.start[keep], p.count[keep], p.anchor[keep]), hot[at[keep]]
        a, x, doc = p.anchor >> np.uint64(32), fingerprints(h, rows, p), _ids(table)[p.row]
        bucket = np.where(hot, x, p.anchor) % np.uint64(n_anchors)
        place = p.start if m.within else np.zeros(len(doc), np.int64)
        order = np.lexsort((place, doc, x, a, bucket))
        new = _changes(bucket[order], a[order], x[order])
        return table, data, offsets, h, rows, p, hot, a, x, doc, place, bucket.astype(np.int64), order, new

    def send_fingerprints(table: pa.Table, messages: pa.Table) -> pa.Table:
        s, out = shared(table, messages), []
        if s:
            *_, hot, a, x, doc, place, bucket, order, new = s
            first = order[new]
            for b, i in _by_bucket(bucket[first]):
                i = first[i]
                out.append((b, a[i].astype(np.uint32).tobytes(), x[i].tobytes(), _pack_ids(doc[i]), place[i].astype(np.int32).tobytes() if m.within else None, np.packbits(hot[i]).tobytes()))
        g = [table.column("_g")[0].as_py()] * len(out) if out else []
        return pa.table({"b": pa.array([o[0] for o in out], pa.int64()), "_g": pa.array(g, pa.int64()),
                         **{n: pa.array([o[j] for o in out], pa.binary()) for j, n in enumerate(("a", "x", "d", "s", "m"), 1)}})

    def settle(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        sizes = [len(x) for x in lists]
        a = np.concatenate(lists)
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint64)
        doc = np.concatenate([_unpack_ids(r, n) for r, n in zip(table.column("d").to_pylist(), sizes)])
        place = np.frombuffer(b"".join(table.column("s").to_pylist()), np.int32) if m.within else np.zeros(len(a), np.int32)
        order = np.lexsort((place, doc, x, a))
        ao, do, so = a[order], doc[order], place[order]
        new, new_anchor = _changes(ao, x[order]), _changes(ao)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1] > 1
        later, alone = np.empty(len(a), bool), np.empty(len(a), bool)
        later[order] = (do != do[head]) | (so != so[head])
        alone[order] = ~several
        first = ~later & (~alone | _bits(table.column("m").to_pylist(), sizes))
        cut = np.cumsum(sizes)[:-1]
        return message(table.column("_g").to_pylist(), [np.packbits(v).tobytes() for v in np.split(later, cut)],
                       [np.packbits(v).tobytes() for v in np.split(first, cut)], table.column("b")[0].as_py(), 2)

    def send_phrases(table: pa.Table, messages: pa.Table) -> pa.Table:
        s, out = shared(table, messages), []
        if not s:
            return pa.table({n: pa.array([], t) for n, t in (("b", pa.int64()), ("_g", pa.int64()), ("h", pa.binary()), ("c", pa.binary()))})
        table, data, offsets, h, rows, p, is_hot, _, _, doc, place, bucket, order, new = s
        g = table.column("_g")[0].as_py()
        answers = dict(zip(said(messages, "i", 2), zip(said(messages, "a", 2), said(messages, "m", 2))))
        names, sizes = np.unique(bucket[order[new]], return_counts=True)
        later, first = (_bits([answers[b][j] for b in names.tolist()], sizes.tolist()) if len(names) else np.zeros(0, bool) for j in (0, 1))
        kind = np.cumsum(new) - 1
        head = order[np.flatnonzero(new)[kind]] if len(order) else order
        repeated, whole = np.empty(len(order), bool), np.empty(len(order), bool)
        repeated[order] = later[kind] | (doc[order] != doc[head]) | (place[order] != place[head])
        whole[order] = first[kind]
        whole &= ~repeated
        row, at = np.repeat(p.row[repeated], p.count[repeated]), expand(p.start[repeated], p.count[repeated])
        by = np.lexsort((at, row))
        if len(by):  # a message to itself, past the buckets
            out.append((-1 - g, np.stack(runs(row[by], at[by])).astype(np.int64).tobytes(), None))
        p, is_hot = Phrases(p.row[whole], p.start[whole], p.count[whole], p.anchor[whole]), is_hot[whole]
        bucket = p.anchor % np.uint64(n_buckets)
        if is_hot.any():  # these go as single windows, by the hash of the window
            c = p.count[is_hot]
            one = Phrases(np.repeat(p.row[is_hot], c), expand(p.start[is_hot], c), np.ones(int(c.sum()), np.int64), np.repeat(p.anchor[is_hot], c))
            first = rows[one.row] + one.start
            grams = np.zeros(len(first), np.uint64)
            for j in range(length):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[first + j]
            bucket = np.concatenate([bucket[~is_hot], (grams >> np.uint64(20)) % np.uint64(n_buckets)])
            p = Phrases(*(np.concatenate([getattr(p, f)[~is_hot], getattr(one, f)]) for f in ("row", "start", "count", "anchor")))
        blob, sizes = m.content(data, offsets, h, rows, p), m.size(p.count)
        ids = _ids(table)
        cut = np.cumsum(sizes) - sizes
        for b, i in _by_bucket(bucket.astype(np.int64)):
            out.append((b, _pack(ids, p.row[i], p.start[i], p.count[i]), blob[expand(cut[i], sizes[i])].tobytes()))
        return pa.table({"b": pa.array([o[0] for o in out], pa.int64()), "_g": pa.array([g] * len(out), pa.int64()),
                         "h": pa.array([o[1] for o in out], pa.binary()), "c": pa.array([o[2] for o in out], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        if table.column("b")[0].as_py() < 0:
            return message(table.column("_g").to_pylist(), table.column("h").to_pylist(), [None] * table.num_rows)
        heads = [_unpack(x) for x in table.column("h").to_pylist()]
        group = np.repeat(np.arange(len(heads)), [x.shape[1] for x in heads])
        doc, row, start, count = np.concatenate(heads, axis=1)
        sizes = m.size(count)
        content = np.frombuffer(b"".join(table.column("c").to_pylist()), np.uint8)
        bad = m.repeated(doc, start, count, content, sizes)
        e = np.repeat(np.arange(len(doc)), count)[bad]
        at = expand(start, count)[bad]
        order = np.lexsort((at, row[e], group[e]))
        key = (group[e].astype(np.int64) << 32 | row[e])[order]
        key, at, size = runs(key, at[order])
        g, out, names = [], [], table.column("_g").to_pylist()
        for x, i in _by_bucket(key >> 32):
            g.append(names[x])
            out.append(np.stack([key[i] & 0xFFFFFFFF, at[i], size[i]]).astype(np.int64).tobytes())
        return message(g, out, [None] * len(g))

    def finish(table: pa.Table, found_runs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return m.finish(table, None)
        table, copy = own(table, found_runs)
        lists = [np.frombuffer(x, np.int64).reshape(3, -1) for x in said(found_runs, "a")]
        row, at, size = np.concatenate(lists, axis=1) if lists else np.zeros((3, 0), np.int64)
        order = np.argsort(row, kind="stable")
        row, at, size = row[order], at[order], size[order]

        def covered(i: int, n: int) -> np.ndarray | None:
            if copy[i]:
                return np.ones(n, bool) if n >= length else None
            a, b = np.searchsorted(row, [i, i + 1])
            if a == b:
                return None
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at[a:b], 1)
            np.subtract.at(edge, at[a:b] + size[a:b] + length - 1, 1)
            return np.cumsum(edge[:-1]) > 0

        return m.finish(table, covered)

    told = "_g long, k int, i long, _h long, a binary, m binary"
    anchors = grouped.cogroup(copies.groupBy("_g")).applyInArrow(send_anchors, "b long, _g long, a binary, m binary")
    known = anchors.groupBy("b").applyInArrow(answer, told)
    prints = grouped.cogroup(known.union(copies).groupBy("_g")).applyInArrow(send_fingerprints, "b long, _g long, a binary, x binary, d binary, s binary, m binary")
    firsts = prints.groupBy("b").applyInArrow(settle, told)
    sent = grouped.cogroup(firsts.union(known).union(copies).groupBy("_g")).applyInArrow(send_phrases, "b long, _g long, h binary, c binary")
    bad = sent.groupBy("b").applyInArrow(compare, told)
    return grouped.cogroup(bad.union(copies).groupBy("_g")).applyInArrow(finish, m.schema)
