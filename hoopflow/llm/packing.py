"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces are dealt into blocks at random. Every block is packed by several islands: a solution is a
set of bins; crossover injects another solution's well-filled bins whole, removes the bins
that hold a piece twice, and best-fits the pieces that lost their bin; mutation empties a few
badly filled bins and a few full ones. Every solution is then improved by exchanges of one or two pieces between unfilled bins,
which gather the room that is left in few bins until one is empty. An island goes on until generations bring no fewer bins or a
lower bound is met. Between epochs each island's elite moves to the next island of its block (a
shuffle). The best solution of a block wins. Bins of poor fill from all blocks are dealt and packed once more.
"""

from __future__ import annotations

import base64
import itertools
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopflow.llm.align import PLAIN, expand, split_parts
from hoopflow.llm.text import row_slices, utf8
from hoopflow.session import cut_lineage

CAPACITY, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1024, 4096, 2, 3, 60, 4
#: Generations without fewer bins after which an island stops; rounds of exchanges at most; members of a bin up to which pairs are exchanged.
PATIENCE, ROUNDS, PAIRED = 4, 40, 8


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts by the byte-level ``tokenizers`` file at ``path``.

    Byte-level pre-tokens never cross the place before a single space between visible characters, so texts are cut there and
    each distinct part is encoded once and remembered. Parts of Latin characters and plain blanks are encoded from the
    ranks of the same vocabulary, which is several times faster and gives the same ids (tested); the others, and
    parts that may hold a special token, by ``tokenizers``. The memory is emptied at ``limit`` ids.
    """

    def __init__(self, path: str, limit: int = 1 << 21):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model, self.limit = Tokenizer.from_file(path), limit
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.cuts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, parts: list[str]) -> None:
        fast, plain = self.part, PLAIN.fullmatch
        ids = [fast(p) if plain(p) and "<|" not in p else None for p in parts]
        slow = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(slow, self.model.encode_batch([parts[i] for i in slow], add_special_tokens=False)):
            ids[i] = e.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(n.sum()))])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(n)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and their offsets; null is empty."""
        if len(self.ids) > self.limit:
            self._forget()
        coded, offsets = split_parts(texts, lead=False, fine=True)
        parts = coded.dictionary.to_pylist()
        known = self.known
        self._learn([p for p in parts if p not in known])
        entry = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        at = entry[coded.indices.to_numpy(zero_copy_only=False)]
        which, place = expand(self.cuts[at], self.cuts[at + 1])
        return self.ids[place], np.searchsorted(which, offsets)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            text = batch.column("_text")
            for lo, hi in row_slices(utf8(text)[1]):
                flat, cut = encode(text.slice(lo, hi - lo))
                row, piece, start, length, crc = [], [], [], [], []
                for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()), lo):
                    n = y - x + 1
                    cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n] if n > capacity else [0, n]
                    raw = flat[x:y].tobytes() + end_id.to_bytes(4, "little")
                    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        row.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a:4 * b]))
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                                       "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
    return run


def _fills(bins: list[list[int]], length: list[int]) -> list[int]:
    """Tokens in every bin; no bin is empty."""
    if not bins:
        return []
    n = np.fromiter(map(len, bins), np.int64, len(bins))
    at = np.fromiter(itertools.chain.from_iterable(bins), np.int64, int(n.sum()))
    return np.add.reduceat(np.asarray(length, np.int64)[at], np.cumsum(n) - n).tolist()


def best_fit(items: list[int], length: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, longest first, into the fullest of ``bins`` that takes them; opens bins as needed."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - f, i) for i, f in enumerate(_fills(bins, length)))
    for x in sorted(items, key=lambda k: (-length[k], k)):
        need = length[x]
        at = bisect_left(room, (need, -1))
        if at == len(room):
            bins.append([x])
            left, i = capacity - need, len(bins) - 1
        else:
            left, i = room.pop(at)
            bins[i].append(x)
            left -= need
        if left:
            insort(room, (left, i))
    return bins


def _fitness(bins: list[list[int]], length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven fill."""
    fill = np.array(_fills(bins, length), float) / capacity
    return -len(bins), float((fill**2).sum())


def lower_bound(length: list[int], capacity: int) -> int:
    """Bins that no packing can do without: all tokens, and pieces above half the capacity with the smaller ones that fit beside none (Martello and Toth's L2)."""
    a = np.sort(np.asarray(length, np.int64))
    sums = np.concatenate([[0], np.cumsum(a)])
    half = int(np.searchsorted(a, capacity // 2, "right"))
    k = np.concatenate([[0], np.unique(a[:half])])
    far = np.searchsorted(a, capacity - k, "right")
    low = np.searchsorted(a, k, "left")
    beside = (far - half) * capacity - (sums[far] - sums[half])
    return int((len(a) - half + np.maximum(0, -(-(sums[half] - sums[low] - beside) // capacity))).max())


def _exchange(bins: list[list[int]], length: list[int], capacity: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Exchange none, one or two pieces of an unfilled bin for longer ones of another, as long as the fill gets more uneven.

    A bin takes part once a round, the best exchanges first. Only partners that fit in the room are looked at.
    """
    bins, fill = [list(b) for b in bins], _fills(bins, length)

    def own(b: list[int]) -> tuple[list[tuple], list[int]]:
        one = [length[x] for x in b]
        units, sizes = [(), *((x,) for x in b)], [0, *one]
        if 1 < len(b) <= PAIRED:
            units += itertools.combinations(b, 2)
            sizes += map(sum, itertools.combinations(one, 2))
        return units, sizes

    known = {i: own(b) for i, b in enumerate(bins) if fill[i] < capacity}
    for _ in range(rounds):
        units = list(itertools.chain.from_iterable(u for u, _ in known.values()))
        where = np.repeat(np.fromiter(known, np.int64, len(known)), [len(u) for u, _ in known.values()])
        size = np.fromiter(itertools.chain.from_iterable(z for _, z in known.values()), np.int64, len(units))
        order = np.argsort(size, kind="stable")
        size, at = size[order], where[order]
        full = np.array(fill, np.int64)[at]
        lo, hi = np.searchsorted(size, size, "right"), np.searchsorted(size, size + capacity - full, "right")
        left, right = expand(lo, hi)
        if not len(left):
            break
        d = size[right] - size[left]
        gain = np.where(at[left] == at[right], 0, d * (full[left] - full[right] + d))
        heads = np.flatnonzero(np.diff(left, prepend=-1))
        top = np.maximum.reduceat(gain, heads)
        best = np.flatnonzero(gain == np.repeat(top, np.diff(heads, append=len(left))))
        best = best[gain[best] > 0]
        used: set[int] = set()
        for e in best[np.argsort(-gain[best], kind="stable")].tolist():
            i, j = int(at[left[e]]), int(at[right[e]])
            if i in used or j in used:
                continue
            used |= {i, j}
            x, y = units[order[left[e]]], units[order[right[e]]]
            bins[i] = [k for k in bins[i] if k not in x] + list(y)
            bins[j] = [k for k in bins[j] if k not in y] + list(x)
            fill[i] += int(d[e])
            fill[j] -= int(d[e])
            for k in (i, j):
                known.pop(k)
                if 0 < fill[k] < capacity:
                    known[k] = own(bins[k])
        if not used:
            break
    return [b for b in bins if b]


def _cross(a: list[list[int]], b: list[list[int]], length: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    fill = _fills(b, length)
    full = [x for x, f in zip(b, fill) if f >= capacity - 2]
    if not full:
        full = [b[i] for i in sorted(range(len(b)), key=lambda i: -fill[i])[:max(1, len(b) // 4)]]
    a0 = int(rng.integers(len(full)))
    injected = [full[(a0 + k) % len(full)] for k in range(max(1, len(full) // 3))]
    inside = {x for s in injected for x in s}
    stay = [s for s in a if inside.isdisjoint(s)]
    lost = [x for s in a if not inside.isdisjoint(s) for x in s if x not in inside]
    return best_fit(lost, length, stay + injected, capacity)


def _mutate(bins: list[list[int]], length: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    fill = _fills(bins, length)
    poor, whole = [i for i, f in enumerate(fill) if f < capacity], [i for i, f in enumerate(fill) if f == capacity]
    if not poor:
        return bins
    # Full bins hold the short pieces that could close others.
    out = set(rng.choice(poor, min(len(poor), max(2, len(poor) // 30)), replace=False).tolist())
    if whole:
        out |= set(rng.choice(whole, min(len(whole), max(2, len(whole) // 40)), replace=False).tolist())
    return best_fit([x for i in sorted(out) for x in bins[i]], length, [b for i, b in enumerate(bins) if i not in out], capacity)


def _encode(bins: list[list[int]], n: int) -> bytes:
    of = np.empty(n, np.int32)
    for i, b in enumerate(bins):
        of[b] = i
    return of.tobytes()


def _decode(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def evolve(length: list[int], elites: list[bytes], seed: int, capacity: int, generations: int, population: int, patience: int = PATIENCE) -> bytes:
    """One island, one epoch: the best solution found, as the bin of every piece.

    Ends at the lower bound, or after ``patience`` generations that brought no fewer bins (``generations`` at most).
    """
    rng = np.random.default_rng(seed)
    judged = lambda s: (_fitness(s, length, capacity), s)
    rank = lambda pool: sorted(pool, key=lambda x: x[0], reverse=True)[:population]
    lower = lower_bound(length, capacity)
    pool = rank([judged(_decode(e)) for e in elites] or [judged(_exchange(best_fit(list(range(len(length))), length, [], capacity), length, capacity))])
    fewest, since = len(pool[0][1]), 0
    for _ in range(generations):
        if fewest <= lower or since >= patience:
            break
        pick = lambda: pool[int(rng.integers(len(pool)))][1]
        # The best solution mutated, and a crossed child.
        children = [_mutate(_cross(pick(), pick(), length, capacity, rng) if i % 2 else pool[0][1], length, capacity, rng) for i in range(max(1, population // 2))]
        pool = rank(pool + [judged(_exchange(s, length, capacity)) for s in children])
        since = 0 if len(pool[0][1]) < fewest else since + 1
        fewest = len(pool[0][1])
    return _encode(pool[0][1], len(length))


def _pack(pieces: DataFrame, block: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(_b, bin, key, length, fill): ``pieces`` (key, length) packed in blocks of about ``block`` pieces."""
    n = pieces.count()
    n_blocks = max(1, n // block)
    # Blocks by hash: each has the same mix of lengths and a bounded size.
    work = pieces.withColumn("_b", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(n_blocks)))
    groups = cut_lineage(work.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("p")))
    state = groups.select("_b", F.col("p.length").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("i"), F.array().cast("array<binary>").alias("e"))

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                out = []
                for b, i, l, e in zip(*(t.column(c).to_pylist() for c in ("_b", "i", "l", "e"))):
                    out.append(evolve(l, e, (b * 1009 + i) * 31 + number, capacity, generations, population))
                yield pa.record_batch({"_b": t.column("_b"), "i": t.column("i"), "l": t.column("l"), "best": pa.array(out, pa.binary())})
        return run

    for number in range(epochs):
        done = state.repartition(min(n_blocks * islands, 20_000), "_b", "i").mapInArrow(epoch(number), "_b long, i int, l array<bigint>, best binary")
        if number == epochs - 1:
            break
        ring = Window.partitionBy("_b").orderBy("i")
        first = F.first("best").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        # The neighbour's elite joins the own one; a block has ``islands`` rows.
        state = done.withColumn("e", F.array("best", F.coalesce(F.lead("best").over(ring), first))).select("_b", "l", "i", "e")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            of = [np.frombuffer(x, np.int32) for x in t.column("best").to_pylist()]
            n_bins = [len(np.unique(x)) for x in of]
            yield pa.record_batch({"_b": t.column("_b"), "i": t.column("i"), "n": pa.array(n_bins, pa.int32()), "of": pa.array([x.tolist() for x in of], pa.list_(pa.int32()))})

    solved = done.mapInArrow(bins, "_b long, i int, n int, of array<int>").groupBy("_b").agg(F.min_by("of", F.struct("n", "i")).alias("of"))
    flat = groups.join(solved, "_b").select("_b", F.explode(F.arrays_zip("of", "p")).alias("x")).select("_b", F.col("x.of").alias("bin"), F.col("x.p.key").alias("key"), F.col("x.p.length").alias("length"))
    return flat


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
         islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null or empty text is its end
    token. Only documents above ``capacity`` are cut: full pieces after a first one that may be
    shorter. Equal rows are packed one by one; a null id stays null. An empty table gives no rows.
    Other columns are ignored. Run again on the same rows, it gives the same lengths and sequences up to their numbers.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    pieces = plain.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = cut_lineage(pieces.withColumn("key", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity).select("key", "length")
    options = dict(capacity=capacity, islands=islands, epochs=epochs, generations=generations, population=population)
    first = cut_lineage(_pack(rest, block, **options))
    fill = first.groupBy("_b", "bin").agg(F.sum("length").alias("fill"))
    poor = fill.where(F.col("fill") < 0.97 * capacity).select("_b", "bin")
    good = first.join(poor, ["_b", "bin"], "left_anti")
    again = _pack(first.join(poor, ["_b", "bin"], "left_semi").select("key", "length"), block, **options)
    # Numbers: blocks and bins are below 2^31 each; the two rounds and full pieces have their own residues.
    number = (F.col("_b") * (1 << 31) + F.col("bin")) * 3
    placed = good.select("key", "length", number.alias("sequence_id")).union(again.select("key", "length", (number + 1).alias("sequence_id")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key")
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select("key", "sequence_id", "offset")
    whole = full.select("key", (F.col("key") * 3 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.union(whole), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
