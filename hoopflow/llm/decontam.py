"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on the Karp-Rabin hashes of ``seed``-word runs.
For each item of which a document holds enough seeds, the longest match of unmarked words is
marked as a tile again and again; the tiled share of the item is its coverage. Order
does not matter to it, so reordered passages count.

The benchmark is the query set: blocks of at most ``block_words`` words (so of a fixed size) are
sent to the executors one after the other, and each block sees all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopflow.llm.repeats import expand
from hoopflow.llm.text import gram_hashes, row_slices, utf8, word_hashes

SEED, COVERAGE, BLOCK_WORDS = 5, 0.5, 500_000


def tiles(item_at: np.ndarray, doc_at: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, words) from seed positions, longest first.

    Ties go to the smaller item start, then document start. Each word is in one tile at most.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    i, d = item_at[order], (doc_at - item_at)[order]
    new = np.ones(len(i), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    todo = [(-(n + seed - 1), int(a), int(a + x)) for a, x, n in zip(i[first], d[first], np.diff(np.append(first, len(i))).tolist())]
    import heapq
    heapq.heapify(todo)
    used_item, used_doc, out = set(), set(), []
    while todo:
        n, a, b = heapq.heappop(todo)
        free = [a + k not in used_item and b + k not in used_doc for k in range(-n)]
        if all(free):
            out.append((a, b, -n))
            used_item.update(range(a, a - n))
            used_doc.update(range(b, b - n))
            continue
        k = 0
        while k < -n:  # what is left between marked words competes again
            if not free[k]:
                k += 1
                continue
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= seed:
                heapq.heappush(todo, (-(e - k), a + k, b + k))
            k = e
    return out


def _scan(block, seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, begin, item, at, size, names = block.value
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            out = []
            for i, j in row_slices(offsets):
                h, rows = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower=True)
                g = gram_hashes(h, seed)
                place = np.flatnonzero(sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
                k = np.minimum(np.searchsorted(keys, g[place]), len(keys) - 1)
                hit = keys[k] == g[place]
                place, k = place[hit], k[hit]
                row = np.searchsorted(rows, place, "right") - 1
                inside = place + seed <= rows[row + 1]
                place, k, row = place[inside], k[inside], row[inside]
                count = begin[k + 1] - begin[k]
                which = expand(begin[k], count)
                place, row, it, pos = np.repeat(place, count), np.repeat(row, count), item[which], at[which]
                order = np.lexsort((pos, it, row))
                place, row, it, pos = place[order], row[order], it[order], pos[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (it[1:] != it[:-1])
                edge = np.append(np.flatnonzero(new), len(row))
                for a, b in zip(edge[:-1], edge[1:]):
                    n = int(size[it[a]])
                    distinct = np.unique(pos[a:b])
                    reach = int(np.minimum(np.diff(distinct), seed).sum()) + seed
                    if reach < coverage * n:
                        continue
                    t = tiles(pos[a:b], place[a:b] - rows[row[a]], min(seed, n))
                    covered = sum(x[2] for x in t)
                    if covered >= coverage * n:
                        out.append((i + int(row[a]), names[it[a]], len(t), covered, n))
            c = list(zip(*out)) or [()] * 5
            yield pa.record_batch({"_key": batch.column("_key").take(pa.array(c[0], pa.int64())), "item_id": pa.array(c[1], pa.int64()), "n_tiles": pa.array(c[2], pa.int64()),
                                   "covered": pa.array(c[3], pa.int64()), "item_words": pa.array(c[4], pa.int64())})
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """Items streamed to the driver partition by partition, in blocks of a bounded size."""
    block, words = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        n = len(r.t.split())
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((r.i, r.t))
        words += n
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            seed: int = SEED, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(_key, item_id, n_tiles, covered, item_words) of every document and item with at least ``coverage`` of the item tiled."""
    spark = docs.sparkSession
    schema = "_key long, item_id long, n_tiles long, covered long, item_words long"
    out = spark.createDataFrame([], schema)
    plain = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        data, offsets = utf8(pa.array([t for _, t in block]))
        h, rows = word_hashes(data, offsets, lower=True)
        g = gram_hashes(h, seed)
        size = np.diff(rows)
        count = np.maximum(size - seed + 1, 0)
        item = np.repeat(np.arange(len(block)), count)
        at = expand(np.zeros(len(block), np.int64), count)
        value = g[rows[:-1][item] + at] if len(item) else np.zeros(0, np.uint64)
        if not len(value):
            continue
        order = np.argsort(value, kind="stable")
        keys, first = np.unique(value[order], return_index=True)
        sent = spark.sparkContext.broadcast((keys, np.append(first, len(value)), item[order], at[order], size, [i for i, _ in block]))
        out = out.union(plain.mapInArrow(_scan(sent, seed, coverage), schema))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per distinct document id: doc_id, n_items, item_id (best covered, smallest on ties), coverage, contaminated, kept.

    Null or empty texts, and items of fewer than ``seed`` words, match nothing. Rows with one id
    count as one document, contaminated if any row is. A null id is one document. Repeated items each
    count. Empty tables are allowed: without benchmark all is kept. Other columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(np.iinfo(np.int64).max))
    work = docs.select(key.alias("_key"), F.col(text_col).alias("text"))
    found = matches(work, benchmark, "_key", "text", seed=seed, coverage=coverage, block_words=block_words)
    best = found.groupBy("_key").agg(F.count("*").alias("n_items"), F.max_by("item_id", F.struct(F.expr("covered / item_words"), -F.col("item_id"))).alias("item_id"), F.max(F.expr("covered / item_words")).alias("coverage"))
    return (work.select("_key").distinct().join(best, "_key", "left")
            .select(F.nullif("_key", F.lit(np.iinfo(np.int64).max)).alias("doc_id"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
                    F.col("n_items").isNotNull().alias("contaminated"), F.col("n_items").isNull().alias("kept")))
