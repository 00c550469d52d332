"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

All tokens of both sides are sorted by start and their ends are accumulated as a running maximum: a group ends where
a start reaches it. Inside a group an A and a B token are linked where their byte ranges overlap.

Neither tokenizer lets a token cross a single space between visible characters, so texts are cut there into parts;
every distinct part of a block is tokenised and aligned once. A block holds documents of bounded bytes. It
is one stored row: its documents as part numbers, its parts' links, and for each distinct link the number of
its documents. Counting links over the corpus and sending the counts back then moves one row per block and
distinct link, not one per document, and no link can have more rows than there are blocks.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopflow.llm.minhash import stored
from hoopflow.llm.bpe import _LATIN
from hoopflow.llm.text import row_slices, utf8

BLOCK_BYTES = 3 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of blanks that aren't ASCII; a space before one of them is never a cut.
_MAYBE_BLANK = _BLANK.copy()
_MAYBE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?)")] = True
#: Characters for which both libraries cut alike: Latin ones and plain blanks.
PLAIN = re.compile("[ \\n\\r\\t" + "".join(map(re.escape, _LATIN)) + "]+")
BLOCK = "payload binary, pair array<long>, pair_docs array<long>"
#: What only the block itself needs again is packed and compressed, so that wide rows stay small in storage and exchanges.
PACKED = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "size": pa.int32(), "parts": pa.int32(),
          "stream": pa.int32(), "stream_size": pa.int32(), "link_size": pa.int32(), "links": pa.int32()}
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and the number of each one's group in that order.

    A group breaks where a start reaches the running maximum of the ends.
    """
    order = np.lexsort((end, start))
    s, e = start[order], end[order]
    breaks = np.ones(len(s), bool)
    breaks[1:] = s[1:] >= np.maximum.accumulate(e)[:-1]
    return order, np.cumsum(breaks) - 1


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with first[i] <= j < last[i]."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def split_parts(texts: pa.Array, lead: bool = True, fine: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Parts of every text, with ``lead`` after a space, dictionary-encoded, and the part offsets of the texts. Null and empty have none.

    ``fine`` also cuts between an ASCII letter and a mark of ``_MARK``, where only byte-level pre-tokens are sure to end.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    led = texts if not lead else pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, offsets = utf8(led)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        cut[1:-2] = (data[1:-1] == 0x20) & ~_BLANK[data[:-2]] & ~_MAYBE_BLANK[data[2:]]
        # The last byte of a text has no successor of its own.
        cut[offsets[1:] - 1] = False
        if fine:
            cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    at = np.flatnonzero(cut).astype(np.int64)
    if not len(data):
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
    return parts.dictionary_encode(), np.searchsorted(at, offsets)


class Aligner:
    """Tokens of a block's distinct parts by both files, aligned. Nothing is kept from one block to the next."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        n_a = max(names.values()) + 1
        self.size_a = np.zeros(n_a, np.int64)
        for t, i in names.items():
            self.size_a[i] = len(t)
        # The same vocabulary as ranks encodes parts of Latin characters faster, with the same ids.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        import public_tokenizers
        import tiktoken
        self.fast_a = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: a piece goes over a word's end, so parts can't be tokenised alone")
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.blank = self.b.piece_to_id("▁")
        # Ids with the sign behind them: A inside and at the end of its side, B inside and at the end of the group.
        self.spell = [f"{i}{c}" for c, n in ((",", n_a), ("|", n_a), (",", self.n_b), (";", self.n_b)) for i in range(n)]

    def _tokens(self, parts: list[str], size: np.ndarray) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of every part on both sides, and which parts come back as their bytes; the others have no ids."""
        fast = self.fast_a
        a = [fast(p) if PLAIN.fullmatch(p) else None for p in parts]
        slow = [i for i, x in enumerate(a) if x is None]
        for i, e in zip(slow, self.a.encode_batch([parts[i] for i in slow], add_special_tokens=False)):
            a[i] = e.ids
        # The library of B puts a space in front itself, and gives nothing for no text.
        b = [x or [self.blank] for x in self.b.encode([p[1:] for p in parts], num_threads=1)]
        spell = self.bytes_b.__getitem__
        sound = np.ones(len(parts), bool)
        if b"".join(map(spell, itertools.chain.from_iterable(b))) != "".join(parts).encode():
            sound = np.array([b"".join(map(spell, x)) == p.encode() for x, p in zip(b, parts)], bool)
        n = np.fromiter(map(len, a), np.int64, len(a))
        total = np.append(0, np.cumsum(self.size_a[np.fromiter(itertools.chain.from_iterable(a), np.int64, int(n.sum()))]))
        end = np.cumsum(n)
        sound &= total[end] - total[end - n] == size
        for i in np.flatnonzero(~sound).tolist():
            a[i], b[i] = [], []
        return a, b, sound

    def block(self, ids: pa.Array, texts: pa.Array) -> dict[str, np.ndarray | pa.Array | list]:
        """One block: its documents, its parts and its distinct links."""
        coded, offsets = split_parts(texts)
        parts = coded.dictionary.to_pylist()
        n_parts = len(parts)
        size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b, sound = self._tokens(parts, size)
        n_a, n_b = np.fromiter(map(len, a), np.int64, n_parts), np.fromiter(map(len, b), np.int64, n_parts)
        ids_a = np.fromiter(itertools.chain.from_iterable(a), np.int64, int(n_a.sum()))
        ids_b = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(n_b.sum()))
        # Both sides tile the parts' bytes without gaps, so ends are running sums of sizes.
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        start_a, start_b = end_a - self.size_a[ids_a], end_b - self.size_b[ids_b]
        order, group = coalesce(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
        of = np.empty(len(order), np.int64)
        of[order] = group
        group_a, group_b = of[:len(ids_a)], of[len(ids_a):]
        # Inside its group, an A token overlaps the B tokens from the first that ends after its start to the last that starts before its end.
        low = np.maximum(np.searchsorted(end_b, start_a, "right"), np.searchsorted(group_b, group_a, "left"))
        high = np.minimum(np.searchsorted(start_b, end_a, "left"), np.searchsorted(group_b, group_a, "right"))
        i, j = expand(low, high)
        pair, place = np.unique(ids_a[i] * self.n_b + ids_b[j], return_inverse=True)
        n_groups = int(group[-1]) + 1 if len(group) else 0
        # Spelled in order of group and side: each id with the sign that follows it.
        last_a, last_b = np.append(np.diff(group_a), 1) > 0, np.append(np.diff(group_b), 1) > 0
        n_a_ids = len(self.size_a)
        code = np.concatenate([ids_a + n_a_ids * last_a[:len(ids_a)], 2 * n_a_ids + ids_b + self.n_b * last_b[:len(ids_b)]])
        stream = code[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        # Parts begin where both sides begin, so a part's groups and links lie together.
        part_a, part_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        part_g = np.append(group_a, n_groups)[part_a]
        part_l = np.searchsorted(i, part_a)
        counts = np.stack([np.diff(part_a), np.diff(part_b), np.diff(part_g), np.diff(part_l)], 1) if n_parts else np.zeros((0, 4), np.int64)

        part = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        # One part that doesn't come back whole leaves its document without tokens.
        lost = np.zeros(len(texts), bool)
        lost[doc[~sound[part]]] = True
        keep = ~lost[doc]
        doc, part = doc[keep], part[keep]
        sums = [np.bincount(doc, counts[part, c], len(texts)).astype(np.int64) for c in range(4)]
        # Distinct (document, link): each distinct part of a document gives its links.
        once = np.unique(doc * (n_parts + 1) + part)
        d, p = once // (n_parts + 1), once % (n_parts + 1)
        x, y = expand(part_l[p], part_l[p + 1])
        seen = np.unique(d[x] * (len(pair) + 1) + place[y])
        docs_of = np.bincount(seen % (len(pair) + 1), minlength=len(pair))[:len(pair)]
        return {"doc_id": ids, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "size": np.bincount(doc, minlength=len(texts)), "parts": part,
                "stream": stream, "stream_size": np.diff(part_a + part_b), "link_size": counts[:, 3], "links": place, "pair": pair, "pair_docs": docs_of}


@functools.lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _one(values, kind: pa.DataType) -> pa.Array:
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind))


def _pack(block: dict) -> bytes:
    row = pa.record_batch({c: _one(block[c], t) for c, t in PACKED.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _blocks(path_a: str, path_b: str, block_bytes: int, n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        if aligner.n_b > n_b:
            raise ValueError(f"{path_b} has more than {n_b} pieces")
        for batch in batches:
            text = batch.column("_text")
            for lo, hi in row_slices(utf8(text)[1], block_bytes):
                b = aligner.block(batch.column("doc_id").slice(lo, hi - lo), text.slice(lo, hi - lo))
                pair = b["pair"] // aligner.n_b * n_b + b["pair"] % aligner.n_b
                # Freed buffers go back to the system: a worker shares its memory with the executor.
                pa.default_memory_pool().release_unused()
                yield pa.record_batch({"payload": pa.array([_pack(b)], pa.binary()), "pair": _one(pair, pa.int64()), "pair_docs": _one(b["pair_docs"], pa.int64())})
    return run


def _finish(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = _aligner(path_a, path_b).spell.__getitem__
        for batch in batches:
            for r in range(batch.num_rows):
                with pa.ipc.open_stream(batch.column("payload")[r].as_py()) as stream:
                    packed = stream.read_next_batch()
                num = lambda c: packed.column(c).flatten().to_numpy(zero_copy_only=False)
                ids = packed.column("doc_id").flatten()
                n, size, part, link_size, links = len(ids), num("size"), num("parts"), num("link_size"), num("links")
                back = batch.column("back")[r]
                value = back.values.to_numpy(zero_copy_only=False) if back.is_valid else np.zeros(0, np.int64)
                # Sums over a part's links, then over a document's parts; counts are whole numbers far below 2^53.
                of = np.repeat(np.arange(len(link_size)), link_size)
                doc = np.repeat(np.arange(n), size)
                over = lambda v: np.bincount(doc, np.bincount(of, v[links], len(link_size))[part], n).astype(np.int64)
                n_best, count_sum = over(value & 1), over(value >> 1)
                # A part's groups end in the sign between groups.
                ends = np.cumsum(np.append(0, num("stream_size"))).tolist()
                pieces = list(map(spell, num("stream").tolist()))
                groups = ["".join(pieces[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                width = np.fromiter(map(len, groups), np.int64, len(groups))
                cuts = np.cumsum(np.append(0, size))
                letters = np.append(0, np.cumsum(width[part]))[cuts]
                order, cut = part.tolist(), cuts.tolist()
                # Documents go out a bounded number of letters at a time.
                for a, b in row_slices(letters, 1 << 23):
                    spelled = ["".join(map(groups.__getitem__, order[cut[k]:cut[k + 1]]))[:-1] for k in range(a, b)]
                    yield pa.record_batch({"doc_id": ids.slice(a, b - a), **{c: pa.array(num(c)[a:b]) for c in ("n_a", "n_b", "n_groups", "n_links")},
                                           "n_best": pa.array(n_best[a:b]), "count_sum": pa.array(count_sum[a:b]), "groups": pa.array(spelled, pa.string())})
    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, n_b: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every document.

    A (a ``tokenizers`` byte-level file) encodes space + text, B (a ``sentencepiece`` model with byte fallback and without
    normalisation) the text, to which it adds the space. Strings of special tokens are plain text. ``groups`` is
    ``a1,a2|b1;a3|b2,b3`` in order. The count of a linked id pair is the number of documents that hold it linked;
    ``count_sum`` adds it over a document's links, and ``n_best`` counts links whose count is the
    highest of their A id. Texts that are null or empty, or whose tokens' joined bytes differ from space + text,
    have zeros and an empty ``groups``, and count nowhere. Every row is a document, repeated ids included; a null id stays
    null; an empty table gives no rows; other columns are ignored. Texts are never cut short: one longer than
    ``block_bytes`` is a block of its own. ``n_b`` is above the number of B's pieces.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    paths = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    blocks = stored(plain.mapInArrow(_blocks(*paths, block_bytes, n_b), BLOCK).withColumn("block", F.monotonically_increasing_id()))
    held = blocks.select("block", F.explode(F.arrays_zip("pair", "pair_docs")).alias("x")).select("block", F.col("x.pair").alias("pair"), F.col("x.pair_docs").alias("n"))
    # A link has at most one row a block, and an A id at most as many pairs as B has ids.
    counts = held.where("n > 0").groupBy("pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.expr(f"pair div {n_b}")))
    value = counts.select("pair", (F.col("n") * 2 + (F.col("n") == top).cast("long")).alias("value"))
    back = (held.select("block", "pair").join(value, "pair", "left").groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct("pair", F.coalesce("value", F.lit(0)).alias("value")))).alias("back"))
            .select("block", F.col("back.value").alias("back")))
    return blocks.select("block", "payload").join(back, "block", "left").drop("block").mapInArrow(_finish(*paths), RESULT)
