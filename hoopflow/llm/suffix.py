"""Suffix-array removal of repeated byte strings by prefix-free parsing.

Window-minimum triggers (the smallest gram hash of each window) cut every document into phrases; neighbouring phrases overlap by
``length - 1`` bytes, so each string of ``length`` bytes lies in exactly one phrase and the
order of two suffixes down to that depth is settled inside their phrases. The distinct
phrases are the dictionary: their suffixes are sorted (one suffix array per trigger bucket),
equal neighbours share a rank. The parse (which document holds which phrase) then gives
every rank its first document. Highly repetitive text costs its dictionary only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hoopflow.llm.repeats import GROUP_BYTES, HOT_GROUPS, LAST, Method, expand, repeated_windows

_CODE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
TRIGGER = 24


def _symbols(data, offsets):
    return _CODE[data], offsets


def _sort_suffixes(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix ``text[at:at + length]``; equal strings share a rank."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text) + 1, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + len(word)]
    if length >= 8:
        keys = [word[at + o] for o in [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])]
    else:
        keys = [word[at] >> np.uint64(8 * (8 - length))]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), np.int64)
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def repeated_in_smaller(doc, count, content, sizes, length):
    """Per window of every phrase: does its string occur in a document with a smaller id?"""
    raw, cut = content.tobytes(), np.cumsum(sizes) - sizes
    ids: dict[bytes, int] = {}
    phrase = np.fromiter((ids.setdefault(raw[a:a + n], len(ids)) for a, n in zip(cut.tolist(), sizes.tolist())), np.int64, len(sizes))
    first = np.full(len(ids), LAST, np.int64)
    np.minimum.at(first, phrase, doc)
    dictionary = np.frombuffer(b"".join(ids), np.uint8)
    own = np.fromiter(map(len, ids), np.int64, len(ids))
    windows = own - length + 1
    rank = _sort_suffixes(dictionary, expand(np.cumsum(own) - own, windows), length)
    earliest = np.full(int(rank.max()) + 1, LAST, np.int64)
    np.minimum.at(earliest, rank, np.repeat(first, windows))
    begin = np.cumsum(windows) - windows
    return earliest[rank[expand(begin[phrase], count)]] < np.repeat(doc, count)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).
    A null text is empty; a text shorter than ``length`` stays whole; rows with equal ids do
    not remove each other; a null id counts as larger than any other. An empty table gives no
    rows. Other columns are ignored.
    """
    if length < 2:
        raise ValueError("length must be at least 2")

    def content(data, offsets, h, rows, p):
        return data[expand(rows[p.row] + p.start, p.count + length - 1)]

    def finish(table: pa.Table, covered) -> pa.Table:
        ids = [None if x == LAST else x for x in table.column("_id").to_pylist()]
        out = []
        for i, text in enumerate(table.column("_text").to_pylist()):
            raw = text.encode()
            mask = covered(i, len(raw))
            if mask is None:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                continue
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
            out.append((len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*out)) or [()] * 5
        return pa.table({"doc_id": pa.array(ids, pa.int64()), **{n: pa.array(c[j], pa.int64()) for j, n in enumerate(("n_bytes", "n_removed", "n_spans"))},
                         "kept_sha256": pa.array(c[3], pa.string()), "kept": pa.array(c[4], pa.binary())})

    method = Method(length, max(1, min(TRIGGER, length // 2)), False, _symbols, content, lambda count: count + length - 1,
                    lambda doc, start, count, content, sizes: repeated_in_smaller(doc, count, content, sizes, length), finish,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return repeated_windows(docs, method, id_col, text_col, group_bytes, hot_groups)
