"""Substring removal on words: seed and extend.

Winnowing picks seeds: of the k-word grams in every window the smallest hash. Documents are
joined on equal seeds; around a seed a match is extended both ways through every window that
holds it, compared with the earliest place of that window. Maximal runs of matched windows
are the repeats of at least ``length`` words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hoopflow.llm.repeats import GROUP_BYTES, HOT_GROUPS, LAST, Method, expand, repeated_windows
from hoopflow.llm.text import mix, word_hashes

SEED_WORDS = 9


def repeated_earlier(doc, start, count, content):
    """Per window of every seed's run: does the same window start earlier (id, then position)?"""
    h = content.view(np.uint64)
    d, s = np.repeat(doc, count), expand(start, count)
    order = np.lexsort((s, d, h))
    ho, do, so = h[order], d[order], s[order]
    first = np.ones(len(h), bool)
    first[1:] = ho[1:] != ho[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    out = np.empty(len(h), bool)
    out[order] = (do > do[head]) | (so > so[head])
    return out


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """Remove each word covered by a ``length``-word window that also starts earlier.

    Earlier means in a row with a smaller id, or in the same document further left. Returns
    doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space).
    Null or empty text has no words; fewer than ``length`` words stay whole; of two rows with
    one id only a later position is removed; a null id counts as larger than any other. An
    empty table gives no rows. Other columns are ignored.
    """
    if length < 2:
        raise ValueError("length must be at least 2")

    def content(data, offsets, h, rows, p):
        at = expand(rows[p.row] + p.start, p.count)
        acc = np.zeros(len(at), np.uint64)
        for j in range(length):
            acc = acc * np.uint64(0xA24BAED4963EE407) + h[at + j]
        return mix(acc).view(np.uint8)

    def finish(table: pa.Table, covered) -> pa.Table:
        ids = [None if x == LAST else x for x in table.column("_id").to_pylist()]
        out = []
        for i, text in enumerate(table.column("_text").to_pylist()):
            words = text.encode().split()
            mask = covered(i, len(words))
            kept = words if mask is None else [w for w, bad in zip(words, mask.tolist()) if not bad]
            joined = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
        c = list(zip(*out)) or [()] * 4
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(c[0], pa.int64()), "n_removed": pa.array(c[1], pa.int64()),
                         "kept_sha256": pa.array(c[2], pa.string()), "kept": pa.array(c[3], pa.string())})

    method = Method(length, max(1, min(SEED_WORDS, length // 2)), True, word_hashes, content, lambda count: count * 8,
                    lambda doc, start, count, content, sizes: repeated_earlier(doc, start, count, content), finish,
                    "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return repeated_windows(docs, method, id_col, text_col, group_bytes, hot_groups)
