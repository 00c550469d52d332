"""Encoding by byte-pair merges, speculated and verified, and decoding.

Greedy longest-match proposes the tokens of a word. They are its encoding exactly if no merge ever crosses the
border of two neighbours, so every adjacent pair is checked, all pairs of a batch at once. Only words with a failing
pair are merged step by step.

Why the check is enough: a merge has a larger rank than the merges of its parts, so merging runs in the order of
ranks. At the border of tokens a and b stand, over time, the parts on a's right edge and on b's left edge. A merge
of two such parts of rank r happens first if r is below the rank that uses up the left part, and not above the rank
that uses up the right part (equal ranks go from left to right). Tokens that merging would not give for their own
bytes are never proposed.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hoopflow.llm.text import row_slices, utf8

_NEVER = np.int64(2**62)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Merges:
    """Merge table of a vocabulary whose ids follow the order of the merges.

    ``first`` is the number of single symbols: they have the ids below it, and merge number r makes id ``first + r``.
    """

    def __init__(self, pairs: list[tuple[int, int]], first: int):
        self.first = first
        self.n = first + len(pairs)
        self.left = np.concatenate([np.arange(first), np.array([a for a, _ in pairs], np.int64)]) if pairs else np.arange(first)
        self.right = np.concatenate([np.arange(first), np.array([b for _, b in pairs], np.int64)]) if pairs else np.arange(first)
        self.rank = {p: first + i for i, p in enumerate(pairs)}
        code = self.left[first:] * self.n + self.right[first:]
        order = np.argsort(code, kind="stable")
        self.codes, self.made = code[order], order + first
        # A token is what merging gives for its bytes if both parts are, and nothing merges across them earlier.
        sound = [True] * first
        apart = self.compatible(self.left[first:], self.right[first:], np.arange(first, self.n))
        for ok, l, r in zip(apart.tolist(), self.left[first:].tolist(), self.right[first:].tolist()):
            sound.append(ok and sound[l] and sound[r])
        self.sound = np.array(sound, bool)
        self._trie()

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id that the pair merges to, or a number above all ids."""
        if not len(self.codes):
            return np.full(len(a), _NEVER)
        code = a * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.made[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, user: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of tokens stays apart; ``user`` is the merge that joins the whole pair, if one does."""
        a, b = np.asarray(a, np.int64).copy(), np.asarray(b, np.int64).copy()
        top = np.full(len(a), _NEVER) if user is None else np.asarray(user, np.int64)
        use_a, use_b = top.copy(), top - (user is not None)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self._merged(x, y)
            hit = (r < use_a[live]) & (r <= use_b[live])
            good[live[hit]] = False
            # Back in time: the part that was made last comes apart; of equal ones the right one was.
            step_a = x > y
            more = ~hit & (np.maximum(x, y) >= self.first)
            la, lb = live[more & step_a], live[more & ~step_a]
            use_a[la], a[la] = a[la], self.right[a[la]]
            use_b[lb], b[lb] = b[lb], self.left[b[lb]]
            live = live[more]
        return good

    def _trie(self) -> None:
        """Transitions of the trie of all sound tokens, as sorted keys node * symbols + symbol."""
        spelled: list[tuple[int, ...]] = [(i,) for i in range(self.first)]
        for l, r in zip(self.left[self.first:].tolist(), self.right[self.first:].tolist()):
            spelled.append(spelled[l] + spelled[r])
        step: dict[int, int] = {}
        ends = [-1]
        for i, (word, ok) in enumerate(zip(spelled, self.sound.tolist())):
            if not ok:
                continue
            node = 0
            for s in word:
                key = node * self.first + s
                node = step.get(key, -1)
                if node < 0:
                    node = step[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        keys = np.fromiter(step.keys(), np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        self.ends = np.array(ends, np.int64)
        self.size = np.array([len(w) for w in spelled], np.int64)

    def propose(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words and their offsets per word."""
        total = len(symbols)
        last = np.repeat(offsets[1:], np.diff(offsets))
        best = symbols.copy()
        live = np.arange(total)
        node = np.zeros(total, np.int64)
        depth = 0
        # Longest token at every position, for all positions together.
        while len(live):
            key = node * self.first + symbols[live + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, node = live[ok], self.nodes[at[ok]]
            end = self.ends[node]
            best[live[end >= 0]] = end[end >= 0]
            depth += 1
            ok = live + depth < last[live]
            live, node = live[ok], node[ok]
        after = np.arange(total) + self.size[best]
        taken = np.zeros(total, bool)
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        while len(at):
            taken[at] = True
            nxt = after[at]
            at = nxt[nxt < last[at]]
        where = np.flatnonzero(taken)
        return best[where], np.searchsorted(where, offsets)

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word: lowest rank first, then leftmost."""
        ids = list(symbols)
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (s := get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            h = prev[i]
            if h >= 0 and (s := get((ids[h], r))) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return [t for t in ids if t >= 0]

    def merge_all(self, symbols: np.ndarray, offsets: np.ndarray, width: int = 48) -> list[np.ndarray]:
        """Exact merging of many words: one merge of every word a step, words above ``width`` symbols one by one."""
        size = np.diff(offsets)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(size)
        for i in np.flatnonzero(size > width).tolist():
            out[i] = np.array(self.merge(symbols[offsets[i]:offsets[i + 1]].tolist()), np.int64)
        # Words of equal length form a matrix; each step shortens it by one column.
        for n in np.unique(size[(size > 0) & (size <= width)]).tolist():
            which = np.flatnonzero(size == n)
            ids = symbols[offsets[which][:, None] + np.arange(n)].astype(np.int64)
            rank = self._merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), n - 1)
            while True:
                at = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
                best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), _NEVER)
                done = best == _NEVER
                for i, row in zip(which[done].tolist(), ids[done]):
                    out[i] = row
                which, ids, rank, at, best = which[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(which):
                    break
                rows, col = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
                ids[rows, at] = best
                col = np.arange(rank.shape[1] - 1)
                rank = np.take_along_axis(rank, col + (col >= at[:, None]), 1)
                left, right = at > 0, at < ids.shape[1] - 1
                rank[rows[left], at[left] - 1] = self._merged(ids[rows[left], at[left] - 1], best[left])
                rank[rows[right], at[right]] = self._merged(best[right], ids[rows[right], at[right] + 1])
        return out

    def encode(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], int]:
        """Little-endian 32-bit tokens of every word (words are not empty), and how many words had to be merged."""
        if len(offsets) < 2:
            return [], 0
        tokens, cuts = self.propose(symbols, offsets)
        a, b = tokens[:-1], tokens[1:]
        inner = np.ones(max(len(tokens) - 1, 0), bool)
        inner[cuts[1:-1] - 1] = False
        code, back = np.unique(a[inner] * self.n + b[inner], return_inverse=True)
        good = self.compatible(code // self.n, code % self.n)
        bad = np.flatnonzero(inner)[~good[back]]
        failed = np.unique(np.searchsorted(cuts, bad, "right") - 1)
        raw, ends = tokens.astype("<u4").tobytes(), (cuts * 4).tolist()
        out = [raw[x:y] for x, y in zip(ends[:-1], ends[1:])]
        size = offsets[failed + 1] - offsets[failed]
        first = np.cumsum(np.append(0, size))
        flat = symbols[np.arange(first[-1]) - np.repeat(first[:-1] - offsets[failed], size)]
        for w, ids in zip(failed.tolist(), self.merge_all(flat, first)):
            out[w] = ids.astype("<u4").tobytes()
        return out, len(failed)


#: Characters whose letters, numbers and lower case are the same in every Unicode version, with no composition among them.
_LATIN = [chr(i) for i in range(0x21, 0x250) if chr(i).isprintable()]
_LATIN_PART = re.compile("[" + "".join(map(re.escape, _LATIN)) + "]+")
_L, _N = ("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind) for kind in "LN")
_LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+")


class WordEncoder:
    """Ids of texts for the lower-casing byte-pair vocabulary with word ends at ``path``.

    No word crosses an ASCII blank, so texts are cut there and every distinct part is encoded once, in batches of
    parts. Parts of Latin characters are cut into words here; others by the normaliser and pre-tokeniser of the
    file. What is remembered is emptied at ``limit`` characters.
    """

    def __init__(self, path: str, limit: int = 1 << 24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], len(vocab) - len(pairs))
        # Bytes are spelled by one character each: visible ones by themselves, the others by those from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inside, self.ending = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in self.byte_of.items():
            self.inside[b], self.ending[b] = vocab[c], vocab[c + suffix]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = os.path.commonprefix(list(self.special))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.limit, self.n_words, self.n_merged = limit, 0, 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.held = 0

    def _split(self, part: str) -> list[bytes]:
        if _LATIN_PART.fullmatch(part):
            low = part.lower()
            # One capital becomes two characters, the second of which isn't Latin.
            if "\u0307" not in low:
                return [w.encode() for w in _LATIN_WORD.findall(low)]
        lib = self.library
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))]

    def _learn(self, parts: list[str]) -> None:
        """Adds parts that aren't known; all their new words are encoded together."""
        plans: list[list] = []
        for p in parts:
            if self.special and self.mark in p:
                plan: list = []
                for s in self.cut.split(p):
                    if s in self.special:
                        plan.append(self.special[s])
                    elif s:
                        plan += self._split(s)
                plans.append(plan)
            else:
                plans.append(self._split(p))
        words = self.words
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(plans)) if w not in words and isinstance(w, bytes)]
        size = np.fromiter(map(len, new), np.int64, len(new))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        raw = np.frombuffer(b"".join(new), np.uint8)
        symbols = self.inside[raw]
        symbols[offsets[1:] - 1] = self.ending[raw[offsets[1:] - 1]]
        ids, failed = self.merges.encode(symbols, offsets)
        words.update(zip(new, ids))
        self.n_words += len(new)
        self.n_merged += failed
        for p, plan in zip(parts, plans):
            self.known[p] = words[plan[0]] if len(plan) == 1 and isinstance(plan[0], bytes) else b"".join(
                words[w] if isinstance(w, bytes) else np.uint32(w).astype("<u4").tobytes() for w in plan)
        self.held += 5 * int(size.sum()) + 2 * sum(map(len, parts))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of every text; null is empty."""
        if self.held > self.limit:
            self._forget()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        known = self.known
        self._learn([p for p in parts if p not in known])
        ids = list(map(known.__getitem__, parts))
        offsets = split.offsets.to_numpy()
        at = coded.indices.to_numpy(zero_copy_only=False).tolist()
        first = offsets[0]
        return [b"".join(map(ids.__getitem__, at[a - first:b - first])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of whole texts.

    Equal to the ids of the ``tokenizers`` file at ``path`` without added special tokens, truncation or padding; the
    strings of special tokens inside a text become their ids. A null or empty text has no ids. Rows are independent:
    repeated rows give repeated results, a null id stays null, an empty table gives no rows, other columns are
    ignored. A text is never cut; memory holds one text and the remembered parts.
    """
    at = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(at)
        for batch in batches:
            text = batch.column("_text")
            for a, b in row_slices(utf8(text)[1]):
                ids = encoder(text.slice(a, b - a))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                       "ids": pa.array(ids, pa.binary())})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


@functools.lru_cache(maxsize=2)
def _spellings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``: the entries of all ids, special ones included, joined by one space.

    That is how a vocabulary without a decoder of its own is decoded. No ids give an empty text.
    """
    at = path or tokenizer_path()
    names = [f.name for f in encoded.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = _spellings(at).__getitem__
        for batch in batches:
            ids = batch.column("ids")
            # One entry is a few bytes; slices of ids keep the decoded texts of a batch small.
            size = np.array([0 if x is None else x for x in pc.binary_length(ids).to_pylist()], np.int64)
            for a, b in row_slices(np.concatenate([[0], np.cumsum(size)]), 1 << 22):
                part = batch.slice(a, b - a)
                text = [" ".join(map(spell, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(text, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
