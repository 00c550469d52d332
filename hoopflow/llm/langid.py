"""Language identification in two levels.

A text's byte trigrams, hashed, are its features. Linear support vector machines (one against
the rest) pick the language family; inside it one-versus-one machines vote for the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopflow.llm.text import row_slices, utf8

#: Training documents per language and hashed dimensions.
SAMPLE, DIMS = 400, 1 << 13
#: Families of ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0x21, 0x41), 0x0A, 0x09, 0x0D, *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram at every byte; digits and ASCII punctuation count as blanks."""
    b = np.concatenate([_FOLD[data], np.full(2, 32, np.uint32)])
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    code = code * np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - 13)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("_text"))
        out = []
        for i in range(batch.num_rows):
            k, c = np.unique(trigrams(data[offsets[i]:offsets[i + 1]]), return_counts=True)
            out.append((k.astype(np.uint16).tobytes(), (c / max(1, c.sum())).astype(np.float32).tobytes()))
        yield pa.record_batch({"_id": batch.column("_id"), "lang": batch.column("lang"), "k": pa.array([o[0] for o in out], pa.binary()), "c": pa.array([o[1] for o in out], pa.binary())})


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Squared-hinge linear machine, accelerated gradient; y is 1 or -1; the last column of x is constant."""
    w, prev = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    lipschitz = 1 + 2 * cost * float((weight[:, None] * x**2).sum() / max(1, len(x))) * 2
    for t in range(rounds):
        z = w + (t / (t + 3)) * (w - prev)
        slack = np.maximum(0, 1 - y * (x @ z)) * weight
        grad = z - 2 * cost * (x.T @ (slack * y)) / len(x)
        prev, w = w, z - grad / lipschitz
    return w


def _balance(y: np.ndarray) -> np.ndarray:
    pos = max(1, (y > 0).sum())
    neg = max(1, (y < 0).sum())
    return np.where(y > 0, len(y) / 2 / pos, len(y) / 2 / neg).astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """``docs`` (_id, _text, lang), training rows only. Per language the ``sample`` documents with the smallest id hashes."""
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id")
    known = docs.where("lang is not null and _id is not null and _text rlike '\\\\p{L}'").select("_id", "lang").withColumn("r", F.row_number().over(pick)).where(f"r <= {sample}").select("_id", "lang")
    rows = docs.join(known, ["_id", "lang"], "left_semi").select("_id", "lang", "_text").mapInArrow(_counts, "_id long, lang string, k binary, c binary").orderBy("_id", "lang", "k", "c").collect()
    langs = sorted({r.lang for r in rows})
    family = {c: _FAMILY.get(c, f"own:{c}") for c in langs}
    names = sorted(set(family.values()))
    x = np.zeros((len(rows), DIMS + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.k, np.uint16)] = np.frombuffer(r.c, np.float32) * 100
    x[:, DIMS] = 1
    lang = np.array([r.lang for r in rows])
    fam = np.array([family[c] for c in lang])
    columns, weights = [], []
    for f in names if len(names) > 1 else []:
        y = np.where(fam == f, 1, -1).astype(np.float32)
        columns.append(("family", f, None))
        weights.append(fit_svm(x, y, _balance(y)))
    for f in names:
        for a, b in combinations([c for c in langs if family[c] == f], 2):
            use = (lang == a) | (lang == b)
            y = np.where(lang[use] == a, 1, -1).astype(np.float32)
            columns.append((f, a, b))
            weights.append(fit_svm(x[use], y, _balance(y)))
    w = np.stack(weights, 1).astype(np.float32) if weights else np.zeros((DIMS + 1, 0), np.float32)
    return {"columns": columns, "w": w, "families": {f: [c for c in langs if family[c] == f] for f in names}}


def decide(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every row of margins."""
    columns, families = model["columns"], model["families"]
    names = list(families)
    n = len(margins)
    at = {c: i for i, c in enumerate(columns)}
    sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
    if len(names) > 1:
        of = np.stack([margins[:, at[("family", f, None)]] for f in names], 1)
        best, score = of.argmax(1), sure(of.max(1))
    else:
        best, score = np.zeros(n, int), np.ones(n)
    out = np.full(n, "und", object)
    for i, f in enumerate(names):
        rows = np.flatnonzero(best == i)
        langs = families[f]
        votes, strength = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
        for a, b in combinations(range(len(langs)), 2):
            m = margins[rows, at[(f, langs[a], langs[b])]]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            strength[:, a] += np.clip(m, -1, 1)
            strength[:, b] -= np.clip(m, -1, 1)
        win = (votes + strength * 1e-3).argmax(1)
        out[rows] = np.array(langs, object)[win]
        if len(langs) > 1:
            score[rows] *= sure(strength[np.arange(len(rows)), win] / (len(langs) - 1))
    return out, score


def _predict(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.ascontiguousarray(model["w"].T)
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            margins = np.zeros((batch.num_rows, len(w)))
            for i, j in row_slices(offsets):
                off = offsets[i:j + 1] - offsets[i]
                full = np.flatnonzero(np.diff(off))
                if not len(full):
                    continue
                part = data[offsets[i]:offsets[j]]
                code = trigrams(part)
                # the last two trigrams of a row must not see the next row
                for back in (1, 2):
                    p = off[1:][full] - back
                    p = p[p >= off[:-1][full]]
                    edge = np.zeros((len(p), 2), np.uint8)
                    edge[:, 0] = part[p]
                    edge[:, 1] = part[p + 1] if back == 2 else 32
                    b = _FOLD[edge]
                    code[p] = ((b[:, 0] << np.uint32(16) | b[:, 1] << np.uint32(8) | np.uint32(32)) * np.uint32(0x9E3779B1) >> np.uint32(19)).astype(np.int64)
                size = np.diff(off)[full]
                for c in range(len(w)):
                    margins[i + full, c] = np.add.reduceat(w[c][code], off[:-1][full]) / size * 100 + w[c][DIMS]
            lang, score = decide(margins, model)
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            none = ~letter | (lang == "und")
            lang[none] = "und"
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(np.where(none, 0.0, np.clip(score, 0, 1)))})
    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from rows with a language, an id and a letter whose crc32(id as text) mod 5 is not 0. Null text, or
    text without a letter, is ``und`` with score 0; so is everything if nothing can be learned.
    Equal texts get equal predictions. An empty table gives no rows. Other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % 5 == 0, F.lit(False))
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).alias("lang")).withColumn("held_out", held)
    model = train(plain.where("not held_out").select("_id", "_text", "lang"), sample)
    return (plain.select(F.col("_id").alias("doc_id"), "held_out", "_text", F.expr("_text rlike '\\\\p{L}'").alias("_letter"))
            .mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double"))
