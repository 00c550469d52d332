"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score sees its own features and its neighbours'; the chain adds a
transition weight. Forward-backward marginals, weighted by line length, average into the
document's share of good text, which a logistic curve, fitted on the labels, turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopflow.llm.text import row_slices, utf8, word_hashes

#: Labelled documents of each class used for fitting, and the most lines of such a document.
SAMPLE, SAMPLE_LINES = 1500, 200
FEATURES = ["length", "words", "word_length", "upper", "symbols", "digits", "exclaim", "stops", "same", "variety", "lower_start", "not_ascii", "commas", "blank"]
_KIND = np.zeros((256, 8), np.float32)
_KIND[65:91, 0] = 1
_KIND[97:123, 1] = 1
_KIND[[ord(c) for c in "#*$%&|<>"], 2] = 1
_KIND[48:58, 3] = 1
_KIND[33, 4] = 1
_KIND[[46, 63], 5] = 1
_KIND[128:, 6] = 1
_KIND[44, 7] = 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (floats in 0..1), line lengths in bytes, and the line offsets of the rows."""
    brk = data == 10
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(brk) + 1]))
    starts = starts[starts < offsets[-1]]
    # A break that ends a row starts no line of the next one.
    lines = np.searchsorted(starts, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), lines
    ends = np.append(starts[1:], len(data))
    size = (ends - starts).astype(np.float64)
    kinds = np.stack([np.add.reduceat(_KIND[:, k][data], starts) for k in range(8)], 1).astype(np.float64)
    h, words = word_hashes(data, np.append(starts, len(data)))
    count = np.diff(words).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(words))
    same = np.zeros(n)
    if len(h) > 1:
        pair = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        same = np.bincount(owner[1:][pair], minlength=n).astype(float)
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=n).astype(float) if len(h) else np.zeros(n)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    w = np.maximum(count, 1)
    first = data[starts]
    x = np.stack([np.log1p(size) / 12, np.log1p(count) / 10, np.minimum(size / w / 20, 1), kinds[:, 0] / letters, np.minimum(kinds[:, 2] / w, 1), np.minimum(kinds[:, 3] / size * 4, 1),
                  np.minimum(kinds[:, 4] / w, 1), np.minimum(kinds[:, 5] / w * 4, 1), same / w, distinct / w, ((first >= 97) & (first <= 122)).astype(float),
                  np.minimum(kinds[:, 6] / size * 4, 1), np.minimum(kinds[:, 7] / w * 4, 1), (count == 0).astype(float)], 1)
    return x.astype(np.float32), np.maximum(size, 1), lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a document's ends), both marks, and a constant."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = np.zeros((n, 1), x.dtype), np.zeros((n, 1), x.dtype)
    full = lines[:-1] < lines[1:]
    first[lines[:-1][full]] = 1
    last[lines[1:][full] - 1] = 1
    return np.concatenate([x, before * (1 - first), after * (1 - last), first, last, np.ones((n, 1), x.dtype)], 1)


def marginals(score: np.ndarray, lines: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, P(same state as the line before), and the log partition sum.

    ``score`` is the log odds of good of a line, ``stay`` what two equal neighbours add. Documents
    run side by side, longest first, so that a step handles one line of each.
    """
    size = np.diff(lines)
    order = np.argsort(-size, kind="stable")
    begin, size = lines[:-1][order], size[order]
    begin, size = begin[size > 0], size[size > 0]
    n = len(score)
    good, same = np.zeros(n), np.zeros(n)
    if not len(size):
        return good, same, 0.0
    half = score / 2
    # f: log odds of the forward messages; b: of the backward ones.
    f, b = half * 2, np.zeros(n)
    step = lambda m: np.logaddexp(stay + m, 0) - np.logaddexp(m, stay)
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]
    norm = np.zeros(n)
    norm[begin] = np.logaddexp(half[begin], -half[begin])
    for t in range(1, int(size[0])):
        at = begin[:alive[t]] + t
        p = f[at - 1]
        f[at] = score[at] + step(p)
        # log sum of the forward step, with the message before normalised to 1
        lp, lq = -np.logaddexp(0, -p), -np.logaddexp(0, p)
        up, dn = np.logaddexp(lp + stay, lq), np.logaddexp(lp, lq + stay)
        norm[at] = np.logaddexp(up + half[at], dn - half[at])
    for t in range(int(size[0]) - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        b[at] = step(score[at + 1] + b[at + 1])
    good = 1 / (1 + np.exp(-np.clip(f + b, -500, 500)))
    for t in range(1, int(size[0])):
        at = begin[:alive[t]] + t
        p, q = f[at - 1], score[at] + b[at]
        a, c = np.logaddexp(p + q, 0) + stay, np.logaddexp(p, q)
        same[at] = 1 / (1 + np.exp(-np.clip(a - c, -500, 500)))
    return good, same, float(norm.sum())


def fit_field(x: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 150, l2: float = 2.0) -> tuple[np.ndarray, float]:
    """Maximum conditional likelihood (Adam on the mean gradient); every line carries its document's label."""
    y = np.repeat(label, np.diff(lines)).astype(float)
    w, stay = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    pairs = np.maximum(np.diff(lines) - 1, 0).sum()
    docs = max(1, len(label))
    for t in range(1, rounds + 1):
        good, same, _ = marginals(x @ w, lines, stay)
        grad = np.append(x.T @ (y - good) - l2 * w, pairs - same.sum() - l2 * stay) / docs
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, stay = w + move[:-1], min(3.0, stay + float(move[-1]))
    return w, stay


def _share(w, stay, x, size, lines):
    """Length-weighted log odds of good of every row, and its share of good text; 0.5 without lines."""
    good, _, _ = marginals(with_neighbours(x, lines) @ w, lines, stay)
    total = np.concatenate([[0], np.cumsum(size)])
    part = np.concatenate([[0], np.cumsum(size * good)])
    whole = total[lines[1:]] - total[lines[:-1]]
    return np.where(whole > 0, (part[lines[1:]] - part[lines[:-1]]) / np.maximum(whole, 1), 0.5)


def _odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on z by Newton steps, with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * weight.sum() / max(1, len(z)) * np.eye(2)
        d = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * weight.sum() / max(1, len(z)) * np.array([a - 1, b]))
        a, b = a + d[0], b + d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("_text"))
        for i, j in row_slices(offsets):
            x, size, lines = line_features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            yield pa.record_batch({"_id": batch.column("_id").slice(i, j - i), "y": batch.column("y").slice(i, j - i), "x": pa.array([x[lines[r]:lines[r + 1]].tobytes() for r in range(j - i)], pa.binary()),
                                   "s": pa.array([size[lines[r]:lines[r + 1]].tobytes() for r in range(j - i)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on ``sample`` labelled documents of each class, those with the smallest id hashes, of at most SAMPLE_LINES lines.

    ``docs`` (_id, _text), ``labels`` (_id, y); the class frequencies for the curve are those of
    all given labels. With one class only, or no labels, the score is that class's frequency, else 0.5.
    """
    known = labels.where("_id is not null and y in (0, 1)").groupBy("_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * sample ids: a fixed size.
    rows = docs.join(F.broadcast(chosen), "_id").where(f"length(_text) > 0 and size(split(_text, '\\n')) <= {SAMPLE_LINES}").mapInArrow(_features, "_id long, y int, x binary, s binary").orderBy("_id", "x").collect()
    prior = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    if len({r.y for r in rows}) < 2:
        return {"w": np.zeros(3 * len(FEATURES) + 3), "stay": 0.0, "curve": (0.0, float(_odds(np.array(prior)))), "prior": prior}
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in rows]
    lines = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    x, size, label = np.concatenate(xs), np.concatenate([np.frombuffer(r.s) for r in rows]), np.array([r.y for r in rows])
    w, stay = fit_field(with_neighbours(x, lines), lines, label)
    z = _odds(_share(w, stay, x, size, lines))
    weight = np.where(label == 1, totals[1] / max(1, (label == 1).sum()), totals[0] / max(1, (label == 0).sum()))
    return {"w": w, "stay": stay, "curve": fit_curve(z, label, weight), "prior": prior}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = model["curve"]
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            out = []
            for i, j in row_slices(offsets):
                x, size, lines = line_features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                p = 1 / (1 + np.exp(-np.clip(a * _odds(_share(model["w"], model["stay"], x, size, lines)) + b, -30, 30)))
                out.append(np.where(np.diff(lines) > 0, p, model["prior"]))
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "_text"), pa.array(np.concatenate(out) if out else np.zeros(0))],
                                             names=[*(n for n in batch.schema.names if n != "_text"), "_score"])
    return run


def held_out(id_col: str, folds: int = 3, fold: int = 1):
    """Is crc32 of the id as text, modulo ``folds``, equal to ``fold``? A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y"))
    return fit(plain.where(~held_out("_id")), known.where(~held_out("_id")), sample)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learns from labelled rows that are not held out; ids, labels and other columns are no inputs of a score. Null
    and empty texts get the frequency of label 1. Equal texts get equal scores. A null id is scored
    and never learned from. Conflicting labels of an id are averaged and rounded. An empty table gives no rows.
    """
    model = model or train(docs, labels, id_col, text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("held_out", held_out("doc_id"))
    scored = plain.select("doc_id", "held_out", "_text").mapInArrow(_score(model), "doc_id long, held_out boolean, _score double")
    return scored.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""
    model = train(docs, labels, id_col, text_col)
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    schema = f"_row {work.schema['_row'].dataType.simpleString()}, _score double"
    out = work.mapInArrow(_score(model), schema).where(F.col("_score") >= threshold)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
