"""Personal data by aggregated weak labels.

Four kinds have base patterns, whose spans always stay. Candidates for more spans (secrets, spaced-out
addresses, local phone numbers, quoted keys) get votes from three kinds of labelers: patterns,
gazetteers and context. Expectation-maximisation over the counts of vote patterns estimates the
labelers' reliabilities; its posteriors train the final span classifier on shape features; the
classifier decides on each candidate. The text is read once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopflow.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches of these start where a run of digits starts: a later start in the run fails as the first did.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._-]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: Candidate patterns (runs have no upper length; possessive, so each is read once), gazetteers and context words of the added kinds.
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{16,}+(?![A-Za-z0-9])|[A-Za-z0-9+/]{24,}+)(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"),
    # What follows the local part, which is taken from here to the left.
    "spelled_email": re.compile(r" ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,}+ ?(?:\[dot\]|\(dot\)) ?[A-Za-z]{2,}+(?![A-Za-z0-9])"),
    "id_number": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
GAZETTEER = ("AKIA", "ghp_", "gho_", "sk-", "gmail", "mail", "outlook", "555", "800")
CONTEXT = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "phone", "tel", "call", "mobile", "mail", "contact", "ssn", "social")
LABELERS = ["pattern", "gazetteer", "context", "mixed", "assigned"]
_SHAPES = 10


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > last and _NAME.match(text, i - 1):
            i -= 1
        m = _DOMAIN.match(text, at) if i < at else None
        if m:
            out.append((i, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns, in code points, end exclusive; matches that fail their check are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def _spelled(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    last = 0
    for m in pattern.finditer(text):
        i = m.start()
        while i > last and _SPELLED.match(text, i - 1):
            i -= 1
        while i and i < m.start() and _ALNUM.match(text, i - 1):  # no word is cut by the span before
            i += 1
        if m.start() - i >= 2:
            last = m.end()
            yield i, last


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes, shape) of spans that overlap no base span. Votes and shape are bit sets."""
    taken = sorted(s for v in base.values() for s in v)
    starts = np.array([s for s, _ in taken] or [0])
    ends = np.maximum.accumulate(np.array([e for _, e in taken] or [0]))
    out = []
    for kind, pattern in CANDIDATES.items():
        if kind == "spelled_email" and "at)" not in text and "at]" not in text:
            continue
        if kind != "secret" and kind != "spelled_email" and not _DIGIT.search(text):
            continue
        for a, b in _spelled(text, pattern) if kind == "spelled_email" else (m.span() for m in pattern.finditer(text)):
            i = int(np.searchsorted(starts, b)) - 1
            if taken and i >= 0 and ends[i] > a:
                continue
            s, before = text[a:b], text[max(0, a - 24):a].lower()
            digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
            hexes = all(c in "0123456789abcdef" for c in s)
            mixed = digits >= 3 and letters >= 3 or kind != "secret"
            votes = [s[:4] == "AKIA" or s[:2] in ("gh", "sk") and digits > 2 or kind != "secret" or hexes and mixed, any(g in s for g in GAZETTEER), any(c in before for c in CONTEXT),
                     mixed, before.rstrip(" \"'")[-1:] in ("=", ":")]
            shape = [kind == "secret", kind == "local_phone", kind == "spelled_email", kind == "id_number", digits >= 3, digits >= 8, letters >= 6, hexes, len(s) >= 20, len(s) > 64]
            out.append((kind, a, b, sum(v << j for j, v in enumerate(votes)), sum(v << j for j, v in enumerate(shape))))
    return out


def fit_labelers(patterns: list[tuple[int, int]], rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over (votes, count); a labeler votes for or abstains.

    Returns the log odds and, per labeler, the log likelihood ratios of abstaining and voting.
    Starts from votes of the majority; voting never speaks against a span.
    """
    n = len(LABELERS)
    q = [0.9 if v.bit_count() * 2 > n else 0.1 for v, _ in patterns]
    odds, ratios = 0.0, [(0.0, 0.0)] * n
    for _ in range(rounds):
        yes = sum(p * c for p, (_, c) in zip(q, patterns))
        no = sum(c for _, c in patterns) - yes
        odds = math.log((yes + 1) / (no + 1))
        ratios = []
        for j in range(n):
            a = (sum(p * c for p, (v, c) in zip(q, patterns) if v >> j & 1) + 1) / (yes + 2)
            b = (sum((1 - p) * c for p, (v, c) in zip(q, patterns) if v >> j & 1) + 1) / (no + 2)
            ratios.append((min(0.0, math.log((1 - a) / (1 - b))), max(0.0, math.log(a / b))))
        q = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(r[v >> j & 1] for j, r in enumerate(ratios)))))) for v, _ in patterns]
    return odds, ratios


def fit_classifier(cells: list[tuple[int, int, int]], odds: float, ratios: list[tuple[float, float]]) -> np.ndarray:
    """Logistic regression of the posteriors on shape and votes; ``cells`` (votes, shape, count) hold every span."""
    if not cells:
        return np.zeros(_SHAPES + len(LABELERS) + 1)
    x = np.array([[*(s >> j & 1 for j in range(_SHAPES)), *(v >> j & 1 for j in range(len(LABELERS))), 1] for v, s, _ in cells], float)
    y = np.array([1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(r[v >> j & 1] for j, r in enumerate(ratios)))))) for v, _, _ in cells])
    c = np.array([n for *_, n in cells], float)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (c * (y - p)) - w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return w


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, kind array<string>, a array<int>, b array<int>, votes array<int>, shape array<int>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("_text"):
            t = text.as_py()
            base = base_spans(t)
            said = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), said, candidates(t, base)))
        more = [r[6] for r in rows]
        lists = [pa.array([[c[j] for c in m] for m in more], pa.list_(pa.string() if j == 0 else pa.int32())) for j in range(5)]
        cols = [pa.array([r[j] for r in rows], pa.int64() if j < 4 else pa.string()) for j in range(6)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, *lists], names=[c.split()[0] for c in _FOUND.split(", ")])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as ``kind:start:end`` (base first), and n_added.

    Null text is empty: no spans, and the digest of an empty string. Equal rows give equal rows; a null id
    stays null. Without candidates nothing is fitted and only base spans are returned. An
    empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = cut_lineage(plain.mapInArrow(_find, _FOUND))
    # At most 2^5 votes and 2^10 shapes, whatever the corpus.
    cells = [(r.v, r.s, r.n) for r in found.select(F.explode(F.arrays_zip("votes", "shape")).alias("x")).groupBy(F.col("x.votes").alias("v"), F.col("x.shape").alias("s")).agg(F.count("*").alias("n")).orderBy("v", "s").collect()]
    odds, ratios = fit_labelers([(v, n) for v, _, n in cells])
    w = fit_classifier(cells, odds, ratios)
    add = [(j, "shape", float(w[j])) for j in range(_SHAPES)] + [(j, "votes", float(w[_SHAPES + j])) for j in range(len(LABELERS))]
    logit = " + ".join([f"{float(w[-1])!r}D", *(f"{x!r}D * (shiftright(x.{c}, {j}) & 1)" for j, c, x in add)])
    extra = F.expr(f"transform(array_sort(transform(filter(arrays_zip(kind, a, b, votes, shape), x -> {logit} >= 0), x -> struct(x.kind, x.a, x.b))), x -> concat_ws(':', x.kind, x.a, x.b))")
    return (found.withColumn("_extra", extra)
            .select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(F.array_join("_extra", ","), F.lit(""))).alias("spans"), F.size("_extra").cast("long").alias("n_added")))
