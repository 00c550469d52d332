"""Alignment, merge encoding and centroids against brute force, and on odd rows and tables."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hoopflow.llm import align, bpe, centroids
from hoopflow.llm.queries import ORACLES, QUERIES
from hoopflow.session import ship

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "Hello, World's  we'll it's 'll 123abc ５６", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|end", "tab\tnew\n\nline\r\n end\n", "nbsp here   x　 y z\u0085w",
       "é ́x Å Å ﬁ ＡＢ İI ΑΣ Σ", "▁ under ▁▁x", "<s> </s> <unk> <0x41>", "\x00 \x01\x1c\x1d\x1e\x1f \x7f", "日本語 テキスト한국어 ไทย", "😀👩‍👩‍👧 x😀", "a" * 3000, "ab" * 900 + " " + "é" * 500, " " * 200, "\n" * 60 + "z", "don't DON'T --'s ''' 're", "﻿bom ​ zero", "word " * 2000]
SCHEMA = "doc_id long, text string, ids string, n_a long, block string, parts long, size long, _text string"


def clash(spark, texts, start=0):
    rows = [(i + start, t, "i", 1, "b", 2, 3, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.tokenizer_path())


def brute_bpe(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, docs, library):
    odd = clash(spark, ODD, 10_000).union(clash(spark, ODD[:4], 10_000)).union(spark.createDataFrame([(None, "null id", "i", 1, "b", 2, 3, "t")], SCHEMA))
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(every)).collect())
    assert got == Counter((r.doc_id, *brute_bpe(library, r.text)) for r in every.collect())
    assert bpe.decode(bpe.encode(odd)).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert bpe.decode(bpe.encode(odd.limit(0))).collect() == []


def test_bpe_words_at_random(library):
    rng = random.Random(5)
    enc = bpe.WordEncoder(bpe.tokenizer_path())
    alphabets = ["ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz'-0123456789", "éüñçøß" "日本語" "ابت", "!?.,;:-_#$"]
    texts = [" ".join("".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 24))) for _ in range(40)) for _ in range(400)]
    assert [list(np.frombuffer(x, "<u4")) for x in enc(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    # Both paths run: most words pass the check, some are merged step by step.
    assert 0 < enc.n_merged < enc.n_words


def test_bpe_check_is_exact():
    """On a small table, greedy tokens pass the check exactly where step-by-step merging gives them; unsound tokens are never proposed."""
    rng = random.Random(7)
    for _ in range(60):
        n, pairs = 3, []
        for r in range(12):
            for _ in range(20):
                p = (rng.randrange(n + r), rng.randrange(n + r))
                if p not in pairs:
                    pairs.append(p)
                    break
        m = bpe.Merges(pairs, n)
        words = [np.array([rng.randrange(n) for _ in range(rng.randint(1, 14))]) for _ in range(80)]
        offsets = np.cumsum([0, *map(len, words)])
        got, _ = m.encode(np.concatenate(words), offsets)
        want = [m.merge(w.tolist()) for w in words]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
        for width in (0, 5, 48):
            assert [g.tolist() for g in m.merge_all(np.concatenate(words), offsets, width)] == want


def test_bpe_forgets_without_change(docs, library):
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    enc = bpe.WordEncoder(bpe.tokenizer_path(), limit=100)
    for t in texts:
        assert enc(pa.array([t]))[0] == brute_bpe(library, t)[1]


def brute_align(rows):
    """Token by token, with byte sets; counts over all rows."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(align.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.tokenizer_path("piece_bpe_32k.model"))
    letters = {}
    n = 0
    for i in range(256):
        if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255:
            letters[chr(i)] = i
        else:
            letters[chr(256 + n)] = i
            n += 1
    assert set(letters) == set(ByteLevel.alphabet())

    def spans(parts):
        at, out = 0, []
        for i, p in parts:
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    found, count = [], Counter()
    for doc, text in rows:
        ta = tb = []
        groups, links = [], []
        if text:
            pa_ = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            pb = []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                pb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in pa_) == want and b"".join(x for _, x in pb) == want:
                ta, tb = spans(pa_), spans(pb)
        ends = sorted({e for _, _, e in ta} & {e for _, _, e in tb})
        i = j = 0
        for e in ends:
            ga, gb = [], []
            while i < len(ta) and ta[i][2] <= e:
                ga.append(ta[i]); i += 1
            while j < len(tb) and tb[j][2] <= e:
                gb.append(tb[j]); j += 1
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        count.update(set(links))
        found.append((doc, len(ta), len(tb), len(groups), links, ";".join(groups)))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter((d, na, nb, ng, len(l), sum(count[p] == top[p[0]] for p in l), sum(count[p] for p in l), g) for d, na, nb, ng, l, g in found)


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 3000])
def test_alignment_equals_brute_force(spark, docs, block_bytes):
    odd = clash(spark, ODD, 10_000).union(clash(spark, ODD[:9], 10_000)).union(spark.createDataFrame([(None, "null id", "i", 1, "b", 2, 3, "t")], SCHEMA))
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = Counter(tuple(r) for r in align.align(every, block_bytes=block_bytes).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())
    assert got == brute_align([(r.doc_id, r.text) for r in every.collect()])


def test_alignment_of_odd_tables(spark):
    ship(spark)
    odd = clash(spark, ODD)
    assert align.align(odd).count() == len(ODD)
    assert align.align(odd.limit(0)).collect() == []
    nothing = align.align(clash(spark, [None, "", None])).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_coalesce_breaks_where_a_start_reaches_the_end():
    start, end = np.array([0, 2, 2, 5, 7, 7]), np.array([2, 4, 5, 7, 9, 8])
    order, group = align.coalesce(start, end)
    assert [(start[o], end[o], g) for o, g in zip(order, group)] == [(0, 2, 0), (2, 4, 1), (2, 5, 1), (5, 7, 2), (7, 8, 3), (7, 9, 3)]


def brute_centroids(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [list(v) for _, v in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda v: min((dist(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[pick(v)[1]].append(v)
        for n, vs in of.items():
            centers[n] = [sum(x) // len(vs) for x in zip(*vs)]
    final = [(i, *pick(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in final:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in final)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_centroids_equal_brute_force_and_sql(spark):
    ship(spark)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = Counter(tuple(r) for r in QUERIES["op12_centroids"](spark, SF).select(*COLUMNS).collect())
    assert got == brute_centroids([(r.vec_id, r.embedding) for r in table.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_centroids']})").fetchall())


def test_centroids_of_odd_vectors(spark):
    """Nulls, other lengths, non-finite values, ties, repeated and null ids, large values, clashing columns."""
    rng = random.Random(3)
    v = lambda s=1.0: [rng.gauss(0, s) for _ in range(4)]
    rows = [(i, v(), 0, 0.0) for i in range(40)] + [(i, [0.5, 0.5, 0.5, 0.5], 0, 0.0) for i in range(40, 60)] + [(3, v(), 0, 0.0), (3, v(), 1, 0.0), (None, v(), 1, 0.0)]
    rows += [(70, None, 0, 0.0), (71, [1.0, None, 2.0, 3.0], 0, 0.0), (72, [1.0], 0, 0.0), (73, [float("nan")] * 4, 0, 0.0), (74, [float("inf"), 0.0, 0.0, 0.0], 0, 0.0), (75, [], 0, 0.0)]
    schema = "vec_id long, embedding array<double>, cluster int, rest double"
    for extra in ([], [(80, [3e4, -3e4, 1.0, 0.0], 0, 0.0)], [(80, [4e5, -4e5, 1.0, 0.0], 0, 0.0), (81, [4e5, -4e5, 1.0, 0.001], 0, 0.0)]):
        table = spark.createDataFrame(rows + extra, schema)
        got = Counter(tuple(r) for r in centroids.cluster(table, dim=4, lead=2, rounds=4).select(*COLUMNS).collect())
        assert got == brute_centroids([r[:2] for r in rows + extra], rounds=4, dim=4)
    few = spark.createDataFrame(rows[:3], schema)
    assert Counter(tuple(r) for r in centroids.cluster(few, dim=4, lead=9).select(*COLUMNS).collect()) == brute_centroids([r[:2] for r in rows[:3]], dim=4)
    assert centroids.cluster(spark.createDataFrame([], schema), dim=4).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 0, 0.0), (2, [-1e30, 0.0, 0.0, 0.0], 0, 0.0)], schema)
    assert {r.distance for r in centroids.cluster(huge, k=1, dim=4).collect()} == {centroids.LONG}


def test_bound_never_hides_the_nearest():
    rng = np.random.default_rng(1)
    measured = 0
    for lead in (0, 1, 5, 8):
        v = (rng.normal(0, 200, (500, 8)) * np.array([9, 5, 3, 1, 1, .5, .2, .1])).astype(np.int64)
        c = v[rng.choice(500, 6)]
        mean = v.mean(0)
        axes = centroids.rotation(np.cov(v.T), lead)
        best, dist, n = centroids.nearest(v, *centroids.rotated(v, mean, axes), c, mean, axes)
        every = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (dist == every.min(1)).all()
        measured = n
    assert measured < 3 * 500
