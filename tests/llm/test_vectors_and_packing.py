"""Packing, hard negatives and whitening against brute-force versions, with every edge case, and on empty tables."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderflow.llm import hard_negatives, sequence_packing, whitening
from cinderflow.llm.sequence_packing import Capacity
from cinderflow.llm.vectors import finite, whole
from cinderflow.storage import ship_package

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
CLASH = ["x", "n", "part", "number", "nth", "offset", "score", "anchor", "block", "row", "rank", "a", "b", "found", "dim"]


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship_package(spark)


def texts():
    draw = random.Random(5)
    out = [" ".join(draw.choice(["alpha", "Beta", "ñandú", "x1", "--", "don't"]) for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    return [*out, None, "", " \n", "word " * 700, *["same text"] * 90]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a b"), (3, "other"), (3, "other")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in (*CLASH, "piece", "length", "ids")}).repartition(5)


def brute_fit(lengths, cap):
    """Sequences that best fit makes piece by piece, longest first."""
    shares, caps, held = np.array(cap.weights) / [cap.tokens, cap.documents, cap.cost], [cap.tokens, cap.documents, cap.cost], []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fit = [k for k, left in enumerate(held) if (left >= need).all()]
        if not fit:
            held.append(np.array(caps) - need)
        elif cap.rule == "norm":
            held[min(fit, key=lambda k: (held[k] - need) @ shares)] -= need
        else:
            held[max(fit, key=lambda k: (held[k] / caps) @ (need * shares))] -= need
    return len(held)


CAPS = [Capacity(128, 128, 128**2), Capacity(128, 3, 128**2), Capacity(128, 100, 60**2), Capacity(128, 5, 70**2, rule="dot"), Capacity(64, 1, 64**2)]


@pytest.mark.parametrize("cap", CAPS)
def test_packing(spark, docs, cap):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    got = sequence_packing.pack(docs, WORDS, cap).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), cap.longest)):
            want[(r["doc_id"], k, at, tuple(ids[at : at + cap.longest]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        sizes = [n for _, n in pieces]
        assert [at for at, _ in pieces] == [sum(sizes[:k]) for k in range(len(sizes))]  # gapless
        assert sum(sizes) <= cap.tokens and len(sizes) <= cap.documents and sum(n * n for n in sizes) <= cap.cost
    fitted = brute_fit([r["length"] for r in got], cap)
    assert len(held) == fitted if cap.rule == "norm" else len(held) <= 1.05 * fitted


def test_packed_sequences_and_edges(spark, docs):
    cap = CAPS[1]
    packed = sequence_packing.pack(docs, WORDS, cap)
    rows = sequence_packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == packed.agg(F.sum("length")).first()[0]
    ends = collections.Counter(i for r in rows for i in r["ids"])[1]
    assert ends == docs.count()  # one end id a document
    assert all(len(r["offsets"]) == len(r["doc_ids"]) <= 3 for r in rows)
    assert sequence_packing.pack(docs.limit(0), WORDS, cap).count() == 0
    with pytest.raises(ValueError):
        Capacity(tokens=0)


def test_plan_grows_with_lengths_not_pieces():
    few = sequence_packing.plan({n: 3 for n in range(1, 513)}, Capacity(512, 512, 512**2))
    many = sequence_packing.plan({n: 3_000_000 for n in range(1, 513)}, Capacity(512, 512, 512**2))
    assert len(many) <= 4 * 512 + len(few)
    tokens = sum(3_000_000 * n for n in range(1, 513))
    used = {int(r["first"]) + k for r in many[-1:] for k in range(1)} and int((many["first"] + -(-(many["to"] - many["from"]) // many["each"])).max())
    assert used <= math.ceil(tokens / 512) * 1.001


def vectors(spark, dims=7, rows=400, seed=2):
    draw = np.random.default_rng(seed)
    out = [(k, [float(v) for v in draw.normal(size=dims)], int(draw.integers(0, 4)) if k % 3 else 2) for k in range(rows)]
    same = out[7][1]
    out += [(rows + k, same, 2) for k in range(60)]  # copies of one vector
    odd = [(None, [0.5] * dims, 1), (1000, None, 1), (1050, [float("nan")] * dims, 1), (1100, [None] * dims, 1), (1150, [float("inf")] * dims, 2), (1200, [], 2), (1250, [1.0, 2.0], 3), (1300, [0.25] * dims, None), (50, out[50][1], out[50][2])]
    return spark.createDataFrame(out + odd, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in CLASH}).repartition(6)


def as_ints(v, scale, shift, dims):
    return [math.floor(scale * c) + shift for c in v] + [shift] * (dims - len(v))


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("sizes", [(2048, 128, 32), (64, 8, 3)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_ROWS", "ANCHOR_ROWS", "CHUNK_DIMS"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    df = vectors(spark)
    rows = [(r["vec_id"], r["label"], np.array(as_ints(r["embedding"], 256, 0, 7))) for r in df.collect() if r["label"] is not None and good(r["embedding"])]
    last = lambda v: (v is None, v or 0)
    want = collections.Counter()
    for i, (a, own, x) in enumerate(rows):
        if a is None or a % 50:
            continue
        scored = sorted(((-int(x @ y), last(v), j) for j, (v, _, y) in enumerate(rows) if j != i))
        for s, _, j in [t for t in scored if rows[t[2]][1] == own][:5]:
            fit = [t for t in scored if rows[t[2]][1] != own and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            for rank, (n, _, k) in enumerate(fit, 1):
                want[(a, rows[j][0], rank, rows[k][0], -s, -n)] += 1
    clean = finite(df.where("label is not null"), "embedding").select("vec_id", "label", whole("embedding", 256).alias("x"))
    got = collections.Counter(map(tuple, hard_negatives.mine(clean, F.col("vec_id") % 50 == 0).collect()))
    assert got == want and sum(want.values()) > 20
    assert hard_negatives.mine(clean.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(clean, F.lit(False)).count() == 0


def test_hard_negatives_wide_sums(spark):
    """Components too large for doubles are multiplied as whole numbers."""
    big = 1 << 30
    rows = [(0, 1, [big, 3]), (1, 1, [big, 5]), (2, 2, [big // 2 + 1, 7]), (3, 2, [big // 2, 9])]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, x array<long>"), F.col("vec_id") == 0).collect()]
    score = big * big + 15
    assert sorted(got) == [(0, 1, 1, 2, score, big * (big // 2 + 1) + 21), (0, 1, 2, 3, score, big * (big // 2) + 27)]


def test_whitening(spark):
    df = vectors(spark)
    rows = [(r["vec_id"], as_ints(r["embedding"], 64, 1_000_000, 7)) for r in df.collect() if good(r["embedding"])]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(df).collect()
    assert len(got) == 7 * len(rows) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    deviation = collections.Counter((v, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for v, x in rows for _ in range(7))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got) == deviation
    by = {v: x for v, x in rows}
    for r in got:
        k = r["component"] - 1
        assert math.isclose(r["explained"], values[k] / values.sum(), rel_tol=1e-9) and 0 <= r["identity_error"] < 1e-9
        off = np.array([(n * c - s) / n for c, s in zip(by[r["vec_id"]], sums, strict=True)])
        assert math.isclose(abs(r["whitened"]), abs(off @ axes[:, k] / math.sqrt(values[k])), rel_tol=1e-7, abs_tol=1e-7)
    sign = collections.defaultdict(set)
    for r in got:
        off = np.array([(n * c - s) / n for c, s in zip(by[r["vec_id"]], sums, strict=True)]) @ axes[:, r["component"] - 1]
        if abs(r["whitened"]) > 1e-6:
            sign[r["component"]].add(np.sign(off) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in sign.values())  # the same for all rows
    few = whitening.whiten(df, components=3).select("component").distinct().count()
    assert few == 3 and whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 7")).count() == 0


def test_whitening_rank_and_small_values(spark):
    """A dimension that is a copy of another has no component of its own; small variances keep their digits."""
    draw = np.random.default_rng(1)
    x = np.stack([draw.integers(-2000, 2000, 3000), draw.integers(-3, 4, 3000)], 1)
    rows = [(k, [float(a) / 64, float(a) / 64, float(b) / 64]) for k, (a, b) in enumerate(x.tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_jacobi_graded():
    """Singular values of a graded matrix to full relative precision."""
    d = 9
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(d, d)))
    sizes = 10.0 ** -np.arange(d)
    got, axes = whitening.jacobi(q * sizes)  # columns orthogonal up to scale: singular values are the sizes
    assert np.allclose(got / sizes, 1, rtol=1e-12) and np.allclose(axes.T @ axes, np.eye(d), atol=1e-12)
    assert whitening.jacobi(np.zeros((0, 1)))[0].tolist() == [0.0]


def test_triangles_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    df = vectors(spark, dims=5, rows=300, seed=9)
    many = whitening.whiten(df.repartition(13), components=2).select("explained").distinct().collect()
    assert len({round(r["explained"], 12) for r in many}) == 2


def test_tiles_of_one_chunk_are_not_shuffled(spark):
    """Scores of vectors that are one chunk stay in the task that makes them: the plan groups no tiles."""
    rows = [(i, i % 3, [i % 5, i % 7 - 3] + [i % 2] * 62) for i in range(200)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, x array<long>"), F.col("vec_id") % 50 == 0)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0
