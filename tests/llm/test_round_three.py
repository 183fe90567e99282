"""Whitening, language model scores and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanescope.llm import conversations, scoring, whitening
from lanescope.llm.language import fold

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# whitening


def test_counts_of_pivots_are_counts_of_eigenvalues():
    g = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 40):
        a = g.normal(size=(n, n))
        a = a + a.T
        for shift in (-1.0, 0.0, 0.7):
            assert (whitening.pivots(a - shift * np.eye(n)) > 0).sum() == (np.linalg.eigvalsh(a) > shift).sum()
    assert sorted(np.sign(whitening.pivots(np.array([[0.0, 1.0], [1.0, 0.0]])))) == [-1, 1]


def spread(values, seed=2):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [[3.0], [2.0, 1.0], list(range(40, 0, -1)), [5.0] * 3 + [1.0, 1.0, 1 - 1e-9, 0.5] + [0.0] * 20, [1.0] * 20, [1e-300, 5e-301], [1e12, 1.0, 1e-3, 0.0], [1 + k * 1e-13 for k in range(20)]],
)
def test_leading_eigenvectors(values):
    a = spread(values)
    e, v = whitening.leading(a)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    size = abs(want).max()
    assert np.abs(e - want).max() <= 1e-13 * size * len(a)
    assert np.abs(a @ v - v * e).max() <= 1e-13 * size * len(a)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    for k, (x, y) in enumerate(itertools.pairwise(want)):
        if x - y > 1e-6 * size and (k == 0 or want[k - 1] - x > 1e-6 * size):  # alone: its vector is its own
            assert abs(abs(v[:, k] @ np.linalg.eigh(a)[1][:, ::-1][:, k]) - 1) < 1e-12


def plain_whitening(vectors, most=16):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in vectors}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return {i: (n, int(((n * v - s) ** 2).sum()), (v - s / n) @ u / np.sqrt(e)) for i, v in x.items()}, e / np.trace(c.T @ c / n)


def test_whitening_of_a_table(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    given = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    bad = [(-1, None), (-2, [1.0, None]), (-3, [float("nan")] * 64), (-4, [float("inf")] * 64), (-5, [])]
    again = [(10_000 + k, v) for k, v in given[:50]]  # count once
    df = spark.createDataFrame(given + bad + again, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "'n' AS n", "2 AS component").repartition(5)
    out = whitening.whitened(df).toPandas()
    want, explained = plain_whitening(given + again)
    assert len(out) == 16 * len(want) and set(out["vec_id"]) == set(want) and list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.pivot(index="vec_id", columns="component", values="whitened")
    plain = np.array([want[i][2] for i in got.index])
    assert np.abs(got.to_numpy() * np.sign((got.to_numpy() * plain).sum(axis=0)) - plain).max() < 1e-9
    assert all((r.n, r.deviation) == want[r.vec_id][:2] for r in out.itertuples())
    assert np.abs(out.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-12
    assert out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-10


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (2, [0.5, 0.0, 0.0]), (2, [1.5, 0.0, 0.0]), (None, [0.5, 0.0, 0.0]), (5, [1e308, 1.0]), (6, [-1e308, 1.0]), (7, [2.0]), (8, [2.0])]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    three = out[out["n"] == 3]
    assert len(three) == 12 and three["whitened"].isna().sum() == 8  # two of three coordinates never vary
    assert three["identity_error"].max() < 1e-12 and set(three[three["component"] == 1]["explained"]) == {1.0}
    far = out[out["vec_id"].isin([5, 6])]
    assert len(far) == 4 and far["deviation"].isna().all() and sorted(far[far["component"] == 1]["whitened"].abs()) == [1.0, 1.0]
    one = out[out["vec_id"].isin([7, 8])]
    assert len(one) == 2 and one["whitened"].isna().all() and one["explained"].isna().all() and (one["deviation"] == 0).all()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).count() == 0


# language model scores


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


ODD = [*enumerate([None, "", " ", "A b a B", "x" * 2_500_000, "\n \tç ÇA\x0b", "w " * 700_000, "\x1c"] + ["a b c d e f"] * 20), (None, "a b"), (None, None), (1, "a b")]


@pytest.mark.parametrize("odd", [True, False])
def test_scores_against_true_counts(spark, odd):
    df = spark.createDataFrame(ODD, "doc_id long, text string") if odd else spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    train = [words(t) for d, t in rows if not held_out(d)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    mine = fold(F.col("doc_id"), 7) == 2
    extra = df.selectExpr("*", "1 AS segment", "'k' AS keys", "2 AS chunk")
    got = [tuple(r) for r in scoring.scored(extra, mine).collect()]
    by_chunks = [tuple(r) for r in scoring.scored(extra, mine, bound=-1).collect()]  # the filter is not broadcast
    flat = lambda rs: sorted(((r[0] or -1, *r[1:5], round(r[5], 6), round(r[6], 6)) for r in rs))
    assert flat(got) == flat(by_chunks)
    want = []
    for d, t in rows:
        t = words(t)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        exact = sum(math.log10((min(two[p], one[p[0]]) + scoring.STRENGTH * (one[p[1]] + 1) / (n + v + 1)) / (one[p[0]] + scoring.STRENGTH)) for p in zip([None, *t], t, strict=False))
        want.append((d or -1, held_out(d), len(t), sum(one[w] > 0 for w in t), n, round(base, 5), exact))
    off = same = 0.0
    for g, w in zip(sorted((r[0] or -1, *r[1:5], round(r[5], 5), r[6]) for r in got), sorted(want), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) <= 2e-5 * max(1, abs(w[5]) / 100)
        off, same = off + abs(g[6] - w[6]), same + abs(w[6])
    assert off < 0.03 * same  # levels are no counts, but near them
    if not odd:
        out = [r for r in got if r[1]]
        assert sum(r[6] for r in out) > sum(r[5] for r in out)  # texts that were held out are likelier than by the plain model


def test_levels_are_never_too_low_and_seldom_too_high():
    g = np.random.default_rng(5)
    keys = np.unique(g.integers(0, 2**63, 40_000).astype(np.uint64))
    level = scoring.level_of(g.geometric(0.2, len(keys)))
    bits = -(-scoring.BITS * int(level[::2].sum()) // 64) * 64
    held = scoring.Filter(scoring.entered(keys[::2], level[::2], bits), np.zeros(1, np.int64), np.array([bits]), keys[:0], level[:0])
    got = held.levels(keys)
    assert (got[::2] >= level[::2]).all() and (got[::2] > level[::2]).mean() < 0.03 and (got[1::2] > 0).mean() < 0.03
    assert scoring.level_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_scores_without_training_texts_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in scoring.scored(df, F.lit(True)).collect()}
    assert (out[1]["n_tokens"], out[1]["n_known"], out[1]["train_tokens"], out[1]["base_score"], out[1]["score"]) == (3, 0, 0, 0.0, 0.0)
    assert scoring.scored(df.where("false"), F.lit(False)).count() == 0


def test_long_texts_are_read_in_stretches(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two  three", "", "x" * 50, "Last one ", " a"])
    want = [x.tolist() for x in scoring.tokens(texts)]
    for size in (1, 3, 7, 20):
        monkeypatch.setattr(scoring, "STRETCH", size)
        assert [x.tolist() for x in scoring.tokens(texts)] == want


# conversations

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, messages) of (initial, must go, truncated, role, text) by trying everything."""
    after, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}

    @lru_cache(None)
    def go(i, q, inserted):
        options = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if inserted < 4:
            options += [(2 + c, "I" + a, (name[after[q]] + ":", *m)) for c, a, m in go(i, after[q], inserted + 1)]
        if i < len(rows):
            initial, gone, cut, role, text = rows[i]
            options += [(3 + c, "D" + a, m) for c, a, m in go(i + 1, q, 0)]
            if not gone:
                kept = 1 if (initial, q) == ("s", 0) else after[q] if initial == name[after[q]][0] else None
                if kept:
                    options += [(cut + c, "K" + a, (f"{role}:{text}", *m)) for c, a, m in go(i + 1, kept, 0)]
                options += [(2 + cut + c, "R" + a, (f"{name[after[q]]}:{text}", *m)) for c, a, m in go(i + 1, after[q], 0)]
        return [min(options)] if options else []

    for i in range(len(rows), -1, -1):  # from the end, so that nothing recurses deeply
        for q in range(4):
            go(i, q, 0)
    return go(0, 0, 0)[0]


def plain_repair(table):
    groups = defaultdict(list)
    for c, t, role, text in table:
        own = groups[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told, n = set(), [], Counter()
        for _, role, text in rows:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            told.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault in ("blank", "duplicate"), int(fault == "truncated"), role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, messages = cheapest(tuple(told))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(messages).encode()).hexdigest())
    return out


def test_block_tables_find_the_cheapest_least_edits():
    kinds = [(i, False, cut) for cut in (0, 1) for i in "sua?"] + [("u", True, 0)]
    g = np.random.default_rng(0)
    every = [list(x) for n in range(4) for x in itertools.product(kinds, repeat=n)] + [[kinds[j] for j in g.integers(0, 9, g.integers(4, 60))] for _ in range(400)]
    rows = np.array(["sua?".index(i) + (8 if gone else 4 * cut) for c in every for i, gone, cut in c])
    ends = np.cumsum([len(c) for c in every])
    cost, edits, last = conversations.repaired(rows, ends)
    got = zip(cost.tolist(), conversations.audits(edits, last, ends).to_pylist(), strict=True)
    assert list(got) == [cheapest(tuple((*r, "", "") for r in c))[:2] for c in every]


def test_repair_of_tables(spark):
    r = random.Random(3)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "unknown", "User"], [None, "", " ", "Hi.", "no end", "\n\t", "a ", "b! \x0b", " ", "x" * 5000 + "?", "🙂", "same."]
    odd = [(r.choice([1, 2, 3, None]) if i < 250 else i % 150 + 10, r.choice([None, 0, 1, 2, 3, -4, 9, 9**12]), r.choice(roles), r.choice(texts)) for i in range(800)]
    odd += [(4, None, "user", "again.")] * 300  # equal rows
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "'k' AS plan", "2 AS copies").repartition(7)
    for table, rows in ((df, odd), (t := spark.read.parquet(f"{MIDDLE}/conversations.parquet"), [tuple(x) for x in t.collect()])):
        got = {x[0]: tuple(x)[1:] for x in conversations.repair(conversations.damaged(table)).collect()}
        assert got == plain_repair(rows)
    assert conversations.repair(conversations.damaged(df.where("false"))).count() == 0


def test_repair_of_undamaged_rows(spark):
    rows = [("a", 0, "system", "Be kind."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Hello."), ("b", 0, "assistant", "What?")]
    out = {x["conv_id"]: x for x in conversations.repair(conversations.undamaged(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()}
    assert (out["a"]["audit"], out["a"]["cost"], out["a"]["illegal"]) == ("KKK", 0, 0)
    assert (out["b"]["audit"], out["b"]["cost"]) == ("IK", 2)
    assert out["b"]["repaired_sha256"] == hashlib.sha256(b"user:\nassistant:What?").hexdigest()
