"""The corpus operators against plain versions on small, awkward tables."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

import corpus_pipeline
from lanescope.llm import catalogue, common, decontaminate, jaccard, language, neighbours, packing, rangecoder, suffixes, tokenfiles, toxicity
from lanescope.llm.tokens import PieceEncoder, encoder, vocabulary

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ODD = brute.ODD + [LONG, LONG + " tail", "one two three four", "One two  three\tfour", "a " * 300, "İΣ ß 🙂🙂 naïve", "  double  spaces  ", "x\n\n y"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    # columns whose names the operators use themselves
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd).selectExpr("*", "'n' AS n", "1 AS row", "'k' AS key", "0 AS score", "'x' AS h", "array(1) AS spans")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_decontamination_hits_and_long_form(spark, docs, texts):
    items = [(1, "Alpha beta gamma"), (2, None), (3, ""), (4, LONG[:2000]), (5, "alpha, BETA"), (None, "one two"), (6, "one two three four")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) if w]
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            k = min(13, len(w))
            for s in range(len(w) - k + 1):
                windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    some = docs.union(spark.createDataFrame([(1, "say alpha beta; gamma alpha beta", "n", 1, "k", 0, "x", [1]), (1, "alpha beta", "n", 1, "k", 0, "x", [1])], docs.schema))
    for limit in (decontaminate.BROADCAST_WINDOWS, 1):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontaminate.contamination(some, bench, broadcast_windows=limit).collect())
        want = []
        for d, t in [*texts.items(), (1, "say alpha beta; gamma alpha beta"), (1, "alpha beta")]:
            w, hit, found = words(t), set(), set()
            for k in {len(x) for x in windows}:
                for s in range(len(w) - k + 1):
                    if tuple(w[s : s + k]) in windows:
                        hit |= set(range(s, s + k))
                        found |= windows[tuple(w[s : s + k])]
            want.append((d, len(w), len(hit), ",".join(sorted(found))))
        assert got == sorted(want)
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piecewise_encoding_equals_whole_encoding(texts, name, spaces):
    own = [*texts.values(), "<|endoftext|> a<|endoftext|>", "\x1c a\x1cb", " x", "x ", "a \n b", "a\n b"]
    own += ["it's, 's ,'s 'tis x'll.", "é, e,\u0301x", "1,000.5a-b_c (d)e", "a  b", "<|"]
    for slots in (1 << 16, 3):
        e = PieceEncoder(vocabulary(name), spaces, slots)
        for _ in range(2):
            ids, n = e.encode(pa.array(own))
            for got, t in zip(np.split(ids, np.cumsum(n)[:-1]), own, strict=True):
                assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_range_coder_round_trips_and_notices_damage():
    g = np.random.default_rng(3)
    for ids in (g.integers(0, 50_000, 70_000), np.zeros(5000, int), np.arange(3), np.array([], int), np.array([2**19 - 1, 0]), g.geometric(0.01, 100_000)):
        ids = ids.astype(np.uint32)
        assert (rangecoder.decode_block(rangecoder.encode_block(ids)) == ids).all()
    block = bytearray(rangecoder.encode_block(g.integers(0, 500, 9000).astype(np.uint32)))
    block[-300] ^= 8
    with pytest.raises(ValueError):
        rangecoder.decode_block(bytes(block))
    with pytest.raises(ValueError):
        rangecoder.encode_block(np.array([2**19], np.uint32))


def test_token_files_round_trip(spark, docs, texts):
    path = common.scratch(spark, "t")
    tokenfiles.write_tokens(docs, path, block_tokens=3000)
    tk, at = encoder(vocabulary("byte_bpe_50k.json"), True).tokenizer, 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_tokens(spark, path).collect()}
    for d in sorted(texts):
        ids = np.array([*tk.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = common.scratch(spark, "t")
    tokenfiles.write_tokens(docs.where("false"), empty)
    assert tokenfiles.read_tokens(spark, empty).count() == 0


def test_packing_covers_every_id_once(docs, texts):
    tk = encoder(vocabulary("word_bpe_49k.json"), False).tokenizer
    rows = packing.packed(docs, with_ids=True, max_open=5).collect()
    per, seqs = {}, {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for d, t in texts.items():
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        own = sorted(per[d], key=lambda r: r["start"])
        assert [i for r in own for i in r["ids"]] == ids and own[0]["start"] == 0 and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    for own in seqs.values():
        own = sorted(own, key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and own[-1]["offset"] + own[-1]["length"] <= 2048
    assert packing.packed(docs.where("false")).count() == 0


def test_level_choice_minimises_the_sum_of_squares():
    g = np.random.default_rng(0)
    for _ in range(200):
        p = packing.Packer(32)
        p.count[1:32] = g.integers(0, 4, 31)
        size = int(g.integers(1, 32))

        def after(level, p=p, size=size):
            c = p.count.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c[1:32] ** 2).sum())

        options = [0, *[h for h in range(1, 32 - size + 1) if p.count[h]]]
        assert after(p.level_for(size)) == min(map(after, options))


def plain_repeats(texts, size):
    seen, out = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if b[i : i + size] in seen:
                m[i : i + size] = True
            else:
                seen.add(b[i : i + size])
        out[d] = (len(b), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest(), int((np.diff(m.astype(int), prepend=0) == 1).sum()))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_match_brute_force(spark, docs, texts, batches):
    some = {d: t for d, t in texts.items() if len(t) < 30_000}
    own = docs.where(F.length(F.coalesce("text", F.lit(""))) < 30_000)
    got = {r["doc_id"]: (r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), len(r["spans"])) for r in suffixes.without_repeats(own, batches=batches).collect()}
    assert got == plain_repeats(some, 100)
    assert suffixes.without_repeats(docs.where("false")).count() == 0


def test_repeats_leave_only_their_spans_behind(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    own = docs.where(F.length(F.coalesce("text", F.lit(""))) < 5_000)
    out = suffixes.without_repeats(own, batches=4)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["spans"]
    assert out.count() == own.count()


def plain_components(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_matches_brute_force(spark, docs, texts, monkeypatch):
    base = ("the quick brown fox jumps over a lazy dog while many small birds sing near the old stone bridge and " * 2).split()
    g = np.random.default_rng(1)
    more = {}
    for k in range(60):  # a family of mutated copies that chain
        w = list(base)
        for j in g.choice(len(w), k % 7, replace=False):
            w[j] = f"m{g.integers(0, 40)}"
        more[20_000 + k] = " ".join(w)
    every = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    want = plain_components(texts | more)
    for pack, tile in ((512, 1024), (16, 8)):  # with tiles of 8 the family is dealt to slots and settled in the second pass
        monkeypatch.setattr(jaccard, "PACK", pack)
        monkeypatch.setattr(jaccard, "TILE", tile)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_texts(every).collect()}
        assert got == want
    one = {r["doc_id"] for r in jaccard.one_of_each(every.withColumn("_gone", F.lit(1))).collect()}
    assert one == {d for d, (_, c) in want.items() if c == d}
    assert jaccard.near_texts(docs.where("false")).count() == 0


def test_jaccard_where_ids_repeat(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (4, b + " x"), (3, a + " y"), (None, a), (7, "short"), (7, "short"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(0))
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.near_texts(df).collect())
    assert got == [(0, 26, 0), (3, 27, 3), (4, 27, 4), (5, 26, 3), (5, 26, 4), (7, 1, 7), (7, 1, 7), (8, 0, 8)]
    left = sorted(((r["doc_id"] or 0), r["text"]) for r in jaccard.one_of_each(df).collect() if r["text"])
    assert left == sorted([(0, a), (3, a + " y"), (4, b + " x"), (7, "short")]) and jaccard.one_of_each(df).columns == df.columns


def test_jaccard_links_come_from_the_tree(spark, monkeypatch):
    g = np.random.default_rng(6)
    rows = [(i, " ".join(f"t{i % 50}w{k}" if k != i // 50 else "other" for k in range(120))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{g.integers(0, 9)}" for _ in range(90))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: c for d, (_, c) in plain_components(dict(rows)).items()}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_texts(df).collect()} == want
    assert sum(d != c for d, c in want.items()) == 250
    # a tree that answers nothing leaves no link at all: there is no other way to one
    doc, f, n = np.arange(6), np.zeros(6, np.int64), np.full(6, 40)
    groups, points = [np.array([0])] * 6, np.ones((6, jaccard.GROUPS), np.uint8)
    sets = [np.arange(40, dtype=np.int64).tobytes()] * 6
    task = (doc, f, doc.copy(), np.zeros(6, np.int64), groups, points, n, sets)
    assert len(list(jaccard.verified(*task))) == 5
    nothing = np.zeros(0, np.int64)
    monkeypatch.setattr(jaccard.CountTree, "search", lambda *_: (nothing, nothing))
    assert list(jaccard.verified(*task)) == []


def test_jaccard_where_one_passage_is_in_every_part(spark, monkeypatch):
    # a licence line once or twice in each text, near copies here and there; ranked or not, the line is no link by itself
    g = np.random.default_rng(8)
    line = "this work comes without any warranty and under the terms of its licence"
    bodies = [" ".join(f"w{g.integers(0, 10**6)}" for _ in range(60)) for _ in range(150)]
    texts = {i: f"{line} {b}" + (f" {line}" if i % 3 == 0 else "") for i, b in enumerate(bodies)}
    texts |= {500 + i: t + " end" for i, t in texts.items() if i % 5 == 0}
    texts |= {900: line, 901: line + " x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    want = plain_components(texts)
    for ranked in (500_000, 0):
        monkeypatch.setattr(jaccard, "RANKED", ranked)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_texts(df).collect()} == want


def test_count_tree_never_misses():
    g = np.random.default_rng(2)
    points = g.poisson(1.0, (500, jaccard.GROUPS)).astype(np.int32)
    points[:200] = points[0] + g.poisson(0.05, (200, jaccard.GROUPS))
    sizes = points.sum(1)
    points[200:210, 3] = 70_000  # more than 16 bits hold
    points = jaccard.points_of([jaccard.point_bytes(p) for p in points])
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard.CountTree(points, sizes)
    q, e = tree.search(points, sizes)
    got = set(zip(q.tolist(), e.tolist(), strict=True))
    for i in range(500):
        fits = (4 * np.minimum(sizes, sizes[i]) >= 3 * np.maximum(sizes, sizes[i])) & (np.minimum(points, points[i]).sum(1) >= jaccard.needed(sizes[i], sizes))
        assert {k for j, k in got if j == i} == set(np.flatnonzero(fits).tolist())


def test_vectors_match_brute_force(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + g.normal(size=16) * 0.08 * (i % 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, []), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [1.0] * 15 + [None]), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, rows[1][1]), (308, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS rep", "1 AS cell")
    sound = {i: np.array(v, np.float64) for i, v in rows if i is not None and (i <= 300 or i in (306, 307))}
    unit = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in unit}

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    for tile in (8192, 50):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(df, tile=tile).collect() if r["vec_id"] is not None}
        assert got == {i: (len(links.get(i, ())), least(i)) for i, _ in rows if i is not None}
    assert neighbours.near_vectors(df.where("false")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in common.components(edges, "path").collect()}
    assert got == dict.fromkeys(range(201), 0)
    assert common.components(edges.where("false"), "none").count() == 0


def test_language_on_held_out_documents(spark, docs):
    lang = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    out = catalogue.QUERIES["op8_language"](spark, MIDDLE).join(lang, "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    model = language.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    odd = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert odd[10_000]["lang_pred"] == odd[10_001]["lang_pred"] == "und" and odd[10_000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in odd.values())
    assert language.train(docs.where("false").withColumn("lang", F.lit("en")))[0] == []
    assert {r["lang_pred"] for r in language.identify(docs, ([], None, np.zeros((0, 1)))).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark, docs):
    folder = "/root/testdata/sf0.1"
    out = catalogue.QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    r = out.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("acc"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall")).first()
    assert r["acc"] > 0.93 and r["recall"] > 0.88
    labels = spark.createDataFrame([(10_000, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    odd = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    assert len(odd) == docs.count() and all(0 <= x["score"] <= 1 for x in odd)


def test_toxicity_counts_frequent_bigrams_whole(spark):
    # "alpha beta" after 600 words in toxic texts and after 60 in ordinary ones; both words are as frequent in either class
    toxic = [f"w{i} alpha beta x{i} gamma delta" for i in range(600)]
    plain = [f"w{i} alpha beta x{i} gamma delta" if i < 60 else f"w{i} alpha delta x{i} gamma beta" for i in range(600)]
    rows = [(i, t, int(i < 600)) for i, t in enumerate(toxic + plain)] + [(5000, "alpha beta", None), (5001, "alpha delta", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    n = {r["pair"]: (r["t"], r["o"]) for r in toxicity.counts(df.where("toxic is not null").select("text", "toxic")).collect()}
    pair = {t: int(toxicity.bigrams(pa.array([t]))[0][1]) for t in ("alpha beta", "alpha delta")}
    assert n[pair["alpha beta"]] == (600, 60) and n[pair["alpha delta"]] == (0, 540)
    out = {r["doc_id"]: r["ratio"] for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True)).where("doc_id >= 5000").collect()}
    assert out[5000] > 0.5, out


def test_toxicity_scores_with_the_whole_model(spark):
    # however few rows of the model are broadcast, the others are joined
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "no id"), (-1, None), (-1, "")], "doc_id long, text string"))
    whole, joined = ({(r["doc_id"], i) if r["doc_id"] in (None, -1) else r["doc_id"]: r["ratio"] for i, r in enumerate(toxicity.toxicity(docs, labels, F.lit(True), keep=k).orderBy("doc_id", "ratio").collect())} for k in (300_000, 5))
    assert whole.keys() == joined.keys() and len(whole) == docs.count() and any(whole.values())
    assert max(abs(whole[k] - joined[k]) for k in whole) < 1e-6


def plain_model(rows, discount, least):
    """The toxicity model of rows (text, toxic) in plain dictionaries, by words: the ratio that a word, a word's backoff and a bigram add."""
    t, o = Counter(), Counter()
    for text, toxic in rows:
        w = ["^", *re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
        (t if toxic else o).update(zip(w, w[1:], strict=False))
    pairs = sorted(set(t) | set(o))
    words, before = sorted({w for _, w in pairs}), sorted({v for v, _ in pairs})
    ct, co = ({w: sum(1 for p in pairs if p[1] == w and n[p]) for w in words} for n in (t, o))
    cs = Counter(w for _, w in pairs)
    zt, zo, zs = sum(ct.values()), sum(co.values()), len(pairs)

    def p(c, z):
        kinds = sum(v > 0 for v in c.values())
        return {w: (max(c[w] - discount, 0) + discount * kinds * cs[w] / zs) / z for w in words}

    def sure(r, a, b, odds):
        share = 1 / (1 + math.exp(-odds))
        z = max(abs(a - (a + b) * share) - 0.5, 0) / math.sqrt((a + b) * share * (1 - share))
        return r * (1 - least * least / (z * z)) if z > least else 0.0

    def middle(values, counts):
        of = {}
        for k, v in values.items():
            of.setdefault(math.floor(2 * math.log2(counts[k])), []).append(v)
        return {k: sorted(of[math.floor(2 * math.log2(counts[k]))])[(len(of[math.floor(2 * math.log2(counts[k]))]) - 1) // 2] for k in values}

    pt, po, odds = p(ct, zt), p(co, zo), math.log(zt / zo)
    raw = {w: math.log(pt[w] / po[w]) for w in words}
    usual = middle(raw, {w: ct[w] + co[w] for w in words})
    out = {(w,): sure(raw[w] - usual[w], ct[w], co[w], usual[w] + odds) for w in words}
    vt, vo, kt, ko = ({v: sum(f(n[q]) for q in pairs if q[0] == v) for v in before} for n, f in ((t, int), (o, int), (t, bool), (o, bool)))
    mt, mo = ({v: discount * k[v] / n[v] if n[v] else 1.0 for v in before} for n, k in ((vt, kt), (vo, ko)))
    b = {v: math.log(mt[v] / mo[v]) for v in before}
    usual_b = middle(b, {v: kt[v] + ko[v] for v in before})
    back = {v: sure(b[v] - usual_b[v], kt[v], ko[v], usual_b[v] + math.log(max(vt[v], 0.5) / max(vo[v], 0.5))) for v in before}
    out |= {("after", v): x for v, x in back.items()}
    for v, w in pairs:
        full = [(max(n[v, w] - discount, 0) / s[v] if s[v] else 0) + m[v] * q[w] for n, s, m, q in ((t, vt, mt, pt), (o, vo, mo, po))]
        out[v, w] = sure(math.log(full[0] / full[1]) - raw[w] - back[v], t[v, w], o[v, w], raw[w] + odds)
    return {k: x for k, x in out.items() if x}


def test_toxicity_model_matches_a_plain_one(spark):
    g = np.random.default_rng(12)
    rows = [(" ".join(g.choice(["alpha", "Beta", "gamma", "delta", "eps"], 12, p=[0.4, 0.1, 0.2, 0.2, 0.1] if k % 3 == 0 else [0.1, 0.3, 0.2, 0.2, 0.2])), int(k % 3 == 0)) for k in range(30)]
    for least in (0.2, 1.0):
        want = plain_model(rows, 0.75, least)
        got = {r["key"]: r["r"] for r in toxicity.train(spark.createDataFrame(rows, "text string, toxic int"), least=least).collect()}
        ids = {w: int(toxicity.word_ids(pa.array([w]))[0][0]) for w in ("alpha", "beta", "gamma", "delta", "eps")} | {"^": int(toxicity.OPENING)}
        key = lambda k: ids[k[0]] if len(k) == 1 else -ids[k[1]] if k[0] == "after" else ids[k[0]] << 31 | ids[k[1]]
        assert len(want) > 5 and got.keys() == {key(k) for k in want} and all(math.isclose(got[key(k)], x, rel_tol=1e-5, abs_tol=1e-6) for k, x in want.items())


def test_language_matches_plain_naive_bayes(spark):
    g = np.random.default_rng(8)
    letters = {"aa": "abcde fg", "bb": "defgh ab", "cc": "abgh xyz"}
    rows = [(i, "".join(g.choice(list(letters[n]), int(g.integers(1, 120)))), n) for i, n in enumerate(["aa", "bb", "cc", "aa", "aa"] * 12)]
    rows += [(90, "ABc", None), (91, None, "aa"), (92, "abc", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    buckets = 1 << 10

    def plain(text):
        codes = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in f"\n{text}\n"]
        return [int(language.gram_buckets(np.array(codes[i : i + n], np.uint64), n, buckets)[0]) for n in (2, 3) for i in range(len(codes) - n + 1)]

    known = [(t, n) for _, t, n in rows if t is not None and n]
    names = sorted({n for _, n in known})
    prior = {n: math.log((1 + sum(m == n for _, m in known)) / (len(names) + len(known))) for n in names}
    count = {n: Counter(b for t, m in known if m == n for b in plain(t)) for n in names}
    model = language.train(df, buckets=buckets)
    assert model[0] == names
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    for i, t, _ in rows:
        own = plain(t or "")
        like = {n: sum(math.log((count[n][b] + 0.5) / (sum(count[n].values()) + 0.5 * buckets)) for b in own) for n in names}
        if not t or not any(map(str.isalpha, t)):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        best = max(names, key=lambda n: like[n] + prior[n])
        shown = {n: math.exp((like[n] - like[best]) * min(1, 60 / len(own)) + prior[n] - prior[best]) for n in names}
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(shown.values()), abs=1e-3)
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert language.accepted(none, language.train(none)).count() == len(rows)  # nothing learned, nothing rejected
    # what a text's neighbours in a batch are makes no difference
    one = {r["doc_id"]: r["score"] for r in language.identify(df.repartition(40, "doc_id"), model).collect()}
    assert all(abs(one[i] - got[i]["score"]) < 1e-9 for i in one)


def test_double_vectors_keep_their_digits(spark):
    a = [1.0, 0.0, 0.0, 0.0]
    angle = math.acos(0.95)
    rows = [(1, a), (2, [math.cos(angle - 1e-10), math.sin(angle - 1e-10), 0.0, 0.0]), (3, [math.cos(angle + 1e-10), 0.0, math.sin(angle + 1e-10), 0.0])]
    got = {r["vec_id"]: r["component_id"] for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_vectors_of_any_magnitude_link_by_direction(spark):
    rows = [(1, [1e-170, 2e-170, 0.0, 0.0]), (2, [1.0, 2.0, 0.0, 0.0]), (3, [1e200, 1e200, 0.0, 1e199]), (4, [2e200, 2e200, 0.0, 2e199]), (5, [5e-324, 0.0, 0.0, 0.0]), (6, [1.7e308, 0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0, -3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_repeats_where_ids_repeat_or_texts_are_long(spark, monkeypatch):
    g = np.random.default_rng(5)
    text = lambda n: "".join(g.choice(list("abcdefgh"), n))
    x, y = text(150), text(150)
    df = spark.createDataFrame([(1, x), (2, x), (2, y), (2, "short"), (None, x), (3, None)], "doc_id long, text string").withColumn("row", F.lit(1))
    got = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in suffixes.without_repeats(df).collect())
    assert got == sorted([(0, x), (1, x), (2, ""), (2, y), (2, "short"), (3, "")])
    monkeypatch.setattr(suffixes, "STRETCH", 512)  # anchors found by stretches are those of the whole text
    roll, at = suffixes.Rolling(np.frombuffer((text(3000) + x * 3).encode(), np.uint8)), np.array([0, 3450])
    parts = suffixes.anchors(roll, at, 100, 40)
    monkeypatch.setattr(suffixes, "STRETCH", 1 << 25)
    assert all((p == q).all() for p, q in zip(parts, suffixes.anchors(roll, at, 100, 40), strict=True))


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(13)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    taken = " ".join(f"q{k}" for k in range(13))
    near = " ".join(f"w{k}" for k in range(60))
    kind = "doc_id long, text string, lang string, source string, n_chars long, row int, spans string, comp int, component_id int, h int"
    rows = [(1, near, "en"), (2, near + " more", "en"), (2, "other words in here", "en"), (None, "mail me at a.b@c.de", "en"), (None, taken, "en"), (3, taken, "en"), (3, "a clean one", "en"), (4, None, "en"), (5, "", None), (5, "", "en"), (6, "123", None)]
    docs = spark.createDataFrame([(i, t, n, "s", len(t or ""), 1, "x", 2, 3, 4) for i, t, n in rows], kind)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r["doc_id"] or 0), r["text"] or "") for r in df.collect())
    here = sorted((i or 0, t or "") for i, t, _ in rows)
    kept = texts(stages["language"](spark, docs, str(tmp_path)))
    assert kept == [x for x in here if any(map(str.isalpha, x[1]))]
    assert texts(stages["near_duplicates"](spark, docs, str(tmp_path))) == [x for x in here if x[1] != near + " more"]
    assert texts(stages["decontamination"](spark, docs, str(tmp_path))) == [x for x in here if x[1] != taken]
    assert texts(stages["personal_data"](spark, docs, str(tmp_path))) == sorted((i, t.replace("a.b@c.de", "[email]")) for i, t in here)
    assert stages["packing"](spark, docs, str(tmp_path)).count() >= len(rows)
    for name, stage in stages.items():
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        path = common.scratch(spark, "s")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            assert set(before) == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
            break
        assert docs.columns == names
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in plain_components(before).items() if c == d}
        elif name == "decontamination":
            oracle = decontaminate.contamination(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            assert oracle.where("n_hit > 0 and 20 * n_hit >= n_words").count() == 0 and set(after) <= set(before)
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all(brute.personal(after[d]) == [] for d in after) and all(after[d] == t for d, t in before.items() if not brute.personal(t))
