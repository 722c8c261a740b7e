"""Small cases for the operators: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewell.llm import _chunks, decontaminate, embedding_dedup, language_id, license_scan, lm_score, mixing, ngram_join, substring_dedup, token_counts, toxicity
from phrasewell.llm._components import components
from phrasewell.llm._vec import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
EDGE = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, "  \t\n ", "en", "a", 5),
    (3, LONG, "en", None, 1),
    (4, LONG + " tail", "en", "b", 1),
    (5, "one two", "fr", "a", 1),
    (6, "One TWO", "fr", "a", 1),
    (7, f"x y {PASSAGE} z", "de", "c", 1),
    (8, f"q {PASSAGE} r s t u", "de", "c", 1),
    (8, f"q {PASSAGE} r s t u", "de", "c", 1),
    (9, "été İstanbul ſ K 中文 😀 \x0b a\x00b", "fr", "é", 1),
    (None, f"v {PASSAGE}", "en", "c", 1),
]


def frame(spark, rows=EDGE):
    """The rows with more columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("score", "n_words", "kept", "_row", "bucket", "rank"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text, lower=False):
    text = (text or "").translate(LOWER) if lower else (text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def alnum(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


@pytest.fixture(autouse=True, params=[None])
def small_chunks(monkeypatch):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 60_000)


def test_word_hashes_agree_with_split():
    texts = [None, b"", b" a  b\t\na ", LONG.encode(), "été été".encode()]
    h, ends = word_hashes(texts)
    flat = [w for t in texts for w in re.split(rb"[\x20\x09-\x0D]+", t or b"") if w]
    assert len(h) == len(flat) == ends[-1]
    ids = {}
    assert all(ids.setdefault(w, x) == x for w, x in zip(flat, h.tolist())) and len(set(ids.values())) == len(ids)


def test_words_across_pieces(monkeypatch):
    from phrasewell.llm import _vec

    text = (LONG + " " + "y" * 5000 + " end").encode()
    whole = word_hashes([text])
    monkeypatch.setattr(_vec, "PIECE", 1000)
    cut = word_hashes([text])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (2, 1)], "u long, v long")
    assert dict(tuple(r) for r in components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


# 1 ---


def test_license_scan(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. All rights reserved; all rights reserved."),
        (2, "GNU General Public License v3, see the general public license"),
        (3, None),
        (4, "nothing " * 500 + "all rights reserved"),
        (5, "SPDX-License-Identifier: MIT"),
        (6, "All Rights\nReserved. " * 3000),
        (7, "CC-BY accby by"),
    ]
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 10, "cc-by,reserved")
    assert got[1]["labels"] == "cc-by,cc-by-nc,reserved"
    assert (got[2]["n_base"], got[2]["base_labels"]) == (2, "gpl") and "gpl-3.0" in got[2]["labels"] and "gnu-gpl" not in got[2]["labels"]
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, 0, None, "", 0.0)
    assert (got[4]["n_words"], got[4]["first_word"], got[4]["last_word"]) == (503, 500, 500)
    assert got[5]["labels"] == "mit" and got[5]["score"] == 1.0
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (3000, 0, 8997)
    assert (got[7]["n_base"], got[7]["first_word"]) == (1, 0)
    assert len(license_scan.rules()) > 200
    assert license_scan.scan(empty(spark)).count() == 0
    out = license_scan.digest(license_scan.scan(frame(spark)))
    assert sorted(r["n_words"] for r in out.collect()) == sorted(len(alnum(r[1])) for r in EDGE)


def test_license_fields_in_both_spellings(spark):
    rows = [(1, "Licence: MIT"), (2, "The licence is Apache 2.0."), (3, "License: MIT"), (4, "licence")]
    got = {r["doc_id"]: (r["labels"], r["score"], r["n_base"]) for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: ("mit", 0.8, 0), 2: ("apache-2.0", 0.8, 0), 3: ("mit", 0.8, 0), 4: ("", 0.0, 0)}


# 2 ---


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(40, 16))
    for i, b in enumerate(base):
        for j in range(1 + i % 5):
            rows.append((len(rows), [float(np.float32(x)) for x in b + rng.normal(size=16) * 0.05 * j], i % 3))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(300)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 16, 0), (2004, rows[0][1], None), (2005, [2.0, 1.0], 0), (2006, [4.0, 2.0], 0), (2006, [4.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rid", F.lit(1))
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id").collect())
    good = [(v, np.asarray(e, float), lab) for v, e, lab in rows if lab is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    par = list(range(len(good)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    links = Counter()
    for i in range(len(good)):
        for j in range(i):
            a, b = good[i], good[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                par[y] = x
    least = {}
    for i, g in enumerate(good):
        least[find(i)] = min(least.get(find(i), g[0]), g[0])
    want = [(g[0], links[i], least[find(i)]) for i, g in enumerate(good)]
    ids = {id(g) for g in good}
    want += [(v, 0, v) for v in (2000, 2001, 2002, 2003, 2004)]
    assert ids and got == sorted(want)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_recall(spark, sf):
    v = [(r[0], np.asarray(r[1], float), r[2]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = np.stack([a for _, a, _ in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.asarray([c for _, _, c in v])
    links = ((x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.query(spark, sf).collect()}
    found = sum(min(got[i], n) for (i, _, _), n in zip(v, links.tolist()))
    assert all(got[i] <= n for (i, _, _), n in zip(v, links.tolist())) and found >= 0.9 * links.sum()


def planted(rng, n, sizes):
    """n unit vectors of 64 numbers, the first of them in groups of near copies (cosine about 0.95) of these sizes; each vector's group."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = []
    for m in sizes:
        c, u = unit(rng.normal(size=(1, 64))), rng.normal(size=(m, 64))
        parts.append(math.sqrt(0.95) * c + math.sqrt(0.05) * unit(u - (u @ c.T) * c))
    x = np.concatenate([*parts, unit(rng.normal(size=(n - sum(sizes), 64)))]).astype(np.float32)
    return x, np.repeat([*sizes, 1], [*sizes, n - sum(sizes)])


def links_of(spark, folder, x):
    """n_links by the operator and by brute force, one label for all."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = f"{folder}/planted.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(len(x), np.int32)}), path)
    got = dict(tuple(r) for r in embedding_dedup.near_duplicates(spark.read.parquet(path)).select("vec_id", "n_links").collect())
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(y[i : i + 1000] @ y.T >= 0.93).sum(axis=1) - 1 for i in range(0, len(y), 1000)])
    return np.asarray([got[i] for i in range(len(x))]), want


def test_embedding_dense_group(spark, tmp_path):
    x, _ = planted(np.random.default_rng(5), 6000, [2000])
    got, want = links_of(spark, tmp_path, x)
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_embedding_recall_by_group_size(spark, tmp_path):
    x, size = planted(np.random.default_rng(11), 24_000, [8000, 2000, 300, 50, 10, *[5] * 40, *[2] * 400])
    got, want = links_of(spark, tmp_path, x)
    assert len(np.unique(x, axis=0)) == 24_000 and (got <= want).all()
    for m in (8000, 2000, 300, 50, 10, 5, 2):
        assert 0 < 0.99 * want[size == m].sum() <= got[size == m].sum(), m


def test_embedding_pivots_are_spread():
    x, _ = planted(np.random.default_rng(6), 3000, [1000])
    p = embedding_dedup._spread(x.astype(float), 400, 0.93)
    assert len(p) == 400 and (p @ p.T - 2 * np.eye(400)).max() < 2 * 0.93**2 - 1
    assert len(embedding_dedup._spread(x[:1000].astype(float), 400, 0.93)) == 1


# 3 ---


def test_folding_and_exceptions():
    assert toxicity.fold("IDІОT 1d10t ｉdiot i​diot") == " idiot idiot idiot idiot "
    assert toxicity.fold("in 2024, 3 $") == " in "
    m = toxicity.Matcher({" clown": 3.0, " idiot ": 2.0}, ("clown fish",))
    assert m.features("clowns and idiot idiots")[:3] == (5.0, 3.0, 2)
    assert m.features("a clown fish")[0] == 0.0
    assert m.features(None) == (0.0, 0.0, 0, 0) and m.features("") == (0.0, 0.0, 0, 0)
    assert m.features("x " * 50_000 + "cl0wn")[2] == 1


def test_toxicity_learns(spark):
    bad = [(i, f"this one is a grumpf{i % 3} thing word{i} here", 1) for i in range(60)]
    good = [(100 + i, f"this one is a nice thing word{i} here", 0) for i in range(120)]
    model = toxicity.learn(spark.createDataFrame([*bad, *good, (900, None, 0), (901, "x", None)], "doc_id long, text string, toxic int"))
    docs = spark.createDataFrame([(1, "some Grumpf9 words"), (2, "some nice words"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[1]["predicted"] == 1 and all(got[i]["predicted"] == 0 for i in (2, 3, 4))
    none = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert all(r["score"] == 0.0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.score(frame(spark), model).count() == len(EDGE)


def test_rare_entries_are_not_crowded_out(spark):
    """Copies of a long toxic text add more than 20,000 entries of more weight than a rarer word."""
    rng = np.random.default_rng(8)
    long = " ".join("".join(w) for w in rng.choice(list("bcdfgklmnprtuvz"), (5000, 9)))
    rows = [(long, 1)] * 60 + [(f"a vexoqua day {i}", 1) for i in range(5)] + [(f"a calm day {i}", 0) for i in range(200)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int").repartition(4))
    assert any(" vexoqua ".startswith(e) for e in model["weights"])
    docs = spark.createDataFrame([(1, "a vexoqua day"), (2, "a calm day")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_matches"] for r in toxicity.score(docs, model).collect()}
    assert got == {1: 1, 2: 0}


def test_pruning_by_stem_is_pruning_of_all(spark):
    rows = [(" idio", 9, 0, 3.0), (" idiot", 8, 0, 3.5), (" idiot ", 8, 0, 5.0), (" idiotic ", 3, 0, 4.0), (" fop ", 3, 0, 3.0), (" fopp", 3, 0, 3.0), (" fopp ", 3, 0, 3.0), (" idle", 4, 0, 2.5)]
    df = spark.createDataFrame(rows, "entry string, toxic long, clean long, w double").repartition(4)
    assert {r["entry"]: r["w"] for r in toxicity._distinct_stems(df).collect()} == toxicity._pruned(rows)


# 4 ---


def brute_hits(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(8, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, its = alnum(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    its |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()))
    return sorted(out, key=repr)


ITEMS = [(1, PASSAGE), (2, "P5 p6, p7 p8 p9 p10 p11 p12 p13"), (3, "one two"), (4, None), (5, "..."), (6, "w5 w6 w7 w8 w9 w10 w11 w12"), (None, "q p0"), (7, "one two"), (8, "w1 w1 w1 w1 w1 w1 w1 w1")]


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontaminate(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(frame(spark), items, broadcast_windows=most)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_hits([r[:2] for r in EDGE], ITEMS)
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.decontaminate(frame(spark), items.limit(0)).where("n_hit > 0").count() == 0


# 5 ---


def brute_join(docs):
    sets = []
    for _, t in docs:
        w = words(t, True)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    par = list(range(len(docs)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                par[y] = x
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)].append(d[0])
    return sorted(((d[0], len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else d[0]) for i, d in enumerate(docs)), key=repr)


@pytest.mark.parametrize(("tile", "grams", "few"), [(1024, 1_500_000, 256), (4, 1_500_000, 256), (16, 900, 4)])
def test_ngram_join(spark, monkeypatch, tile, grams, few):
    import random

    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "GRAMS", grams)
    monkeypatch.setattr(ngram_join, "FEW", few)
    r = random.Random(5)
    base = [f"v{r.randrange(4000)}" for _ in range(90)]
    rows = [x for x in EDGE]
    for i in range(60):  # near copies with edits of their own, some near the threshold
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"e{r.randrange(30)}"
        rows.append((100 + i, " ".join(w), "en", "a", 1))
    for i in range(40):  # a passage that many share
        rows.append((300 + i, " ".join([f"u{r.randrange(9999)}" for _ in range(r.randrange(10, 60))] + base[:30]), "en", "a", 1))
    w = [f"z{r.randrange(4000)}" for _ in range(120)]
    for i in range(30):  # a chain: each links with its neighbours and not with the ends
        rows.append((500 - i, " ".join(w), "en", "a", 1))
        w = w[6:] + [f"y{r.randrange(9999)}" for _ in range(6 if i != 14 else 40)]
    got = sorted((tuple(x) for x in ngram_join.join(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_join([x[:2] for x in rows])


def test_representatives(spark):
    got = ngram_join.representatives(frame(spark))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([0, 1, 2, 3, 5, 7, 9])  # 8 and the one without id link with 7
    assert ngram_join.representatives(empty(spark)).count() == 0


@pytest.mark.parametrize(("few", "cells", "pairs"), [(256, 4_000_000, 2_000_000), (4, 600, 7)])
def test_partial_overlaps(monkeypatch, few, cells, pairs):
    for name, value in (("FEW", few), ("CELLS", cells), ("PAIRS", pairs)):
        monkeypatch.setattr(ngram_join, name, value)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    held = [x.tobytes() for x in sets]
    want = np.asarray([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngram_join._overlaps(held, np.arange(60))
    assert (np.triu(got, 1) == np.triu(want, 1)).all()
    assert (ngram_join._overlaps(held, np.arange(20), np.arange(20, 60)) == want[:20, 20:]).all()


# 6 ---


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "en", ["a", "b", "c", None][i % 4] if i % 3 else "a", 1) for i in range(400)] + EDGE[:3] + [(500, "x", "en", "Z", 1)]
    got = [r.asDict() for r in mixing.mix(frame(spark, rows)).collect()]
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(frame(spark, rows).repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(frame(spark, EDGE[:3])).collect())


def solved(size: list[int], target: float) -> list[float]:
    """Rates of one source's documents by bisection of the dual."""
    mean = sum(size) / len(size)
    lo, hi = -1e4, 1e4
    rate = lambda lam: [math.exp(min(math.log(3), max(-700.0, lam * x / mean))) for x in size]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(w * x for w, x in zip(rate(mid), size, strict=True)) < target else (lo, mid)
    return rate(lo)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_entropy_balance(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    import random

    r = random.Random(3)
    rows = [(i, " ".join(["w"] * (1 + int(r.paretovariate(0.8)) % 3000)), "en", ["a", "b", "c", "d", None][min(4, int(r.expovariate(0.9)))], 1) for i in range(500)]
    got = mixing.mix(frame(spark, rows).repartition(5)).collect()
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
    assert len(by) == 5
    for found in by.values():
        size, target = [x["size"] for x in found], found[0]["target"]
        want = solved(size, target) if target < 3 * sum(size) * (1 - 1e-9) else [3.0] * len(size)
        assert [x["rate"] for x in found] == pytest.approx(want, abs=2e-6)
        assert abs(sum(x["taken"] for x in found) - target) <= 1
        assert all(x["taken"] <= 3 * x["size"] and math.floor(x["rate"]) * x["size"] <= x["taken"] <= math.floor(x["rate"] + 1) * x["size"] for x in found)
    assert max(len({x["rate"] for x in found}) for found in by.values()) > 20  # rates differ within a source


def test_newton_meets_the_constraints(spark):
    counts = spark.createDataFrame([("a", 1 + k * k, 1 + k % 3) for k in range(60)] + [("b", 7, 5), ("b", 9000, 1), (None, 3, 2)], "source string, size long, _n long")
    whole = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    for share in (0.001, 0.3, 1.0, 1.7, 2.999):
        found = mixing.rates(counts, whole.withColumn("target", share * F.col("source_size"))).collect()
        assert len(found) == 3 and all(abs(x["gradient"]) <= 1e-9 for x in found)
    none = mixing.rates(counts, whole.withColumn("target", F.lit(0.0))).collect()
    assert all(x["lambda"] is None for x in none)


# 7 ---


def test_language_id(spark):
    rows = [(f"der hund und die katze {i} nicht schön auch", "de") for i in range(50)] + [(f"le chien et la souris {i} n'est pas où", "fr") for i in range(50)] + [(None, "de"), ("x", None)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model["langs"] == ["de", "fr"]
    out = language_id.detect(frame(spark, [*EDGE[:3], (10, "die KATZE und der Hund", "", "", 1), (11, "la souris et le chien", None, None, 1), (12, "123 !?", "", "", 1), (13, "la souris " * 200_000, "", "", 1)]), model)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert [got[i][0] for i in (0, 1, 2, 10, 11, 12, 13)] == ["und", "und", "und", "de", "fr", "und", "fr"]
    assert all(0 <= s <= 1 for _, s in got.values())
    none = language_id.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.detect(frame(spark), none).collect()} == {"und"}
    assert language_id.detect(empty(spark), model).count() == 0


def test_language_accuracy(spark, sf):
    found = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


# 8 ---


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = EDGE + [(20 + i, t, "", "", 1) for i, t in enumerate([" ", "  ", "a  b", " a", "a ", "▁", "▁ a▁", "<s> </s>", "a\x00b", "\n\n a", "x" * 3000])]
    got = sorted((tuple(r) for r in token_counts.count_tokens(frame(spark, rows), path).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "")), len(model.encode(r[1] or "")) > 4096) for r in rows]
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


# 9 ---


def brute_dedup(docs, window=20):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (order(d), k)), (order(d), k))
    out = []
    for d, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (order(d), k):
                gone |= set(range(k, k + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_substring_dedup(spark, batches):
    rows = [*EDGE, (10, " ".join(["same"] * 100), "", "", 1), (11, " ".join(["same"] * 19), "", "", 1), (12, " ".join(["same"] * 20), "", "", 1)] + [(30 + i, f"{i} {i} {PASSAGE} {i}", "", "", 1) for i in range(30)]
    out = substring_dedup.dedup(frame(spark, rows), batches=batches)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == brute_dedup([r[:2] for r in rows])
    assert out.where("n_removed > 0 and kept_text is null").count() == 0
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_runs_are_compacted_between_batches(spark, monkeypatch):
    """With the batches of the query some batch meets an index that has been compacted, and later ones lose no history."""
    met, add, compact = [], substring_dedup.FingerprintIndex.add, substring_dedup.FingerprintIndex.compact
    state = {"compacted": False}

    def seen_compact(self):
        compact(self)
        state["compacted"] = True

    def seen_add(self, batch):
        met.append(state["compacted"])
        return add(self, batch)

    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", seen_compact)
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "add", seen_add)
    rows = [(i, f"{i} {PASSAGE if i % 2 else LONG[:400]} {i}", "", "", 1) for i in range(40)]
    got = sorted((tuple(r) for r in substring_dedup.dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == brute_dedup([r[:2] for r in rows]) and any(met)


# 10 ---


def test_lm_score(spark):
    rows = [*EDGE, *((40 + i, f"the cat sat on the mat {i % 3}", "", "", 1) for i in range(30))]
    docs = frame(spark, rows).withColumn("_train", F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))
    got = lm_score.score(docs).collect()
    tokens = [(d, [*words(t, True), None]) for d, t, *_ in rows]
    c = Counter(w for d, ws in tokens if d is None or d % 5 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in tokens), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=repr) == want
    by = {r["doc_id"]: r["score"] for r in got}
    assert all(math.isfinite(s) and s <= 0 for s in by.values())
    assert by[41] > sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words("the cat sat on the mat 1"), None])
    assert lm_score.score(docs.limit(0)).count() == 0
    assert all(r["n_known"] == 0 for r in lm_score.score(docs.withColumn("_train", F.lit(False))).collect())


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    b, q2, q1 = np.full(4000, 5), rng.choice([4, lm_score.BINS - 1], 4000, p=[0.7, 0.3]), np.full(4000, 40)
    w = lm_score.learn_weights((b * lm_score.BINS + q2) * lm_score.BINS + q1, np.ones(4000), 1000)
    assert np.allclose(w.sum(axis=1), 1) and 0.6 < w[5, 0] < 0.75


def test_crc_agrees():
    from phrasewell.llm._vec import crc_mod

    assert crc_mod([5, None], 7).tolist() == [zlib.crc32(b"5") % 7, 0]


def test_license_sql_agrees(spark):
    import duckdb

    rows = [(1, "Licensed under CC BY-NC 4.0. All rights reserved; all rights reserved."), (2, "GNU General Public License v3, see the general public license"), (3, None), (4, ""), (5, "SPDX-License-Identifier: MIT OR Apache-2.0"), (6, "All Rights\nReserved. " * 200), (7, "cc by cc by sa, in the public domain MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    rel = c.sql(license_scan.sql())
    got = license_scan.digest(license_scan.scan(docs)).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
