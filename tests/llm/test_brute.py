"""Operators that SQL can't express against plain restatements of their rules, and held-out quality."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_small import DOCS, EDGE, LONG, PASSAGE, brute_dedup, empty, frame, words

from phrasewell.llm import _chunks, language_id, license_scan, lm_score, substring_dedup, token_counts, toxicity

#: Large enough to tell quality; the smallest tables have too few labels.
QUALITY_SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(QUALITY_SF), reason="no test tables")


# 1 ---


def test_license_priority_decides_overlaps(spark):
    def labels(text):
        return license_scan.digest(license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]["labels"].split(",")

    assert "mit" in labels("Licensed under the MIT license.")
    kept = license_scan.scan(spark.createDataFrame([(1, "see the mit license")], "doc_id long, text string")).selectExpr("explode(kept) as d").select("d.*").collect()
    assert [(d["s"], -d["ne"], d["pr"]) for d in kept] == [(0, 4, 3)]  # the name inside is as good as nothing beside it


@pytest.mark.parametrize("seed", range(3))
def test_kept_detections_brute(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [[(int(s := rng.integers(0, 12)), -int(s + rng.integers(1, 7)), int(rng.integers(1, 7)), i, "x", 0.5, False) for i in range(int(rng.integers(0, 25)))] for _ in range(40)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, found {license_scan.DETECTION}")
    for r in df.withColumn("kept", license_scan._kept(F.col("found"))).collect():
        have = sorted(tuple(d) for d in rows[r["i"]])
        want = [d for k, d in enumerate(have) if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] <= d[1] for e in have[:k])]
        assert [tuple(d) for d in r["kept"]] == want


# 3 ---


def naive_features(text, weights, exceptions):
    folded = toxicity.fold(text)
    n = len(folded.split())
    inside = []
    for e in exceptions:
        p = f" {' '.join(toxicity.fold(e).split())} "
        inside += [(k, k + len(p)) for k in range(len(folded)) if folded.startswith(p, k)]
    found = {}
    for k, c in enumerate(folded):
        if c == " ":
            fits = [e for e in weights if folded.startswith(e, k)]
            if fits and not any(a <= k and k < b - 1 for a, b in inside):
                found[k] = weights[max(fits, key=len)]
    return (sum(found.values()), max(found.values(), default=0.0), len(found), n)


def test_toxic_matches_brute():
    import random

    r = random.Random(4)
    weights = {" fool ": 3.0, " foo": 2.5, " dolt": 4.0, " dolts ": 5.0, " é": 2.6}
    exceptions = ("fool proof", "no dolts here")
    pool = ["fool", "f00l", "foolish", "dolt", "D0LTS", "dolts", "proof", "here", "no", "été", "123", "x", "ｄｏｌｔ", "-", "fооl"]
    matcher = toxicity.Matcher(weights, exceptions)
    for _ in range(400):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(12)))
        got, want = matcher.features(text), naive_features(text, weights, exceptions)
        assert got == pytest.approx(want) if want[3] else got[:3] == (0.0, 0.0, 0), text


@needs_data
def test_toxic_quality(spark):
    labels = spark.read.parquet(f"{QUALITY_SF}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = toxicity.query(spark, QUALITY_SF).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in got if not r["toxic"]], [r["score"] for r in got if r["toxic"]]
    area = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    hit = [r for r in got if r["predicted"]]
    assert area >= 0.85 and sum(r["toxic"] for r in hit) >= 0.9 * len(hit) and sum(r["toxic"] for r in hit) >= 0.6 * len(bad)


# 7 ---


def exact_languages(docs, gram, rate):
    counts = defaultdict(Counter)
    for text, lang in docs:
        if text is not None and lang is not None:
            for h in language_id._grams(text, gram):
                counts[lang].update(h.tolist())
    return {lang: {k for k, n in c.items() if n >= rate * sum(c.values())} for lang, c in counts.items()}


def test_language_filters_brute(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    from phrasewell.llm._vec import crc_mod

    train = crc_mod([d[0] for d in docs], 5) != 0
    sets = exact_languages([d[1:] for d, t in zip(docs, train, strict=True) if t], language_id.GRAM, language_id.RATE)
    got = {r["doc_id"]: r for r in language_id.query(spark, sf).collect()}
    apart = 0
    for doc_id, text, _ in docs:
        h = [x for part in language_id._grams(text or "") for x in part.tolist()]
        if not h:
            assert (got[doc_id]["lang_pred"], got[doc_id]["score"]) == ("und", 0.0)
            continue
        share = {lang: sum(x in s for x in h) / len(h) for lang, s in sets.items()}
        best = max(share.values())
        assert abs(got[doc_id]["score"] - best) < 0.02  # false positives are corrected for in the mean
        apart += share[got[doc_id]["lang_pred"]] < best - 0.01
    assert apart <= 0.01 * len(docs)


def test_blocks_of_languages_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs.select("text", "lang"))
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.detect(docs.select("doc_id", "text"), model).collect()}
    monkeypatch.setattr(language_id, "LANGS_AT_ONCE", 1)
    model = language_id.learn(docs.select("text", "lang"))
    parts = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.detect(docs.select("doc_id", "text"), model).collect()}
    assert parts.keys() == whole.keys() and np.mean([parts[k][0] == whole[k][0] for k in whole]) >= 0.99
    assert all(abs(parts[k][1] - whole[k][1]) < 0.02 for k in whole)


# 8 ---


def test_forgotten_parts_change_nothing(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import random

    import sentencepiece

    r = random.Random(6)
    path = public_tokenizers.path(token_counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "x" * 5000, "中文" * 300, " a  b ", *(" ".join(r.choice(["alpha", "béta", "▁", "g" * 90, "", "\n"]) + str(r.randrange(50)) for _ in range(60)) for _ in range(30))]
    monkeypatch.setattr(token_counts, "REMEMBERED", 600)
    counter = token_counts.PieceCounter(path)
    for _ in range(2):
        assert counter.counts(texts) == [len(library.encode(t)) for t in texts]
        assert counter.held <= 600 and sum(len(p) + 8 for p in counter.known if p) <= 600
    assert max(map(len, counter.known)) <= token_counts.LONGEST_REMEMBERED


# 9 ---


def test_index_goes_on_in_a_later_session(spark, tmp_path):
    """Two sessions, each with an index object of its own, give what one call gives."""
    rows = [(i, f"{i} {PASSAGE if i % 3 else LONG[: 300 + 7 * i]} {i} {LONG[50 * i : 50 * i + 200]}", "", "", 1) for i in range(60)] + [(7, PASSAGE + " again", "", "", 1), (None, f"last {PASSAGE}", "", "", 1)]
    path = str(tmp_path / "index")
    cuts = [[r for r in rows if r[0] is not None and lo <= r[0] < lo + 15] for lo in range(0, 60, 15)]
    cuts[-1].append(rows[-1])
    got = []
    for part in cuts:
        session = spark.newSession()
        index = substring_dedup.FingerprintIndex(session, path, most_runs=2)
        got += index.add(session.createDataFrame(part, DOCS)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_dedup([r[:2] for r in rows])
    index = substring_dedup.FingerprintIndex(spark, path)
    assert index.state["compactions"] == 1 and len(index.state["texts"]) == 4 and len(index.state["runs"]) == 2
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path, window=12)
    again = substring_dedup.dedup(spark.createDataFrame([(900, PASSAGE, "", "", 1)], DOCS), path=path, batches=1).collect()
    assert again[0]["n_removed"] == 40 and again[0]["kept_text"] == ""


def test_a_failed_batch_leaves_the_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = substring_dedup.FingerprintIndex(spark, path)
    index.add(frame(spark, EDGE).select("doc_id", "text"))
    before = index.state["runs"][:]

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "_late", fails)
        with pytest.raises(RuntimeError):
            substring_dedup.FingerprintIndex(spark, path).add(frame(spark, EDGE).select("doc_id", "text"))
    later = substring_dedup.FingerprintIndex(spark, path)
    assert later.state["runs"] == before and later.add(spark.createDataFrame([(99, PASSAGE)], "doc_id long, text string")).collect()[0]["n_removed"] == 40


def test_clashing_columns_pass(spark):
    df = frame(spark, EDGE).withColumns({"h1": F.lit("y"), "start": F.lit(3), "n_removed": F.lit("z"), "kept_text": F.lit("z")})
    out = substring_dedup.dedup(df)
    assert set(out.columns) == (set(df.columns) - {"_row"}) | set(substring_dedup.ADDED)
    assert {(r["h1"], r["start"], r["score"], r["bucket"]) for r in out.collect()} == {("y", 3, "x", "x")} and out.count() == len(EDGE)


# 10 ---


def brute_lm(rows, train):
    """Deleted interpolation with dictionaries; EM sees estimates rounded to a quarter of an octave, scores are exact."""
    near = lambda p: 2.0 ** (-(min(math.floor(-math.log2(p) * 4), 198) + 0.5) / 4) if p else 0.0
    tokens = [[*words(t, True), None] for _, t in rows]
    c1, c2 = Counter(), Counter()
    for ws, on in zip(tokens, train, strict=True):
        if on:
            c1.update(ws)
            c2.update(zip([None, *ws[:-1]], ws, strict=True))
    n, v = sum(c1.values()), len(c1)
    group = lambda c: min(max(0, c).bit_length(), lm_score.BUCKETS - 1)
    seen = Counter()
    for (u, w), k in c2.items():
        context = c1[u] - 1
        seen[group(context), near((k - 1) / context if context else 0.0), near((c1[w] - 1) / max(1, n - 1))] += k
    weights = {b: [0.4, 0.5, 0.1] if b else [0.0, 0.9, 0.1] for b in range(lm_score.BUCKETS)}
    for _ in range(lm_score.EM_STEPS):
        new = {b: [0.0, 5e-4, 5e-4] for b in weights}
        for (b, p2, p1), k in seen.items():
            part = [x * y for x, y in zip(weights[b], (p2, p1, 1 / (v + 1)), strict=True)]
            for i in range(3):
                new[b][i] += k * part[i] / sum(part)
        weights = {b: [x / sum(w) for x in w] for b, w in new.items()}
    for b in range(1, lm_score.BUCKETS):
        if not any(k[0] == b for k in seen):
            weights[b] = weights[b - 1]
    out = []
    for ws in tokens:
        total = 0.0
        for u, w in zip([None, *ws[:-1]], ws, strict=True):
            l2, l1, l0 = weights[group(c1[u])]
            total += math.log10(l2 * (c2[u, w] / c1[u] if c1[u] else 0) + l1 * c1[w] / n + l0 / (v + 1))
        out.append(total)
    return out


def test_lm_score_brute(spark, monkeypatch):
    import random

    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 3_000)
    r = random.Random(8)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" if r.random() < 0.6 else "the cat sat" for _ in range(r.randrange(40)))) for i in range(150)] + [(300, None), (301, "")]
    train = [i % 4 != 0 for i, _ in rows]
    docs = spark.createDataFrame([(*x, t) for x, t in zip(rows, train, strict=True)], "doc_id long, text string, _train boolean")
    got = {x["doc_id"]: x["score"] for x in lm_score.score(docs.repartition(3)).collect()}
    for (i, _), want in zip(rows, brute_lm(rows, train), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-4)


@needs_data
def test_lm_learns_more_than_words(spark):
    got = lm_score.query(spark, QUALITY_SF).where("held_out and n_tokens > 20")
    assert got.where("score > base_score").count() >= 0.9 * got.count()


# The pipeline ---


def test_pipeline_on_edges(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")

    def run(name, rows, items):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        return pipeline.run(spark, sf).collect()

    assert run("no_rows", [], [(1, "a b c")]) == []
    got = run("edges", [*EDGE, (20, PASSAGE, "de", "c", 1), (20, PASSAGE, "de", "c", 1)], [])
    ids = {r["doc_id"] for r in got}
    assert ids <= {3, 4, 5, 6, 7, 8, 9, 20, None} and 5 in ids | {6} and all(r["taken"] >= 0 for r in got)
    assert empty(spark).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
