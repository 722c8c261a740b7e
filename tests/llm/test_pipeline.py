"""The pipeline against brute force, stage by stage, on a small fixture."""

from collections import Counter

import pytest
from test_llm_small import DOCS, PASSAGE, alnum, brute_dedup, brute_join, words

from phrasewell.llm import _chunks, language_id

pipeline = pytest.importorskip("corpus_pipeline")

ITEM = " ".join(f"bench{i}" for i in range(12))


@pytest.fixture
def folder(spark, tmp_path):
    import random

    r = random.Random(11)
    de, fr = "der die das und ist nicht schön auch mit einem hund katze wald haus".split(), "le la les et est pas très aussi avec un chien chat forêt maison".split()
    rows = []
    for i in range(60):
        lang, pool = (("de", de), ("fr", fr))[i % 2]
        text = " ".join(f"{r.choice(pool)}{r.choice(pool)}" for _ in range(r.randrange(30, 90)))
        rows.append((i, text, lang, "abc"[i % 3] if i % 4 else "a", len(text)))
    base = rows[3][1].split()
    rows += [(100, " ".join(base), "fr", "a", 1), (101, " ".join([*base[:-1], "et"]), "fr", "b", 1)]  # an exact and a near copy of 3
    rows += [(110 + k, f"{rows[k][1]} {PASSAGE} {rows[k][1][:20]}", "de", "c", 1) for k in (5, 6)]  # a passage that repeats
    rows += [(120, f"{rows[8][1][:60]} {ITEM} la maison", "fr", "b", 1)]  # a benchmark item
    rows += [(130, None, "de", "a", 0), (131, "", "de", "a", 0), (132, "12 34 !!", "fr", None, 8), (133, rows[10][1][::-1].replace("e", "n"), None, None, 1)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "nothing of this is anywhere in the documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder, monkeypatch):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 4_000)
    sf, rows = folder
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    def step(k):
        nonlocal docs
        docs = pipeline.materialize(pipeline.STAGES[k][1](spark, docs, sf))
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    got = step(0)
    assert docs.columns == columns and set(range(60)) <= set(got) and not {130, 131, 132} & set(got)
    kept = {c for d, _, c in brute_join(sorted(got.items()))}
    got = step(1)
    assert set(got) == kept and 100 not in got and 101 not in got and docs.columns == columns
    want = {d: (n, gone) for d, n, gone, _ in brute_dedup(sorted(got.items()))}
    before, got = got, step(2)
    assert set(got) == {d for d, (n, gone) in want.items() if gone < n or not n} and docs.columns == columns
    assert all(len(words(t)) == want[d][0] - want[d][1] for d, t in got.items()) and all(t == before[d] for d, t in got.items() if not want[d][1])
    windows = {tuple(w[k : k + 8]) for w in (alnum(ITEM),) for k in range(len(w) - 7)}
    dirty = {d for d, t in got.items() if any(tuple(alnum(t)[k : k + 8]) in windows for k in range(len(alnum(t))))}
    before, got = got, step(3)
    assert 120 in dirty and set(got) == set(before) - dirty and docs.columns == columns
    last = pipeline.materialize(pipeline.STAGES[4][1](spark, docs, sf)).collect()
    assert Counter({r["doc_id"]: r["size"] for r in last}) == Counter({d: len(words(t)) for d, t in got.items()})
    taken, target = Counter(), {}
    for r in last:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and text

    whole = pipeline.run(spark, sf)
    assert Counter((r["doc_id"], r["taken"]) for r in whole.collect()) == Counter((r["doc_id"], r["taken"]) for r in last)


def test_short_items_drop_no_clean_documents(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, "maison"), (3, "le chat"), (4, "of")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [
        (1, "dans la maison le chat dort toute la nuit", "fr", "a", 1),  # clean: short items in passing
        (2, f"la maison {ITEM}", "fr", "a", 1),
        (3, "Le chat!", "fr", "a", 1),  # nothing but an item
        (4, "le chat of maison dort", "fr", "a", 1),  # mostly items
        (5, "many words of a clean text", "fr", "a", 1),
        (6, " ".join(ITEM.split()[:7]), "fr", "a", 1),  # less than a window
        (7, None, "fr", "a", 1),
        (None, "maison", "fr", "a", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in pipeline.benchmarks(spark, docs, str(tmp_path)).collect()} == {1, 5, 6, 7}


def test_without_labels_letters_decide(spark, folder):
    sf, _ = folder
    docs = spark.createDataFrame([(1, "abc", None, "a", 3), (2, "12", None, "a", 2), (3, None, None, "a", 0)], DOCS)
    assert [r["doc_id"] for r in pipeline.languages(spark, docs, sf).collect()] == [1]


def test_learned_languages_reject_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert pipeline.languages(spark, docs, sf).count() >= 0.99 * docs.count() and language_id.REJECT_BELOW <= 0.2
