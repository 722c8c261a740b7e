"""Search invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewell.operators import index as I
from phrasewell.plans import search as Q
from phrasewell.sources import io as IO
from phrasewell.sources import views as D


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_all_cells_is_exact(spark, sf):
    q, w = D.questions(spark, sf), D.words(spark, sf)
    centroids = I.label_centroids(w)
    cols = ("qid", "rank", "doc_idx", "word_idx")
    cells = I.assign(w, centroids)
    assert rows(Q.starts_by_cells(q, cells, centroids, centroids.count(), 5, "start").select(*cols)) == rows(Q.starts_open(q, w, 5).select(*cols))


def test_only_probed_cells_are_read(spark, sf, tmp_path):
    q, w = D.questions(spark, sf).where("qid = 0"), D.words(spark, sf)
    path = str(tmp_path / "index")
    I.build(w, path, I.label_centroids(w))
    cells = I.stored(spark, path)
    found = Q.starts_by_cells(q, cells, spark.read.parquet(f"{path}/centroids"), 2, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    probed = [r[0] for r in I.probe(q, spark.read.parquet(f"{path}/centroids"), 2).select("cluster_id").collect()]
    assert len(set(probed)) == 2 and any("cluster_id" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])
    files = spark.read.parquet(f"{path}/index").where(F.col("cluster_id").isin(probed)).select(F.input_file_name()).distinct().collect()
    assert {int(r[0].split("cluster_id=")[1].split("/")[0]) for r in files} == set(probed)


def test_blocks_of_centroids_agree(spark, sf, monkeypatch):
    w = D.words(spark, sf)
    whole = rows(I.nearest_cells(w, I.label_centroids(w), "start", 3).select("word_id", F.array_join("cells", ",").alias("c")))
    monkeypatch.setattr(I, "CELLS_AT_ONCE", 3)
    assert rows(I.nearest_cells(w, I.label_centroids(w), "start", 3).select("word_id", F.array_join("cells", ",").alias("c"))) == whole


def test_index_stages(spark, sf, tmp_path):
    w = D.words(spark, sf)
    path, target = str(tmp_path / "index"), str(tmp_path / "moved")
    for stage in ("coarse", "fine"):
        I.build(w, path, stage=stage, cells=4)
    for shard in range(3):
        I.build(w.where(F.col("doc_idx") % 3 == shard), path, stage="add", shard=str(shard))
    I.build(w.limit(0), path, stage="add", shard="0")  # there already
    I.build(w, path, stage="merge")
    I.build(w, path, stage="move", target=target)
    got = I.stored(spark, path, target).join(w, ["doc_idx", "word_idx"]).collect()
    assert len(got) == w.count()
    assert all(abs(a - b) < 0.01 for r in got[:50] for a, b in zip(r["decoded"], r["start"], strict=True))
    with pytest.raises(ValueError):
        I.build(w, path, stage="polish")


def test_blocks_of_questions_agree(spark, sf):
    from phrasewell.operators import topk as K

    q, w = D.questions(spark, sf), D.words(spark, sf)
    assert rows(K.score_all(q, w, 3, block=4)) == rows(K.score_all(q, w, 3))


def test_running_best():
    from phrasewell.operators.topk import _Best

    r = np.random.default_rng(2)
    scores = r.integers(0, 9, (5, 60)).astype(float)  # many ties
    doc, word = r.permutation(60) // 7, r.permutation(60)
    best = _Best(5, 4)
    for lo in range(0, 60, 13):
        best.offer(scores[:, lo : lo + 13], doc[lo : lo + 13], word[lo : lo + 13])
    for q in range(5):
        want = sorted(zip(-scores[q], doc, word, strict=True))[:4]
        assert list(zip(-best.score[q], best.doc[q], best.word[q], strict=True)) == want


def test_words_without_vectors_are_no_candidates(spark, sf):
    w = D.words(spark, sf).withColumn("start", F.when(F.col("word_id") % 2 == 0, F.col("start")))
    got = Q.starts_open(D.questions(spark, sf), w, 5)
    assert got.where("(doc_idx * 25 + word_idx) % 2 = 1").count() == 0 and got.count() == 5 * D.questions(spark, sf).count()


def test_starts_without_ends(spark, sf):
    q, w = D.questions(spark, sf), D.placed_words(spark, sf)
    starts = Q.starts_open(q, w, 2)
    found = Q.complete(q, starts, w, ends=w.limit(0))
    assert found.where("j is not null or score > -9e8").count() == 0
    shown = Q.results(found, w, D.titled_contexts(spark, sf)).collect()
    assert len(shown) == found.count() and all(len(r["answer"]) == 1 and r["context"][r["start_pos"] : r["end_pos"]] == r["answer"] for r in shown)


def test_word_offsets(spark):
    texts = [(0, "a  bb [PAR] c\td [PAR]  [PAR] 𝒳y"), (1, ""), (2, " x")]
    got = D.word_offsets(spark.createDataFrame(texts, "doc_idx long, context string")).collect()
    assert sorted((r["doc_idx"], r["word_idx"], r["par_idx"], texts[r["doc_idx"]][1][r["char_start"] : r["char_end"]]) for r in got) == [(0, 0, 0, "a"), (0, 1, 0, "bb"), (0, 2, 1, "c"), (0, 3, 1, "d"), (0, 4, 3, "𝒳y"), (2, 0, 0, "x")]


def test_dump_skip_and_replace(spark, sf, tmp_path):
    w = D.words(spark, sf).select("doc_idx", "word_idx", "label")
    path = str(tmp_path / "dump")
    IO.write_phrase_dump(w.where("doc_idx < 10"), path, per_bucket=5)
    IO.write_phrase_dump(w, path, "skip", per_bucket=5)
    assert IO.read_phrase_dump(spark, path).count() == w.count()
    IO.write_phrase_dump(w.where("doc_idx = 3 and word_idx < 2"), path, per_bucket=5)  # replaces this document only
    assert IO.read_phrase_dump(spark, path).count() == w.where("doc_idx <> 3 or word_idx < 2").count()
    assert IO.read_phrase_dump(spark, path, [0]).select("doc_idx").distinct().count() == w.where("doc_idx < 5").select("doc_idx").distinct().count()
    assert IO.unreadable_files(spark, path).count() == 0
    broken = next((tmp_path / "dump" / "doc_bucket=1").glob("*.parquet"))
    broken.write_bytes(broken.read_bytes()[:40])
    for crc in (tmp_path / "dump" / "doc_bucket=1").glob(".*.crc"):
        crc.unlink()
    assert [r[0].rsplit("/", 1)[-1] for r in IO.unreadable_files(spark, path).collect()] == [broken.name]


def test_corpus_files(spark, tmp_path):
    import json

    for n in (0, 1):
        doc = {"version": "x", "data": [{"title": f"t{n}", "paragraphs": [{"context": "a b", "qas": [{"id": f"q{n}", "question": "?", "answers": [{"text": "b", "answer_start": 2}]}]}]}]}
        (tmp_path / f"{n:04d}").write_text(json.dumps(doc))
    assert [r["doc_idx"] for r in IO.read_file_range(spark, str(tmp_path), 0, 2).orderBy("doc_idx").collect()] == [0, 1000]
    assert [r["qas_id"] for r in IO.flatten_examples(IO.read_corpus(spark, str(tmp_path / "0001"))).collect()] == ["q1"]


def test_stream_takes_new_files_once(spark, sf, tmp_path):
    from phrasewell.streaming import words as S

    w = D.words(spark, sf)
    folder, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    cells = I.label_centroids(w)
    for half in ("doc_idx % 2 = 0", "doc_idx % 2 = 1"):
        w.where(half).write.mode("append").parquet(folder)
        S.append_to_index(S.word_stream(spark, folder, w), cells, path, mark).awaitTermination()
    assert spark.read.parquet(path).count() == w.count()
