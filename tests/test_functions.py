"""Golden cases worked by hand."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.functions import tokenize as T
from phrasewell.functions import vectors as V
from phrasewell.operators import corpus as C
from phrasewell.operators import evaluate as E
from phrasewell.operators import index as I
from phrasewell.operators import sparse as P
from phrasewell.operators import spans as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_quantize_and_back(spark):
    assert one(spark, V.quantize(arr(0.025, -0.5, 9, -9))) == [40, 30, 127, -128]
    assert one(spark, V.dequantize(F.array(*map(F.lit, [40, 127, -128])))) == pytest.approx([0.0, 4.35, -8.4])
    assert one(spark, V.maybe_dequantize(arr(1, 2), F.lit(None).cast("double"), F.lit(20.0))) == [1.0, 2.0]


def test_lift_and_distance(spark):
    assert one(spark, V.lift(arr(3, 4), 13.0)) == [12.0, 3.0, 4.0]
    assert one(spark, V.lift_question(arr(1, 2))) == [0.0, 1.0, 2.0]
    l2 = V.squared_distance(V.lift(arr(3, 4), 13.0), V.lift_question(arr(1, 2)))
    assert one(spark, l2) == 152.0
    assert one(spark, V.distance_to_product(l2, 13.0, V.norm(arr(1, 2)))) == pytest.approx(11.0)
    assert one(spark, V.distance_to_product(F.lit(4.0))) == -2.0


def test_unpack(spark):
    shard, idx = V.unpack_id(F.lit(200000005))
    assert (one(spark, shard), one(spark, idx)) == (200000000, 5)


def test_boundary_filter(spark):
    rows = [(0, i, s, e) for i, (s, e) in enumerate(zip([1.0, -1.0, 1.0, 1.0], [-1.0, 1.0, 1.0, -1.0]))]
    out = S.boundary_filter(spark.createDataFrame(rows, "doc_idx long, word_idx long, filter_start double, filter_end double"), 0.0, 2)
    got = {}
    for r in out.collect():
        got.setdefault((r["i"], r["start_ord"]), {})[r["o"]] = r["end_ord"]
    assert got == {(0, 0): {0: -1, 1: 0}, (2, 1): {0: 1, 1: -1}, (3, 2): {0: -1, 1: -1}}


def test_windows_and_max_context(spark):
    w = C.token_windows(F.lit(10), 4, 2)
    assert [tuple(x) for x in one(spark, w)] == [(0, 4), (2, 4), (4, 4), (6, 4)]
    assert one(spark, C.max_context(w, F.lit(5))) == 2
    assert one(spark, C.token_windows(F.lit(0), 4, 2)) == []


@settings(max_examples=15, deadline=None)
@given(n=st.integers(1, 60), size=st.integers(1, 12), stride=st.integers(1, 12))
def test_windows_cover(spark, n, size, stride):
    stride = min(stride, size)
    w = one(spark, C.token_windows(F.lit(n), size, stride))
    assert set().union(*(range(s, s + k) for s, k in w)) == set(range(n))


def test_crop(spark):
    s = F.lit("aa [PAR] bb cc [PAR] dd")
    r = one(spark, X.crop(s, F.lit(12), F.lit(14)))
    assert (r["context"], r["start"], r["end"]) == ("bb cc", 3, 5)
    assert one(spark, X.paragraph_ordinal(s, F.lit(12))) == 1
    r = one(spark, X.crop(F.lit("a [PAR]  [PAR] 𝒳b"), F.lit(15), F.lit(16)))
    assert (r["context"], r["start"], r["end"]) == ("𝒳b", 0, 1)


@pytest.mark.parametrize("s, keep", [("???", True), ("????", False), ("!!!!!", True), ("!!!!!!", False)])
def test_presentable(spark, s, keep):
    assert one(spark, X.presentable(F.lit(s))) is keep


@pytest.mark.parametrize("s, want", [("The  Apollo-11, a rocket!", "apollo11 rocket"), ("the", ""), ("thé", "thé"), ("aé the x", "aé x"), ("", ""), ("a b　c", "b c")])
def test_normalize(spark, s, want):
    assert one(spark, X.normalize_answer(F.lit(s))) == want


def test_scores(spark):
    rows = [("1", "red apple pie", "the apple pie"), ("2", "the", "a"), ("3", "x", None)]
    got = {r["qid"]: (r["em"], round(r["f1"], 6)) for r in E.scores(spark.createDataFrame(rows, "qid string, truth string, pred string"), ["qid"]).collect()}
    assert got == {"1": (False, 0.8), "2": (True, 0.0), "3": (False, 0.0)}


def test_recall(spark):
    ranks = spark.createDataFrame([(1, 1.0), (2, 1e9), (3, 3.0)], "qid long, rank double")
    assert [(r[0], round(r[1], 6)) for r in E.recall_at(ranks, 3).orderBy("k").collect()] == [(1, round(1 / 3, 6)), (2, round(1 / 3, 6)), (3, round(2 / 3, 6))]


def test_tfidf(spark):
    assert one(spark, X.tfidf(F.lit(1), F.lit(10), F.lit(1))) == pytest.approx(1.279430, abs=1e-6)
    assert one(spark, X.tfidf(F.lit(3), F.lit(10), F.lit(6))) == 0.0


def test_sparse_product(spark):
    q = spark.createDataFrame([(1, 1, 2.0), (1, 5, 3.0)], "q long, term_id long, val double")
    c = spark.createDataFrame([(7, 5, 4.0), (7, 9, 1.0)], "d long, term_id long, val double")
    assert [tuple(r) for r in P.product(q, c, "q", ["d"]).collect()] == [(1, 7, 12.0)]


def test_over_represented(spark):
    hits = spark.createDataFrame([(7, 50), (8, 1), (9, 49)], "doc_idx long, count long")
    assert sorted(r[0] for r in I.over_represented(hits, 0.01).collect()) == [7, 9]


def test_length_filter_and_merge(spark):
    pars = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([300, 300, 2500, 100])], "doc_id long, par_idx int, par_text string")
    assert [len(r["merged"]) for r in C.merge_paragraphs(pars, 500, 2000).collect()] == [602]
    lengths = spark.createDataFrame([("x" * n,) for n in (499, 500, 1999, 2000)], "t string")
    assert sorted(len(r[0]) for r in lengths.where(C.length_between(F.col("t"), 500, 2000)).collect()) == [500, 1999]


def test_gaps(spark):
    make = lambda *r: spark.createDataFrame(list(r), "start long, end long")
    assert C.gaps(make((0, 2), (2, 5))).count() == 0
    assert [tuple(r) for r in C.gaps(make((0, 2), (3, 5))).collect()] == [(3, 5, 2)]
    assert C.gaps(make((0, 2), (2, 5)), 0, 5).count() == 0
    assert sorted(tuple(r) for r in C.gaps(make((1, 2), (2, 5)), 0, 7).collect()) == [(1, 2, 0), (7, 7, 5)]


def test_tokenizers():
    assert T.basic_tokens("Héllo, wörld! 中文") == ["hello", ",", "world", "!", "中", "文"]
    assert T.basic_tokens(None) == []
    assert T.cleaned("Héllo,\u00a0 wörld!\x00") == "hello, world!" and T.cleaned(None) == ""
    v = {"mar", "##ket", "##place"}
    assert T.pieces("marketplace", v) == ["mar", "##ket", "##place"]
    assert T.pieces("xyz", v) == ["xyz"] and T.pieces("xyz", v, True) == ["[UNK]"]


@pytest.mark.parametrize(
    "original, tokens, want",
    [
        ("Green  Lake's shore", "green lake", (0, 11)),
        ("abc", "zzz", (0, 3)),
        ("the re\u0301sume\u0301 of Ann", "resume", (4, 12)),  # accents of their own
        ("the r\u00e9sum\u00e9 of Ann", "resume", (4, 10)),
        ("a (b) c", "( b )", (2, 5)),
        ("one two", "t ##wo", (4, 7)),
        ("x\u200by z", "z", (4, 5)),  # a control character counts nothing
        ("", "a", (0, 0)),
    ],
)
def test_aligned_span(original, tokens, want):
    assert T.aligned_span(original, tokens) == want


def test_span_in_words():
    assert T.span_in_words(["Old", "(mill)", "road"], 1, 2, "mill ) road") == (5, 15)


def ids_of(spark, column, n=40):
    return {r["id"]: r["x"] for r in spark.range(n).select("id", column.alias("x")).collect()}


def test_noise(spark):
    ids = F.transform(F.sequence(F.lit(1000), F.lit(1029)), lambda i: i.cast("long"))
    marked = T.framed(ids, 101, 102)
    whole = [101, *range(1000, 1030), 102]
    key = F.col("id")
    short = ids_of(spark, T.shortened(marked, key, 1.0, 2, 60))
    assert all(x[0] == 101 and x[-1] == 102 and x[1:-1] == whole[1 : len(x) - 1] for x in short.values())
    assert {len(x) for x in short.values()} >= {32} and min(len(x) for x in short.values()) >= 4  # a length beyond the text's own leaves it
    assert all(len(x) <= 32 for x in ids_of(spark, T.shortened(marked, key, 1.0, 0, 300, always_shorter=True)).values())
    assert set(map(tuple, ids_of(spark, T.shortened(marked, key, 0.0)).values())) == {tuple(whole)}
    lost = ids_of(spark, T.replaced(marked, key, 1.0, 1.0))
    assert set(map(tuple, lost.values())) == {(101, *[100] * 30, 102)}
    drawn = ids_of(spark, T.replaced(marked, key, 1.0, 0.0, vocab_size=1200))
    assert all(x[0] == 101 and x[-1] == 102 and all(999 <= i < 1200 for i in x[1:-1]) for x in drawn.values())
    mixed = ids_of(spark, T.shuffled(marked, key, 0.5))
    assert all(len(x) == 32 and set(x[1:-1]) <= set(whole[1:-1]) and x[0] == 101 and x[-1] == 102 for x in mixed.values()) and len(set(map(tuple, mixed.values()))) == 40
    empty = T.framed(F.expr("cast(array() as array<long>)"), 101, 102)
    assert set(map(tuple, ids_of(spark, T.noisy(empty, key)).values())) == {(101, 102)}
    kept = [x == whole for x in ids_of(spark, T.noisy_negative(marked, key, share=0.5), 200).values()]
    assert 0.3 < sum(kept) / 200 < 0.7


def test_terms_are_linear(spark):
    import time

    took = []
    for n in (4_000, 64_000):
        row = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("s"))
        start = time.time()
        assert row.select(F.size(X.terms(F.col("s"))).alias("n")).collect()[0][0] == 2 * n - 1
        took.append(time.time() - start)
    assert took[1] < 40 * max(took[0], 0.2)
    assert one(spark, X.terms(F.lit("A b-c"))) == ["a", "b", "c", "a b", "b c"] and one(spark, X.terms(F.lit("a"))) == ["a"] and one(spark, X.terms(F.lit(""))) == []


@settings(max_examples=15, deadline=None)
@given(n=st.integers(1, 60), size=st.integers(1, 12), stride=st.integers(1, 12), at=st.integers(0, 59))
def test_best_window(spark, n, size, stride, at):
    stride, at = min(stride, size), at % n
    assert one(spark, C.best_window(F.lit(at), F.lit(n), size, stride)) == one(spark, C.max_context(C.token_windows(F.lit(n), size, stride), F.lit(at)))


def test_answer_span(spark):
    t = F.array(*map(F.lit, "a b a b c".split()))
    find = lambda *w: tuple(one(spark, X.answer_span(t, F.lit(1), F.lit(4), F.array(*map(F.lit, w)))))
    assert find("a", "b") == (2, 3) and find("b") == (1, 1) and find("z") == (1, 4) and find(*"bbbbbb") == (1, 4)


def test_draws_and_dummy(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "k long, text string")
    got = C.draws(rows, 30, "k").collect()
    assert sorted(r["draw"] for r in got) == list(range(1, 31)) and {r["k"] for r in got} <= set(range(7))
    both = C.with_dummy(rows.where("k < 2"), "k", "text", F.lit("d"), F.col("k") == 0).collect()
    assert sorted((r["k"], r["doc_idx"], r["text"]) for r in both) == [(0, 0, "d"), (0, 1, "t0"), (1, 0, "t1"), (1, 1, "d")]


def test_unknown_quantizer():
    assert I.quantizer("SQ8") and I.quantizer("PQ16")
    with pytest.raises(ValueError):
        I.quantizer("SQ4")


def test_float_round_trip(spark):
    v = [struct.unpack("f", struct.pack("f", x))[0] for x in (-1.234, 0.0, 2.5)]
    back = one(spark, V.dequantize(V.quantize(arr(*v))))
    assert all(math.isclose(a, b, abs_tol=0.025 + 1e-9) for a, b in zip(v, back))
