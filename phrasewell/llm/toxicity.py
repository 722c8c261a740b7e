"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded: compatibility forms, case, accents left alone, look-alike letters of other scripts and digits that stand for letters
become plain letters, other characters become spaces. The lexicon holds words and word beginnings (stems) whose share of toxic
documents is far above that of clean ones, weighted by the log ratio of the two; it is learned from labelled texts. One Aho-Corasick pass over a folded text
sums the weights of the longest entry at each word, leaving out words inside exception phrases. The sum, normalised by the text's length,
goes through a logistic curve that is fitted to the labels, so 0.5 means as likely toxic as not.

Null and empty texts have no matches and get the score of a text without any; very long ones are folded and matched whole. A score of just the threshold
is predicted toxic; an empty table gives an empty result. Without labels of both kinds every score is 0.
Rows of the labels without a document, or with a null label, teach nothing. Repeated labels count each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm._shared import crc_mod, materialize, table

# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "e",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "γ": "y", "σ": "o",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ք": "p", "ẹ": "e", "ọ": "o", "ḷ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Phrases in which an entry's words don't count.
EXCEPTIONS = ("clown fish", "class clown fish", "pathetic fallacy", "village idiot pub", "idiot proof", "worthless check", "white trash bag", "trash can", "trash bin", "pond scum", "sore loser rule")
#: A stem has so many letters; an entry needs SUPPORT toxic documents, SHARE of all toxic documents and WEIGHT.
#: By the share a lexicon has at most 1 / SHARE times as many entries as a toxic document has on average, whatever the corpus.
STEMS = range(4, 9)
SUPPORT, SHARE, WEIGHT = 3, 5e-4, 2.5
#: Documents, share of the toxic documents and weight that make an entry stay whatever else explains its documents.
FREQUENT = (6, 0.025, 3.5)
#: The curve is fitted on at most so many labelled rows, those with the least hash.
FIT_ROWS = 100_000
THRESHOLD = 0.7
#: At most so many labels (16 bytes each) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000

_map: dict[int, str] = {}


def _folding() -> dict[int, str]:
    if not _map:
        for c in range(0x0, 0x2000):
            s = chr(c)
            low = unicodedata.normalize("NFKC", s).lower()
            low = "".join(LOOK_ALIKE.get(x, x) for x in low)
            if not (low.isalpha() and len(low) <= 3):
                low = DIGITS.get(s, " ") if not unicodedata.combining(s) else ""
            _map[c] = low
        for c in (*range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0x24B6, 0x24EA)):
            low = unicodedata.normalize("NFKC", chr(c)).lower()
            _map[c] = "".join(LOOK_ALIKE.get(x, DIGITS.get(x, x if x.isalpha() else " ")) for x in low)
        for c in (*range(0x2010, 0x2070), 0x20AC, 0x3000):
            _map[c] = DIGITS.get(chr(c), " ") if c not in (0x200B, 0x200C, 0x200D, 0x2060) else ""
        for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
            _map[c] = ""
    return _map


_digits_only = re.compile(r"(?<![^\W\d_])[\d@$!|€]+(?![^\W\d_])")


def fold(text: str) -> str:
    """The folded words of a text, a space before and after each; digits and signs count as letters only beside a letter."""
    plain = _digits_only.sub(" ", unicodedata.normalize("NFC", text))
    return f" {' '.join(plain.translate(_folding()).split())} "


def _entries(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for n in STEMS:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return out


def _counts(labelled: DataFrame) -> DataFrame:
    """(entry, toxic, clean): numbers of labelled documents that hold each entry; one row for " " has all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
            for h in held:
                h.clear()
            return out

        for b in batches:
            for text, label in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                held[label].update(_entries(fold(text or "")))
                held[label][" "] += 1
            if len(held[0]) + len(held[1]) > 1_000_000:
                yield rows()
        yield rows()

    return labelled.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _pruned(found: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Entries without those that a shorter entry already stands for about as well."""
    kept: dict[str, float] = {}
    for entry, _, _, weight in sorted(found, key=lambda x: (len(x[0].rstrip()), x[0])):
        stem = entry.rstrip()
        shorter = [kept[s] for k in range(2, len(stem) + 1) if (s := stem[:k]) in kept and s != entry]
        if not shorter or weight > max(shorter) + 1.5:
            kept[entry] = weight
    return kept


def _distinct_stems(top: DataFrame) -> DataFrame:
    """The rows that `_pruned` keeps. All that stand for an entry share its shortest stem, so each such group is pruned for itself."""

    def work(t: pa.Table) -> pa.Table:
        kept = _pruned([tuple(r.values()) for r in t.select(["entry", "toxic", "clean", "w"]).to_pylist()])
        return t.select(["entry", "toxic", "clean", "w"]).filter(pa.array([e in kept for e in t["entry"].to_pylist()], pa.bool_()))

    rows = top.select("entry", "toxic", "clean", "w").withColumn("root", F.substring(F.rtrim("entry"), 1, 1 + STEMS.start))
    return rows.groupBy("root").applyInArrow(work, "entry string, toxic long, clean long, w double")


def _needed(weights: dict[str, float], matched: list[tuple[frozenset, int]], support: int) -> dict[str, float]:
    """Of the entries those that explain documents no better entry explains: a greedy cover of the toxic documents, given as sets of entries and how many documents have each.

    Near copies make any word of theirs look toxic; once their real entry is taken, such words have nothing left to explain.
    """
    left = [(m, n) for m, n in matched if m]
    kept: dict[str, float] = {}
    while left:
        count: Counter = Counter()
        for m, n in left:
            for e in m:
                count[e] += n
        best = max(count, key=lambda e: (count[e] * weights[e], e))
        if count[best] < support:
            break
        kept[best] = weights[best]
        left = [(m, n) for m, n in left if best not in m]
    return kept


class Matcher:
    """Sums of weights over folded texts."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for e, w in weights.items():
            self.find.add_word(e, (len(e), w))
        for e in exceptions:
            p = f" {' '.join(fold(e).split())} "
            self.find.add_word(p, (len(p), None))
        self.empty = not len(self.find)
        if not self.empty:
            self.find.make_automaton()

    def entries(self, text: str | None) -> list[str]:
        """All entries that occur."""
        folded = fold(text or "")
        return [] if self.empty else sorted({folded[end - length + 1 : end + 1] for end, (length, weight) in self.find.iter(folded) if weight is not None})

    def features(self, text: str | None) -> tuple[float, float, int, int]:
        """(sum of weights, largest weight, matched words, words)."""
        folded = fold(text or "")
        n = folded.count(" ") - 1 if len(folded) > 2 else 0
        if self.empty or not n:
            return 0.0, 0.0, 0, n
        at: dict[int, tuple[int, float]] = {}
        away: list[tuple[int, int]] = []
        for end, (length, weight) in self.find.iter(folded):
            start = end - length + 1
            if weight is None:
                away.append((start, end))
            elif start not in at or length > at[start][0]:
                at[start] = (length, weight)
        if away:  # ends ascend, so a running bound tells whether a start lies inside a phrase
            away.sort()
            starts, reach = np.asarray([a for a, _ in away]), np.maximum.accumulate([b for _, b in away])
            at = {s: v for s, v in at.items() if not ((i := int(np.searchsorted(starts, s, "right")) - 1) >= 0 and s < reach[i])}
        if not at:
            return 0.0, 0.0, 0, n
        w = [v for _, v in at.values()]
        return float(sum(w)), float(max(w)), len(w), n


def _vector(f: tuple[float, float, int, int]) -> list[float]:
    total, most, hits, n = f
    return [1.0, math.log1p(total), most / 5, math.log1p(100 * total / (n + 20)), math.log1p(n) / 5 if hits else 0.0, float(hits > 0)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


_matchers: dict[int, Matcher] = {}


def _matcher(model: dict) -> Matcher:
    key = hash((frozenset(model["weights"].items()), model["exceptions"]))
    if key not in _matchers:
        _matchers[key] = Matcher(model["weights"], model["exceptions"])
    return _matchers[key]


def learn(labelled: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, support: int = SUPPORT, least_weight: float = WEIGHT, share: float = SHARE) -> dict:
    """The lexicon and the curve from labelled(text, toxic)."""
    labelled = materialize(labelled.where("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic")))
    counts = materialize(_counts(labelled))
    model = {"weights": {}, "exceptions": tuple(exceptions), "curve": None}
    whole = counts.where("entry = ' '").collect()
    toxic, clean = (whole[0]["toxic"], whole[0]["clean"]) if whole else (0, 0)
    if not toxic or not clean:
        return model
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    top = counts.where((F.col("entry") != " ") & (F.col("toxic") >= max(support, share * toxic))).withColumn("w", ratio).where(F.col("w") >= least_weight)
    found = [tuple(r) for r in _distinct_stems(top).collect()]
    model["weights"] = {e: w for e, _, _, w in found}
    some = labelled.withColumn("_h", F.xxhash64("text")).orderBy("_h").limit(FIT_ROWS).select("text", "toxic") if labelled.count() > FIT_ROWS else labelled
    first = labelled.sparkSession.sparkContext.broadcast(model)  # what passes support, share, weight and pruning
    names = sorted(model["weights"])

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number = _matcher(first.value), {e: i for i, e in enumerate(sorted(first.value["weights"]))}
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(number[e] for e in m.entries(x.as_py())) for x in b.column(0)], pa.list_(pa.int32()))], ["e"])

    # An entry of a fair share of all toxic documents stays in any case. At most FIT_ROWS sets of entries come to the driver, equal ones once.
    frequent = {e for e, t, _, w in found if t >= max(FREQUENT[0], FREQUENT[1] * toxic) and w >= FREQUENT[2]} & model["weights"].keys()
    sets = some.where("toxic = 1").select("text").mapInArrow(matches, "e array<int>").where(F.size("e") > 0).groupBy("e").count().collect()
    cover = _needed(model["weights"], [(frozenset(names[i] for i in r["e"]), r["count"]) for r in sets], support)
    model = model | {"weights": {e: model["weights"][e] for e in sorted(frequent)} | cover}
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(shared.value)
        for b in batches:
            out = [_vector(m.features(x.as_py())) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    rows = some.mapInArrow(features, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    rows.sort()
    x, y = np.repeat([r[0] for r in rows], [r[2] for r in rows], axis=0), np.repeat([r[1] for r in rows], [r[2] for r in rows])
    model["curve"] = _logistic(x, y)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted, n_matches and n_words of each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, curve = _matcher(shared.value), shared.value["curve"]
        for b in batches:
            found = [m.features(x.as_py()) for x in b.column(1)]
            out = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(_vector(f), curve)))))) if curve else 0.0 for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], ["doc_id", "score", "predicted", "n_matches", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {key}, score double, predicted int, n_matches long, n_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")
    # Texts stay where they are while the labels are few enough to be sent to them.
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    model = learn(docs.join(F.broadcast(labels) if few else labels, "doc_id").select("text", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "n_matches")
