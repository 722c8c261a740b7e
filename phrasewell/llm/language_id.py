"""Language ID with language-bitmask n-gram filters.

Training counts letter n-grams (word edges count as a letter) per language over all training texts. An n-gram belongs to a
language if it makes up at least `rate` of that language's n-grams, so a language has at most 1 / rate of them. They fill one
bit-sliced Bloom filter: slot by slot a mask of languages, so that one lookup (the masks of a few slots, and-ed) returns all
languages that hold an n-gram. A text is decided by popcounts per language, each corrected for its filter's false positives.

Null texts and texts without letters are `und` with score 0. So is everything if nothing could be learned. Rows without
language, and empty ones, teach nothing; an empty table gives an empty result. Equal counts go to the language first in code-point order. The score is the share of the text's n-grams
that the language has, after the correction. Texts are handled whole, in pieces that end between words (a single word of
more than PIECE letters may be cut). Columns of the input pass through `detect` unchanged, except that columns named lang_pred and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm._chunks import blob
from phrasewell.llm._shared import crc_mod, materialize, table
from phrasewell.llm._vec import mix64

GRAM, RATE, HASHES, SLOTS = 4, 1e-5, 3, 1 << 21
PIECE = 1 << 20
#: Languages of one filter, which is broadcast: 64 MB with all slots.
LANGS_AT_ONCE = 256
#: Texts whose winner scores less are rejected by the pipeline's stage.
REJECT_BELOW = 0.2

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point 0 if it isn't a letter, else that of its lower-case form."""
    if not _letters:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters.append(t)
    return _letters[0]


def _grams(text: str, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Hashes of the letter n-grams of a text, piece by piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (cut := text.rfind(" ", at, end)) > at:
            end = cut + 1
        codes = _letter_table()[np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = end
        on = codes != 0
        if not on.any():
            continue
        codes = codes[on | np.concatenate(([False], on[:-1]))]
        codes = np.concatenate(([0], codes[1:] if codes[0] == 0 else codes, [0] if codes[-1] else [])).astype(np.uint64)
        n = len(codes) - gram + 1
        if n <= 0:  # a text of a letter or two: one n-gram
            yield _hash(np.concatenate((codes, np.zeros(gram - len(codes), np.uint64))), 1, gram)
            continue
        inner = np.ones(n, bool)
        for j in range(1, gram - 1):
            inner &= codes[j : j + n] != 0
        if gram > 2 and not inner.any():  # only words shorter than an n-gram
            inner[:] = True
        yield _hash(codes, n, gram)[inner]


def _hash(codes: np.ndarray, n: int, gram: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return mix64(h)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def learn(labelled: DataFrame, gram: int = GRAM, rate: float = RATE, slots: int = SLOTS) -> dict:
    """The filter from labelled(text, lang)."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def rows() -> pa.RecordBatch:
            out: list[tuple] = []
            for lang, (keys, counts) in held.items():
                key, n = _merge(keys, counts)
                part = (key >> np.uint64(58)).astype(np.int64)
                edge = np.searchsorted(part, np.arange(parts + 1))
                out += [(lang, p, blob(key[a:b]), blob(n[a:b])) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())], ["lang", "part", "keys", "counts"])

        size = 0
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                for h in _grams(text, gram):
                    k, n = np.unique(h, return_counts=True)
                    keys, counts = held.setdefault(lang, ([], []))
                    keys.append(k)
                    counts.append(n)
                    size += len(k)
            if size > 4_000_000:
                for lang, (keys, counts) in list(held.items()):
                    k, n = _merge(keys, counts)
                    held[lang] = ([k], [n])
                size = sum(len(k[0]) for k, _ in held.values())
                if size > 4_000_000:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    def total(t: pa.Table) -> pa.Table:
        key, n = _merge([np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in t["counts"].to_pylist()])
        return pa.table({"lang": [t["lang"][0].as_py()], "keys": pa.array([blob(key)], pa.binary()), "counts": pa.array([blob(n)], pa.binary()), "n": pa.array([int(n.sum())], pa.int64())})

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, part int, keys binary, counts binary")
    summed = materialize(rows.groupBy("lang", "part").applyInArrow(total, "lang string, keys binary, counts binary, n long"))
    all_grams = {r[0]: r[1] for r in summed.groupBy("lang").agg(F.sum("n")).collect()}  # a number a language
    langs = sorted(all_grams, key=lambda x: x.encode())
    return {"langs": langs, "gram": gram, "block": lambda at: _block(summed, langs[at : at + LANGS_AT_ONCE], all_grams, rate, slots)}


def _block(summed: DataFrame, langs: list[str], all_grams: dict[str, int], rate: float, slots: int) -> dict:
    """The filter of some languages: at most 1 / rate n-grams each."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, k, n in zip(b["lang"].to_pylist(), b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True):
                out.append((lang, blob(np.frombuffer(k, np.uint64)[np.frombuffer(n, np.int64) >= rate * all_grams[lang]])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["lang", "keys"])

    chosen: dict[str, list] = {x: [] for x in langs}
    for r in summed.where(F.col("lang").isin(langs)).select("lang", "keys", "counts").mapInArrow(choose, "lang string, keys binary").collect():
        chosen[r[0]].append(np.frombuffer(r[1], np.uint64))
    keys = [np.concatenate(chosen[x] or [np.empty(0, np.uint64)]) for x in langs]
    need = 16 * max([1, *map(len, keys)])
    m = min(slots, 1 << max(12, (need - 1).bit_length()))
    masks = np.zeros((-(-len(langs) // 64) or 1, m), np.uint64)
    for i, k in enumerate(keys):
        for at in _slots(k, m):
            masks[i // 64][at] |= np.uint64(1 << (i % 64))
    fill = [float(np.mean((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(langs))]
    return {"langs": langs, "masks": masks, "false": [f**HASHES for f in fill]}


def _slots(h: np.ndarray, m: int) -> Iterator[np.ndarray]:
    for j in range(HASHES):
        yield (h & np.uint64(m - 1)).astype(np.int64)
        h = mix64(h + np.uint64(j + 1))


def decide(text: str | None, block: dict, gram: int = GRAM) -> tuple[str, float]:
    """The best language of a block and its score."""
    langs, masks = block["langs"], block["masks"]
    hits, total = np.zeros(len(langs)), 0
    for h in _grams(text or "", gram):
        total += len(h)
        found = None
        for at in _slots(h, masks.shape[1]):
            got = masks[:, at]
            found = got if found is None else found & got
        for i in range(len(langs)):
            hits[i] += np.count_nonzero(found[i // 64] & np.uint64(1 << (i % 64)))
    if not total or not langs:
        return "und", 0.0
    false = np.asarray(block["false"])
    share = np.clip((hits / total - false) / np.maximum(1e-9, 1 - false), 0, 1)
    best = int(np.argmax(share))
    return langs[best], float(share[best])


def _decided(docs: DataFrame, block: dict, gram: int, text: str, first: bool) -> DataFrame:
    """docs with lang_pred and score, by this block's languages where they do better than those before."""
    names = docs.columns if not first else [*docs.columns, "lang_pred", "score"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + (", lang_pred string, score double" if first else "")
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most SLOTS masks of LANGS_AT_ONCE bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decide(x.as_py(), shared.value, gram) for x in b.column(at)]
            rest = b.columns
            if not first:
                known = list(zip(b.column(len(rest) - 2).to_pylist(), b.column(len(rest) - 1).to_pylist(), strict=True))
                found = [new if new[1] > old[1] else old for new, old in zip(found, known, strict=True)]
                rest = rest[:-2]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    return docs.mapInArrow(work, fields)


def detect(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. A model of more languages than LANGS_AT_ONCE looks at the texts once for each such block of them."""
    out = docs.drop("lang_pred", "score")
    for at in range(0, max(1, len(model["langs"])), LANGS_AT_ONCE):
        out = _decided(out, model["block"](at), model["gram"], text, at == 0)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(crc_mod(F.col("doc_id"), 5) != 0).select("text", "lang"))
    out = detect(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
