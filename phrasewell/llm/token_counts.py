"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, grouped into batches balanced by bytes and encoded; only lengths come back. For the
sentencepiece vocabulary a boundary before a space that follows another character is safe: no piece of it has its
space mark after another character (checked when the model is loaded), so no merge crosses the boundary, and the
mark that the library puts before each text stands for that space. The parts between such boundaries repeat a lot, so each worker
remembers the lengths of short parts it has encoded, up to a bound in characters. A text without spaces is one part: pieces may cross any
other place, so it is encoded whole, and not remembered.

Null texts count as empty and have no tokens. Texts of any length are handled whole; a text is never held more than
once besides its parts. Repeated rows count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from phrasewell.llm._shared import table

MODEL = "piece_bpe_32k.model"
OVER_LIMIT = 4096
#: Characters encoded by one call, characters of parts whose lengths a worker remembers in all, and of the longest such part.
BATCH_BYTES, REMEMBERED, LONGEST_REMEMBERED = 1 << 20, 16 << 20, 64

_PART = re.compile("(?:^[ ▁]*|[ ▁])[ ▁]*[^ ▁]+|[ ▁]+")


class PieceCounter:
    """Token counts of whole texts under a sentencepiece model, as its encode() with default settings gives them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.model.encode("a a")) == 2 * len(self.model.encode("a"))
        self.known: dict[str, int] = {"": 1}
        self.held = 0

    def _encoded(self, parts: set[str]) -> dict[str, int]:
        """Counts of parts; short ones are remembered, as far as the bound goes, and all forgotten beyond it."""
        out, batch, size = {}, [], 0
        for part in parts:
            batch.append(part)
            size += len(part) + 8
            if size >= BATCH_BYTES:
                out.update(zip(batch, map(len, self.model.encode(batch, num_threads=1)), strict=True))
                batch, size = [], 0
        if batch:
            out.update(zip(batch, map(len, self.model.encode(batch, num_threads=1)), strict=True))
        short = {p: n for p, n in out.items() if len(p) <= LONGEST_REMEMBERED}
        size = sum(len(p) + 8 for p in short)
        if self.held + size > REMEMBERED:
            self.known, self.held = {"": 1}, 0
        if size <= REMEMBERED:
            self.known.update(short)
            self.held += size
        return out

    def parts(self, text: str) -> list[str]:
        """Texts whose counts add up to that of text, "" standing for a space at the end."""
        if "  " not in text and "▁" not in text and text[0] != " ":
            return text.split(" ")
        found = _PART.findall(text)
        return [found[0], *(x[1:] for x in found[1:])]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split = [self.parts(t) if t else [] for t in texts]
        known = self.known
        if new := set().union(*split) - known.keys():
            known = {p: known[p] for p in set().union(*split) & known.keys()} | self._encoded(new)
        return [sum(map(known.__getitem__, p)) for p in split]


def grouped(texts: list[str], lengths: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, over_limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs(doc_id, text)."""
    key = docs.schema["doc_id"]
    docs = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _counters:
            _counters[model_path] = PieceCounter(model_path)
        counter = _counters[model_path]
        for b in batches:
            col = pc.fill_null(b.column(1).cast(pa.string()), "")
            size = pc.binary_length(col).to_pylist()
            found: list[int] = []
            for lo, hi in grouped(size, size):
                found += counter.counts(col.slice(lo, hi - lo).to_pylist())
            n = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), n, pc.greater(n, over_limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(work, f"doc_id {key.dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
