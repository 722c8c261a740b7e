"""Tokenisers that need more than the JVM's functions: Arrow functions over columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of CJK ideographs in Unicode.
_CJK = re.compile("([一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f])")


def _is_space(c: str) -> bool:
    return c in " \t\n\r" or unicodedata.category(c) == "Zs"


def _is_control(c: str) -> bool:
    return c not in "\t\n\r" and unicodedata.category(c).startswith("C")


def _is_punctuation(c: str) -> bool:
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c).startswith("P")


def basic_tokens(text: str | None, lower: bool = True) -> list[str]:
    """Cleaned, lower-cased words without accents; every punctuation mark and CJK character is a token."""
    clean = "".join(" " if _is_space(c) else c for c in text or "" if not (c in "\x00�" or _is_control(c)))
    out: list[str] = []
    for word in _CJK.sub(r" \1 ", clean).split():
        if lower:
            word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
        part = ""
        for c in word:
            if _is_punctuation(c):
                out += [part, c] if part else [c]
                part = ""
            else:
                part += c
        if part:
            out.append(part)
    return out


def cleaned(text: str | None) -> str:
    """What basic_tokens does short of splitting at punctuation: words without accents and control characters, one space between them."""
    clean = "".join(" " if _is_space(c) else c for c in text or "" if not (c in "\x00\ufffd" or _is_control(c)))
    words = _CJK.sub(r" \1 ", clean).lower().split()
    return " ".join("".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in words)


def all_but_split(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(cleaned)

    return run(c)


def pieces(token: str, vocab: frozenset[str] | dict, unknown: bool = False, longest: int = 100) -> list[str]:
    """Longest known pieces from the left, those after the first marked by ##; the token itself (or [UNK]) if there is no way."""
    fail = ["[UNK]"] if unknown else [token]
    if len(token) > longest:
        return fail
    out, at = [], 0
    while at < len(token):
        for end in range(len(token), at, -1):
            piece = ("##" if at else "") + token[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return fail
    return out


def basic(c: Column, lower: bool = True) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: basic_tokens(x, lower))

    return run(c)


def wordpiece(c: Column, vocab: dict[str, int], unknown: bool = False) -> Column:
    """Pieces of a token array; the vocabulary is a file of bounded size and travels with the function."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda tokens: [p for t in tokens for p in pieces(t, vocab, unknown)])

    return run(c)


def full(c: Column, vocab: dict[str, int]) -> Column:
    return wordpiece(basic(c), vocab)


def with_tokenizer(c: Column, tokenizer: Callable[[str], list[str]]) -> Column:
    """Words by a caller's tokenizer that keeps all characters but white space: array of struct(word, start)."""

    @F.pandas_udf("array<struct<word:string,start:int>>")
    def run(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            out, at = [], 0
            for w in tokenizer(text or ""):
                at = text.index(w, at)  # raises if the tokenizer changed the text
                out.append({"word": w, "start": at})
                at += len(w)
            return out

        return s.map(one)

    return run(c)


def _letters_of(c: str, lower: bool) -> int:
    """How many characters of tokens one character of a text gives."""
    if _is_space(c) or c in "\x00\ufffd" or _is_control(c):
        return 0
    if not lower:
        return 1
    return sum(unicodedata.category(x) != "Mn" for x in unicodedata.normalize("NFD", c.lower()))


def aligned_span(original: str, tokenized: str, lower: bool = True) -> tuple[int, int]:
    """Where tokens (joined by spaces, pieces marked by ##) stand in the original; all of it where they don't.

    They are looked for in the original's own tokens; the characters of those are counted against the original's, an accent with its letter.
    """
    wanted = " ".join(tokenized.replace(" ##", "").replace("##", "").split())
    tokens = " ".join(basic_tokens(original, lower))
    at = tokens.find(wanted)
    if not wanted or at < 0:
        return 0, len(original)
    first = at - tokens.count(" ", 0, at)
    last = first + len(wanted) - wanted.count(" ") - 1
    sizes = [_letters_of(c, lower) for c in original]
    if sum(sizes) != len(tokens) - tokens.count(" "):
        return 0, len(original)
    place = [i for i, n in enumerate(sizes) for _ in range(n)]
    end = place[last] + 1
    while end < len(original) and unicodedata.category(original[end]) == "Mn":  # accents of the last letter
        end += 1
    return place[first], end


def span_in_words(words: list[str], first: int, last: int, tokenized: str, lower: bool = True) -> tuple[int, int]:
    """The same for tokens that come from words first to last of a text whose words are joined by single spaces; places count from the text's start."""
    before = sum(len(w) + 1 for w in words[:first])
    start, end = aligned_span(" ".join(words[first : last + 1]), tokenized, lower)
    return before + start, before + end


def final_text(original: Column, tokenized: Column) -> Column:
    @F.pandas_udf("struct<start:int,end:int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([aligned_span(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["start", "end"])

    return run(original, tokenized)


def _draw(key: Column, what: str, at: Column | int = 0) -> Column:
    """A number in [0, 1) fixed by the key, the kind of draw and the place."""
    text = F.concat_ws(":", key.cast("string"), F.lit(what), (at if isinstance(at, Column) else F.lit(at)).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _pick(draw: Column, low: int | Column, high: int | Column) -> Column:
    """low to high, both included, by a draw."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(draw * (high - low + 1))).cast("long")


def shortened(ids: Column, key: Column, share: float, least: int = 0, most: int = 300, always_shorter: bool = False) -> Column:
    """Ids (a mark, the tokens, an end mark) cut to a drawn number of tokens, the end mark kept; always_shorter draws at most their own number."""
    n = F.size(ids) - 2
    to = _pick(_draw(key, "length"), least, F.least(n, F.lit(most)) if always_shorter else most)
    cut = F.concat(F.slice(ids, F.lit(1), (to + 1).cast("int")), F.slice(ids, -1, 1))
    return F.when((_draw(key, "shorten") < share) & (to < n), cut).otherwise(ids)


def replaced(ids: Column, key: Column, share: float, unknown_share: float, vocab_size: int = 30522, unknown: int = 100, least_id: int = 999) -> Column:
    """Tokens between the marks replaced with a probability: by the unknown id or by one drawn from least_id up."""

    def one(x: Column, i: Column) -> Column:
        new = F.when(_draw(key, "unknown", i) < unknown_share, F.lit(unknown).cast("long")).otherwise(_pick(_draw(key, "new", i), least_id, vocab_size - 1))
        return F.when((i > 0) & (i < F.size(ids) - 1) & (_draw(key, "replace", i) < share), new).otherwise(x.cast("long"))

    return F.transform(ids, one)


def shuffled(ids: Column, key: Column, share: float) -> Column:
    """From the first token to the last, each takes with a probability the id of a token drawn from the sequence as it then is. For a model's input of bounded length."""

    def step(acc: Column, i: Column) -> Column:
        other = F.element_at(acc, (_pick(_draw(key, "other", i), 1, F.size(ids) - 2) + 1).cast("int"))
        new = F.concat(F.slice(acc, F.lit(1), i), F.array(other), F.slice(acc, i + 2, F.size(ids)))
        return F.when(_draw(key, "shuffle", i) < share, new).otherwise(acc)

    return F.when(F.size(ids) > 2, F.aggregate(F.sequence(F.lit(1), F.size(ids) - 2), ids, step)).otherwise(ids)


def noisy(ids: Column, key: Column, vocab_size: int = 30522, shorten: float = 0.5, replace: float = 0.3, unknown: float = 0.1, shuffle: float = 0.2, least: int = 0, most: int = 300) -> Column:
    """A passage's ids with noise: shortened, some tokens replaced, some shuffled. All draws are fixed by the key."""
    return shuffled(replaced(shortened(ids, key, shorten, least, most), key, replace, unknown, vocab_size), key, shuffle)


def noisy_negative(ids: Column, key: Column, vocab_size: int = 30522, share: float = 1.0, shorten: float = 1.0, replace: float = 1.0, unknown: float = 1.0, shuffle: float = 1.0, least: int = 0, most: int = 300) -> Column:
    """The same for a share of negatives, which are cut to at most their own length and by default lose all their tokens."""
    changed = shuffled(replaced(shortened(ids, key, shorten, least, most, always_shorter=True), key, replace, unknown, vocab_size), key, shuffle)
    return F.when(_draw(key, "negative") < share, changed).otherwise(ids)


def framed(ids: Column, start: int, end: int, most: int | None = None) -> Column:
    """Ids between a start and an end mark, cut to `most` tokens first."""
    ids = ids if most is None else F.slice(ids, 1, most)
    return F.concat(F.array(F.lit(start).cast("long")), ids.cast("array<long>"), F.array(F.lit(end).cast("long")))
