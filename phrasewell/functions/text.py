"""Column functions over texts; offsets are from 0 and count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " [PAR] "
_SEP = r" \[PAR\] "
#: The white space that separates words of a context.
CONTEXT_SPACE = r"[ \t\r\n ]+"
NO_SPACE = r"[^ \t\r\n ]+"
ARTICLES = r"(?U)\b(a|an|the)\b"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
TERM = r"[\p{L}0-9]+"


def between(s: Column, start: Column, end: Column) -> Column:
    return F.substring(s, start + 1, end - start)


def paragraphs_of(context: Column) -> Column:
    """The texts between separators, stripped of white space."""
    return F.transform(F.split(context, r"\[PAR\]"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))


def crop(context: Column, start: Column, end: Column) -> Column:
    """The paragraphs that the span touches, and the span's place in them: struct(context, start, end)."""
    left = F.element_at(F.split(F.substring(context, F.lit(1), start), _SEP), -1)
    right = F.element_at(F.split(F.substring(context, end + 1, F.length(context)), _SEP), 1)
    return F.struct(F.concat(left, between(context, start, end), right).alias("context"), F.length(left).alias("start"), (F.length(left) + end - start).alias("end"))


def paragraph_ordinal(context: Column, at: Column) -> Column:
    """Separators that begin before a place."""
    return F.size(F.split(F.substring(context, F.lit(1), at + 4), r"\[PAR\]")) - 1


def word_places(context: Column) -> Column:
    """array of struct(gap, word): each word of a context with the number of characters before it since the word before."""
    gaps = F.transform(F.split(context, NO_SPACE), lambda g: F.length(g))
    return F.zip_with(F.regexp_extract_all(context, F.lit(NO_SPACE), F.lit(0)), F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda w, g: F.struct(g.alias("gap"), w.alias("word")))


def count_of(s: Column, what: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))


def presentable(context: Column, questions: int = 3, exclamations: int = 5) -> Column:
    return (count_of(context, "?") <= questions) & (count_of(context, "!") <= exclamations)


def end_or_next(start: Column, end: Column) -> Column:
    return F.coalesce(end, start + 1)


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two closed intervals meet."""
    return (a1 <= b2) & (b1 <= a2)


def white_tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")


def normalize_answer(s: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(s), PUNCTUATION, ""), ARTICLES, " ")
    return F.array_join(white_tokens(plain), " ")


def exact_match(a: Column, b: Column) -> Column:
    return normalize_answer(a) == normalize_answer(b)


def context_words(s: Column) -> Column:
    return F.filter(F.split(s, CONTEXT_SPACE), lambda t: t != "")


def word_index(s: Column, at: Column) -> Column:
    """The word that holds the character at a place, or the last word before it; -1 if there is none."""
    return F.size(context_words(F.substring(s, F.lit(1), at + 1))) - 1


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def answer_span(tokens: Column, first: Column, last: Column, answer: Column) -> Column:
    """The first place between two tokens at which the answer's tokens stand, as struct(start, end); first and last themselves where there is none."""
    n = F.size(answer)

    def at(t: Column) -> Column:
        places = F.when(last - n + 1 >= first, F.sequence(first, last - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        hit = F.filter(places, lambda i: F.slice(t, i + 1, n) == answer)
        start = F.get(hit, 0)
        return F.struct(F.coalesce(start, first).alias("start"), F.when(start.isNotNull(), start + n - 1).otherwise(last).alias("end"))

    return let(tokens, at)


def terms(s: Column) -> Column:
    """Lower-case terms and pairs of adjacent terms."""

    def with_pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(t, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(F.regexp_extract_all(F.lower(s), F.lit(TERM), F.lit(0)), with_pairs)


def term_id(term: Column) -> Column:
    """One of 2 ** 24 numbers: the first six hex digits of the term's md5."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 6), 16, 10).cast("long")


def tfidf(tf: Column, documents: Column, holding: Column) -> Column:
    return F.log1p(tf) * F.greatest(F.lit(0.0), F.log((documents - holding + 0.5) / (holding + 0.5)))


def title_spaced(title: Column) -> Column:
    return F.lower(F.replace(title, F.lit("_"), F.lit(" ")))


def title_joined(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"(?U)\s+", "_"))


def highlight(s: Column, start: Column, end: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), start), F.lit("<em>"), between(s, start, end), F.lit("</em>"), F.substring(s, end + 1, F.length(s)))


def padded(ids: Column, n: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), n)), 1, n)


def mask(ids: Column, n: int) -> Column:
    return F.slice(F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), n)), 1, n)


def classes(ch: Column) -> Column:
    """The class of a character: space, control, punctuation, cjk or other."""
    # The ranges of CJK ideographs in Unicode.
    cjk = r"^[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]$"
    return (
        F.when(ch.rlike(r"^[ \t\n\r]$|^\p{Zs}$"), "space").when(ch.rlike(r"^\p{C}$"), "control").when(ch.rlike(r"^[!-/:-@\[-`{-~]$|^\p{P}$"), "punctuation").when(ch.rlike(cjk), "cjk").otherwise("other")
    )
