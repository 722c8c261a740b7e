"""License scans: ordered signature rules over normalised words, all in Catalyst expressions.

A text is lower-cased (A-Z) and its words joined by single spaces. A rule is a regex over that form, gated by
a keyword that must occur first, with a priority and a confidence. The rule table is built from license families times
sentence templates, a few hundred rules. Everything happens within a row: one scan, no shuffle, no Python.

Overlaps: a detection that lies wholly inside the span of another is suppressed if the other's priority is as good (small) or better; of equal
spans the better priority stays, then the first rule. So a name inside a grant goes, and a grant inside the loose mention of
another license stays beside it. Detections that only overlap in part both stay.

Null or empty texts have no words and no detections, and an empty table gives an empty result. Very long texts are scanned whole, within their row. Repeated rows are scanned each for itself; extra columns pass
through `scan` and are left out of the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from phrasewell.llm._shared import LOWER, UPPER, WORD_GAP, ascii_lower, let, table, text_or_empty

# The three base phrases and their labels, from the query's contract.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: label: (keyword that gates the rules, regex of the name in normalised words, SPDX-like ids in normalised words)
FAMILIES = {
    "apache-2.0": ("apache", r"apache (?:software )?(?:license|licence)(?: v(?:ersion)? ?2(?: 0)?| version 2(?: 0)?| 2(?: 0)?)?", r"apache 2 0"),
    "apache-1.1": ("apache", r"apache (?:software )?license (?:version |v)?1 1", r"apache 1 1"),
    "mit": (" mit ", r"mit (?:license|licence)", r"mit"),
    "x11": ("x11", r"x11 (?:license|licence)", r"x11"),
    "isc": (" isc ", r"isc (?:license|licence)", r"isc"),
    "bsd-2-clause": ("bsd", r"(?:simplified|2 clause|two clause) bsd license|bsd 2 clause(?: license)?", r"bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause(?: license)?", r"bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?", r"bsd 4 clause"),
    "0bsd": ("bsd", r"(?:zero clause bsd|0bsd)(?: license)?", r"0bsd"),
    "gpl-2.0": ("general public", r"(?:gnu )?general public license (?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    "gpl-3.0": ("general public", r"(?:gnu )?general public license (?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    "gnu-gpl": ("general public", r"gnu general public license", r"gpl"),
    "lgpl-2.1": ("lesser general", r"(?:gnu )?lesser general public license (?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?"),
    "lgpl-3.0": ("lesser general", r"(?:gnu )?lesser general public license (?:version |v)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    "lgpl": ("lesser general", r"(?:gnu )?lesser general public license", r"lgpl"),
    "agpl-3.0": ("affero", r"(?:gnu )?affero general public license(?: (?:version |v)?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    "gfdl": ("free documentation", r"(?:gnu )?free documentation license(?: (?:version |v)?1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    "mpl-1.1": ("mozilla", r"mozilla public license (?:version |v)?1 1", r"mpl 1 1"),
    "mpl-2.0": ("mozilla", r"mozilla public license(?: (?:version |v)?2(?: 0)?)?", r"mpl 2 0"),
    "epl-1.0": ("eclipse", r"eclipse public license (?:version |v)?1 0", r"epl 1 0"),
    "epl-2.0": ("eclipse", r"eclipse public license(?: (?:version |v)?2 0)?", r"epl 2 0"),
    "cddl-1.0": ("common development", r"common development and distribution license(?: (?:version |v)?1 [01])?", r"cddl 1 [01]"),
    "cpl-1.0": ("common public", r"common public license(?: (?:version |v)?1 0)?", r"cpl 1 0"),
    "eupl": ("european union", r"european union public (?:license|licence)(?: (?:version |v)?1 [012])?", r"eupl 1 [012]"),
    "artistic": ("artistic", r"artistic license(?: (?:version |v)?[12] 0)?", r"artistic [12] 0"),
    "bsl-1.0": ("boost", r"boost software license(?: (?:version |v)?1 0)?", r"bsl 1 0"),
    "busl-1.1": ("business source", r"business source license(?: (?:version |v)?1 1)?", r"busl 1 1"),
    "zlib": ("zlib", r"zlib(?: libpng)? license", r"zlib"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    "wtfpl": ("public license", r"do what the fuck you want to public license", r"wtfpl"),
    "psf": ("python software", r"python software foundation license", r"psf 2 0"),
    "php": ("php", r"php license(?: (?:version |v)?3 0(?:1)?)?", r"php 3 01?"),
    "postgresql": ("postgresql", r"postgresql (?:license|licence)", r"postgresql"),
    "openssl": ("openssl", r"openssl license", r"openssl"),
    "ofl-1.1": ("open font", r"(?:sil )?open font license(?: (?:version |v)?1 1)?", r"ofl 1 1"),
    "odbl-1.0": ("open database", r"open (?:data commons )?open database license|open database license", r"odbl 1 0"),
    "odc-by": ("open data commons", r"open data commons attribution license", r"odc by 1 0"),
    "pddl": ("open data commons", r"open data commons public domain dedication(?: and license)?", r"pddl 1 0"),
    "cdla": ("community data", r"community data license agreement(?: (?:permissive|sharing))?", r"cdla (?:permissive|sharing) [12] 0"),
    "ms-pl": ("microsoft public", r"microsoft public license", r"ms pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal license", r"ms rl"),
    "cc0-1.0": ("cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    "cc-by-4.0": ("cc by", r"cc by (?:license )?[1234] [05]", r"cc by [1234] [05]"),
    "cc-by-sa": ("cc by", r"cc by sa(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    "cc-by-nc": ("cc by", r"cc by nc(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    "cc-by-nd": ("cc by", r"cc by nd(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    "cc-by-nc-sa": ("cc by", r"cc by nc sa(?: [1234] [05])?", r"cc by nc sa [1234] [05]"),
    "cc-by-nc-nd": ("cc by", r"cc by nc nd(?: [1234] [05])?", r"cc by nc nd [1234] [05]"),
    "cc-attribution": ("creative commons", r"creative commons attribution(?: license)?(?: [1234] [05])?(?: international| unported)?", r"cc by"),
    "cc-attribution-sa": ("creative commons", r"creative commons attribution share ?alike(?: license)?(?: [1234] [05])?(?: international| unported)?", r"cc by sa"),
    "cc-attribution-nc": ("creative commons", r"creative commons attribution non ?commercial(?: license)?(?: [1234] [05])?(?: international| unported)?", r"cc by nc"),
}

#: (template's name, text around {name} or {id}, priority, confidence); the smaller priority is the better.
TEMPLATES = [
    ("grant", r"(?:dual )?(?:licensed|released|distributed|published|provided|available|redistributed|shared) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}", 1, 1.0),
    ("spdx", r"spdx license identifier {id}", 1, 1.0),
    ("subject", r"(?:subject to|governed by|covered by|in compliance with|according to) (?:the )?(?:terms of )?(?:the |an? )?{name}", 2, 0.95),
    ("field", r"(?:license|licence) (?:is )?(?:the )?{id}", 3, 0.8),
    ("see", r"see (?:the )?{name}(?: for (?:more )?details)?", 3, 0.85),
    ("name", r"{name}", 5, 0.7),
]

#: Rules of their own: (label, name, keyword, regex, priority, confidence)
SINGLE = [
    ("public-domain", "dedication", "public domain", r"(?:dedicated|released|placed) (?:in|in ?to|to) the public domain", 1, 1.0),
    ("public-domain", "mention", "public domain", r"(?:is |are )?in the public domain", 4, 0.8),
    ("mit", "text", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 1.0),
    ("isc", "text", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1, 1.0),
    ("bsd", "text", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?", 1, 1.0),
    ("warranty-disclaimer", "text", "without warranty", r"without warranty of any kind(?: express or implied)?", 4, 0.4),
    ("warranty-disclaimer", "text2", "without even the implied", r"without even the implied warranty of merchantability", 4, 0.4),
    ("proprietary", "text", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 2, 0.8),
    ("proprietary", "copying", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use)(?: of this file)?", 2, 0.8),
    ("copyright", "year", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 5, 0.5),
    ("copyright", "holder", "copyright", r"copyright (?:c )?by", 5, 0.5),
    ("cc-url", "url", "creativecommons", r"creativecommons org (?:licenses|publicdomain) (?:by|by sa|by nc|by nd|by nc sa|by nc nd|zero|mark)(?: [1234] [05])?", 1, 1.0),
    ("osi-url", "url", "opensource", r"opensource org licenses? [a-z0-9]+(?: [0-9])*", 2, 0.9),
    ("gnu-url", "url", "gnu org", r"gnu org (?:licenses|copyleft) [al]?gpl(?: [0-9])*", 2, 0.9),
    ("apache-2.0", "url", "apache org", r"apache org licenses license 2 0", 1, 1.0),
    ("reserved", "some", "some rights reserved", r"some rights reserved", 4, 0.5),
    ("no-derivatives", "text", "permission", r"may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed))? without (?:prior |written |express )*permission", 2, 0.8),
]


def rules() -> list[tuple[str, str, str, str, int, float, bool]]:
    """(rule, label, keyword, regex, priority, confidence, is_base), in the order of the rule numbers."""
    out = [(f"base:{label}", label, phrase, phrase, 6, 0.6, True) for phrase, label in BASE_PHRASES]
    for label, (keyword, name, ids) in FAMILIES.items():
        for kind, text, priority, confidence in TEMPLATES:
            gate = "spdx license identifier" if kind == "spdx" else keyword
            if kind == "field":
                gate = " licen"  # in both spellings
            out.append((f"{label}:{kind}", label, gate, text.format(name=f"(?:{name})", id=f"(?:{ids})"), priority, confidence, False))
    out += [(f"{label}:{kind}", label, *rest, False) for label, kind, *rest in SINGLE]
    return out


DETECTION = "array<struct<s:int,ne:int,pr:int,id:int,label:string,conf:double,base:boolean>>"
#: Detections are gathered in runs of this many, so that a text with very many costs no quadratic copying.
RUN = 512


def _words(c: Column) -> Column:
    """Words in a piece that begins and ends with a space."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1


def _gather(items: Column, start: Column, step) -> Column:
    """Folds items with step(state, item) -> (new state, element or null) and returns the elements that aren't null; linear in their number."""
    none = F.expr(f"cast(array() as {DETECTION})")
    zero = F.struct(start.alias("st"), F.expr(f"cast(array() as array<{DETECTION}>)").alias("runs"), none.alias("cur"))

    def merge(acc: Column, x: Column) -> Column:
        def put(p: Column) -> Column:
            full = F.size(acc.cur) >= RUN
            one = F.when(p.el.isNull(), none).otherwise(F.array(p.el))
            return F.struct(
                p.st.alias("st"),
                F.when(full, F.concat(acc.runs, F.array(acc.cur))).otherwise(acc.runs).alias("runs"),
                F.when(full, one).otherwise(F.concat(acc.cur, one)).alias("cur"),
            )

        return let(step(acc.st, x), put)

    return F.aggregate(items, zero, merge, lambda a: F.flatten(F.concat(a.runs, F.array(a.cur))))


def _found(norm: Column, r: Column) -> Column:
    """All places of rule r in norm."""

    def places(p: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            end = at + _words(F.concat(F.lit(" "), p.hits[i], F.lit(" ")))
            el = F.struct(at.alias("s"), (-end).alias("ne"), r.pr.alias("pr"), r.id.alias("id"), r.label.alias("label"), r.conf.alias("conf"), r.base.alias("base"))
            return F.struct((end + _words(p.rest[i + 1])).alias("st"), el.alias("el"))

        return F.when(F.size(p.hits) > 0, _gather(F.sequence(F.lit(0), F.size(p.hits) - 1), _words(p.rest[0]), step)).otherwise(F.expr(f"cast(array() as {DETECTION})"))

    return let(F.struct(F.split(norm, r.rx, -1).alias("rest"), F.regexp_extract_all(norm, r.rx, F.lit(0)).alias("hits")), places)


def _kept(found: Column) -> Column:
    """The detections that aren't inside the span of one with as good a priority.

    In order of start, longer ones first, what holds a detection comes before it; for each priority the furthest end so far of that or a better one decides.
    """
    levels = range(1, 1 + max(r[4] for r in rules()))

    def step(ends: Column, d: Column) -> Column:
        to = F.transform(ends, lambda e, i: F.when(i + 1 >= d.pr, F.greatest(e, -d.ne)).otherwise(e))
        return F.struct(to.alias("st"), F.when(-d.ne > F.element_at(ends, d.pr), d).alias("el"))

    return _gather(F.array_sort(found), F.array(*[F.lit(-1) for _ in levels]), step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words and two arrays of detections: found (all) and kept (not suppressed).

    A detection has s (first word, from 0), ne (minus the word after the last), pr, id (rule number), label, conf
    and base. Null texts count as empty.
    """
    bare = F.trim(F.regexp_replace(ascii_lower(text_or_empty(text)), WORD_GAP, " "))
    all_rules = rules()
    keywords = F.array(*[F.lit(k) for k in dict.fromkeys(r[2] for r in all_rules)])
    fixed = F.array(*[
        F.struct(F.lit(kw).alias("kw"), F.lit(f"(?<= )(?:{rx})(?= )").alias("rx"), F.lit(pr).alias("pr"), F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(conf).alias("conf"), F.lit(base).alias("base"))
        for i, (_, label, kw, rx, pr, conf, base) in enumerate(all_rules)
    ])
    none = F.expr(f"cast(array() as {DETECTION})")
    out = docs.withColumn("_bare", bare)
    out = out.withColumn("_norm", F.when(F.col("_bare") == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), "_bare", F.lit(" "))))
    out = out.withColumn("n_words", _words(F.col("_norm")).cast("long"))
    norm = F.col("_norm")
    out = out.withColumn("_kw", F.filter(keywords, lambda k: F.contains(norm, k)))
    gated = F.when(F.size("_kw") == 0, none).otherwise(
        F.flatten(F.transform(F.filter(fixed, lambda r: F.array_contains(F.col("_kw"), r.kw)), lambda r: _found(norm, r)))
    )
    out = out.withColumn("found", gated)
    out = out.withColumn("kept", F.when(F.size("found") == 0, none).otherwise(_kept(F.col("found"))))
    return out.drop("_bare", "_norm", "_kw")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per scanned row with the contract's columns."""
    base = F.filter("found", lambda d: d.base)
    out = scanned.withColumn("_base", base)
    places = F.transform("_base", lambda d: d.s)
    labels = lambda a: F.transform(a, lambda d: d.label)
    return out.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("_base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels("_base"), labels("kept"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d.conf)), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))



def sql() -> str:
    """The digest in DuckDB SQL. Its regexes have no look-around, so there each word has a space of its own on both sides."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({i}, {quote(label)}, {quote(kw)}, {quote(' (?:' + rx.replace(' ', '(?:  )') + ') ')}, {pr}, {conf}::DOUBLE, {base})" for i, (_, label, kw, rx, pr, conf, base) in enumerate(rules()))
    levels = " ".join(f"WHEN {k} THEN max(CASE WHEN pr <= {k} THEN e END) OVER before" for k in range(1, 1 + max(r[4] for r in rules())))
    return f"""
WITH rules(id, label, kw, rx, pr, conf, base) AS (VALUES
  {rows}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_GAP}', ' ', 'g'), ' ') AS bare
  FROM documents),
n AS (
  SELECT r, doc_id, CASE WHEN bare = '' THEN 0 ELSE len(bare) - len(replace(bare, ' ', '')) + 1 END::BIGINT AS n_words,
         ' ' || bare || ' ' AS norm, CASE WHEN bare = '' THEN '' ELSE ' ' || replace(bare, ' ', '  ') || ' ' END AS twice
  FROM d),
hit AS (
  SELECT r, id, label, pr, conf, base, regexp_split_to_array(twice, rx) AS rest, regexp_extract_all(twice, rx) AS hits
  FROM n JOIN rules ON contains(norm, kw)),
found AS (
  SELECT *, s + (len(h) - len(replace(h, ' ', ''))) // 2 AS e
  FROM (
    SELECT r, id, label, pr, conf, base, hits[i] AS h,
           (len(b) - len(replace(b, ' ', ''))) // 2 AS s
    FROM (SELECT *, array_to_string(rest[1:i], '') || array_to_string(hits[1:i - 1], '') AS b
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hit WHERE len(hits) > 0)))),
judged AS (
  SELECT *, e > coalesce(CASE pr {levels} END, -1) AS kept
  FROM found WINDOW before AS (PARTITION BY r ORDER BY s, e DESC, pr, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels, max(conf) FILTER (kept) AS score
  FROM judged GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM n LEFT JOIN per USING (r)
"""


__all__ = ["rules", "scan", "digest", "query", "sql"]
