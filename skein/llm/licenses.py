"""License scans: a positional rare-token index, native from end to end.

Templates are licence texts, those given here or a table of them. Each is indexed by its rarest words, rarest by their
document frequency in the whole corpus: as many as it may differ in words, and SURE more, so that by the pigeonhole
principle an acceptable place agrees with at least SURE of them. The index is one list of postings, (template,
position) by word. A document looks its rare words up; each posting gives the place where the template would start;
places are intersected by counting, and those with enough postings stay. There the mandatory key phrases must stand
and enough of the template's words must agree.

Null texts count as empty: no words, no labels, score 0. Equal rows give equal rows, and rows without doc_id are rows
like others. Of labels at one place all are given. A very long text costs in proportion to its words and to the
postings of its rare words; it stays in one row. An empty table gives an empty one. Only doc_id and text are read;
other columns go, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Postings that an acceptable place has at least, where its template has so many words.
SURE = 3
#: Words that a template may begin before a text.
BEFORE = 1 << 20
#: Bytes of templates at most.
INDEX_BYTES = 4 << 20


@dataclass(frozen=True)
class Template:
    """A notice, its label, its mandatory key phrases, and the share of its words that must agree."""

    label: str
    text: str
    keys: tuple[str, ...]
    agree: float = 0.8
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def slack(self) -> int:
        """Words that may differ."""
        n = len(self.words)
        return n - self.least

    @property
    def least(self) -> int:
        n = len(self.words)
        return n if self.base else min(n, -int(-n * self.agree // 1))

    def key_words(self) -> list[tuple[int, str]]:
        """The key phrases' words with their positions."""
        words, out = self.words, set()
        for key in self.keys:
            k = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            out |= {(at + j, w) for j, w in enumerate(k)}
        return sorted(out)


def normal(text: str) -> str:
    """A text's words, one space between them."""
    return " ".join(w for w in re.split(SEPARATORS, text.translate({c: c + 32 for c in range(65, 91)})) if w)


def base(label: str, phrase: str) -> Template:
    return Template(label, phrase, (phrase,), 1.0, True)


TEMPLATES = (
    base("cc-by", "cc by"),
    base("gpl", "general public license"),
    base("reserved", "all rights reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "3")),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words. The Kelvin sign is taken out first: lower() would turn it into an ASCII letter."""
    lowered = F.lower(F.replace(F.col("text"), F.lit("K"), F.lit("ĸ")))
    return docs.withColumn("words", F.array_remove(F.split(lowered, SEPARATORS), ""))


def document_frequency(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each template word stands. As many rows as the templates have words reach the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = with_words(docs).select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_words(template: Template, frequency: dict[str, int]) -> list[tuple[int, str]]:
    """The positions and words that index a template: its highest-IDF words, SURE more than may differ if it has them."""
    order = sorted(enumerate(template.words), key=lambda x: (frequency.get(x[1], 0), x[0]))
    return order[: template.slack + SURE]


def templates_of(table: DataFrame) -> tuple[Template, ...]:
    """Templates of a table: label, text, keys (an array of phrases of the text), agree. Its size is bounded by INDEX_BYTES."""
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > INDEX_BYTES:
        raise ValueError(f"templates of {size} bytes; the index is part of the plan and takes {INDEX_BYTES}")
    return tuple(Template(r["label"], normal(r["text"]), tuple(normal(k) for k in r["keys"]), r["agree"]) for r in table.select("label", "text", "keys", "agree").collect())


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def index(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, str]:
    """The index as SQL constants: the rare words, postings, and the templates with their key words."""
    frequency = document_frequency(docs, templates)
    postings: dict[str, list] = {}
    shown = []
    for number, t in enumerate(templates):
        chosen = rare_words(t, frequency)
        for at, word in chosen:
            postings.setdefault(word, []).append({"t": number, "i": at})
        shown.append({"label": t.label, "base": t.base, "words": t.words, "need": max(1, len(chosen) - t.slack), "least": t.least, "keys": [{"i": i, "w": w} for i, w in t.key_words()]})
    lists = {w: i for i, w in enumerate(sorted(postings))}

    def constant(value: list, kind: str) -> str:
        escaped = json.dumps(value, ensure_ascii=False).replace("\\", "\\\\").replace("'", "\\'")
        return f"from_json('{escaped}', '{kind}')"

    return {
        "rare": _quoted(lists),
        "numbers": f"map({', '.join(f"'{w}', {i}" for w, i in lists.items())})",
        "postings": constant([postings[w] for w in lists], "array<array<struct<t:int,i:int>>>"),
        "templates": constant(shown, "array<struct<label:string,base:boolean,words:array<string>,need:int,least:int,keys:array<struct<i:int,w:string>>>>"),
    }


def scan(docs: DataFrame, templates: tuple[Template, ...] | DataFrame = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places (label, start).

    score: the largest share of a notice's words that agree at a place where it stands; 1 for a whole notice.
    """
    docs = texts(docs)
    if isinstance(templates, DataFrame):
        templates = tuple(t for t in TEMPLATES if t.base) + templates_of(templates)
    has = index(docs, templates)
    hits = f"filter(transform(words, (w, p) -> CASE WHEN w IN ({has['rare']}) THEN named_struct('w', w, 'p', p) END), x -> x IS NOT NULL)"
    # a place is one number: the template, then where it starts (it may be before the text)
    looked_up = f"get({has['postings']}, element_at({has['numbers']}, h.w))"
    met = f"array_sort(flatten(transform(hits, h -> transform({looked_up}, e -> shiftleft(bigint(e.t), 40) + (h.p - e.i + {BEFORE})))))"
    number, start = "int(shiftright(m, 40))", f"int((m & {(1 << 40) - 1}L) - {BEFORE})"
    template = f"get({has['templates']}, {number})"
    enough = f"array_distinct(filter(met, (m, k) -> get(met, k + {template}.need - 1) = m))"
    placed = f"transform({enough}, m -> named_struct('t', {template}, 's', {start}))"
    keyed = "filter(placed, x -> forall(x.t.keys, k -> coalesce(get(words, x.s + k.i) = k.w, false)))"
    agreeing = "size(filter(x.t.words, (w, i) -> coalesce(get(words, x.s + i) = w, false)))"
    counted = "transform(keyed, x -> named_struct('label', x.t.label, 'base', x.t.base, 'start', bigint(x.s), 'least', x.t.least, 'agree', {0}, 'of', size(x.t.words)))".format(agreeing)
    found = with_words(docs).select("doc_id", "words", F.expr(hits).alias("hits"))
    found = found.select("doc_id", "words", F.expr(met).alias("met")).select("doc_id", "words", F.expr(placed).alias("placed"))
    found = found.select("doc_id", "words", F.expr(keyed).alias("keyed")).select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(counted).alias("counted"))
    found = found.select("doc_id", "n_words", F.expr("filter(counted, x -> x.agree >= x.least)").alias("places"))
    starts = "transform(filter(places, x -> x.base), x -> x.start)"
    label = lambda chosen: F.expr(f"array_join(array_sort(array_distinct(transform({chosen}, x -> x.label))), ',')")
    return found.select(
        "doc_id",
        "n_words",
        F.expr(f"bigint(size({starts}))").alias("n_base"),
        F.expr(f"array_min({starts})").alias("first_word"),
        F.expr(f"array_max({starts})").alias("last_word"),
        label("filter(places, x -> x.base)").alias("base_labels"),
        label("places").alias("labels"),
        F.expr("coalesce(array_max(transform(places, x -> x.agree / double(x.of))), 0D)").alias("score"),
        F.expr("transform(places, x -> named_struct('label', x.label, 'start', x.start))").alias("places"),
    )


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(docs).drop("places")


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL that tries every place."""
    agree = lambda t: " + ".join(f"CAST(s + {i} >= 0 AND coalesce(w[s + {i + 1}] = '{x}', false) AS INT)" for i, x in enumerate(t.words))
    keys = lambda t: " AND ".join(f"coalesce(w[s + {i + 1}] = '{x}', false)" for i, x in t.key_words())
    # a place may begin before the text as long as its key phrases lie within
    at = ", ".join(f"list_filter(range(-20, len(w)), lambda s: s + {t.key_words()[0][0]} >= 0 AND {keys(t)} AND {agree(t)} >= {t.least}) AS at_{k}" for k, t in enumerate(templates))
    chosen = [(k, t) for k, t in enumerate(templates)]
    bases = [(k, t) for k, t in chosen if t.base]
    label = lambda c: "array_to_string(list_sort(list_distinct(flatten([{}]))), ',')".format(", ".join(f"list_transform(at_{k}, lambda s: '{t.label}')" for k, t in c))
    starts = "flatten([{}])".format(", ".join(f"at_{k}" for k, _ in bases))
    share = "greatest(CAST(0 AS DOUBLE), {})".format(", ".join(f"coalesce(list_max(list_transform(at_{k}, lambda s: ({agree(t)}) / CAST({len(t.words)} AS DOUBLE))), 0)" for k, t in chosen))
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
     p AS (SELECT doc_id, w, {at} FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({starts}) AS BIGINT) AS n_base, CAST(list_min({starts}) AS BIGINT) AS first_word,
       CAST(list_max({starts}) AS BIGINT) AS last_word, {label(bases)} AS base_labels, {label(chosen)} AS labels, {share} AS score
FROM p"""
