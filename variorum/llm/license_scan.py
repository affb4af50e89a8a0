"""Licence scans by a positional index of rare tokens, in DataFrame functions alone.

Templates are notices and whole licence texts with a label.  Document
frequencies of their words, over all documents, rank them; the rarest of each
template and their positions are the postings.  A text looks up the words that
it shares with the postings, rarest first, takes every posting as a guess of
where a template starts, and intersects the guesses: those that agree on
(template, start) are one candidate, weighed by the IDF of the words that
agree.  A candidate counts if the template's mandatory phrase stands at its
place, word by word, and enough weight agrees.

The base phrases are templates whose phrase is the whole of them; any of their
rare words is enough, so every place is found.

Defined results: null and empty texts have no words, no places, empty labels
and a score of 0; very long texts are scanned whole; words that tie in
frequency rank by their letters; equal rows are scanned one by one; an empty
table gives an empty one; columns beside the named ones are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm._licences import NOTICES

# The phrases of the base scan with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a short and of a long template that are posted, words of a long one, and the share of their weight that must agree.
RARE, RARE_OF_LONG, LONG, SHARE = 3, 8, 24, 0.6


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    phrase: tuple[str, ...]
    label: str
    base: bool

    def rare(self, idf: dict[str, float]) -> list[str]:
        """Its rarest words."""
        return sorted(set(self.words), key=lambda w: (-idf[w], w))[: RARE_OF_LONG if len(self.words) > LONG else RARE]

    @property
    def offset(self) -> int:
        n = len(self.phrase)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.phrase)


def templates() -> list[Template]:
    base = [Template(tuple(p.split()), tuple(p.split()), label, True) for p, label in BASE.items()]
    return base + [Template(tuple(re.findall(WORD, t.lower())), tuple(p.split()), label, False) for t, p, label in NOTICES]


def _words(text: str) -> Column:
    # lower() would turn these two letters beyond ASCII into ASCII ones
    own = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")), F.lit("İ"), F.lit("ı"))
    return F.regexp_extract_all(F.lower(own), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def inverse_frequencies(docs: DataFrame, found: list[Template]) -> dict[str, float]:
    """IDF of the templates' words over all documents."""
    vocabulary = sorted({w for t in found for w in t.words})
    held = docs.select(F.explode(F.array_intersect(_words("text"), _strings(vocabulary))).alias("word")).groupBy("word").count().collect()  # a row for each word of the templates at most
    n, df = docs.count(), {r["word"]: r["count"] for r in held}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    found = templates()
    idf = inverse_frequencies(docs, found)
    rare = [t.rare(idf) for t in found]
    lookup = sorted({w for ws in rare for w in ws}, key=lambda w: (-idf[w], w))  # rarest first, and so are a text's own
    number = {w: i for i, w in enumerate(lookup)}
    postings: list[list[tuple[int, int, float]]] = [[] for _ in lookup]
    for k, (t, ws) in enumerate(zip(found, rare, strict=True)):
        total = sum(idf[w] for i, w in enumerate(t.words) if w in ws)
        for i, w in enumerate(t.words):
            if w in ws:
                postings[number[w]].append((k, i, idf[w] / total))
    listed = F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(x).alias("x")) for k, i, x in p]) for p in postings])
    about = F.array(*[F.struct(_strings(t.phrase).alias("phrase"), F.lit(t.offset).alias("offset"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in found])

    words = F.col("words")
    own, posted = F.col("own"), F.col("posted")
    at = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(own, w).cast("int").alias("n"), i.alias("i"))), lambda s: s["n"] > 0)
    guesses = F.flatten(F.transform(at, lambda s: F.transform(F.get(posted, s["n"] - 1), lambda p: F.struct(p["k"].alias("k"), (s["i"] - p["i"]).alias("start"), p["x"].alias("x")))))
    some = docs.select("doc_id", _words("text").alias("words"))
    some = some.select("doc_id", "words", F.array_intersect(_strings(lookup), words).alias("own"))  # rarest first
    some = some.select("doc_id", "words", "own", F.transform("own", lambda w: F.get(listed, (F.array_position(_strings(lookup), w) - 1).cast("int"))).alias("posted"))
    some = some.select("doc_id", "words", F.when(F.size(own) > 0, F.array_sort(guesses)).alias("g"))

    g = F.col("g")
    changes = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i)["k"] != F.get(g, i - 1)["k"]) | (F.get(g, i)["start"] != F.get(g, i - 1)["start"]))
    some = some.select("doc_id", "words", "g", F.when(F.size(g) > 0, changes).alias("c"))
    c = F.col("c")

    def candidate(first: Column, number: Column) -> Column:
        end = F.coalesce(F.get(c, number + 1), F.size(g))
        agree = F.aggregate(F.slice(g, first + 1, end - first), F.lit(0.0), lambda s, p: s + p["x"])
        return F.struct(F.get(g, first)["k"].alias("k"), F.get(g, first)["start"].alias("start"), F.least(agree, F.lit(1.0)).alias("share"))

    def stands(s: Column) -> Column:
        t = F.get(about, s["k"])
        begin = s["start"] + t["offset"]
        return (begin >= 0) & (F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"]) & (t["base"] | (s["share"] >= SHARE))

    some = some.select("doc_id", "words", F.filter(F.transform(c, candidate), stands).alias("m"))
    m = F.col("m")
    base = F.transform(F.filter(m, lambda s: F.get(about, s["k"])["base"]), lambda s: F.struct(s["start"].alias("start"), F.get(about, s["k"])["label"].alias("label")))
    some = some.select("doc_id", "words", "m", base.alias("b"))
    names = lambda labels: F.coalesce(F.concat_ws(",", F.array_sort(F.array_distinct(labels))), F.lit(""))
    starts = F.transform("b", lambda s: s["start"])
    return some.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(F.transform("b", lambda s: s["label"])).alias("base_labels"),
        names(F.transform(m, lambda s: F.get(about, s["k"])["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform(m, lambda s: F.when(F.get(about, s["k"])["base"], 1.0).otherwise(s["share"]))), F.lit(0.0)).alias("score"),
    )
