"""License notices by an exact set-similarity join of text blocks against templates."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm import common

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

# Phrases with their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Notices of public licenses, as words, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Licenses:
    """Parameters.

    containment: share of a template's distinct words that a block (a line) must hold, in hundredths.
    templates, phrases: (words, label) each.
    """

    containment: int = 80
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _hash(words: list[str]) -> np.ndarray:
    return common.word_hashes(pa.array([" ".join(words)]), common.PUNCTUATION)[0]


def _frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in the whole corpus; the driver gets a row a word."""
    known = _hash(vocabulary)
    order = np.argsort(known)
    ranked = known[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(ranked), np.int64)
        for batch in common.slices(batches, "text"):
            words, _ = common.word_hashes(batch.column(0), common.PUNCTUATION)
            at = np.searchsorted(ranked, words)
            at[at == len(ranked)] = 0
            counts += np.bincount(at[ranked[at] == words], minlength=len(ranked))
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(counts)], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    found = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary)}


@dataclass
class Matcher:
    """The inverted index of template prefixes, in the global order (rarest word first)."""

    p: Licenses
    rank: dict[str, int]
    templates: list[tuple[list[str], str, int]] = field(default_factory=list)
    index: dict[str, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self) -> None:
        for words, label in self.p.templates:
            ordered = sorted(set(words.split()), key=self.rank.__getitem__)
            need = -(-self.p.containment * len(ordered) // 100)
            for at, word in enumerate(ordered[: len(ordered) - need + 1]):
                self.index[word].append((len(self.templates), at))
            self.templates.append((ordered, label, need))
        self.phrases = [(words.split(), label) for words, label in self.p.phrases]
        seeds = sorted({*self.index, *(words[0] for words, _ in self.phrases)})
        self.seeds = np.sort(_hash(seeds))

    def block(self, words: list[str]) -> list[tuple[str, float]]:
        """Label and containment of each template that a block meets.

        Length filter: at least ``need`` distinct template words. Prefix filter: one of a template's rarest
        words. Positional filter: what stands behind the first shared word on both sides must still suffice.
        """
        held = sorted({w for w in words if w in self.rank}, key=self.rank.__getitem__)
        found, tried = [], set()
        for i, word in enumerate(held):
            for t, at in self.index.get(word, ()):
                ordered, label, need = self.templates[t]
                if t in tried or len(held) < need:
                    continue
                tried.add(t)
                if 1 + min(len(ordered) - at - 1, len(held) - i - 1) < need:
                    continue
                both = len(set(ordered).intersection(held))
                if both >= need:
                    found.append((label, both / len(ordered)))
        return found

    def document(self, text: str) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """n_base, first and last place, labels of phrases, labels of all, and score."""
        words = words_of(text)
        n, places, base, labels, score = 0, [], set(), set(), 0.0
        for phrase, label in self.phrases:
            size = len(phrase)
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + size] == phrase:
                    n += 1
                    places.append(at)
                    base.add(label)
                    score = 1.0
        for line in text.split("\n"):
            for label, share in self.block(words_of(line)):
                labels.add(label)
                score = max(score, share)
        return n, min(places, default=None), max(places, default=None), base, base | labels, score


def scan(docs: DataFrame, p: Licenses = Licenses()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per document.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Base figures are of the phrases;
    labels add those of templates of which a line holds the given share of distinct words, ordered over the
    corpus rarest first for the filters. score: the largest share found (a phrase counts 1), else 0.

    Documents none of whose words can start a match are told apart on word hashes and not looked at again; the rest
    are matched on their words. Defined cases: a null text is empty: no words, no labels, score 0; null or repeated
    doc_ids keep a row each; extra columns are ignored; an empty table gives an empty result.
    """
    vocabulary = sorted({w for words, _ in p.templates for w in words.split()})
    counts = _frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts[w], w)))}
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(p, rank)
        for batch in common.slices(batches, "text"):
            words, cuts = common.word_hashes(batch.column(1), common.PUNCTUATION)
            at = np.searchsorted(matcher.seeds, words)
            at[at == len(matcher.seeds)] = 0
            hits = np.concatenate([[0], np.cumsum(matcher.seeds[at] == words)])
            some = hits[cuts[1:]] > hits[cuts[:-1]]
            rows = []
            for i in range(batch.num_rows):
                found = matcher.document(batch.column(1)[i].as_py()) if some[i] else (0, None, None, (), (), 0.0)
                rows.append((int(cuts[i + 1] - cuts[i]), *found[:3], ",".join(sorted(found[3])), ",".join(sorted(found[4])), found[5]))
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)

