"""Licence scans: fixed phrases, and an exact set-similarity join of text blocks with licence templates.

Phrases: every place where a phrase's words stand consecutively counts.

Templates: a block meets a template when it holds at least ``containment`` of the template's distinct
words. Words are put in one order for the whole corpus, rarest first, by counting the templates' words
over all documents. To reach the threshold, a block must hold one of a template's first
``n - need + 1`` words in that order (prefix filter), have at least ``need`` distinct words (length filter),
and, given the place of the first shared word, have enough of the template left (positional filter). What
passes is counted exactly, so the filters lose nothing. Blocks are lines; a line of over ``BLOCK_WORDS`` words
is cut into blocks of that size, each beginning half a block after the last. Besides, each template has blocks
of twice its length over the words of the whole text, half overlapping, so a notice is found however its lines
are broken and however long it is. Notices resemble each other, and every template that a block meets gives its
label: the notice of one version of a licence meets those of the others too.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are put in lower case. Null texts are
empty; a document without words has no labels and score 0. Repeated rows are scanned each time; an empty
table gives no rows. Other columns are not read. Templates and phrases are a parameter of a size that a
closure can carry (``MAX_TEMPLATE_WORDS`` words in all; more are refused).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.75
BLOCK_WORDS = 64
MAX_TEMPLATE_WORDS = 200_000

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notices that licences ask their users to place in a work, by SPDX identifier.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution license": "cc-by-4.0",
    "dedicated to the public domain under cc0": "cc0-1.0",
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text)


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _template_sets(templates: Mapping[str, str]) -> dict[frozenset[bytes], tuple[str, int]]:
    """Distinct words -> label, number of words."""
    sets: dict[frozenset[bytes], tuple[str, int]] = {}
    for text, label in templates.items():
        words = words_of(_plain(text))
        if words:
            _, longest = sets.get(frozenset(words), (label, 0))
            sets[frozenset(words)] = label, max(longest, len(words))
    if sum(map(len, sets)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words in all")
    return sets


def word_frequencies(docs: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of the given words stands in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(w for w in words_of(_plain(text)) if w in words)
        yield pd.DataFrame([(w.decode(), n) for w, n in found.items()], columns=["word", "n"], dtype=object)

    counted = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}  # at most the templates' words


class TemplateIndex:
    """Finds all templates that a block of words contains to the threshold."""

    def __init__(
        self, sets: Mapping[frozenset[bytes], tuple[str, int]], frequency: Mapping[bytes, int], containment: float
    ):
        rank = lambda w: (frequency.get(w, 0), w)
        self.templates, self.by_word = [], defaultdict(list)
        for words, (label, length) in sets.items():
            need = max(1, -(-int(round(containment * len(words) * 1e9)) // 10**9))
            self.templates.append((words, label, need, length))
            for place, word in enumerate(sorted(words, key=rank)[: len(words) - need + 1]):
                self.by_word[word].append((len(self.templates) - 1, place))
        self.least = min((need for _, _, need, _ in self.templates), default=0)

    def contained(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of all templates met by a block."""
        if len(block) < self.least:
            return
        first: dict[int, int] = {}
        for word in block & self.by_word.keys():
            for which, place in self.by_word[word]:
                first[which] = min(place, first.get(which, place))
        for which, place in first.items():
            words, label, need, _ = self.templates[which]
            if len(block) >= need and len(words) - place >= need:
                shared = words & block
                if len(shared) >= need:
                    yield label, len(shared) / len(words)

    def in_text(self, lines: list[list[bytes]]) -> dict[str, float]:
        """Label -> largest containment of all templates met by a text's blocks."""
        words = [w for line in lines for w in line]
        found = [hit for start, end in blocks_of(lines) for hit in self.contained(set(words[start:end]))]
        windows = set()
        for at, word in enumerate(words):
            for which, _ in self.by_word.get(word, ()):
                last = at // self.templates[which][3]
                windows.update((which, n) for n in (last - 1, last) if n >= 0)
        for which, n in windows:
            template, label, need, length = self.templates[which]
            shared = template.intersection(words[n * length : (n + 2) * length])
            if len(shared) >= need:
                found.append((label, len(shared) / len(template)))
        met: dict[str, float] = {}
        for label, share in found:
            met[label] = max(share, met.get(label, 0.0))
        return met


def blocks_of(lines: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """First word and end of the lines' blocks, counted over the whole text."""
    first = 0
    for words in lines:
        if len(words) <= BLOCK_WORDS:
            yield first, first + len(words)
        else:
            for at in range(0, len(words) - BLOCK_WORDS // 2, BLOCK_WORDS // 2):
                yield first + at, first + min(at + BLOCK_WORDS, len(words))
        first += len(words)


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: (label, first word, number of words) of every phrase. score: 1 with a phrase, else the largest
    containment of a template that is met, else 0.
    """
    sets = _template_sets(templates)
    frequency = word_frequencies(docs, frozenset().union(*sets)) if sets else {}
    by_first = defaultdict(list)
    for phrase, label in phrases.items():
        first, *rest = words_of(_plain(phrase))
        by_first[first].append((rest, label))
    schema = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:long,words:long>>"
    )
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    index = TemplateIndex(sets, frequency, containment)

    def one(text: str | None) -> tuple:
        plain = _plain(text)
        lines = [words_of(line) for line in plain.split(b"\n")]
        words = [w for line in lines for w in line]
        spans = [
            (label, at, 1 + len(rest))
            for at, word in enumerate(words)
            if word in by_first
            for rest, label in by_first[word]
            if words[at + 1 : at + 1 + len(rest)] == rest
        ]
        starts = [at for _, at, _ in spans]
        met = {label: 1.0 for label, _, _ in spans}
        base = sorted(met)
        if not index.by_word.keys().isdisjoint(words):
            for label, share in index.in_text(lines).items():
                met[label] = max(share, met.get(label, 0.0))
        return (
            len(words), len(spans), min(starts, default=None), max(starts, default=None),
            ",".join(base), ",".join(sorted(met)), max(met.values(), default=0.0),
            [dict(zip(("label", "first", "words"), s)) for s in spans],
        )

    @F.pandas_udf(schema)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=names, dtype=object)

    return docs.select("doc_id", scanned("text").alias("found")).select("doc_id", "found.*")
