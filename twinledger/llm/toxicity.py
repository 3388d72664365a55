"""Toxicity from a lexicon that misspellings cannot hide from, read in context.

Learning. Words and word beginnings that stand in toxic texts far more often than in clean ones form the
lexicon. A beginning is taken at its longest form that still covers its words, and only if several words
share it; so inflected terms are found as well. A logistic regression over a few sums of what is found
gives the score.

Finding. The lexicon is a trie. Each word is run through it with a Levenshtein automaton for one edit, kept as
bits, which leaves a branch as soon as no spelling below it can be near enough; words that share neither the first
two letters nor the next three with a term cannot be near any and are not run. A word one edit from a whole
term, or one whose beginning is one edit from a beginning, is a misspelling of it, unless clean texts of the fit
hold that word. Two neighbouring letters in the wrong order count as one edit. Frequent whole words that a
beginning matches stay in the trie for their misspellings, which count as the beginning's.

Context. A find is quoted when it stands between quotation marks on its line, or when one of the WINDOW
words before it is a word of reporting. Quoted and misspelled finds count as QUOTED and MISSPELLED of a find.

Only the text is an input of a score; labels serve the fit alone. The fit reads at most FIT_ROWS
labelled rows of each class, chosen by hash, and MAX_TERMS terms; all else covers all documents.
Rows without a label, or with a null one, are not learnt from; of several labels the highest counts. Without any
toxic (or clean) example every score is 0 (or 1), but for rounding. Null texts are empty; an empty text gets the score of
a text without finds. Repeated rows are scored each time; an empty table gives no rows. Other columns are
carried along by ``drop_toxic`` and are not read by the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import written

#: Labelled rows of each class that a fit reads, and terms that a lexicon holds.
FIT_ROWS, MAX_TERMS = 40_000, 5_000
#: Texts that must hold a term, how much more often toxic ones must, and words that share a beginning.
MIN_TEXTS, MIN_RATIO, MIN_WORDS = 8, 20.0, 4
#: Lengths of beginnings, and the least length of a term that may be misspelled.
SHORTEST, LONGEST, FUZZY_LENGTH = 3, 10, 5
WINDOW, QUOTED, MISSPELLED = 4, 0.4, 0.9
THRESHOLD = 0.3
#: Words remembered by a worker, some 10 MB, and those among them that a lexicon's automaton has run, some 20 MB.
#: Workers outlive a step, so what is remembered for one adds to the memory of all after it.
KEPT_WORDS, KEPT_RUNS = 80_000, 170_000
# Words that announce somebody else's speech.
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quoting quotes term word insult slur "
    "sagte schrieb nannte zitat zitiert wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split()
)

_WORD = re.compile(r"[^\W_]+(?:[*@$'’][^\W_]+)*")
_QUOTES = re.compile("[\"“”„«»]")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Lexicon:
    """A trie of terms; those marked open match every word that begins with them.

    below: whole words that begin so; they stand for that term.
    """

    def __init__(self, terms: Sequence[tuple[str, bool, float]], below: Sequence[str] = ()):
        # A node: children, then [term number, open] or None.
        self.terms, self.root = list(terms), ({}, [])
        self.below = frozenset(below)
        for number, (term, open_, _) in enumerate(self.terms):
            self._add(term, number, open_)
        for word, number in [(word, self.exact(word)) for word in below]:
            self._add(word, number, False)
        long = [t for t in (*(term for term, _, _ in self.terms), *below) if len(t) >= FUZZY_LENGTH]
        self.heads, self.tails = {t[:2] for t in long}, {t[2:5] for t in long}
        self.turned = {t[0] + t[2] + t[1] for t in long}

    def _add(self, term: str, number: int, open_: bool) -> None:
        node = self.root
        for letter in term:
            node = node[0].setdefault(letter, ({}, []))
        node[1].append((number, open_))

    def exact(self, word: str) -> int | None:
        """The term that the word is or begins with; the longest one."""
        node, best = self.root, None
        for at, letter in enumerate(word):
            node = node[0].get(letter)
            if node is None:
                break
            for number, open_ in node[1]:
                if open_ or at + 1 == len(word):
                    best = number
        return best

    def near(self, word: str) -> int | None:
        """A whole term one edit away from the word, or a beginning one edit away from how the word begins.

        Bit i of ``none`` (of ``one``) says that the path so far is the word's first i letters with no
        (with at most one) edit.
        """
        if len(word) < FUZZY_LENGTH - 1:
            return None
        letters: dict[str, int] = {}
        for at, letter in enumerate(word):
            letters[letter] = letters.get(letter, 0) | 1 << at
        full = (1 << len(word) + 1) - 1
        found, stack = [], [(self.root, 1, 3, 0)]
        while stack:
            (children, ends), none, one, depth = stack.pop()
            if depth >= FUZZY_LENGTH:
                found += [number for number, open_ in ends if open_ or one >> len(word) & 1]
            for letter, child in children.items():
                mask = letters.get(letter, 0)
                exact = (none & mask) << 1
                # A letter of the path may match, be added, stand for another, or one of the word be left out.
                edited = ((one & mask) << 1 | none | none << 1 | exact << 1 | exact) & full
                if edited:
                    stack.append((child, exact, edited, depth + 1))
        return min(found) if found else None

    def swapped(self, word: str) -> int | None:
        """A term that the word is or begins with once two neighbouring letters change places."""
        if len(word) < FUZZY_LENGTH:
            return None
        words = (word[:at] + word[at + 1] + word[at] + word[at + 2 :] for at in range(len(word) - 1))
        found = [(w, n) for w in words if (n := self.exact(w)) is not None]
        return min((n for w, n in found if w in self.below or len(self.terms[n][0]) >= FUZZY_LENGTH), default=None)

    def possible(self, word: str) -> bool:
        """Whether the word can be a misspelling.

        An edit beyond a term's first two letters leaves these in place. One within them leaves the next three, at
        most one place further on or back. The swap of the second and the third letter shows in the first three.
        """
        return (
            word[:2] in self.heads
            or word[2:5] in self.tails
            or word[1:4] in self.tails
            or word[3:6] in self.tails
            or word[:3] in self.turned
        )

    def misspelled(self, word: str) -> int | None:
        """The term that the word, none itself, is a misspelling of."""
        if not self.possible(word):
            return None
        return min((n for n in (self.near(word), self.swapped(word)) if n is not None), default=None)


@dataclass(frozen=True)
class Model:
    """terms: (term, open, weight); known: words of clean texts that are one edit from a term; below: see Lexicon."""

    terms: tuple[tuple[str, bool, float], ...] = ()
    known: frozenset[str] = frozenset()
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    below: tuple[str, ...] = ()

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features(self.terms, self.known, text, self.below)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


class _Matcher(dict):
    """Word -> (term, misspelled) or None, remembered; words that cost an automaton's run for longer than others."""

    def __init__(self, lexicon: Lexicon, known: frozenset[str]):
        super().__init__()
        self.lexicon, self.known = lexicon, known

    def __missing__(self, word: str):
        number, kept = self.lexicon.exact(word), KEPT_WORDS
        found = (number, False) if number is not None else None
        if found is None and word not in self.known and self.lexicon.possible(word):
            number, kept = self.lexicon.misspelled(word), KEPT_RUNS
            found = (number, True) if number is not None else None
        if len(self) < kept:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _matcher(terms: tuple[tuple[str, bool, float], ...], known: frozenset[str], below: tuple[str, ...]) -> _Matcher:
    return _Matcher(Lexicon(terms, below), known)


def finds(
    terms, known: frozenset[str], text: str | None, below: tuple[str, ...] = ()
) -> tuple[int, list[tuple[str, int, int, float]]]:
    """Number of words, and (term, start, end, what it counts) of all finds in the text in lower case."""
    lowered = (text or "").lower()
    matcher = _matcher(terms, known, below)
    words = _WORD.findall(lowered)
    found = [(at, hit) for at, hit in enumerate(map(matcher.__getitem__, words)) if hit]
    if not found:
        return len(words), []
    spans, out = [m.span() for m in _WORD.finditer(lowered)], []
    for at, (number, misspelled) in found:
        start, end = spans[at]
        line_end = lowered.find("\n", end)
        before = len(_QUOTES.findall(lowered, lowered.rfind("\n", 0, start) + 1, start))
        after = _QUOTES.search(lowered, end, line_end if line_end >= 0 else len(lowered))
        quoted = (before % 2 == 1 and after) or not REPORTING.isdisjoint(words[max(0, at - WINDOW) : at])
        out.append((number, start, end, (QUOTED if quoted else 1.0) * (MISSPELLED if misspelled else 1.0)))
    return len(words), out


def features(terms, known: frozenset[str], text: str | None, below: tuple[str, ...] = ()) -> list[float]:
    """How many finds, the heaviest, their share of the words, how many terms."""
    n_words, found = finds(terms, known, text, below)
    if not found:
        return [0.0] * 4
    total = sum(counts for *_, counts in found)
    by_term: dict[int, float] = {}
    for number, _, _, counts in found:
        by_term[number] = max(counts, by_term.get(number, 0.0))
    heaviest = max(terms[number][2] * counts for number, counts in by_term.items())
    return [math.log1p(total), heaviest, math.sqrt(total / n_words), math.log1p(sum(by_term.values()))]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) rows for the fit; share of each class's labels that was drawn.

    Copies and nearly all near copies count once: of rows with the same label and either of two min-hashes of
    three-word shingles the same, one is kept. Else the words of a text that was copied often would look like terms.
    """
    marked = (
        labels.filter("toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
        .withColumn("toxic", (F.col("toxic") == 1).cast("int"))
    )
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {c: min(1.0, FIT_ROWS / n) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))
    limit = F.when(F.col("toxic") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0)) * 1_000_000

    @F.pandas_udf("first long, second long")
    def mark(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_marks(t) for t in texts], columns=["first", "second"], dtype="int64")

    texts = docs.select("doc_id", "text")
    # Both sides that are broadcast hold some FIT_ROWS ids of each class.
    drawn = texts.join(F.broadcast(marked.filter(draw < limit)), "doc_id")
    marked_rows = drawn.select("toxic", "doc_id", mark("text").alias("mark")).select("toxic", "doc_id", "mark.*")
    one = marked_rows.groupBy("first", "toxic").agg(F.min(F.struct("doc_id", "second")).alias("kept")).select("toxic", "kept.*")
    one = one.groupBy("second", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return texts.join(F.broadcast(one.select("doc_id", "toxic")), "doc_id").select("text", "toxic"), shares


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _marks(text: str | None) -> tuple[int, int]:
    """Two min-hashes of three words in a row (of all words, if fewer), as signed numbers."""
    words = words_of(text)
    hashes = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    width = min(3, len(words))
    total = np.full(max(1, len(words) - 2), width, np.uint64)
    for at in range(width):
        total = _spread(total ^ hashes[at : at + len(total)])
    first, second = total.min(), _spread(~total).min()
    return int(first) - 2**63, int(second) - 2**63


def _spread(x: np.ndarray) -> np.ndarray:
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, toxic_texts, clean_texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found[toxic].update(set(words_of(text)))
        rows = [(w, found[1][w], found[0][w]) for w in found[0].keys() | found[1].keys()]
        yield pd.DataFrame(rows, columns=["word", "toxic_texts", "clean_texts"], dtype=object)

    counted = sample.mapInPandas(count, "word string, toxic_texts long, clean_texts long")
    return counted.groupBy("word").agg(F.sum("toxic_texts").alias("toxic_texts"), F.sum("clean_texts").alias("clean_texts"))


def _term_counts(sample: DataFrame, candidates: frozenset[tuple[str, bool]]) -> dict[tuple[str, bool], list[int]]:
    """Candidate -> how many clean and how many toxic texts hold it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(words_of(text))
                held = {(w, False) for w in words}
                held.update((w[:n], True) for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
                found.update((*term, toxic) for term in held & candidates)
        rows = [(*key, n) for key, n in found.items()]
        yield pd.DataFrame(rows, columns=["term", "open", "toxic", "n"], dtype=object)

    counted = sample.mapInPandas(count, "term string, open boolean, toxic int, n long")
    out = {term: [0, 0] for term in candidates}
    for r in counted.groupBy("term", "open", "toxic").agg(F.sum("n").alias("n")).collect():
        out[r["term"], r["open"]][r["toxic"]] = r["n"]
    return out


def _lexicon(
    words: DataFrame, sample: DataFrame, n_toxic: float, n_clean: float
) -> tuple[tuple[tuple[str, bool, float], ...], tuple[str, ...]]:
    """The terms, and the frequent whole words that begin with an open one."""
    least = max(3, min(MIN_TEXTS, int(n_toxic / 10)))
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.char_length("word")))
    begun = words.filter(F.char_length("word") >= SHORTEST).select(
        F.explode(F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("term"),
        "toxic_texts",
        "clean_texts",
    )
    sums = (F.sum("toxic_texts").alias("toxic"), F.sum("clean_texts").alias("clean"), F.count(F.lit(1)).alias("words"))
    open_ = begun.groupBy("term").agg(*sums).withColumn("open", F.lit(True))
    whole = words.filter(F.char_length("word") >= SHORTEST).select(
        F.col("word").alias("term"), F.col("toxic_texts").alias("toxic"), F.col("clean_texts").alias("clean"),
        F.lit(1).cast("long").alias("words"), F.lit(False).alias("open"),
    )
    ratio = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    rows = (
        open_.unionByName(whole)
        .filter((F.col("toxic") >= least) & (ratio >= MIN_RATIO))
        .collect()
    )
    n_words = {(r["term"], r["open"]): r["words"] for r in rows}
    texts = {
        term: (toxic, clean)
        for term, (clean, toxic) in _term_counts(sample, frozenset(n_words)).items()
        if toxic >= least and (toxic / n_toxic) >= MIN_RATIO * (clean + 0.5) / n_clean
    }

    def weight(term: tuple[str, bool]) -> float:
        toxic, clean = texts[term]
        return math.log((toxic + 0.5) / n_toxic) - math.log((clean + 0.5) / n_clean)

    # The longest form of a beginning that still covers its texts.
    covered = {
        term[:-1]
        for term, open_ in texts
        if open_ and (term[:-1], True) in texts and texts[term, True][0] >= 0.95 * texts[term[:-1], True][0]
    }
    chosen: dict[str, tuple[str, bool, float]] = {}
    for term, open_ in sorted(texts, key=lambda t: (not t[1], len(t[0]), t[0])):
        if open_ and (n_words[term, True] < MIN_WORDS or term in covered):
            continue
        if not any(chosen.get(term[:n], ("", False))[1] for n in range(SHORTEST, len(term) + 1)):
            chosen[term] = (term, open_, weight((term, open_)))
    terms = tuple(sorted(chosen.values(), key=lambda t: (-t[2], t[0])))[:MAX_TERMS]
    lexicon = Lexicon(terms)
    below = (w for w, open_ in texts if not open_ and w not in chosen and len(w) >= FUZZY_LENGTH)
    return terms, tuple(sorted(w for w in below if lexicon.exact(w) is not None))


def _fit(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty; no weight below 0, since every find speaks for toxicity."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    active = np.ones(len(w), bool)
    for _ in range(8):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            penalty = np.r_[1e-6, np.full(len(w) - 1, 1.0)]
            gradient = x.T @ (sample_weight * (p - y)) + penalty * w
            hessian = (x * (sample_weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            step = np.zeros(len(w))
            step[active] = np.linalg.solve(hessian[np.ix_(active, active)], gradient[active])
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        below = active & (w < 0)
        below[0] = False
        if not below.any():
            return w
        active &= ~below
        w[below] = 0
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and weights from the labelled rows that are not held out."""
    sample, shares = _sample(docs, labels)
    sample = written(spark, sample)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(bias=40.0 if 1 in sizes else -40.0)
    words = written(spark, _word_counts(sample))
    terms, below = _lexicon(words, sample, sizes[1], sizes[0])
    known = _known(words, terms, below)
    found = _with_features(sample, F.col("text"), terms, known, below)
    # Equal rows of features are summed before they come to the driver: at most FIT_ROWS of each class.
    table = found.groupBy("toxic", "_features").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([r["_features"] for r in table], float)
    y = np.array([r["toxic"] for r in table], float)
    n = np.array([r["n"] / shares[r["toxic"]] for r in table], float)
    w = _fit(x, y, n)
    return Model(terms, known, tuple(map(float, w[1:])), float(w[0]), below)


def _known(words: DataFrame, terms, below: tuple[str, ...]) -> frozenset[str]:
    """The words of clean texts that would be misspellings: at most those of the sample's texts."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms, below)
        for batch in batches:
            yield pd.Series([lexicon.exact(w) is None and lexicon.misspelled(w) is not None for w in batch], dtype=bool)

    lengths = [len(term) for term in (*(term for term, _, _ in terms), *below) if len(term) >= FUZZY_LENGTH]
    if not lengths:
        return frozenset()
    possible = F.char_length("word") >= min(lengths) - 1
    if not any(open_ for term, open_, _ in terms if len(term) >= FUZZY_LENGTH):
        possible &= F.char_length("word") <= max(lengths) + 1
    candidates = words.filter((F.col("clean_texts") > 0) & possible)
    return frozenset(r["word"] for r in candidates.filter(near("word")).select("word").collect())


def _with_features(df: DataFrame, text: Column, terms, known: frozenset[str], below: tuple[str, ...]) -> DataFrame:
    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([features(terms, known, t, below) for t in texts], dtype=object)

    return df.withColumn("_features", found(text))


def toxicity_score(model: Model, text: Column) -> Column:
    """Column: the score of each whole text, between 0 and 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored(text)


def score_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(spark, docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score THRESHOLD or more."""
    return docs.filter(toxicity_score(fit(spark, docs, labels), F.col("text")) < THRESHOLD)
