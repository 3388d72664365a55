import math
import random
import zlib

import pytest
from helpers import CLASHING, ODD, docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinledger.llm import toxicity as tox

LABELS = "doc_id long, quality int, toxic int, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=6, unique=True), st.text("abcd", max_size=9))
def test_automaton_finds_what_one_edit_gives(terms, word):
    found = tox.Lexicon([(t, False, 1.0) for t in terms]).near(word)
    near = [n for n, t in enumerate(terms) if distance(t, word) <= 1 and len(word) >= 4]
    assert found == min(near, default=None)


def plain_exact(terms, below, word):
    """The longest term that the word is or begins with, a whole word below one standing for it."""
    fits = [(len(t), n) for n, (t, open_, _) in enumerate(terms) if word == t or open_ and word.startswith(t)]
    return max(fits)[1] if fits else None


def plain_misspelled(terms, below, word):
    whole = [(t, n) for n, (t, open_, _) in enumerate(terms) if not open_] + [(b, plain_exact(terms, (), b)) for b in below]
    begun = [(t, n) for n, (t, open_, _) in enumerate(terms) if open_]
    found = []
    if len(word) >= 4:
        found += [n for t, n in whole if len(t) >= 5 and distance(t, word) <= 1]
        found += [n for t, n in begun if len(t) >= 5 and any(distance(t, word[:i]) <= 1 for i in range(len(word) + 1))]
    for at in range(len(word) - 1 if len(word) >= 5 else 0):
        turned = word[:at] + word[at + 1] + word[at] + word[at + 2 :]
        n = plain_exact(terms, below, turned)
        if n is not None and (turned in below or len(terms[n][0]) >= 5):
            found.append(n)
    return min(found, default=None)


@settings(max_examples=400, deadline=None)
@given(
    st.dictionaries(st.text("abc", min_size=3, max_size=7), st.booleans(), min_size=1, max_size=5),
    st.lists(st.text("abc", min_size=2, max_size=9), max_size=6),
    st.text("abcd", max_size=10),
)
def test_misspellings_against_every_edit(marked, words, word):
    """What is not run through the automaton is no misspelling of anything."""
    terms = [(t, open_, 1.0) for t, open_ in marked.items()]
    below = {w for w in words if len(w) >= 5 and w not in marked and plain_exact(terms, (), w) is not None}
    lexicon = tox.Lexicon(terms, tuple(sorted(below)))
    assert lexicon.exact(word) == plain_exact(terms, below, word)
    assert lexicon.misspelled(word) == plain_misspelled(terms, below, word)


def test_open_terms_match_their_continuations():
    lexicon = tox.Lexicon([("lowe", True, 1.0), ("lowest", False, 1.0), ("idiot", False, 1.0)])
    assert [lexicon.exact(w) for w in ("low", "lowe", "lowering", "lowest", "idiot", "idiots")] == [None, 0, 0, 1, 2, None]


TERMS = (("idiot", False, 8.0), ("zaku", True, 7.0))


def counts(text, known=frozenset()):
    return [(text[a:b], n) for _, a, b, n in tox.finds(TERMS, known, text)[1]]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("you idiot", [("idiot", 1.0)]),
        ('"you idiot" is an insult', [("idiot", tox.QUOTED)]),
        ('stray " idiot', [("idiot", 1.0)]),
        ("she said idiot", [("idiot", tox.QUOTED)]),
        ("she said it\nand you there are an idiot", [("idiot", 1.0)]),
        ("idi0t idiott idot", [("idi0t", tox.MISSPELLED), ("idiott", tox.MISSPELLED), ("idot", tox.MISSPELLED)]),
        ("zakuran", [("zakuran", 1.0)]),
        ("", []),
        (None, []),
    ],
)
def test_context(text, expected):
    assert counts(text) == expected


def test_known_words_are_no_misspellings():
    assert counts("idiom", frozenset(["idiom"])) == []
    assert counts("idiom") == [("idiom", tox.MISSPELLED)]


def corpus(n=1_500):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = prose(i, rng.choice([10, 60, 200]), 2_000)
        toxic = i % 8 == 0
        for _ in range(rng.choice([1, 3, 6]) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot!", "scumbag", f"zaku{rng.randrange(90)}x"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    found = tox.score_report(spark, docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) >= 0.99 * len(held)


def plain_score(model, text):
    """The score by the definitions: every word against every term, quotation marks counted line by line."""
    total, by_term, n_words = 0.0, {}, 0
    before = []
    for line in (text or "").lower().split("\n"):
        for m in tox._WORD.finditer(line):
            word, n_words = m.group(), n_words + 1
            number = plain_exact(model.terms, model.below, word)
            counts = 1.0
            if number is None and word not in model.known:
                number, counts = plain_misspelled(model.terms, model.below, word), tox.MISSPELLED
            if number is not None:
                left, right = (sum(c in "\"“”„«»" for c in part) for part in (line[: m.start()], line[m.end() :]))
                if left % 2 and right or any(w in tox.REPORTING for w in before[-tox.WINDOW :]):
                    counts *= tox.QUOTED
                total += counts
                by_term[number] = max(by_term.get(number, 0.0), counts)
            before.append(word)
    x = [0.0] * 4
    if by_term:
        heaviest = max(model.terms[n][2] * c for n, c in by_term.items())
        x = [math.log1p(total), heaviest, math.sqrt(total / n_words), math.log1p(sum(by_term.values()))]
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, model.bias + sum(w * v for w, v in zip(model.weights, x))))))


def test_scores_against_brute_force(spark):
    rows, labels = corpus(600)
    labels = spark.createDataFrame(labels, LABELS)
    rows += [
        (10_001, 'he said "idiot"\nidoit and scumbga, "zaku7x'), (10_002, "scumbag idi0t zakku9x idiott"),
        (10_003, "„Idiot“ schrieb er\nzzaku"), *ODD,
    ]
    frame = docs(spark, rows)
    model = tox.fit(spark, frame, labels)
    found = sorted((repr(r["text"]), r["score"]) for r in frame.select("text", tox.toxicity_score(model, F.col("text")).alias("score")).collect())
    expected = sorted((repr(text), plain_score(model, text)) for _, text in rows)
    assert [t for t, _ in found] == [t for t, _ in expected]
    assert [s for _, s in found] == pytest.approx([s for _, s in expected])


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(600)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, q, t, x in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in tox.score_report(spark, docs(spark, rows), spark.createDataFrame(ls, LABELS)).collect()}
        for ls in (labels, flipped)
    ]
    assert scores[0] == pytest.approx(scores[1])


def test_odd_rows_labels_and_clashing_columns(spark, tmp_path):
    rows, labels = corpus(400)
    odd = [(None, 1, 1, "x"), (5, 1, None, "x"), (6, 1, 1, "x"), (6, 0, 0, "x"), (10**9, 1, 1, "x")]
    frame = docs(spark, rows + ODD, CLASHING, tmp_path / "d")
    table = spark.createDataFrame(labels + odd, LABELS)
    found = tox.score_report(spark, frame, table).collect()
    assert len(found) == len(rows) + len(ODD)
    nothing = {r["score"] for r in found if r["doc_id"] in (9_999, None)}
    assert all(s < 0.3 for s in nothing)
    kept = tox.drop_toxic(spark, frame, table)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not r["predicted"] for r in found)


@pytest.mark.parametrize(("toxic", "expected"), [([], 0), ([0, 0, 0], 0), ([1] * 12, 1)])
def test_labels_of_one_class_or_none(spark, toxic, expected):
    rows = [(i, f"text number {i}") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(toxic)], LABELS)
    found = tox.score_report(spark, docs(spark, rows), labels).collect()
    assert {r["predicted"] for r in found} == {expected} and len(found) == 20
    assert tox.score_report(spark, docs(spark, []), labels).count() == 0


def test_copies_teach_nothing(spark):
    """The words of one toxic text that was copied often are no terms."""
    rows, labels = corpus()
    copied = " ".join(["idiot"] + [f"only{i}" for i in range(30)])
    rows += [(10_000 + i, f"{copied} n{i}") for i in range(200)]
    labels += [(10_000 + i, 1, 1, "x") for i in range(200)]
    model = tox.fit(spark, docs(spark, rows), spark.createDataFrame(labels, LABELS))
    assert {t for t, _, _ in model.terms} == {"idiot", "scumbag", "zaku"}
