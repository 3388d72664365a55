import random

import pytest
from helpers import docs, prose

from twinledger.llm import toxicity as tox

TERMS = (("idiot", True, 8.0), ("scumbag", False, 7.0), ("zaku", True, 6.0))
BELOW = ("zakuran",)


def found(text, known=frozenset()):
    return [(text[a:b], TERMS[n][0], c) for n, a, b, c in tox.finds(TERMS, known, text, BELOW)[1]]


@pytest.mark.parametrize("word", ["idi0t", "idot", "idoit", "iidiotic", "idi0tically", "idoits", "diiots"])
def test_misspelled_beginnings(word):
    assert found(word) == [(word, "idiot", tox.MISSPELLED)]
    assert found(word, frozenset([word])) == []


def test_swapped_letters_of_whole_terms_and_words_below_a_beginning():
    assert found("scmubag zaukran idiotic zakuran zkuran") == [
        ("scmubag", "scumbag", tox.MISSPELLED), ("zaukran", "zaku", tox.MISSPELLED), ("idiotic", "idiot", 1.0),
        ("zakuran", "zaku", 1.0), ("zkuran", "zaku", tox.MISSPELLED),
    ]
    assert found("scmubags idea ido radiot") == []


def test_learnt_beginnings_find_misspellings(spark):
    rng, rows, labels = random.Random(5), [], []
    forms = ["idiot", "idiots", "idiotic", "idiotically", "idiotism"]
    for i in range(800):
        words = prose(i, 40, 500)
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(forms)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = tox.fit(spark, docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(open_ for _, open_, _ in model.terms)
    clean = model.score("w1 w2 w3 w4 w5 w6")
    for word in ("idi0t", "idot", "idoit", "idi0tically"):
        assert model.score(f"w1 w2 w3 {word} w4 w5") > max(clean, tox.THRESHOLD)
