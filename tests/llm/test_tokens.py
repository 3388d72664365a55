import numpy as np
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinledger.llm import token_counts, tokens

PATH = tokens.default_path()
PUBLISHED = Tokenizer.from_file(PATH)
PUBLISHED.encode_special_tokens = True


def expected(text):
    return PUBLISHED.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sab1.")), max_size=80))
def test_ids_are_those_of_the_published_tokenizer(text):
    assert tokens.encode(PATH, text) == expected(text)


def test_odd_texts():
    for text in (None, "", " ", "<|endoftext|> a", "x" * 3000, " \n a\n\nb \n", "​zero ﻿b", "it's I'll 'a'"):
        assert tokens.encode(PATH, text) == expected(text)


def brute(lengths):
    n, total = len(lengths), sum(lengths)
    out = []
    for limit in sorted(set(lengths)):
        fit = [x for x in lengths if x <= limit]
        over = [x for x in lengths if x > limit]
        out.append(
            (limit, lengths.count(limit), len(fit), sum(fit), len(over), sum(over),
             sum(min(x, limit) for x in lengths), len(fit) / n)
        )
    assert not out or out[-1][3] == total
    return out


def context_rows(spark, rows):
    table = token_counts.context_table(token_counts.length_histogram(docs(spark, rows)))
    return sorted(tuple(r) for r in table.collect())


def test_context_table_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "LENGTHS_PER_GROUP", 3)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 40, 200))]
    rows += [(1, None), (1, None), (None, "")]
    assert context_rows(spark, rows) == brute([len(expected(t)) for _, t in rows])


def test_one_long_text_and_no_rows(spark):
    text = "some words " * 100_000
    assert context_rows(spark, [(1, text)]) == brute([len(expected(text))])
    assert context_rows(spark, []) == []
