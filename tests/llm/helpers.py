"""Tables for the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A column of a user's own, named like something that operators make.
CLASHING = DOCS + ", size long, keep_id string, score string, `_row` long, `a.b` string"


def docs(spark, rows, schema=DOCS, path=None):
    """(doc_id, text[, source]) as a documents table, read from files if a path is given."""
    full = [
        (i, text, "en", source[0] if source else "s", None if text is None else len(text)) for i, text, *source in rows
    ]
    if schema == CLASHING:
        full = [(*row, 1, "x", "y", 7, "z") for row in full]
    frame = spark.createDataFrame(full, schema)
    if path is None:
        return frame
    frame.repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def prose(seed: int, words: int, vocabulary: int = 5_000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


#: Null and empty texts, null ids, blanks only, repeated rows, one very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"),
    (5, "A b c"), (6, "word " * 60_000), (7, "é ß 漢字 　 😀"), (8, "\x00\x1f<s>&lt;</s>"),
]


def tuples(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
