import random
import re

import pytest
from helpers import CLASHING, ODD, docs, tuples

from twinledger.llm import license_scan as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(i, text):
    w = words(text)
    places = [
        (at, label)
        for phrase, label in lic.PHRASES.items()
        for at in range(len(w))
        if w[at : at + len(phrase.split())] == phrase.split()
    ]
    met = {label: 1.0 for _, label in places}
    base = sorted(met)
    blocks = {template: [] for template in lic.TEMPLATES}
    for line in (text or "").split("\n"):
        line = words(line)
        starts = range(0, len(line) - 32, 32) if len(line) > 64 else [0]
        for found in blocks.values():
            found += [line[at : at + 64] for at in starts]
    for template, label in lic.TEMPLATES.items():
        length, t = len(words(template)), set(words(template))
        blocks[template] += [w[at : at + 2 * length] for at in range(0, len(w), length)]
        share = max(len(t.intersection(block)) / len(t) for block in blocks[template])
        if share >= lic.CONTAINMENT:
            met[label] = max(share, met.get(label, 0))
    starts = [at for at, _ in places]
    return (i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted(met)), max(met.values(), default=0.0))


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def corpus():
    rng, rows = random.Random(4), []
    pool = sorted({w for t in lic.TEMPLATES for w in t.split()}) + ["cc", "by", "all", "rights", "reserved", "zé", "x9"]
    for i in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([3, 9, 40, 150])))
        notice = rng.choice([*lic.TEMPLATES, *lic.PHRASES]).split()
        if rng.random() < 0.7:
            notice.pop(rng.randrange(len(notice)))
        rows.append((i, f"{text}\n{', '.join(notice).upper()}.\n{text[:40]}-{rng.choice(['CC  BY', 'cc-by', 'İ K'])}"))
    return rows


def test_against_brute_force(spark):
    rows = corpus() + ODD
    assert tuples(lic.scan(docs(spark, rows)), *COLUMNS) == sorted((brute(*r) for r in rows), key=repr)


def test_clashing_columns_and_no_rows(spark):
    assert tuples(lic.scan(docs(spark, ODD, CLASHING)), *COLUMNS) == sorted((brute(*r) for r in ODD), key=repr)
    assert lic.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "base", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-4.0,cc-by-nc-4.0,cc-by-sa-4.0"),
        ("Licensed under the GNU General Public License, version 3", "gpl", "gpl,gpl-2.0,gpl-3.0,lgpl"),
        ("Released under the MIT License.", "", "mit"),
        ("the license was released", "", ""),
        ("All rights\nreserved.", "reserved", "reserved"),
        ("CC BY cc by CC BY", "cc-by", "cc-by"),
    ],
)
def test_notices(spark, text, base, labels):
    row = lic.scan(docs(spark, [(1, text)])).head()
    assert (row["base_labels"], row["labels"]) == (base, labels)


def test_other_templates_and_none(spark):
    frame = docs(spark, [(1, "do what you want")])
    assert lic.scan(frame, {}, {"Do what you want!": "free"}).head()["labels"] == "free"
    assert lic.scan(frame, {}, {}).head()["labels"] == ""
    with pytest.raises(ValueError):
        lic.scan(frame, {}, {" ".join(f"w{i}" for i in range(200_001)): "long"})
