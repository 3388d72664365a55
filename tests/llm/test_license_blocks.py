import pytest
from helpers import docs

from twinledger.llm import license_scan as lic


def labels(spark, text, templates=lic.TEMPLATES):
    return lic.scan(docs(spark, [(1, text)]), {}, templates).head()["labels"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Licensed under the Apache License, Version 2.0; also released under the MIT License", "apache-2.0,mit"),
        ("Released under the MIT License, dedicated to the public domain under CC0", "cc0-1.0,mit"),
        ("Licensed under the GNU General Public License, version 3", "gpl-2.0,gpl-3.0,lgpl"),
    ],
)
def test_all_notices_of_a_block(spark, text, expected):
    assert labels(spark, text) == expected


def test_a_notice_beside_a_longer_one(spark):
    found = labels(spark, "Text: Licensed under CC BY 4.0.\nImages: Licensed under CC BY-SA 4.0.")
    assert {"cc-by-4.0", "cc-by-sa-4.0"} <= set(found.split(","))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("licensed under the GNU\nGeneral Public License, version 3", "gpl-2.0,gpl-3.0,lgpl"),
        ("Released under the\nMIT License", "mit"),
        ("x " * 10 + "licensed under the GNU General Public License, version 3", "gpl-2.0,gpl-3.0,lgpl"),
        ("a\nb c\n" * 7 + "licensed\nunder the GNU General Public\nLicense, version\n3" + " y" * 30, "gpl-2.0,gpl-3.0,lgpl"),
    ],
)
def test_notices_over_line_ends(spark, text, expected):
    assert labels(spark, text) == expected


def test_notices_at_any_place():
    words = lic.words_of(b"licensed under the gnu general public license version 3")
    index = lic.TemplateIndex(lic._template_sets(lic.TEMPLATES), {}, lic.CONTAINMENT)
    for before in range(60):
        for cut in range(1, len(words)):
            lines = [[b"x"] * before, words[:cut], words[cut:], [b"y"] * 40]
            assert index.in_text(lines)["gpl-3.0"] == 1.0


def test_long_template(spark):
    licence = [f"w{i % 300}" for i in range(900)]
    text = "\n".join(" ".join(licence[at : at + 12]) for at in range(0, 900, 12))
    assert labels(spark, "other " * 77 + text, {" ".join(licence): "long"}) == "long"
    assert labels(spark, "other " * 77 + text[:300], {" ".join(licence): "long"}) == ""
