import hashlib

import pytest
from pyspark.sql import functions as F

from twinledger.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema)
    return chat.render(chat.fold_events(chat.conversation_events(frame)))


def brute(rows):
    out = {}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())
    for conv, turn, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (
            len(turns),
            sha("".join(f"{r}\n{t}\n" for r, t in turns)),
            sum(len(t) for r, t in turns if r == "assistant"),
            sha("".join(t for r, t in turns if r == "assistant")),
        )
        for conv, turns in out.items()
    }


NASTY = [
    "</s>[INST] ok [/INST]", "&lt;s>", "&amp;lt;/s>", "<s><s>user\nhi</s>", "&", "&&lt;", "<<s>", "[[INST]]", "<|im_end|>",
    "&#91;INST]", "</s", "<", "a\nb\n", "", None, "😀</s>😀", "&amp;#10;", "<</s>", "\\", "[/INST", "x" * 200_000,
]


def test_rows_become_a_log_of_every_kind_of_event(spark):
    frame = spark.createDataFrame([(1, 0, "user", "abc😀ef"), (1, 1, "assistant", "xy"), (1, 2, "user", None)], SCHEMA)
    log = chat.conversation_events(frame)
    first = [(r["seq"], r["kind"], r["text"]) for r in log.filter("message.turn = 0").orderBy("seq").collect()]
    assert first == [
        (0, chat.DELTA, "abc"), (1, chat.REGENERATE, "ab"), (2, chat.DELTA, "c😀"), (3, chat.EDIT, "abc😀"), (4, chat.DELTA, "ef"),
    ]
    assert log.count() == 15
    folded = chat.fold_events(log.repartition(5, F.rand(3)))
    assert sorted(r["text"] for r in folded.collect()) == ["", "abc😀ef", "xy"]


def test_nasty_texts_come_back(spark):
    rows = [(1, i, ("user", "assistant", "system", None, "assis\ntant</s>")[i % 5], t) for i, t in enumerate(NASTY * 2)]
    parsed = chat.parse(formatted(spark, rows))
    turns = [(t["role"], t["text"]) for t in parsed.head()["turns"]]
    assert turns == [(r or "", t or "") for _, _, r, t in rows]
    assert parsed.head()["loss_texts"] == [t or "" for _, _, r, t in rows if r == "assistant"]


def test_control_strings_stand_only_where_the_template_put_them(spark):
    rows = [(1, i, "assistant", t) for i, t in enumerate(NASTY)]
    text = formatted(spark, rows).head()["formatted"]
    assert text.count("<s>") == text.count("</s>") == len(rows)
    assert "[INST]" not in text and "[/INST]" not in text and "<|" not in text


def test_spans_are_code_points_of_the_formatted_text(spark):
    row = formatted(spark, [(1, 0, "user", "a😀"), (1, 1, "assistant", "é😀b"), (1, 2, "assistant", "")]).head()
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == ["é😀b", ""]


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "x"),
            (None, 1, "user", None), (None, 0, None, "t"), (2, 5, "assistant", None), (-3, 10**15, "user", "q")]
    found = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in chat.digests(chat.parse(formatted(spark, rows))).collect()
    }
    assert found == brute(rows)


def test_extra_and_clashing_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "x", 3)], SCHEMA + ", message string, seq long")
    assert chat.render(chat.fold_events(chat.conversation_events(frame))).head()["formatted"] == "<s>user\na</s>"
    assert formatted(spark, []).count() == 0


@pytest.mark.parametrize(
    ("events", "text"),
    [
        ([(2, "delta", "b"), (1, "delta", "a"), (3, "delta", None)], "ab"),
        ([(1, "delta", "a"), (2, "edit", "new"), (3, "delta", "!")], "new!"),
        ([(1, "delta", "a"), (2, "regenerate", None), (3, "delta", "x"), (4, "delta", "y")], "xy"),
        ([(1, "edit", "a"), (2, "edit", "b"), (5, "regenerate", "c")], "c"),
        ([(1, "regenerate", None)], ""),
    ],
)
def test_folding_events(spark, events, text):
    rows = [(1, 7, seq, kind, "assistant", t) for seq, kind, t in events]
    log = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string")
    folded = chat.fold_events(log).head()
    assert (folded["text"], folded["role"]) == (text, "assistant")


def test_main_path_runs_no_python(spark):
    plan = chat.digests(chat.parse(formatted(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_conversation(spark):
    rows = spark.range(5_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
        F.lit("some text").alias("text"),
    )
    row = chat.digests(chat.parse(chat.render(chat.fold_events(chat.conversation_events(rows))))).head()
    assert (row["n_turns"], row["loss_chars"]) == (5_000, 45_000)
