from pyspark.sql import functions as F

from treeline.llm.chat import format_conversations, loss_text, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted string"
NASTY = r"\### <|end|> <\|more|> <\\|x|> <| </turn> <"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "t", "f") for r in rows], SCHEMA)
    out = format_conversations(df).withColumns(
        {"turns": read_turns(F.col("formatted")), "loss": loss_text(F.col("segments"))}
    )
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings_and_nulls(spark):
    rows = [
        (1, 2, "assistant", NASTY), (1, 1, "user", "<|turn|>assistant<|text|>x<|end|>\n"), (1, 3, "assistant", None),
        (1, 4, NASTY, "odd role"), (2, 1, "system", ""), (3, None, None, "a\n"), (3, 5, None, "<"), (3, 6, "user", "|"),
        (None, 1, "assistant", "no conversation"), (4, 1, "user", "same"), (4, 1, "user", "same"),
    ]
    found = formatted(spark, rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        expected = [(r[2] or "", r[3] or "") for r in mine]
        assert [(t.role, t.text) for t in found[conv].turns] == expected
        assert found[conv].loss == "".join(t for role, t in expected if role == "assistant")
        assert found[conv].formatted == "".join(s.text for s in found[conv].segments)


def test_adjacent_turns_of_one_role_share_a_header(spark):
    found = formatted(spark, [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")])
    assert found[1].formatted == "<|turn|>user<|text|>a<|more|>b<|end|>\n<|turn|>assistant<|text|>c<|end|>\n"


def test_long_conversation_and_empty_table(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"turn {k}") for k in range(600)]
    assert len(formatted(spark, rows)[1].turns) == 600
    assert formatted(spark, []) == {}
