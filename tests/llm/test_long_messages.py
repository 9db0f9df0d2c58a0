"""Quotation linking of very long messages."""

from shelfwise.llm import quotations


def test_many_lines_of_changing_levels(spark):
    lines = [("> " if i % 2 else "") + f"line {i}" for i in range(6000)]
    rows = [(1, 1, "user", "line 3\nand more"), (1, 2, "bot", "\n".join(lines)), (2, 1, "user", "\n".join(["same"] * 6000)), (3, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotations.conversations(df).collect()}
    long = got[1, 2]
    assert long.n_quotes == 3000 and long.parent_turn == 1 and long.depth == 1
    assert long.text == "\n".join(lines[::2])
    assert got[2, 1].n_quotes == 0 and got[2, 1].text == "\n".join(["same"] * 6000)
    assert got[3, 1].text == "" and got[3, 1].parent_turn is None


def test_texts_are_parsed_once(spark):
    df = spark.createDataFrame([(1, 1, "user", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = quotations.parsed_messages(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
