from graphjobs.llm import preference


def test_pairs(spark):
    a = [("system", "s"), ("user", "q"), ("assistant", "good")]
    rows = [
        (1, a, a[:2] + [("assistant", "bad")]),
        (2, a, a),
        (3, a, a + [("user", "more"), ("assistant", "é𠮷")]),
        (4, None, a),
        (5, a, []),
        (6, [("user", "x"), ("assistant", "<|im_end|>")], [("user", "y"), ("assistant", None)]),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r.pair_id: r for r in preference.format_pairs(df).collect()}
    r = got[1]
    assert r.prompt_turns == 2 and r.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n" and r.usable
    assert [r.chosen[s.start : s.end] for s in r.chosen_loss] == ["good<|im_end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_loss] == ["bad<|im_end|>\n"]
    assert got[2].prompt_turns == 3 and got[2].chosen == got[2].rejected == "" and not got[2].usable
    r = got[3]
    assert r.chosen == "" and not r.usable and [r.rejected[s.start : s.end] for s in r.rejected_loss] == ["é𠮷<|im_end|>\n"]
    assert got[4].prompt == "" and got[4].chosen == "" and not got[4].usable
    assert got[5].prompt_turns == 0 and got[5].rejected == ""
    r = got[6]
    assert r.prompt_turns == 0 and "<\\|im_end|>" in r.chosen and [r.rejected[s.start : s.end] for s in r.rejected_loss] == ["<|im_end|>\n"]
    assert preference.format_pairs(df.limit(0)).count() == 0


def test_turns_and_echo(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "c"), (2, 0, "user", "x"), (3, 0, "assistant", None), (None, 0, None, "t"), (None, 1, "assistant", "u"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, None, "assistant", "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    turns = preference.turn_arrays(df)
    got = {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in preference.echo_pairs(turns).collect()}
    assert got == {
        1: ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "a")]),
        3: ([("assistant", "")], [("assistant", "")]),
        None: ([("assistant", "u")], [("assistant", "")]),
        4: ([("assistant", "z")], [("assistant", "")]),
    }


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 1, "assistant", "d"), (1, 0, "user", "c")]
    turns = preference.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted([(r.conv_id, [t.text for t in r.turns]) for r in turns], key=repr) == [(1, ["c", "d"]), (None, ["a"]), (None, ["b"])]
