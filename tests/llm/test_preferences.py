from pyspark.sql import functions as F

from tallyloom.llm.preferences import Template, conversations, format_pairs, spans_text, with_other_answer

PAIR = "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"


def test_prefix_masks_and_edges(spark):
    ask, yes, no = ("user", "Well?"), ("assistant", "Yes <|end|>"), ("assistant", "No")
    rows = [
        (1, [ask, yes], [ask, no]),
        (2, [ask, yes], [ask, yes]),
        (3, None, [ask]),
        (4, [ask, yes, ask, no], [ask, yes]),
        (5, [(None, None)], [("user", "")]),
        (6, [yes], [no]),
        (6, [yes], [no]),
    ]
    frame = spark.createDataFrame(rows, PAIR).selectExpr("*", "'old' as prompt", "1 as extra", "2 as p_a", "3 as p_row")
    found = {r["pair_id"]: r for r in format_pairs(frame).collect()}
    one = found[1]
    assert one["prompt"] == "<|user|>\nWell?<|end|>\n" and one["n_prompt_turns"] == 1 and one["extra"] == 1
    assert one["p_a"] == 2 and one["p_row"] == 3
    assert one["chosen_text"] == "<|assistant|>\nYes < |end|><|end|>\n"
    for side in ("chosen", "rejected"):
        (span,) = one[f"{side}_spans"]
        trained = one[f"{side}_text"][span["start"] : span["stop"]]
        assert trained == {"chosen": "Yes < |end|><|end|>", "rejected": "No<|end|>"}[side]
    assert not found[2]["usable"] and found[2]["chosen_text"] == ""
    assert found[3]["n_prompt_turns"] == 0 and not found[3]["usable"]
    assert found[4]["n_prompt_turns"] == 2 and found[4]["rejected_text"] == "" and len(found[4]["chosen_spans"]) == 1
    assert found[5]["n_prompt_turns"] == 1
    assert found[6]["prompt"] == "" and found[6]["usable"]
    assert format_pairs(frame.filter("pair_id = 6")).count() == 2
    assert format_pairs(frame.limit(0)).collect() == []


def test_conversations_and_pairs(spark):
    rows = [(4, 1, "assistant", "a"), (4, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "b"), (5, 2, "user", None)]
    rows += [(6, 0, "assistant", "alone"), (None, 0, "user", "x"), (8, None, None, None), (9, 0, "user", "no answer")]
    talks = conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert talks.count() == 5
    pairs = {r["pair_id"]: r for r in with_other_answer(talks).collect()}
    assert set(pairs) == {4, 5, 6, 8, 9}
    assert all(pairs[i]["rejected"] is None for i in (6, 8, 9))
    assert [t["text"] for t in pairs[6]["chosen"]] == ["alone"] and [t["text"] for t in pairs[9]["chosen"]] == ["no answer"]
    formatted = {r["pair_id"]: r for r in format_pairs(with_other_answer(talks)).collect()}
    assert formatted[6]["rejected_text"] == "" and not formatted[6]["usable"] and formatted[5]["usable"]
    assert [t["text"] for t in pairs[5]["chosen"]] == ["q", "b"]
    assert [t["text"] for t in pairs[5]["rejected"]] == ["q", "a"]


def test_spans_of_several_turns(spark):
    turns = [("assistant", "one"), ("user", "é🙂"), ("assistant", "two")]
    frame = spark.createDataFrame([(1, turns, [("user", "z")])], PAIR)
    t = Template(opening="[", opened="]", end=".", after="", mark="[", broken="(")
    row = format_pairs(frame, t).withColumn("s", spans_text(F.col("chosen_spans"))).first()
    text = row["chosen_text"]
    assert text == "[assistant]one.[user]é🙂.[assistant]two."
    assert [text[s["start"] : s["stop"]] for s in row["chosen_spans"]] == ["one.", "two."]
    assert row["s"] == ",".join(f"{s['start']}-{s['stop']}" for s in row["chosen_spans"])
