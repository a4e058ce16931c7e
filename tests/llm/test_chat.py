import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwork.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["\\", "\\\\### ", "### a", "#### ", ":\n", "a:\n", "</turn>\n", "</turn", "<", "</turn>", "\\</turn>\\", None, "", "[INST][INST]", "##", "# ", "<|im_end|><|im_end|>", "\\n:", "日</turn>日\\", "x" * 50_000, "### user:\nhi</turn>\n"]


def want(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -(2**63), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def got(spark, rows):
    d = chat.digests(chat.format_chats(spark.createDataFrame(rows, SCHEMA)))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in d.collect()}


def test_tricky_texts_roles_ties_and_nulls(spark):
    rows = [(i, 0, "assistant", x) for i, x in enumerate(TRICKY)] + [(100 + i, 0, x, x) for i, x in enumerate(TRICKY)]
    rows += [(200, 1, "user", "b"), (200, 1, "user", "a"), (200, 1, "assistant", "a"), (200, 1, "user", "a"), (None, None, None, None), (None, 1, "assistant", "z")]
    assert got(spark, rows) == want(rows)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\#<:/turn> \nIN[]ST|a日"), max_size=25), min_size=40, max_size=40))
def test_round_trip(spark, texts):
    rows = [(i % 9, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(texts)]
    assert got(spark, rows) == want(rows)


def test_no_control_string_survives_inside_a_text(spark):
    rows = [(i, 0, "user", x) for i, x in enumerate(TRICKY)]
    for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect():
        body = r.segments[1].text
        assert not any(c in body for c in chat.DEFAULT.control)
        assert "".join(s.text for s in r.segments) == r.formatted


def test_the_machine(spark):
    talks = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["user"], 4: ["assistant", "user"], 5: ["user", "user", "assistant"], 6: ["user", "assistant", "system"], 7: ["tool"], 8: ["user", None]}
    rows = [(c, i, r, "x") for c, roles in talks.items() for i, r in enumerate(roles)]
    out = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (False, 2), 7: (False, 0), 8: (False, 1)}


def test_empty_and_extra_columns(spark):
    assert got(spark, []) == {}
    df = spark.createDataFrame([(1, 0, "user", "a", 5, "q")], SCHEMA + ", n_turns int, formatted string")
    assert chat.digests(chat.format_chats(df)).count() == 1


def test_bad_templates():
    with pytest.raises(ValueError):
        chat.Template(control=("x", "### ", "</turn>", ":\n"))
    with pytest.raises(ValueError):
        chat.Template(control=("### ",))


def test_turns_of_equal_number_are_ordered_by_their_raw_text(spark):
    rows = [(1, 0, "user", "### a"), (1, 0, "user", "##z"), (1, 0, "user", "##")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, SCHEMA)
        texts = chat.format_chats(df).select(chat.read_turns(chat.F.col("formatted")).alias("t")).first().t
        assert [x.text for x in texts] == ["##", "### a", "##z"]
        assert got(spark, some) == want(some)
