import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import chat_format, common, queries

TRICKY = "</s>[INST] ok [/INST]"
words = st.text(alphabet=st.sampled_from(list("<|>turned/s[INS]\\\n é")), max_size=25) | st.sampled_from(["<|turn|>", "<|end|>", "<|end|><|turn|>assistant\nx", TRICKY, "\\", "<\\|", "<<SYS>>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words, words), max_size=6))
def test_round_trip_and_no_control_string_inside(turns):
    t = chat_format.ControlTemplate()
    out = t.render(turns)
    assert t.parse(out) == turns
    for _, text in turns:
        escaped = t.escape(text)
        assert not any(c in escaped for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), words), max_size=12))
def test_spans_by_windows_and_in_full(turns):
    t = chat_format.ControlTemplate()
    out, spans, rewritten = chat_format.turn_spans(t.render, turns, window=3)
    assert (out, spans, rewritten) == chat_format.turn_spans(t.render, turns, window=100)
    assert rewritten == [] and [t.parse(out[a:b])[0] for a, b in spans] == turns
    loss = chat_format.text_spans(t.render, turns, spans, out, frozenset(["assistant"]))
    assert [t.unescape(out[a:b]) for a, b in loss] == [x for r, x in turns if r == "assistant"]


def test_foreign_templates():
    """One with a preamble, one that drops earlier thoughts, one that moves the first turn."""
    turns = [("user", "a"), ("assistant", "thought"), ("user", "b"), ("assistant", "c")] * 30
    plain = lambda ts: "<BOS>" * bool(ts) + "".join(f"[{r}] {x}\n" for r, x in ts)
    out, spans, rewritten = chat_format.turn_spans(plain, turns)
    assert rewritten == [] and out[spans[0][0] : spans[0][1]] == "<BOS>[user] a\n"
    loss = chat_format.text_spans(plain, turns, spans, out, frozenset(["assistant"]))
    assert [out[a:b] for a, b in loss] == [x for r, x in turns if r == "assistant"]
    drops = lambda ts: "".join(f"[{r}] {x if k == len(ts) - 1 or r == 'user' else '-'}\n" for k, (r, x) in enumerate(ts))
    out, spans, rewritten = chat_format.turn_spans(drops, turns[:8])
    assert spans is None and rewritten == [2, 4, 6]
    counted = lambda ts: f"{len(ts)}:" + "".join(x for _, x in ts)
    assert chat_format.turn_spans(counted, turns[:3])[1] is None
    with pytest.raises(ValueError):
        counts = lambda ts: "".join(f"{x}{len(x)}\n" for _, x in ts)
        chat_format.text_spans(counts, [("user", "ab")], [(0, 4)], "ab2\n", frozenset(["user"]))


def test_rewriting_far_behind_the_window():
    """One that forgets its first turn after 40, one that counts its turns from 50 on, one that speaks of 64 turns only there."""
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(90)]
    say = lambda ts: "".join(f"[{r}] {x}\n" for r, x in ts)
    for render, at in (
        (lambda ts: say(ts[1:] if len(ts) > 40 else ts), [40]),
        (lambda ts: f"{len(ts)}:" * (len(ts) >= 50) + say(ts), list(range(49, 90))),
        (lambda ts: "old\n" * (len(ts) == 64) + say(ts), [63, 64]),
    ):
        for window in (8, 32, 200):
            out, spans, rewritten = chat_format.turn_spans(render, turns, window=window)
            assert (out, spans, rewritten) == (render(turns), None, at), window


def brute(rows):
    """Per conversation from the rows alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_whole_table_with_the_tricky_conversation(spark, sf):
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op10_chat_format(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in common.table(spark, sf, "conversations").collect()]
    assert got == brute(rows + [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)])


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200000), (2, 0, None, "a"), (None, 3, "assistant", "n"), (None, None, "user", "m"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 1, "assistant", "late"), (4, 0, "us\ner\\", "first")]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} <|end|>") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as n_turns")
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(chat_format.format_conversations(df)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    assert got == brute(rows)
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_a_rewriting_that_the_next_turn_undoes():
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(90)]
    say = lambda ts: "".join(f"[{r}] {x}\n" for r, x in ts)
    for n in (33, 45, 71):
        render = lambda ts: "old\n" * (len(ts) == n) + say(ts)  # noqa: B023, E731
        assert chat_format.turn_spans(render, turns) == (say(turns), None, [n - 1, n])


def test_thousands_of_turns_by_every_prefix():
    turns = [(("user", "assistant")[i % 2], f"turn {i} <|end|> " * 5) for i in range(4000)]
    t = chat_format.ControlTemplate()
    out, spans, rewritten = chat_format.turn_spans(t.render, turns)
    loss = chat_format.text_spans(t.render, turns, spans, out, frozenset(["assistant"]))
    assert rewritten == [] and [t.unescape(out[a:b]) for a, b in loss] == [x for r, x in turns if r == "assistant"]
