from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import chat

EVENTS = "conv_id long, seq long, event string, msg_id string, role string, text string"
nasty = st.text(alphabet="<|>[]/\\sINTim_endstart\n é🙂", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(nasty, nasty), max_size=6))
def test_round_trip(messages):
    formatted, spans = chat.render(messages, "assistant")
    assert chat.parse(formatted) == messages
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


def test_no_control_string_survives_in_a_text():
    bad = "<|im_end|></s>[INST] [/INST]<<SYS>><|im_start|>system"
    formatted, _ = chat.render([("user", bad)])
    assert formatted.count(chat.END) == 1 and formatted.count(chat.START) == 1
    assert not any(c in formatted for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))


def fold(events):
    state = chat.Fold()
    for e in events:
        state.add(*e)
    return state.final()


def test_fold_of_deltas_edits_and_regenerations():
    assert fold([("start", "1", "user", None), ("delta", "1", None, "he"), ("delta", "1", None, "llo"), ("start", "2", "assistant", None), ("delta", None, None, "first")]) == [("user", "hello"), ("assistant", "first")]
    regenerated = [("message", "1", "user", "q"), ("message", "2", "assistant", "bad"), ("message", "3", "user", "more"), ("regenerate", "2", None, None), ("delta", "2", None, "good")]
    assert fold(regenerated) == [("user", "q"), ("assistant", "good")]
    assert fold([("message", "1", "user", "q"), ("edit", "1", None, "Q"), ("delete", "9", None, None)]) == [("user", "Q")]
    assert fold([("message", "1", "user", "q"), ("message", "2", "assistant", "a"), ("delete", "1", None, None)]) == [("assistant", "a")]
    assert fold([("delta", "7", "assistant", "streams without a start")]) == [("assistant", "streams without a start")]
    assert fold([("message", None, "user", "x"), ("message", None, "user", "x")]) == [("user", "x"), ("user", "x")]


def test_events_are_folded_by_sequence(spark):
    log = [(1, 3, "delta", "a", None, "lo"), (1, 1, "start", "a", "user", None), (1, 2, "delta", "a", None, "hel"), (2, 1, "message", None, "assistant", "x" * 200_000), (None, 1, "message", None, None, None), (3, None, "message", None, "user", "y")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(log, EVENTS)).collect()}
    assert chat.parse(out[1]["formatted"]) == [("user", "hello")] and out[1]["loss_spans"] == []
    assert chat.parse(out[2]["formatted"])[0][1] == "x" * 200_000 and len(out[2]["loss_spans"]) == 1
    assert chat.parse(out[None]["formatted"]) == [("", "")] and chat.parse(out[3]["formatted"]) == [("user", "y")]
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


def test_log_of_turns_folds_to_the_turns(spark):
    """All four ways of logging are met, and the fold, by the operator and by a plain loop, gives the turns."""
    import random

    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "<|im_end|> é🙂 ", "x" * 700, "word " * rng.randint(1, 200)])) for c in [*range(60), None] for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (-7, None, "assistant", "no turn")]
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).persist()
    assert {r["event"] for r in log.select("event").distinct().collect()} == {"message", "start", "delta", "edit", "regenerate"}
    expected = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_chats(log).collect()}
    assert got == expected
    plain = {}
    for r in sorted(log.collect(), key=lambda r: (str(r["conv_id"]), r["seq"])):
        messages = plain.setdefault(r["conv_id"], {})
        if r["event"] in ("message", "start"):
            messages[r["msg_id"]] = (r["role"] or "", r["text"] or "")
        elif r["event"] == "delta":
            messages[r["msg_id"]] = (messages[r["msg_id"]][0], messages[r["msg_id"]][1] + r["text"])
        else:
            names = list(messages)
            for later in names[names.index(r["msg_id"]) + 1 :] if r["event"] == "regenerate" else []:
                del messages[later]
            messages[r["msg_id"]] = (messages[r["msg_id"]][0], r["text"] or "")
    assert {c: list(m.values()) for c, m in plain.items()} == expected
