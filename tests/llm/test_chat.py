"""Chat formatting: round trips of the template, masks against character sets, and edge cases."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import compare, connect
from trailmark.llm import chat, registry

SF = "/root/testdata/sf0.001"
T = chat.Template()
BITS = ["<", "\\", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", "[", "INST]", "<|endoftext|>", "|", " ok ", "é", "🙂", "\n"]
TEXT = st.lists(st.sampled_from(BITS), max_size=12).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=5)


@settings(max_examples=500, deadline=None)
@given(TURNS)
def test_template_is_reversible(turns):
    formatted, spans = T.render(turns)
    assert T.parse(formatted) == turns
    assert [T.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    assert not any(c in T.escape(t) for _, t in turns for c in T.controls)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_tokens_stay_within_turns(turns):
    """The mask covers exactly the learnt texts, though characters are split over tokens."""
    coder = chat.tokenizer(public_tokenizers.path(chat.TOKENIZER), T.markers)
    formatted, spans = T.render(turns)
    coded = coder.encode(formatted, add_special_tokens=False)
    places = np.array(coded.offsets).reshape(-1, 2)
    learnt = [s for s, (r, _) in zip(spans, turns) if r == "assistant"]
    mask = chat.meets(learnt, places[:, 0], places[:, 1])
    want = {i for a, b in learnt for i in range(a, b)}
    assert {i for (a, b), m in zip(places.tolist(), mask) if m for i in range(a, b)} == want
    assert mask.tolist() == [bool(want & set(range(a, b))) for a, b in places.tolist()]
    assert [T.unescape(x) for x in chat.under(formatted, places[:, 0], places[:, 1], mask)] == [
        t for r, t in turns if r == "assistant" and t
    ]
    assert sum(i >= 50256 for i in coded.ids) == 1 + 3 * len(turns)  # only the template's own markers
    assert coder.decode(coded.ids, skip_special_tokens=False) == formatted


def test_faulty_templates_are_refused():
    for bad in ({"begin": ""}, {"role": "</s>"}, {"end": "a\\b"}, {"end": "<<s>"}, {"reserved": ("a<",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_query_matches_sql(spark):
    got = registry.QUERIES["op12_chat_format"](spark, SF)
    assert compare(got, connect(SF), registry.CHECKS["op12_chat_format"]) == []


def test_edges(spark):
    rows = [
        (1, 2, "assistant", None, 1), (1, 0, None, "hi", 1), (1, 1, "assistant", "", 1),
        (2, 0, "assistant", "same", 1), (2, 0, "assistant", "same", 1), (2, None, "tool\n", "<", 1),
        (None, 0, "assistant", "no id", 1), (None, 1, "user", "x", 1),
        (3, 0, "assistant", "a <\\\\/s> 日本 " * 40_000, 1), (4, 0, "user", "only a question", 1),
        (5, 0, "assistant", "<", 1), (5, 1, "assistant", "\\s>", 1),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    chats = chat.format_chats(frame.withColumnRenamed("ids", "formatted").repartition(3))
    assert set(chats.columns) == {"conv_id", "formatted", "ids", "starts", "ends", "loss_mask"}
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    want = {
        1: [("", "hi"), ("assistant", ""), ("assistant", "")],
        2: [("tool\n", "<"), ("assistant", "same"), ("assistant", "same")],
        None: [("assistant", "no id"), ("user", "x")],
        3: [("assistant", rows[8][3])],
        4: [("user", "only a question")],
        5: [("assistant", "<"), ("assistant", "\\s>")],
    }
    assert got.keys() == want.keys()
    for k, turns in want.items():
        lost = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
        assert got[k]["formatted_chars"] == len(T.render(turns)[0])
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0
    other = frame.selectExpr("cast(conv_id as string) `a.b`", "turn n", "role who", "text said")
    renamed = chat.format_chats(other, "a.b", "n", "who", "said")
    assert {r["a.b"] for r in chat.read_back(renamed, "a.b").collect()} == {"1", "2", "3", "4", "5", None}
