"""Every turn survives formatting, whatever marks it contains."""

from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import chat

PARTS = ["</s>", "<s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "\\", "<", "[", "a", " ", "/s>", "<\\/s>", "<<ROLE ", "<</ROLE>>", ">>", "é", "\n"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=10).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool 1", "<s>%é\n"]), TEXTS), max_size=5)
KINDS = "conv_id bigint, turn bigint, role string, text string"


@given(turns=TURNS)
@settings(max_examples=500, deadline=None)
def test_whole_conversations_parse_back(turns):
    rendered = [chat.render(role, text) for role, text in turns]
    whole = "".join(text for text, _ in rendered)
    assert [(t.role, t.text) for t in chat.parse(whole)] == turns


@given(text=TEXTS)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_leaves_no_mark(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat.RAW.search(chat.escape(text))


def test_what_breaks_the_grammar_is_rejected():
    assert chat.parse("hello") is None
    assert chat.parse("<s>never closed") is None
    assert chat.parse("<<ROLE x>>a") is None
    assert chat.parse("<s>a[INST] b</s>") is None
    assert chat.parse("") == []


def test_digests_cover_nulls_ties_and_long_texts(spark):
    long = "x[INST] " * 50_000
    rows = [
        (7, 1, "assistant", "b"),
        (7, 0, "user", None),
        (7, 1, "assistant", "b"),
        (7, 1, None, "a"),
        (None, 0, "assistant", long),
        (8, None, "assistant", "</s>"),
        (8, 0, "user", ""),
    ]
    formatted = chat.format_turns(chat.ordered_turns(spark.createDataFrame(rows, KINDS))).cache()
    got = {row.conv_id: row for row in chat.digests(formatted).collect()}
    turns = {7: [("user", ""), ("", "a"), ("assistant", "b"), ("assistant", "b")], None: [("assistant", long)], 8: [("assistant", "</s>"), ("user", "")]}
    assert set(got) == set(turns)
    for conversation, expected in turns.items():
        said = "".join(text for role, text in expected if role == "assistant")
        row = got[conversation]
        assert row.n_turns == len(expected)
        assert row.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in expected).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(said), sha256(said.encode()).hexdigest())
        assert row.formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in expected)
    for row in formatted.collect():
        assert chat.unescape(row.formatted[row.start : row.end]) == row.text
        assert row.in_loss == (row.role == "assistant")
    empty = spark.createDataFrame([], KINDS)
    assert chat.digests(chat.format_turns(chat.ordered_turns(empty))).count() == 0
