import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import chat

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MARKS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<\\|", "\\", "<", "|", "a", " ", "\n", "é", "😀"]), max_size=8).map("".join)


@given(MARKS)
def test_escape_is_reversible_and_leaves_no_mark(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>", ""]), MARKS), max_size=5))
def test_round_trip_and_mask(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    t = chat._tokenizer(TOKENIZER)
    offsets = np.array(t.encode(formatted, add_special_tokens=False).offsets).reshape(-1, 2)
    mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
    brute = [any(a < e and s < b and s < e for a, b in spans) for s, e in offsets]
    assert list(mask) == brute
    assert chat.masked_text(formatted, offsets[:, 0], offsets[:, 1], mask) == "".join(x for r, x in turns if r == "assistant")


ROWS = [(1, 1, "assistant", "fine\n\n <|im_end|>", 7), (1, 0, "user", "hi", 7), (2, 0, None, None, 7), (2, 0, None, None, 7),
        (None, 0, "assistant", "x", 7), (3, 5, "assistant", "b" * 200000, 7), (3, 5, "assistant", "a", 7), (4, None, "user", "", 7)]


def test_table_cases(spark):
    """Nulls, ties, repeated rows, a long text, a column that clashes with a result."""
    rows = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.format_conversations(rows, TOKENIZER).collect()}
    assert set(out) == {None, 1, 2, 3, 4}
    assert chat.parse(out[1].formatted) == [("user", "hi"), ("assistant", "fine\n\n <|im_end|>")]
    assert chat.parse(out[2].formatted) == [("", ""), ("", "")]
    assert [t[0] for _, t in chat.parse(out[3].formatted)] == ["a", "b"]
    assert sum(out[1].loss_mask) > 0 and not any(out[4].loss_mask)
    assert len(out[3].token_ids) == len(out[3].loss_mask) == len(out[3].token_start)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(rows, TOKENIZER).collect() == []


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = {tuple(r) for r in con.sql(chat.ORACLE_TURNS).fetchall()}
    got = {tuple(r) for r in chat.op7_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
