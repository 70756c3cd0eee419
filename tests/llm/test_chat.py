"""Layouts by fingerprint, the template's escapes, and formatted conversations read back."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollweave.llm import chat_format, chat_layouts, queries

ROWS = "conv_id long, turn long, role string, text string, first_turn string, formatted int"
pieces = st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "<", "[", "/", "s>", " ", "\n", "SYS>>", "INST]", "é", "x"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces), pieces), max_size=5))
def test_template_is_read_back(turns):
    assert list(chat_format.read_turns("".join(chat_format.marked(*t)[0] for t in turns))) == turns


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_escapes(text):
    said = chat_format.escape(text)
    assert chat_format.unescape(said) == text
    assert not any(c in said for c in chat_format.CONTROLS)


def expected(turns):
    """conv_id -> digests of turns (conv_id, turn, role, text) in order."""
    out = {}
    for c in {t[0] for t in turns}:
        mine = [(r or "", x or "") for _, _, r, x in sorted(
            (t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, (t[2] or "").encode(), (t[3] or "").encode()))]
        loss = "".join(x for r, x in mine if r == "assistant")
        out[c] = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_format.marked(r, x)[0]) for r, x in mine))
    return out


def digests(segments):
    rows = chat_format.digests(segments).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def awkward():
    rng = random.Random(2)
    texts = [None, "", "</s>[INST] ok [/INST]", "a\\</s>", "é" * 50, "long " * 60_000, "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(texts)) for c in range(30) for t in range(rng.randint(1, 6))]
    return rows + rows[:5] + [(None, 0, "user", "no id"), (None, None, "user", "no turn"), (5, None, "assistant", "first")]


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_rows(spark, monkeypatch, most):
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", most)
    turns = awkward() + [(77, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(3000)]  # one long conversation
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], ROWS).repartition(7)
    assert digests(chat_format.format_conversations([df])) == expected(turns)


def test_empty_table(spark):
    assert digests(chat_format.format_conversations([spark.createDataFrame([], ROWS)])) == {}


RECORDS = {
    "messages": {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"messages": 1}},
    "message parts": {"conv_id": 1, "messages": [{"role": "user", "content": [{"text": "q"}]}, {"role": "assistant", "content": [{"text": "a"}, {"text": ""}]}]},
    "shared": {"conv_id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "nested": {"conv_id": 1, "data": {"turns": [{"speaker": "User", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]}},
    "prompt": {"conv_id": 1, "prompt": "q", "completion": "a", "lang": "en"},
    "response": {"response": "a", "prompt": "q", "conv_id": 1},
    "instruction": {"conv_id": 1, "instruction": "q", "input": "", "output": "a"},
}


@pytest.mark.parametrize("name", RECORDS)
def test_record_layouts(spark, name):
    told = chat_layouts.fingerprinted(spark.createDataFrame([(json.dumps(RECORDS[name]),)], "record string"), "record")
    assert [r.layout for r in told.collect()] == [name]
    got = [(r.conv_id, r.role.lower(), r.text) for r in chat_layouts.record_turns(told).orderBy("place").collect()]
    assert got == [(1, "user", "q"), (1, "assistant", "a")]


def test_optional_fields(spark):
    record = {"conv_id": 2, "system": "s", "instruction": "do", "input": "this", "output": "done"}
    told = chat_layouts.fingerprinted(spark.createDataFrame([(json.dumps(record),)], "record string"), "record")
    got = [(r.role, r.text) for r in chat_layouts.record_turns(told).orderBy("place").collect()]
    assert got == [("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")]


def test_unknown_records_are_told(spark):
    bad = ['{"conv_id": 1, "prompt": "q"}', "no json", "[1]", None, "", '{"conv_id": 3, "messages": []}', '{"conv_id": 1, "prompt": "q", "completion": "a", "response": "b"}']
    told = chat_layouts.fingerprinted(spark.createDataFrame([(b,) for b in bad], "record string"), "record").collect()
    assert [r.layout for r in told] == [None] * len(bad)
    assert [r.fingerprint is not None for r in told] == [True, False, False, False, False, True, True]


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat_layouts.table_turns(spark.createDataFrame([(1, "a")], "conv_id long, text string"))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    assert {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_chat_formatting"](spark, folder).collect()} == expected(turns)
