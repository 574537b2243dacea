import hashlib

from fluxlane.llm import catalog, chat
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = st.lists(st.sampled_from(["<", "\\", "/", "s>", "INST]", "[", "</s>", "<s>", "[INST]", "[/INST]", "a", "\n", "é", " "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_any_turn_comes_back(role, text):
    chunk, a, b = chat.render_turn(role, text)
    assert chat.parse(chunk) == [(role, text)] and chat.unescape(chunk[a:b]) == text and chat.unescape(chat.escape(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_chunks_in_a_row_parse_to_all_turns(turns):
    assert chat.parse("".join(chat.render_turn(*t)[0] for t in turns)) == turns


def test_plain_content_is_not_escaped():
    assert chat.render_turn("user", "a [b] <c> \\ d")[0] == "<s>[INST]user[/INST]a [b] <c> \\ d</s>"


def expected(turns):
    full = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests_by_conversation(spark):
    rows = [(1, 2, "assistant", "fine </s>"), (1, 1, "user", "how"), (2, 1, "user", None), (2, 1, None, "x"), (2, None, "assistant", "first"), (None, 1, "assistant", "lost"), (3, 1, "assistant", "é" * 50_000), (3, 1, "assistant", "é" * 50_000)]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "conv_id long, turn long, role string, text string, chunk string, loss_start int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == {
        1: expected([("user", "how"), ("assistant", "fine </s>")]),
        2: expected([("assistant", "first"), ("", "x"), ("user", "")]),
        None: expected([("assistant", "lost")]),
        3: expected([("assistant", "é" * 50_000)] * 2),
    }
    assert chat.read_back(chat.format_turns(df.filter("conv_id > 99"))).collect() == []


def test_query_matches_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    by = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: r.turn):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: tuple(r)[1:5] for r in catalog.op3_chat_formatting(spark, sf).collect()}
    assert got == {k: expected(v) for k, v in by.items()}
