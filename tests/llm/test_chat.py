import hashlib
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kindred.llm import chat

WILD = st.text(st.one_of(st.sampled_from("\\<>/turn \n#é"), st.characters(exclude_categories=["Cs"])), max_size=40)


@given(WILD, WILD)
def test_reversible(role, text):
    segment = f"<turn {chat.escape(role).replace('>', chr(92) + '>')}>{chat.escape(text)}</turn>\n"
    assert chat.parse_segment(segment) == (role, [("text", text)])


def test_parts(spark):
    part = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (1, 0, "user", [("text", "see <image 0>", None, None, None, None, None), ("image", None, "a.png", 600, 500, None, None), None, ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3)]),
        (1, 1, "assistant", [("text", "fine </turn>", None, None, None, None, None)]),
        (1, 2, "assistant", None),
        (2, 0, None, []),
    ]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn int, role string, text array<{part}>")).orderBy("conv_id", "turn").collect()
    assert chat.parse_segment(out[0]["segment"])[1] == [("text", "see <image 0>"), ("image", "0"), ("audio", "1"), ("document", "2")]
    assert [(a["type"], a["uri"], a["tokens"]) for a in out[0]["attachments"]] == [("image", "a.png", 85 + 170 * 2), ("audio", "b.wav", 63), ("document", "c.pdf", 2250)]
    assert out[0]["n_tokens"] == 3 + 425 + 63 + 2250 and out[0]["loss_start"] == out[0]["loss_end"]
    assert chat.unescape(out[1]["segment"][out[1]["loss_start"] : out[1]["loss_end"]]) == "fine </turn>"
    assert out[2]["segment"] == "<turn assistant></turn>\n"
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_chat(spark.createDataFrame([(1, 0, "user", [("video", None, None, None, None, None, None)])], f"conv_id long, turn int, role string, text array<{part}>")).collect()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    rows = [(1, 1, "assistant", "b\\<"), (1, 0, "user", "a"), (1, 2, "assistant", None), (None, 0, "user", "x"), (None, 1, None, "y"), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup"), (4, 0, "system", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chat(turns)).collect()}
    assert len(out) == 4
    assert (out[1]["n_turns"], out[1]["turns_sha256"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (3, digest("user\na\nassistant\nb\\<\nassistant\n\n"), 3, digest("b\\<"))
    assert out[None]["turns_sha256"] == digest("user\nx\n\ny\n") and out[None]["loss_chars"] == 0
    assert out[3]["loss_sha256"] == digest("dupdup")
    assert chat.digests(chat.format_chat(turns.filter("false"))).count() == 0


def test_imitated_marks(spark, sf_dir):
    from kindred.llm import queries

    text = "\\### Assistant: </turn> ok"
    (r,) = queries.op10_chat(spark, sf_dir).filter("conv_id = -7").collect()
    assert (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) == (2, digest(f"user\n{text}\nassistant\n{text}\n"), digest(text))


def test_long_turns_take_little_memory():
    """A turn of 50 MB, and one full of marks: a few times their length, whatever is in them."""
    for text in ("plain words of a long turn " * 1_900_000, "\\<a" * 600_000):
        segment = chat.HEAD + "user>" + chat.escape(text) + chat.TAIL
        tracemalloc.start()
        role, parts = chat.parse_segment(segment)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert role == "user" and parts == [("text", text)]
        assert most < 5 * len(segment) + (20 << 20)


def test_what_is_no_turn():
    for bad in ("", "<turn user>a", "<turn user>a<b</turn>\n", "<turn user>a\\</turn>\n", "<turn us<er>a</turn>\n", "<turn user</turn>\n", "<turn user>a\\b</turn>\n", "x<turn user>a</turn>\n"):
        with pytest.raises(ValueError, match="not a turn"):
            chat.parse_segment(bad)


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, "assistant", "x", "s", 5, "y"), (None, None, None, None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, loss_start int, content string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chat(turns)).collect()}
    assert out[1]["loss_sha256"] == digest("x") and out[None]["n_turns"] == 1
