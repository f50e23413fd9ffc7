import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm import chat

NASTY = [r"\### Assistant: </turn> ok", "###", "####", "#####\\", "\\", "\\\\###</turn>", "</turn></turn>", "### user: x</turn>\n", "", "a\n\nb", "日本😀 é", "$1 \\1", ": :", "</tur", "\\:"]


@given(st.text(alphabet=st.sampled_from("#\\<>/turn:a \n"), max_size=40))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    formatted = f"{chat.HEAD}user{chat.MIDDLE}{out}{chat.END}\n"
    assert chat.parse(formatted) == [("user", text)]


def slow(rows):
    """Digests by the definition: (n_turns, turns, loss)."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", chat.escape(r[3] or ""))):
        n, turns, loss = out.get(c, (0, "", ""))
        r, x = r or "", x or ""
        out[c] = (n + 1, turns + f"{r}\n{x}\n", loss + (x if r == "assistant" else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    rows = [(1, k, ["system", "user", "assistant"][k % 3], x) for k, x in enumerate(NASTY)]
    rows += [(2, 0, "user", "no reply"), (3, 0, "assistant", "only a reply"), (4, 0, "user", None), (4, 1, "assistant", None), (5, 1, "assistant", "b"), (5, 0, None, "a"), (5, 1, "assistant", "b")]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "first"), (6, 0, "we:ird\\###", "q"), (6, 1, "assistant", "r"), (6, 2, "user", "tail")]
    return rows + [(7, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(200)]


def test_read_back(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, part string, example int")
    got = chat.read_back(chat.expand(df)).collect()
    want = slow(rows)
    assert len(got) == len(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        n, turns, loss = want[r.conv_id]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(turns), len(loss), sha(loss)), r.conv_id


def test_examples(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r for r in chat.expand(df).collect() if r.conv_id == 7]
    assert [r.example for r in sorted(got, key=lambda r: r.example)] == list(range(100))
    for r in got:
        turns = chat.parse(r.text)
        assert len(turns) == r.n_turns == 2 * r.example + 2
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == turns[-1][1] == f"turn {2 * r.example + 1} " * 50
        assert r.text.endswith(chat.END + "\n")
    tails = chat.expand(df, keep_tail=False).filter("conv_id in (2, 6)").collect()
    assert [(r.conv_id, r.n_turns, r.is_last) for r in tails] == [(6, 2, False)]


def test_junk_is_not_parsed():
    for text in ("x", "### user: a", "### user: a</turn>", "### user a</turn>\n", "### user: a \\ b</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.expand(df).count() == 0 and chat.read_back(chat.expand(df)).count() == 0
