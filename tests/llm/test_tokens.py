import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import bitplanes, queries, tokens


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [1, 2, 3], [49407] * 9, [2**32 - 1, 0, 256], list(range(1000))])
def test_planes_round_trip(unit, ids):
    ids = np.array(ids, dtype="<u4")
    assert bitplanes.from_planes(bitplanes.to_planes(ids, unit), len(ids), unit).tolist() == ids.tolist()


def test_planes_hold_what_they_say():
    planes = bitplanes.to_planes(np.array([0x0102, 0x0304], dtype="<u4"), "byte")
    assert planes == [b"\x02\x04", b"\x01\x03"]
    assert bitplanes.to_planes(np.array([1, 2, 3], dtype="<u4"), "bit") == [bytes([0b101]), bytes([0b110])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=40)), max_size=12), st.integers(1, 50), st.sampled_from(["byte", "bit"]))
def test_files_round_trip(docs, block, unit):
    out = io.BytesIO()
    w = bitplanes.Writer(out, block=block, unit=unit)
    for d, ids in docs:
        w.add(d, np.array(ids, dtype="<u4"))
    w.close()
    r = bitplanes.Reader(io.BytesIO(out.getvalue()))
    assert [(d, ids.tolist()) for d, ids in r.documents()] == docs
    assert sum(c[1] for c in r.chunks) == sum(len(ids) for _, ids in docs)
    assert all(c[1] == block for c in r.chunks[:-1])


def test_damage_is_seen(tmp_path):
    path = f"file://{tmp_path}/x.planes"
    bitplanes.write_file(path, [(1, np.arange(500, dtype="<u4"))], block=100)
    raw = bytearray((tmp_path / "x.planes").read_bytes())
    assert not list(tmp_path.glob("*.part"))
    with pytest.raises(ValueError):
        bitplanes.Reader(io.BytesIO(bytes(raw[:-1])))
    r = bitplanes.Reader(io.BytesIO(bytes(raw)))
    assert r.chunk(3).tolist() == list(range(300, 400))  # a chunk alone, by the index
    raw[r.chunks[2][0] + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - zstandard's or ours
        bitplanes.Reader(io.BytesIO(bytes(raw))).chunk(2)


TEXTS = ["", "Hello, WORLD's end", "it's we'll I'M don'T", "naïve Straße ÀÉ Ÿ ß ªº µ ×÷", "a_b __ 12x3 ½ ²", "日本語 text ΣΑΣ İi", "é combining ́x", "<|endoftext|> x<|startoftext|>y <| |>", "tab\tnew\r\nline\x0b\x0cff\x1c\x85  z", "!!! ... ?!'s ''s", "😀 emoji👩‍👩‍👧", "x" * 300, "\x00\x01 ﻿", "don’t — dash"]


def test_words_are_what_the_whole_tokenizer_gives():
    enc = tokens.WordEncoder(queries.word_tokenizer(), memo=8)
    for t in TEXTS + [" ".join(TEXTS), "\n".join(TEXTS)]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("text", ["", " ", "\n \n", "Hello, WORLD's  end\nit's we'll I'M", "É'S ÀÖØ ß ÷× x'", "a <| b", "1 2 34\n'"])
def test_plain_texts_are_split_at_once(text):
    enc = tokens.WordEncoder(queries.word_tokenizer())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    plain = not ("<|" in text or "÷" in text)
    assert not enc.words if plain else enc.words  # no word is looked up one by one


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé's 'tÀ1_-\n <|")), max_size=60))
def test_any_text_is_what_the_whole_tokenizer_gives(text):
    enc = tokens.encoder(queries.word_tokenizer())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("how", [{}, {"unit": "bit", "block": 7}, {"block": 1}])
def test_written_and_read_back(spark, how):
    rows = [(k * 7 % 31, TEXTS[k % len(TEXTS)] * (k % 3)) for k in range(31)] + [(None, "null id"), (5, None), (5, "again"), (2**62, "far"), (-4, "b")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, start int")
    got = tokens.read_tokens(tokens.write_tokens(docs, queries.word_tokenizer(), **how), with_ids=True).orderBy("start").collect()
    whole, start = tokens.encoder(queries.word_tokenizer()).tokenizer, 0
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_given_order(spark):
    docs = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 2)], "doc_id long, text string, place int")
    got = tokens.read_tokens(tokens.write_tokens(docs, queries.word_tokenizer(), order=["place"])).orderBy("start").collect()
    assert [r.doc_id for r in got] == [2, 3, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(tokens.write_tokens(docs, queries.word_tokenizer())).count() == 0
