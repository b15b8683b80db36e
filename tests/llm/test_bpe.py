import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from docstrata.llm import bpe as module
from docstrata.llm.bpe import Bpe, code_documents, decode_documents, encode_documents, sufficient_lookahead

PATH = P.path("byte_bpe_50k.json")
OURS, THEIRS = Bpe(PATH), Tokenizer.from_file(PATH)


def same(text):
    ids = np.frombuffer(b"".join(OURS.encode(text)), np.int32)
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert OURS.decode(ids) == THEIRS.decode(want, skip_special_tokens=False)


def test_every_character():
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    bad = []
    for at in range(0, len(chars), 512):
        text = "".join(f"a{c} {c}b" for c in chars[at : at + 512])
        if np.frombuffer(b"".join(OURS.encode(text)), np.int32).tolist() != THEIRS.encode(text, add_special_tokens=False).ids:
            bad += [c for c in chars[at : at + 512] if np.frombuffer(b"".join(OURS.encode(f"a{c} {c}b")), np.int32).tolist() != THEIRS.encode(f"a{c} {c}b", add_special_tokens=False).ids]
    assert bad == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '’s\n\t t é中😀.-=1x") | st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a  b", "\n \n", "it's we'll 'S", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endo", "x" * 30_000, "ab" * 20_000, " " * 30_000 + "y", "\n" * 9000, "中文" * 9000, "word " * 30_000, "- =" * 20_000, "a\x1c b\x85 c᠎ d​ e"])
def test_long_and_odd_texts(text):
    same(text)


def test_windows_give_what_the_whole_piece_gives(monkeypatch):
    monkeypatch.setattr(module, "WINDOW_BYTES", 40)
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "-=", "theringation", "éàü", "0123456789"):
        data = "".join(rng.choice(list(alphabet), 6000)).encode()
        assert list(OURS.piece(data)) == OURS.merge(data)


def test_lookahead_of_a_known_chain():
    # a+b, then ab... : c d e in falling ranks: de (0), cd (1), bc (2), ab (3)
    ids = {c: i for i, c in enumerate("abcde")}
    pairs = [(ids["d"], ids["e"]), (ids["c"], ids["d"]), (ids["b"], ids["c"]), (ids["a"], ids["b"])]
    assert sufficient_lookahead(pairs, [5, 6, 7, 8], [1] * 5 + [2] * 4) == 4


def test_documents(make_docs):
    texts = ["a b", None, "", "é" * 5000, "bad <|endoftext|>", "a b"]
    docs = make_docs(list(enumerate(texts)) + [(None, "z")])
    rows = decode_documents(encode_documents(docs, PATH), PATH).collect()
    want = sorted(THEIRS.encode(t or "", add_special_tokens=False).ids for t in [*texts, "z"])
    assert sorted(r.ids for r in rows) == want and sorted(r.text for r in rows) == sorted([t or "" for t in texts] + ["z"])
    assert decode_documents(encode_documents(docs.limit(0), PATH), PATH).collect() == []


def test_bytes_that_form_no_text():
    ids = np.array([OURS.byte_ids[b] for b in b"\xe4\xb8A\xff\xe4\xb8"], np.int32)
    assert OURS.decode(ids) == THEIRS.decode(ids.tolist(), skip_special_tokens=False)
    assert OURS.decode(ids, block=1) == OURS.decode(ids)


def test_whole_table_and_odd_texts_together(spark, sf, make_docs, monkeypatch):
    monkeypatch.setattr(module, "STEP_CHARS", 5000)
    odd = ["a  b", " lead", "trail ", "tab\t x", "a \n b", "\n", "x<|endoftext|> y", "<|endoftext|>", "it's  'S we'll", "é é", "", " ", "a\x1c b\x85 c", "- =" * 900, " x" * 3000, "z" * 9000 + " q"]
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = table + [(10_000 + i, t) for i, t in enumerate(odd)]
    docs = make_docs(rows).repartition(3)
    got = {r.doc_id: r for r in code_documents(docs, PATH).collect()}
    assert got == {r.doc_id: r for r in decode_documents(encode_documents(docs, PATH), PATH).collect()}
    for i, text in rows:
        want = THEIRS.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].text == THEIRS.decode(want, skip_special_tokens=False)


def test_blocks_of_any_text_are_bounded(monkeypatch):
    """Lines, Chinese, base64 and tables: blocks end where pieces do, and ids are the library's."""
    coder, known = OURS, THEIRS
    rng = random.Random(4)
    mixed = ["".join(rng.choice("ab é'sdt\n\t  12三千，。世界.!-_'’") for _ in range(3000)) for _ in range(20)]
    texts = [*mixed, "word\n" * 4000, "世界，你好。" * 2000, "QUJDREVG1+/x9" * 3000, "a,b\n1,2\n" * 2000, " \n \n x'll 's" * 900, "世界" * 3000]
    for size in (300, 1 << 16):
        monkeypatch.setattr(module, "CHUNK_CHARS", size)
        for text in texts:
            assert "".join(coder.blocks(text)) == text
            assert [i for b in coder.encode(text) for i in np.frombuffer(b, np.int32).tolist()] == known.encode(text, add_special_tokens=False).ids
    for text in ("word\n" * 100_000, "世界，你好。" * 100_000, "QUJDREVG1+/x9" * 50_000):
        assert max(map(len, coder.blocks(text))) <= module.CHUNK_CHARS
