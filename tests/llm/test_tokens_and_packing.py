"""Ids against the library, exact round trips of the files, and packing plans against direct checks."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rows import SF, awkward, documents, empty  # noqa: F401 - fixtures
from textlab.llm import packing, token_files
from textlab.llm.tokens import Encoder, public_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def enc(request):
    return Encoder(public_path(request.param), cache_chunks=200)


def test_ids_are_those_of_the_whole_text(enc):
    rng = random.Random(4)
    bits = list("ÀéÑßŒ,;abAZ'sS. \n\t\x0b\x0c\x1c\x85  ​́ΣςİŉŁ1٣#\x00\r") + ["<|endoftext|>", "'s", "  ", "\n\n", "word", " the"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert enc.encode(text) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_ids_of_documents(enc, documents):
    for r in documents.collect():
        assert enc.encode(r.text) == np.array(enc.tokenizer.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()


class Counting(dict):
    """A memory that counts how often it is asked."""

    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_each_word_is_looked_up_once():
    one = Encoder(public_path(FILES[0]))
    one.cache = Counting(one.cache)
    for text in ("some words of a text, some words", "some words of another text: zyxwvut 12", "a text of words"):
        one.cache.asked = 0
        assert one.encode(text) == np.array(one.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert one.cache.asked == len(text.split())


def test_words_at_hand_give_the_ids_of_their_text(enc):
    for text in ("", " \n", "Some words,\tof a TEXT", "été 12 #x", "<|endoftext|> a\x00b"):
        data = text.encode()
        assert enc.encode_words(data, data.split()) == enc.encode(text)
    for data in (b"a\xff b\xe2\x82 c", b"\xe2 \x82\xac"):            # not UTF-8
        assert enc.encode_words(data, data.split()) == enc.encode(data.decode("utf-8", "replace"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=300), st.integers(1, 70))
def test_simple8b_round_trip(ids, block):
    data = np.array(ids, np.uint64)
    raw = token_files.to_bytes(data, block)
    assert (token_files.from_bytes(raw) == data).all()
    for k in range(-(-len(ids) // block)):
        assert (token_files.from_bytes(raw, k) == data[k * block:(k + 1) * block]).all()


def test_small_ids_take_few_words():
    words, _ = token_files.pack_words(np.ones(6000, np.uint64), 1000)
    assert len(words) < 6000 / 50
    with pytest.raises(ValueError):
        token_files.from_bytes(b"x" * 64)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
def test_plan_places_every_piece_once_and_tightly(counts):
    used, seen = {}, {}
    rows = packing.plan(counts, 40)
    for size in counts:
        own = [r for r in rows if r[0] == size]
        for rank in range(counts[size]):
            _, first, sequence, offset, each = [r for r in own if r[1] <= rank][-1]
            k = rank - first
            used.setdefault(sequence + k // each, []).append((offset + k % each * size, size))
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 40
    pieces = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    bins: list[int] = []
    for size in pieces:                                    # best-fit decreasing, piece by piece
        fit = [k for k, left in enumerate(bins) if left >= size]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= size
        else:
            bins.append(40 - size)
    assert len(used) == len(bins) and not seen


def check_files(spark, docs, path):
    token_files.write(docs, path)
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    enc, start = Encoder(public_path(FILES[0])), 0
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: r[:2])
    assert [r.doc_id for r in got] == [d if known else None for known, d, _ in texts]
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted(enc.encode(t) for _, _, t in texts)
    assert sorted(np.array(r.ids[:-1], "<u4").tobytes() for r in got) == want


def test_files_hold_the_documents_in_order(spark, documents, awkward, empty, tmp_path):
    check_files(spark, documents, str(tmp_path / "d"))
    check_files(spark, awkward, str(tmp_path / "a"))
    check_files(spark, empty, str(tmp_path / "e"))


def check_packing(docs, capacity=64):
    enc = Encoder(public_path(FILES[1]))
    packed = packing.pack(docs, capacity=capacity, with_ids=True)
    rows = packed.collect()
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and (r.length == capacity or r.piece == 0)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {s: b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.offset)) for s, own in by_seq.items()}
    texts = [r.text or "" for r in docs.select("text").collect()]
    assert sum(r.length for r in rows) == sum(len(enc.encode(t)) // 4 + 1 for t in texts)
    assert sum(r.piece == 0 for r in rows) == len(texts)
    return len(by_seq), sum(r.length for r in rows)


def test_packing_of_documents(documents):
    n, total = check_packing(documents, 1024)
    assert n <= -(-total // 1024) * 1.02 + 1


def test_packing_of_awkward_rows(awkward, empty):
    check_packing(awkward)
    assert packing.pack(empty).count() == 0
