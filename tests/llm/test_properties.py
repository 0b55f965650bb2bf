"""Properties of the parts that need no session, on generated texts."""

from __future__ import annotations

import array
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from claimloom.llm import bpe, credentials, quotes, substrings, topk
from claimloom.llm.queries import tokenizer_path
from claimloom.llm.words import Words
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Letters of all blocks up to those that every Unicode version of the last years knows alike.
TEXT = st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60)


@lru_cache
def coders():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), "rb") as f:
        return bpe.Coder(f.read()), Tokenizer.from_file(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_bpe_round_trip(text):
    mine, theirs = coders()
    assert array.array("I", mine.encode(text)).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(mine.encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.text("ab c", min_size=1, max_size=40), st.integers(2, 60))
def test_heap_and_scan_agree(text, times):
    mine, _ = coders()
    word = (text.replace(" ", "") * times or "a").encode()
    ids = [mine.first[b] for b in word]
    old, bpe.LONG = bpe.LONG, 1 << 30
    try:
        scanned = mine.merge(word)
    finally:
        bpe.LONG = old
    assert mine._merge_long(ids) == scanned


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words(texts):
    words = Words(pa.array(texts, pa.string()))
    got = [[bytes(words.data[s:e]).decode() for s, e, d in zip(words.start, words.end, words.doc, strict=True) if d == i] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text("tokensecrapiky_:= \"'0123456789abcdefAKIA\n", max_size=120))
def test_base_spans_are_those_of_the_open_patterns(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    want += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert credentials.base_spans(text) == [(s, e, k) for s, _, e, k in sorted(want)]
    base, every = credentials.spans_of(text)
    assert [s for s in every if s[2] in credentials.KINDS[:3]] == base


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 12))
def test_window_hashes_name_windows(values, length):
    hashes = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
    names = substrings.window_hashes(hashes, length)
    windows = [tuple(values[i : i + length]) for i in range(len(values) - length + 1)]
    assert len(names) == len(windows)
    assert len(set(zip(windows, names.tolist(), strict=True))) == len(set(windows)) == len(set(names.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=4, max_size=4), min_size=1, max_size=60), st.lists(st.integers(-300, 300), min_size=4, max_size=4), st.integers(1, 6))
def test_search_never_loses_a_member(vectors, query, k):
    table, q = np.array(vectors, float), np.array([query], float)
    found = topk.Index(table).search(q, np.ones((1, len(table)), bool), k)[0]
    scores = table @ q[0]
    kth = np.sort(scores)[-min(k, len(scores))]
    assert set(np.flatnonzero(scores >= kth)) <= set(found.tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab ", max_size=8)), max_size=12))
def test_quote_levels_come_back(lines):
    text = "\n".join("> " * level + line.strip(" >") for level, line in lines)
    got = quotes.levels(text)
    if lines:
        assert [level for level, _ in got] == [level for level, _ in lines]
    assert all(level == 0 or ">" not in quotes.unquoted(got) for level, _ in got)
