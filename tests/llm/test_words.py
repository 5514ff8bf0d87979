import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from histshift.llm import words as W


def split(texts, lower=False):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    starts, ends, first = W.bounds(data, offsets)
    found = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    return found, W.hashes(data, starts, ends, lower)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00e9 \t\n\x0b\x0c\r\x1c\u00a0Z", max_size=30), max_size=6))
def test_words_are_what_bytes_split_gives(texts):
    raw = [t.encode() for t in texts]
    assert split(raw)[0] == [t.split() for t in raw]


def test_hash_is_a_function_of_the_word_alone(monkeypatch):
    raw = [b"aa b", b" b aa" + b" c" * 50, b"q" * 3000 + b" aa", b"Aa AA"]
    monkeypatch.setattr(W, "CHUNK", 16)
    found, h = split(raw)
    flat = [w for t in found for w in t]
    assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))
    lower = split(raw, True)[1]
    assert len(set(lower.tolist())) == len({w.lower() for w in flat})


def test_ngrams_are_equal_exactly_where_the_words_are():
    h = W.mix(np.array([1, 2, 3, 1, 2, 3, 4, 1, 2] * 9, np.uint64))
    for n in (1, 2, 3, 4, 5, 7, 25, 50):
        got = W.ngrams(h, n)
        want = [tuple(h[i:i + n]) for i in range(len(h) - n + 1)]
        assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want))
    assert len(W.ngrams(h[:3], 4)) == 0
