import random
import zlib

import numpy as np
import pytest

from histshift.llm import pieces as P
from tests.llm.fixtures import frame


@pytest.fixture(scope="module")
def lattice():
    return P.Lattice(P.MODEL)


def every(text, lattice):
    """All segmentations of a text by plain recursion."""
    marked, out = P.SPACE + text.replace(" ", P.SPACE) if text else "", []

    def walk(at, ids, score):
        if at == len(marked):
            out.append((score, tuple(ids)))
            return
        for end in range(at + 1, len(marked) + 1):
            hit = lattice.pieces.get(marked[at:end])
            if hit:
                walk(end, [*ids, *hit[0]], score + hit[1])
        if marked[at] not in lattice.pieces:
            walk(at + 1, [*ids, *[lattice.byte[b] for b in marked[at].encode()]], score + lattice.unknown)
    walk(0, [], 0.0)
    return sorted(out, key=lambda s: -s[0])


def test_n_best_against_all_segmentations(lattice):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab the in\n\u00e9\U0001d54f12  .") for _ in range(rng.randrange(11)))
        for n in (1, 2, 4, 7):
            got, want = P.encode(text, lattice, n), every(text, lattice)
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
            assert len(set(got)) == len(got) and set(got) <= set(want)
            assert all(P.decode(ids, lattice) == text for _, ids in got)


@pytest.mark.parametrize("text", ["", " ", "  x ", "\u2581", "a\u2581 b", "\u2581\u2581 ", "\ue000\u2581", "\x00\n", "a" * 3000])
def test_decode_gives_back_any_text(lattice, text):
    assert all(P.decode(ids, lattice) == text for _, ids in P.encode(text, lattice, 3))


def test_whole_text_search_agrees_with_parts(lattice):
    text = "An other example, of words.  And signs!"
    marked = P.SPACE + text.replace(" ", P.SPACE)
    assert [s for s, _ in lattice.n_best(marked, 6)] == pytest.approx([s for s, _ in P.encode(text, lattice, 6)])


def test_merge_takes_the_best_combinations():
    rng = np.random.default_rng(4)
    for _ in range(50):
        parts = [sorted(((float(x), (k,)) for k, x in enumerate(rng.integers(-9, 0, rng.integers(1, 4)))), reverse=True)
                 for _ in range(rng.integers(1, 5))]
        sums = [0.0]
        for p in parts:
            sums = [a + s for a in sums for s, _ in p]
        assert [s for s, _ in P.combined(parts, 4)] == sorted(sums, reverse=True)[:4]


def test_edge_rows(spark):
    got = P.encode_digest(frame(spark)).collect()
    assert len(got) == frame(spark).count() and all(r.ok and r.scores == sorted(r.scores, reverse=True) for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (1, 2)} == {0}
    assert P.encode_digest(frame(spark, [])).count() == 0
    ranked = P.encode_texts(frame(spark).where("doc_id = 11")).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4]


def test_digest_covers_every_rank(spark, lattice):
    df = frame(spark).where("doc_id in (1, 3, 7, 11, 17)")
    ranks = {(r.doc_id, r["rank"]): r for r in P.encode_texts(df).collect()}
    for r in P.encode_digest(df).collect():
        want = [ranks[r.doc_id, k] for k in range(1, len(r.scores) + 1)]
        assert len(want) == sum(doc == r.doc_id for doc, _ in ranks)
        assert r.scores == [w.score for w in want] and r.rank_pieces == [len(w.ids) for w in want]
        assert r.rank_crc32 == [zlib.crc32(np.array(w.ids, "<u4").tobytes()) for w in want]
        assert r.rank_ok == [True] * len(want) and len(set(r.rank_crc32)) == len(want)
        assert (r.n_pieces, r.ids_crc32) == (r.rank_pieces[0], r.rank_crc32[0])
    names = P.parts_of("one two", lattice)
    lattice.prepare(set(names))
    base, found = P.choices_of(names, lattice, 4)
    wrong = [(s, {k: ids + ids[-4:] for k, ids in other.items()}) for s, other in found]     # spells a letter twice
    assert [ok for _, _, ok in P.digests(base, wrong, b"one two", lattice)] == [True] + [False] * 3


def test_forward_passes_of_bounded_size_agree(lattice, monkeypatch):
    texts = [f"\u2581word{k}{chr(0x4e00 + k)}" * (1 + k % 5) for k in range(60)]
    want = lattice.viterbi(texts)
    monkeypatch.setattr(P, "PASS", 50)
    assert lattice.viterbi(texts) == want


def test_hashes_are_found_by_their_upper_bits():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000):
        h = np.r_[rng.integers(0, 2 ** 63, n, dtype=np.uint64), np.uint64(2 ** 64 - 1)][-n:]
        table = P.Hashes(h)
        at, found = table.find(h)
        assert found.all() and (table.sorted[at] == h).all() and (h[table.order] == table.sorted[:-1]).all()
        other = rng.integers(0, 2 ** 64, 2000, dtype=np.uint64)
        assert table.find(np.r_[other, np.uint64(0)])[1].tolist() == np.isin(np.r_[other, np.uint64(0)], h).tolist()
