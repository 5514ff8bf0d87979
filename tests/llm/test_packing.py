import random
import zlib

import numpy as np

from histshift.llm import packing as K
from tests.llm.fixtures import frame


def fewest(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest[rest.index(room)] -= lengths[i]
            place(i + 1, rest)
        place(i + 1, [*rooms, capacity - lengths[i]])
    place(0, [])
    return best[0] if lengths else 0


def test_pack_is_optimal_on_small_instances():
    rng = random.Random(11)
    for _ in range(300):
        capacity = rng.choice([10, 17, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(11))]
        bins = K.pack(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= capacity for b in bins)
        assert K.lower_bound(lengths, capacity) <= len(bins) == fewest(lengths, capacity) if lengths else not bins


def test_bin_completion_beats_best_fit_where_that_is_wasteful():
    lengths, capacity = [6, 5, 5, 4, 4, 3, 3], 10       # 30 in all; best-fit leaves room
    assert len(K.complete(lengths, capacity, 3)) == 3 and K.complete([6, 6, 6], 10, 2) is None
    many = lengths * 40
    assert len(K.pack(many, capacity)) == 120


def test_large_shards_come_near_the_bound_and_lose_nothing():
    rng = random.Random(5)
    for low, high, most in ((300, 700, 6), (1, 2047, 16), (500, 520, 16)):
        lengths = [rng.randint(low, high) for _ in range(16_384)]
        bins = K.pack(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
        assert K.lower_bound(lengths, 2048) <= len(bins) <= K.lower_bound(lengths, 2048) + most
        assert len(bins) <= len(K.best_fit(lengths, 2048))


def test_the_fullest_filling_is_found():
    rng = random.Random(2)
    for _ in range(300):
        pieces = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(0, 80)
        have = {s: pieces.count(s) for s in pieces}
        order = list(have)
        rng.shuffle(order)
        fill = K.fullest(order, have, room)
        sums = {0}
        for x in pieces:
            sums |= {s + x for s in sums if s + x <= room}
        assert sum(fill) == max(sums) and all(fill.count(s) <= have[s] for s in fill)


def test_fillings_are_undominated():
    assert K.fillings([5, 4, 3, 2, 1], 5)[0] in ([5], [4, 1], [3, 2])
    assert [4] not in K.fillings([5, 4, 3], 5) and K.fillings([9], 5) == [[]]


def test_ids_equal_the_tokenizers(spark):
    encoder = K.WordEncoder(K.VOCABULARY)
    rng = random.Random(3)
    alphabet = [*"aBc\u00e9 \u00c8\u00df\u00ff\u0178\u00d7\u00f7'sT12.,|$#<>&\n\t\x1c\x7f\u00a0\u2003\u0130\u212a\U0001d54f\u6f22\u0301\u017f",
                "<|endoftext|>", "<|", "'ll", "word", "verylong" * 12]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == want, text


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 7)
    df = frame(spark).select("doc_id", "text", "lang")
    rows = K.pack_documents(df, capacity=64, keep_ids=True).collect()
    tokenizer = K.WordEncoder(K.VOCABULARY).tokenizer
    want = []
    for r in df.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k // 64, k, ids[k:k + 64]) for k in range(0, len(ids), 64)]
    got = [(r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert K.pack_documents(frame(spark, [])).count() == 0
