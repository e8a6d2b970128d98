"""Packing: exact ids, gapless places, few sequences."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "a.,b Éa, İx ǆ", "x _. y._z 1.5 3,4 .a ,b Ab.C", "<|endoftext|> x", "x <|STARTOFTEXT|> y.", "it's we'll 'd", "é e ́ ﬁ ß SS ẞ µ ×. ÷,", "a\tb\nc\x0bd\x1ce\x85f\xa0g h", "..., --- &&&. the%%%,", "中文 日本。", "¿qué? ¡sí!", "a" * 300, "\x00 \x7f."]


def same(tokenizer, texts, cache):
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert cache.ids(texts) == want


def test_ids(tokenizer):
    cache = packing.WordCache(PATH)
    same(tokenizer, ODD, cache)
    small = packing.WordCache(PATH, most=5)
    for t in ODD * 2:
        same(tokenizer, [t, t + " " + t], small)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbÉßİŒ 1.,_'\"\n\t-·×é́中"), max_size=30))
def test_ids_of_any_text(text):
    cache = packing._cache(PATH)
    same(cache.tokenizer, [text], cache)


def check_plan(counts, capacity):
    plan = packing.plan(counts, capacity)
    places, bins = packing.Places(plan.ranges), defaultdict(list)
    for length, n in counts.items():
        if n:
            sequence, offset = places.find(np.full(n, length, np.int64), np.arange(n))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                bins[s].append((o, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plan.sequences
    return plan.sequences


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 40), max_size=15))))
def test_plans_are_gapless(case):
    capacity, counts = case
    used = check_plan(counts, capacity)
    # No more than first-fit decreasing would take at worst.
    assert used <= 11 / 9 * -(-sum(n * c for n, c in counts.items()) // capacity) * 2 + 1


def test_combinations_fill_exactly():
    assert check_plan({6: 10, 4: 10}, 10) == 10
    assert check_plan({5: 4, 3: 4, 2: 4}, 10) == 4
    assert check_plan({4: 3, 3: 6, 2: 3, 1: 12}, 12) == 4
    r = random.Random(2)
    counts = Counter(r.randint(1, 700) for _ in range(30_000))
    assert check_plan(counts, 2048) <= 1.001 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_no_exact_combination_is_left():
    r = np.random.default_rng(0)
    for capacity, n, low, high in ((60, 40, 1, 60), (60, 300, 8, 25), (97, 500, 15, 35), (200, 2000, 35, 70)):
        plan = packing.Plan(Counter(r.integers(low, high, n).tolist()), capacity)
        plan.exact()
        left = sorted(plan.left)
        for k in range(1, 5):
            for lengths in itertools.combinations_with_replacement(left, k):
                assert sum(lengths) != capacity or any(lengths.count(x) > plan.left[x] for x in lengths)


def test_narrow_lengths_fill_sequences():
    counts = Counter(np.random.default_rng(1).normal(500, 50, 200_000).round().astype(int).tolist())
    assert check_plan(counts, 2048) <= 50_100


def test_pack(spark, docs, tokenizer, clashing):
    r = random.Random(4)
    texts = [None, "", *ODD, *[" ".join(r.choice(["the", "Of,", "mountain.", "x"]) for _ in range(r.choice([3, 30, 300, 3000]))) for _ in range(60)], "the of", "the of"]
    rows = packing.pack(clashing(docs(texts)), PATH).collect()
    pieces = defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append(x)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[i], key=lambda x: x.piece)
        assert [x.piece for x in got] == list(range(-(-len(ids) // 2048)))
        for x in got:
            part = ids[x.start : x.start + 2048]
            assert (x.start, x.length, x.ids_crc32) == (2048 * x.piece, len(part), zlib.crc32(part.tobytes()))
    bins = defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(x.length for x in rows) // 2048) + 1


def test_cases(docs):
    assert packing.pack(docs([]), PATH).count() == 0
    rows = packing.pack(docs(["a b", "a b", None], ids=[1, 1, None]), PATH).collect()
    assert len(rows) == 3 and len({(x.sequence_id, x.offset) for x in rows}) == 3


def test_no_exact_combination_is_left():
    """By trying all combinations of up to four pieces that are left."""
    import random
    from itertools import combinations_with_replacement

    r = random.Random(14)
    for capacity in (12, 30, 64):
        for _ in range(40):
            counts = {n: r.randint(1, 6) for n in r.sample(range(1, capacity + 1), r.randint(1, min(12, capacity)))}
            made = packing.Plan(dict(counts), capacity)
            made.exact()
            for k in (1, 2, 3, 4):
                for lengths in combinations_with_replacement(sorted(made.left), k):
                    assert sum(lengths) != capacity or not made.fits(lengths), (counts, lengths)
            used = sum(n * c for n, c in counts.items()) - sum(n * c for n, c in made.left.items())
            assert used == made.sequences * capacity
