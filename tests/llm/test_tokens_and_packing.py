import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from responsa.llm import packing, token_counts, tokens

ODD = ["", None, "a\x1cb", "Á É ΣΑΣ İstanbul", "<|endoftext|>x y<|startoftext|>", "it's 123 don'T !!! 　 日本語", "ﬁ a b c \x85 d", "x" * 3000, "ȩ́ ́a", " 'S 's", "\U0001f600😀 a'lla", "word " * 20_000]


def want(t):
    return tokens.encoder().library.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    for t, raw in zip(ODD, tokens.encoder().ids(ODD), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    enc = tokens.Encoder(tokens.vocabulary(), 20) if not hasattr(test_ids_of_any_text, "enc") else test_ids_of_any_text.enc
    test_ids_of_any_text.enc = enc  # a small cache, which is often renewed
    for t, raw in zip(texts, enc.ids(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want(t)


def test_other_vocabularies_are_encoded_whole():
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    for t, raw in zip(ODD[3:6], e.ids(ODD[3:6]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.library.encode(t, add_special_tokens=False).ids


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, piece int, sub string, rank int")


def test_packed_sequences_hold_the_documents(spark, make):
    texts = [make(i, 1 + i * 7 % 90) for i in range(120)] + ODD + [make(3, 3000)]
    rows = packing.pack(table(spark, texts + texts[:5]), with_ids=True).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = np.frombuffer(r.ids, "<u4")
        assert len(part) == r.length <= packing.SIZE and zlib.crc32(r.ids) == r.ids_crc32
        ids.setdefault(r.doc_id, []).append((r.start, part.tolist()))
    for i, t in enumerate(texts + texts[:5]):
        assert sum((p for _, p in ids[i]), []) == [*want(t), 1]
        assert [s for s, _ in ids[i]] == list(range(0, len(want(t)) + 1, packing.SIZE))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // packing.SIZE) + 1
    assert packing.pack(table(spark, [])).count() == 0


def check_plan(counts, size):
    plan = packing.make_plan(counts, size)
    fill, taken = {}, {}
    for n, first, places, each, seq, off in plan:
        for d in range(places):
            taken.setdefault(n, []).append(first + d)
            fill.setdefault(seq + d // each, []).append((off + d % each * n, n))
    assert {n: sorted(x) for n, x in taken.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(fill)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 9), max_size=12))
def test_plans_place_every_piece_once(counts):
    check_plan(counts, 32)


def test_exact_complements_are_found():
    assert check_plan({20: 4, 12: 2, 7: 2, 5: 2}, 32) == 4  # 20 + 12, and 20 + 7 + 5
    assert check_plan({20: 1, 6: 1, 4: 1, 2: 1}, 32) == 1  # three lengths fill the gap
    r = random.Random(1)
    counts = {n: r.randrange(200) for n in range(1, 2000)}
    total = sum(n * c for n, c in counts.items())
    assert check_plan(counts, 4096) <= -(-total // 4096) + 1


def test_token_counts(spark, make):
    texts = [make(i, i % 40) for i in range(100)] + [None, "", make(1, 2000)] + [make(5, 20)] * 30
    lengths = sorted(len(want(t)) for t in texts)
    got = token_counts.limits(token_counts.histogram(token_counts.lengths(table(spark, texts)))).collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(lengths))
    for r in got:
        le = [n for n in lengths if n <= r.n_tokens]
        assert (r.n_docs, r.docs_le, r.tokens_le, r.docs_gt, r.tokens_gt) == (lengths.count(r.n_tokens), len(le), sum(le), len(lengths) - len(le), sum(lengths) - sum(le))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths) and r.lost_total == sum(lengths) - r.truncated_total
        assert abs(r.quantile - len(le) / len(lengths)) < 1e-12
    assert token_counts.limits(token_counts.histogram(token_counts.lengths(table(spark, [])))).count() == 0


def test_words_are_cached_once_whatever_stands_beside_them():
    enc = tokens.Encoder(tokens.vocabulary())
    texts = [f"Straße{a} {b}straße ÉTÉ{a} {b}Été word{a} {b}WORD" for a in ".,;:!?)" for b in "([«"]
    assert enc.ids(texts) == [enc._whole(t) for t in texts]
    assert sum(len(x) for x in vars(enc).values() if isinstance(x, dict)) == 13  # 3 words and 10 marks


def test_texts_of_any_characters_are_as_the_library_has_them():
    enc, r = tokens.Encoder(tokens.vocabulary(), 500), random.Random(1)
    pool = [*map(chr, [*range(0x250), *range(0x2010, 0x2028)]), *"'s're  \t\n\x85\xa0\x1cİſßΣςσé́中😀ǅȺ" * 6]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(500)]
    assert enc.ids(texts) == [enc._whole(t) for t in texts]
