import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm.harmonic import HarmonicBins, cut_plan, harmonic_pack, padding, powers_of_two
from lexloom.llm.packing import default_tokenizer


def check(rows, wanted):
    """Every id once, in order; sequences without gaps and of at most 2048 tokens. wanted: a bag of (doc_id, ids)."""
    held, pieces = defaultdict(list), defaultdict(list)
    for row in rows:
        held[row.sequence_id].append((row.offset, row.length))
        pieces[row.doc_id, row.doc_tokens].append((row.start, row.length, row.ids_crc32, row.ids))
    for placed in held.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
    for (doc_id, n), found in pieces.items():
        texts = [ids for other, ids in wanted if other == doc_id and len(ids) == n]
        by_start = defaultdict(list)
        for start, length, crc, ids in found:
            assert len(ids) == length and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            by_start[start].append(ids)
        assert sum(length for _, length, _, _ in found) == n * len(texts)
        for text in texts:
            at = 0
            while at < n:
                piece = next(ids for ids in by_start[at] if ids == text[at : at + len(ids)])
                by_start[at].remove(piece)
                at += len(piece)
    assert sorted(map(str, wanted)) == sorted(str((k[0], ids)) for k in pieces for o, ids in wanted if (o, len(ids)) == k)
    return sum(2048 - sum(n for _, n in placed) for placed in held.values() if sum(n for _, n in placed).bit_count() != 1)


def whole_ids(docs):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]


def test_every_id_lies_in_one_piece_and_little_is_padded(documents):
    packed = harmonic_pack(documents).collect()
    wanted = whole_ids(documents)
    padded = check(packed, wanted)
    assert padded <= 0.002 * sum(len(ids) for _, ids in wanted)


def test_odd_rows(spark, odd_docs, no_docs):
    check(harmonic_pack(odd_docs).collect(), whole_ids(odd_docs))
    check(harmonic_pack(odd_docs.repartition(3), stored=True).collect(), whole_ids(odd_docs))
    assert harmonic_pack(no_docs).count() == 0
    assert padding(harmonic_pack(odd_docs)).first().n_padding < 500


def test_reruns_agree(documents):
    one, two = (sorted(map(tuple, harmonic_pack(documents, with_ids=False).collect()), key=str) for _ in range(2))
    assert one == two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([0.0, 1.0, 4.0]))
def test_bins_of_a_class_hold_as_many_pieces_as_the_class_says(lengths, cost):
    bins, placed = HarmonicBins(64, 5, cost), defaultdict(list)
    for doc, length in enumerate(lengths):
        for piece in bins.add(doc, np.arange(length)):
            placed[piece[4]].append(len(piece[2]))
    for pieces in placed.values():
        assert {64 // n for n in pieces} == {len(pieces)} and sum(pieces) <= 64
    rest = defaultdict(int)
    for piece in bins.rest():
        rest[piece[4]] += len(piece[2])
    assert all(n.bit_count() == 1 for n in rest.values())
    assert sum(map(sum, placed.values())) + sum(rest.values()) == sum(lengths)
    assert not set(placed) & set(rest)


def test_plans_are_the_best_of_all_cuts():
    """Against trying every first piece; without a cost for cuts nothing is padded."""

    def least(length, known={0: 0.0}):
        if length not in known:
            known[length] = min(16 / (16 // n) - n + 1.0 + least(length - n) for n in range(1, length + 1))
        return known[length]

    for length, plan in enumerate(cut_plan(16)):
        assert sum(plan) == length and abs(sum(16 / (16 // n) - n + 1.0 for n in plan) - least(length)) < 1e-9
    assert all(16 % n == 0 for plan in cut_plan(16, 0.0) for n in plan)
    assert powers_of_two(2048 * 2 + 1300, 2048) == [2048, 2048, 1024, 256, 16, 4]
