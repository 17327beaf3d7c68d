import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm.packing import BestFit, WordTokens, best_fit, default_tokenizer, pack, sequences, token_pieces


WORDS, TOKENIZER = WordTokens(default_tokenizer()), Tokenizer.from_file(default_tokenizer())


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_those_of_whole_texts(documents):
    words, tokenizer = WordTokens(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = [row.text for row in documents.limit(120).collect()]
    texts += ["Foo<|endoftext|>bar", "don't can't 'S x's", "İstanbul ŒUVRE ÿÝ ß", "a\x1cb\x85c", "é É ́q", "A×B÷b x!!%%% a<|b|>", "", " \n"]
    for text, found in zip(texts, words([text.encode() for text in texts]), strict=True):
        assert found.tolist() == whole_ids(tokenizer, text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_has_the_ids_of_the_whole(texts):
    raw = [text.encode("utf-8", "replace") for text in texts]
    for text, found in zip(raw, WORDS(raw), strict=True):
        assert found.tolist() == whole_ids(TOKENIZER, text.decode())[:-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_takes_the_fullest_bin_that_fits(sizes, open_bins):
    """Against a plain list of open bins; among bins of the same free space any may be taken."""
    bins, free, fullest = BestFit(20, open_bins), {}, set()
    for size in sizes:
        number, offset = bins.place(size)
        fitting = [left for at, left in free.items() if left >= size and at not in fullest]
        if number in free:
            assert free[number] == min(fitting) and offset == 20 - free[number]
        else:
            assert not fitting and offset == 0
            open_now = [at for at, left in free.items() if left and at not in fullest]
            if len(open_now) == open_bins and size < 20:
                least = min(free[at] for at in open_now)
                closed = [at for at in open_now if free[at] == least and at not in bins._bins[least]]
                assert len(closed) == 1
                fullest.add(closed[0])
        free[number] = free.get(number, 20) - size
        assert free[number] >= 0


def check_places(rows, length=2048):
    held = defaultdict(list)
    for row in rows:
        held[row.sequence_id].append((row.offset, row.length))
    for pieces in held.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= length
    return len(held)


def test_documents_are_packed_whole(documents):
    rows, texts = pack(documents, with_ids=False).collect(), {row.doc_id: row.text for row in documents.collect()}
    tokenizer, pieces = Tokenizer.from_file(default_tokenizer()), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, cuts = np.array(whole_ids(tokenizer, text), "<u4"), sorted(pieces[doc_id], key=lambda row: row.piece)
        assert [(row.piece, row.start) for row in cuts] == [(n, 2048 * n) for n in range(len(cuts))]
        assert sum(row.length for row in cuts) == len(ids)
        assert [row.ids_crc32 for row in cuts] == [zlib.crc32(ids[row.start : row.start + row.length].tobytes()) for row in cuts]
    used = check_places(rows)
    assert used <= 1.1 * -(-sum(row.length for row in rows) // 2048) + 2


def test_odd_rows(odd_docs, no_docs):
    rows = pack(odd_docs).collect()
    check_places(rows)
    by = defaultdict(list)
    for row in rows:
        by[row.doc_id].append(row)
    assert [(row.length, row.ids) for row in by[4]] == [(1, [0])] == [(row.length, row.ids) for row in by[5]]
    assert len(by[2]) == 2 and len(by[None]) == 2 and len(by[10]) > 10
    assert pack(no_docs).count() == 0


def test_sequences_are_made_of_their_pieces(odd_docs):
    packed = best_fit(token_pieces(odd_docs), 2, open_bins=1)
    rows, made = packed.collect(), {row.sequence_id: row.input_ids for row in sequences(packed).collect()}
    assert len(made) == check_places(rows)
    for row in rows:
        assert made[row.sequence_id][row.offset : row.offset + row.length] == row.ids


def test_a_worker_keeps_no_more_words_than_asked_for():
    texts = [" ".join(f"w{at}x{word}" for word in range(50)).encode() for at in range(40)]
    few = WordTokens(default_tokenizer(), known_words=100)
    for text in texts:
        assert few([text])[0].tolist() == WORDS([text])[0].tolist()
        assert len(few._at) <= 150 and len(few._parts) <= 250
