import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import alignment
from lexloom.llm.alignment import Tokenizers, align, byte_letters, default_tokenizers, linked_pairs, text_parts

PATH_A, PATH_B = default_tokenizers()
A, B = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
A.encode_special_tokens = True
LETTERS, WORDS = byte_letters(), {at: word for word, at in A.get_vocab().items()}


def bytes_a(at):
    return bytes(LETTERS[letter] for letter in WORDS[at])


def bytes_b(at):
    piece = B.id_to_piece(at)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(at) else piece.replace("▁", " ").encode()


def tokens_of(text):
    """Ids of the whole text, none where the text does not come back."""
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    same = b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode()
    return (a, b) if same else ([], [])


def plain(text):
    """(ids, ids, groups, links), token by token and byte by byte."""
    a, b = tokens_of(text)
    of_a = [at for at, token in enumerate(a) for _ in bytes_a(token)]
    of_b = [at for at, token in enumerate(b) for _ in bytes_b(token)]
    links = [(a[x], b[y]) for x, y in sorted(set(zip(of_a, of_b, strict=True)))]
    groups, first_a, first_b = [], 0, 0
    for place in range(len(of_a)):
        end = place + 1 == len(of_a)
        if end or of_a[place] != of_a[place + 1] and of_b[place] != of_b[place + 1]:
            x, y = of_a[place] + 1, of_b[place] + 1
            groups.append(",".join(map(str, a[first_a:x])) + "|" + ",".join(map(str, b[first_b:y])))
            first_a, first_b = x, y
    return a, b, groups, links


def wanted(docs):
    known = {}
    made = [(doc_id, *known.setdefault(text, plain(text))) for doc_id, text in docs]
    counts = Counter(link for *_, links in made for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for doc_id, a, b, groups, links in made:
        n_best = sum(counts[link] == best[link[1]] for link in links)
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(a), len(b), len(groups), len(links), n_best, sum(counts[link] for link in links), hashed))
    return sorted(rows, key=str), counts, best


ODD_TEXTS = [
    "a   b", " x", "x ", "  ", "a \n b", "x\n \ny", "x\n y  z", "▁x y", "日本語 テキスト。x 한국어 текст", "<|endoftext|> <s> hi</s>",
    "don't 'S x's", "y  　 z", "é ́x", "\x1c y \x00", "a  b", "a  b", "mit Straße ŒUVRE ǅ", "x" * 3000, "\U0001f600 \U0001f600a",
]


@pytest.mark.parametrize("head_pairs", [1_000_000, 40, 0])
def test_figures_are_those_of_whole_texts(documents, head_pairs):
    """With all pairs at hand in the tasks, with some, and with none."""
    docs = documents.limit(60)
    rows, _, _ = wanted([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, align(docs, head_pairs=head_pairs).collect()), key=str) == rows


def test_odd_rows(spark, odd_docs, no_docs):
    short = odd_docs.filter("coalesce(length(text), 0) < 60000")
    rows, _, _ = wanted([(r.doc_id, r.text) for r in short.collect()])
    assert sorted(map(tuple, align(short, head_pairs=100).collect()), key=str) == rows
    assert align(no_docs).count() == 0
    long = align(odd_docs.filter("doc_id = 10")).first()
    a, b = tokens_of(odd_docs.filter("doc_id = 10").first().text)
    assert (long.n_a, long.n_b) == (len(a), len(b))


def test_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    rows, counts, best = wanted(list(enumerate(ODD_TEXTS)))
    made = align(docs, with_groups=True).collect()
    assert sorted((tuple(row)[:8] for row in made), key=str) == rows
    assert {row.doc_id: row.groups for row in made} == {at: ";".join(plain(text)[2]) for at, text in enumerate(ODD_TEXTS)}
    pairs = {(row.a, row.b): (row.n, row.best) for row in linked_pairs(docs).collect()}
    assert pairs == {pair: (n, n == best[pair[1]]) for pair, n in counts.items()}


def test_nothing_changes_when_what_is_known_is_forgotten(documents, monkeypatch):
    docs = documents.limit(30).coalesce(1)
    before = sorted(map(tuple, align(docs).collect()), key=str)
    run = alignment.figures(PATH_A, PATH_B, type("Shared", (), {"value": alignment.Head(alignment.head_of(linked_pairs(docs), 10**6)[1])}), "x", False)
    for name in ("KNOWN_PARTS", "TEXT_ROWS"):
        monkeypatch.setattr(alignment, name, 3)
    monkeypatch.setattr(alignment, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda self: 0})())}))
    rows = docs.selectExpr("doc_id", "cast(text AS binary) AS text").toArrow().to_batches()
    made = [tuple(row[name] for name in alignment.FIGURE_NAMES) for batch in run(iter(rows)) for row in batch.to_pylist()]
    assert sorted(made, key=str) == before


BOTH = Tokenizers(PATH_A, PATH_B)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t 　ab.é日1'▁"), max_size=14))
def test_any_text_has_the_ids_of_its_parts(text):
    good, of_a, of_b = BOTH(text_parts(text.encode()))
    made = (sum(of_a, []), sum(of_b, [])) if good.all() else ([], [])
    assert made == tokens_of(text)
