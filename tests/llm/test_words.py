import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from reference import blank_words, letter_words, shingles

from scriptorium.llm import words as W
from scriptorium.llm.superminhash import signatures

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB c\n\t.é0|", max_size=40)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    for separators, plain in ((W.BLANK, blank_words), (W.NO_LETTER, letter_words)):
        data, offsets = W.text_bytes(pa.array(texts, pa.string()))
        hashes, first, _, _ = W.word_hashes(W.lowered(data), offsets, separators)
        names = {}
        for i, text in enumerate(texts):
            own = plain(text)
            assert len(own) == first[i + 1] - first[i]
            for word, value in zip(own, hashes[first[i] : first[i + 1]].tolist()):
                assert names.setdefault(word, value) == value
        assert len(set(names.values())) == len(names)
        if separators is W.BLANK:
            _, edges = W.distinct(*W.shingle_hashes(hashes, first))
            assert np.diff(edges).tolist() == [len(shingles(t)) for t in texts]


def test_sliced_columns_keep_their_texts():
    column = pa.array(["ab cd", None, "ef", "gh ij kl"]).slice(2)
    data, offsets = W.text_bytes(column)
    assert W.word_spans(data, offsets)[2].tolist() == [0, 1, 4]


def test_hashes_do_not_depend_on_blocks():
    data = np.frombuffer(b"alpha beta gamma delta " * 50, np.uint8)
    starts, ends, _ = W.word_spans(data, np.array([0, len(data)]))
    assert (W.span_hashes(data, starts, ends, 16) == W.span_hashes(data, starts, ends)).all()


def test_signatures_estimate_similarity_with_less_variance():
    base = W.mix(np.arange(15, dtype=np.uint64))
    guesses = []
    for seed in range(300):
        own = W.mix(base + np.uint64(seed * 7919))
        table = signatures(np.concatenate([own[:12], own[3:]]), np.array([0, 12, 24]))
        guesses.append((table[0] == table[1]).mean())
    true = 9 / 15
    assert abs(np.mean(guesses) - true) < 0.01
    assert np.std(guesses) < 0.9 * (true * (1 - true) / 128) ** 0.5


def test_signatures_of_empty_and_equal_sets():
    own = W.mix(np.arange(400, dtype=np.uint64))
    table = signatures(np.concatenate([own, own]), np.array([0, 0, 400, 800, 800]))
    assert np.isinf(table[0]).all() and np.isinf(table[3]).all()
    assert (table[1] == table[2]).all() and np.isfinite(table[1]).all()
