"""Word features of the language identifier, side by side and one by one."""

from __future__ import annotations

import numpy as np
import pytest

from quillspan.llm import langid

WORDS = ["a", "hello", "zoé", "straße", "漢字", "ʰa", "x" * 300, "Über", "the", "a"]


@pytest.mark.parametrize("buckets", [2, 64, 1 << 15])
def test_features_of_all_words_are_those_of_each(buckets):
    flat, starts = langid.features_of(WORDS, buckets)
    assert [part.tolist() for part in np.split(flat, starts[1:])] == [langid.features(w, buckets) for w in WORDS]


def test_a_word_with_a_script_no_language_has_tells_nothing():
    model = langid.Model(["de", "ja"], np.log(np.random.default_rng(3).random((64, 2)) + 0.1).astype(np.float32),
                         {"Latin": np.array([True, False]), "Han": np.array([False, True])})
    scores = model.word_scores(["hello", "漢字", "αβγ", "zoé"])
    assert scores.argmax(axis=1).tolist() == [0, 1, 0, 0] and scores[2].tolist() == [0, 0]
    assert (scores[[0, 3], 1] < -1e5).all() and scores[1, 0] < -1e5
