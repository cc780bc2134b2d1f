"""What the language model's steps cost: no Python code for single words, no new memory at each step."""

import sys
import tracemalloc

import numpy as np

from sessionlake.llm import masked_lm


def model_of(classes: int, slots: int = 1 << 16) -> masked_lm.Model:
    rng = np.random.default_rng(5)
    vocabulary = [b"w%d" % k for k in range(classes * classes - 1 - masked_lm.spare_ids(classes))]
    return masked_lm.Model(classes, vocabulary, rng.integers(0, 256, slots).astype(np.uint8), np.zeros(masked_lm.spare_ids(classes) + 1))


def test_words_beyond_the_vocabulary_are_met_by_the_batch():
    model = model_of(32)
    texts = [b" ".join(b"W%d" % (k * j) for k in range(3000)) for j in (1, 7, 11)] + [None, b"", b" \t", b"w1", b"w1 " * 40_000 + b"\xc3\x9cber"]
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    words = masked_lm.Words(model)
    sys.setprofile(seen)
    try:
        row, places, counts, _ = words.row(texts)
    finally:
        sys.setprofile(None)
    assert calls < counts.sum() / 1000, calls

    spare, known = masked_lm.spare_ids(32), {w: k for k, w in enumerate(model.vocabulary)}
    own = masked_lm.Words(model).row(texts)[3]
    want, codes, edge = [0] * masked_lm.WINDOW, [], [0] * masked_lm.WINDOW
    for t in texts:
        for w in masked_lm.tokens(t):
            at, slot = masked_lm.spare_and_slot(w, spare, len(model.counts))
            want.append(known[w] + 1 + spare if w in known else at)
            codes.append(0 if w in known else int(model.counts[slot]))
        want += edge
    assert row.tolist() == want and own.tolist() == codes
    assert counts.tolist() == [len(masked_lm.tokens(t)) for t in texts] and (row[places] > 0).all() and len(places) == counts.sum()


def test_steps_use_their_memory_again():
    classes = 64
    row = np.random.default_rng(2).integers(1, classes * classes, 30_000).astype(np.int32)
    places = np.arange(2, 4098)
    net = masked_lm.Network(classes)
    for step in (lambda: net.learn(row, places, 0.1), lambda: net.log_probabilities(row, places)):
        step()
        tracemalloc.start()
        try:
            step()
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 1 << 21, peak


def test_scores_do_not_rest_on_what_is_scored_with_them():
    net = masked_lm.Network(8)
    net.flat += np.random.default_rng(4).normal(0, 0.3, len(net.flat)).astype(np.float32)
    row = np.random.default_rng(6).integers(0, 64, 9000).astype(np.int32)
    places = np.random.default_rng(8).permutation(np.arange(2, 8998))
    whole = net.log_probabilities(row, places)
    assert np.allclose(whole[::500], [net.log_probabilities(row, places[k : k + 1])[0] for k in range(0, len(places), 500)], atol=1e-5)
    assert len(net.log_probabilities(row, places[:0])) == 0
