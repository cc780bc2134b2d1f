"""One step of the language model's training against finite differences."""

import numpy as np

from sessionlake.llm import masked_lm


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(3)
    classes = 6
    net = masked_lm.Network(classes)
    net.flat += rng.normal(0, 0.3, len(net.flat)).astype(np.float32)
    row = rng.integers(0, classes * classes, 40).astype(np.int32)
    places = np.array([5, 6, 9, 13, 20, 21, 30, 33])
    start = net.flat.copy()

    def loss(flat):
        return -masked_lm.Network(classes, flat).log_probabilities(row, places).mean()

    net.squares = masked_lm.Network(classes, np.ones_like(net.flat)).p  # a step of rate 1 is then g / sqrt(1 + g * g)
    net.learn(row, places, 1.0)
    step = (start - net.flat).astype(np.float64)
    told = step / np.sqrt(1 - step**2)
    moved = np.flatnonzero(np.abs(told) > 3e-3)
    assert len(moved) > 300
    for k in [*rng.choice(moved, 120, replace=False), *rng.choice(len(start), 40, replace=False)]:
        up, down = start.copy(), start.copy()
        up[k] += 0.01
        down[k] -= 0.01
        want = (loss(up) - loss(down)) / (float(up[k]) - float(down[k]))
        assert abs(told[k] - want) < 2e-3 + 0.03 * abs(want), (k, told[k], want)
    untouched = start == net.flat
    assert untouched.any() and net.log_probabilities(row, places).mean() > -loss(start)
