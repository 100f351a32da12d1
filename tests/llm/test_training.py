import tracemalloc

import numpy as np

from sparkloom.llm import training


def test_steps_over_a_sample_take_little_memory_and_equal_those_over_all_of_it():
    draw = np.random.default_rng(5)
    sample = training.Sample.__new__(training.Sample)
    lengths = draw.integers(0, 3000, 1000)
    lengths[[0, 7, -1]] = 0  # rows without features
    sample.y = np.zeros(len(lengths), np.int64)
    sample.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    sample.slots = draw.integers(0, 2 * training.SLOTS, len(sample.row)).astype("<i4")
    sample.values = draw.random(len(sample.row)).astype("<f4")
    w, per_row = draw.standard_normal(2 * training.SLOTS), draw.standard_normal(len(lengths))
    tracemalloc.start()
    margins, gradient = sample.margins(w), sample.gradient(per_row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(sample.row)
    assert np.allclose(margins, np.bincount(sample.row, w[sample.slots] * sample.values, len(lengths)))
    assert np.allclose(gradient, np.bincount(sample.slots, per_row[sample.row] * sample.values, 2 * training.SLOTS))
