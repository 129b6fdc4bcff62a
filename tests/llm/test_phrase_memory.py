"""A task's memory while it counts phrases goes by the size of a block."""

import random
import tracemalloc

import numpy as np

from ripplemap.llm import phrases


def test_a_block_stays_small():
    rng = random.Random(3)
    names = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choices(names, k=200_000)).encode()
    texts = [line] * (phrases.BLOCK_BYTES // len(line) + 1)
    everything = phrases.Filter(np.full(1 << 10, 0xFFFFFFFFFFFFFFFF, np.uint64))
    tracemalloc.start()
    cut = phrases.Cut("en", texts)
    assert phrases._stripes(cut, 2, everything, None, set(), 64).num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak >> 20
