from pathlib import Path

import numpy as np

from glyphmill.llm.shared import returning


def held():
    """MB that this process holds for itself."""
    lines = Path("/proc/self/smaps_rollup").read_text().splitlines()
    return next(int(x.split()[1]) for x in lines if x.startswith("Private_Dirty")) / 1024


def test_a_task_gives_its_memory_back():
    """Memory between pieces that stay is returned as well, once the results are all read."""
    stay = []

    def task():
        parts = []
        for k in range(3_000):
            parts.append(np.ones(12_000))
            if k % 10 == 0:
                stay.append(np.ones(1_000))
        yield held()

    before = held()
    (most,) = returning(task())
    assert most - before > 250 and held() - before < 0.3 * (most - before)
