"""What Python workers keep between tasks."""

import sys

import numpy as np
import pytest
from strandline.llm import _common


class Mapped:
    """Runs what it is given over no batches, as a worker would."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([])))


def resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_leaves_no_free_memory_behind():
    kept, peak = [], []

    def run(batches):
        held = [np.ones(1000) for _ in range(25_000)]
        kept.append(held[-1])  # what lies above the freed blocks keeps malloc from giving them back by itself
        peak.append(resident())
        del held
        yield from batches

    before = resident()
    _common.in_batches(Mapped(), run, "v long")
    assert peak[0] - before > 150 and resident() - before < 50


def test_bits_of_pairs_are_those_of_all_at_once():
    from strandline.llm import near_copies

    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, (50, near_copies.BITS // 64), dtype=np.uint64)
    for n in (0, 1, 4096, 9000):
        p, q = rng.integers(0, 50, (2, n))
        assert (near_copies._differing(fps, p, q) == np.bitwise_count(fps[p] ^ fps[q]).sum(axis=1)).all()
