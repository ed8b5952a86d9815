"""Sum-of-squares bin packing, without Spark."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Place pieces one by one, longest first, each in the open bin where the sum over gaps of the squared count of open bins with that gap becomes smallest.

    lengths: whole numbers from 1 to capacity. Ties go to the smallest gap, so to the fullest bin; a new bin is opened
    only where no open one has room, as few bins are wanted. Returns each piece's bin, its offset in the bin, and the
    number of bins. Equal lengths keep their order.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    # counts[g]: open bins with gap g; full bins (gap 0) are closed, and no bin is open with the whole capacity.
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # Moving a bin from gap g to g - size changes the sum by 2 (counts[g - size] - counts[g] + 1), filling it by 1 - 2 counts[g].
        before = counts[size:]
        change = 2 * (counts[: capacity + 1 - size] - before + 1)
        change[0] = 1 - 2 * before[0]
        change[before == 0] = NONE
        at = int(np.argmin(change))
        if change[at] < NONE:
            gap = at + size
            chosen = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen = capacity, made
            made += 1
        bins[i], offsets[i] = chosen, capacity - gap
        if left := gap - size:
            counts[left] += 1
            open_bins.setdefault(left, []).append(chosen)
    return bins, offsets, made
