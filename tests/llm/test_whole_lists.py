"""Index lists that come in parts."""

import numpy as np
import pyarrow as pa

from freshet.llm.jaccard_join import _runs


def test_tail_of_a_cut_list_is_a_part():
    token = np.r_[np.ones(12, np.int64), np.full(3, 2), np.full(2, 3)]
    key = np.arange(17)
    for size in (4, 5, 6, 11):
        batches = [pa.RecordBatch.from_pydict({"token": token[i : i + size], "set_id": key[i : i + size]}) for i in range(0, 17, size)]
        seen: dict[int, set] = {}
        for (t, k), part in _runs(iter(batches), 8):
            for x in np.unique(t):
                seen.setdefault(int(x), set()).add(part)
        assert seen == {1: {True}, 2: {False}, 3: {False}}, (size, seen)
