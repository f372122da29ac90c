"""What is done with is not held on to."""

import numpy as np
import pyarrow as pa

from sparkfeat.llm import textscan as ts


def test_a_group_is_not_held_while_it_is_worked_on():
    def batches():
        for k in [1] * 10 + [2]:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1000, k)), pa.array(["x" * 1000] * 1000)], names=["k", "text"])

    before, groups = pa.total_allocated_bytes(), ts.grouped(batches(), "k")
    group = next(groups)
    assert group.num_rows == 10_000 and pa.total_allocated_bytes() - before > 10_000_000
    del group
    assert pa.total_allocated_bytes() - before < 3_000_000
    assert [g.num_rows for g in groups] == [1000]
