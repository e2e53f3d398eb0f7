"""What a worker takes at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sheafspark.llm import language_id
from sheafspark.llm.common import slices


def test_a_step_of_language_takes_little_at_once():
    texts = [f"words of row {i} that say nothing " * 30 for i in range(4000)]
    model = language_id.Model(list("abcd"), np.ones((language_id.BUCKETS, 4), np.float32), seen=np.ones(language_id.BUCKETS, bool))
    batch = pa.RecordBatch.from_pydict({"_text": texts})
    tracemalloc.start()
    n = sum(len(language_id.evidence(model, part.column("_text"))[0]) for part in slices(batch, "_text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts)
    assert peak < 64 << 20
