import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_duplicates import groups
from tidemark.llm import simhash


@pytest.mark.parametrize("distance", [3, 8])
def test_entries_follow_the_fingerprints(distance):
    """A fingerprint has no more entries among many fingerprints than among few; those of a value are split in its task."""
    sample = np.sort(np.random.default_rng(6).integers(0, 2**63, simhash.SAMPLE).astype(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(sample[:10].view(np.int64))], ["fp"])
    made = [sum(b.num_rows for b in simhash.entries(simhash.plan(sample, n, distance))(iter([batch]))) for n in (50_000, 250_000, 15_000_000)]
    assert made == [made[0]] * 3


@pytest.mark.parametrize("direct", [16, 1 << 20])
def test_values_split_in_their_task(monkeypatch, direct):
    """Clusters around chains of centres, all in one value: split by the other bits or compared directly, the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(7)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(30):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))))
    fp = np.array(sorted(values), np.uint64)
    for block, height in ((1024, 128), (8, 3)):
        forest = simhash.Forest(len(fp))
        simhash.link(fp, np.ones(len(fp), bool), 8, forest, np.arange(len(fp)), block=block, height=height)
        want = groups(fp.tolist(), 8)
        assert {int(v): int(fp[forest.find(i)]) for i, v in enumerate(fp)} == want
