"""The running lists of the table scan against one sort of all rows."""

import numpy as np
import pyarrow as pa
import pytest

from polysema.llm import ann


def test_blocks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    r = np.random.default_rng(3)
    codes = r.integers(0, 256, (37, 4), dtype=np.uint8)
    t = pa.table({"rep": np.arange(37), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "half": np.arange(37) / 2.0, "own": pa.array([np.full(3, i, np.float32).tobytes() for i in range(37)], pa.binary())})
    blocks = list(ann.runs(iter(t.to_batches(max_chunksize=4)), np.float32))
    assert [len(b[0]) for b in blocks] == [12, 12, 12, 1]
    assert np.array_equal(np.concatenate([b[1].T for b in blocks]), codes) and np.array_equal(np.concatenate([b[2] for b in blocks]), np.arange(37, dtype=np.float32) / 2)
    assert np.array_equal(np.concatenate([b[3] for b in blocks]), np.repeat(np.arange(37, dtype=np.float32), 3).reshape(37, 3))
    assert list(ann.runs(iter([]))) == []


def test_running_list_is_the_nearest_of_all_with_ties():
    r = np.random.default_rng(4)
    ids, distance = r.permutation(60), r.integers(0, 6, 60).astype(float)
    held = (np.empty(0, np.int64), np.empty(0))
    for at in range(0, 60, 7):
        held = ann.nearer(held, ids[at : at + 7], distance[at : at + 7], 5)
    want = np.lexsort((ids, distance))[:5]
    assert held[0].tolist() == ids[want].tolist() and held[1].tolist() == distance[want].tolist()


def test_shortlist_keeps_ties():
    assert ann.shortlist(np.array([1.0, 5, 2, 5, 2, 2, 0]), 3).tolist() == [1, 2, 3, 4, 5]
    assert ann.shortlist(np.array([1.0, 0]), 3).tolist() == [0, 1]


@pytest.mark.parametrize("n, dense", [(500, 0), (4000, 0), (4000, 1500)])
def test_recall_does_not_fall_with_blocks_or_in_dense_groups(n, dense, monkeypatch):
    """A third of the rows may lie so close together that their codes are nearly equal."""
    monkeypatch.setattr(ann, "BLOCK", 500)
    monkeypatch.setattr(ann, "SHORTLIST", 50)
    r = np.random.default_rng(5)
    x = r.standard_normal((n, 32))
    x[:dense] = x[0] + 0.05 * x[:dense]
    x = x[r.permutation(n)]
    books = ann.fit(x[:500])
    codes = ann.packed(ann.encode(ann.padded(x), books))
    t = pa.table({"rep": np.arange(n), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "half": (x * x).sum(1) / 2, "own": pa.array([v.tobytes() for v in x], pa.binary())})
    hit = 0
    for q in range(0, 500, 25):
        held = (np.empty(0, np.int64), np.empty(0))
        for ids, code, half, own in ann.runs(iter(t.to_batches(max_chunksize=250))):
            score = ann.scan(code, half, ann.tables(x[q : q + 1], books)[0])
            held = ann.measured(held, x[q], books.error(x[q : q + 1])[0], score, ids, own, 11)
        hit += len(set(np.argsort(((x - x[q]) ** 2).sum(1))[:11].tolist()) & set(held[0].tolist()))
    assert hit >= 0.97 * 20 * 11
