"""Text chunks keep all rows in order, whatever the batches."""

import pyarrow as pa
import pytest

from corpusloom.llm import common

TEXTS = [None, "", "a" * 5, "b" * 30, "é" * 4, None, "c", "d" * 9, "e" * 10, ""]


@pytest.mark.parametrize("size", [1, 2, 3, 10])
@pytest.mark.parametrize("limit", [1, 10, 20, 1000])
def test_rows_stay_in_order_within_the_bounds(size, limit, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_ROWS", 4)
    whole = pa.record_batch({"i": pa.array(range(len(TEXTS))), "text": pa.array(TEXTS, pa.string())})
    batches = [whole.slice(at, size) for at in range(0, len(TEXTS), size)] + [whole.slice(0, 0)]
    found = list(common.text_chunks(iter(batches), 1, limit))
    assert [x for b in found for x in b.column(1).to_pylist()] == TEXTS
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(len(TEXTS)))
    for b in found:
        filled = [len(t.encode()) for t in b.column(1).to_pylist() if t]
        assert 0 < b.num_rows <= 4
        assert sum(filled) <= limit or len(filled) == 1


def test_no_batches():
    assert list(common.text_chunks(iter([]), 0)) == []
