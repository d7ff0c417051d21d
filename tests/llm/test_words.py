import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from caseloom.llm import arrow

TEXTS = st.lists(st.one_of(st.none(), st.text("ab é\n\t\x0b 日", max_size=30)), min_size=1, max_size=6)


@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    w = arrow.words(pa.array(texts, pa.string()))
    found = [w.unique[i].as_py().decode() for i in w.ids.tolist()]
    wanted = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert found == [x for t in wanted for x in t]
    assert np.diff(w.bounds).tolist() == [len(t) for t in wanted]


@given(TEXTS, st.integers(1, 4))
def test_windows_stay_in_their_text(texts, size):
    w = arrow.words(pa.array(texts, pa.string()))
    starts = np.flatnonzero(arrow.window_starts(w.bounds, size)).tolist()
    wanted = [a + i for a, b in zip(w.bounds, w.bounds[1:]) for i in range(b - a - size + 1)]
    assert starts == wanted


def test_slices_hold_whole_rows_and_all_of_them():
    batch = pa.record_batch({"text": ["x" * 10, None, "y" * 100, "", "z" * 3]})
    parts = list(arrow.sliced([batch], limit=20))
    assert len(parts) > 1
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_sliced_arrays_are_read_at_their_offset():
    texts = pa.array(["skip me", "a bb", "ccc"]).slice(1)
    w = arrow.words(texts)
    assert [w.unique[i].as_py() for i in w.ids.tolist()] == [b"a", b"bb", b"ccc"]
