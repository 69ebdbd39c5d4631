import pyarrow as pa

from lectern.llm.common import text_slices


def test_slices_are_the_column():
    texts = ["a" * 5, None, "é" * 12, "", "b", "c" * 9, "d" * 30, None]
    got = list(text_slices(pa.array(texts), 10))
    assert [t for _, _, own in got for t in own] == [t or "" for t in texts]
    assert [(a, b) for a, b, _ in got] == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]
    assert list(text_slices(pa.array([], pa.string()), 10)) == []
