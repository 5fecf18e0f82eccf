"""Offsets and windows on very long texts, and running sums over lists."""

import time

import pyarrow as pa

from clauseloom.operators import passages

SENTENCES = 200_000


def test_sums_before_start_anew_with_each_list():
    lists = pa.array([[3, 4, 5], [], None, [7], [1, 1]], pa.list_(pa.int32()))
    assert passages.sums_before(lists).to_pylist() == [[0, 3, 7], [], None, [0], [0, 1]]
    assert passages.sums_before(lists.slice(3)).to_pylist() == [[0], [0, 1]]
    assert passages.sums_before(lists.slice(0, 0)).to_pylist() == []


def test_a_text_of_very_many_sentences_takes_seconds(spark):
    parts = [f"..é😀 item {i} says {'terminate' if i % 100 == 0 else 'nothing'}." for i in range(SENTENCES)]
    text = "".join(parts)
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "contract_id long, text string")
    passages.merged_passages(frame.filter("contract_id > 1")).collect()  # starts the workers
    start = time.perf_counter()
    offsets = passages.sentence_offsets(frame).collect()
    windows = passages.context_windows(frame).collect()
    merged = passages.merged_passages(frame).collect()
    assert time.perf_counter() - start < 60
    assert len(windows) == SENTENCES // 100
    for r in windows[:: 500]:
        assert r["passage"] == text[r["first"] : r["last"]]
    for r in offsets[:: 9_999]:
        assert text[r["start"] + r["length"] - 1] == "."
    assert sum(r["length"] for r in offsets) + offsets[0]["start"] == len(text)
    assert all(text[r["first"] : r["last"]] == r["passage"] for r in merged)
