import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mapframe.llm import common

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZé 日\n\t\x0b-9🙂", max_size=12)), max_size=8)
LOWER = {c: c + 32 for c in range(65, 91)}


@given(TEXTS, st.sampled_from([(common.WHITE, r"[^\x20\x09-\x0D]+"), (common.NOT_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]))
def test_words_are_those_of_the_pattern(texts, kind):
    flat, at = common.words(common.text_of(pa.array(texts, pa.string())), kind[0])
    found = flat.to_pylist()
    assert [found[a:b] for a, b in zip(at, at[1:])] == [re.findall(kind[1], (t or "").translate(LOWER)) for t in texts]


@given(TEXTS, st.integers(1, 5), st.integers(1, 30))
def test_blocks_keep_rows_and_order(texts, size, most):
    whole = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(common.blocks((whole.slice(k, size) for k in range(0, len(texts), size)), most=most))
    assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist()
    for p in parts:
        assert p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5))))
def test_ranges(pairs):
    starts, lengths = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    assert common.ranges(starts, lengths).tolist() == [x for s, n in pairs for x in range(s, s + n)]


def test_written_tables(spark):
    before = common.shared_dir(spark)
    assert before == common.shared_dir(spark)
    frame = common.written(spark.range(3), "t")
    assert frame._mapframe_path.startswith(before) and frame.count() == 3
    common.drop_written(frame)
    with pytest.raises(Exception):
        spark.read.parquet(frame._mapframe_path).count()


class Session:
    """What :func:`shared_dir` asks of a session."""

    def __init__(self, setting, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: setting)})
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_is_the_sessions():
    assert common.shared_dir(Session("hdfs:///shared/", "spark://host:7077")) == "hdfs:///shared"
    assert common.shared_dir(Session("hdfs:///shared", "local[2]")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(None, "local-cluster[2,1,1024]"))
