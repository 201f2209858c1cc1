from collections import Counter

import corpus_pipeline as cp
from mapframe.llm.common import written
from tests.llm.test_packing_tokens import BYTE, check_packed, expected
from tests.llm.test_text_joins import clusters, hits, one_edit

DATA = "/root/testdata/sf0.001"


def stage(name):
    return dict(cp.STAGES)[name]


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = written(stage("quality_classifier")(spark, docs, DATA), "t")
    assert kept.columns == docs.columns
    ids = {d for d, _ in rows_of(kept)}
    told = [(d in ids) == bool(q) for d, q in labels.items()]
    assert sum(told) > 0.9 * len(told) and all(d in ids for d, q in labels.items() if q == 1)

    lines = written(stage("line_dedup")(spark, kept, DATA), "t")
    assert lines.columns == docs.columns
    seen, want = [], {}
    for d, t in sorted(rows_of(kept)):
        left = []
        for line in t.split("\n"):
            w = line.split()
            if not w or not any(w == o or len(w) >= 5 and len(o) >= 5 and one_edit(o, w) for o in seen):
                left.append(line)
            seen.append(w)
        text = "\n".join(left)
        if text == t or text.split():
            want[d] = text
    assert dict(rows_of(lines)) == want

    one = written(stage("simhash_near_dedup")(spark, lines, DATA), "t")
    found = clusters(rows_of(lines))
    assert {d for d, _ in rows_of(one)} == {c for _, _, c in found} and one.columns == docs.columns

    clean = written(stage("benchmark_decontamination")(spark, one, DATA), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert Counter(rows_of(clean)) == Counter((d, t) for d, t in rows_of(one) if not hits(t, items)[-1]) and clean.columns == docs.columns

    check_packed(stage("packing")(spark, clean, DATA).collect(), dict(expected(rows_of(clean), BYTE, 1)))


def test_run(spark):
    from __spark_entry__ import queries

    made = queries()["pipeline"](spark, DATA)
    assert made.count() > 0 and len(cp.STAGES) == 5


def test_stages_of_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "a b c d e f g", None, "s", 13, 1), (3, "a b c d e f g", "en", None, 13, 1), (4, "x " * 50_000, "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for frame in (docs, docs.limit(0)):
        for name, f in cp.STAGES[:-1]:
            assert f(spark, frame, DATA).columns == list(cp.COLUMNS), name
            written(f(spark, frame, DATA), "t")
        assert cp.STAGES[-1][1](spark, frame, DATA).count() >= 0
    left = {r.doc_id for r in stage("line_dedup")(spark, docs, DATA).collect()}
    assert left == {None, 1, 2, 4}
    assert stage("simhash_near_dedup")(spark, docs, DATA).count() == 3
