import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mapframe.llm.common import fresh_path
from mapframe.llm.encoding import encoder
from mapframe.llm.packing import Packer, op2_packing, pack_documents
from mapframe.llm.token_files import open_part, op8_token_files, read_manifest, read_token_files, write_token_files

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", None, " a", "a ", "a  b", "a\n b", "x<|endoftext|>y <|endoftext|> z", "it's don't we'll 'x", "é é a  b", "İstanbul ǅ ſ ß", "日本 語 test 🙂 x", "123 45.6 a1b2", "\n\n a\n\nb c", "tab\tb c", "Hello, world! (test) [x] <y>", "ﬁ ½ Ⅷ", "a<|startoftext|> b", "\x00 x \x1c y", "A" * 3000 + " " + "1" * 2000, "w " * 5000]
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunked_ids_equal_those_of_the_whole_text(path):
    plain = Tokenizer.from_file(path)
    ids, at = encoder(path).encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_a_small_memory_changes_nothing(monkeypatch):
    from mapframe.llm import encoding

    monkeypatch.setattr(encoding, "_MOST", 40)
    one, plain = encoding.Encoder(BYTE), Tokenizer.from_file(BYTE)
    for k in range(30):
        texts = [f"common words here w{k} w{k + j} x{k * j}" for j in range(8)]
        ids, at = one.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(one.known) <= 80 and len(set(one.known.to_pylist())) == len(one.known)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAéß'.,1<|>́İ日", max_size=40), max_size=5), st.sampled_from([BYTE, WORD]))
def test_chunked_ids_of_any_text(texts, path):
    plain = Tokenizer.from_file(path)
    ids, at = encoder(path).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def expected(rows, path, end):
    plain = Tokenizer.from_file(path)
    return [(d, np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in rows]


def check_packed(got, docs):
    """Every id of every document in one piece; sequences gapless and full."""
    pieces, sequences, groups = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for d, ids in docs.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].window <= 2048 and at & (at - 1) == 0
        groups[rows[0].step_group, rows[0].window] += at
    assert len({g for g, _ in groups}) == len(groups)  # a group has windows of one size
    return sequences


def test_op2(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    sequences = check_packed(op2_packing(spark, DATA).collect(), dict(expected(rows, BYTE, 1)))
    assert sum(r[0].window >= 256 for r in sequences.values()) > 0.9 * len(sequences)


def test_packing_of_odd_rows(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    check_packed(pack_documents(frame, BYTE, 1).collect(), dict(expected([r[:2] for r in rows], BYTE, 1)))
    assert pack_documents(frame.limit(0), BYTE, 1).count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "x"), (3, "x")], "doc_id long, text string")
    assert sum(r.length for r in pack_documents(repeated, BYTE, 1).collect()) == 2 * 3 + 2 * 2


def test_packing_in_small_blocks(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    made = pack_documents(spark.read.parquet(f"{DATA}/documents.parquet"), BYTE, 1, block_bytes=64 << 10, chunks=5_000)
    check_packed(made.collect(), dict(expected(rows, BYTE, 1)))


@given(st.lists(st.integers(1, 6000), max_size=60))
def test_packer_loses_nothing(lengths):
    packer, windows = Packer(), []
    for k, n in enumerate(lengths):
        windows += packer.add(k, n)
        if k % 7 == 6:
            windows += packer.pack()
    windows += [*packer.pack(), *packer.rest()]
    seen = defaultdict(list)
    for window in windows:
        size = sum(p[2] for p in window)
        assert size <= 2048 and size & (size - 1) == 0
        for d, start, n in window:
            seen[d].append((start, n))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == dict(enumerate(lengths))
    for parts in seen.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n


def test_op8(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    start, want = 0, []
    for d, ids in expected(rows, WORD, 2):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op8_token_files(spark, DATA).collect()) == want


def test_token_files_of_odd_rows(spark):
    rows = [(5, "a b", 1), (5, "c", 2), (None, "n", 3), (2, None, 4), (9, "", 5), (2, None, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start int")
    for path, dtype in ((WORD, "<u2"), (BYTE, "<u2")):
        out = fresh_path(spark, "t")
        assert write_token_files(frame, path, out, 2)["dtype"] == dtype
        got = sorted((tuple(r) for r in read_token_files(spark, out).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [None, 2, 2, 5, 5, 9]
        assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
        manifest = read_manifest(out)
        ids = np.concatenate([np.asarray(open_part(out, p["part"], manifest["dtype"])[0]) for p in manifest["parts"]])
        assert len(ids) == sum(r[2] for r in got) and (ids == 2).sum() >= len(rows)
    out = fresh_path(spark, "t")
    assert write_token_files(frame.limit(0), WORD, out, 2)["parts"] == [] and read_token_files(spark, out).count() == 0
    out = fresh_path(spark, "t")
    assert write_token_files(frame, BYTE, out, 70_000)["dtype"] == "<u4"


def test_parts_of_token_files_follow_the_bytes(spark, monkeypatch):
    from mapframe.llm import token_files

    monkeypatch.setattr(token_files, "PART_BYTES", 50)
    frame = spark.createDataFrame([(k, "ten bytes!") for k in range(100)], "doc_id long, text string")
    out = fresh_path(spark, "t")
    parts = write_token_files(frame, WORD, out, 2)["parts"]
    assert 10 < len(parts) <= 20 and sum(p["docs"] for p in parts) == 100
    read = read_token_files(spark, out)
    assert sorted(r.doc_id for r in read.collect()) == list(range(100)) and read.rdd.getNumPartitions() == len(parts)
