"""Plane files: exact round trips, random access, the ids of the tokenizer."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from tablescope.llm import id_planes, queries


def expected(rows):
    """(doc_id, start, n_tokens, crc) by the tokenizer itself, over sorted (id, text) rows."""
    from tokenizers import Tokenizer

    tokenizer, out, at = Tokenizer.from_file(queries.tokenizer_file()), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = id_planes.to_planes(ids, kind)
    assert len(planes) == id_planes.KINDS[kind]
    assert (id_planes.from_planes(planes, n, kind) == ids).all()
    low = ids % 7
    planes = [p if p.strip(b"\0") else None for p in id_planes.to_planes(low.astype(np.uint32), kind)]
    assert (id_planes.from_planes(planes, n, kind) == low).all()
    if kind == "bit" and n:
        assert all(np.unpackbits(np.frombuffer(p, np.uint8), count=n).tolist() == (ids >> k & 1).tolist()
                   for k, p in enumerate(id_planes.to_planes(ids, kind)))


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_any_run_of_ids_is_found(tmp_path, kind):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in rng.integers(0, 90, 50)]
    writer = id_planes.PlaneWriter(fs.LocalFileSystem(), f"{tmp_path}/x", kind, block=64)
    for key, ids in enumerate(docs):
        writer.add(None if key == 3 else key, ids[:5], ids[5:])
    size = writer.close()
    every = np.concatenate(docs)
    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/x") as file:
        assert file.size() == size
        reader = id_planes.PlaneReader(file)
        assert reader.sizes.tolist() == [len(d) for d in docs] and reader.known.tolist() == [k != 3 for k in range(50)]
        for _ in range(200):
            a, b = sorted(rng.integers(0, len(every) + 1, 2).tolist())
            assert (reader.ids(a, b) == every[a:b]).all()
    with pytest.raises(ValueError):
        id_planes.PlaneReader(pa.BufferReader(b"something else" * 9))


def test_query_matches_the_tokenizer(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op11_id_planes"](spark, sf)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == expected(rows)


def test_odd_texts(spark, odd, nothing, tmp_path):
    rng = random.Random(3)
    parts = ["a", "B ", "  ", " \n", "\n", "\t", " it's", " 12", "é", " ’", "​", "!? ", "　", "\x85", "x,y",
             "<|endoftext|>", " <|endoftext|> ", "<|endof"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(-20, 200)]
    rows += [(900, None), (901, ""), (902, "word " * 5000), (None, "of no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for kind, block, most, tasks in (("bit", 64, 500, 3), ("byte", 1000, 1 << 20, None)):
        folder = f"{tmp_path}/{kind}"
        index = id_planes.write_ids(df, folder, queries.tokenizer_file(), kind=kind, block=block, file_ids=most, tasks=tasks)
        docs = [(r["key"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in id_planes.read_documents(index, folder).collect()]
        assert sorted(docs, key=lambda r: r[1]) == expected(rows)
    index = id_planes.write_ids(odd, f"{tmp_path}/odd", queries.tokenizer_file())
    docs = sorted(map(tuple, id_planes.read_documents(index, f"{tmp_path}/odd").collect()), key=lambda r: r[1])
    assert [d[0] for d in docs] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12]
    assert all(a[1] + a[2] == b[1] for a, b in zip(docs, docs[1:]))
    one = index.filter("start = 0")
    assert id_planes.read_documents(one, f"{tmp_path}/odd").filter("key is null").count() == 1
    index = id_planes.write_ids(nothing, f"{tmp_path}/no", queries.tokenizer_file())
    assert index.count() == 0 and id_planes.read_documents(index, f"{tmp_path}/no").count() == 0
