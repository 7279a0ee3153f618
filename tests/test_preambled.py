"""The data source for preambled files: ranges of any size, headers in other orders, files that fail by themselves."""

import random

import pytest

from lacunae.sources import preambled, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, d = random.Random(2), tmp_path_factory.mktemp("files")
    lines = [f'{k},"{rng.randrange(10**rng.randrange(1, 12))},x",{"é" * rng.randrange(3)}' for k in range(500)]
    (d / "a.csv").write_bytes(("Unit: 1\nmore, of it\nkey,value,other\n" + "\n".join(lines) + "\n").encode())
    (d / "b.CSV").write_bytes("Unit: 2\r\nother,key\r\no1,1\r\n\r\no2,2".encode())
    (d / "c.csv").write_bytes(b"Unit: 3\nno header\n1,2\n")
    (d / "d.csv").write_bytes(b"")
    (d / "_skipped").write_bytes(b"key\n1\n")
    (d / "sub").mkdir()
    (d / "sub" / "e.csv").write_bytes(b"key\n" + b"9\n" * 3)
    return d


@pytest.mark.parametrize("size", [1, 7, 100, 4096, 1 << 26])
def test_any_range(spark, folder, size):
    if size == 1:
        reader = preambled.PreambledReader(str(folder / "b.CSV"), {"key": "k"}, 1)
        assert [r[3] for part in reader.partitions() for r in reader.rows(part)] == ["1", "2"]
        return
    columns = {"key": "k", "value": "v"}
    if size < 100:  # without a job for each few bytes
        reader = preambled.PreambledReader(str(folder), columns, size)
        rows = [r for part in reader.partitions() for r in reader.rows(part)]
    else:
        rows = [tuple(r) for r in readers.read_preambled_csv(spark, str(folder), columns, size).select("file", "line", "preamble", "k", "v", "reason").collect()]
    by = {}
    for file, at, preamble, k, v, reason in rows:
        by.setdefault(file.rsplit("/", 1)[-1], []).append((at, preamble, k, v, reason))
    a = sorted(by["a.csv"])
    assert [x[2] for x in a] == [str(k) for k in range(500)] and all(x[3].endswith(",x") and x[1] == "Unit: 1" for x in a)
    assert [x[2:] for x in sorted(by["b.CSV"])] == [("1", None, None), ("2", None, None)]
    assert [x[4] for x in by["c.csv"]] == ["no such header"] and [x[4] for x in by["d.csv"]] == ["no such header"]
    assert "_skipped" not in by and [x[2] for x in by["e.csv"]] == ["9"] * 3


def test_what_fails_is_told(tmp_path):
    (tmp_path / "x.csv").write_bytes(b"key\n1\n")
    reader = preambled.PreambledReader(str(tmp_path), {"key": "k"}, 1 << 20)
    part = reader.partitions()[0]
    (tmp_path / "x.csv").unlink()
    batch = next(iter(reader.read(part)))
    assert batch.num_rows == 1 and "x.csv" in batch.column("file")[0].as_py() and batch.column("reason")[0].as_py()
    assert preambled.files_of(str(tmp_path / "*.csv")) == []
