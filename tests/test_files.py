"""The file index on files that are longer than what one task reads."""

import hashlib
import random

import pytest

from tidemark.sources import digests, files

R = random.Random(5)
ODD = ["a.bin", "b c.bin", "d,e.bin", "f[1]{2}.bin", "g?*.bin", "h%20i.bin"]


@pytest.fixture
def pieces(monkeypatch):
    monkeypatch.setattr(digests, "PIECE", 16_000)
    monkeypatch.setattr(digests, "RECORD", 60)


def filled(folder, sizes):
    folder.mkdir(exist_ok=True)
    for name, n in sizes.items():
        (folder / name).write_bytes(R.randbytes(n))
    return sorted((p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in folder.iterdir())


def rows(frame):
    return sorted((r["member"], r["size"], r["sha256"]) for r in frame.collect())


def test_long_files_are_read_in_pieces(spark, tmp_path, pieces):
    """No task is given more than a piece: sizes around a piece, a prime, whole records, and odd names."""
    sizes = [16_001, 104_729, 96_000, 17_599, 1, 16_000]
    want = filled(tmp_path / "data", dict(zip(ODD, sizes, strict=True)))
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}/data")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 16_000)
    try:
        got = files.index_files(spark, str(tmp_path / "data"), "*.bin")
        assert got.columns == ["member", "size", "sha256"] and rows(got) == want
        assert rows(files.index_files(spark, "viewfs://files/in")) == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_parts_cover_files_of_all_sizes(spark, tmp_path, pieces):
    want = filled(tmp_path / "data", {f"{n}.bin": n for n in [*range(16_001, 36_000, 1_111), 16_500, 32_000, 53_760]})
    found = {f"file:{tmp_path}/data/{name}": n for name, n, _ in want}
    assert digests.sha256(spark, found) == {f"file:{tmp_path}/data/{name}": digest for name, _, digest in want}


def test_long_files_named_like_packed_ones(spark, tmp_path, pieces):
    want = filled(tmp_path / "data", {"a,[b].gz": 40_000, "c.zst": 17_000, "d.bin": 40_000, "e.gz": 10})
    assert rows(files.index_files(spark, str(tmp_path / "data"))) == want


def test_a_file_that_has_changed_is_an_error(spark, tmp_path, pieces):
    filled(tmp_path / "data", {"a.bin": 40_000})
    with pytest.raises(Exception, match="a piece has"):
        digests.sha256(spark, {f"file:{tmp_path}/data/a.bin": 40_001})
