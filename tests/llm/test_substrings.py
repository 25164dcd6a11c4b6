"""Substring deduplication against brute force: hot passages, repeated ids, odd rows, and its look-up of levels."""

import random

import numpy as np

from tidemark.llm import common, substring_dedup

from .test_llm import brute_substrings

R = random.Random(21)


def prose(n):
    return " ".join(f"w{R.randrange(300)}" for _ in range(n))


def removed(spark, rows, length=50):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, kept_text string, n_words int").repartition(5)
    return [tuple(r)[:4] for r in substring_dedup.repeated_substrings(d, length).collect()]


def test_hot_passages_and_repetition(spark):
    passage, line = prose(64), " ".join(["ab"] * 70)
    rows = [(i, f"{prose(R.randint(0, 60))} {passage if i % 3 else passage[:-4]} {prose(R.randint(0, 30))}") for i in range(80)]
    rows += [(100 + i, f"{prose(5)} {line} {'ab ' * i}{prose(5)}") for i in range(6)] + [(200, prose(49)), (201, prose(50)), (202, rows[0][1].upper())]
    assert set(removed(spark, rows)) == brute_substrings(rows)


def test_other_lengths(spark):
    passage = prose(30)
    rows = [(i, f"{prose(9)} {passage[i:]} {prose(9)}") for i in range(12)]
    for length in (8, 13):
        assert set(removed(spark, rows, length)) == brute_substrings(rows, length)


def test_rows_without_or_with_the_same_id(spark):
    text = prose(60)
    got = removed(spark, [(None, text), (5, text), (5, text), (7, text), (8, None), (9, "x" * 1_000_000), (10, prose(20_000))])
    assert sorted((i, n) for i, _, n, _ in got if i and i < 8) == [(5, 0), (5, 0), (7, 60)]
    assert [n for i, _, n, _ in got if i is None] == [0] and len(got) == 7


def test_equal_first_halves_are_told_apart(tmp_path):
    levels = substring_dedup.Levels(str(tmp_path), 1, 50)
    a, b, low = np.array([4, 4, 4, 8], "<u8"), np.array([1, 2, 5, 1], "<u8"), np.array([10, 20, 30, 40], "<i8")
    for name, column in (("a", a), ("b", b), ("low", low)):
        substring_dedup.write_array(f"{tmp_path}/3/0.{name}", column)
    got = levels.lowest(np.array([4, 4, 4, 4, 8, 6], "<u8"), np.array([5, 1, 2, 9, 1, 1], "<u8"))
    none = np.iinfo(np.int64).max
    assert got.tolist() == [30, 10, 20, none, 40, none]


def test_words_of_texts_side_by_side():
    raws = [b"a  b\tc", None, b"", b" \x0b ", "é 日本 a\u00a0b".encode(), b"b a", b"x" * 5000, *(prose(R.randint(0, 40)).encode() for _ in range(200))]
    known: dict[int, bytes] = {}
    for piece in (1 << 20, 64, 1):
        h, counts = common.WordHasher(piece)(raws)
        words = [w for r in raws for w in (r or b"").split()]
        assert counts.tolist() == [len((r or b"").split()) for r in raws] and len(h) == len(words)
        for k, w in zip(h.tolist(), words, strict=True):
            assert known.setdefault(k, w) == w
    assert len(known) == len(set(words))
    assert [len(x) for x in common.WordHasher()([])] == [0, 0]


def test_many_shards_with_few_open_files(tmp_path):
    """1,024 shards are looked up twice under a limit of 512 open files."""
    import resource

    from tidemark.llm import packed

    keys = np.random.default_rng(5).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    shard = (keys & np.uint64(1023)).astype(np.int64)
    for k in range(1024):
        packed.write_table(f"{tmp_path}/1/{k}", np.unique(keys[shard == k]))
    levels = substring_dedup.Levels(str(tmp_path), 10, 50)
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (512, before[1]))
    try:
        for _ in range(2):
            assert levels.repeated(1, keys).all() and not levels.repeated(1, keys ^ np.uint64(1 << 40)).any()
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)
    assert len(levels.maps.held) <= levels.maps.most < 512
