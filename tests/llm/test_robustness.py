"""Rows without a doc_id or that share one, odd and very long texts, empty tables and clashing columns, for operators that key by row."""

import hashlib
import random

from tidemark.llm import bpe, chat, decontam, exact_dedup
from tidemark.llm.queries import vocabulary

R = random.Random(31)
LONG = [" ".join(f"w{R.randrange(500)}" for _ in range(20_000)), "x" * 1_000_000]


def prose(n):
    return " ".join(f"w{R.randrange(400)}" for _ in range(n))


def test_decontamination_by_row(spark):
    leak = prose(12)
    rows = [(None, f"x {leak}"), (None, "clean"), (5, "clean too"), (5, f"{leak} y"), (6, f"{LONG[0]} {leak}"), (7, LONG[1]), (8, None)]
    d = spark.createDataFrame([(i, t, 1, 2, True) for i, t in rows], "doc_id bigint, text string, row int, n_hit int, contaminated boolean")
    bench = spark.createDataFrame([(1, leak, "x")], "item_id bigint, text string, words string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontam.decontaminate(d, bench).collect()), key=str)
    assert got == sorted([(None, 13, 12), (None, 1, 0), (5, 2, 0), (5, 13, 12), (6, 20_012, 12), (7, 1, 0), (8, 0, 0)], key=str)
    assert decontam.decontaminate(d, bench).filter("n_near > 0").count() == 3


def test_exact_copies_of_odd_rows(spark):
    rows = [(None, "a"), (3, "a"), (3, "b"), (4, "b"), (None, None), (5, ""), (6, LONG[0]), (7, LONG[0]), (8, LONG[1]), (9, LONG[1] + "y"), (3, "a")]
    d = spark.createDataFrame([(i, t, "r", 7) for i, t in rows], "doc_id bigint, text string, recipe string, group_size int")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(d).collect()), key=str)
    want = [(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (3, 3, 2, True), (4, 3, 2, False), (None, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 1, True), (9, 9, 1, True)]
    assert got == sorted(want, key=str)


def test_collided_digests_of_rows_that_share_an_id(spark, monkeypatch):
    """With a digest that is the same for all chunks that begin alike, chunks are told apart by their bytes."""
    monkeypatch.setattr(exact_dedup, "digest", lambda chunk: hashlib.blake2b(chunk[:1], digest_size=16).digest())
    rows = [(1, "a one"), (1, "a two"), (2, "a one"), (None, "a two"), (4, "b")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (None, 1, 2), (4, 4, 1)], key=str)


def test_bpe_of_long_texts_and_clashing_columns(spark):
    rows = [(1, LONG[0]), (1, LONG[0]), (None, "x" * 20_000), (3, "é\n\n\t " * 500)]
    got = bpe.encode_decode(spark.createDataFrame([(i, t, 3, "q") for i, t in rows], "doc_id bigint, text string, n_tokens int, ids_sha256 string"), vocabulary()).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary()).count() == 0


def test_chat_of_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.formatted(chat.from_rows(empty))).count() == 0
    rows = [(1, 0, "user", LONG[1], "a", 1), (1, 0, "user", LONG[1], "b", 2), (1, None, "assistant", "[</s>\\", "c", 3)]
    out = chat.read_back(chat.formatted(chat.from_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, loss_mask int")))).first()
    assert [t["text"] for t in out["turns_read"]] == ["[</s>\\", LONG[1], LONG[1]] and out["loss_text"] == "[</s>\\"
