"""Line deduplication against brute force: hot lines, odd rows, rows without an id or that share one."""

import hashlib
import random

from tidemark.llm import line_dedup

R = random.Random(12)
SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=10, most=2):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= least:
                holders.setdefault(key, set()).add(i)
    first = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in holders.items() if len(v) >= most}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(SPACE))) not in first or first[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def deduped(spark, rows, **how):
    d = spark.createDataFrame([(i, t, 1, "x", [2], 3) for i, t in rows], "doc_id bigint, text string, k1 int, kept_text string, places array<int>, doc int").repartition(5)
    return sorted((tuple(r)[:4] for r in line_dedup.repeated_lines(d, **how).collect()), key=str)


def test_random_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)
    pool = ["Shared line of text", "shared LINE of text ", "Été à la plage", "été à la plage", " padded by a wide space", "short", "123456789", "1234567890", "日本語日本語日本語", "日本語日本語日本語日", "", "  ", "a\rb carriage return"]
    rows = [(i, "\n".join([*R.choices(pool, k=R.randint(0, 6)), f"own line number {R.randrange(90)}", "the hot line of all documents"])) for i in range(150)]
    assert deduped(spark, rows) == brute(rows)
    assert deduped(spark, rows, min_docs=5, min_chars=3) == brute(rows, 3, 5)


def test_odd_rows(spark):
    long = "\n".join(f"line number {i} of a long text" for i in range(20_000))
    rows = [(None, "one line of text\nmore"), (3, "One line of text"), (3, "one line of text\n\none line of text"), (3, "one line of text"), (2, "two lines of text"), (None, "two lines of text\n" * 3), (None, "only without an id"), (None, "only without an id"), (7, long), (6, long + "\nEnd of it all."), (8, "x" * 1_000_000), (9, "X" * 1_000_000), (10, None), (11, ""), (12, None)]
    assert deduped(spark, rows) == brute(rows)
    assert deduped(spark, [(1, None)]) == brute([(1, None)])
    assert line_dedup.repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
