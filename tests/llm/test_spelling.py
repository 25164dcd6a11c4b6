"""Spelling variants against brute force: edit pairs by definition, hot halves in slices, odd rows, chains of forms."""

import random
import re
import zlib
from collections import Counter

from tidemark.llm import spelling

R = random.Random(13)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=7, every=31):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= 2}
    form, out = {}, []
    beside = {w: [v for v in words if near(w, v)] for w in words}
    for w, vs in beside.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 10 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(beside[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(5)
    return sorted(tuple(r) for r in spelling.variants(d, **how).collect())


def altered(word):
    at, letter = R.randrange(len(word)), R.choice("abcdeé")
    return R.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


def test_pairs_by_definition():
    words = {"".join(R.choices("abé", k=R.randint(1, 9))) for _ in range(400)} | {"b" * 300, "b" * 299, "b" * 299 + "c"}
    words = sorted(words, key=lambda w: hash(w) % 97)
    index, asked = words[: len(words) * 2 // 3], words[len(words) // 3 :]
    q, w = spelling.Index(index).near(asked)
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(index) if near(a, b)]


def test_random_texts_with_hot_halves(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    base = ["".join(R.choices("abcdefgÀàé", k=R.randint(6, 12))) for _ in range(40)] + ["congress" + x for x in ("", "e", "o", "ion", "iona")]
    pool = [*base, *(altered(w) for w in base for _ in range(6)), *(altered(altered(w)) for w in base), *("conabcd" + x + y for x in "abcd" for y in "efgh")]
    rows = [(i, " ".join(R.choices(pool, [60] * len(base) + [1] * (len(pool) - len(base)), k=R.randint(0, 80))).replace("c", "C")) for i in range(120)]
    want = brute(rows)
    assert found(spark, rows) == want and any(r[1] for r in want) and any(r[4] > 2 for r in want)


def test_chains_and_odd_rows(spark):
    rows = [(1, "lettern " * 2000 + "letters " * 150), (2, "lettres " * 12 + "lettre_ " * 9 + "bettres " * 3 + "betores"), (None, "betores, ÉCOLÉSS école; Écolèss"), (None, None), (3, ""), (3, "x" * 5000 + " " + "x" * 4999 + "y" + " éééééé× 日本語abcdefg日本"), (3, "x" * 5000 + " " + "x" * 4999 + "y"), (4, "abcdefg abcdefg")]
    want = brute(rows)
    assert found(spark, rows) == want and {len(r[0]) for r in want} >= {7, 5000}
    assert found(spark, [(1, None)]) == [] and spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
