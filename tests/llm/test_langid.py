"""Language identification against a plain version of the backoff."""

import math
import random
from collections import Counter

import regex

from tidemark.llm import langid

R = random.Random(3)
LETTERS = {"aa": "abcdeéü", "bb": "abxyzñ", "cc": "abcxyzß"}


def word(lang):
    return "".join(R.choice(LETTERS[lang]) for _ in range(R.randint(1, 7)))


def text(lang, n):
    return " ".join(R.choice(["{}", "{},", "'{}'", "{}1", "{}-x", "½{}"]).format(word(lang)) for _ in range(n))


def plain(train, texts, longest=5):
    """The method in plain Python: counts, posteriors, words first, then the longest n-grams that are known."""
    langs = sorted({la for _, la in train})
    words = {la: Counter(w for t, x in train if x == la for w in regex.findall(r"\p{L}+", t.lower())) for la in langs}
    grams = {k: {la: Counter() for la in langs} for k in range(1, longest + 1)}
    for la in langs:
        for w, n in words[la].items():
            for k, counts in grams.items():
                for i in range(len(w) + 3 - k):
                    counts[la][f" {w} "[i : i + k]] += n

    def posteriors(counts, least):
        kept = {la: {x: n for x, n in c.items() if n >= least} for la, c in counts.items()}
        keys = {x for c in kept.values() for x in c}
        p = {x: [(kept[la].get(x, 0) + 0.5) / (sum(kept[la].values()) + 0.5 * len(keys)) for la in langs] for x in keys}
        return {x: [math.log(v / sum(vs)) for v in vs] for x, vs in p.items()}

    known, tables = posteriors(words, 2), {k: posteriors(c, 3) for k, c in grams.items()}
    out = []
    for t in texts:
        found, total = regex.findall(r"\p{L}+", (t or "").lower()), [0.0] * len(langs)
        for w in found:
            rows = [known[w]] if w in known else []
            for k in range(longest, 0, -1) if not rows else ():
                if rows := [tables[k][g] for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]) in tables[k]]:
                    break
            total = [a + sum(r[j] for r in rows) / len(rows) if rows else a for j, a in enumerate(total)]
        e = [math.exp(x - max(total)) for x in total]
        out.append((langs[e.index(max(e))], 1 / sum(e)) if found else ("und", 0.0))
    return out


def test_backoff_equals_the_plain_version(spark):
    train = [(text(la, R.randint(1, 40)), la) for la in LETTERS for _ in range(25)]
    odd = [None, "", " \n", "½ ² ① Ⅷ 12 _", "é", "a", "　ab ba", "Zzz!" * 50, text("aa", 20_000), " ".join(word("bb") for _ in range(200_000))]
    texts = [*odd, *(text(R.choice(list(LETTERS)), R.randint(1, 12)) for _ in range(200))]
    rows = spark.createDataFrame([(i, t, la, "x") for i, (t, la) in enumerate(train)], "doc_id bigint, text string, lang string, score string")
    model = langid.fit(rows)
    asked = spark.createDataFrame([(i % 150, t, str(i), 7) for i, t in enumerate(texts)], "doc_id bigint, text string, lang_pred string, score int").repartition(3)
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.predict(asked, model).collect()}
    assert langid.predict(asked, model).count() == len(texts)
    for (i, _), (la, p) in zip(enumerate(texts), plain(train, texts), strict=True):
        assert any(g[0] == i % 150 and g[1] == la and math.isclose(g[2], p, abs_tol=2e-3) for g in got), (i, la, p)


def test_scores_do_not_depend_on_what_is_remembered():
    import pyarrow as pa

    model = langid.Model(["aa", "bb"], {"ab": 0}, [{"a": 1}], __import__("numpy").array([[-0.1, -2.3], [-1.0, -0.5]], "f4"))
    texts = pa.array([" ".join(word("aa") for _ in range(30)) for _ in range(50)] + ["ab ab"])
    forgetful, mindful = langid.Scorer(model, 3), langid.Scorer(model)
    for _ in range(3):
        a, b = forgetful(texts), mindful(texts)
        assert a[0] == b[0] and (a[1] == b[1]).all()
