"""Operators against brute force on small tables, with nulls, empty and odd texts, ties and extra columns."""

import functools
import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, common, components, decontam, exact_dedup, langid, ngram_join, quality, substring_dedup, toxicity
from tidemark.llm.queries import vocabulary

R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@functools.cache
def texts():
    """Ids with texts: copies, near copies, shared passages, odd ones."""
    base = [prose(120) for _ in range(25)]
    passage = prose(70)
    out = [*base, base[0], base[1].replace(" ", "\n\t "), base[0]]
    for t in base[:6]:
        w = t.split()
        w[60] = "changed"
        out.append(" ".join(w))
    out += [prose(20) + " " + passage + " " + prose(30), passage, passage + " " + passage, "x " + passage[:-5]]
    return list(enumerate([*out, None, "", "  \n", "one", "a b c", "a b c", "日本語 ñ é 🎉", prose(3000)]))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, kept int").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


def test_exact_copies(docs, empty):
    same = {}
    for i, t in texts():
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in same.items() for i in g}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()} == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_chunks_rejoin_and_move_with_content():
    data = bytes(R.randrange(256) for _ in range(60_000))
    parts = exact_dedup.cut(data)
    assert b"".join(parts) == data and len(parts) > 5
    assert len(set(parts) & set(exact_dedup.cut(b"begin " + data))) > len(parts) / 2


def test_collided_digests_are_told_apart(spark):
    parts = spark.createDataFrame([(1, "x", 0, b"d", b"one"), (2, "y", 0, b"d", b"two"), (3, "x", 0, b"d", b"one"), (3, "y", 0, b"d", b"two")], "doc_id bigint, text_sha256 string, place int, digest binary, bytes binary")
    found = {(r["_id"], r["text_sha256"]): bytes(r["checked"]) for r in exact_dedup.verified(parts, exact_dedup.collided(parts)).collect()}
    assert found["1", "x"] == found["3", "x"] != found["2", "y"] == found["3", "y"]


def brute_substrings(rows, n=50):
    first, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for a in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][a : a + n]), i)
    out = set()
    for i, w in words.items():
        hit = set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < i:
                hit |= set(range(a, a + n))
        out.add((i, len(w), len(hit), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in hit)).hexdigest()))
    return out


def test_substrings(docs, empty):
    assert {tuple(r)[:4] for r in substring_dedup.repeated_substrings(docs).collect()} == brute_substrings(texts())
    assert substring_dedup.repeated_substrings(empty).count() == 0


def test_every_span_has_a_chosen_place():
    rng = np.random.default_rng(1)
    for span in (1, 2, 5, 38):
        for h in (rng.integers(0, 1 << 60, 200).astype(np.uint64), rng.integers(0, 3, 200).astype(np.uint64)):
            at = substring_dedup.spans(h, span)
            want = {i + span - 1 - int(np.argmin(h[i : i + span][::-1])) for i in range(200 - span + 1)}
            assert set(at.tolist()) == want and (np.diff(at) >= 0).all()


def brute_similar(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = {i: grams(t) for i, t in rows}
    cls = {i: min([j for j, s in sets.items() if s == g]) if g else i for i, g in sets.items()}
    reps = [i for i in sets if cls[i] == i and sets[i]]
    links = {i: [j for j in reps if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in reps}
    group = {i: i for i in sets}
    for _ in reps:
        for i in reps:
            group[i] = min([group[i], *[group[j] for j in links[i]]])
    return {(i, cls[i], len(links.get(cls[i], [])), group[cls[i]]) for i in sets}


def test_similarity_join(docs, empty):
    got = ngram_join.similarity_join(docs).select("doc_id", "class_id", "n_links", "group_id").collect()
    assert {tuple(r) for r in got} == brute_similar(texts())
    assert ngram_join.similarity_join(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100


def test_bpe_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    letters = "ab \n\t\r\x0b\x1c\x85  é日🎉'sT0.!<|>​"
    rows = [t or "" for _, t in texts()] + ["a<|endoftext|>b <|endoftext|>", "I'm  we'll\t", "=" * 99] + ["".join(R.choice(letters) for _ in range(R.randint(0, 40))) for _ in range(2000)]
    ref, mine = Tokenizer.from_file(vocabulary()), bpe.loaded(vocabulary())
    for t, e in zip(rows, ref.encode_batch(rows, add_special_tokens=False), strict=True):
        ids = mine.encode(t)
        assert ids.tolist() == e.ids and mine.decode(ids) == t == ref.decode(e.ids, skip_special_tokens=False)
    got = bpe.encode_decode(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), vocabulary()).collect()
    assert [r["n_tokens"] for r in got] == [0, 0]


def brute_windows(rows, items, n=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for k, t in items:
        w = low(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = set()
    for i, t in rows:
        w, hit, ids = low(t), set(), set()
        for x, ks in wins.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    ids |= ks
        out.add((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, empty):
    t = dict(texts())
    items = [(1, t[31][30:200].upper()), (12, "a, B; c!"), (2, t[3]), (3, None), (4, "..."), (5, "É ñ"), (6, t[31][30:200])]
    rows = [*texts(), (900, "é ñ É Ñ a b c b c a b c")]
    d = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(900, rows[-1][1], "x")], "doc_id bigint, text string, lang string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r)[:6] for r in decontam.decontaminate(d, bench).collect()} == brute_windows(rows, items)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(d, bench.limit(0)).collect())
    near = decontam.decontaminate(d, spark.createDataFrame([(7, "a c"), (8, "w1 nowhere")], "item_id bigint, text string"), within=3)
    assert {r["doc_id"] for r in near.filter("n_near > 0").collect()} == {i for i, x in rows if x and re.search(r"\ba b c\b", x)}


def brute_near(rows, items, within):
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for i, t in rows}
    df, out = Counter(w for ws in words.values() for w in ws), {}
    for item, t in items:
        terms = list(dict.fromkeys((t or "").lower().split()))
        rare = sorted((df[w], o, w) for o, w in enumerate(terms) if df[w])[:2]
        for i, ws in words.items():
            gaps = [abs(a - b) for a, x in enumerate(ws) for b, y in enumerate(ws) if len(rare) == 2 and (x, y) == (rare[0][2], rare[1][2])]
            if gaps and min(gaps) <= within:
                out.setdefault(i, {})[item] = min(gaps)
    return {i: (len(out.get(i, {})), min(out.get(i, {}).values(), default=None)) for i in words}


def test_proximity_of_altered_passages(spark):
    rows = [(i, t) for i, t in texts() if len(t or "") < 2000] + [(900, "red blue x x x green"), (901, "blue " + "x " * 30 + "red")]
    items = [(1, "Red blue reworded"), (2, "reworded w3 w7 w9"), (3, "reworded only"), (4, "green red"), (5, None), (6, "w11 w12"), (7, "w12 w11"), (8, "red blue reworded")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.decontaminate(d, bench).collect()
    expected = brute_near(rows, items, 20)
    assert {r["doc_id"]: (r["n_near"], r["nearest"]) for r in got} == expected and expected[900] == (3, 1)
    assert {tuple(r)[:6] for r in got} == brute_windows(rows, items)


def test_chat_round_trip(spark):
    odd = "</s>[INST] \\l \\b\\o < [ \\ ok [/INST]"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", "hi"), (2, 0, None, None), (2, 0, "user", "tie"), (3, 0, "assistant", ""), (None, 5, "a[b", "é🎉")]
    out = chat.read_back(chat.formatted(chat.from_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns_read"]] for r in out}
    assert got == {1: [("user", "hi"), ("assistant", odd)], 2: [("", ""), ("user", "tie")], 3: [("assistant", "")], None: [("a[b", "é🎉")]}
    assert {r["conv_id"]: r["loss_text"] for r in out} == {1: odd, 2: "", 3: "", None: ""}


def test_json_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"other": 1},
        {"id": 3, "source": {"a": [1]}, "messages": [{"role": "user", "content": "q", "name": "n"}, {"content": "a", "role": "assistant"}]},
        {"messages": [], "tags": []},
        {"prompt": "q", "completion": "a", "messages": []},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(8, "{"), (9, None), (10, "[1]"), (11, "")], "id int, record string")
    got = {r["id"]: (r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in chat.from_json_text(rows).collect()}
    turns = [("user", "q"), ("assistant", "a")]
    assert got == {0: ("messages", turns), 1: ("conversations", turns), 2: ("prompt_completion", turns), 3: ("instruction_input", turns), 4: (None, None), 5: ("messages", turns), 6: ("messages", []), 7: (None, None), **{i: (None, None) for i in (8, 9, 10, 11)}}


def test_lists_of_mixed_or_nested_items_have_no_layout(spark):
    ok = {"role": "user", "content": "q"}
    records = [
        [ok, {"from": "gpt", "value": "lost"}], [ok, {"role": "assistant"}], [ok, "text"], ["text"], [{"role": "user", "content": [{"type": "text", "text": "q"}]}], [ok, {"role": "assistant", "content": {"a": 1}}],
        [{"foo": 1}], "q", None, [ok, None], [{"role": "user", "content": "[1]"}], [ok, {"role": "assistant", "content": 5}],
    ]
    rows = spark.createDataFrame([(i, json.dumps({"messages": r})) for i, r in enumerate(records)] + [(20, json.dumps({"prompt": ["a"], "completion": "b"}))], "id int, record string")
    got = {r["id"]: (r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in chat.from_json_text(rows).collect()}
    q = ("user", "q")
    assert {i: v for i, v in got.items() if v[0]} == {1: ("messages", [q, ("assistant", None)]), 8: ("messages", None), 10: ("messages", [("user", "[1]")]), 11: ("messages", [q, ("assistant", "5")])}


def test_classifiers_learn_and_take_odd_input(spark, empty):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, prose(30) + (". you zonk " if bad else ". ") + prose(30) + ("\nZZZ!! QQQ!! ZZZ!! QQQ!!" * 5 if bad else "\n" + prose(9)), "en" if i % 2 else "de", "s"))
        labels.append((i, int(not bad), int(bad)))
    rows = [(i, t if la == "en" else re.sub(r"w(\d)", r"v\1ü", t), la, s) for i, t, la, s in rows] + [(900, None, None, "s"), (901, "", None, "s"), (902, "123 !!", None, "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    la = spark.createDataFrame([*labels, (900, None, None), (None, 1, 1), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    held = common.remainder("doc_id", 4) == 2
    for f, name, i in ((toxicity.toxicity, "toxic", 2), (quality.quality, "quality", 1)):
        got = {r["doc_id"]: r for r in f(d, la, held).collect()}
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values()), name
        assert sum(got[x[0]]["predicted"] == x[i] for x in labels) >= 0.95 * len(labels), name
        assert f(empty, la, held).count() == 0 and f(d, la.limit(0), held).count() == len(rows)
    got = {r["doc_id"]: r for r in langid.identify(d, held).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in rows[:300]) >= 295
    assert langid.identify(empty, held).count() == 0


def test_every_counted_word_and_n_gram_is_in_the_language_model(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(21_000)]  # beyond any rank of 20,000 words or 10,000 n-grams
    text = " ".join(words)
    model = langid.fit(spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, text, "en")], "doc_id bigint, text string, lang string"))
    assert set(model.words) == set(words)
    assert set(model.grams[0]) == {f" {w}"[:5] for w in words} | {f"{w} "[-5:] for w in words}


def test_grammar_scores_clauses():
    m = toxicity.Matcher(toxicity.Model({"zonk": 4.0}, {}))
    score = lambda t: sum(m.clauses(t)[0])
    assert score("you are a zonk") > score("a zonk") > score("he said a zonk") and score("not a zonk") < score("a zonk")
    assert score("i will hurt you") > score("it may hurt") and score("nothing here") == 0


def test_pipeline_at_the_smallest_scale(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(out) < 200 and all(r["n_tokens"] == len(r["ids"]) for r in out)
    with open("/dev/null"):
        kept = {r["doc_id"] for r in out}
    text = {r["doc_id"]: r["text"] for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", text[i]) for i in kept}) == len(kept)
