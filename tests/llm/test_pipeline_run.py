"""The whole pipeline over small tables with planted cases, against a plain version of each stage."""

import random
import re
from collections import Counter

import corpus_pipeline
from tidemark.llm.queries import vocabulary

R = random.Random(44)


def prose(n):
    return " ".join(f"w{R.randrange(600)}" for _ in range(n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, items):
    """What the stages leave: by rows of (id, text), in the order of the pipeline."""
    left = [(i, t) for i, t in docs if "zonk" not in (t or "")]
    first = {}
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        order = (i is None, i or 0)
        if key not in first or order < first[key][0]:
            first[key] = (order, (i, t))
    left, grams = [x for _, x in first.values()], {}
    group = list(range(len(left)))
    for k, (_, t) in enumerate(left):
        grams[k] = shingles(t or "")
    for _ in left:
        for a in range(len(left)):
            for b in range(len(left)):
                if a != b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                    group[a] = group[b] = min(group[a], group[b])
    best = {}
    for k, (i, t) in enumerate(left):
        order = (i is None, i or 0)
        if group[k] not in best or order < best[group[k]][0]:
            best[group[k]] = (order, (i, t))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(words(t)[a : a + len(x)]) == x for x in wins for a in range(len(words(t)) - len(x) + 1))
    return [x for _, x in best.values() if not hit(x[1])]


def test_the_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    base = [prose(R.randint(20, 60)) for _ in range(60)]
    leak = prose(14)
    docs = list(enumerate(base)) + [(100 + i, base[i].replace(" ", "  ", 3)) for i in range(10)] + [(None, base[11]), (None, base[12] + " tail"), (3, base[5]), (3, prose(30))]
    docs += [(200 + i, " ".join([*base[20 + i].split()[:-1], "changed"])) for i in range(8)] + [(300, f"{prose(9)} {leak} {prose(9)}"), (None, leak), (301, " ".join(leak.split()[:9]))]
    docs += [(400 + i, f"{prose(8)} you are a zonk {prose(8)}") for i in range(40)] + [(None, "you are a zonk"), (500, None), (501, ""), (502, " \n"), (503, "é日本🎉 " * 3)]
    docs += [(600 + i, prose(25)) for i in range(120)]
    spark.createDataFrame([(i, t, "en", "s", 7) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("zonk" in (t or "")), 1) for i, t in docs if i is not None and i not in (3,)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, leak), (2, None), (3, "...")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids").collect()
    ref = Tokenizer.from_file(vocabulary())
    want = Counter((i, tuple(ref.encode(t or "", add_special_tokens=False).ids)) for i, t in plain(docs, items))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert len(want) < len(docs) - 60
