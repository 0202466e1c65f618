"""Near passages against all windows, and how few of them are compared."""

import random
from difflib import SequenceMatcher

import pytest

from textora.operators import near


def brute(pages, facts, least=0.9):
    out = {}
    for fact, what in facts:
        what = near.normal(what or "")
        for key, text in pages:
            text = near.normal(text or "")
            if not what or not text:
                continue
            words, size, top = text.split(" "), what.count(" ") + 1, float(what in text)
            for width in {max(1, size - 1), size, size + 1}:
                for i in range(max(1, len(words) - width + 1)):
                    top = max(top, SequenceMatcher(None, " ".join(words[i : i + width]), what, autojunk=False).ratio())
            if top >= least:
                out[fact, key] = round(top, 4)
    return out


def spoiled(rng, text, share):
    """text with some characters gone, doubled, or changed."""
    return "".join("" if (r := rng.random()) < share / 3 else c * 2 if r < share * 2 / 3 else "x" if r < share else c for c in text)


@pytest.mark.parametrize("least", [0.9, 0.7])
def test_near_scores_equal_all_windows(spark, least, monkeypatch):
    monkeypatch.setattr(near, "SLICE", 300)
    rng = random.Random(7)
    syllables = "th er on an in re nd at en ou ti es or ing ha le".split()
    say = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    facts = [(k, say(n)) for k, n in enumerate((1, 1, 2, 2, 3, 4, 5, 8, 8, 12, 20, 30))]
    facts += [(12, "a"), (13, None), (14, "  "), (15, "ab"), (16, "Straße ﬁne naïve words here"), (17, "aaaa aaaa aaaa aaaa aaaa")]
    pages = [(k, say(rng.randint(0, 40)) + " " + spoiled(rng, rng.choice(facts[:12])[1], rng.choice((0, 0.05, 0.1, 0.2))) + " " + say(rng.randint(0, 60))) for k in range(60)]
    pages += [(100, None), (101, ""), (102, "x"), (103, "STRASSE fine  naïve\nwords hera"), (104, "aaaa aaa aaaa aaaaa aaaa aaa " * 20), (None, facts[8][1]), (None, facts[8][1])]
    df, asked = spark.createDataFrame(pages, "doc_id long, text string"), spark.createDataFrame(facts, "fact int, text string")
    got = near.near_scores(df.repartition(3), asked, least=least).collect()
    assert {(r.fact, r.doc_id): r.score for r in got} == brute(pages, facts, least)
    assert len({(r.fact, r.doc_id) for r in got}) == len(got)
    assert near.near_scores(df, asked.limit(0)).count() == 0 and near.near_scores(df.limit(0), asked).count() == 0


def test_blocks_of_facts_find_the_same(spark, sf_dir, monkeypatch):
    docs, asked = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS fact", "text")
    pick = lambda df: sorted((r.fact, r.doc_id, r.score) for r in df.select("fact", "doc_id", "score").collect())
    whole = pick(near.near_scores(docs, asked))
    monkeypatch.setattr(near, "BLOCK", 1500)
    assert pick(near.near_scores(docs, asked)) == whole


def test_few_windows_are_compared(spark):
    """Of all windows of documents less than one in a hundred is compared."""
    d = "/root/testdata/sf0.01"
    docs, asked = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet").selectExpr("item_id AS fact", "text")
    texts = [r.text or "" for r in docs.select("text").collect()]
    given = near.Facts([near.normal(r.text) for r in asked.collect()], near.NEARLY)
    looked = all_ = 0
    for t in texts[:200]:
        plain = near.normal(t)
        looked += given.best(plain)[1]
        all_ += sum(max(1, plain.count(" ") + 2 - w.count(" ") - 1 - d) for w in given.texts for d in (-1, 0, 1))
    assert looked < all_ / 100


def test_windows_that_begin_together_are_looked_at_together(monkeypatch):
    """Of windows side by side few are compared character by character, and the best ratio is that of all of them."""
    rng, calls, common = random.Random(5), [], near.common
    monkeypatch.setattr(near, "common", lambda *a: calls.append(1) or common(*a))
    word = lambda: "".join(rng.choices(("th", "er", "on", "an", "in"), k=rng.randint(1, 3)))
    fact = " ".join(word() for _ in range(40))
    text = " ".join(word() for _ in range(600)) + " " + spoiled(rng, fact, 0.05) + " " + " ".join(word() for _ in range(600))
    found, looked = near.Facts([fact], near.NEARLY).best(text)
    assert found == {0: brute([(1, text)], [(0, fact)])[0, 1]}
    assert looked > 3 * len(calls) > 0
