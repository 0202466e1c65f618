"""Token shards and their key index, fill-in-the-middle cuts, vector codes: brute force, round trips and odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textora.llm import infill, key_index, queries, token_shards, tokens, vector_codes
from textora.llm._common import new_path, read

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    """Ids of a text that is encoded in one piece."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(docs, whole):
    """(doc_id, start, n_tokens, ids_crc32) of rows in order of ids."""
    start, out = 0, []
    for k, text in docs:
        ids = np.array([*whole(text), 0], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens_of_all_documents(spark, sf_dir, whole):
    docs = sorted((r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect())
    assert sorted(map(tuple, queries.op11_token_shards(spark, sf_dir).collect())) == expected(docs, whole)


def test_pieces_have_the_ids_of_the_whole(whole, monkeypatch):
    made, rng = tokens.Encoder(PATH), np.random.default_rng(1)
    monkeypatch.setattr(tokens, "KEPT", 40)  # so that pieces are forgotten again and again
    drawn = ["".join(rng.choice([*"ab  \n\t'sé中1.,�\x1c", "<|endoftext|>", " x'll"], 30)) for _ in range(400)]
    for text in [*drawn, "", " ", "  a", "a  ", "\n a\n", "<|endoftext|> <|endoftext|>"]:
        assert np.frombuffer(made.encode(text), "<u2").tolist() == whole(text)
        assert "".join(tokens.pieces(text)) == "".join(tokens.slices(text, 7)) == text
    monkeypatch.setattr(tokens, "TOGETHER", 90)
    assert [np.frombuffer(x, "<u2").tolist() for x in made.encode_all(drawn)] == [whole(text) for text in drawn]
    monkeypatch.setattr(tokens, "SLICE", 20)
    assert [np.frombuffer(x, "<u2").tolist() for x in made.encode_all(drawn)] == [whole(text) for text in drawn]
    monkeypatch.setattr(tokens, "slices", lambda text, f=tokens.slices: f(text, 11))
    assert all(np.frombuffer(made.encode(text), "<u2").tolist() == whole(text) for text in drawn)


def test_shards_of_odd_rows(spark, whole):
    """Small shards and parts: null and repeated ids, null, empty and long texts, keys that are not there, two runs alike."""
    docs = [(5, "five"), (None, "no id"), (5, "five again"), (-3, None), (7, ""), (2**62, "word " * 40_000), (None, None), *((k, f"text {k} \n") for k in range(100, 140)), *((9, f"hot {k}") for k in range(300))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("id", F.lit(1.5))
    starts = []
    for given in (frame, frame.repartition(3)):
        uri = new_path(spark, "test-tokens")
        listed = token_shards.write_tokens(given, uri, PATH, shard_bytes=900).collect()
        token_shards.build_index(spark, uri, part_keys=10)
        assert len(listed) > 5 and token_shards.index_parts(spark, uri) >= 4
        got = token_shards.fetch(given, uri, ids=True).collect()
        starts.append(sorted((r.start, r.doc_id, r.ids_crc32) for r in got))
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((k is not None, k or 0, [*whole(t), 0]) for k, t in docs)
        by_start = sorted(got, key=lambda r: r.start)
        assert [r.doc_id for r in by_start] == sorted((k for k, _ in docs), key=lambda k: (k is not None, k or 0))
        assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    assert starts[0] == starts[1]
    absent = spark.createDataFrame([(6,), (5,), (5,), (10**15,)], "doc_id long")
    assert sorted(r.doc_id for r in token_shards.fetch(absent, uri).collect()) == [5, 5]
    reader = token_shards.TokenReader(spark, uri)
    assert [x.tolist() for x in reader.get(2**62)] == [[*whole("word " * 40_000), 0]] and sorted(x.tolist() for x in reader.get(5)) == sorted([[*whole("five"), 0], [*whole("five again"), 0]])
    assert len(reader.get(9)) == 300 and reader.get(6) == [] and [x.tolist() for x in reader.get(-3)] == [[0]]


def test_shards_of_no_rows(spark):
    none, uri = spark.createDataFrame([], "doc_id long, text string"), new_path(spark, "test-tokens")
    assert token_shards.write_tokens(none, uri, PATH).count() == 0 and token_shards.build_index(spark, uri).count() == 0
    assert token_shards.fetch(none, uri).count() == 0 and token_shards.TokenReader(spark, uri).get(1) == []
    assert token_shards.fetch(spark.createDataFrame([(1,), (None,)], "doc_id long"), uri).count() == 0


def test_index_is_minimal_and_perfect():
    keys = np.random.default_rng(2).integers(0, 2**64, 50_000, dtype=np.uint64)
    index = key_index.KeyIndex.from_bytes(key_index.KeyIndex.build(keys, np.arange(50_000), np.ones(50_000)).to_bytes())
    held, slots = index.find(keys)
    assert held.all() and (slots["first"] == np.arange(50_000)).all() and sorted(index.places(keys)) == list(range(50_000))
    assert index.find(np.arange(50_000, dtype=np.uint64))[0].sum() == 0
    with pytest.raises(ValueError, match="differ"):
        key_index.KeyIndex.build(np.array([1, 1], np.uint64), np.zeros(2), np.ones(2))


def test_rank_index_bounds_its_error():
    """All boundaries of lines of very unlike lengths: few segments, small residuals, exact cuts."""
    rng = np.random.default_rng(3)
    for lines in ([*(int(x) for x in rng.pareto(1.1, 5000) * 20), 100_000, *[1] * 2000], [60] * 3000, [0], []):
        text = "".join("é" * n + "\n" for n in lines) + "end" * (len(lines) % 2)
        y = infill.boundaries(np.frombuffer(text.encode(), np.uint8))
        assert y.tolist() == np.cumsum([0, *(len(x) for x in text.splitlines(keepends=True))]).tolist()
        first, at, slope = infill.segments(y, 64)
        off = y - infill.predicted(np.array(first), np.array(at), np.array(slope), np.arange(len(y)))
        assert abs(off).max() <= 65
        assert len(first) <= 1 + len(y) // 2
    y = np.arange(3001) * 61
    assert len(infill.segments(y, 64)[0]) == 1


def cut(doc_id, text, rate=100, spm=50):
    """By the contract, over Python strings."""
    text = text or ""
    lines = text.splitlines(keepends=True) if set(text) <= set("\n abcxyz<PSM>é") else None
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or d[2] % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if d[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("rate", [100, 40])
def test_cuts_of_odd_rows(spark, rate):
    texts = [None, "", "\n", "a", "a\n", "\n\nb", "x<P>y", "<S>", "a<M", "é\n" * 5000 + "<", "abc " * 3 + "\n", *("xyz\n" * k for k in range(1, 60))]
    docs = [(k, t, "mine", 1.5) for k, t in enumerate(texts)] + [(None, "a\nb\nc\n", None, None), (3, "a\nb\n", "twice", 0.0)]
    made = infill.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string, Output string, fim_text double"), rate=rate)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert made.columns == ["doc_id", "text", "fim_text", "n", "form", "prefix_chars", "middle_chars", "output", "rank_index"]
    assert sorted(((r.doc_id or 0), r.text or "", r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in got) == sorted((k or 0, t or "", c[0], c[1], c[2] or 0, c[3] or 0, c[4]) for k, t, *_ in docs for c in [cut(k, t, rate)])
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def coded(rows, parts, entries, rounds):
    """{(id, vector): (code, error)} and the digest, by all distances over Python integers."""
    ints = [(k, [math.floor(1024 * x) for x in v]) for k, _, v in rows]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(ints[0][1]) // parts
    cutting = lambda v: [v[k * w : (k + 1) * w] for k in range(parts)]
    books = [[cutting(v)[k] for _, v in ints[:entries]] for k in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for _, v in ints:
                own.setdefault(near(cutting(v)[k], books[k])[1], []).append(cutting(v)[k])
            books[k] = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[k])]
    out = {}
    for key, v in ints:
        best = [near(x, books[k]) for k, x in enumerate(cutting(v))]
        out[key, tuple(v)] = ("".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("entries", [7, 32, 256])
def test_codes_equal_all_distances(spark, entries):
    """Clusters, copies, ties and far points, small blocks; every row that has a code, by brute force."""
    rng = np.random.default_rng(4)
    rows = [(k, k % 3 if k % 5 else None, (rng.choice([-1.0, 0.0, 0.25, 3.0]) + rng.normal(size=8) * (k % 4) / 8).astype(np.float32).tolist()) for k in range(700)]
    rows += [(3, 1, [0.5] * 8), (None, None, [0.5] * 8), *((1000 + k, 0, [1.0] * 8) for k in range(50))]
    odd = [(2000, 0, None), (2001, 0, [1.0] * 7 + [None]), (2002, 0, [1.0] * 7 + [math.nan]), (2003, 0, [1.0] * 7 + [math.inf])]
    uncoded = [(2004, 9, [1.0] * 4), (2005, 0, []), (2006, 9, [1e30] + [0.0] * 7)]
    frame = spark.createDataFrame(rows + odd + uncoded, "vec_id long, label int, embedding array<float>").withColumn("n", F.lit(1)).withColumn("code", F.lit("x"))
    got = vector_codes.product_codes(frame.repartition(3), entries=entries, rounds=3).collect()
    want, digest = coded(rows, 4, entries, 3)
    assert len(got) == len(rows) + len(uncoded) and {r.codebooks_sha256 for r in got} == {digest}
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error) for r in got if r.vec_id is None or r.vec_id < 2000) == sorted((k if k is not None else -1, *want[k, tuple(math.floor(1024 * x) for x in v)]) for k, _, v in rows)
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + (r.error or 0)
    assert all(r.label_error == (None if r.label == 9 else sums[r.label]) for r in got)
    assert all(r.code is None and r.error is None for r in got if r.vec_id and r.vec_id >= 2000)


def test_trees_leave_no_nearer_entry():
    """Most nodes of close clusters are assigned whole; what nearest() leaves open holds the nearest entry."""
    rng = np.random.default_rng(5)
    points = (rng.integers(-8, 8, (40, 1)) * 4000 + rng.integers(-20, 20, (4000, 4)).reshape(40, 100, 4).sum(axis=1)[:, :1]).repeat(100, axis=0) + rng.integers(-20, 20, (4000, 4))
    book = points[rng.choice(4000, 64, replace=False)]
    order, entry_order = vector_codes.sort_points(points, vector_codes.LEAF), vector_codes.sort_points(book, 1)
    held, entries = vector_codes.tree(points[order], order, vector_codes.LEAF), vector_codes.tree(book[entry_order], entry_order, 1)
    node, entry, left = vector_codes.nearest(held, entries)
    best = np.argmin(vector_codes.distances(held.points, book), axis=1)
    seen = np.zeros(4000, int)
    for p, e in zip(node, entry, strict=True):
        assert (best[held.start[p] : held.end[p]] == e).all()
        seen[held.start[p] : held.end[p]] += 1
    for p, open_ in left:
        assert set(best[held.start[p] : held.end[p]]) <= set(open_) and len(open_) < 64
        seen[held.start[p] : held.end[p]] += 1
    assert (seen == 1).all()


def test_codes_of_nothing(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert vector_codes.product_codes(spark.createDataFrame([], shape)).count() == 0
    assert vector_codes.product_codes(spark.createDataFrame([(1, None, 1), (2, [None], 1)], shape)).count() == 0
    assert [r.code for r in vector_codes.product_codes(spark.createDataFrame([(1, [], 1)], shape)).collect()] == [None]
    with pytest.raises(ValueError, match="divide"):
        vector_codes.product_codes(spark.createDataFrame([(1, [1.0, 2.0], 1)], shape))


def test_kept_ids_serve_repeats_and_the_older_generation(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 2)
    asked = []
    kept = tokens.Kept(lambda words: asked.append(list(words)) or [None if w == "?" else w.encode() for w in words])
    assert kept.each(["a", "b", "a", "?"]) == [b"a", b"b", b"a", None]
    assert kept.each(["c", "b"]) == [b"c", b"b"] and kept.each(["a", "a"]) == [b"a", b"a"]
    assert asked == [["a", "b", "?"], ["c"], []] and kept.get("b") == b"b" and kept.get("x") is None
