"""Each operator on small rows: its rule against plain Python, and the cases its docstring defines."""

import hashlib
import random
import struct

import corpus_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tempora.llm import chat, common, decontaminate, langid, line_dedup, near_dedup, pii, sentencepiece, substring_dedup, topk, toxicity
from tempora.llm.queries import model_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, tag string, ids string, `class` string, _row string"
rng = random.Random(3)
VOCABULARY = [f"w{i:03d}" for i in range(400)]


def words(n, seed=None):
    pick = random.Random(seed) if seed is not None else rng
    return [pick.choice(VOCABULARY) for _ in range(n)]


def documents(spark, texts, source="s"):
    """Rows of documents with further columns whose names the operators use themselves."""
    rows = [(i, t, "en", source, 1, "a", "b", "c", "d", "e") for i, t in (texts if texts and isinstance(texts[0], tuple) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   ", "a", "\n\n", "ä" * 3000, " ".join(["word"] * 3000), "x" * 70_000]


# learning samples

def test_a_long_text_ranked_first_leaves_room_for_the_others(spark):
    docs = documents(spark, ["long " * 30, "short a", "short b", "word " * 40, "", None, "x" * 99])
    picked = spark.createDataFrame([(0, "p", 1), (1, "p", 2), (2, "p", 3), (3, "q", 1), (4, "q", 2), (6, "r", 1)], "_id long, _y string, _place int")
    found = common.sample_texts(docs, picked, 17)
    assert sorted(found) == [("", "q"), ("short a", "p"), ("short b", "p"), ("word word word", "q"), ("x" * 17, "r")]
    assert common.sample_texts(docs, picked.limit(0), 17) == []


def test_a_language_of_long_texts_only_is_learned(spark):
    docs = spark.createDataFrame([(i, t * (40 if y == "de" else 1), y) for i, (t, y) in enumerate((f"{t} ", y) for t, y in LEARN)], "doc_id long, text string, lang string")
    found = langid.identify(docs.limit(2), langid.fit(docs, max_chars=1_000)).collect()
    assert [r.lang_pred for r in found] == ["en", "de"]


# line dedup

def test_lines_over_the_ratio_go_and_others_stay(spark):
    pages = [f"menu\nown {i}\n  menu  \n\nfoot {i % 2}" for i in range(20)]
    rows = {r.doc_id: r for r in line_dedup.drop_boilerplate(documents(spark, pages), ratio=0.6, count="gone").collect()}
    assert rows[3].text == "own 3\n\nfoot 1" and rows[3].gone == 2 and rows[3].score == "a"
    none = line_dedup.drop_boilerplate(documents(spark, pages), ratio=0.6, min_pages=21)
    assert {r.text for r in none.collect()} == set(pages)


def test_line_dedup_is_per_site_and_survives_odd_rows(spark):
    odd = documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "menu")])
    many = documents(spark, [(100 + i, "menu") for i in range(12)], "other")
    bare = documents(spark, [(200 + i, "menu") for i in range(12)], None)
    out = {(r.doc_id, r.source): r.text for r in line_dedup.drop_boilerplate(odd.union(many).union(bare)).collect()}
    assert [out[i, "s"] for i in range(len(ODD))] == ODD
    assert out[None, "s"] == "menu" and out[100, "other"] == "" and out[200, None] == "menu"
    assert line_dedup.drop_boilerplate(odd.limit(0)).columns == odd.columns
    assert line_dedup.drop_boilerplate(odd.limit(0)).count() == 0


def test_repeated_pages_count_each_and_ratio_is_exceeded_not_reached(spark):
    rows = [(1, "a")] * 10 + [(2, f"b{i}") for i in range(10)]
    assert {r.text for r in line_dedup.drop_boilerplate(documents(spark, rows), ratio=0.5).collect()} >= {"a"}
    assert "a" not in {r.text for r in line_dedup.drop_boilerplate(documents(spark, rows), ratio=0.49).collect()}


def test_hosts_of_urls(spark):
    urls = spark.createDataFrame([("https://U:p@A.example.org:80/x",), ("http://b.example/?q",), ("no url",), (None,)], "url string")
    assert [r[0] for r in urls.select(line_dedup.host_of(F.col("url"))).collect()] == ["a.example.org", "b.example", None, None]


# language identification

LEARN = [("the cat and the dog are here with us", "en"), ("der hund und die katze sind hier bei uns", "de")] * 30


def test_chain_equals_plain_forward_backward():
    gen = np.random.default_rng(0)
    n, k = 300, 3
    psi, first = gen.random((n, k)) + 0.01, gen.random(n) < 0.1
    first[0] = True
    move, start = gen.random((k, k)), gen.random(k)
    a, b = np.zeros((n, k)), np.ones((n, k))
    for i in range(n):
        a[i] = (start if first[i] else a[i - 1] @ move) * psi[i]
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = 1 if first[i + 1] else move @ (psi[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    want = a * b / (a * b).sum(1, keepdims=True)
    got, pairs = langid.chain(psi, first, move, start, True)
    assert np.allclose(got, want) and np.isclose(pairs.sum(), (~first).sum())


def test_words_of_a_switched_text_get_their_own_languages():
    label = langid.Labeller(langid.train(LEARN))
    post = label.posteriors([["the", "dog", "and", "the", "cat", "und", "die", "katze", "sind", "hier"]])
    assert post[:4].argmax(1).tolist() == [1] * 4 and post[-4:].argmax(1).tolist() == [0] * 4


def test_language_of_odd_texts(spark):
    docs = documents(spark, [*ODD, "12 34 !", "the dog and the cat"])
    rows = {r.doc_id: r for r in langid.identify(docs, langid.train(LEARN)).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 4, 8)] == ["und"] * 5 and rows[0].score == 0.0
    assert rows[9].lang_pred == "en" and 0.5 < rows[9].score <= 1 and rows[5].lang_pred in ("en", "de")
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.fit(docs.limit(0)) is None and langid.identify(docs.limit(0), langid.train(LEARN)).count() == 0


def test_held_out_accuracy_of_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.select("doc_id", "text", "lang"), langid.fit(docs)).where(common.crc_held_out(F.col("doc_id")))
    good = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert good > 0.95


# decontamination

def test_masks_hit_every_pattern_of_two_replaced_words():
    for a in range(decontaminate.WINDOW):
        for b in range(decontaminate.WINDOW):
            assert any(not {a - o, b - o} & set(m) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1]))


def test_overlaps_equal_brute_force(spark):
    items = [(i, " ".join(words(n, 50 + i))) for i, n in enumerate([3, 5, 9, 13, 20, 40, 40])] + [(7, None), (8, "")]
    items += [(9, items[5][1])]
    docs = [(100, None), (101, ""), (102, " ".join(ODD[-1:])), (None, "x " + items[4][1])]
    for i in range(40):
        body = words(60, i)
        item = items[i % 7][1].split()
        for _ in range(i % 5):
            item[rng.randrange(len(item))] = "zz"
        body[20:20] = item[i % 3:]
        docs.append((i, " ".join(body).upper() if i % 2 else ", ".join(body)))
    docs.append(docs[4])
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(documents(spark, docs), frame).collect()}
    assert got == brute.overlaps(docs, items) and (None, 4) in got
    kept = {r.doc_id for r in decontaminate.clean(documents(spark, docs), frame).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.overlaps(documents(spark, docs), frame.limit(0)).count() == 0
    assert decontaminate.clean(documents(spark, docs).limit(0), frame).columns == documents(spark, docs[:1]).columns


# exact top-k

def test_topk_equals_brute_force(spark):
    gen = np.random.default_rng(1)
    rows = [(i, gen.normal(0, 1, 8).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 400)] + [(400, None), (401, [None] + [0.0] * 7), (402, [float("nan")] * 8), (403, [float("inf")] * 8)]
    rows += [(None, [1.0] * 8), (500, [1.0, 2.0]), (501, [2.0, 2.0]), (20, rows[20][1]), (502, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    v = topk.scaled(frame, "vec_id", "embedding", 64)
    topk.SHARD, topk.BLOCK, topk.LEAF, before = 64, 8, 8, (topk.SHARD, topk.BLOCK, topk.LEAF)
    try:
        got = sorted(tuple(r) for r in topk.search(v, v.where("id % 20 = 0"), 7).collect())
    finally:
        topk.SHARD, topk.BLOCK, topk.LEAF = before
    whole = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], e, strict=True)), i) for i, e in whole.items() if i != q and len(e) == len(whole[q]))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:7])]
    assert got == sorted(want)
    assert topk.search(v.limit(0), v.limit(0), 3).count() == 0


def test_large_components_stay_exact():
    big = np.array([[2**40, 1], [2**40, 2]], np.int64)
    rows, _ = topk.search_shard(big[:1], np.array([9]), big, np.array([1, 2]), 2, np.full(1, -np.inf))
    assert sorted(rows) == [(0, 1, 2**80 + 1), (0, 2, 2**80 + 2)]


def test_topk_moves_blocks_and_shards_without_a_join(spark, monkeypatch):
    for name, value in {"SHARD": 16, "LEAF": 4, "BLOCK": 4, "BLOCKS": 3, "LARGE_BLOCK": 16, "STRIPE": 2, "STRIPES": 3, "PENDING": 5}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    gen = np.random.default_rng(4)
    # many equal vectors and scores, and numbers of every width
    rows = [(i, [1, 1, 2]) for i in range(0, 90, 3)] + [(i, gen.integers(-3, 4, 3).tolist()) for i in range(1, 90, 3)]
    rows += [(i, [int(x) for x in gen.integers(-10**e, 10**e, 2)]) for i, e in zip(range(2, 90, 3), [1, 3, 5, 8, 9] * 6, strict=False)]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    result = topk.search(v, v.where("id % 2 = 0"), 5)
    want = []
    for q, a in rows:
        scores = sorted((-sum(x * y for x, y in zip(a, e, strict=True)), i) for i, e in rows if i != q and len(e) == len(a))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5]) if q % 2 == 0]
    assert sorted(tuple(r) for r in result.collect()) == sorted(want)
    # rows of many queries or vectors are small on disk: the planner must not get to broadcast them
    assert "Join" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_large_scores_are_ranked_exactly():
    big = np.array([[2**40, i] for i in (3, 1, 2, 2)], np.int64)
    rows, kth = topk.search_shard(big[:2], np.array([1, 9]), big, np.array([1, 2, 3, 4]), 2, np.full(2, -np.inf))
    assert sorted(rows) == [(0, 3, 2**80 + 6), (0, 4, 2**80 + 6), (1, 1, 2**80 + 3), (1, 3, 2**80 + 2)]
    assert kth.tolist() == [2**80 + 6, 2**80 + 2]


# near duplicates

def test_sketch_fills_every_coordinate_and_estimates():
    gen = np.random.default_rng(2)
    for n in (1, 2, 7, 160, 5000):
        assert near_dedup.sketch(gen.integers(0, 2**63, n, dtype=np.uint64)).max() < 2**63
    x = gen.integers(0, 2**63, 1000, dtype=np.uint64)
    assert abs((near_dedup.sketch(x[:800]) == near_dedup.sketch(x)).mean() - 0.8) < 0.12


def test_near_groups_equal_brute_force(spark):
    docs = [(1000 + i, t) for i, t in enumerate(ODD)] + [(1100, "A b c"), (1101, "a  B\tc"), (1102, "a b")]
    for g in range(4):
        base = words(120, 900 + g)
        for i in range(40):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            docs.append((g * 50 + i, " ".join(copy)))
        docs.append((500 + g, docs[-3][1]))
    rng.shuffle(docs)
    rows = near_dedup.components(documents(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_members_of_a_pivot_are_linked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2000)
    test_near_groups_equal_brute_force(spark)


def test_near_dedup_of_null_repeated_and_no_rows(spark):
    text = " ".join(words(30, 5))
    docs = documents(spark, [(None, text), (3, text), (3, text), (2, text), (4, None), (5, "")])
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.components(docs).collect()), key=repr)
    assert rows == sorted([(None, None, True), (3, 2, False), (3, 2, False), (2, 2, True), (4, 4, True), (5, 5, True)], key=repr)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 4, 5]
    assert near_dedup.components(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {r.node: r.root for r in common.components(frame, "test").collect()}
    assert len({root[i] for i in range(61)}) == 1 and len({root[i] for i in range(100, 140)}) == 1
    assert root[0] != root[100] and set(root) == set(range(61)) | set(range(100, 140))


# toxicity

def test_unseen_misspelling_scores_like_its_word():
    pick = random.Random(4)
    sample = [(" ".join([*pick.choices(VOCABULARY, k=30), *(["dreadfulness"] * (i % 2))]), i % 2) for i in range(400)]
    score = toxicity.Scorer(toxicity.train(sample))
    plain, bad, misspelt, empty, none = score([" ".join(words(30, 1)), "w001 w002 dreadfulness w004", "w001 w002 dreadfulnesss w004", "", None])
    assert plain < 0.5 < min(bad, misspelt) and empty == none and 0 <= empty <= 1


def test_every_slot_of_five_texts_is_learned():
    pick = random.Random(5)
    common_words = " ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(900))
    model = toxicity.train([(common_words + " dreadfulness" * (i < 6), int(i < 30)) for i in range(60)], epochs=3)
    assert model.slot_logit[toxicity.slots_of(["dreadfulness"])[1]].all()


def test_texts_by_slots_multiply_as_one_matrix(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", 7)
    gen = np.random.default_rng(1)
    plain = (gen.random((9, 40)) * (gen.random((9, 40)) < 0.3)).astype(np.float32)
    used = gen.permutation(40)[:30]
    texts = toxicity.Texts([(np.flatnonzero(r).astype(np.int32), r[r != 0]) for r in plain], used, block=5)
    right, left = gen.random((30, 3)).astype(np.float32), gen.random((9, 3)).astype(np.float32)
    assert np.allclose(texts.times(right), plain[:, used] @ right, atol=1e-5) and np.allclose(texts.back(left), plain[:, used].T @ left, atol=1e-5)


def test_toxicity_of_odd_rows_and_nothing_to_learn(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}
    model = toxicity.train([("bad " * 3, 1), ("good " * 3, 0)] * 20)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = toxicity.clean(docs, None)
    assert kept.columns == docs.columns and kept.first().score == "a"
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).join(labels, "doc_id").where(common.crc_held_out(F.col("doc_id")))
    hit, said, true = scored.select(F.sum((F.col("predicted") * F.col("toxic")).cast("int")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit / true > 0.75 and hit / said > 0.75


# substring dedup

def test_repeats_equal_brute_force(spark):
    passage = words(50, 77)
    docs = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, " ".join(passage)), (None, "x " + " ".join(passage[:34]))]
    for i in range(30):
        body = words(80, 300 + i)
        if i % 3 == 0:
            at = rng.randrange(80)
            body[at:at] = passage[rng.randrange(10):rng.randrange(34, 51)]
        docs.append((i, ("\n" if i % 2 else "  ").join(body)))
    docs += [(50, docs[-1][1]), (51, docs[-1][1]), (51, docs[-1][1]), (52, " ".join(passage + words(5, 1) + passage))]
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["n_words"])
    found = substring_dedup.dedup(documents(spark, docs))
    rows = found.select("doc_id", "n_words", gone, F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute.repeats(docs)
    assert all(n >= 35 for r in found.collect() for n in [s.n_words for s in r.repeats])
    assert substring_dedup.dedup(documents(spark, docs).limit(0)).count() == 0


# sentencepiece

def test_tokens_equal_the_library(spark):
    import sentencepiece as library

    p = library.SentencePieceProcessor(model_file=model_file())
    texts = [*ODD[:-1], " a  b ", "▁a ▁▁ b▁", "\tx\r\ny", "<s> </s>", "日本 語 🙂", "a\u0000b", "é ﬁ", " " * 40, *(" ".join(words(20)) for _ in range(5))]
    texts += [t[:200] for t, in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    packed = {r.doc_id: r for r in sentencepiece.encode(documents(spark, texts), model_file(), packed=True).collect()}
    plain = sentencepiece.encode(documents(spark, texts), model_file())
    decoded = {r.doc_id: r for r in sentencepiece.decode(plain, model_file()).collect()}
    for i, t in enumerate(texts):
        ids = p.encode(t or "", add_bos=True, add_eos=True)
        assert packed[i].ids == struct.pack(f"<{len(ids)}I", *ids) and packed[i].n_tokens == len(ids)
        assert packed[i].decoded == p.decode(ids) == decoded[i].decoded and decoded[i].ids == ids
    assert packed[0].score == "a" and hashlib.sha256(packed[0].ids).digest_size == 32
    assert sentencepiece.encode(documents(spark, texts).limit(0), model_file()).count() == 0


# personal data

def test_base_spans_equal_brute_force(spark):
    alphabet = ["a", "b.c", "@", ".", "1", "23", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (55", ") 010-9999", " ", " ", "\n", "_", "é", "+", "-", "%", "1.2.3.4"]
    texts = [*ODD, "1" * 5000, "a@" + "b." * 3000 + "c", "+1" + "(" * 3000, "1 " * 4000]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(400)]
    rows = {r.doc_id: r for r in pii.digests(pii.find(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = brute.personal(t)
        assert rows[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{z}" for k, a, z in spans)), t
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(k == s[0] for s in spans) for k in pii.KINDS]


def test_terms_that_give_an_entity_away(spark):
    texts = [f"ask {'Zorblatt'} about x@y.example now, line {i}" for i in range(5)] + ["about nothing ask line"] * 20 + ["Zorblattian ask"]
    found = pii.find(documents(spark, texts))
    first = {r.doc_id: r for r in pii.digests(found).collect()}
    assert first[0].spans == "email:19:30,term:4:12" and first[5].spans == ""
    text = {r.doc_id: r.text for r in pii.sanitised(documents(spark, texts), found).collect()}
    assert text[2] == "ask  about [email] now, line 2" and text[25] == texts[25]
    bare = documents(spark, [(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (1, None)])
    assert sorted((str(r.doc_id), r.n_email) for r in pii.digests(pii.find(bare)).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert pii.find(bare.limit(0)).count() == 0


def test_a_term_beside_an_entity_of_one_document_gives_it_away(spark):
    texts = ["mail Zorblatt there: x@y.example today", "meet Quuxley there: a@b.example today", "meet Quuxley there: a@b.example today"] + ["they meet there today and mail"] * 200
    found = pii.find(documents(spark, texts))
    assert [r.spans for r in pii.digests(found).orderBy("doc_id").collect()[:4]] == ["email:21:32,term:5:13"] + ["email:20:31,term:5:12"] * 2 + [""]
    assert pii.sanitised(documents(spark, texts), found).where("doc_id = 0").first().text == "mail [term] there: [email] today"


def test_terms_far_from_their_entity_are_marked_wherever_they_stand(spark):
    gap = "they meet there today and mail " * 4
    texts = [f"Zorblatt {gap}x@y.example {gap}zorblatt", f"x@y.example {gap}", f"{gap}Zorblatt, x@y.example p@q.example r@s.example"] + [gap] * 300
    rows = {r.doc_id: r.spans for r in pii.digests(pii.find(documents(spark, texts + ["they today"]))).collect()}
    assert rows[0].split(",")[1:] == ["term:0:8", f"term:{len(texts[0]) - 8}:{len(texts[0])}"]
    assert "term" not in rows[1] and "term" not in rows[3] and rows[2].split(",")[3:] == ["term:124:132"]


# chat

def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("part", F.lit("y"))


def least_cost(roles):
    """The least cost over all choices, tried one by one."""
    best = {chat.START: 0.0}
    for r in roles:
        after = {}
        for s, c in best.items():
            options = [(c + (chat.MERGE if s == r else chat.MERGE + chat.RELABEL), s)] if s != chat.START else []
            for q in chat.NEXT[s]:
                options.append((c + (0 if q == r else chat.RELABEL), q))
                for z in chat.NEXT[q]:
                    options.append((c + chat.INSERT + (0 if z == r else chat.RELABEL), z))
            for cost, s2 in options:
                after[s2] = min(after.get(s2, 1e9), cost)
        best = after
    return min(c + chat.finish(s)[0] for s, c in best.items())


@pytest.mark.parametrize("part", [4096, 3])
def test_repair_costs_least_and_is_legal(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    pick = random.Random(6)
    convs = {i: [pick.choice(["user", "assistant", "system", "tool", None, " User "]) for _ in range(pick.randrange(1, 14))] for i in range(60)}
    rows = [(i, t, r, f"t{t}") for i, roles in convs.items() for t, r in enumerate(roles)]
    out = {}
    for r in sorted(chat.repair(conversations(spark, rows)).collect(), key=lambda r: (r.conv_id, r.part)):
        cost, roles, text, n = out.get(r.conv_id, (0.0, [], "", 0))
        out[r.conv_id] = cost + r.cost, roles + [x for x in r.roles.split(",") if x], text + r.rendered, n + r.n_turns
    for i, roles in convs.items():
        cost, made, text, n = out[i]
        assert cost == least_cost([chat.role_of(r) for r in roles]) and n == len(roles)
        state = chat.START
        for m in made:
            assert chat.NAMES.index(m) in chat.NEXT[state]
            state = chat.NAMES.index(m)
        assert state in chat.FINAL and text.count("<|end|>") == len(made)
        assert [text.count(f"t{t}\n") + text.count(f"t{t}<") for t in range(len(roles))] == [1] * len(roles)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, "user", "late <|end|>"), (2, 0, "system", "s"),
            (None, 0, "user", "x"), (None, 0, "user", "y"), (3, 0, "user", "q" * 100_000)]
    out = sorted(((r.conv_id, r.rendered, r.cost) for r in chat.repair(conversations(spark, rows)).collect()), key=repr)
    text = {c: "".join(t for d, t, _ in out if d == c) for c in (2, 3)}
    first = "".join(r.rendered for r in sorted((r for r in chat.repair(conversations(spark, rows)).collect() if r.conv_id == 1), key=lambda r: r.part))
    assert first == "<|user|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user|>\nlate < |end|><|end|>\n"
    assert text[2] == "<|user|>\ns<|end|>\n" and len(text[3]) > 100_000
    assert sorted(t for c, t, _ in out if c is None) == ["<|user|>\nx<|end|>\n", "<|user|>\ny<|end|>\n"]
    assert chat.repair(conversations(spark, rows).limit(0)).count() == 0
