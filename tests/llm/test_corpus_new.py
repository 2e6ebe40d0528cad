"""Spelling variants, language-model scores and collocations against plain versions, and their odd cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tempora.llm import collocation, common, elias_fano, lm_score, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, word string, n long, phrase string, score string, block string, learn string"
ODD = [None, "", "   ", "a", "\n\n", "ä" * 3000, " ".join(["word"] * 3000), "x" * 70_000, ".,;:!?" * 50, "\xff \x85  "]


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, "en")[:2] + (r[2] if len(r) > 2 else "en", "a", 1, "b", "c", "d", "e") for r in rows], SCHEMA)


# collocations

def plain_collocations(rows, least, top):
    f, total = {}, Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((p, a, counts[p[:k]], counts[p[k:]], score))
        kept = [c for c in found if not any(
            len(q[0]) > len(c[0]) and 100 * q[1] >= 80 * c[1] and any(q[0][i:i + len(c[0])] == c[0] for i in range(len(q[0]))) for q in found)]
        kept.sort(key=lambda c: (-c[4], -c[1], " ".join(c[0]).encode()))
        out += [(lang, i + 1, " ".join(p), a, x, y, total[lang], s) for i, (p, a, x, y, s) in enumerate(kept[:top])]
    return sorted(out)


def phrase_rows():
    pick = random.Random(7)
    shared = [" ".join(pick.choices("abcdefgh", k=40)) for _ in range(5)]
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(50, "a b c", None), (51, "A b, c", "und")]
    for i in range(60):
        body = " ".join(pick.choice(["New  York", "new york,", "of the", "the", "a\tb", "Ä", "b c.", "x"]) for _ in range(60))
        rows.append((100 + i, body + "\n" + pick.choice(shared), pick.choice(["en", "de", None])))
    return [*rows, rows[-1], (None, rows[-2][1], "en")]


@pytest.mark.parametrize("part", [collocation.PART, 20])
def test_collocations_equal_a_plain_count(spark, monkeypatch, part):
    monkeypatch.setattr(collocation, "PART", part)
    rows = phrase_rows()
    found = collocation.collocations(documents(spark, rows), least=4, top=40)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 4, 40)


def test_chunks_give_back_the_text_and_hold_each_phrase_once():
    hashes, pick = common.WordHashes(), random.Random(1)
    tokens = collocation.tokens_of(" ".join(pick.choices(["a", "b", "c", "d,", "e"], k=3000)))
    cut = [c.split(b" ") for c in collocation.chunks(tokens, hashes)]
    assert len(cut) > 20 and [t for c in cut for t in c[:-3]] == tokens
    assert all(a[-3:] == b[:3] for a, b in zip(cut, cut[1:], strict=False))
    assert collocation.chunks([], hashes) == []


def test_collocations_of_nothing_and_large_numbers(spark):
    none = collocation.collocations(documents(spark, phrase_rows()).limit(0))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", "p q", 2, big), ("en", "p", 1, big + 3), ("en", "q", 1, big), ("en", None, 1, 3 * big // 2)], "lang string, phrase string, size int, f long")
    assert [r.score for r in collocation.scored(counts).collect()] == [2_000_000 * big // (2 * big + 3)]


# spelling variants

def plain_variants(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = 1 if d is None else zlib.crc32(f"{d}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(x, y):
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))

    form, out = {}, []
    beside = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(beside[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n.get(form[w])))
    return sorted(out, key=repr)


def spelled_rows():
    pick, words = random.Random(11), Counter()
    letters = "abÀé"
    for _ in range(60):
        word = "".join(pick.choices(letters, k=pick.randrange(6, 12)))
        times = pick.choice([5, 6, 30, 200])
        words[word] += times
        for _ in range(5):
            at, c = pick.randrange(len(word) + 1), pick.choice(letters)
            words[pick.choice([word[:at] + c + word[at:], word[:at] + c + word[at + 1:], word[:at] + word[at + 1:]])] += max(5, times // pick.choice([1, 5, 6]))
    words.update({"aaaaaa": 50, "aaaaaaa": 9, "aaaaaaaa": 400, "x" * 30_000: 6, "x" * 29_999: 40})
    runs = [w for w, n in words.items() for _ in range(n)]
    pick.shuffle(runs)
    rows = [(i, " ".join(runs[i::97]).upper() if i % 3 == 0 else ",".join(runs[i::97])) for i in range(97)]
    return [*enumerate(ODD, 200), *rows, rows[5], (None, rows[6][1]), (None, None)]


@pytest.mark.parametrize(("crowd", "block"), [(spelling.CROWD, spelling.BLOCK), (3, 50), (0, 2000)])
def test_variants_equal_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelled_rows()
    found = spelling.variants(documents(spark, rows), crowd=crowd)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_variants(rows)


def test_variants_of_nothing(spark):
    none = spelling.variants(documents(spark, [(1, "a")]).limit(0))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w40"}


# language-model scores

def test_elias_fano_gives_back_what_it_holds():
    gen = np.random.default_rng(3)
    for values in ([0], [0, 0, 5], [7] * 200, np.sort(gen.integers(0, 10**12, 3000)), np.sort(gen.integers(0, 9, 3000)), [2**40]):
        values = np.array(values, np.int64)
        held = elias_fano.EliasFano.over(elias_fano.EliasFano.of(values).arrays())
        assert (held[np.arange(len(values))] == values).all()
        ask = gen.integers(0, int(values[-1]) + 2, 500)
        at, found = held.successor(np.zeros(500, np.int64), np.full(500, len(values)), ask)
        assert (at == np.searchsorted(values, ask)).all() and (found == np.isin(ask, values)).all()
    gaps = np.sort(gen.integers(0, 10**12, 4_000_000))
    whole = elias_fano.EliasFano.of(gaps)
    assert sum(a.nbytes for a in whole.arrays()) < 0.45 * gaps.nbytes


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [""]


def plain_scores(rows, learn):
    c = [Counter(), Counter(), Counter()]
    for d, text in rows:
        if learn(d):
            w = ["", *tokens(text)]
            for i in range(1, len(w)):
                c[0][w[i]] += 1
                c[1][w[i - 1], w[i]] += 1
                c[2][tuple(w[i - 2:i + 1])] += i > 1
    total, distinct = sum(c[0].values()), len(c[0])
    p1 = {w: (c[0][w] + 1) / (total + distinct + 1) for _, t in rows for w in tokens(t)}

    def left_out(m):
        return sum(n * math.log10((n - 1 + m * p1[w]) / (c[0][v] - 1 + m)) for (v, w), n in c[1].items())

    m = max(lm_score.MASSES, key=left_out)

    def log10(u, v, w):
        p = (c[1][v, w] + m * p1[w]) / (c[0][v] + m)
        if u is not None and c[1][u, v] >= lm_score.CONTEXT:
            p = (c[2][u, v, w] + m * p) / (c[1][u, v] + m)
        return math.log10(p)

    out = []
    for d, text in rows:
        t = tokens(text)
        w = [None, "", *t]
        out.append((d, bool(learn(d)), len(t), sum(c[0][x] > 0 for x in t), total, sum(math.log10(p1[x]) for x in t), sum(log10(*w[i:i + 3]) for i in range(len(t)))))
    return out


@pytest.mark.parametrize(("block", "shard"), [(lm_score.BLOCK, lm_score.SHARD), (300, 200)])
def test_scores_equal_plain_counts(spark, monkeypatch, block, shard):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "SHARD", shard)
    pick = random.Random(2)
    rows = [*enumerate(ODD), (None, "the cat"), (None, None)]
    rows += [(100 + i, " ".join(pick.choice(["the cat sat", "The dog", "on the mat", f"w{pick.randrange(40)}"]) for _ in range(pick.randrange(30)))) for i in range(60)]
    rows += rows[-3:]
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = [tuple(r) for r in lm_score.score(documents(spark, rows), flag).collect()]
    want = plain_scores(rows, learn)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[6] - b[6]) <= 3 * a[2] / (2 * elias_fano.GRID)


def test_scores_with_nothing_to_learn_or_to_score(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    rows = sorted(tuple(r) for r in lm_score.score(docs, F.lit(False)).collect())
    assert rows == [(1, False, 3, 0, 0, 0.0, 0.0), (2, False, 1, 0, 0, 0.0, 0.0)]
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0


def test_a_block_of_texts_is_stored_small_and_alone(spark, monkeypatch):
    kept, stored = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, **options: kept.setdefault(name, stored(df, name, **options)))
    monkeypatch.setattr(lm_score, "BLOCK", 3000)
    docs = documents(spark, [(i, "the cat sat on the mat " * 60) for i in range(20)]).coalesce(1)
    assert lm_score.score(docs, F.lit(True)).count() == 20
    rows = kept["blocks"].select("ends", "tokens").collect()
    # a reader lays all blocks of a file out at once, and the JVM copies a row several times
    assert len(rows) > 5 and len(kept["blocks"].inputFiles()) == len(rows)
    assert all(len(r.tokens) < 2 * r.ends[-1] for r in rows)


# what earlier operators now do

def test_a_menu_of_a_small_site_goes_and_lists_are_spread_alike(spark):
    from tempora.llm import line_dedup

    docs = spark.createDataFrame([(i, f"menu\nown {i}\npair {i // 2}", "small") for i in range(9)] + [(100 + i, f"foot\nx{i % 30}\ny{i}", "large") for i in range(200)]
                                 + [(400, "menu\nmenu", "lone"), (401, None, None)], "doc_id long, text string, source string")
    plain = line_dedup.drop_boilerplate(docs, count="gone")
    got = {r.doc_id: (r.text, r.gone) for r in plain.collect()}
    assert got[3] == ("own 3", 2) and got[8] == ("own 8\npair 4", 1) and got[101] == ("x1\ny1", 1) and got[400] == ("menu\nmenu", 0)
    spread = line_dedup.drop_boilerplate(docs, count="gone", broadcast_lines=0, spread_pages=7)
    assert {r.doc_id: (r.text, r.gone) for r in spread.collect()} == got


def test_one_row_of_each_component_stays_whatever_repeats(spark):
    from tempora.llm import near_dedup

    pick = random.Random(5)
    base = pick.choices([f"w{i}" for i in range(300)], k=200)
    a, b = " ".join(base), " ".join([*base[:199], "other"])
    c = " ".join(pick.choices([f"v{i}" for i in range(300)], k=50))
    rows = [(2, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, b), (7, ""), (7, ""), (None, None)]
    kept = near_dedup.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    one = got.pop((2, a), 0) + got.pop((2, b), 0)
    assert one == 1 and got == {(None, c): 1, (7, ""): 2, (None, None): 1}
    assert near_dedup.one_of_each(documents(spark, rows).limit(0)).count() == 0


def test_short_benchmark_items_are_searched_whole(spark):
    from tempora.llm import decontaminate

    docs = documents(spark, [(1, "Alpha, beta gamma"), (2, "beta alpha"), (3, "gamma"), (4, None)])
    items = spark.createDataFrame([(10, "alpha beta"), (11, "gamma"), (12, ""), (13, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}
    assert found == {(1, 10), (1, 11), (3, 11)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items, least_words=2).collect()} == {(1, 10)}


def test_numbers_without_letters_are_no_language(spark):
    from tempora.llm import langid

    docs = documents(spark, [(1, "½ ² ① Ⅳ"), (2, "the ½ cat"), (2, "the ½ cat")])
    model = langid.train([("the cat", "en"), ("die katze", "de")] * 30)
    assert sorted(r.lang_pred for r in langid.identify(docs, model).collect()) == ["en", "en", "und"]


def test_only_texts_of_rows_that_go_or_repeat_are_exchanged(spark, monkeypatch):
    from tempora.llm import near_dedup

    pick = random.Random(6)
    text = [" ".join(pick.choices([f"w{i}" for i in range(300)], k=30)) for _ in range(20)]
    rows = [*enumerate(text), (50, text[0]), (51, text[1]), (52, None)]
    want = sorted((i, t) for i, t in rows if i < 50) + [(52, None)]
    kept = near_dedup.one_of_each(documents(spark, rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "ArrowEvalPython" in plan[plan.index("LeftAnti"):]
    # with a table so small that every key is marked the join alone decides
    monkeypatch.setattr(near_dedup, "FATE_BITS", 6)
    assert sorted((r.doc_id, r.text) for r in near_dedup.one_of_each(documents(spark, rows)).collect()) == want
