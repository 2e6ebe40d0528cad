"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import corpus_brute as brute
import corpus_pipeline
import pytest
from catalog import check
from helpers import SMALL
from tempora.llm import common, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    verdict = check.compare(spark, check.connect(SMALL), SMALL, queries.QUERIES[name], queries.ORACLE[name])
    assert verdict.startswith("ok"), verdict


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_plain_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    model = toxicity.fit(docs, common.table(spark, SMALL, "labels"))
    rows = [r.asDict() for r in docs.collect()]
    scores = toxicity.Scorer(model)([r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]

    pages, held = {}, {}
    for r in rows:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for line in {x.strip(" ") for x in (r["text"] or "").split("\n")} - {""}:
            held[r["source"], line] = held.get((r["source"], line), 0) + 1
    bad = {k for k, n in held.items() if n >= 2 and n > 0.1 * pages[k[0]]}
    for r in rows:
        if r["text"] is not None:
            r["text"] = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in bad)

    groups = brute.near([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]
    items = [tuple(r) for r in common.table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    grams = {g for _, t in items for w in [brute.words_for_overlap(t)] for g in zip(w, w[1:], w[2:], w[3:])}
    near = [r for r in rows for w in [brute.words_for_overlap(r["text"])] if any(g in grams for g in zip(w, w[1:], w[2:], w[3:]))]
    leaks = {d for d, _ in brute.overlaps([(r["doc_id"], r["text"]) for r in near], items)}
    rows = [r for r in rows if r["doc_id"] not in leaks]

    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    want = {r["doc_id"]: (r["text"], p.encode(r["text"] or "", add_bos=True, add_eos=True)) for r in rows}
    got = {r.doc_id: (r.text, r.ids) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want
