"""The registered queries opN_<name> of the corpus operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import chat, collocation, common, decontaminate, langid, line_dedup, lm_score, near_dedup, pii, sentencepiece, spelling, substring_dedup, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def model_file() -> str:
    """The tokenizer model of a public package; PIECE_MODEL names another file."""
    import public_tokenizers

    return os.environ.get("PIECE_MODEL") or str(public_tokenizers.path("piece_bpe_32k.model"))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


LINES = """
WITH cut AS (
  SELECT doc_id, source, text, row_number() OVER () AS page FROM documents),
lines AS (
  SELECT page, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS place FROM cut),
pages AS (SELECT source, count(*) AS total FROM cut WHERE source IS NOT NULL GROUP BY 1),
bad AS (
  SELECT source, trim(line) AS line FROM lines JOIN pages USING (source) WHERE trim(line) <> ''
  GROUP BY source, trim(line), total
  HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) > 0.1 * total),
kept AS (
  SELECT page, string_agg(l.line, chr(10) ORDER BY place) FILTER (b.line IS NULL) AS kept,
         count(b.line) AS n
  FROM lines l LEFT JOIN bad b ON b.source = l.source AND b.line = trim(l.line) GROUP BY page)
"""


@query("op1_line_dedup", LINES + """
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text,
       coalesce(n, 0) AS lines_dropped
FROM cut LEFT JOIN kept USING (page)""")
def op1(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, count="lines_dropped")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", common.crc_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op3_decontamination")
def op3(spark, sf_dir):
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.overlaps(docs.select("doc_id", "text"), items).drop("tag")


@query("op4_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op4(spark, sf_dir):
    vectors = topk.scaled(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.search(vectors, vectors.where("id % 20 = 0"), 20)


@query("op5_minhash_near_dedup")
def op5(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.components(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return found.select("doc_id", common.crc_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


REPEATS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i + 1:i + 35], ' ') AS s
  FROM (SELECT r, w, unnest(range(len(w) - 35 + 1)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (
  SELECT r, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
marked AS (
  SELECT x.r, x.i, word,
         count(y.i) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 35 - 1 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words x LEFT JOIN repeated y ON y.r = x.r AND y.i = x.i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (
  SELECT r, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY r) USING (r)
"""


@query("op7_substring_dedup", REPEATS)
def op7(spark, sf_dir):
    found = substring_dedup.dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["n_words"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_sentencepiece")
def op8(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = sentencepiece.encode(docs, model_file(), packed=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_pii")
def op9(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs))


@query("op10_chat_formatting")
def op10(spark, sf_dir):
    return chat.repair(common.table(spark, sf_dir, "conversations"))


SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
named AS (SELECT run, n, doc_id, hex(doc_id || ':' || run) AS x FROM counted),
bytes AS (
  SELECT run, n, doc_id, list_transform(range(length(x) // 2), lambda i:
           (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS b
  FROM named),
hashed AS (
  SELECT run, n, doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) AS h
  FROM bytes, crc),
cut AS (
  SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 199 = 0
                 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
fewer AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM fewer a JOIN fewer b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM fewer a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM fewer a JOIN words b ON a.v = b.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
         CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
way AS (
  SELECT word, word AS now, 0 AS steps FROM forms
  UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN forms f ON f.word = way.now WHERE f.form IS NOT NULL),
top AS (SELECT word, arg_max(now, steps) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN top USING (word)"""


@query("op11_spelling_variants", SPELLING)
def op11(spark, sf_dir):
    return spelling.variants(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_lm_scores")
def op12(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = lm_score.score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM cut GROUP BY lang),
begun AS (SELECT lang, w, unnest(range(len(w))) AS i FROM cut),
grams AS (
  SELECT lang, m AS size, array_to_string(w[i + 1:i + m], ' ') AS phrase
  FROM begun, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
scores AS (
  SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM best, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ o USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query("op13_phrase_collocations", PHRASES)
def op13(spark, sf_dir):
    return collocation.collocations(common.table(spark, sf_dir, "documents").select("lang", "text"))
