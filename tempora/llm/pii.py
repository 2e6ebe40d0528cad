"""Personal data: patterns, and terms that disclose it, in DataFrame functions only.

*Base spans* are the leftmost non-overlapping matches of each kind (email, ip, card, phone) that pass
its test; failing matches are dropped.  The patterns are written without needless backtracking, so
that a long run of letters or digits costs its length, not its square; they match what the plain
ones match.  Positions come from the lengths of matches and of the text between them, summed per text.

*Terms* by information-theoretic sanitisation: an entity is the value of a base span, a term a word
of four letters or more of a document that holds an entity, wherever it stands.  Over the whole corpus

    IC(e) = ln(N / df(e)),  PMI(e, t) = ln(N * n(e, t) / (df(e) * df(t))),

where df counts the documents that hold e or t and n(e, t) those that hold both.  PMI is
ln(P(e|t) / P(e)), and P(e|t) = n(e, t) / df(t) says little when the counts are low, so it is
estimated as (n(e, t) + ``PRIOR`` * P(e)) / (df(t) + ``PRIOR``), as if ``PRIOR`` further documents held t
by chance; there is no least count.  A term discloses an entity if PMI(e, t) >= ``DISCLOSURE`` * IC(e):
knowing the term then gives away (nearly) all that knowing the entity says.  Every place of it in
every document that holds the entity becomes a span of kind ``term``.  In sanitised text, base spans
become their kind in brackets, terms with PMI >= ``REMOVAL`` * IC are removed and the other ones
generalised to ``[term]``.

Scale: a term discloses e only if df(t) <= ``reach`` = df(e) * (N / df(e)) ** (1 - ``DISCLOSURE``), since
the estimate lies between n / df(t) and P(e), and n <= df(e).  So only words that are about as rare
as an entity of their document meet its entities, and entities that stand in the same documents,
which all terms treat alike, count as one; an entity that stands once adds no pairs to the others of
its document.  Words are listed with their places only for documents that hold an entity; document
counts of words are distinct per text first and combined before the shuffle; texts themselves are not
shuffled.  Spans and words of one text are ordered per text.

Defined results: a null text is an empty one; null and repeated doc_ids are told apart by their text,
rows that repeat both get the same spans each; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common

KINDS = ("email", "ip", "card", "phone")
PRIOR = 0.25
DISCLOSURE = 0.9
REMOVAL = 0.97

# What the kinds look like.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}  # without it there is no match
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"(?<![^\s(\"'])\p{L}{4,}+(?=[,;:!?)\"'.]*+(?:\s|$))"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + term(i))
    return total % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _matches(kind: str, text: Column) -> Column:
    """Array of matches with the length of the text before; null if there is none."""
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    found = F.transform(
        F.arrays_zip(values.alias("value"), F.slice(between, 1, F.size(values)).alias("before")),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["value"].alias("value"), F.length(m["before"]).alias("gap")))
    hint = text.contains(HINTS[kind]) if kind in HINTS else F.lit(True)
    return F.when(hint & text.rlike(pattern), found)


def keyed(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select("doc_id", key.alias("key"), common.text_tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def _hits(text: Column) -> Column:
    """Matches of all kinds, before their tests."""
    return F.flatten(F.filter(F.array(*(_matches(k, text) for k in KINDS)), lambda found: found.isNotNull()))


def base_spans(rows: DataFrame) -> DataFrame:
    """``key, tag, kind, start, end, value`` of ``keyed`` rows."""
    hits = rows.select("key", "tag", F.explode(_hits(F.col("text"))).alias("m")).select("key", "tag", "m.*")
    hits = hits.dropDuplicates(["key", "tag", "kind", "i"])
    place = Window.partitionBy("key", "tag", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.length("value")).cast("long")).over(place)
    found = hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return found.where(passes(F.col("kind"), F.col("value"))).drop("i", "gap")


def words_beside(rows: DataFrame) -> DataFrame:
    """``key, tag, term, start, end`` of the words of every text that holds an entity."""
    text = F.col("text")
    values = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, TERM, -1), F.length), 1, F.size(values))
    word = F.posexplode(F.arrays_zip(F.transform(values, F.lower).alias("term"), F.transform(values, F.length).alias("n"), gaps.alias("gap")))
    holding = rows.where(F.exists(_hits(text), lambda m: passes(m["kind"], m["value"])))
    words = holding.select("key", "tag", word.alias("i", "w")).select("key", "tag", "i", "w.*").dropDuplicates(["key", "tag", "i"])
    place = Window.partitionBy("key", "tag").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("end", F.sum((F.col("gap") + F.col("n")).cast("long")).over(place)).select("key", "tag", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def _entity() -> Column:
    value = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value"))
    return F.concat_ws(":", "kind", value)


def _disclosure() -> Column:
    """PMI / IC from ``n, n_entity, n_term, n_both``."""
    chance = F.col("n_entity") / F.col("n")
    given = (F.col("n_both") + PRIOR * chance) / (F.col("n_term") + PRIOR)
    return F.log(given / chance) / -F.log(chance)


def term_spans(rows: DataFrame, base: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """``key, tag, kind, start, end, disclosure``: words that give away an entity of their text."""
    # a word counts once per text; the count of texts themselves rides along under an empty word
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    counted = common.stored(rows.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "words")
    total = F.broadcast(counted.where("term = ''").select(F.col("n_term").alias("n")))  # one row
    holders = base.select(_entity().alias("entity"), "key", "tag").distinct()
    alike = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *(F.bit_xor(F.xxhash64("key", "tag", F.lit(i))).alias(f"x{i}") for i in (0, 1)))
    entities = alike.groupBy("n_entity", "x0", "x1").agg(F.min("entity").alias("entity")).join(total).where("n_entity < n")
    reach = F.col("n_entity") * F.pow(F.col("n") / F.col("n_entity"), F.lit(1 - disclosure)) * (1 + 1e-9)
    held = common.stored(holders.join(entities.select("entity", "n", "n_entity", reach.alias("reach")), "entity"), "entities-held")
    beside = common.stored(words_beside(rows), "words-beside")
    farthest = held.groupBy("key", "tag").agg(F.max("reach").alias("farthest"))
    rare = beside.select("key", "tag", "term").distinct().join(farthest, ["key", "tag"]).join(counted, "term").where("n_term <= farthest")
    both = common.stored(rare.join(held, ["key", "tag"]).where("n_term <= reach").select("entity", "term", "key", "tag", "n", "n_entity", "n_term"), "terms-beside")
    together = both.groupBy("entity", "term", "n", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    telling = together.select("entity", "term", _disclosure().alias("disclosure")).where(F.col("disclosure") >= disclosure)
    found = both.select("entity", "term", "key", "tag").join(telling, ["entity", "term"]).groupBy("key", "tag", "term").agg(F.max("disclosure").alias("disclosure"))
    return beside.join(found, ["key", "tag", "term"]).select("key", "tag", F.lit("term").alias("kind"), "start", "end", "disclosure")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, key, tag, spans``: each row's spans (kind, start, end, disclosure) in order of kind and start."""
    rows = keyed(docs)
    base = common.stored(base_spans(rows), "pii-base")
    terms = term_spans(rows, base)
    spans = base.select("key", "tag", "kind", "start", "end", F.lit(None).cast("double").alias("disclosure")).unionByName(terms)
    order = F.array_position(F.array(*(F.lit(k) for k in (*KINDS, "term"))), F.col("kind"))
    one = F.struct(order.alias("order"), "start", "end", "kind", "disclosure")
    per_text = spans.groupBy("key", "tag").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    empty = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string,disclosure:double>>")
    joined = rows.select("doc_id", "key", "tag").join(common.stored(per_text, "pii-spans"), ["key", "tag"], "left")
    return joined.withColumn("spans", F.coalesce("spans", empty))


def _written(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def _of(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(_of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, removal: float = REMOVAL) -> DataFrame:
    """``doc_id, text``: texts with every span replaced; of overlapping spans the first counts."""
    rows = keyed(docs).join(found.select("key", "tag", "spans").dropDuplicates(["key", "tag"]), ["key", "tag"])
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["disclosure"].alias("disclosure"))))

    def step(done: Column, s: Column) -> Column:
        instead = F.when((s["kind"] == "term") & (s["disclosure"] >= removal), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        between = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        more = F.struct(F.concat(done["text"], between, instead).alias("text"), s["end"].alias("at"))
        return F.when(s["start"] >= done["at"], more).otherwise(done)

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(by_place, start, step)
    rest = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))
    return rows.select("doc_id", F.concat(done["text"], rest).alias("text"))
