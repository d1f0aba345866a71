"""PII: information-theoretic sanitisation. Built-in functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and telephone
numbers, found by pattern. Each distinct value is a protected entity. Terms
that stand in its documents may give it away though it is masked itself; how
much, the corpus tells: with n(e), n(t) the documents that hold entity e and
term t, n(e,t) those that hold both, and N all documents, t discloses

    log(n(e,t) N / (n(e) n(t))) / log(N / n(e))

of the information of e: pointwise mutual information over information content,
1 if t stands with e only. Terms that reach GENERALISE are replaced by the name
of their kind, those that reach REMOVE are taken out, wherever they stand in a
document that mentions e. So much must be no accident: with k independent
sightings of t with e, of k(e) of e, and l = k(e) n(t) / N expected,
k log(k / l) - (k - l) (Chernoff's bound of a Poisson tail) has to exceed
log(terms in question / CHANCE). Two sightings are the least; sightings are
independent if t stands in different surroundings, and in documents that are no
near copies, so that copies of a document or passage are no evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import connected_components, free_names, materialize, quoted, text_key

GENERALISE, REMOVE = 0.75, 0.95
#: How likely at most any term of an entity is judged by accident.
CHANCE = 0.05
#: Minimum hashes of a document's three-word shingles: bands, and hashes in each.
#: Documents that agree in a band and in half of all hashes are near copies; a fifth
#: is enough if it stands for as many shingles as a copied passage has terms.
BANDS, ROWS = 15, 2
#: Terms on each side that are a term's surroundings; as many as 4 SIDE + 1 alike are a copied passage.
SIDE = 5
#: Letters and digits in a row, with the marks that belong to them; how frequent it is decides, not its length.
TERM = r"[\p{L}\p{M}\p{N}]+"
KINDS = ["email", "ip", "card", "phone", "term"]

_SPAN = "struct<start:int,kind:int,end:int,value:string,action:string>"
#: Matches that a block of the running position holds; keeps it near linear in their number.
_BLOCK = 256

# The patterns are those of the contract, without what makes Java try again in
# vain: a match starts at a run's first character or at the last match's end,
# and possessive repeats, as nothing that follows could need what they took.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points from 0."""
    pairs = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value"))),
        lambda x: x["value"].isNotNull(),
    )

    def width(x: Column) -> Column:
        return x["gap"] + F.length(x["value"])

    def positions(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + width(x)))
        starts = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

        def inside(block: Column, start: Column) -> Column:
            return F.aggregate(
                block,
                F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
                lambda a, x: F.struct(
                    (a["at"] + width(x)).alias("at"),
                    F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + width(x)).alias("end"), x["value"].alias("value")))).alias("out"),
                ),
                lambda a: a["out"],
            )

        return F.flatten(F.zip_with(blocks, starts, inside))

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda b: F.slice(p, b * _BLOCK + 1, _BLOCK))

    return _let(pairs, lambda p: F.when(F.size(p) > 0, _let(blocks(p), positions)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _spans(text: Column, kind: int, pattern: str, may: Column, ok: Callable[[Column], Column]) -> Column:
    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), F.lit("mask").alias("action"))

    found = F.transform(F.filter(_located(text, pattern), lambda x: ok(x["value"])), span)
    return F.when(may, found).otherwise(F.array()).cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    """The base spans, by start, then kind. Cheap tests spare most texts the patterns."""
    byte = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    kinds = [
        _spans(text, 0, _EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        _spans(text, 1, _IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")),
        _spans(text, 2, _CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))),
        _spans(text, 3, _PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
    ]
    return F.array_sort(F.concat(*kinds))


def _words(text: Column) -> Column:
    """The terms of a text in their order, in lower case."""
    found = F.array_join(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), " ")
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(found), " "))


def _blank(text: Column, spans: Column) -> Column:
    """The text with spaces for its spans; positions stay."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        width = F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, F.repeat(F.lit(" "), width))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def _sightings(words: Column, own: Column) -> Column:
    """Array of (term, contexts): hashes of the SIDE terms on each side, of 2 SIDE before it and of 2 SIDE after it.

    Wherever a term stands in a copied passage of 4 SIDE + 1 terms, one of them
    lies in the passage. Where the text ends too early own stands for it.
    """

    def of(w: Column) -> Column:
        def at(i: Column) -> Column:
            def around(before: int, after: int) -> Column:
                whole = (i >= before) & (i + after < F.size(w))
                return F.when(whole, F.xxhash64(F.slice(w, F.greatest(i - before, F.lit(0)) + 1, F.lit(before + 1 + after)))).otherwise(own)

            contexts = [around(SIDE, SIDE), around(2 * SIDE, 0), around(0, 2 * SIDE)]
            return F.struct(F.get(w, i).alias("term"), *[c.alias(f"context{n}") for n, c in enumerate(contexts)])

        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1), at))

    return _let(words, of)


def _prints(words: Column) -> Column:
    """BANDS * ROWS minimum hashes of the three-word shingles; the agreeing share estimates their Jaccard similarity."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def least(x: Column, i: int) -> Column:
        return F.array_min(F.transform(x, lambda h: F.xxhash64(h, F.lit(i))))

    return _let(_let(words, of), lambda x: F.array(*[least(x, i) for i in range(BANDS * ROWS)]))


def _grouped(spark: SparkSession, mentions: DataFrame) -> DataFrame:
    """mentions(kind, value, text_key, prints, length, ...) with group, one for all near copies that mention an entity, instead of prints and length.

    In each band a document is held against the least of those that agree with it.
    """
    entity = ["kind", "value"]
    own = mentions.withColumn("id", F.xxhash64("kind", "value", "text_key"))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("prints", b * ROWS + 1, ROWS)).alias("print")) for b in range(BANDS)])
    banded = own.select(*entity, "id", "prints", "length", F.explode(bands).alias("b")).select(*entity, "id", "prints", "length", "b.*")
    least = banded.groupBy(*entity, "band", "print").agg(F.min(F.struct("id", "prints", "length")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = F.size(F.filter(F.zip_with("prints", "least.prints", lambda a, b: a == b), lambda x: x))
    n = BANDS * ROWS
    shared = same / (n + same) * (F.col("length") + F.col("least.length"))
    near = (2 * same >= n) | ((5 * same >= n) & (shared > 4 * SIDE))
    edges = banded.join(least, [*entity, "band", "print"]).filter((F.col("id") != F.col("least.id")) & near)
    edges = materialize(spark, edges.select(F.col("id").alias("a"), F.col("least.id").alias("b")).distinct(), "copies")
    if edges.isEmpty():
        return own.withColumn("group", F.col("id")).drop("id", "prints", "length")
    return own.join(connected_components(spark, edges), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("id", "component", "prints", "length")


def find_pii(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, spans, added) for each row of docs: base spans, and those of disclosing terms.

    text_key is a 128-bit hash of the text. All documents' terms are counted,
    each once a document. Null texts are empty: no spans. Rows with equal texts
    have equal spans; repeated rows are each counted as a document. Terms are
    spared pairing only if their counts rule them out. An empty table gives an
    empty result. Other columns of docs aren't read, whatever their names.
    """
    t = F.coalesce(quoted(text).cast("string"), F.lit(""))
    key = F.struct(*text_key(F.col("text")))
    read = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), t.alias("text"))

    with_spans = read.withColumn("spans", base_spans(F.col("text")))
    found = materialize(spark, with_spans.select("doc_id", key.alias("text_key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "pii")
    n_all = found.count()
    documents = found.filter(F.size("spans") > 0).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("spans").alias("spans"), F.first("text").alias("text"))
    documents = materialize(spark, documents, "documents")
    bare = _blank(F.col("text"), F.col("spans"))

    # a single text is no evidence, and what all documents hold is no secret
    entity = ["kind", "value"]
    entities = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    holders = materialize(spark, documents.select("text_key", "copies", F.explode(entities).alias("e")).select("e.*", "text_key", "copies"), "holders")
    n_entity = holders.groupBy(*entity).agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_texts")).filter((F.col("n_texts") > 1) & (F.col("n_entity") < n_all))
    several = materialize(spark, holders.join(n_entity.drop("n_texts"), entity), "several")
    telling = documents.join(several.select("text_key").distinct(), "text_key", "left_semi")
    prints = telling.select("text_key", _prints(_words(bare)).alias("prints"), F.size(_words(bare)).alias("length"))
    grouped = materialize(spark, _grouped(spark, several.join(prints, "text_key")), "groups")
    n_groups = grouped.groupBy(*entity).agg(F.count_distinct("group").alias("n_groups"))

    # all terms of all documents, less those that stand in base spans only
    every = read.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"), F.lit(1).cast("bigint").alias("n"))
    inside = documents.select(F.explode(F.array_except(_words(F.col("text")), _words(bare))).alias("term"), (-F.col("copies")).alias("n"))
    n_term = every.unionByName(inside).groupBy("term").agg(F.sum("n").alias("n_term")).filter("n_term > 1")

    # n(e,t) is n(e) at most, so that more frequent terms can't reach GENERALISE
    most = F.col("n_entity") * F.pow(n_all / F.col("n_entity"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    sightings = telling.select("text_key", F.explode(_sightings(_words(bare), F.xxhash64("text_key"))).alias("s")).groupBy("text_key", "s.term").agg(*[F.min(f"s.context{n}").alias(f"context{n}") for n in range(3)])
    close = sightings.join(n_term, "term").join(grouped.withColumn("most", most), "text_key").filter(F.col("n_term") <= F.col("most")).drop("most")
    close = materialize(spark, close, "close")

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"context{n}").alias("context")) for n in range(3)]))
    contexts = close.select(*entity, "term", each.alias("c")).select(*entity, "term", "c.*").distinct().groupBy(*entity, "term", "side").agg(F.count("*").alias("n"))
    contexts = contexts.groupBy(*entity, "term").agg(F.min("n").alias("contexts"))
    groups = close.groupBy(*entity, "term", "group", "n_entity", "n_term").agg(F.sum("copies").alias("n"))
    together = groups.groupBy(*entity, "term", "n_entity", "n_term").agg(F.sum("n").alias("n_both"), F.count("*").alias("groups"))
    pairs = together.join(contexts, [*entity, "term"]).join(n_groups, entity).withColumn("k", F.least("groups", "contexts"))
    pairs = materialize(spark, pairs, "pairs")
    tested = pairs.groupBy(*entity).agg(F.count("*").alias("tested"))
    expected = F.col("n_groups") * F.col("n_term") / float(n_all)
    sure = (F.col("k") > expected) & (F.col("k") * F.log(F.col("k") / expected) - (F.col("k") - expected) >= F.log(F.col("tested") / CHANCE))
    disclosed = F.log(F.col("n_both") * float(n_all) / (F.col("n_entity") * F.col("n_term"))) / F.log(F.lit(float(n_all)) / F.col("n_entity"))
    told = pairs.filter("k > 1").join(tested, entity).filter(sure).select(*entity, "term", disclosed.alias("disclosed")).filter(F.col("disclosed") >= GENERALISE)

    # at all its places in all documents that mention the entity
    hit = close.join(materialize(spark, told, "told"), [*entity, "term"]).groupBy("text_key", "term").agg(F.max("disclosed").alias("disclosed"))
    action = F.when(F.col("disclosed") >= REMOVE, "remove").otherwise("generalise")
    actions = hit.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", action))).alias("actions"))

    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), F.try_element_at("actions", F.lower(x["value"])).alias("action"))

    added = F.filter(F.transform(_located(bare, TERM), span), lambda s: s["action"].isNotNull()).cast(f"array<{_SPAN}>")
    added = telling.join(actions, "text_key").select("text_key", added.alias("added"))
    out = found.select("doc_id", "text_key", "spans").join(materialize(spark, added, "added"), "text_key", "left")
    return out.select("doc_id", "text_key", "spans", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_pii()'s spans."""

    def of(kind: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("spans", of(i))).cast("bigint").alias(f"n_{KINDS[i]}") for i in range(4)]
    every = F.array_sort(F.concat("spans", "added"))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("added").cast("bigint").alias("n_term"))


def sanitise(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of find_pii() masked in the text; all other columns and rows stay.

    A span is replaced by its kind in brackets ([EMAIL], [TERM]), or taken out
    if its term is to be removed. Of overlapping spans the first is replaced
    and the rest of the others goes with it. A null text stays null. Columns may
    have any names; an empty table gives an empty result.
    """
    found = find_pii(spark, docs, doc_id, text)
    own_key, key, spans = free_names(docs, "own_key", "text_key", "all_spans")
    per_text = found.select(F.col("text_key").alias(key), F.array_sort(F.concat("spans", "added")).alias(spans)).filter(F.size(spans) > 0).dropDuplicates([key])
    per_text = materialize(spark, per_text, "masks")
    t = quoted(text).cast("string")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def mask(acc: Column, s: Column) -> Column:
        label = F.when(s["action"] == "remove", "").otherwise(F.element_at(labels, s["kind"] + 1))
        more = F.when(s["start"] >= acc["at"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), label)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(spans, start, mask, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    own = docs.withColumn(own_key, F.struct(*text_key(F.coalesce(t, F.lit("")))))
    joined = own.join(per_text, F.col(own_key) == F.col(key), "left")
    clean = F.when(F.col(spans).isNull(), quoted(text)).otherwise(masked).alias(text)
    return joined.select(*[clean if c == text else quoted(c) for c in docs.columns])
