"""Mixing sources to target weights by pivotal dependent rounding.

Every document is to be taken target / source_size times. The whole part is
certain; the fraction is a copy probability. Where two documents of a source
meet, words are moved from one's expectation to the other's, in the direction
that a fair lottery gives, until one of them is an integer: so each document's
expected copies stay as they were, and the words of both together stay the
same. What remains undecided of a group goes up a reduction tree, group by
group, to at most one document a source, which its own lottery decides.

Where a large and a small document meet it is mostly the small one that is
decided, so a large one remains, and its lottery may miss by as much. A reserve
of small documents therefore waits at the root, in levels from large to small.
What the lottery of a level has taken too much or too little is spread, in equal
shares a word, over the expectations of the levels that follow before the next
is folded. As lotteries are fair, this changes no document's expected copies but
those of the smallest, where what is left to spread may exceed what they can
take up. A source's words hence differ from its target by about the smallest
documents of its reserve, unless it has too few documents to take the error up.

Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import free_names, materialize

#: Documents that a group of the reduction tree holds on average.
GROUP = 48
#: Documents of a source, of its smaller half, that wait for the root of the tree on average. All do where there are no more.
RESERVE = 256
#: Levels of the reserve, from its largest documents to its smallest.
LEVELS = 20
#: Most copies of a document.
MOST = 2

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(spark: SparkSession, sizes: DataFrame, weights: list[float], share: float, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for sizes(source, size).

    Sources by code point, null last, weigh as listed, repeating. They share
    `share` of all sizes; a target stops at `most` times its source's size and
    the excess is shared again. Only the two sums that a round needs come to
    the driver. Ranks are made of a range partition's offset and a row number
    within it, so that no task sees all sources.
    """
    totals = materialize(spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").asc_nulls_last()]
    parts = totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = materialize(spark, parts, "ranges")
    offsets = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = parts.join(offsets, "part").withColumn("rank", F.col("offset") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = materialize(spark, ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "weights")

    row = known.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * float(row[0] or 0), 0.0
    if row[1]:
        budget = min(budget, most * float(row[0] or 0))
        capped, free = 0.0, float(row[1])
        while True:
            level = max(budget - capped, 0.0) / free
            over = F.col("weight") * level > F.col("cap")
            now = known.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
            if float(now[0]) == capped or not now[1]:
                level = level if now[1] else float("inf")
                break
            capped, free = float(now[0]), float(now[1])
    return known.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of (words, key, doc_id, p), the largest first.

    Gives the decided documents, and in `left` the one that is not (or null).
    """
    kind = "struct<words:bigint,key:bigint,doc_id:bigint,p:double>"

    def moved(item: Column, p: Column) -> Column:
        return F.struct(item["words"].alias("words"), item["key"].alias("key"), item["doc_id"].alias("doc_id"), p.alias("p"))

    def settle(done: Column, a: Column, b: Column) -> Column:
        """One of both has p 0 or 1 now, or both have."""
        open_a, open_b = (a["p"] > 0) & (a["p"] < 1), (b["p"] > 0) & (b["p"] < 1)
        out = F.when(open_a, F.array(b)).when(open_b, F.array(a)).otherwise(F.array(a, b))
        return F.struct(F.concat(done, out).alias("done"), F.when(open_a, a).when(open_b, b).alias("left"))

    def meet(acc: Column, x: Column) -> Column:
        a = acc["left"]
        mass_a, mass_b = a["p"] * a["words"], x["p"] * x["words"]
        up = F.least(a["words"] - mass_a, mass_b)  # words that can move to a
        down = F.least(mass_a, x["words"] - mass_b)
        to_a = _uniform(a["key"], x["key"], F.lit(seed)) * (up + down) < down
        # the one whose bound is reached gets an exact 0 or 1
        full_a, empty_b = a["words"] - mass_a <= mass_b, mass_b <= a["words"] - mass_a
        empty_a, full_b = mass_a <= x["words"] - mass_b, x["words"] - mass_b <= mass_a
        p_a = F.when(to_a, F.when(full_a, F.lit(1.0)).otherwise((mass_a + up) / a["words"])).otherwise(F.when(empty_a, F.lit(0.0)).otherwise((mass_a - down) / a["words"]))
        p_b = F.when(to_a, F.when(empty_b, F.lit(0.0)).otherwise((mass_b - up) / x["words"])).otherwise(F.when(full_b, F.lit(1.0)).otherwise((mass_b + down) / x["words"]))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), x.alias("left"))).otherwise(settle(acc["done"], moved(a, p_a), moved(x, p_b)))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("left"))
    return F.aggregate(items, start, meet)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, i: a + i["words"])


def _settle_levels(items: Column, seed: int) -> Column:
    """The decided documents of (words, key, doc_id, p, held), level by level; each level's error is spread over all that follow.

    Level 0 holds what the tree has left; each further one a quarter of what
    remains of the reserve, the largest first.
    """
    kind = "struct<words:bigint,key:bigint,doc_id:bigint,p:double>"

    def moved(x: Column, shift: Column) -> Column:
        p = F.least(F.greatest(x["p"] - shift, F.lit(0.0)), F.lit(1.0))
        return F.struct(x["words"].alias("words"), x["key"].alias("key"), x["doc_id"].alias("doc_id"), p.alias("p"))

    def levels(x: Column) -> Column:
        held = F.filter(x, lambda i: i["held"])

        def start(i: Column) -> Column:
            return F.when(i == LEVELS, F.size(held)).otherwise(F.ceil(F.size(held) * (1 - F.pow(F.lit(0.75), i)))).cast("int")

        parts = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.slice(held, start(i) + 1, start(i + 1) - start(i)))
        return F.concat(F.array(F.filter(x, lambda i: ~i["held"])), parts)

    def level(acc: Column, x: Column) -> Column:
        # what is owed is spread over the words of this level and of those that follow
        shift = F.when(acc["rest"] > 0, acc["error"] / acc["rest"]).otherwise(0.0)
        shift = F.when(F.get(x, F.lit(0))["held"], shift).otherwise(0.0)
        return _let(F.struct(shift.alias("shift"), _total(x).alias("words")), lambda y: _let(F.transform(x, lambda i: moved(i, y["shift"])), lambda m: folded(acc, x, m, y["words"])))

    def folded(acc: Column, x: Column, m: Column, words: Column) -> Column:
        absorbed = F.aggregate(F.zip_with(x, m, lambda i, j: i["words"] * (i["p"] - j["p"])), F.lit(0.0), lambda a, i: a + i)
        return _let(F.struct(absorbed.alias("absorbed"), _fold(m, seed).alias("f")), lambda y: decided(acc, x, y, words))

    def decided(acc: Column, x: Column, y: Column, words: Column) -> Column:
        left = y["f"]["left"]
        got = F.when(_uniform(left["key"], F.lit(seed + 1)) < left["p"], 1.0).otherwise(0.0)
        last = F.struct(left["words"].alias("words"), left["key"].alias("key"), left["doc_id"].alias("doc_id"), got.alias("p"))
        done = F.concat(acc["done"], y["f"]["done"], F.when(left.isNotNull(), F.array(last)).otherwise(F.array().cast(f"array<{kind}>")))
        error = acc["error"] - y["absorbed"] + F.when(left.isNotNull(), (got - left["p"]) * left["words"]).otherwise(0.0)
        rest = acc["rest"] - F.when(F.get(x, F.lit(0))["held"], words).otherwise(F.lit(0).cast("bigint"))
        return F.struct(error.alias("error"), rest.alias("rest"), done.alias("done"))

    def all_levels(x: Column) -> Column:
        rest = _total(F.filter(x, lambda i: i["held"]))
        start = F.struct(F.lit(0.0).alias("error"), rest.alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))
        return F.aggregate(levels(x), start, level)

    return _let(items, all_levels)["done"]


def _fold_groups(spark: SparkSession, dealt: DataFrame, seed: int) -> DataFrame:
    item = F.struct((-F.col("words")).alias("order"), "key", "words", "doc_id", "p")
    groups = dealt.groupBy("source", "band", "group").agg(F.array_sort(F.collect_list(item)).alias("items"))
    plain = F.transform("items", lambda x: F.struct(x["words"].alias("words"), x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["p"].alias("p")))
    return materialize(spark, groups.select("source", _fold(plain, seed).alias("f")).select("source", "f.done", "f.left"), "fold")


def _decided(folded: DataFrame) -> DataFrame:
    return folded.select(F.explode("done").alias("d")).select("d.key", "d.doc_id", "d.p")


def _left(folded: DataFrame) -> DataFrame:
    return folded.filter("left is not null").select("source", "left.words", "left.key", "left.doc_id", "left.p", F.lit(0).cast("bigint").alias("band"))


def mix(
    spark: SparkSession, docs: DataFrame, weights: list[float], share: float, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(source, doc_id, size, source_size, target, copies): one row for each distinct document.

    Rows with equal doc_id, source and size are one document here: they are
    taken together, equally often, and its words are those of all of them. A
    null text, or one without words, has size 0 and is taken as often as its
    source's ratio says, rounded by its own lottery. Null sources are a source
    like others, null ids an id. An empty table gives an empty result. Reruns
    agree, as every lottery is a hash of the documents that take part.
    """
    slim = docs.select(F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), word_count(F.col(f"`{text}`")).alias("size"))
    units = materialize(spark, slim.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "units")
    targets = materialize(spark, source_targets(spark, units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share), "targets")

    same = F.col("u.source").eqNullSafe(F.col("t.source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = units.alias("u").join(targets.alias("t"), same).select("u.*", "source_size", "target", ratio.alias("ratio"))
    key = F.xxhash64(F.lit(seed), "source", "doc_id", "size")
    known = known.withColumns({"words": F.col("size") * F.col("rows"), "whole": F.floor("ratio").cast("bigint"), "key": key})
    known = known.withColumn("p", F.col("ratio") - F.col("whole"))
    known = materialize(spark, known, "known")

    alone = known.filter("words = 0").select("key", "doc_id", F.when(_uniform("key", F.lit(seed + 1)) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    level = known.filter("words > 0 and p > 0").select("source", "words", "key", "doc_id", "p", F.floor(F.log2("words") * 2).alias("band"))
    held = level.groupBy("source").agg(F.percentile_approx("words", 0.5).alias("median"), F.greatest(F.ceil(F.count("*") / (2 * RESERVE)), F.lit(1)).alias("every"))
    small = (F.col("every") == 1) | (F.col("words") <= F.col("median")) & (F.pmod(F.xxhash64("key", F.lit(-1)), F.col("every")) == 0)
    level = level.alias("l").join(held.alias("h"), F.col("l.source").eqNullSafe(F.col("h.source"))).select("l.*", small.alias("held"))
    level = materialize(spark, level, "level")
    reserve = level.filter("held")
    level = level.filter("not held").drop("held")
    decided = alone
    n = 0
    while not level.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).isEmpty():
        # documents of similar size meet first; later what a source has left
        counts = level.groupBy("source", "band").agg(F.count("*").alias("n"))
        by = F.col("l.source").eqNullSafe(F.col("c.source")) & (F.col("l.band") == F.col("c.band"))
        group = F.pmod(F.xxhash64("key", F.lit(seed + n)), F.ceil(F.col("n") / GROUP))
        dealt = level.alias("l").join(counts.alias("c"), by).select("l.*", group.alias("group"))
        folded = _fold_groups(spark, dealt, seed + n)
        decided = decided.unionByName(_decided(folded))
        level = _left(folded)
        n += 1
    item = F.struct((-F.col("words")).alias("order"), "key", "words", "doc_id", "p", "held")
    last = level.withColumn("held", F.lit(False)).unionByName(reserve).groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("items"))
    last = materialize(spark, last.select(F.explode(_settle_levels(F.col("items"), seed + n)).alias("d")).select("d.key", "d.doc_id", "d.p"), "last")
    decided = decided.unionByName(last)
    chosen = decided.select("key", F.col("doc_id").alias("id"), F.round("p").cast("bigint").alias("extra"))
    both = known.join(chosen, (known["key"] == chosen["key"]) & known["doc_id"].eqNullSafe(chosen["id"]), "left")
    return both.select("source", "doc_id", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def taken_words(spark: SparkSession, docs: DataFrame, weights: list[float], share: float, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source)."""
    m = mix(spark, docs, weights, share, seed)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    by = (rows["doc_id"].eqNullSafe(m["doc_id"])) & (rows["source"].eqNullSafe(m["source"])) & (rows["size"] == m["size"])
    return rows.join(m, by).select(rows["doc_id"], rows["size"], "source_size", "target", (rows["size"] * F.col("copies")).alias("taken"))


def take_copies(spark: SparkSession, docs: DataFrame, weights: list[float], share: float, seed: int = 0) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as the mix takes it (0, 1 or 2 times), with all columns.

    As in mix(): repeated rows are taken alike, a null text has no words, null
    ids and sources are values like others. Columns may have any further names;
    an empty table gives an empty result.
    """
    names = free_names(docs, "mix_id", "mix_source", "mix_size", "mix_copies", "mix_copy")
    m = mix(spark, docs, weights, share, seed).filter("copies > 0")
    m = m.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "size", "copies"), names, strict=False)])
    by = F.col("doc_id").cast("bigint").eqNullSafe(F.col(names[0])) & F.col("source").cast("string").eqNullSafe(F.col(names[1])) & (word_count(F.col("text")) == F.col(names[2]))
    return docs.join(m, by).withColumn(names[4], F.explode(F.sequence(F.lit(1), F.col(names[3])))).drop(*names)
