"""Glossary matching: n-grams of the source joined with canonical term keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms

#: Glossaries of at most so many keys are broadcast; larger ones shuffle.
BROADCAST_KEYS = 200_000
#: Runs of tokens are looked up before the join in glossaries of at most so many keys; all those of larger ones join.
LISTED_KEYS = 10_000


def keyed(glossary: DataFrame, fold: bool = True, colon: bool = False) -> DataFrame:
    """(entry_pos, key, size): canonical keys of entries (entry_pos, source_term) as arrays of tokens."""
    tokens = terms.canonical(terms.term_tokens(F.col("source_term"), fold, colon))
    return glossary.select("entry_pos", tokens.alias("key")).where(F.size("key") > 0).withColumn("size", F.size("key"))


def deduplicated(glossary: DataFrame) -> DataFrame:
    """The first entry of each (folded term, targets, forbidden), by position."""
    w = Window.partitionBy(terms.folded_case(F.col("source_term")), "target_terms", "forbidden_terms").orderBy("entry_pos")
    return glossary.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hits(segments: DataFrame, glossary: DataFrame, cap: int | None = None, raw_too: bool = True, fold: bool = True, colon: bool = False) -> DataFrame:
    """(idx, condition_id, entry_pos, size, rank): entries whose term stands in the source, longest first.

    At each token that can begin a key the run of as many tokens as the longest key has
    is cut out, and the distinct runs of a segment are reduced at once; what they begin
    with, in all lengths that keys have, joins the keys as text. ``raw_too``
    also matches keys against tokens that are not reduced. Each (segment, entry) counts
    once; hits of a segment are gathered in one shuffle and ranked there.
    """
    keys = keyed(glossary, fold, colon).select("entry_pos", F.array_join("key", " ").alias("key"), "size")  # no token holds a space
    bound = keys.agg(F.collect_set("size").alias("sizes"), F.count("*").alias("n")).first()
    if not bound.n:
        return segments.select("idx", "condition_id").limit(0).selectExpr("idx", "condition_id", "0 AS entry_pos", "0 AS size", "1 AS rank")
    listed = sorted({r.key for r in keys.select("key").distinct().collect()}) if bound.n <= LISTED_KEYS else None
    begins = None if listed is None else sorted({t for k in listed for t in terms.reducible(k.split(" ")[0])})
    runs = segments.select("idx", "condition_id", terms.term_tokens(F.col("source"), fold, colon).alias("raw"))

    def cut(t: Column, i: Column) -> Column:
        run = F.array_join(F.slice("raw", i + 1, max(bound.sizes)), " ")
        return run if begins is None else F.when(t.isin(begins), run)

    runs = runs.select("idx", "condition_id", F.array_distinct(F.array_compact(F.transform("raw", cut))).alias("raw"))
    one = F.split(terms.canonical_text(F.array_join("raw", " | ")), r" \| ")  # no token is a bar
    runs = runs.select("idx", "condition_id", (F.array_distinct(F.concat(one, "raw")) if raw_too else one).alias("run"))
    parts = F.array_distinct(F.flatten(F.transform("run", lambda r: F.array(*(F.substring_index(r, " ", n) for n in sorted(bound.sizes))))))
    probes = runs.select("idx", "condition_id", F.explode(parts if listed is None else F.filter(parts, lambda x: x.isin(listed))).alias("key"))
    found = probes.join(F.broadcast(keys) if bound.n <= BROADCAST_KEYS else keys, "key")
    own = found.groupBy("condition_id", "idx").agg(F.array_sort(F.collect_set(F.struct((-F.col("size")).alias("less"), "entry_pos"))).alias("hits"))
    own = own.withColumn("hits", F.slice("hits", 1, cap)) if cap is not None else own
    ranked = own.select("condition_id", "idx", F.posexplode("hits").alias("place", "hit"))
    return ranked.select("idx", "condition_id", F.col("hit.entry_pos").alias("entry_pos"), (-F.col("hit.less")).alias("size"), (F.col("place") + 1).alias("rank"))


#: Characters that the start of a fallback term has in the index.
LEAD = 2


def fallback_hits(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """(idx, condition_id, entry_pos): entries without tokens (such as Han terms) that stand in the source as they are.

    The distinct pairs of characters of a source join the first characters of the terms;
    what meets there is compared in full, so the work follows the matches, not the product.
    """
    odd = glossary.where(F.size(terms.term_tokens(F.col("source_term"))) == 0).select("entry_pos", F.trim("source_term").alias("term")).where("term != ''")
    odd = odd.withColumn("lead", F.substring("term", 1, LEAD))
    at = F.when(F.length("source") > 0, F.sequence(F.lit(1), F.length("source"))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substring(F.col("source"), i, F.lit(1)), F.substring(F.col("source"), i, F.lit(LEAD))))))
    probes = segments.select("idx", "condition_id", F.explode(grams).alias("lead"))
    near = probes.join(odd, "lead").select("idx", "condition_id", "entry_pos", "term").distinct()
    return near.join(segments.select("idx", "condition_id", "source"), ["idx", "condition_id"]).where(F.col("source").contains(F.col("term"))).select("idx", "condition_id", "entry_pos")


def term_checks(segments: DataFrame, found: DataFrame, glossary: DataFrame) -> DataFrame:
    """Issues of hits: a forbidden term in the translation, or none of the wanted ones."""
    rows = found.join(F.broadcast(glossary) if glossary.count() <= BROADCAST_KEYS else glossary, "entry_pos").join(segments.select("idx", "condition_id", "translation"), ["idx", "condition_id"])
    has = lambda col: F.exists(col, lambda t: F.col("translation").contains(t))
    bad = F.when(has("forbidden_terms"), F.struct(F.lit("forbidden_term").alias("issue_type"), F.when(F.col("priority") == "high", "major").otherwise("minor").alias("severity")))
    level = F.when(F.col("priority") == "high", "major").when(F.col("priority") == "medium", "minor").otherwise("info")
    lacking = F.when((F.size("target_terms") > 0) & ~has("target_terms"), F.struct(F.lit("glossary_target_missing").alias("issue_type"), level.alias("severity")))
    return rows.select("idx", "condition_id", "entry_pos", F.inline(F.filter(F.array(bad, lacking), lambda x: x.isNotNull())))


def accuracy(segments: DataFrame, found: DataFrame, glossary: DataFrame) -> DataFrame:
    """Per condition: hits, hits whose translation has a wanted term, and their share (null without hits)."""
    rows = found.join(glossary.select("entry_pos", "target_terms"), "entry_pos").join(segments.select("idx", "condition_id", "translation"), ["idx", "condition_id"])
    good = F.exists("target_terms", lambda t: F.col("translation").contains(t))
    return rows.groupBy("condition_id").agg(F.count("*").alias("hits"), F.count_if(good).alias("good")).withColumn("accuracy", F.col("good") / F.col("hits"))
