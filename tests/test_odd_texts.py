"""Queries on texts that the supplied small tables lack, beside their SQL or plain recomputation."""

import random

import pytest
from pyspark.sql import functions as F
from test_oracles import canonical

from verbatix.functions import tokens as T
from verbatix.operators import glossary
from verbatix.plans.catalogue import ORACLES, QUERIES


def both(spark, folder, name, texts, items=()):
    """Rows of a query and of its SQL over documents of these texts."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return canonical(tuple(r[c] for c in cols) for r in df.collect()), canonical(db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_capitals_of_several_letters(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "translatable", ["Üß. x", "ß", "ßa", "ﬁn", "ŉA", "ıx", "Éa", "AB", "ABC", "", None, "İB", "ΐA", "aß"])
    assert got == wanted


def test_marks_hold_all_tokens(spark):
    rng = random.Random(3)
    parts = [*"%%&&<>{}\\ \n;#xnrtLd12-+*.a/b\"é第", "𠮷", "&amp;", "</b>", "<b ", "%1", "%n", "\u00a0"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(20))),) for _ in range(4000)], "s string").select("s", T.marks(F.col("s")).alias("m"))
    for kind in set(T.EXTRACTORS) - {"number"}:
        assert not rows.where(~(T.EXTRACTORS[kind](F.col("s")) == T.EXTRACTORS[kind](F.col("m")))).head(1)
    assert spark.createDataFrame([("word %1 " * 9 + "plain " * 500,)], "s string").select(F.length(T.marks(F.col("s"))).alias("n")).first().n < 60


@pytest.mark.parametrize("most", [10_000, 0])
def test_glossary_by_plain_recomputation(spark, monkeypatch, most):
    monkeypatch.setattr(glossary, "LISTED_KEYS", most)
    one = lambda t: t[:-3] + "y" if len(t) > 5 and t.endswith("ies") else t[:-2] if len(t) > 4 and t.endswith(("ches", "shes", "xes", "zes")) else t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith(("ss", "us", "is")) else t
    rng = random.Random(4)
    words = ["map", "maps", "boxes", "box", "query", "queries", "class", "this", "a", "status", "layers", "layer"]
    texts = [[rng.choice(words) for _ in range(rng.randrange(12))] for _ in range(60)]
    entries = [[rng.choice(words) for _ in range(rng.randrange(1, 4))] for _ in range(25)]
    wanted = set()
    for i, t in enumerate(texts):
        for e, k in enumerate(entries):
            key = [one(x) for x in k]
            runs = [t[p : p + len(k)] for p in range(len(t) - len(k) + 1)]
            if any(r == key or [one(x) for x in r] == key for r in runs):
                wanted.add((i, e, len(k)))
    segments = spark.createDataFrame([(i, "c", " ".join(t)) for i, t in enumerate(texts)], "idx long, condition_id string, source string")
    terms_of = spark.createDataFrame([(e, " ".join(k)) for e, k in enumerate(entries)], "entry_pos int, source_term string")
    found = glossary.hits(segments, terms_of)
    assert {(r.idx, r.entry_pos, r.size) for r in found.collect()} == wanted
    if most:  # a run that begins no key is not exploded, and the join goes by whole keys
        assert "[first#" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["issue_type_counts", "type_pivot", "best_and_worst"])
def test_texts_are_checked_once(spark, tmp_path, name):
    got, wanted = both(spark, tmp_path, name, [f"text {k}.5 %d {{a}} <b>" if k % 3 else None for k in range(60)])
    assert got == wanted
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1
