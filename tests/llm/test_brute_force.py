"""Operators without SQL against plain recomputation, and the SQL of the URL filter on pages with links."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from verbatix.llm import common, decontaminate, language_id, mixing, secret_scan, token_codes, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(8)
WORDS = sorted({"".join(RNG.choice("abdeilmnorstu") for _ in range(RNG.randint(3, 8))) for _ in range(500)})


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def smith_waterman(a, b):
    table, best = [[0] * (len(b) + 1)], 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, table[-1][j] + (1 if x == y else -1), table[-1][j + 1] - 1, row[j] - 1))
        best = max(best, *row)
        table.append(row)
    return best


@pytest.mark.parametrize("chars", [1 << 24, 300])
def test_decontamination_is_smith_waterman(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    rng = random.Random(4)
    items = [prose(rng.randint(6, 30), 100 + k) for k in range(12)]
    items += [prose(2, 301), WORDS[5], "", " . ", prose(3, 302)]
    texts = [prose(60, 500 + k) for k in range(8)]
    for k, item in enumerate(items[:12]):  # some words changed, left out or put in, but five in a row stay
        some = item.split()
        at = rng.choice([0, len(some) - 1])
        some[at : at + 1] = rng.choice([["other"], [], ["one", "two"]])
        texts.append(" ".join([prose(20, 600 + k), *some, prose(20, 700 + k)]))
    texts += [items[12].upper() + ".", items[13], prose(9, 9) + " " + items[12], items[16], None, "", "!"]
    rows = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None)], "item_id long, text string")
    wanted = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            x, y = ("".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for t in (item, text))
            if len(x) < 3:
                if x and x == y:
                    wanted[d, i] = len(x)
            elif (score := smith_waterman(x, y)) >= max(min(6, len(x)), 0.45 * len(x)):
                wanted[d, i] = score
    assert len(wanted) >= 14
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(rows, bench).collect()}
    assert got == wanted
    left = {r.doc_id for r in decontaminate.clean(rows, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in wanted}


def test_languages_are_hypervectors(spark):
    make = {"aa": "eton sira anet ruel", "bb": "über zwölf grün ruel", "cc": "ño ción más"}
    rows = [(i, " ".join(random.Random(i).choices(make[k].split(), k=3 + i % 9)) + "," * (i % 2), k) for i in range(60) for k in [list(make)[i % 3]]]
    table = [(i, t, k, "s", 1) for i, t, k in rows] + [(100, "", "aa", "s", 1), (101, None, "dd", "s", 1), (102, "anet", None, "s", 1)]
    letters = np.random.default_rng(language_id.SEED).choice(np.array([-1, 1], np.int8), (language_id.SYMBOLS, language_id.SIZE)).astype(float)
    symbol = language_id.Profiles.symbol()

    def profile(text):
        x = [0]
        for c in [*map(ord, text), 0]:
            if (s := int(symbol[c])) or x[-1]:
                x.append(s)
        grams = [tuple(x[i : i + 3]) for i in range(len(x) - 2) if x[i + 1]]
        return sum((math.prod(np.roll(letters[s], 2 - p) for p, s in enumerate(g)) for g in grams), np.zeros(language_id.SIZE)), len(grams)

    sums = defaultdict(lambda: np.zeros(language_id.SIZE))
    for i, t, k, *_ in table:
        if k and zlib.crc32(str(i).encode()) % 4 != 2:
            x, n = profile(t or "")
            sums[k] += x / max(n, 1)
    cosine = lambda x, y: float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-30))
    for r in language_id.predict(spark.createDataFrame(table, DOCS)).collect():
        x, n = profile(table[r.doc_id if r.doc_id < 100 else r.doc_id - 40][1] or "")
        assert (r.lang_pred == "und") == (n == 0)
        if n:
            found = {k: cosine(x, y) for k, y in sums.items()}
            best = max(found.values())
            assert abs(found[r.lang_pred] - best) < 1e-6 and abs(r.score - max(0, best)) < 1e-5
    assert language_id.predict(spark.createDataFrame([], DOCS)).count() == 0


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD_LANGS", 7)
    rows = [(4 * i + j, prose(30, i), f"l{i:04}", "s", 1) for i in range(520) for j in range(3)]
    langs, vectors = language_id.train(spark.createDataFrame(rows, DOCS))
    assert langs == sorted({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}) and len(langs) > 500
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-5)


def test_url_filter_is_its_sql_with_links(spark):
    duckdb = pytest.importorskip("duckdb")
    rng, hosts = random.Random(6), [f"h{k}.{z}" for k in range(14) for z in ("com", "net", "org")]
    rows = [(i, f"http://{rng.choice(hosts)}/fr/{i}", " ".join(f"<a href='https://{rng.choice(hosts).upper()}/x'>" for _ in range(rng.randrange(3)))) for i in range(120)]
    rows += [(200 + i, f"http://c{i}.com/", f"<a href='//c{i + 1}.com'>") for i in range(14)] + [(214, "http://c14.com/", "<a href='//h1.net'>"), (300, None, "<a href='//h2.com'>"), (301, "none", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").createOrReplaceTempView("linked_pages")
    got = url_filter.judge(spark.table("linked_pages"))
    pages = spark.table("linked_pages").toArrow()
    db = duckdb.connect()
    db.register("pages", pages)
    wanted = db.sql(f'SELECT page_id, host, path, rule, verdict, "by" FROM ({url_filter.ORACLE})').fetchall()
    show = lambda x: sorted(map(repr, map(tuple, x)))
    assert show(got.collect()) == show(wanted)
    by_links = {r[4] for r in wanted if r[5] == "links"}
    assert by_links == {"allow", "block"}


def test_tokens_in_the_order_of_rows(spark):
    rows = common.materialize(frame(spark, [(i, prose(i % 7, i), "s") for i in range(60)]).repartition(3))
    plain = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_codes.encode_documents(rows).collect()}
    got = sorted(token_codes.encode_documents(rows, order=()).collect(), key=lambda r: r.start)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == plain and len(got) == 60
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]


def test_secret_training_has_bounded_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(secret_scan, "_fit", seen.extend)
    secret_scan.train(frame(spark, [(1, prose(3000, 1), "s"), (2, "x" * 100_000 + " few words", "s"), (3, None, "s"), (4, "", "s"), (5, prose(10, 3), "s")]))
    assert len(seen) == 3 and "few words" in seen and prose(10, 3) in seen and max(map(len, seen)) < 400


def _draw(*parts):
    return int(hashlib.md5(":".join([str(mixing.SEED), *map(str, parts)]).encode()).hexdigest()[:13], 16) / 4503599627370496


def _copies(doc_id, mean):
    out, p, c, u = 0, math.exp(-mean), 0.0, _draw(doc_id, 1)
    for k in range(200):
        c += p
        out += u >= c
        p *= mean / (k + 1)
    return out


def test_pipeline_from_end_to_end(spark, tmp_path):
    from tokenizers import Tokenizer

    item = prose(30, 9000)
    rows, toxic, labels = [], set(), []
    for i in range(600):
        text = prose(40, i)
        if i % 4 == 0:
            text += " vileword nastyword"
            toxic.add(i)
        rows.append((i, text, f"s{min(i % 5, 2)}"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + k, prose(40, 1), "s0") for k in range(30)] + [(1030, prose(41, 1), "s1")]  # text 1 again, and with a word more
    rows += [(1100, f"{prose(20, 3000)} {item} {prose(20, 3001)}", "s1"), (1101, item, "s2"), (1200, "", "s1"), (1201, None, "s2")]
    folder = str(tmp_path)
    frame(spark, rows).withColumn("extra", mixing.F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [r for r in rows if r[0] not in toxic and not 1000 <= r[0] <= 1101]
    n = {s: sum(r[2] == s for r in left) for _, _, s in left}
    tokenizer = Tokenizer.from_file(token_codes.tokenizer_path())
    wanted = []
    for i, t, s in left:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        wanted += [(i, len(ids), zlib.crc32(ids.tobytes()))] * _copies(i, sum(n.values()) / len(n) / n[s])
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(wanted)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order != sorted(order)  # mixing's shuffle stays


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, [(1, "x", "s")]).limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
