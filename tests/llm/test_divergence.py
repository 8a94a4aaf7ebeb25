import re
from collections import Counter

import pytest
from check import compare, duck

from callmeter.llm import divergence, queries

SF = "/root/testdata/sf0.001"
NAME = "op13_source_divergence"


def plain(rows):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(w for r, ws in zip(rows, words) if r[0] == lang for w in set(ws))
        kept = {w for w, n in df.items() if n >= 3}
        sources = {r[1] for r in rows if r[0] == lang}
        count = {s: Counter(w for r, ws in zip(rows, words) if r[:2] == (lang, s) for w in ws if w in kept) for s in sources}
        whole = sum(count.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        ps, q = {s: p(count[s]) for s in sources}, p(whole)
        for s in sources:
            pair = [(-sum((ps[s][w] - ps[o][w]) ** 2 // ps[o][w] for w in kept), o.encode(), o) for o in sources if o != s]
            term = [(-((ps[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:200])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def run(df, **kw):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, **kw).collect())


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        return spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, terms string, p string")
    return build


def test_whole_table_against_sql(spark):
    ok, text = compare(spark, duck(SF), SF, NAME, queries.QUERIES[NAME], queries.SQL[NAME])
    assert ok, text


ODD = [("en", "a", "The cat Sat the_cat"), ("en", "a", "the dog"), ("en", "b", "THE cat 12 the"), ("en", "b", "Cat's tail é É"), ("en", "c", ""), ("en", "c", None), ("en", None, "é the cat É"),
       ("en", "d", "é" * 70_000 + " cat " * 20_000), (None, "a", "x x x"), ("", "b", "x y"), ("", None, "x"), ("fr", "a", "seul"), ("fr", "b", None), ("l\x00m", "a", "z z"), ("l\x00m", "b", "z"), ("l\x00m", "a", "z w"),
       ("de", "a", "Wort"), ("de", "a", "Wort"), ("de", "a", "Wort"), ("de", "Ä", "Wort"), ("de", "z", "Wort\x00Wort 𝒜𝒷"), ("de", "z", "𝒜𝒷"), ("de", "b", "𝒜𝒷 wort")]


@pytest.mark.parametrize("bytes_", [divergence.BUCKET_BYTES, 30_000])
def test_odd_rows_in_one_vocabulary_or_many(make, bytes_):
    assert run(make(ODD), bucket_bytes=bytes_) == plain(ODD)


def test_one_source_with_most_rows(make):
    rows = [("en", "hot" if k % 3 else f"s{k % 12}", " ".join(f"w{chr(97 + k * j % 23)}" for j in range(k % 9))) for k in range(300)]
    rows = [(a, b, t.replace("w", "W", 1)) for a, b, t in rows]
    assert run(make(rows)) == plain(rows)


def test_no_kept_terms_and_no_rows(make):
    rows = [("en", "a", "one"), ("en", "b", "two")]
    assert run(make(rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert run(make([])) == []


def test_only_two_hundred_terms_are_ranked_and_ties_go_by_item(make):
    words = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(300)]
    rows = [("en", "a", " ".join(words))] * 3 + [("en", "b", "other")] * 3
    got = run(make(rows))
    assert got == plain(rows) and sum(r[1:3] == ("a", "term") for r in got) == 200


def test_probability_is_exact_beyond_long(spark):
    row = spark.range(1).select(divergence.probability(divergence.F.lit(30_000_000_000_000), divergence.F.lit(90_000_000_000_001), divergence.F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * 30_000_000_000_001 // 90_000_000_000_008


def test_rows_do_not_grow_with_the_vocabulary_or_its_buckets(spark, make):
    """600 documents in 8 tasks: some rows for each task and group, however many buckets the terms are dealt to."""
    rows = [("en", f"s{k % 2}", " ".join(f"w{chr(97 + j % 26)}{chr(97 + (j + k) % 26)}" for j in range(60))) for k in range(600)]
    parts = divergence.folded(make(rows).repartition(8), 3)
    assert parts.filter("seen").count() <= 8 * 3 * divergence.HOMES and parts.filter("not seen").count() <= 8 * 2 * 30 * divergence.HOMES
    total = parts.filter("not seen").select("weight", divergence.F.explode("terms").alias("term")).groupBy("term").agg(divergence.F.sum("weight").alias("n"))
    want = Counter(f"en\x00{w}" for _, _, t in rows for w in t.split())
    assert {r.term: r.n for r in total.collect()} == want


@pytest.mark.parametrize("terms, row_terms, bytes_", [(1, 1 << 16, 20), (7, 2, 20), (1 << 20, 3, 7), (50, 1, divergence.BUCKET_BYTES), (1 << 20, 1 << 16, 60)])
def test_folds_rows_and_buckets_of_all_sizes(make, monkeypatch, terms, row_terms, bytes_):
    """Vocabulary and counts are those of the documents, wherever folds end and rows are cut."""
    monkeypatch.setattr(divergence, "FOLD_TERMS", terms)
    monkeypatch.setattr(divergence, "ROW_TERMS", row_terms)
    rows = ODD + [("en", "hot" if k % 3 else f"s{k % 5}", " ".join(f"w{chr(97 + k * j % 23)}" for j in range(k % 9))) for k in range(60)]
    assert run(make(rows), bucket_bytes=bytes_) == plain(rows)


def test_a_term_is_written_once_in_however_many_tasks_it_is(spark, make):
    """Before, each task wrote its terms and counts anew: 8 times the strings here."""
    rows = [("en", f"s{k % 2}", " ".join(f"w{chr(97 + j)}" for j in range(20)) + f" once{'x' * (k + 1)}") for k in range(64)]
    parts = divergence.folded(make(rows).repartition(8), 3)
    strings = {r.seen: r.n for r in parts.groupBy("seen").agg(divergence.F.sum(divergence.F.size("terms")).alias("n")).collect()}
    assert strings == {True: 3 * 20 + 64, False: 2 * 20}  # counts of 32 have one digit that is not 0; words of one document have no count
    assert run(make(rows).repartition(8)) == plain(rows)
