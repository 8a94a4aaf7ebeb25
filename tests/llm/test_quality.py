import numpy as np
import pytest

from callmeter.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_grades(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 1), (1, 1), (None, None)], "q int, t int")
    assert [r.g for r in df.select(quality.grade(df.q, df.t).alias("g")).collect()] == [2, 1, 0, 0, 2]


def test_gradient_is_that_of_the_likelihood():
    """One small step lowers the loss in the direction of numeric differences, for weights and thresholds."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(400)]
    truth = rng.normal(size=40)
    score = np.array([truth[r].sum() for r in rows])
    grades = np.digitize(score, np.quantile(score, [0.3, 0.7]))
    m = quality.fit(rows, grades, decay=0.0)
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(np.array([m.score(r) for r in rows]))
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = tails.sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.8
    assert ((tails[:, -1] >= 0.5) == (grades == 2)).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 4 <> 0"))
    held = quality.scored(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id"), model).select("quality", "toxic", "__keep", "__expected").toPandas()
    good, toxic = held[(held.quality == 1) & (held.toxic == 0)], held[held.toxic == 1]
    poor = held[(held.quality == 0) & (held.toxic == 0)]
    assert good.__keep.mean() > 0.98 and toxic.__keep.mean() < 0.15 and poor.__keep.mean() < 0.2
    assert toxic.__expected.mean() < poor.__expected.mean() < good.__expected.mean()


def test_no_labels_keep_all_and_edge_cases(spark, docs):
    d = docs([(1, "fine"), (None, None), (2, ""), (2, "x " * 50_000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.select(d, labels)
    assert kept.columns == d.columns and kept.count() == 4
    assert quality.select(d.limit(0), labels).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.select(d, some).count() <= 4


def test_query_returns_what_is_kept(spark):
    rows = queries.QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.tail_probability >= 0.65 and r.expected_grade >= 1 for r in rows)
    assert queries.QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.001").count() == len(rows) == pytest.approx(200, abs=80)


def likelihood(rows, grades, weights, thresholds):
    score = np.array([weights[r].sum() for r in rows])
    tail = 1 / (1 + np.exp(-(score[:, None] - thresholds[None, :])))
    full = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], axis=1)
    i = np.arange(len(rows))
    return np.log(full[i, grades] - full[i, grades + 1]).mean()


def test_fit_is_where_numeric_differences_vanish():
    """Against a plain likelihood: at the fitted weights and thresholds no small step in any of them raises it, with no decay and equal rarity."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, 4, replace=False)).astype(np.int32) for _ in range(600)]
    truth = rng.normal(size=12)
    grades = np.digitize(np.array([truth[r].sum() for r in rows]) + rng.logistic(size=600), [-0.5, 0.7])
    m = quality.fit(rows, grades, rounds=3000, rate=0.05, decay=0.0)
    w, t, e = m.weights.copy(), m.thresholds.copy(), 1e-5
    assert likelihood(rows, grades, w, t) > likelihood(rows, grades, 0 * w, np.array([-3.0, -1.5])) + 0.1
    for k in range(12):
        up, down = w.copy(), w.copy()
        up[k] += e
        down[k] -= e
        assert abs(likelihood(rows, grades, up, t) - likelihood(rows, grades, down, t)) / (2 * e) < 1e-3
    for k in range(2):
        step = np.eye(2)[k] * e
        assert abs(likelihood(rows, grades, w, t + step) - likelihood(rows, grades, w, t - step)) / (2 * e) < 1e-3


def plain_features(text):
    import zlib
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    again = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(1 for w in words if w[-1] <= 127 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ".,")
    n = max(len(words), 1)
    shape = [f"again {len(bin(again)) - 2 if again else 0}", f"distinct {min(len(bin(n)) - 2, 8)} {8 * len(set(words)) // n}", f"odd {min(20 * odd // n, 10)}"]
    marked = [(w, 0) for w in words] + [(w[:4], 1) for w in words] + [(w[-3:], 2) for w in words] + [(s.encode(), 3) for s in shape]
    return {zlib.crc32(w, k) % (1 << 18) for w, k in marked}


def test_every_document_is_scored_as_a_plain_scorer_does(spark, docs):
    """Whole texts of the given table, nulls, repeats; the model is the one that the query trains."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(table, labels)
    w = model.weights.astype(np.float32)
    more = docs([(-1, None), (-2, ""), (-3, "Ünï code wÖrds! x x x"), (-3, "Ünï code wÖrds! x x x"), (None, "a " * 40_000)])
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").union(more.select("doc_id", "text")).collect()]
    want = []
    for i, t in rows:
        tails = 1 / (1 + np.exp(-(sum(float(w[f]) for f in plain_features(t)) - model.thresholds)))
        want.append((i, tails[1] >= 0.65, tails.sum()))
    got = quality.scored(table.select("doc_id", "text").union(more.select("doc_id", "text")), model).collect()
    assert len(got) == len(want)
    for g, (i, keep, expected) in zip(sorted(got, key=lambda r: (str(r.doc_id), r["__expected"])), sorted(want, key=lambda r: (str(r[0]), r[2]))):
        assert g.doc_id == i and abs(g["__expected"] - expected) < 1e-4 and (g["__keep"] == keep or abs(g["__tail"] - 0.65) < 1e-4)


def test_columns_named_like_helpers_and_fields_that_need_quotes(spark):
    d = spark.sql("SELECT CAST(id AS bigint) AS doc_id, 'some text' AS text, 1 AS grade, 'x' AS found, named_struct('a b', 1, 'c-d', 'y') AS s FROM range(4)")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.select(d, labels, least=0.0).columns == d.columns
    assert quality.select(d, labels, least=0.0).count() == 4 and quality.report(d, labels, least=0.0).count() == 4


def test_driver_gets_the_model_and_none_of_the_rows(spark, docs, monkeypatch):
    """the sample is fitted in a task, with the weights that the same rows have on the driver."""
    rows = [(i, f"word{i % 7} word{i % 3} some more text") for i in range(60)] + [(None, "word1"), (3, None)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(50)], "doc_id long, quality int, toxic int")
    by_id = sorted((i, quality.features((t or "").encode()).tobytes(), t) for i, t in rows if i is not None and i < 50)
    grades = np.array([0 if i % 5 == 0 else 1 + i % 2 for i, _, _ in by_id])
    want = quality.fit([np.frombuffer(f, np.int32) for _, f, _ in by_id], grades)
    monkeypatch.setattr(quality.DataFrame, "toPandas", lambda self: pytest.fail("rows on the driver"))
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("rows on the driver"))
    got = quality.train(docs(rows), labels)
    assert (got.weights == want.weights).all() and (got.thresholds == want.thresholds).all() and got.weights.any()
    none = quality.train(docs([]), labels)
    assert not none.weights.any() and none.thresholds.tolist() == [-3.0, -1.5]
