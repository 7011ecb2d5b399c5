import numpy as np
from pyspark.sql import functions as F

from silthouse.llm import quality as Q


def test_held_out_accuracy(spark):
    """Half of the labels are held back; the other half fits."""
    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = {r.doc_id: r.keep for r in Q.score(docs, labels.filter("hash(doc_id) % 2 = 0")).select("doc_id", "keep").collect()}
    assert len(got) == docs.count()
    held = labels.filter("hash(doc_id) % 2 <> 0").collect()
    share = lambda kept, rows: np.mean([got[r.doc_id] == kept for r in rows])
    assert share(True, [r for r in held if r.quality == 1 and r.toxic == 0]) > 0.99
    assert share(False, [r for r in held if r.quality == 0]) > 0.95
    assert share(False, [r for r in held if r.toxic]) > 0.8


def test_edges(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, None if i % 3 else 0) for i in range(1, 16)] + [(3, None, 1), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.score(odd, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in odd.collect())
    assert Q.score(empty, labels).count() == 0
    none = Q.score(odd, labels.limit(0)).collect()
    assert all(r.keep and r.probability == 0.5 for r in none)
    assert Q.good_documents(odd, labels).columns == odd.columns
    nulls = odd.selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    assert Q.score(nulls, labels).count() == odd.count()


def plain_exchange(others, seen=None):
    """Counts of features by the other view's sure labels, document by document. others: (features of both views)."""

    def exchange(weights, scales):
        out = []
        for k in (0, 1):
            w, (slope, constant) = weights[1 - k], scales[1 - k]
            counts, sizes = np.zeros((2, Q.SIZES[k][0]), np.int64), np.zeros(2, np.int64)
            for views in others:
                p = 1 / (1 + np.exp(-np.clip(slope * (sum(w[i] for i in views[1 - k]) + w[-1]) + constant, -30, 30)))
                if max(p, 1 - p) >= Q.CONFIDENT:
                    sizes[int(p > 0.5)] += 1
                    for i in views[k]:
                        counts[int(p > 0.5), i] += 1
            out.append((counts, sizes))
        if seen is not None:
            seen.append([int(n) for _, n in out for n in n])
        return out

    return exchange


def test_views_teach_each_other():
    """A view whose own labels say little learns from the other one."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3000)
    text = [[10 + v, *rng.integers(100, 5000, 5).tolist()] for v in y]
    meta = [[20 + v] for v in y]
    views = [Q.Rows.of(text[:200]), Q.Rows.of(meta[:200])]
    weights, mix, _ = Q.co_train(views, y[:200], plain_exchange(list(zip(text[200:], meta[200:], strict=True))))
    scores = np.column_stack([Q.Rows.of(v).sums(w) + w[-1] for v, w in zip((text, meta), weights, strict=True)])
    assert ((np.column_stack([scores, np.ones(3000)]) @ mix > 0) == (y == 1)).mean() > 0.99


def test_every_other_document_takes_part(spark):
    """The model and the probabilities are those of a plain co-training run, document by document, over all that aren't fitted on."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    docs = docs.unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    rows = [(r.doc_id, [Q.content((r.text or "").encode()), Q.metadata((r.lang, r.source, r.n_chars))]) for r in docs.collect()]
    y = {r.doc_id: min(int(r.quality == 1 and not r.toxic), 1) for r in labels.collect()}
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    known = sorted((r for r in rows if r[0] in y), key=lambda r: order[r[0]])
    others = [v for i, v in rows if i is not None and i not in y]
    seen = []
    want = Q.co_train([Q.Rows.of([v[k] for _, v in known]) for k in (0, 1)], np.array([y[i] for i, _ in known]), plain_exchange(others, seen))
    got = Q.train(Q.featured(docs), labels)
    assert len(seen) == Q.ROUNDS and sum(seen[0]) > 0
    for a, b in zip([*want[0], want[1]], [*got[0], got[1]], strict=True):
        assert np.allclose(a, b, atol=1e-6)
    weights, mix, least = want
    p = {}
    for i, v in rows:
        p[i] = 1 / (1 + np.exp(-np.clip(sum(m * (sum(w[j] for j in x) + w[-1]) for m, w, x in zip(mix, weights, v, strict=False)) + mix[-1], -30, 30)))
    scored = Q.score(docs, labels).collect()
    assert all(abs(r.probability - p[r.doc_id]) < 1e-6 for r in scored)
    assert {r.doc_id for r in Q.good_documents(docs, labels).collect()} == {i for i in p if p[i] >= least}


def test_names_with_dots(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    assert Q.good_documents(odd.withColumn("a.b", F.lit(1)), labels).columns == [*odd.columns, "a.b"]


def test_labelled_rows_are_bounded(spark, odd, monkeypatch):
    """Rows that repeat a labelled id count once, so no more rows than the bound reach the driver."""
    held = []
    monkeypatch.setattr(Q, "co_train", lambda views, y, exchange: held.append((len(y), views[0].sizes.size)))
    many = odd.crossJoin(spark.range(50)).withColumn("text", F.concat("text", F.col("id").cast("string"))).drop("id")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    Q.train(Q.featured(many), labels, labelled=10)
    assert held == [(10, 10)]


def test_the_driver_gives_memory_back_after_the_fit(spark, sf, docs, monkeypatch):
    given = []
    monkeypatch.setattr(Q.common, "trim", lambda: given.append(1), raising=False)
    features = Q.featured(docs)
    given.clear()
    assert Q.train(features, spark.read.parquet(f"{sf}/labels.parquet")) is not None
    assert given == [1]
