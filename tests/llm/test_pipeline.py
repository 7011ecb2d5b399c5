"""run() against brute force: what each stage keeps of what its predecessor kept."""

import corpus_pipeline as C
import test_decontaminate
import test_lines
import test_packing
import test_similar

from silthouse.llm import common, lines, quality


def test_stages_and_run(spark, sf, docs):
    rows, names = docs, [n for n, _ in C.STAGES]
    assert names == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    keep = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("keep").collect()}
    for name, stage in C.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in rows.collect()]
        rows = common.written(stage(spark, rows, sf), "stage")
        assert rows.columns == docs.columns
        after = {r.doc_id: r for r in rows.collect()}
        if name == "quality classifier":
            assert set(after) == keep
        elif name == "line dedup":
            want = {r[0]: r for r in test_lines.brute(before, lines.MIN_CHARS)}
            assert set(after) == {i for i, r in want.items() if r[2] < r[1]}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "simhash near-dedup":
            assert sorted(after, key=str) == test_similar.brute(before)
        else:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {i for i, r in test_decontaminate.brute(before, bench).items() if not r[4]}
        assert 0 < len(after) <= len(before)
    test_packing.check(rows)
    pieces = C.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert len({(r.doc_id, r.piece) for r in pieces}) == len(pieces)
