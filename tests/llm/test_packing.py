import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from silthouse.llm import packing as P


def check(docs, limit=4096):
    rows = P.pack(docs, limit=limit).collect()
    model = Tokenizer.from_file(P.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = [*model.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, a, len(ids[a : a + limit]), zlib.crc32(np.array(ids[a : a + limit], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), limit))]
    assert sorted(tuple(r[:5]) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= limit
    return len(held), sum(r.length for r in rows)


def test_against_the_tokenizer(docs):
    used, total = check(docs)
    assert used <= -(-total // 4096) * 1.02 + 1


def test_edges(spark, odd, empty):
    check(odd)
    check(odd, limit=64)
    assert P.pack(empty).count() == 0
    tricky = ["it's <|endoftext|> x", "A b c\x1cd", "don't DON'T we'll", "éte İstanbul", "12345 a1b2 $$$x", "你好 abc", "<|ENDOFTEXT|>", " ̈x"]
    check(spark.createDataFrame([(1, t) for t in tricky] * 2, "doc_id long, text string"))


def plain_best_fit(lengths, limit):
    """Sequences that best fit decreasing uses, piece by piece."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else limit
        insort(gaps, gap - n)
    return len(gaps)


def placed(plan, counts, limit):
    steps, room = sorted(plan), defaultdict(list)
    for length, n in counts.items():
        own = [s for s in steps if s[0] == length]
        for rank in range(n):
            _, first, seq, each, off = [s for s in own if s[1] <= rank][-1][:5]
            room[seq + (rank - first) // each].append((off + (rank - first) % each * length, length))
    for x in room.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= limit
    return len(room)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_a_sweep_is_best_fit_decreasing(counts):
    plan, over, _ = P.sweep([(n, 0, c) for n, c in counts.items()], [], 40, 0)
    assert not over and placed(plan, counts, 40) == plain_best_fit([n for n, c in counts.items() for _ in range(c)], 40)


def test_supersteps_against_plain_best_fit(spark):
    rng = np.random.default_rng(2)
    for k, limit in enumerate((40, 40, 100, 1000, 4096)):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, limit + 1, 8 + 40 * k), rng.integers(1, 50, 8 + 40 * k))}
        plan = P.best_fit(spark.createDataFrame(list(counts.items()), "length int, n long"), limit)
        used = placed([tuple(r) for r in plan.select("length", "first", "sequence", "each", "offset").collect()], counts, limit)
        assert used <= plain_best_fit([n for n, c in counts.items() for _ in range(c)], limit) * 1.002 + 1


def test_documents_use_as_few_sequences_as_plain_best_fit(docs):
    rows = P.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == plain_best_fit([r.length for r in rows], 4096)


def test_other_vocabularies(spark):
    """Ids are those of the vocabulary itself, whatever its make."""
    texts = ["Hello  World", "it's a\ttest\n\nof 123 things", "Ünïcode 你好 x", "", " lead"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("byte_bpe_50k.json", P.TOKENIZER):
        model = Tokenizer.from_file(P.tokenizer_path(name))
        got = {r.doc_id: (r.length, r.ids_crc32) for r in P.pieces(docs, tokenizer=P.tokenizer_path(name)).collect()}
        for i, t in enumerate(texts):
            ids = [*model.encode(t, add_special_tokens=False).ids, 1]
            assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_parts_are_encoded_once_and_as_the_tokenizer_does():
    """Words that differ in signs or case share their parts; other characters go word by word."""
    encoder = P.Encoder(P.tokenizer_path())
    texts = ["alpha, (beta) alpha. ALPHA's", "beta-alpha 'til 12", None, "naïve “Straße” Привет, 你好 alpha", "İ alpha é x\x1cy \U0001f600\U0001f600!", "<|endoftext|> alpha", "ΑΣ alpha\x85beta 'S"]
    want = [encoder.model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(P.pa.array(texts, P.pa.string()))] == want
    learned = []
    encoder.learn, learn = lambda parts: (learned.extend(parts), learn(parts)), encoder.learn
    assert [x.tolist() for x in encoder.encode(P.pa.array([*texts, "ALPHA+Beta! gamma;"]))][:-1] == want
    assert sorted(learned) == ["!", "+", ";", "gamma"]
    encoder.forget()
    assert [x.tolist() for x in encoder.encode(P.pa.array(texts))] == want


@contextmanager
def settings(spark, **values):
    were = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)


def ranked(docs, monkeypatch):
    """The packed documents and the files of the table of ranks, one for each task with rows."""
    kept = {}

    def keep(df, tag, write=P.common.written, **options):
        kept[tag] = write(df, tag, **options)
        return kept[tag]

    monkeypatch.setattr(P.common, "written", keep)
    return check(docs), len(kept["ranked"].inputFiles())


def test_ranks_of_few_pieces_take_few_tasks(spark, docs, monkeypatch):
    """Small partitions are joined, so that tasks don't write a file each for a few pieces."""
    with settings(spark, **{"spark.sql.shuffle.partitions": "64"}):
        assert ranked(docs, monkeypatch)[1] <= 8


def test_ranks_over_many_tasks(spark, docs, monkeypatch):
    """A length's ranks go on from one partition to the next, and as many sequences are used."""
    with settings(spark, **{"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        used, files = ranked(docs, monkeypatch)
    assert files > 8 and used == check(docs)


def test_a_worker_gives_its_encoders_back():
    path = P.tokenizer_path()
    before = P.Encoder.at(path)
    P.Encoder.drop()
    assert not P.Encoder._open
    assert P.Encoder.at(path) is not before and P.Encoder.at(path).whole("alpha").tolist() == before.whole("alpha").tolist()
