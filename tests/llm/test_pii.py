import hashlib
import math
import re
from collections import Counter, defaultdict

from silthouse.llm import pii as P


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in P.PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), f"{kind}:{m[0].lower() if kind in ('email', 'ip') else digits}"))
    return out


def brute(rows):
    texts = [(i, t or "") for i, t in rows]
    own = {t: base(t) for _, t in texts}
    tokens = {t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t)] for _, t in texts}
    n, df, e_docs, e_texts, both, both_texts = len(texts), Counter(), Counter(), Counter(), Counter(), Counter()
    copies = Counter(t for _, t in texts)
    for t, c in copies.items():
        words = {w for w, _, _ in tokens[t] if len(w) >= 3}
        for w in words:
            df[w] += c
        for e in {s[3] for s in own[t]}:
            e_docs[e] += c
            e_texts[e] += 1
            for w in words:
                both[e, w] += c
                both_texts[e, w] += 1
    told = defaultdict(set)
    for (e, w), c in both.items():
        if e_texts[e] >= 3 and both_texts[e, w] >= 3 and e_docs[e] < n and math.log(n * c / (e_docs[e] * df[w])) / math.log(n / e_docs[e]) >= 0.9:
            told[e].add(w)
    out = []
    for i, t in texts:
        words = set().union(*told.values())
        terms = [(a, b) for w, a, b in tokens[t] if w in words and not any(a < s[2] and s[1] < b for s in own[t])]
        count = Counter(s[0] for s in own[t])
        parts = [f"{k}:{a}:{b}" for k, a, b, _ in own[t]]
        out.append((i, *(count[k] for k in P.KINDS), hashlib.sha256(",".join(parts).encode()).hexdigest(), ",".join(parts + [f"term:{a}:{b}" for a, b in terms]), len(terms)))
    return sorted(out, key=str)


def check(docs):
    got = sorted(map(tuple, P.report(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    return got


def test_documents(docs):
    assert any(sum(r[1:5]) for r in check(docs))


TRICKY = [
    "a@b.c_d@e.f.g @x.y z@ q@w a.@b-.c..d", "1.2.3.4.5 256.1.1.1 000255.0.0.001 1.2.3 9.9.9.9", "4539 1488 0343 6467 4539148803436467 45391488034364671 1-2 3", "+1 (555) 555-1234. +123 +4 9 +12345678901234567 ++49 30 1234567-",
    "x" * 3000 + "@", "1" * 5000, "+1" + " " * 4000, "a@b" + ".c" * 6000, "1 " * 3000, "é a@é.b ñ a@b.é \U0001f600 u@v.wx", " ".join(f"u{i}@h.org" for i in range(700)), "4539 1488 0343 6467-" * 3,
]


def test_edges(spark, odd, empty):
    check(odd)
    check(empty)
    check(spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)] + [(None, TRICKY[0]), (0, TRICKY[0])], "doc_id long, text string"))


def test_terms(spark):
    rows = [(i, f"Zebulon wrote {i} to boss{i % 2}@x.org about the quarterly plan") for i in range(8)] + [(20 + i, f"the plan number {i} about quarterly things to wrote") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 base", "2 tokens")
    got = {r[0]: r for r in check(docs)}
    assert not got[20][7]
    rows = [(i, f"Zebulon wrote {i} to boss@x.org about the quarterly plan") for i in range(5)] + rows[8:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 _base", "2 _t1")
    assert "term:0:7" in {r[0]: r for r in check(docs)}[2][6]
    clean = P.sanitised(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()}[2] == " wrote 2 to [email] about the quarterly plan"


def test_bare_terms(spark):
    """A term that discloses is marked where the entity isn't named too."""
    rows = [(i, f"Zebulon wrote {i} to boss@x.org about the quarterly plan") for i in range(5)] + [(7, "all about Zebulon and the plan")] + [(20 + i, f"the plan number {i} about quarterly things to wrote") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r for r in check(docs)}
    assert got[7][6] == "term:10:17" and got[20][7] == 0
    assert {r.doc_id: r.text for r in P.sanitised(docs).collect()}[7].startswith("all about [term] and") or {r.doc_id: r.text for r in P.sanitised(docs).collect()}[7] == "all about  and the plan"


def test_many_entities_in_few_texts(spark):
    """Texts with the same entities and words make one pair of classes, not all pairs."""
    body = " ".join(f"u{i}@h.org word{i}x" for i in range(1200))
    docs = spark.createDataFrame([(i, f"{body} n{i}") for i in range(4)] + [(10 + i, f"other text {i}") for i in range(40)], "doc_id long, text string")
    check(docs)
