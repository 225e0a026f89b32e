import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.llm import pii, queries


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in pii.KINDS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def check(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["spans"].startswith(said)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]


def test_given(spark, given, sf_dir):
    rows = queries.op7_pii(spark, sf_dir).collect()
    assert len(rows) == len(given[1])
    check(rows, {d["doc_id"]: d["text"] or "" for d in given[1]})


TRICKY = [
    "a@b.c_x@d.e a.b@c-d.e.f@g.h @x.y a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111",
    "+49 (30) 1234-5678. +1+12 345 678 901 +123456789012345678", "é😀 x@y.zz 😀 10.0.0.1", "0" * 40000 + " " + "a" * 40000, ("m@n.oo " * 3000), "", None,
]


def test_tricky_texts(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    monkeypatch.setattr(queries, "read", lambda *a: df)
    check(queries.op7_pii(spark, "").collect(), {i: t or "" for i, t in enumerate(TRICKY)})


def test_odd_rows(odd_docs, no_docs):
    assert pii.find_personal_data(odd_docs).count() == odd_docs.count()
    assert pii.find_personal_data(no_docs).count() == 0


def planted():
    docs = [(i, f"common words here about nothing {i}") for i in range(200)]
    for i in range(200, 206):
        docs.append((i, f"common hello zorblax common write to zed@secret.org now {i}"))
    docs += [(300, "Zorblax, alone. zorblaxes"), (301, "common write to other@place.com now")]
    return docs


def of_class(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.split("@")[-1], "ip": tuple(value.split(".")[:2]), "card": digits[:6], "phone": digits[:5]}[kind]


def brute_terms(docs, context=6, min_texts=3, least=0.75):
    word = re.compile(r"[^\W\d_]{3,}")
    n_term, n_entity, n_pair = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in docs:
        for w in word.findall(t.lower()):
            n_term[w].add(i)
        last = {}
        for k, p in pii.KINDS.items():
            found = list(re.finditer(p, t))
            for j, m in enumerate(found):
                if valid(k, m.group()):
                    protected = (k, m.group().lower()), (k, "class", of_class(k, m.group().lower()))
                    for e in protected:
                        n_entity[e].add(i)
                    gaps = t[found[j - 1].end() if j else 0 : m.start()], t[m.end() : found[j + 1].start() if j + 1 < len(found) else len(t)]
                    plain = [word.findall(g if k == "email" else re.sub(pii.KINDS["email"], " ", g)) for g in gaps]
                    before, after = plain[0][-context:], plain[1][:context]
                    for w in before + after:
                        for e in protected:
                            n_pair[(e, w.lower())].add(i)
    out = {}
    for (e, w), ids in n_pair.items():
        if len(ids) >= min_texts:
            told = math.log(len(docs) * len(ids) / (len(n_term[w]) * len(n_entity[e]))) / math.log(len(docs) / len(n_entity[e]))
            out[w] = max(out.get(w, -9), told)
    return {w: x for w, x in out.items() if x >= least}


def test_terms_and_sanitising(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.disclosing_terms(df, pii.base_spans(df)).collect()
    want = brute_terms(docs)
    assert {r["term"]: round(r["disclosure"], 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert "zorblax" in want and "common" not in want
    spans = {r["doc_id"]: [(s["start"], s["end"], s["value"]) for s in r["terms"]] for r in pii.find_personal_data(df).collect()}
    for i, t in docs:
        assert spans[i] == [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", t) if m.group().lower() in want]
    assert spans[300] == [(0, 7, "zorblax")] and spans[5] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, pii.find_personal_data(df)).collect()}
    assert clean[300].endswith(", alone. zorblaxes") and "Zorblax" not in clean[300]
    assert "zed@secret.org" not in clean[200] and "[email]" in clean[200] and clean[5] == docs[5][1] and len(clean) == len(docs)


def test_terms_of_classes_of_rare_entities(spark):
    """No address and no number comes twice, yet a word stands beside all of one domain, another beside all of one area."""
    docs = [(i, f"common words here about nothing {i}") for i in range(200)]
    docs += [(200 + i, f"common hello to p{i}@hidden.org quillon now, +1 (386) 555-123{i} vassal common 10.20.{i}.9") for i in range(4)]
    docs += [(300 + i, f"common 4111 1111 1111 {c} farrow end") for i, c in enumerate(("1111", "1129", "1137", "1145"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["term"]: round(r["disclosure"], 9) for r in pii.disclosing_terms(df, pii.base_spans(df)).collect()}
    assert found == {k: round(v, 9) for k, v in brute_terms(docs).items()}
    assert {"quillon", "vassal", "farrow"} <= set(found) and "common" not in found


def test_starts_over_many_runs(spark):
    text = "abc  " * 1000
    row = spark.createDataFrame([(text,)], "text string").select(F.transform(F.split("text", pii.TERM, -1), F.length).alias("gaps"), F.transform(F.regexp_extract_all("text", F.lit(pii.TERM), F.lit(0)), F.length).alias("sizes"))
    assert row.withColumn("s", pii._starts("gaps", "sizes")).first()["s"] == [5 * i for i in range(1000)]


def test_repeats_change_no_term(spark):
    docs = planted()
    for times in (1, 3):
        df = spark.createDataFrame(docs * times, "doc_id long, text string")
        found = {r["term"]: round(r["disclosure"], 9) for r in pii.disclosing_terms(df, pii.base_spans(df)).collect()}
        assert found == {k: round(v, 9) for k, v in brute_terms(docs).items()}


def test_terms_are_whole_words_and_no_parts_of_addresses(spark):
    long = "q" * 200
    docs = [(i, f"plain words only {i}") for i in range(50)] + [(50 + i, f"{long} server mail to zed@hidden.org 10.1.2.3 box {i}") for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near = {n["value"]: n["terms"] for r in pii.base_spans(df).filter("doc_id = 50").collect() for n in r["near"]}
    assert near == {"email:zed@hidden.org": [long, "server", "mail", "box"], "ip:10.1.2.3": [long, "server", "mail", "box"]}


def test_sanitise_keeps_columns_of_any_name(spark):
    rows = [(1, "write to a@b.cc", "k", "m"), (None, None, "k", "m"), (1, "write to a@b.cc", "k", "m"), (None, "x@y.zz", "k", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, marks string")
    got = sorted(map(tuple, pii.sanitise(df, pii.find_personal_data(df)).collect()), key=str)
    assert got == sorted([(1, "write to [email]", "k", "m"), (None, None, "k", "m"), (1, "write to [email]", "k", "m"), (None, "[email]", "k", "m")], key=str)
