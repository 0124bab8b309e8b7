import hashlib
import random
import zlib

import pytest

from polysema.llm import periodic


def plain_runs(w, times, shortest):
    """Every period by itself: maximal stretches where words agree at that distance."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(shortest, times * q):
                out.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("times,shortest", [(2, 2), (3, 1), (4, 6)])
def test_runs_equal_all_periods(times, shortest):
    draw = random.Random(times)
    for k in range(1500):
        letters = draw.choice([1, 2, 3, 5])
        w = [draw.randrange(letters) for _ in range(draw.randint(0, 40))]
        if k % 3 == 0:  # periodic inside, and again in a later factor
            block = w[: draw.randint(0, 8)]
            w = w[: draw.randint(0, 9)] + block * draw.randint(1, 6) + w[: draw.randint(0, 9)]
            w = w + [9] + w[draw.randint(0, 3) :]
        assert periodic.maximal_runs(w, times, shortest) == plain_runs(w, times, shortest), w
        if times == 4:
            assert periodic.runs_of_words([b"%d" % x for x in w]) == plain_runs(w, 4, 6), w


def test_factors_are_the_longest_that_occur_earlier():
    draw = random.Random(5)
    for _ in range(300):
        w = [draw.randrange(3) for _ in range(draw.randint(0, 30))]
        at = 0
        for start, end, source in periodic.factors(w):
            longest = max((n for n in range(len(w) - at + 1) if any(w[s : s + n] == w[at : at + n] for s in range(at))), default=0)
            assert start == at and end - start == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or source < start and w[source : source + end - start] == w[start:end]
            at = end
        assert at == len(w)


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w, 4, 6)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    shown = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *top, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def query(docs):
    return periodic.periodic_runs(periodic.with_planted_runs(docs), runs=False, text=False, digests=True)


def test_query_equals_plain_search(spark):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choice(["a", "b", "cc", "é "]) for _ in range(draw.randint(0, 60)))) for k in range(400)]
    rows += [(401, None), (402, ""), (403, " \t\x0b\n"), (404, "x " * 500), (405, "A a " * 9), (405, "A a " * 9), (406, "no\x1cspace " * 7)]
    docs = spark.createDataFrame([(d, t, "s", 0) for d, t in rows], "doc_id bigint, text string, start string, runs int")
    assert sorted(map(tuple, query(docs).collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [tuple(r) for r in docs.collect() if len(r["text"] or "") < 4000]
    got = query(spark.createDataFrame(short, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in short), key=repr)


def test_runs_and_text_as_columns(spark):
    docs = spark.createDataFrame([(1, "say " + "so it goes " * 5 + "x")], "doc_id bigint, text string")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)] and row["collapsed"] == "say so it goes x" and row["exponent_milli"] == 5000
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_null_id_keeps_its_text(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g")], "doc_id bigint, text string")
    assert periodic.with_planted_runs(docs).first()["text"] == "a b c d e f g"
