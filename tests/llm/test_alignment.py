import functools
import hashlib
from collections import Counter

import pytest

from polysema.llm import alignment
from polysema.llm.queries import aligned_specs

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "don't  stop\n now \n x", "a▁ b", "▁", "x" * 3000, "中文字符 测试　 ok", "\x1c x", "é́ ß 😀🇩🇪 \U0001d7d8", "<s> <0x41> <|endoftext|> <unk>", "\t tab\r\n", "tail ▁b  c", "� \x00 nul", "'s 's  's"]


@functools.cache
def pieces():
    return alignment.Pieces(*aligned_specs())


def plain(text):
    """A and B ids, groups and links, from whole encodings and the tokens' byte ranges."""
    if not text:
        return [], [], "", []
    p, want = pieces(), (" " + text).encode()
    a, b = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
    if b"".join(p.a_bytes[t] for t in a) != want or b"".join(p.b_bytes[t] for t in b) != want:
        return [], [], "", []

    def ranges(ids, table):
        at, out = 0, []
        for t in ids:
            out.append((at, at + len(table[t])))
            at = out[-1][1]
        return out

    ra, rb = ranges(a, p.a_bytes), ranges(b, p.b_bytes)
    groups, last = [], 0
    for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append(",".join(str(t) for t, (s, e) in zip(a, ra) if last <= s < cut) + "|" + ",".join(str(t) for t, (s, e) in zip(b, rb) if last <= s < cut))
        last = cut
    links = [(x, y) for x, (s, e) in zip(a, ra) for y, (u, v) in zip(b, rb) if max(s, u) < min(e, v)]
    return a, b, ";".join(groups), links


def expected(rows):
    found = [(d, *plain(t)) for d, t in rows]
    count = Counter(x for r in found for x in r[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(
        ((d, len(a), len(b), g.count(";") + (g != ""), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, g, links in found), key=repr
    )


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_texts_and_counts(spark, broadcast):
    rows = [*enumerate(ODD), (90, None), (91, "the cat don't sit"), (91, "the cat don't sit"), (None, "the  cats\n")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, groups string, row_ int")
    got = alignment.aligned_documents(docs, *aligned_specs(), broadcast=broadcast)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [tuple(r) for r in docs.collect() if len(r["text"] or "") < 1500]
    got = alignment.aligned_documents(spark.createDataFrame(short, "doc_id bigint, text string"), *aligned_specs())
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected(short)


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello")], "doc_id bigint, text string")
    row = alignment.align(docs, *aligned_specs()).first()
    assert row["groups"] == plain("hello")[2] and sum(row["times"]) == row["n_links"]
    assert alignment.aligned_documents(docs.limit(0), *aligned_specs()).count() == 0


def test_pieces_are_forgotten_in_turn():
    p = alignment.Pieces(*aligned_specs())
    keep, alignment.PIECES_KEPT = alignment.PIECES_KEPT, 3
    try:
        for text in ["some words of a text", "other words of this text", "some words again"] * 3:
            assert p.align_texts([text])[0][1] == plain(text)[2]
    finally:
        alignment.PIECES_KEPT = keep
