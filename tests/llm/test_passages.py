"""Repeated passages against a plain search, and the cases that whole long lines miss."""

import random

from polysema.llm import passages

W = passages.WIDTH


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdéfgh") for _ in range(5)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def left(spark, rows):
    df = docs(spark, rows)
    return {r["doc_id"]: r["text"] for r in passages.remove(df, passages.repeats(df)).collect()}


def test_short_lines_and_passages_inside_lines(spark):
    six = "\n".join(words(10 + i, 10) for i in range(6))
    inner = words(1, 54)
    rows = [
        (1, f"{words(2, 9)}\n{six}\n{words(3, 9)}"), (2, f"{six}\n{words(4, 9)}"), (3, f"licence\n{words(5, 9)}"), (4, f"{words(6, 9)}\nLicence "),
        (5, f"| {inner} {words(7, 12)}"), (6, f"{words(8, 7)} {inner.upper().replace("É", "é")} {words(9, 8)}"), (7, " ".join([words(30, 1)] * 120)), (8, f"{words(11, 20)} {words(12, 49)}"), (9, f"{words(13, 20)} {words(12, 49)}"), (10, None),
    ]
    got = left(spark, rows)
    assert got[1] == rows[0][1] and got[2] == words(4, 9) and got[3] == rows[2][1] and got[4] == words(6, 9) + "\n"
    assert got[5] == rows[4][1] and got[6].split() == f"{words(8, 7)} {words(9, 8)}".split()
    assert len(got[7].split()) == W and got[8] == rows[7][1] and got[9] == rows[8][1] and got[10] is None


def test_equals_plain_search(spark):
    """Without line ends every window of the words is looked up in a dictionary."""
    r = random.Random(6)
    pool = [words(100 + i, 130).split() for i in range(4)]
    rows = []
    for i in range(40):
        t = words(200 + i, r.randint(1, 40)).split()
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, 80)
            t += p[a : a + r.randint(30, 130)] + words(r.randint(1000, 9999), r.randint(0, 9)).split()
        rows.append((i, " ".join(t)))
    seen, want = {}, {}
    for i, text in rows:
        t = text.split()
        gone = set()
        for k in range(len(t) - W + 1):
            kept = seen.setdefault(tuple(t[k : k + W]), (i, k))
            if kept != (i, k) and not (kept[0] == i and k < kept[1] + W):
                gone |= set(range(k, k + W))
        want[i] = [x for k, x in enumerate(t) if k not in gone]
    assert sum(len(x) for x in want.values()) < sum(len(t.split()) for _, t in rows)
    assert {i: t.split() for i, t in left(spark, rows).items()} == want
    assert passages.repeats(docs(spark, rows).limit(0)).count() == 0


def test_windows_in_removed_lines_have_no_anchors(spark, monkeypatch):
    """Copies of a text go as lines, so that no anchor of it is left twice; a common line gives anchors at its ends only."""
    line, text = words(50, 400), "\n".join(words(51 + i, 70) for i in range(3))
    rows = [(i, f"{line}\n{words(400 + i, 8)}") for i in range(30)] + [(100 + i, text) for i in range(30)]
    counts, keep = {}, passages.Scratch.keep

    def counted(self, df, name="t"):
        out = keep(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(passages.Scratch, "keep", counted)
    spans = {(r["doc_id"], r["unit"], r["n_words"], r["kept_doc_id"]) for r in passages.repeats(docs(spark, rows)).collect()}
    assert spans == {(i, "line", 400, 0) for i in range(1, 30)} | {(100 + i, "line", 70, 100) for i in range(1, 30)}
    once = [len(passages._anchors(x, None)[0]) for x in (line, text)]
    assert counts["anchors"] <= sum(once) + 30 * 9 < 30 * sum(once) and counts["windows"] <= 30 * 60
    counts.clear()
    passages.repeats(docs(spark, rows[30:])).collect()
    assert counts["anchors"] == once[1] and counts["twice"] == counts["windows"] == 0
