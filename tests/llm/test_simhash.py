import random

import numpy as np
import pytest
import xxhash

from polysema.llm import simhash


def plain_fingerprint(text):
    w = (text or "").encode().translate(simhash._LOWER).split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(f):
    """Smallest index that each number reaches by distances of 4 bits or less, over all pairs."""
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(f))]


def numbers(seed):
    draw = random.Random(seed)
    out = [draw.getrandbits(64) for _ in range(60)] + [0, 15, 31, (1 << 64) - 1]
    for b in out[:40]:
        for _ in range(4):
            m = b
            for k in draw.sample(range(64), draw.randint(1, 7)):
                m ^= 1 << k
            out.append(m)
    return sorted(set(out))


@pytest.mark.parametrize("at_once,of", [(4_000_000, 0), (500, 0), (300, 2), (4_000_000, 5)])
def test_class_links_equal_all_pairs(monkeypatch, at_once, of):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    f = numbers(at_once)
    parent = np.arange(len(f))
    for part in range(64):
        for held in range(1 << of):
            a, b = simhash.class_links(np.array(f, np.uint64), part, held, of)
            assert all((f[x] ^ f[y]).bit_count() <= 4 * len(f) for x, y in zip(a, b))
            parent = simhash.roots_of(a, b, parent)
    assert parent.tolist() == components(f)


def test_ball_is_dealt_evenly():
    assert len(simhash.ball(2)) == 2081
    assert sorted(len(m) for m in simhash.Ball(0).masks.values()) == [2] + [33] * 63


def test_fingerprints_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choice(["a", "B", "ç", "d e"]) for _ in range(300))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("per_task", [8_000_000, 60])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, per_task):
    monkeypatch.setattr(simhash, "PER_TASK", per_task)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):
        base = [draw.choice(words) for _ in range(120)]
        for _ in range(5):
            w = list(base)
            for at in draw.sample(range(120), draw.randint(0, 3)):
                w[at] = draw.choice(words)
            rows.append((len(rows) + 5, " ".join(w)))
    rows += [(200, None), (3, ""), (4, " \n"), (201, "two words"), (202, "Two\tWORDS"), (203, rows[0][1]), (203, rows[0][1]), (None, rows[7][1]), (None, "lonely text without an id at all"), (204, "x " * 3000)]
    f = [plain_fingerprint(t) for _, t in rows]
    root = components(f)
    smallest = {r: min((d for (d, _), x in zip(rows, root) if x == r and d is not None), default=None) for r in root}
    docs = spark.createDataFrame([(d, t, "q", 1) for d, t in rows], "doc_id bigint, text string, f string, root int")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["f"] % (1 << 64), r["component_id"]) for r in got), key=repr) == sorted(((d, x, smallest[r]) for (d, _), x, r in zip(rows, f, root)), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
