"""Instances of target words in texts against plain loops."""

import random

import pytest
import regex

from polysema.operators import instances


def plain(rows, targets, known, window, stop):
    out = []
    for doc, text in rows:
        spans = [(m.group(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{Nl}\p{No}_]+", text or "")]
        i = 0
        while i < len(spans):
            n = next((n for n in range(len(spans) - i, 0, -1) if "_".join(s[0] for s in spans[i : i + n]) in targets), 0)
            if n:
                left = [s[0] for s in spans[:i] if s[0] in known][-window:]
                right = [s[0] for s in spans[i + n :] if s[0] in known][:window]
                words = list(dict.fromkeys(w for w in left + right if w not in stop))
                out.append((doc, "_".join(s[0] for s in spans[i : i + n]), spans[i][1], spans[i + n - 1][2], words))
            i += max(n, 1)
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,stop,budget", [(1, ["the"], 1 << 26), (3, None, 1 << 26), (10, ["the", "a"], 40)])
def test_equal_to_loops(spark, window, stop, budget):
    r = random.Random(window)
    words = "the a bank river money new york city x é".split()
    rows = [(i, r.choice([" ", ", "]).join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(80)] + [(200, None), (201, ""), (202, "bank"), (None, "river bank"), (203, "the bank"), (203, "the bank")]
    targets, known = {"bank", "new_york", "new_york_city", "city"}, {"the", "a", "river", "money", "bank", "é"}
    table = lambda ws: spark.createDataFrame([(w,) for w in sorted(ws)], "word string")
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id bigint, text string, n int, tokens string")
    got = instances.found_in_texts(docs, table(targets), table(known), window, None if stop is None else table(stop), budget=budget).collect()
    assert sorted(((x["doc_id"], x["target"], x["start"], x["end"], x["words"]) for x in got), key=repr) == plain(rows, targets, known, window, set(stop or ()))
    assert instances.found_in_texts(docs.limit(0), table(targets), table(known)).count() == 0
