"""Edge cases and brute-force comparisons of the training-data operators."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polysema.llm import ann, bpe, decontamination, html, jaccard, langid, linededup, quality, sharding, urlfilter
from polysema.llm.queries import tokenizer_spec
from polysema.llm.shingles import common, shingles

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_bpe_matches_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    letters = "aAbßzÉé'sS \t\n\x1c\x85\xa0012٣²Ⅷ_-<|>ﬁΣσςİı中́😀​\x00%$"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(400)]
    texts += ["<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "", "it's They'LL don't", "ab" * 5000, words(1, 3000)]
    coder = bpe.WordBpe(tokenizer_spec())
    for text, ids, want in zip(texts, coder.encode_batch(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert coder.decode(ids) == t.decode(want.ids, skip_special_tokens=False)


def test_bpe_query_edges(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "a cat"), (3, "a cat")])
    rows = bpe.encode_texts(df, tokenizer_spec(), ids=True, digests=True).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(bpe.encode_texts(df, tokenizer_spec()), tokenizer_spec()).collect()}
    assert decoded == {1: "", 2: "", 3: "a</w> cat</w>"}
    assert bpe.encode_texts(df.limit(0), tokenizer_spec()).count() == 0


def test_sharding(spark):
    df = docs(spark, [(i, words(i, 3)) for i in range(300)] + [(7, "x"), (7, "x"), (None, None), (None, "é")])
    rows = sharding.manifest(df.withColumn("shard", F.lit(1))).collect()
    assert len(rows) == 304
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(1, 0), (3, zlib.crc32("é".encode()))}
    heavy = sharding.assign(df, "doc_id", [1.0, 0.0001]).groupBy("shard").count().collect()
    assert max(heavy, key=lambda r: r["count"])["shard"] == 0
    assert sharding.manifest(df.limit(0)).count() == 0


def test_linededup(spark):
    a, b = words(1, 25), words(2, 25)
    df = docs(spark, [(1, f"{a}\nshort"), (2, f"x\n{a.upper()}\n{b}\n{a}"), (3, None), (3, ""), (1, f"{a}\nshort"), (None, b)])
    spans = linededup.repeats(df).collect()
    assert sorted((r["doc_id"] or -1, r["start"], r["kept_doc_id"]) for r in spans) == [(-1, 0, 2), (2, 2, 1), (2, 2 + len(a) + 1 + len(b) + 1, 1)]
    cut = sorted((r["doc_id"] or -1, r["text"]) for r in linededup.remove(df, linededup.repeats(df)).collect() if r["text"] is not None)
    assert cut == [(-1, ""), (1, f"{a}\nshort"), (1, f"{a}\nshort"), (2, f"x\n{b}\n"), (3, "")]
    assert linededup.repeats(df.limit(0)).count() == 0


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \n\t")) == 0
    assert len(shingles("a b c")) == 1 and (shingles("A b  c") == shingles("a b c")).all()
    assert len(shingles("a b c d e a b c d e")) == 5 and len(shingles("é " * 9)) == 1
    long = words(3, 2000)
    from polysema.llm import shingles as m

    whole, piece = m.word_hashes(long), m.PIECE
    m.PIECE = 100
    try:
        assert (m.word_hashes(long) == whole).all()
    finally:
        m.PIECE = piece
    assert common(shingles(long), shingles(long)) == len(shingles(long))


def groups(n, pairs):
    """The connected components of 0..n-1 as sorted tuples."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return sorted(tuple(g) for g in out.values())


def plain_components(rows):
    """(doc_id, n_shingles, component_id) of every row, nulls as -1, and the number of components, from all pairs."""
    sets = [frozenset(shingles(t).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    found = groups(len(rows), pairs)
    return sorted((-1 if rows[i][0] is None else rows[i][0], len(sets[i]), min((rows[j][0] for j in g if rows[j][0] is not None), default=-1)) for g in found for i in g), len(found)


def got_components(df):
    return sorted(tuple(-1 if x is None else x for x in (r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.near_duplicates(df).collect())


def families(seed, sizes, n_words, changes):
    """Families of near copies whose similarities lie about the threshold."""
    r, rows, shared = random.Random(seed), [], words(77, 40)
    for f in range(12):
        base = words(f, r.choice(n_words)).split()
        for _ in range(r.choice(sizes)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // changes))):
                t[r.randrange(len(t))] = f"m{r.randrange(999)}"
            rows.append((len(rows), " ".join(t) + (" " + shared if r.random() < 0.3 else "")))
    return rows


def test_jaccard_against_all_pairs(spark):
    rows = [(None, "null id"), (900, None), (901, ""), (902, "one two"), (903, "one two"), *families(9, [1, 3, 25], [6, 30, 120], 30)]
    rows += rows[10:13]  # repeated rows
    want, n = plain_components(rows)
    df = docs(spark, rows)
    assert got_components(df.select("doc_id", "text")) == want
    assert jaccard.one_of_each(df).count() == n


def test_jaccard_small_tiles_without_broadcasts(spark, monkeypatch):
    """Many tiles a band, shuffled joins, stars that miss most links."""
    from polysema import tables

    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "band_keys", lambda s: [])
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    rows = families(4, [10, 40], [40, 60], 20)
    assert got_components(docs(spark, rows)) == plain_components(rows)[0]


def test_jaccard_columns_of_any_name(spark):
    rows = families(2, [1, 4], [40], 30)
    df = docs(spark, rows).withColumns({c: F.lit(1) for c in ("_id", "_hash", "text_hash", "n", "d1", "row", "node", "key", "component", "component_id")})
    assert got_components(df) == plain_components(rows)[0]
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == plain_components(rows)[1]


def test_jaccard_empty(spark):
    assert jaccard.near_duplicates(docs(spark, []).select("doc_id", "text")).count() == 0


def test_tiles_equal_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 80, np.uint64)
    sets = [np.unique(np.concatenate((base[: r.integers(40, 80)], r.integers(0, 1 << 62, r.integers(0, 30), np.uint64)))) for _ in range(40)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    tile = jaccard.Tile(np.arange(40), n, np.zeros(40, np.int64), np.arange(40), np.ones(40, bool), np.zeros(40, int))
    links = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * (c := common(sets[i], sets[j])) >= 75 * (n[i] + n[j] - c)}
    alive = set(np.flatnonzero(jaccard.survivors(tile, [jaccard.bitmap(s) for s in sets])).tolist())
    assert links and {x for p in links for x in p} <= alive
    got = jaccard.links(tile, sets)
    assert set(got) <= links and groups(40, got) == groups(40, links)


def test_decontamination(spark):
    item = "What is the colour of the quiet northern sky at dawn? It is pale green with silver clouds."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, words(50, 30)), (1, item)], "item_id bigint, text string")
    df = docs(spark, [(1, words(1, 300) + " " + item + " " + words(2, 300)), (2, words(3, 500)), (3, None), (4, ""), (5, item.split("?")[0]), (6, item.upper()), (6, item.upper())])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.matches(df, items).collect())
    assert got == [(1, 1), (6, 1), (6, 1)]
    assert sorted(r["doc_id"] for r in decontamination.clean(df, items).collect()) == [2, 3, 4, 5]
    assert decontamination.matches(df, items.limit(0)).count() == decontamination.matches(df.limit(0), items).count() == 0


def test_wand_equals_full_scores():
    items = [(i, words(i % 37, 12) + " " + words(i, 6)) for i in range(150)]
    df = decontamination.Counter(t for _, x in items for t in set(x.split()))
    index = decontamination.build(items, df, len(items), 18.0)
    r = random.Random(1)
    for _ in range(60):
        q = np.array(sorted({index.terms[t] for t in items[r.randrange(150)][1].split()} | set(r.choices(range(len(index.terms)), k=20))))
        full = {}
        for t in q:
            for i, x in index.posted[index.first[index.start[t]] : index.first[index.start[t + 1]]]:
                full[i] = full.get(i, 0) + x
        assert {i for i, _ in decontamination.block_max_wand(q, index, 0.4)} == {i for i, x in full.items() if x >= 0.4 - 1e-9}


@pytest.mark.parametrize("part_words", [1_000_000, 40])
def test_decontamination_against_plain_search(spark, monkeypatch, part_words):
    """Every document against every item by the same measures, without an index."""
    monkeypatch.setattr(decontamination, "PART_WORDS", part_words)
    r, d = random.Random(12), decontamination
    items = [(i, words(i, r.randint(2, 20)) + ("? " if i % 3 else " Answer: ") + words(100 + i, r.randint(1, 12)) + ".") for i in range(12)]
    rows = [(0, None), (1, ""), (2, " ".join([words(5, 400)] * 20))]
    for i in range(3, 40):
        own = r.choice(items)[1].split()
        keep = own[: r.randint(1, len(own))] if i % 2 else own
        rows.append((i, words(200 + i, r.randint(0, 200)) + " " + " ".join(keep).upper() + " " + words(300 + i, r.randint(0, 90))))
    rows += rows[5:7]
    n, mean = len(items), sum(len(d.words(t)) for _, t in items) / len(items)
    df = d.Counter(w for _, t in items for w in set(d.words(t.lower())))
    want = []
    for i, text in rows:
        for item_id, t in items:
            one = d.build([(item_id, t)], df, n, mean)
            impact = {w: x for w, k in one.terms.items() for _, x in one.posted[one.first[one.start[k]] : one.first[one.start[k + 1]]]}
            step = max(d.LEAST_STEP, *(len(d.words(x)) for _, x in items)) if part_words > 40 else one.step
            w = d.words((text or "").lower())
            _, question, answer = one.items[0]
            for s in range(0, max(1, len(w) - step), step):
                there = {tuple(w[a : a + m]) for m in {len(g) for g in question | answer} for a in range(s, min(s + 2 * step, len(w)))}
                score = sum(x for k, x in impact.items() if k in w[s : s + 2 * step])
                if score >= d.MIN_SCORE - 1e-9 and d.share(question, there) >= d.MIN_QUESTION and d.share(answer, there) >= d.MIN_ANSWER:
                    want.append((i, item_id))
                    break
    table = docs(spark, rows).withColumns({c: F.lit(0) for c in ("item_id", "score", "part", "words")})
    items = spark.createDataFrame(items, "item_id bigint, text string").withColumn("part", F.lit(1))
    got = [(x["doc_id"], x["item_id"]) for x in d.matches(table, items).collect()]
    assert sorted(got) == sorted(want) and 15 < len(want)
    left = d.clean(table, items)
    assert left.columns == table.columns and sorted(x["doc_id"] for x in left.collect()) == sorted(i for i, _ in rows if i not in {x for x, _ in want})


def test_nearest(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 16))
    x[50:80] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (600, [0.0] * 16), (700, [float("nan")] * 16), (800, [1.0]), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, 10, lambda c: c % 100 == 0).orderBy("query_id", "rank").collect()
    y = x.astype(np.float32).astype(float)
    hit = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10].tolist()
        own = [g for g in got if g["query_id"] == q]
        assert [g["rank"] for g in own] == list(range(1, 11)) and np.allclose([g["score"] for g in own], [d[g["vec_id"]] for g in own])
        hit += len(set(want) & {g["vec_id"] for g in own})
    assert hit >= 38 and {g["query_id"] for g in got} == {0, 100, 200, 300}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(g["query_id"], g["vec_id"]) for g in ann.nearest(few, 10, lambda c: c % 100 == 0).collect()] == [(0, 1)]
    assert ann.nearest(df.limit(0), 10, lambda c: c % 100 == 0).count() == 0


def test_url_rules(spark):
    urls = [(1, "http://A.Net/x"), (2, "https://blog.example.net/en/1?q"), (3, "http://example.com/de/"), (4, "http://x.org/fr/y#z"), (5, None), (6, "no scheme"), (7, "http://bad.example.org/q"), (8, "http://a.net")]
    pages = spark.createDataFrame([(i, u, "", "") for i, u in urls], "page_id bigint, url string, host string, html string")
    bad = spark.createDataFrame([("http://bad.example.org/q", 0)] * 60 + [("http://good.example.org/", 1)] * 60, "url string, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, bad, urlfilter.RULES).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("blog.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7][3] == "block" and got[8][:3] == ("a.net", "", None)
    assert {r["verdict"] for r in urlfilter.judge(pages, bad.limit(0), []).collect()} == {"allow"}


def test_html():
    page = '<html><body class="has-sidebar"><nav><a>Menu</a></nav><article><h1>Ti&amp;tle</h1><p>One<b>two</b><br>three<p>x<div class="ad-box">Buy</div><script>var t="</p>"</script></article><div id="comments">No</div><footer>c</footer>'
    assert html.main_text(page) == "Ti&tle Onetwo three x"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("<article>" + "<p>a " * 20000) == " ".join("a" * 20000)


def test_quality_and_language(spark):
    rows = [(i, words(i, 60) if i % 2 else "spam " * 60) for i in range(120)]
    df = docs(spark, [*rows, (500, None), (501, "")])
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    model = quality.fit(df.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["score"] for r in quality.add_scores(df, model).collect()}
    assert got[500] == got[501] == 0.0 and all((got[i] >= 0.7) == bool(i % 2) for i, _ in rows)
    assert quality.score("text", quality.fit(df.select("doc_id", "text"), labels.limit(0))) == 1.0
    two = spark.createDataFrame([(i, ("the quick house " if i % 2 else "der schöne garten ") * 4, "en" if i % 2 else "de") for i in range(60)] + [(99, None, None), (98, "123 !", "en")], "doc_id bigint, text string, lang string")
    lang = langid.fit(two)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(two, lang).collect()}
    assert found[99] == found[98] == ("und", 0.0) and all(found[i][0] == ("en" if i % 2 else "de") for i in range(60))
    assert langid.predict("text", langid.train([]))[0] == "und"


def test_codewords_are_distinct():
    for n in (2, 4, 30):
        assert len({tuple(c) for c in langid.codewords(n)}) == n


@pytest.mark.parametrize("drop", [False, True])
def test_pipeline_against_plain_steps(spark, tmp_path, drop):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    line = words(900, 30)
    good = [(i, words(i, 80) + "\n" + (line if i < 3 else words(1000 + i, 30))) for i in range(60)]
    rows = good + [(100 + i, "spam " * 80) for i in range(60)] + [(200, good[5][1]), (201, words(500, 40) + " " + words(700, 30) + ".")]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i < 200], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(700, 30))] if not drop else [], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60)) | ({201} if drop else set())
    coder = bpe.WordBpe(tokenizer_spec())
    plain = lambda t: len(coder.encode_batch([t])[0]) // 4
    assert got[0] == plain(good[0][1]) and got[1] == plain(good[1][1].split("\n")[0])
