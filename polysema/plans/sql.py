"""DuckDB SQL of the registered queries; the chain of stages is a list of named subqueries."""

from __future__ import annotations

from polysema.functions import treebank

TOKEN = r"[\p{L}\p{Nl}\p{No}_]+"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def minimize(w: str) -> str:
    """The word's form, see functions.text.minimize; w must be a column."""
    s = f"lower(regexp_replace({w}, '^{SPACE}|{SPACE}$', '', 'g'))"
    head = f"(case when regexp_matches({s}, '^[a-z]') then {s} else substr({s}, 2) end)"
    return f"(case when regexp_matches({head}, '[a-z]$') then {head} else substr({head}, 1, greatest(length({head}) - 1, 0)::BIGINT) end)"


def norm(w: str) -> str:
    return f"lower(string_split({w}, '#')[1])"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"(case when {dot(a, a)} * {dot(b, b)} > 0 then {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) else 0 end)"


N, EDGES, LEAST, POOLED, SWEEPS = 10, 10, 2, 20, 20


# name -> (subqueries that it needs, its own)
_STEPS: dict[str, tuple[str, str]] = {
    "vec": ("", "select 'w' || vec_id || 'w' as word, vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings"),
    "near": ("vec", f"""
      select src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) as r from (
        select a.word as src, b.word as dst, round(list_cosine_similarity(a.v, b.v), 6) as weight from vec a, vec b where a.vec_id <> b.vec_id)) where r <= {N}"""),
    "graph": ("near", "select src, dst, floor(weight * 10000)::INT as wq from near"),
    "nodes": ("graph", f"select src as ego, dst as node, wq from graph where wq > 0 and {minimize('src')} <> {minimize('dst')}"),
    "edges": ("nodes", f"""
      select ego, least(a, b) as a, greatest(a, b) as b, max(wq) as wq from (
        select x.ego, g.src as a, g.dst as b, g.wq, row_number() over (partition by x.ego, g.src order by g.wq desc, g.dst desc) as r
        from nodes x join graph g on g.src = x.node join nodes y on y.ego = x.ego and y.node = g.dst where g.wq > 0) where r <= {EDGES} group by all"""),
    "labelled": ("edges", ""),
    "emitted": ("labelled", """
      select word, cid, size, member, sim, pos from (
        select ego as word, label, node as member, wq / 10000.0::DOUBLE as sim, (row_number() over (partition by ego, label order by wq desc, node desc))::INT as pos from labelled) join (
        select ego as word, label, size, (row_number() over (partition by ego order by size desc, label))::INT as cid from (
          select ego, label, count(*) as size from labelled group by all)) using (word, label)"""),
    "clusters": ("emitted", f"select * from emitted where size >= {LEAST}"),
    "priors": ("clusters", "select word, cid, size / sum(size) over (partition by word) as prob from (select distinct word, cid, size from clusters)"),
    "pooled": ("clusters", f"""
      select word, cid, list(x order by dim) as v from (
        select word, cid, dim, sum(sim * x) / sum(sim) as x from (
          select word, cid, sim, unnest(v) as x, unnest(range(len(v))) as dim from clusters join (select word as member, v from vec) using (member) where pos <= {POOLED}) group by all) group by all"""),
    "model": ("priors pooled", "select word, cid, prob, v from priors join pooled using (word, cid)"),
    "ctx": ("vec", """
      select distinct vec_id as ctx_id, 'w' || c || 'w' as word from (
        select vec_id, (vec_id * 7 + k * 13) % (select count(*) from embeddings) as c from embeddings, range(1, 9) t(k)) where c <> vec_id"""),
    "tsense": ("model", "select vec_id as ctx_id, cid, prob, m.v from model m join vec using (word)"),
    "scores": ("ctx tsense", f"select ctx_id, word, cid, round({cosine('c.v', 's.v')}, 6) as s, round(1 / (1 + exp(-{dot('c.v', 's.v')})), 6) as p from ctx join (select word, v from vec) c using (word) join tsense s using (ctx_id)"),
    "sig": ("scores", """
      select *, (row_number() over (partition by ctx_id order by sig desc, word))::INT as r from (
        select ctx_id, word, round(max(s) - min(s), 6) as sig from scores group by all)"""),
    "sig_p": ("scores", """
      select *, (row_number() over (partition by ctx_id order by sig desc, word))::INT as r from (
        select ctx_id, word, round(max(p) - min(p), 6) as sig from scores group by all)"""),
    "sim_scores": ("sig", f"select ctx_id, cid, round({cosine('m.v', 's.v')}, 6) as score from tsense s join ({{}}) m using (ctx_id)".format("select ctx_id, list(x order by dim) as v from (select ctx_id, dim, avg(x) as x from (select ctx_id, unnest(v) as x, unnest(range(len(v))) as dim from sig join vec using (word) where r <= 3) group by all) group by all")),
    "prob_scores": ("sig_p", f"select ctx_id, cid, round(1 / (1 + exp(-{dot('m.v', 's.v')})), 6) as score from tsense s join ({{}}) m using (ctx_id)".format("select ctx_id, list(x order by dim) as v from (select ctx_id, dim, avg(x) as x from (select ctx_id, unnest(v) as x, unnest(range(len(v))) as dim from sig_p join vec using (word) where r <= 3) group by all) group by all")),
    "apart": ("near", f"""
      select distinct ego, least(t, u) as a, greatest(t, u) as b from (
        select *, row_number() over (partition by ego, t order by s desc, u) as r from (
          select n.src as ego, n.dst as t, x.word as u, round(list_cosine_similarity(e.v, x.v) - list_cosine_similarity(tv.v, x.v), 6) as s
          from near n join vec e on e.word = n.src join vec tv on tv.word = n.dst, vec x where x.word <> n.src and x.word <> n.dst))
      where r = 1 and exists (select 1 from near m where m.src = ego and {minimize('m.dst')} = {minimize('u')})"""),
    "anti_nodes": ("apart", "select ego, node, count(*) as n from (select ego, a as node from apart union all select ego, b from apart) group by all"),
    "anti_labelled": ("anti_nodes graph", ""),
    "adjacent": ("", f"""
      select unnest(t[:-2]) as a, unnest(t[2:]) as b from (select regexp_extract_all(text, '{TOKEN}') as t from documents) where len(t) > 1"""),
    "freq": ("", f"select word, count(*) as freq from (select unnest(regexp_extract_all(text, '{TOKEN}')) as word from documents) group by word having count(*) >= 20"),
    "sparse": ("adjacent freq", """
      select a as word, b as feature, count(*)::DOUBLE as score from adjacent where a in (select word from freq) and b in (select word from freq) group by all having count(*) >= 2"""),
    "isa": ("", f"""
      select lower(string_split(hypo, '#')[1]) as hypo, lower(string_split(hyper, '#')[1]) as hyper, sum(freq)::BIGINT as freq from (
        select hypo, hyper, count(*) as freq from (
          select p_name as hypo, string_split(p_name, ' ')[-1] as hyper from part union all select p_name, p_type from part) group by all having count(*) >= 2) group by all"""),
    "part_clusters": ("isa", """
      select word, cid, count(*) over (partition by word, cid) as size, member, sim, (row_number() over (partition by word, cid order by sim desc, member))::INT as pos from (
        select lower(p_type) as word, p_size % 3 as cid, p_name as member, count(*) / 64.0::DOUBLE as sim from part group by all)"""),
    "synsets": ("", """
      select synset, word, (row_number() over (partition by synset order by n desc, word))::INT as rank from (
        select synset, word, count(*) as n from (
          select 's' || p_size as synset, string_split(p_name, ' ')[1] as word from part union all select 'h' || p_size, string_split(p_name, ' ')[2] from part) group by all)"""),
}


def _propagation(nodes: str, edges: str, out: str) -> str:
    """Subqueries of label propagation in a fixed order: one row an ego and step carries the labels."""
    return f"""
    {out}_num as (select ego, node, wq, row_number() over (partition by ego order by node) as k from ({nodes})),
    {out}_sym as (
      select e.ego, x.k as i, y.k as j, e.wq as w from ({edges}) e join {out}_num x on x.ego = e.ego and x.node = e.a join {out}_num y on y.ego = e.ego and y.node = e.b where e.wq > 0
      union all
      select e.ego, y.k, x.k, e.wq from ({edges}) e join {out}_num x on x.ego = e.ego and x.node = e.a join {out}_num y on y.ego = e.ego and y.node = e.b where e.wq > 0),
    {out}_adj as (
      select ego, count(*) as n, list(coalesce(l, []) order by k) as adj from {out}_num left join (
        select ego, i as k, list({{'j': j, 'w': w}}) as l from {out}_sym group by all) using (ego, k) group by ego),
    {out}_steps as (
      select ego, n, 0 as s, range(1, n + 1) as lab, adj from {out}_adj
      union all
      select ego, n, s + 1, list_transform(range(1, n + 1), lambda x: case when x = s % n + 1 and len(adj[s % n + 1]) > 0 then best else lab[x] end), adj from (
        select *, list_position(sums, list_max(sums)) as best from (
          select *, list_transform(range(1, n + 1), lambda l: coalesce(list_sum(list_transform(adj[s % n + 1], lambda e: case when lab[e.j] = l then e.w else 0 end)), 0)) as sums
          from {out}_steps where s < {SWEEPS} * n))),
    {out} as (select ego, node, wq, lab[k]::INT as label from {out}_num join (select ego, lab from {out}_steps where s = {SWEEPS} * n) using (ego))"""


_RECURSIVE = {
    "labelled": _propagation("select * from nodes", "select * from edges", "labelled"),
    "anti_labelled": _propagation(
        "select ego, node, n::INT as wq from anti_nodes",
        """select ego, a, b, wq from (select x.ego, least(g.src, g.dst) as a, greatest(g.src, g.dst) as b, max(g.wq) as wq
           from anti_nodes x join graph g on g.src = x.node join anti_nodes y on y.ego = x.ego and y.node = g.dst where g.wq > 0 group by all) c
           where not exists (select 1 from apart t where t.ego = c.ego and t.a = c.a and t.b = c.b)""",
        "anti_raw",
    )
    + ", anti_labelled as (select ego, node, wq as n, label from anti_raw)",
}


def chain(last: str, select: str, other: dict[str, tuple[str, str]] | None = None) -> str:
    """A query over the named stage and all that it needs; other: stages in place of those of the same name."""
    order: list[str] = []
    steps = _STEPS | (other or {})

    def need(name: str) -> None:
        if name not in order:
            for x in steps[name][0].split():
                need(x)
            order.append(name)

    need(last)
    if "anti_nodes" not in order and "anti_nodes" in select:
        need("anti_nodes")
    parts = [_RECURSIVE[n] if n in _RECURSIVE else f"{n} as materialized ({steps[n][1]})" for n in order]
    return f"with recursive {', '.join(parts)} {select}"


TERM_FREQUENCIES = f"select word, count(*) as freq from (select unnest(regexp_extract_all(text, '{TOKEN}')) as word from documents) group by word having count(*) >= 20"

_WORDS = f"list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')"

TOKEN_STATS = f"select lang, count(*) as docs, sum(n)::BIGINT as tokens, round(avg(n), 4) as mean_tokens, max(n)::INT as max_tokens from (select lang, len({_WORDS}) as n from documents) group by lang"

MINIMIZE = f"select word, {minimize('word')} as form from (select distinct unnest({_WORDS}) as word from documents)"

_TITLE = "array_to_string(list_transform(range(1, length(w) + 1), lambda i: case when i = 1 or not regexp_matches(substr(lower(w), i - 1, 1), '\\p{L}') then replace(upper(substr(lower(w), i, 1)), 'ẞ', 'SS') else substr(lower(w), i, 1) end), '')"

CASE_VARIANTS = f"""
select word, case when t = w and l = w then w when t = w or t = l then w || ' ' || l when l = w then w || ' ' || t else w || ' ' || t || ' ' || l end as variants
from (select word, w, {_TITLE} as t, lower(w) as l from (select word, word || '-x_y' as w from (select distinct unnest(regexp_extract_all(text, '{TOKEN}')) as word from documents)))"""

PHRASE_VARIANTS = """
with p as (select distinct trim(p_name) as w from part), c as (select w, upper(w[1]) || lower(w[2:]) as c from p)
select w as phrase from c union select c from c union select replace(w, ' ', '_') from c union select replace(c, ' ', '_') from c"""

CLEAN_PAGES = rf"""
with t as (select page_id, ' a;b &AMP; c &quot\; "q" ' || html as h, regexp_replace(html, '<[^>]*>', ' ', 'g') as t from pages)
select page_id, md5(t) as plain, md5(regexp_replace(t, '{SPACE}', ' ', 'g')) as spaced,
  md5(regexp_replace(replace(regexp_replace(regexp_replace(h, '^{SPACE}|{SPACE}$', '', 'g'), '&(amp|quot)(\\;|;)?', ' ', 'gi'), '\;', ' '), '[\\"]', ' ', 'g')) as cleaned from t"""

WHITESPACE = f"select doc_id, length(regexp_replace(text, '[\\n\\r]+', ' ', 'g'))::INT as line_length, length(regexp_replace(text, '{SPACE}', ' ', 'g'))::INT as space_length from documents"

URLS = """
with t as (select page_id, regexp_extract_all('see ' || url || ' and ' || upper(url), '(?i)https?://[^ ]+') as f from pages)
select page_id, unnest(range(len(f)))::INT as at, unnest(f) as found from t"""

#: Strings that tell the patterns apart, beside the documents' texts.
PROBES = ["$", "&#39;", "&;", "1, 2", "1 2 x", "ab-cd", "AB cd-E", "ab1", "+7 (912) 345-67-89", "8 912 345 67 89", "12345678901", "HTTP://A.b/c", "!!", "???", "ABC", "aB", "x_y", "привет", ""]
_FLAGS = {
    "latin_mwe": "(?i)^[-a-z ]+$", "latin_word": "(?i)^[-a-z]+$", "latin_chars": "[a-zA-Z]", "xml_escape": r"&[^\p{Z}\x09-\x0D\x{85}]+;", "dollar": r"\$",
    "phone": r"\+?\s*\b[78]\s*[\(\s-]?\d\d\d[)\s-]?\s*(\d[-\s]?){7}\b", "url": "(?i)https?://[^ ]+", "exclamations": "!!!+", "questions": r"\?\?\?+", "upper_letter": "[A-Z]",
    "upper_run": "[A-Z]{3,}", "spaced_numbers": r"^[,\p{Nd}\p{Z}\x09-\x0D\x{85}]+$", "number": r"\p{Nd}+", "at": "@", "norm_babel": "[()_:]", "norm_babel_dash": "[()_:-]",
}
_PROBE_ROWS = ", ".join(f"({-i - 1}, '{p}')" for i, p in enumerate(PROBES))
PATTERN_FLAGS = f"with t(doc_id, text) as (select doc_id, text from documents union all select * from (values {_PROBE_ROWS})) select doc_id, " + ", ".join(f"regexp_matches(text, '{p}')::INT as {n}" for n, p in _FLAGS.items()) + " from t"

NORM_BABEL = r"""
with t as (select p_partkey, p_name || '#' || replace(p_brand, '#', ':') || ' (' || p_type || ')_x' as w from part)
select p_partkey, lower(string_split(w, '#')[1]) as norm, trim(lower(regexp_replace(regexp_replace(w, '[()_:]', ' ', 'g'), ' +', ' ', 'g'))) as babel,
  case when len(string_split(w, 'e')) > 2 then length(string_split(w, 'e')[1]) + 1 + length(string_split(w, 'e')[2]) else -1 end::INT as second_e from t"""

CLUSTER_PARSE = """
with c as (select p_partkey, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b, p_size from part),
items as (
  select p_partkey, a as word, 1 as place, 0.5::DOUBLE as sim from c union all select p_partkey, b, 2, 1 / pow(2, 0.33) from c
  union all select p_partkey, 'a', 4, p_size / 64.0::DOUBLE from c union all select p_partkey, a, 5, 0.25 from c)
select p_partkey, word, round(arg_max(sim, place), 6) as sim, (row_number() over (partition by p_partkey order by min(place)))::INT as pos from items group by p_partkey, word"""

SENSE_IDS = """
select p_partkey, replace(p_name || '#' || p_type, ' ', '_') || '#' || p_size as sense, replace(p_name || '#' || p_type, ' ', '_') as word, p_size::VARCHAR as cid from part"""

BIGRAMS = f"""
with adjacent as ({_STEPS['adjacent'][1]}),
freq as (select word, count(*) as f from (select unnest(regexp_extract_all(text, '{TOKEN}')) as word from documents) group by word)
select a, b, n, score from (
  select a, b, n, round((n - 5) * (select count(*) from freq) / fa.f / fb.f, 6) as score
  from (select a, b, count(*) as n from adjacent group by all having count(*) >= 5) join freq fa on fa.word = a join freq fb on fb.word = b) where score > 10"""



def taken(vocabulary: str, least: int, most: int) -> str:
    """Subqueries up to ``took`` (doc_id, i, n, phrase): phrases of the vocabulary (p) in the texts, left to right, the longest
    first, none inside another. A match that no earlier one reaches begins a chain; each chain is followed by itself."""
    return f"""
t as (select row_number() over () as doc, doc_id, regexp_extract_all(text, '{TOKEN}') as t from documents),
grams as (select doc, i, n, array_to_string(t[i:i + n - 1], '_') as p from (select doc, t, n, unnest(range(1, len(t) - n + 2)) as i from t, range({least}, {most + 1}) r(n) where len(t) >= n)),
longest as (select doc, i, max(n) as n, max_by(p, n) as p from grams where p in (select p from ({vocabulary})) group by doc, i),
reach as (select *, coalesce(max(i + n) over (partition by doc order by i rows between unbounded preceding and 1 preceding), 0) <= i as head from longest),
runs as (select *, sum(head::INT) over (partition by doc order by i) as run from reach),
took as (
  select doc, run, i, n, p from runs where head
  union all
  select doc, run, i, n, p from (select r.*, row_number() over (partition by r.doc, r.run order by r.i) as k from took x join runs r on r.doc = x.doc and r.run = x.run and r.i >= x.i + x.n) where k = 1)"""


_SCORED = f"select a || '_' || b as p from ({BIGRAMS})"
PHRASE_MERGE = f"with recursive {taken(_SCORED, 2, 2)} select p as phrase, count(*) as n from took group by p"
_THREE = f"select array_to_string(t[i:i + 2], '_') as p from (select t, unnest(range(1, len(t) - 1)) as i from (select regexp_extract_all(text, '{TOKEN}') as t from documents)) group by 1 having count(*) >= 10"
PHRASE_MERGE_ALL = f"with recursive {taken(f'{_SCORED} union all select phrase from ({PHRASE_VARIANTS}) union all {_THREE}', 2, 6)} select p as phrase, count(*) as n from took group by p"
_RARE = f"select word from (select unnest(regexp_extract_all(text, '{TOKEN}')) as word from documents) group by word having count(*) between 20 and 24"
#: The text up to a token is as long as the tokens and the stretches between them, which are the text split at tokens.
PHRASE_PLACES = f"""
with recursive {taken(f'{_SCORED} union all {_RARE}', 1, 2)},
body as (select row_number() over () as doc, doc_id, text from documents),
gaps as (select doc, doc_id, string_split_regex(text, '{TOKEN}') as g, regexp_extract_all(text, '{TOKEN}') as t from body)
select doc_id, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(t[:i - 1], lambda x: length(x))), 0))::INT as start,
  (list_sum(list_transform(g[:i + n - 1], lambda x: length(x))) + list_sum(list_transform(t[:i + n - 1], lambda x: length(x))))::INT as "end", p as phrase
from took join gaps using (doc)"""

NORMALISE = "select 'w' || vec_id || 'w' as word, dim::INT as dim, round(x / n, 6) as value from (select vec_id, unnest(v) as x, unnest(range(len(v))) as dim, sqrt(list_inner_product(v, v)) as n from (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings))"

COSINE_PAIRS = f"""
with e as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings)
select a.vec_id as a, b.vec_id as b, round({cosine('a.v', 'b.v')}, 6) as sim, round(1 / (1 + exp(-{dot('a.v', 'b.v')})), 6) as prob from e a join e b on b.vec_id = a.vec_id + 1"""

EDGE_LOOKUP = "select 'w' || vec_id || 'w' as src, 'w' || (vec_id + 1) || 'w' as dst, coalesce(wq, 0) as wq from embeddings left join graph on src = 'w' || vec_id || 'w' and dst = 'w' || (vec_id + 1) || 'w'"

SUBSTRING_NODES = f"""
with adjacent as ({_STEPS['adjacent'][1]}), freq as ({_STEPS['freq'][1]}),
voc as (select word as node from freq where contains(word, '_') union select a || '_' || b from (select a, b from adjacent group by all having count(*) >= 20))
select distinct word as ego, node from freq, voc where starts_with(node, word || '_') or ends_with(node, '_' || word)"""

SENSE_STATS = f"""
, senses as (select distinct word, cid, size from emitted), per as (select word, count(*) as n from senses where size >= {LEAST} group by word)
select count(*) as words, sum(n)::BIGINT as senses_kept, round(avg(n), 6) as mean_senses, round(stddev_pop(n), 6) as std_senses, quantile_cont(n, 0.5) as median_senses,
  (select count(*) from senses) as senses, round(100 * sum(n) / (select count(*) from senses), 4) as kept_percent from per"""

CLUSTER_STRINGS = "select word, cid, string_agg(member || ':' || printf('%.4f', sim), ', ' order by pos) as line from clusters group by all"

SIMILAR_WORDS = """
select word, member, sim, rank from (
  select *, (row_number() over (partition by word order by sim desc, member))::INT as rank from (
    select word, lower(member) as member, round(sum(sim), 6) as sim from emitted group by all)) where rank <= 5"""

MOST_PROBABLE = "select word, cid, round(prob, 6) as prob from (select *, row_number() over (partition by word order by prob desc, cid) as r from priors) where r = 1"


def pooled(kind: str) -> str:
    weight, total = {"score": ("sim", "sum(sim)"), "rank": ("1 / pos::DOUBLE", "sum(pos)"), "ones": ("1.0::DOUBLE", "count(*)")}[kind]
    return chain("clusters", f"""
      select word, cid, dim, round(sum(w * x) / {total}, 5) + 0.0::DOUBLE as value from (
        select word, cid, sim, pos, {weight} as w, unnest(v) as x, unnest(range(len(v)))::INT as dim from clusters join (select word as member, v from vec) using (member) where pos <= {POOLED}) group by word, cid, dim""")


MAX_PAIRWISE = f"""
select src as w1, dst as w2, coalesce(max(case when a.v is not null and b.v is not null then round({cosine('a.v', 'b.v')}, 6) end), 0) as sim
from near left join model a on a.word = src left join model b on b.word = dst group by all"""

SENSE_KNN = """
select src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) as r from (
  select a.word || '#' || a.cid as src, b.word || '#' || b.cid as dst, round(list_cosine_similarity(a.v, b.v), 6) as weight
  from model a, model b where a.word || '#' || a.cid <> b.word || '#' || b.cid)) where r <= 5"""

MIX = "select word, cid, round(sqrt(list_sum(list_transform(list_zip(m.v, w.v), lambda p: pow(0.5 * p[1] + 0.5 * p[2], 2)))), 5) as length from model m join (select word, v from vec) w using (word)"

CONTEXT_WINDOW = f"""
with words as (select unnest({_WORDS}) as word from documents), voc as (select word, count(*) as n from words group by word),
cut as (select doc_id, text, position('the' in text) as p from documents),
sides as (
  select doc_id, -1 as side, case when p > 0 then substr(text, 1, p - 1) else text end as text from cut
  union all select doc_id, 1, case when p > 0 then substr(text, p + 3) else '' end from cut),
placed as (select doc_id, side, unnest(w) as word, unnest(range(len(w))) as place from (select doc_id, side, {_WORDS} as w from sides)),
near as (select doc_id, word, row_number() over (partition by doc_id, side order by place * side) as r from placed where word in (select word from voc where n >= 20))
select distinct doc_id as ctx_id, word from near where r <= 10 and word not in (select word from voc where n >= 2000)"""

DISAMBIGUATE = """
, by_ctx as (select ctx_id, cid, score from (select *, row_number() over (partition by ctx_id order by score desc, cid) as r from sim_scores) where r = 1),
by_prior as (select ctx_id, cid, prob from (select *, row_number() over (partition by ctx_id order by prob desc, cid) as r from tsense) where r = 1)
select vec_id as ctx_id, vec.word as target, coalesce(c.cid, p.cid, 0)::INT as cid, coalesce(c.score, round(p.prob, 6), 1.0) as score,
  case when c.cid is not null then 'context' when p.cid is not null then 'prior' else 'none' end as how
from vec left join by_ctx c on c.ctx_id = vec_id left join by_prior p on p.ctx_id = vec_id"""

DISAMBIGUATE_ALL = DISAMBIGUATE.replace(" as how\nfrom", " as how,\n  replace(vec.word, ' ', '_') || '#' || coalesce(c.cid, p.cid, 0) as sense\nfrom")

#: Words with vectors: the first token of the document that has the vector's number.
_TEXT_STEPS = {
    "toks": ("", f"select doc_id, regexp_extract_all(text, '{TOKEN}') as t from documents"),
    "vec": ("toks", "select word, vec_id, v from (select t[1] as word, min(vec_id) as vec_id from toks join embeddings on vec_id = doc_id where len(t) > 0 group by 1) join (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings) using (vec_id)"),
    "place": ("vec", "select doc_id, i, w, w in (select word from vec) as known from (select doc_id, unnest(range(1, len(t) + 1)) as i, unnest(t) as w from toks)"),
    "counted": ("place", "select *, sum(known::INT) over (partition by doc_id order by i) as k from place"),
    "inst": ("counted model", "select doc_id, i, w as target, k, known::INT as own from counted where w in (select word from model)"),
    "ctx": ("inst", """
      select distinct x.doc_id || ':' || x.i as ctx_id, c.w as word from (
        select *, unnest(range(1, 6)) as s from inst) x join counted c on c.doc_id = x.doc_id and c.known and (c.k = x.k - x.own + 1 - s or c.k = x.k + s)"""),
    "tsense": ("inst", "select doc_id || ':' || i as ctx_id, cid, prob, v from inst join model on word = target"),
}
_TEXT_ANSWER = """
, by_ctx as (select ctx_id, cid, score from (select *, row_number() over (partition by ctx_id order by score desc, cid) as r from sim_scores) where r = 1),
by_prior as (select ctx_id, cid, prob from (select *, row_number() over (partition by ctx_id order by prob desc, cid) as r from tsense) where r = 1)
select doc_id, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(t[:i - 1], lambda x: length(x))), 0))::INT as start,
  target, coalesce(c.cid, p.cid)::INT as cid, coalesce(c.score, round(p.prob, 6)) as score, case when c.cid is not null then 'context' else 'prior' end as how
from inst join toks using (doc_id) join (select doc_id, string_split_regex(text, '@@TOKEN@@') as g from documents) using (doc_id)
  left join by_ctx c on c.ctx_id = inst.doc_id || ':' || i left join by_prior p on p.ctx_id = inst.doc_id || ':' || i"""
WSD_TEXTS = chain("sim_scores", _TEXT_ANSWER.replace("@@TOKEN@@", TOKEN), _TEXT_STEPS)

ANTI_INVENTORY = "select ego as word, label as cid, max({'n': n, 'node': node}).node as keyword, string_agg(node, ', ' order by node) as cluster from anti_labelled group by all"

ANTI_DISAMBIGUATE = f"""
, inv as (select ego as word, label as cid, max({{'n': n, 'node': node}}).node as keyword from anti_labelled group by all),
c0 as (select vec_id as ctx_id, 'w' || c || 'w' as word from (select distinct vec_id, (vec_id * 7 + k * 13) % (select count(*) from embeddings) as c from embeddings, range(1, 9) t(k)) where c <> vec_id),
c as (select *, row_number() over (partition by ctx_id order by word) as place from c0),
target as (select vec_id as ctx_id, word as target from vec),
context as (select ctx_id, target, word, place from c join target using (ctx_id) where not (starts_with(word, target) and length(word) <= length(target) + 1)),
keys as (select ctx_id, keyword from target join inv on inv.word = target),
dots as (select ctx_id, c.word, place, keyword, round({cosine('a.v', 'b.v')}, 6) as s from context c join vec a on a.word = c.word join keys using (ctx_id) join vec b on b.word = keyword),
sig as (select ctx_id, word, place, round(max(s) - min(s), 6) as sig from dots group by all),
kept as (select ctx_id, word from (select *, row_number() over (partition by ctx_id order by sig desc, place) as r from sig) where r <= 3),
score as (select ctx_id, keyword, round(avg(s), 6) as score from dots join kept using (ctx_id, word) group by all),
ranked as (select *, (row_number() over (partition by ctx_id order by score desc, keyword))::INT as rank from score)
select ctx_id, target, coalesce(keyword, 'UNKNOWN') as keyword, coalesce(score, 1.0) as score, coalesce(rank, 1) as rank from target left join ranked using (ctx_id)"""

_TOP = "select word, feature, score, (row_number() over (partition by word order by score desc, feature))::INT as rank from sparse"
TOP_FEATURES = f"select * from ({_TOP}) where rank <= 10"

SPARSE_COSINE = f"""
, pairs as (select word as w1, feature as w2 from ({_TOP}) where rank <= 3), norms as (select word, sqrt(sum(score * score)) as n from sparse group by word)
select w1, w2, round(coalesce(sum(a.score * b.score) / (any_value(x.n) * any_value(y.n)), 0), 6) as sim
from pairs left join norms x on x.word = w1 left join norms y on y.word = w2 left join sparse a on a.word = w1 left join sparse b on b.word = w2 and b.feature = a.feature group by w1, w2"""

SPARSE_POOLING = f"""
, members as (select word, rank % 2 as cid, feature as member, score as sim, ((rank + 1) // 2) as pos from ({_TOP}) where rank <= 6),
total as (select word, cid, sum(sim) as total from members where pos <= 2 group by all)
select m.word, m.cid, s.feature, round(sum(m.sim * s.score) / any_value(total), 6) as score from members m join sparse s on s.word = m.member join total t on t.word = m.word and t.cid = m.cid group by m.word, m.cid, s.feature"""

HYPONYMS = "select word, hypo, freq, rank from (select hyper as word, hypo, freq, (row_number() over (partition by hyper order by freq desc, hypo))::INT as rank from isa where hypo <> hyper) where rank <= 5"

HYPERNYMS = """
select word, hyper, freq, rank from (
  select w.word, hyper, freq, (row_number() over (partition by w.word order by freq desc, hyper))::INT as rank from (select distinct upper(p_name) as word from part) w join isa on hypo = lower(w.word)) where rank <= 3"""

HAS_RELATION = """
, pairs as (select distinct upper(string_split(p_name, ' ')[1][1]) || string_split(p_name, ' ')[1][2:] || ' ' || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] as hypo, p_type as hyper from part)
select p.hypo, p.hyper, coalesce(freq, 0) as freq from pairs p left join isa i on i.hypo = lower(p.hypo) and i.hyper = lower(p.hyper)"""

HYPERNYM_SCORES = f"""
, found as (select c.word, cid, size, hyper, sim, freq from part_clusters c join isa on hypo = {norm('member')} where hyper <> c.word),
total as (select word, cid, size, hyper, round(sum(sim * freq), 6) as score, count(*) as n from found group by all)
select word, cid, hyper, score, round(score / size, 6) as score_share, n, round(n / size, 6) as n_share, rank from (
  select *, (row_number() over (partition by word, cid order by score desc, hyper))::INT as rank from total) where rank <= 5"""

CLOSURE = """
select word, cid, count(*) filter (length(member) % 4 <> 0) >= 15 as kept, count(*) filter (length(member) % 4 <> 0) as left from part_clusters group by all"""

MEMBER_SENSES = """
, base as (select word, cid, lower(member) as f, max(sim) as w from emitted group by all union all select distinct word, cid, lower(word), 1.0 from emitted),
c as (select word, cid, f, max(w) as w from base group by all),
mem as (select distinct word, cid, member from emitted),
om as (select m.word, m.cid, m.member, f, w from mem m join c using (word, cid) where f <> lower(m.member)),
nc as (select word, cid, member, sqrt(sum(w * w)) as nc from om group by all),
cand as (select word as sw, cid as sc, lower(member) as f, sim from emitted),
ns as (select sw, sc, sqrt(sum(sim * sim)) as ns from cand group by all),
d as (select om.word, om.cid, om.member, sw, sc, sum(w * sim) as d from om join cand on lower(sw) = lower(om.member) and cand.f = om.f group by all),
s as (select word, cid, member, sw, sc, round(d / (nc * ns), 6) as score from d join nc using (word, cid, member) join ns using (sw, sc)),
b as (select *, row_number() over (partition by word, cid, member order by sw <> member, score desc, sw, sc) as r from s)
select mem.word, mem.cid, mem.member, case when score >= 1e-6 then sw || '#' || sc else mem.member || '#?' end as sense, case when score >= 1e-6 then score else 0 end as score
from mem left join b on b.word = mem.word and b.cid = mem.cid and b.member = mem.member and r = 1"""

LABEL_PAIRS = """
select distinct s.word as hypo, h.word as hyper, 'label:' || substr(s.synset, 2) as source from synsets s join synsets h on h.synset = 'h' || substr(s.synset, 2)
where starts_with(s.synset, 's') and h.rank <= 3 and s.word <> h.word"""

VECTOR_PAIRS = """
, sizes as (select synset, count(*) as size from synsets group by synset), ids as (select distinct substr(synset, 2)::INT as i from synsets),
near as (select 'h' || i as src, 's' || (i + k) as dst, k as rank from ids, range(1, 4) t(k)),
kept as (select src, dst from (select src, dst, row_number() over (partition by src order by rank, dst) as r from near join sizes on synset = dst where size <= 8) where r <= 2)
select distinct s.word as hypo, h.word as hyper, 'vector:' || substr(src, 2) as source from kept join synsets h on h.synset = dst join synsets s on s.synset = 's' || substr(src, 2) where s.word <> h.word"""

_MFS = "select word, cid from (select word, cid, row_number() over (partition by word order by size desc, cid) as r from (select distinct word, cid, size from clusters)) where r = 1"
MFS = f"select vec_id as ctx_id, vec.word as target, coalesce(m.cid, -1)::INT as predicted from vec left join ({_MFS}) m on m.word = vec.word"

RANDOM = "select vec_id as ctx_id, word as target, (((vec_id % 65521) * 16807 + 7) % 2147483647 % n + 1)::INT as predicted from vec join (select word, count(distinct cid) as n from clusters group by word) using (word)"

SPEARMAN = """
, p as (select weight as a, abs(regexp_extract(src, '\\d+')::BIGINT - regexp_extract(dst, '\\d+')::BIGINT) as b from near),
r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from p)
select count(*) as n, round(corr(ra, rb), 6) as rho from r"""

MCNEMAR = """
with t as (select count(*) filter (quality = 1 and toxic <> 0) as b, count(*) filter (quality <> 1 and toxic = 0) as c from labels),
k as (select b, c, b + c as n, least(b, c) as m, unnest(range(least(b, c) + 1)) as k from t),
terms as (select *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) as x from k)
select b, c, case when n > 0 then round(2 * sum(x), 6) end as p, case when n > 0 then round(2 * sum(x) - sum(x) filter (k = m), 6) end as midp, case when n > 0 then round((b - c) * (b - c) / n, 6) end as chi2
from terms group by b, c, n"""

SIGNIFICANCE_BY_PLACE = MCNEMAR.replace("count(*) filter (quality = 1 and toxic <> 0)", "count(*) filter (x and not y)").replace("count(*) filter (quality <> 1 and toxic = 0)", "count(*) filter (not x and y)").replace(
    "from labels", "from (select p_size % 3 > 0 as x, (p_partkey + p_size) % 4 > 0 as y from part)"
)

SUMMARY = 'select sum(n_chars)::BIGINT as "sum", round(avg(n_chars), 6) as "mean", round(stddev_pop(n_chars), 6) as "std", quantile_cont(n_chars, 0.5) as "median", min(n_chars) as "min", max(n_chars) as "max" from documents'

WORD_TOKENIZE = f"""
with t as (select doc_id, {treebank.sql('text')} as t from documents)
select doc_id, len(t)::INT as n, md5(array_to_string(t, ' ')) as tokens from t"""

_PROBE = """'He said: "It''s ' || p_name || '," but can''t (or won''t) pay $' || p_size || '.50 -- not at 3:00 p.m. "Gimme ' || p_type || '...", ''tis gonna be No. 5? Mr. ' || p_brand || ' cannot go.'"""
TREEBANK = f"""
with t as (select p_partkey, {_PROBE} as s from part)
select p_partkey, array_to_string({treebank.sql('s')}, ' ') as tokens from t"""

LOWERCASE = r"""
with t as (select unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}_]+')) as w from documents), f as (select w, count(*) as n from t group by w)
select lower(w) as word, max(n) as value from f group by 1"""

POS_VARIANTS = """
with w as (select distinct string_split(p_name, ' ')[1] as w from part), f as (select lower(w) as f from w union select upper(w) from w union select upper(w[1]) || lower(w[2:]) from w)
select f || t as form from f, (values ('#NN'), ('#NP'), ('#JJ'), ('#VB')) v(t)"""

GOOD_TOKENS = f"""
with w as (select distinct unnest(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) as w from documents)
select count(*) as good from w where not regexp_matches(w, '^[,\\p{{Nd}}]+$') and lower(w) not in ('the', 'of', '1')"""

VECTOR_LOOKUP = """
with e as (select label::VARCHAR as word, vec_id as cid, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) as l from embeddings),
a as (select word, case when cid % 2 = 0 then cid else -cid end as cid from e)
select a.word, a.cid, round(coalesce(l, 0.0), 5) as length from a left join e using (word, cid)"""

#: Member i of word w (weight 1 / (i + 1)): w and w#NN have its vector; of new_w_station#NP one of three parts is known, of
#: w_(next) both of two (one for the last word), of abc_w_abc_xyzxyz one of four, and the last none.
POOLED_FALLBACK = """
with e as (select 'word' || vec_id as word, 'word' || (vec_id + 1) as next, embedding::DOUBLE[] as v from embeddings),
p as (
  select word, word as key, 1 / 2.0::DOUBLE + 1 / 3.0::DOUBLE + 1 / 4.0::DOUBLE / 3 + 1 / 5.0::DOUBLE / 2 + 1 / 6.0::DOUBLE / 4 as w from e
  union all select word, next, 1 / 5.0::DOUBLE / 2 from e),
x as (select p.word, w, unnest(v) as x, unnest(range(len(v)))::INT as dim from p join e on e.word = p.key)
select word, 1 as cid, dim, round(sum(w * x) / (1 / 2.0::DOUBLE + 1 / 3.0::DOUBLE + 1 / 4.0::DOUBLE + 1 / 5.0::DOUBLE + 1 / 6.0::DOUBLE + 1 / 7.0::DOUBLE), 5) + 0.0::DOUBLE as value from x group by word, dim"""

EGO_SUBSTRINGS = f"""
select ego, node, max(wq)::INT as wq from (
  select a as ego, b as node, wq from (
    select a, b, count(*) as wq from (select t[i] as a, t[i + 1] as b from (select t, unnest(range(1, len(t))) as i from (select regexp_extract_all(text, '{TOKEN}') as t from documents))) group by all)
  where wq >= 20 and {minimize('a')} <> {minimize('b')}
  union all select ego, node, 10000 from ({SUBSTRING_NODES})) group by all"""

_AT = MEMBER_SENSES.rindex("\nselect")
MEMBER_CLOSURE = f"""{MEMBER_SENSES[:_AT]}, found as ({MEMBER_SENSES[_AT:]})
select word, cid, count(*) filter (where not contains(sense, '?')) >= 5 as kept, count(*) filter (where not contains(sense, '?')) as left from found group by all"""

#: Tagged tokens made of the parts' names: adjective, noun (every second in the plural), of, and a type or a brand.
_TAGGED = """
tagged(sentence, place, form, lemma, tag) as (
  select p_partkey, 1, split_part(p_name, ' ', 1), split_part(p_name, ' ', 1), 'ADJ' from part
  union all select p_partkey, 2, split_part(p_name, ' ', 2) || case when p_size % 2 = 0 then 's' else '' end, split_part(p_name, ' ', 2), 'NOUN' from part
  union all select p_partkey, 3, 'of', 'of', 'ADP' from part
  union all select p_partkey, 4, case when p_size % 3 = 0 then p_brand else lower(p_type) end, case when p_size % 3 = 0 then p_brand else lower(p_type) end, case when p_size % 3 = 0 then 'PROPN' else 'NOUN' end from part),
terms(term) as (select distinct unnest([p_name, p_name || 's of ' || lower(p_type), split_part(p_name, ' ', 2) || ' of ' || p_brand, 'un' || p_name || 'els in ' || lower(p_type), p_type || ' ' || split_part(p_name, ' ', 1), 'Qqq ' || p_brand, p_brand || 'x ofs zz']) from part)"""
_KNOWN = """
counted as (select lower(form) as form, lower(lemma) as lemma, count(*) as n from tagged group by all),
known as (select form, lemma from (select *, row_number() over (partition by form order by n desc, lemma) as r from counted) where r = 1)"""
LEMMAS = f"""
with {_TAGGED}, {_KNOWN},
words as (select word, lower(word) as form from (select distinct unnest(list_concat(string_split(term, ' '), list_transform(string_split(term, ' '), lambda x: x || 's'))) as word from terms)),
shared as (select form, lemma, coalesce(list_max(list_filter(range(1, length(form) + 1), lambda i: form[:i] = lemma[:i])), 0) as k from known),
change as (select form, length(form) - k as cut, substr(lemma, k + 1) as add from shared),
each as (select right(form, s) as suffix, cut, add from (select *, unnest(range(1, least(length(form), 6) + 1)) as s from change) where s >= cut),
rule as (select suffix, cut, add from (select *, row_number() over (partition by suffix order by n desc, cut, add) as r from (select suffix, cut, add, count(*) as n from each group by all)) where r = 1),
fit as (select word, form[:length(form) - cut] || add as changed, row_number() over (partition by word order by length(suffix) desc) as r from (select word, form, right(form, s) as suffix from (select *, unnest(range(1, least(length(form), 6) + 1)) as s from words)) join rule using (suffix))
select word, coalesce(lemma, case when changed <> '' then changed end, form) as lemma, case when lemma is not null then 'known' when changed <> '' then 'suffix' else 'none' end as how
from words left join known using (form) left join (select word, changed from fit where r = 1) using (word)"""
_VITERBI = f"""
{_TAGGED},
totals as (select tag, count(*) as n from tagged group by all),
by_form as (select lower(form) as form, tag, count(*) as n from tagged group by all),
by_suffix as (select suffix, tag, sum(n) as n from (select right(form, s) as suffix, tag, n from (select *, unnest(range(0, least(length(form), 4) + 1)) as s from by_form)) group by all),
words as (select term, i - 1 as pl, w[i] as text, lower(w[i]) as form, len(w) as size from (select term, string_split(term, ' ') as w, unnest(range(1, len(string_split(term, ' ')) + 1)) as i from terms)),
unseen as (select distinct form from words where form not in (select form from by_form)),
longest as (select form, max_by(suffix, length(suffix)) as suffix from (select form, right(form, s) as suffix from (select *, unnest(range(0, least(length(form), 4) + 1)) as s from unseen)) where suffix in (select suffix from by_suffix) group by form),
emit as (select form, tag, round(1000 * ln(e.n / totals.n))::INT as score from (select form, tag, n from by_form union all select form, tag, n from longest join by_suffix using (suffix)) e join totals using (tag)),
pairs as (select a, b, count(*) as n from (select coalesce(lag(tag) over (partition by sentence order by place), '^') as a, tag as b from tagged) group by all),
grid as (select x.a, t.tag as b, coalesce(p.n, 0) as n from (select tag as a from totals union all select '^') x cross join totals t left join pairs p on p.a = x.a and p.b = t.tag),
step as (select a, b, round(1000 * ln((n + 1) / (sum(n) over (partition by a) + count(*) over (partition by a))))::INT as score from grid),
cand as (select term, pl, tag, score from words join emit using (form)),
walk as (
  select term, pl, tag, {{'score': c.score + s.score, 'path': ['^', tag]}} as best from cand c join step s on s.a = '^' and s.b = c.tag where pl = 0
  union all
  select c.term, c.pl, c.tag, max({{'score': w.best.score + s.score + c.score, 'path': list_append(w.best.path, c.tag)}}) from walk w join cand c on c.term = w.term and c.pl = w.pl + 1 join step s on s.a = w.tag and s.b = c.tag group by c.term, c.pl, c.tag),
final as (select term, max(best).path as path from walk join (select distinct term, size from words) using (term) where pl = size - 1 group by term),
analysed as (select term, pl, text, path[pl + 2] as pos, size from words join final using (term))"""
TERM_TAGS = f"""with recursive {_VITERBI} select term, pl::INT as "at", text, pos, pos = 'PROPN' as entity from analysed"""
_HEADS = """
heads as (
  select term, hyper, length(hyper) / length(term) as score from (
    select term, case when adp > 0 then string_agg(text, ' ' order by pl) filter (pl < adp) else max(text) filter (pl = size - 1) end as hyper,
      max(pos) filter (pl = case when adp > 0 then adp - 1 else size - 1 end) as pos, bool_or(pos = 'PROPN') as entity
    from (select *, coalesce(max(pl) filter (pos = 'ADP') over (partition by term), -1) as adp from analysed) group by term, adp)
  where length(term) > 6 and contains(term, ' ') and pos = 'NOUN' and not entity)"""
HEAD_HYPERNYMS = f"with recursive {_VITERBI}, {_HEADS} select term, hyper, round(score, 6) as score from heads"

SUBWORD_VECTORS = """
with n as (select count(*) as n from embeddings),
words as (select distinct unnest([p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || p_size, lower(p_type)]) as word from part),
known as (select word, min(p_partkey) % 7 as row from (select split_part(p_name, ' ', 1) as word, p_partkey from part) group by all),
grams as (select word, g from (select word, unnest(list_transform(range(3, 7), lambda k: substr(w, i, k))) as g, unnest(range(3, 7)) as k, i, w from (select word, '<' || word || '>' as w, unnest(range(1, length(word) + 3)) as i from words)) where i + k - 1 <= length(w)),
hashed as (select word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) as h from grams),
used as (select word, h % (n - 7) + 7 as vec_id from hashed, n union all select word, row from words join known using (word))
select word, len(v) as dims, round(list_sum(v), 5) + 0.0 as total, round(sqrt(list_inner_product(v, v)), 5) as length, word in (select word from known) as known from (
  select word, list(x order by d) as v from (select word, d, avg(x) as x from (select word, unnest(embedding)::DOUBLE as x, unnest(range(len(embedding))) as d from used join embeddings using (vec_id)) group by all) group by word)"""

PREDICTED = DISAMBIGUATE.replace("select vec_id as ctx_id, vec.word as target, coalesce(c.cid, p.cid, 0)::INT as cid, coalesce(c.score, round(p.prob, 6), 1.0) as score,\n  case when c.cid is not null then 'context' when p.cid is not null then 'prior' else 'none' end as how", "select vec_id as context_id, vec.word as target, coalesce(c.cid, p.cid, 0)::VARCHAR as predict_sense_ids") + " where vec_id in (select ctx_id from ctx)"
SWEEP = VECTOR_PAIRS.split("kept as")[0] + """ranked as (select src, dst, row_number() over (partition by src order by rank, dst) as r from near join sizes on synset = dst where size <= 8),
kept as (select c, src, dst from ranked, (values (1), (2)) t(c) where r <= c)
select distinct s.word as hypo, h.word as hyper, 'vector:' || substr(src, 2) as source, c::INT as synsets from kept join synsets h on h.synset = dst join synsets s on s.synset = 's' || substr(src, 2) where s.word <> h.word
union all select hypo, hyper, source, c::INT from (""" + LABEL_PAIRS + ") l, (values (1), (2)) t(c)"
_SENSES2 = SPARSE_POOLING[: SPARSE_POOLING.rindex("\nselect")] + ", sense as (" + SPARSE_POOLING[SPARSE_POOLING.rindex("\nselect") :] + ")"
SPARSE_SENSE_SIM = f"""{_SENSES2},
len as (select word, cid, sqrt(sum(score * score)) as n from sense group by all),
dots as (select a.word, sum(a.score * b.score) as dot from sense a join sense b on a.word = b.word and a.feature = b.feature where a.cid = 0 and b.cid = 1 group by all)
select w.word as w1, 0 as c1, w.word as w2, c.c2::INT as c2, round(case when c.c2 = 1 and x.n * y.n > 0 then coalesce(dot, 0) / (x.n * y.n) else 0 end, 6) as sim
from (select distinct word from sense) w cross join (values (1), (7)) c(c2) left join dots on dots.word = w.word left join len x on x.word = w.word and x.cid = 0 left join len y on y.word = w.word and y.cid = 1"""
SPARSE_MIX = f"""{_SENSES2},
known as (select word, feature, score / sqrt(sum(score * score) over (partition by word)) as score from sparse where word >= 'm'),
own as (select word, cid, feature, case when word in (select word from known) then 0.5 * score / sqrt(sum(score * score) over (partition by word, cid)) else score end as score from sense)
select word, cid, feature, round(sum(score), 6) as score from (
  select * from own union all select s.word, s.cid, k.feature, 0.5 * k.score from (select distinct word, cid from sense) s join known k using (word)) group by all"""
