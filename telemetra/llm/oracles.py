"""DuckDB SQL for the queries that SQL can express on whole tables, by brute force where the operators are not."""

from __future__ import annotations

from . import secrets

#: Components of the pairs p(x, y), given in both directions, over the ids n(id): id and the smallest id reachable.
_REACHED = "r(id, to_id) as (select id, id from n union select r.id, p.y from r join p on r.to_id = p.x), g as (select id, min(to_id) as component_id from r group by id)"

EMBEDDINGS = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
n as (select vec_id as id from v), {_REACHED}, k as (select x, count(*) as n_links from p group by x)
select id as vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, id = component_id as kept from g left join k on x = id"""

_WORDS = r"[^\x20\x09-\x0D]+"

DOCUMENTS = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)] end) as t from w),
z as (select doc_id, count(*) as z from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by all),
o as (select x, y from c join z a on a.doc_id = x join z b on b.doc_id = y where 100 * c >= 85 * (a.z + b.z - c)),
p as (select x, y from o union all select y, x from o), n as (select doc_id as id from documents), {_REACHED}
select id as doc_id, coalesce(z, 0)::bigint as n_shingles, component_id, id = component_id as kept from g left join z on z.doc_id = id"""

#: Windows of 50 words seen from each line forwards and backwards; those with an earlier copy lose their lines.
LINES = f"""with d as (select doc_id, text, str_split(text, chr(10)) as parts from documents where text is not null),
l as (select doc_id, k as line, len(regexp_extract_all(parts[k], '{_WORDS}')) as words, parts from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as k from d)),
u as (select doc_id, line, words, sum(words) over (partition by doc_id order by line) as upto from l),
first as (select doc_id, upto, min(line) as line from u group by all), last as (select doc_id, upto - words as below, max(line) as line from u group by all),
w as (select u.doc_id, u.line as s, f.line as e from u asof join first f on u.doc_id = f.doc_id and f.upto >= u.upto - u.words + 50
  union select u.doc_id, b.line, u.line from u asof join last b on u.doc_id = b.doc_id and b.below <= u.upto - 50),
c as (select w.doc_id, s, e, md5(array_to_string(parts[s:e], chr(10))) as said from w join d on w.doc_id = d.doc_id),
later as (select doc_id, s, e from c qualify row_number() over (partition by said order by doc_id, s) > 1),
gone as (select doc_id, list(distinct line) as gone from (select doc_id, unnest(range(s, e + 1)) as line from later) group by doc_id)
select documents.doc_id, coalesce(len(parts), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
case when gone is null then documents.text else array_to_string([parts[k] for k in range(1, len(parts) + 1) if not list_contains(gone, k)], chr(10)) end as text
from documents left join d on documents.doc_id = d.doc_id left join gone on gone.doc_id = documents.doc_id"""

#: Scores of every document that shares a term with an item, in whole numbers but for the logarithm.
SEARCH = r"""with d as (select doc_id, row_number() over (order by doc_id) as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null),
i as (select item_id, row_number() over (order by item_id) as q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
iq as (select item_id, q, term, count(*) as times from i group by all),
z as (select count(*)::bigint as n, sum(len(t))::bigint as l from d where len(t) > 0),
tf as (select doc_id, r, term, count(*)::bigint as tf, any_value(k)::bigint as k from (select doc_id, r, len(t) as k, unnest(t) as term from d) group by doc_id, r, term),
w as (select term, floor(1000 * ln((2 * (select n from z) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf group by term),
s as (select iq.item_id, iq.q, tf.doc_id, tf.r, sum(iq.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.k * z.n) // z.l))))::bigint as score from iq join tf on iq.term = tf.term join w on w.term = tf.term cross join z group by all),
o as (select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id, r) as rank from s where score > 0)
select item_id, rank, doc_id, score from o where rank <= 20"""


def clusters_sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """K-means in whole numbers, a few CTEs a round; every vector is compared with every centroid."""
    apart = f"list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) for i in range(1, {dim + 1})])::bigint"
    steps = [f"""v as materialized (select vec_id, row_number() over (order by vec_id) as r, [floor(1024 * x)::bigint for x in e] as v from (select vec_id, embedding::double[] as e from embeddings) where len(e) = {dim} and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by h, r) - 1 as k, v as c from (select *, sha256('{seed}:' || vec_id) as h from v) order by h, r limit {k})"""]
    for n in range(rounds + 1):
        steps.append(f"a{n} as materialized (select r, arg_min(k, (d, k)) as k, min(d) as d from (select v.r, c.k, {apart} as d from v, c{n} c) group by r)")
        if n < rounds:
            sums = f"select a.k, i, sum(v.v[i])::hugeint as s, count(*)::hugeint as n from a{n} a join v on v.r = a.r, range(1, {dim + 1}) g(i) group by all"
            steps.append(f"c{n + 1} as materialized (select c.k, coalesce(m.c, c.c) as c from c{n} c left join (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from ({sums}) group by k) m on m.k = c.k)")
    last = f"select v.vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from a{rounds} a join v on v.r = a.r join c{rounds} c on c.k = a.k"
    return f"with {', '.join(steps)} {last}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PATTERNS = ", ".join(f"({_quoted(kind)}, {order}, {_quoted(pattern)})" for order, (kind, pattern) in enumerate([("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX), ("model", secrets.KEY_LIKE)]))

#: Spans by what lies between matches; both Markov models and the ratio of each candidate, from counts of pairs.
SECRETS = f"""with d as (select doc_id, coalesce(text, '') as text from documents),
k as (select doc_id, kind, ord, regexp_extract_all(text, p) as v, [length(x) for x in regexp_split_to_array(text, p)] as g from d, (values {_PATTERNS}) as t(kind, ord, p)),
s as (select doc_id, kind, ord, v[i] as val, (list_sum(g[1:i]) + coalesce(list_sum([length(x) for x in v[1:i - 1]]), 0))::bigint as a from (select *, unnest(range(1, len(v) + 1)) as i from k)),
found as (select *, a + length(val) as z, regexp_replace(val, {_quoted(secrets.ASSIGN_HEAD)}, '') as own from s),
base as (select * from found where ord < 3 and (kind <> 'assign' or length(own) >= 12)),
labelled as (select doc_id, case when kind = 'assign' then own else val end as val, kind from base),
tokens as (select doc_id, unnest(regexp_extract_all(text, {_quoted(secrets.IDENTIFIER)})) as t from d),
plain as (select t from tokens x where (length(t) < 16 or not regexp_matches(t, '[0-9]')) and not exists (select 1 from labelled l where l.doc_id = x.doc_id and contains(x.t, l.val))),
pairs as (select 1 as m, val[i] as a, val[i + 1] as b from (select val, unnest(range(1, length(val))) as i from labelled where kind <> 'hex') union all select 0, t[i], t[i + 1] from (select t, unnest(range(1, length(t))) as i from plain)),
c as (select unnest(str_split('{secrets.ALPHABET}', '')) as c), n as (select m, a, b, count(*) as n from pairs semi join c on pairs.a = c.c where b in (select c from c) group by all),
r as (select m, a, sum(n) as n from n group by all), u as (select m, b, sum(n) / (select sum(n) from n y where y.m = n.m) as u from n group by m, b),
q as (select t.m, x.c as a, y.c as b, mix / {len(secrets.ALPHABET)} + (1 - mix) * (coalesce(n.n, 0) + {secrets.BACK_OFF} * coalesce(u.u, 0)) / (coalesce(r.n, 0) + {secrets.BACK_OFF}) as p
  from (values (0, {secrets.MIX_PLAIN}), (1, {secrets.MIX_RANDOM})) as t(m, mix), c x, c y left join n on n.m = t.m and n.a = x.c and n.b = y.c left join r on r.m = t.m and r.a = x.c left join u on u.m = t.m and u.b = y.c),
w as (select g.a, g.b, round(ln(g.p / h.p), 5) as w from q g join q h on g.a = h.a and g.b = h.b and g.m = 1 and h.m = 0),
free as (select * from found f where ord = 3 and exists (select 1 from n where m = 1) and not exists (select 1 from base b where b.doc_id = f.doc_id and f.a < b.z and b.a < f.z)),
told as (select doc_id, f.a, z, sum(w) / (length(any_value(val)) - 1) as llr from (select doc_id, a, z, val, unnest(range(1, length(val))) as i from free) f join w on w.a = f.val[i] and w.b = f.val[i + 1] group by doc_id, f.a, z),
spans as (select doc_id, kind, ord, a, z from base union all select doc_id, 'model', 3, a, z from told where llr >= {secrets.MARGIN})
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by a, ord) filter (ord < 3), '')) as base_sha256, coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by a, ord), '') as spans
from d left join spans on spans.doc_id = d.doc_id group by d.doc_id"""

ORACLES: dict[str, str] = {
    "op5_line_dedup": LINES,
    "op6_embedding_near_dedup": EMBEDDINGS,
    "op7_secret_scans": SECRETS,
    "op10_minhash_near_dedup": DOCUMENTS,
    "op11_ranked_search": SEARCH,
    "op12_centroid_clustering": clusters_sql(),
}
