"""SQL for those operators' queries that SQL can express on whole tables of the smaller sizes."""

from __future__ import annotations

# Written out here, so that a wrong pattern or bound in the operator shows.
_SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
_EXAMPLES = r"(?i)example|changeme|placeholder|dummy|your[_-]|xxxx|0123456789|1234567890|abcdefgh"

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
s as (select doc_id, i, md5(substr(x, cast(2 * i + 1 as bigint), 200)) k from (select doc_id, x, unnest(range(0, length(x) // 2 - 99)) i from d where length(x) >= 200)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) n from s) where n > 1),
e as (select doc_id, i, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) p from r),
g as (select doc_id, i, sum(case when p is null or i > p then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) g from e),
sp as (select doc_id, min(i) a, max(i) + 100 b from g group by doc_id, g),
q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) l from sp),
k as (select q.doc_id, string_agg(substr(x, cast(2 * l + 1 as bigint), cast(2 * (a - l) as bigint)), '' order by a) || substr(any_value(x), cast(2 * max(b) + 1 as bigint)) h, sum(b - a) gone, count(*) n
      from q join d on q.doc_id = d.doc_id group by q.doc_id)
select d.doc_id, cast(length(x) // 2 as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed, coalesce(n, 0) n_spans, sha256(unhex(coalesce(h, x))) kept_sha256
from d left join k on d.doc_id = k.doc_id
"""

OP4_SQL = f"""
with it as (select distinct item_id, {_WORDS.format("coalesce(text, '')")} w from benchmark),
iw as (select distinct item_id, least(len(w), 10) n, list_slice(w, s, s + least(len(w), 10) - 1) l, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') k
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s from it where len(w) > 0)),
d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
dw as (select doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') k
       from (select doc_id, w, unnest(range(1, len(w) + 1)) p from d), (select distinct n from iw) where p + n - 1 <= len(w)),
m as (select distinct doc_id, item_id, p, dw.n from dw join iw on dw.n = iw.n and dw.k = iw.k),
h as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from m) group by 1),
i as (select doc_id, count(*) n_items, string_agg(t, ',' order by t) s from (select distinct doc_id, cast(item_id as varchar) t from m) group by 1),
wc as (select k, n, x, count(*) c from (select distinct k, n, l from iw), unnest(l) u(x) group by all),
wk as (select k, n, count(*) kinds from wc group by all),
t as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from d),
tc as (select doc_id, x, count(*) c from t where x in (select x from wc) group by all),
cd as (select wc.k, tc.doc_id from wc join wk on wk.k = wc.k join tc on tc.x = wc.x and tc.c >= wc.c group by wc.k, tc.doc_id, kinds having count(*) = kinds),
tp as (select cd.k, cd.doc_id, t.p, t.x, wc.n, wc.c from cd join wc on wc.k = cd.k join t on t.doc_id = cd.doc_id and t.x = wc.x),
sp as (select a.k, a.doc_id, a.p, b.x from (select distinct k, doc_id, p, n from tp) a join tp b on a.k = b.k and a.doc_id = b.doc_id and b.p >= a.p and b.p < a.p + a.n + 5 group by a.k, a.doc_id, a.p, b.x, b.c having count(*) >= b.c),
nk as (select distinct k, doc_id from (select sp.k, doc_id, p from sp join wk on wk.k = sp.k group by sp.k, doc_id, p, kinds having count(*) = kinds)),
nr as (select doc_id, count(*) n_near, string_agg(t, ',' order by t) s from (select distinct nk.doc_id, cast(item_id as varchar) t from nk join iw on iw.k = nk.k
       except select doc_id, cast(item_id as varchar) from m) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(i.s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
  coalesce(n_near, 0) n_near, sha256(coalesce(nr.s, '')) near_sha256
from d left join h on d.doc_id = h.doc_id left join i on d.doc_id = i.doc_id left join nr on d.doc_id = nr.doc_id
"""


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, lang, {rank} k, '{kind}' kind, v, b, b + length(h) e from (
      select doc_id, source, lang, h, v, length(gap) + sum(length(gap) + length(h)) over (partition by doc_id order by i) - length(gap) - length(h) b from (
        select doc_id, source, lang, unnest(list_slice(string_split_regex(t, '{p}'), 1, len(hs))) gap, unnest(hs) h, unnest(regexp_extract_all(t, '{p}', {group})) v, generate_subscripts(hs, 1) i
        from (select doc_id, source, lang, text t, regexp_extract_all(text, '{p}', 0) hs from documents where text is not null))) where length(v) >= {least}"""


OP6_SQL = f"""
with s as ({" union all ".join(_kind_sql(k, *x) for k, x in enumerate(_SECRETS))}),
o as (select v, count(distinct coalesce(source, '')) owners, count(distinct (source, lang)) repositories from s group by 1),
j as (select s.*, case when owners >= 3 or repositories >= 5 or regexp_matches(s.v, '{_EXAMPLES}') then 'example'
      when len(list_distinct(string_split(s.v, ''))) >= 8 then 'live' else 'weak' end verdict from s join o on s.v = o.v),
a as (select doc_id, kind, k, b, e from s union all select distinct doc_id, verdict, case verdict when 'live' then 3 when 'example' then 4 else 5 end, b, e from j),
t as (select doc_id, count(*) filter (where kind = 'assign') n_assign, count(*) filter (where kind = 'access') n_access, count(*) filter (where kind = 'hex') n_hex,
      string_agg(kind || ':' || cast(cast(b as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar), ',' order by b, k) filter (where k < 3) base,
      string_agg(kind || ':' || cast(cast(b as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar), ',' order by b, k) spans from a group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from documents d left join t on d.doc_id = t.doc_id
"""

OP8_SQL = r"""
with base as (
  select page_id, md5(coalesce(html, '')) digest, cast(strlen(html) as bigint) len, regexp_replace(trim(url), '#.*$', '') u from pages
), parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/(index\.html?)?$', '') path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') q from base
), named as (
  select page_id, digest, len, case when host <> '' then host || path || case when q <> '' then '?' || q else '' end end k,
    '"' || digest || '"' tag, 'day ' || cast(page_id % 365 as varchar) d from parts
), asked as (
  select page_id * 2 + 1 record_id, k, page_id * 2 + 5 ts, case when page_id % 7 = 0 then '"foreign"' when page_id % 3 = 0 then null else tag end tag, d from named
), met as (
  select a.*, r.page_id * 2 response_id, r.tag rtag, r.d rd, r.digest, r.len
  from asked a asof left join named r on a.k = r.k and a.ts > r.page_id * 2
), judged as (
  select *, case when response_id is null then 'none'
    when tag is not null then case when tag = rtag then 'resolved' else 'mismatch' end
    when d = rd then 'resolved' else 'mismatch' end verdict from met
)
select record_id, k as key, case when verdict = 'resolved' then response_id end response_id, verdict,
  case when verdict = 'resolved' then 'cache-control=max-age=600;content-length=' || cast(len as varchar) || ';etag=' || rtag || ';last-modified=' || d end headers,
  case when verdict = 'resolved' then digest end digest, case when verdict = 'resolved' then len end length
from judged
"""

OP10_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
), n as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) s from v
), l as (
  select a.vec_id a, b.vec_id b from n a, n b where a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9
), r as (
  select vec_id, vec_id c from v union select l.b, r.c from r join l on l.a = r.vec_id
), k as (select a, count(*) n_links from l group by 1)
select r.vec_id, coalesce(any_value(n_links), 0) n_links, min(c) component_id, r.vec_id = min(c) kept from r left join k on k.a = r.vec_id group by r.vec_id
"""
