"""Pieces of DuckDB SQL that the queries' SQL is built from."""

from __future__ import annotations

SEQ = """seqs as (select lang as species, doc_id as scaffold,
  regexp_replace(translate(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
    'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'A', 'g') as sequence from documents where length(text) > 0)"""

FEAT = """docs_ as (select doc_id, cast(length(text) as bigint) as n, max(doc_id) over () + 1 as c from documents),
l_ as (select l_orderkey as k, l_linenumber as ln, 3 * cast(l_quantity as bigint) + case when l_partkey % 10 = 0 then 1 else 0 end as len, 12 + l_suppkey % 60 as gap
  from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) as rn from lineitem) t where rn = 1),
f_ as (select k, ln, len, cast(coalesce(sum(len + gap) over (partition by k order by ln rows between unbounded preceding and 1 preceding), 0) as bigint) as rel,
  cast(sum(len + gap) over (partition by k) as bigint) as span from l_),
feats as (select d.doc_id as scaffold, concat('t', cast(f_.k as varchar)) as parent, case when o.o_orderstatus = 'F' then '-' else '+' end as strand,
  (f_.k * 37) % greatest(d.n - f_.span, 1) + f_.rel as start0, (f_.k * 37) % greatest(d.n - f_.span, 1) + f_.rel + f_.len - 1 as end0
  from f_ join orders o on o.o_orderkey = f_.k join docs_ d on f_.k % d.c = d.doc_id where d.n > f_.span + 5)"""

FRAG = """frag as (select *, row_number() over w - 1 as i, lead(start0) over w as next0, lag(end0) over w as prev_end,
  count(*) over (partition by scaffold, parent) as n from feats window w as (partition by scaffold, parent order by start0, end0)),
tr as (select scaffold, parent, min(strand) as strand, count(distinct strand) as strands, count(*) as n, cast(sum(end0 - start0 + 1) as bigint) as total,
  min(case when i = 0 then end0 - start0 + 1 end) as first_size, min(case when i = n - 1 then end0 - start0 + 1 end) as last_size,
  coalesce(bool_or(start0 - prev_end - 1 > 0 and start0 - prev_end - 1 < 20), false) as short_gap, coalesce(bool_or(start0 - prev_end - 1 < 20), false) as bad_gap from frag group by scaffold, parent)"""

PAINT = """sup as (select *, strands = 1 and strand = '+' and first_size >= 3 and last_size >= 3 and total % 3 = 0 and not short_gap as supported from tr),
paints as (select scaffold, start0 as a, end0 + 1 as b, case when supported then 1 else 3 end as region, supported, parent, 2 * i as k from frag join sup using (scaffold, parent)
  union all select scaffold, end0 + 1, next0, case when supported then 2 else 3 end, supported, parent, 2 * i + 1 from frag join sup using (scaffold, parent) where next0 > end0 + 1),
size_ as (select scaffold, length(sequence) as len_ from seqs),
top_ as (select scaffold, pos, arg_max(region, (supported::int, parent, k)) as region from (
  select p.scaffold, unnest(range(greatest(a, 0), least(b, len_))) as pos, region, supported, parent, k from paints p join size_ using (scaffold)) group by scaffold, pos),
base0 as (select species, scaffold, unnest(range(length(sequence))) as pos, unnest(string_split(sequence, '')) as base from seqs),
reg as (select species, scaffold, pos, base, coalesce(region, 0) as region from base0 left join top_ using (scaffold, pos))"""

# the closed form of labelling, then erasure of loci with illegal edges
LABEL = """r1 as (select *, lag(region) over w as p1, lead(region) over w as n1, lead(region, 2) over w as n2, lead(region, 3) over w as n3, lag(region, 2) over w as p2,
  sum(case when region in (0, 3) then 1 else 0 end) over w as cut from reg window w as (partition by scaffold order by pos)),
r2 as (select *, region in (1, 2) as inside, first_value(pos) over (partition by scaffold, cut, region in (1, 2) order by pos) as lstart,
  coalesce(sum(case when region = 1 then 1 else 0 end) over (partition by scaffold, cut, region in (1, 2) order by pos rows between unbounded preceding and 1 preceding), 0) as k from r1),
r3 as (select *, first_value(region = 1 and coalesce(n1, 0) = 1 and coalesce(n2, 0) = 1) over (partition by scaffold, cut, inside order by pos) as opens from r2),
r4 as (select *, case when opens then 3 else 0 end as skip,
  region = 1 and coalesce(n1, 0) = 1 and coalesce(n2, 0) = 1 and coalesce(n3, 0) in (0, 3) as s1 from r3),
r5 as (select *, case when not inside then 1
    when region = 1 and opens and pos < lstart + 3 then 2 + pos - lstart
    when region = 1 and s1 and pos >= lstart + skip then 17
    when region = 1 and coalesce(n1, 0) = 1 and coalesce(n2, 0) in (0, 3) and p1 = 1 and pos - 1 >= lstart + skip then 18
    when region = 1 and coalesce(n1, 0) in (0, 3) and p1 = 1 and p2 = 1 and pos - 2 >= lstart + skip then 19
    when region = 1 then 5 + (k - skip) % 3
    when p1 = 1 then 8 + (k - skip) % 3
    when n1 = 1 then 14 + (k - skip) % 3
    else 11 + (k - skip) % 3 end as raw from r4),
legal as (select unnest([0,0,1,1,1,2,3,4,4,5,5,6,6,7,7,7,8,9,10,11,11,12,12,13,13,14,15,16,17,18,19,19]) as f,
                 unnest([1,2,1,2,20,3,4,5,8,6,9,7,10,5,8,17,11,12,13,11,14,12,15,13,16,5,6,7,18,19,1,20]) as t),
r6 as (select *, lag(raw) over w as praw, lead(raw) over w as nraw from r5 window w as (partition by scaffold order by pos)),
r7 as (select r6.*, coalesce(praw is not null and a.f is null, false) or coalesce(nraw is not null and b.f is null, false) as bad,
  sum(case when raw = 1 then 1 else 0 end) over (partition by scaffold order by pos) as locus
  from r6 left join legal a on praw = a.f and raw = a.t left join legal b on raw = b.f and nraw = b.t),
lab as (select species, scaffold, pos, base, region, raw, case when raw <> 1 and not bool_or(bad and raw <> 1) over (partition by scaffold, locus) then raw else 1 end as state from r7)"""

# usable intervals: iv numbers the stretches without ignored bases; i counts from their start
USE = """use0 as (select *, sum(case when region = 3 then 1 else 0 end) over (partition by scaffold order by pos) as cutno from lab),
use as (select *, row_number() over (partition by scaffold, cutno order by pos) - 1 as i, lag(base) over w as b1, lag(state) over w as s1,
  lead(state) over w as nx, lag(base,5) over w || lag(base,4) over w || lag(base,3) over w || lag(base,2) over w || lag(base,1) over w as ctx5
  from use0 where region <> 3 window w as (partition by scaffold, cutno order by pos))"""

# predictions made from the labels: a third of the scaffolds exact, a third shifted by three bases, a third without genes in every fifth
PRED = """pg as (select scaffold, pos, state as gold, case when scaffold % 3 = 1 then coalesce(lag(state, 3) over (partition by scaffold order by pos), 1)
  when scaffold % 15 = 2 then 1 else state end as pred from lab)"""


def labelled(tail: str) -> str:
    return f"with {SEQ}, {FEAT}, {FRAG}, {PAINT}, {LABEL}, {tail}"


def usable(tail: str) -> str:
    return labelled(f"{USE}, {tail}" if not tail.lstrip().startswith("select") else f"{USE} {tail}")


def compared(tail: str) -> str:
    return labelled(f"{PRED}, {tail}" if not tail.lstrip().startswith("select") else f"{PRED} {tail}")
