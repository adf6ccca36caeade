"""SQL for the flow engine's queries over the star schema, in one dialect (recursive CTEs, list functions)."""

from __future__ import annotations

_BASE = """
with recursive raw as (select l_suppkey as a, l_linestatus as st, lead(l_suppkey) over w as b, lead(l_suppkey, 2) over w as c
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_linestatus)),
near as (select least(a, b) as lo, greatest(a, b) as hi, count(*) as n, count(*) filter (where a > b) as back, count(*) filter (where st = 'O') as open
  from raw where b is not null group by 1, 2),
apart as (select least(a, c) as lo, greatest(a, c) as hi, count(*) as n from raw where a <> c group by 1, 2),
forth as (select lo, hi, n, open, row_number() over (partition by lo order by n desc, hi) as up, row_number() over (partition by hi order by n desc, lo) as down from near),
turned as (select lo, hi, n, open, row_number() over (partition by n_regionkey order by back desc, hi, lo) as rank
  from near join supplier on s_suppkey = hi join nation on n_nationkey = s_nationkey where back > 0),
both_first as (select lo, hi, row_number() over (partition by lo order by n desc, hi) as x, row_number() over (partition by hi order by n desc, lo) as y from apart),
er as (select 'S' || src as src, 'S' || dst as dst, 'metadata' as provenance, source_dataset, case when 2 * open >= n then 'Production' else 'DISASTER RECOVERY/BCP' end as environment,
    'Depends on' as rel_type, '' as signal
  from (select lo as src, hi as dst, n, open, case when up = 1 then 'DS1' else 'DS2' end as source_dataset from forth where up = 1 or (up <= 3 and down <= 2) union all select hi, lo, n, open, 'DS3' from turned where rank = 1)
  union all select 'S' || lo, 'S' || hi, 'inferred', 'DS5', '', '', 'DS5_survey_upstream' from both_first where x = 1 and y = 1),
n0 as (select s_suppkey as k, 'S' || s_suppkey as id, s_suppkey % 7 <> 0 as in_bam, s_suppkey % 7 <> 0 and s_suppkey % 5 <> 0 as pci_flag,
    s_suppkey % 11 = 0 and s_suppkey % 7 <> 0 as carries_pan, s_suppkey % 11 = 0 and s_suppkey % 7 <> 0 and s_suppkey % 44 = 0 as detokenizes,
    s_suppkey % 13 = 4 as observed, s_name as app_name, case when s_suppkey % 7 <> 0 then n_name else '' end as line_of_business,
    case when s_suppkey % 7 <> 0 then r_name else '' end as business_group
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
n as (select *, carries_pan and k % 2 = 0 as pan_store, carries_pan and k % 2 = 1 as pan_process, carries_pan and k % 3 = 0 as pan_in_logs,
    in_bam and not carries_pan and k % 17 = 0 as crn_only,
    greatest(case when carries_pan then 4 when pci_flag then 3 else 0 end, case when observed then 2 else 0 end) as tier from n0),
e as (select distinct src, dst from er),
c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src),
cc as (select * from c where src <> dst),
s as (select id from n where carries_pan or observed),
o as (select id from s where not exists (select 1 from cc join s p on p.id = cc.src where cc.dst = s.id
    and not exists (select 1 from cc z where z.src = s.id and z.dst = cc.src)) union select id from n where detokenizes),
scope as (select id from s union select dst from cc join s on s.id = cc.src),
em as (select distinct src, dst from er where provenance = 'metadata'),
cm as (select src, dst from em union select cm.src, em.dst from cm join em on cm.dst = em.src),
conf as (select id from n where carries_pan and not observed union select dst from cm join n on n.id = cm.src and carries_pan and not observed),
above as (select src as origin, dst as id from cc join o on o.id = cc.src union all select id, id from o),
oc as (select id, count(*) as origin_count from above group by id),
solo as (select origin as id, count(*) as solo from above where origin <> id and id in (select id from oc where origin_count = 1) group by origin),
reach as (select src as id, count(*) as reach from cc group by src),
od as (select src as id, count(*) as out_degree from e group by src),
idg as (select dst as id, count(*) as in_degree from e group by dst),
scc as (select id, coalesce(least(id, (select min(x.dst) from c x where x.src = n.id and exists (select 1 from c y where y.src = x.dst and y.dst = x.src))), id) as scc from n)
"""
_BFS = """
lv as (select src, dst, 1 as d from e where src <> dst union select lv.src, e.dst, lv.d + 1 from lv join e on lv.dst = e.src and lv.src <> e.dst where lv.d < (select count(*) from n)),
bfs as (select src, dst, min(d) as d from lv group by src, dst),
"""
_SIGMA = """
sg as (select src, dst, 1 as d, cast(1 as double) as w from e where src <> dst
  union all (select q.src, q.dst, q.d, sum(q.w) from (select sg.src, e.dst, sg.d + 1 as d, sg.w from sg join e on sg.dst = e.src join bfs on bfs.src = sg.src and bfs.dst = e.dst and bfs.d = sg.d + 1) q group by 1, 2, 3)),
sig as (select src, dst, d, sum(w) as w from sg group by src, dst, d),
bt as (select a.dst as id, sum(a.w * b.w / t.w) as b from sig a join sig b on a.dst = b.src join sig t on t.src = a.src and t.dst = b.dst and t.d = a.d + b.d where a.src <> b.dst group by a.dst),
"""
_FACTS = """
f0 as (select n.*, coalesce(reach, 0) as reach, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree, coalesce(b, 0) as b,
    n.id in (select id from o) as is_origin, n.id in (select id from scope) as in_scope, n.id in (select id from conf) and n.id in (select id from scope) as confirmed,
    coalesce(origin_count, 0) as origin_count, coalesce(solo, 0) as solo, carries_pan or observed as is_source, observed and not pci_flag as hidden
  from n left join reach using (id) left join od using (id) left join idg using (id) left join bt using (id) left join oc using (id) left join solo using (id)),
f1 as (select *, reach / greatest(max(reach) over (), 1) as reach_norm, b / greatest(max(b) over (), 1e-9) as b_norm,
    case when in_degree = 0 and is_source then 1.0::double else 0.0::double end as source_flag,
    case when in_scope then 'cde' when exists (select 1 from e join scope on scope.id = e.dst where e.src = f0.id) then 'connected' else 'out' end as category,
    case when trim(line_of_business) = '' then '(not recorded in BAM)' else line_of_business end as lob from f0),
f as (select *, round_even(100 * (0.4 * tier / 4 + 0.3 * reach_norm + 0.2 * b_norm + 0.1 * source_flag)::double, 2) as risk from f1),
fam as (select id, category, unnest(list_filter([case when pan_store then 'req3' end, case when pan_process or detokenizes then 'req4' end, 'req7_8',
    case when pan_in_logs or observed or carries_pan then 'req10' end, 'req11'], lambda x: x is not null)) as family from f where category <> 'out'),
se as (select e.* from e where src in (select id from scope) and dst in (select id from scope)),
"""
GRAPH = _BASE.rstrip()
FULL = GRAPH + "," + (_BFS + _SIGMA + _FACTS).rstrip().rstrip(",")
