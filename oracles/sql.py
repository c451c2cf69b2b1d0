"""SQL twins of the registered queries for an independent engine.

Written from the operator definitions in long form (one row per grid point), not from the Spark plans.
"""

from __future__ import annotations


import numpy as np

ORACLES: dict[str, str] = {}


def r6(x: str, name: str | None = None, digits: int = 6) -> str:
    out = f"(round(({x})::double,{digits})+0e0)"
    return out + f" as {name or x}"


# --- measurement views -------------------------------------------------------------------------

BASE = """
m as (
 select m measurement_id, 'P'||lpad(p::varchar,4,'0') "patientId",
  'P'||lpad(p::varchar,4,'0')||case when m%6<3 then '_Left' else '_Right' end "specimenId",
  case when m%6<3 then 'Left' else 'Right' end side,
  case when m%17=16 then 'P4_R' else 'P'||(m%3+1)::varchar end "position",
  case sp*5%7 when 0 then 'BENIGN' when 1 then 'NORMAL' when 2 then 'CANCER' when 3 then 'ATYPICAL'
   when 4 then 'PRE_CANCEROUS' when 5 then 'BENIGN' else 'NA' end specimen_status,
  (p%11<>10) and (m%6<3 or p%5=0) biopsy,
  case when p%13=12 then null else (35+p%40)::double end age,
  case when m%29=28 then null else (40+m%31)::double end sample_thickness_mm,
  case when m%37=36 then 5e1 when p<40 then 4e1 else 1e1 end calibrant_thickness_mm,
  case when m%41=40 then 2e1 else 25e0 end poni_q_max_nm_inv,
  cast(date '2025-02-06' + cast(p as integer) as date) started_on,
  case when p%9=8 then null else 'cal_'||(p//4)::varchar end linked_agbh_session_uid,
  list_transform(range(0,64), lambda i: 2e0+cast(i as double)/3e0) q_range,
  list_transform(embedding, lambda x: 3e0+4e0*cast(x as double)) radial_profile_data
 from (select vec_id m, vec_id//6 p, vec_id//3 sp, embedding from embeddings)
),
lab as (
 select *, case when specimen_status in ('CANCER','ATYPICAL','PRE_CANCEROUS') then 'CANCER'
   when specimen_status in ('BENIGN','NORMAL') then 'BENIGN' end product_status_group from m
),
qc as (
 select * from lab where "position" in ('P1','P2','P3') and sample_thickness_mm > 0
  and calibrant_thickness_mm between 2 and 40 and poni_q_max_nm_inv >= 23
),
kept as (
 select * from qc where case when linked_agbh_session_uid is null
   then started_on not in (date '2025-02-14', date '2025-03-04')
   else linked_agbh_session_uid not in ('cal_1','cal_5','cal_9') end
),
cohort as (
 select * from kept where "patientId" in (select "patientId" from kept where biopsy)
  and product_status_group is not null
),
rawpts as (
 select measurement_id, "patientId" pid, upper(side) sn, unnest(range(0,64)) i,
  unnest(q_range) q, unnest(radial_profile_data) y from m
),
band as (select measurement_id, median(y) b from rawpts where q between 66e-1 and 74e-1 group by 1),
npts as (
 select r.measurement_id, pid, sn, i, q, y/b y from rawpts r join band using (measurement_id)
 where measurement_id in (select measurement_id from cohort)
),
gate as (
 select measurement_id, arg_min(y, abs(q-14)) v, arg_min(q, abs(q-14)) nq, min(abs(q-14)) d from npts group by 1
),
g as (select c.*, gate.v from cohort c join gate using (measurement_id) where gate.v > 8e-1),
gpts as (select n.* from npts n join g using (measurement_id)),
sides as (
 select "patientId" pid, upper(side) sn, count(*) n, max(case when biopsy then (product_status_group='CANCER')::int end) lab
 from g group by 1,2
),
cases as (
 select t.pid||'::'||t.sn target_case_id, t.pid, t.sn, o.sn osn, t.lab label, t.n tn, coalesce(o.n,0) cn
 from sides t left join sides o on o.pid=t.pid and o.sn<>t.sn where t.lab is not null
),
rowp as (select measurement_id, "patientId" pid, upper(side) sn, biopsy, least(greatest(v/3e0,1e-2),99e-2) p from g),
ev as (
 select pid, sn, avg(p) pm, 1/(1+exp(-avg(ln(p/(1-p))))) la, count(*) n from rowp where biopsy group by 1,2
),
roll as (
 select "patientId" pid, count(distinct "specimenId") specimens, count(*) measurements,
  coalesce(median(age),0e0) age, (max(age) is not null)::int age_available from g group by 1
),
"""


def hat(window: int = 11, order: int = 3) -> str:
    """Smoothing weights from the normal equations of a polynomial fit, as VALUES."""
    x = np.arange(window) - window // 2
    a = np.array([[float(v) ** k for k in range(order + 1)] for v in x])
    h = a @ np.linalg.solve(a.T @ a, a.T)
    return ",".join(f"({r},{c},{float(h[r, c])!r}::double)" for r in range(window) for c in range(window))


def smoothed(name: str, src: str, lo: float, hi: float) -> str:
    """CTEs: ``name`` holds smoothed points (k from 0) of ``src`` inside [lo, hi]."""
    return f"""
{name}_in as (
 select *, row_number() over (partition by measurement_id order by q)-1 k, count(*) over (partition by measurement_id) n
 from {src} where q between {lo!r} and {hi!r}
),
{name} as (
 select a.measurement_id, a.pid, a.sn, a.k, a.q, sum(h.w*b.y) y
 from {name}_in a
 join hat h on h.r = a.k - least(greatest(a.k-5,0), a.n-11)
 join {name}_in b on b.measurement_id=a.measurement_id and b.k = least(greatest(a.k-5,0), a.n-11) + h.c
 group by all
),
"""


def normed(name: str, src: str) -> str:
    """Older normalisation of the smoothed points."""
    return f"""
{name}_b as (
 select measurement_id, count(*) filter (where q between 645e-2 and 695e-2) near,
  quantile_cont(y, 0.05) filter (where q between 645e-2 and 695e-2) b1, quantile_cont(y, 0.05) b2
 from {src} group by 1
),
{name} as (
 select measurement_id, pid, sn, k, q, y/(case when abs(x) < 1e-12 then 1e0 else x end) y
 from {src} join (select measurement_id, case when near>=2 then b1 else b2 end x from {name}_b) using (measurement_id)
),
"""


def pair_ctes(roi: tuple[float, float], mask1: tuple[float, float], legacy: bool = False) -> str:
    s1, sf = ("z1", "zf") if legacy else ("s1", "sf")
    extra = normed("z1", "s1") + normed("zf", "sf") if legacy else ""
    gate_few = "false" if legacy else "(tn<2 or cn<2)"
    return f"""
hat(r,c,w) as (values {hat()}),
{smoothed("s1", "gpts", *roi)}
{smoothed("sf", "gpts", 2.0, 23.0)}
{extra}
mu as (select pid, sn, k, any_value(q) q, avg(y) mu, coalesce(stddev_samp(y),0e0) sd from {s1} group by 1,2,3),
muf as (select pid, sn, k, any_value(q) q, avg(y) mu from {sf} group by 1,2,3),
mur as (select pid, sn, i, avg(y) mu from gpts group by 1,2,3),
pk as (
 select pid, sn, avg(p) peak from (
  select measurement_id, pid, sn, max(y) p from gpts where q between 13e0 and 148e-1 group by 1,2,3 having count(*)>=3)
 group by 1,2
),
nrm as (select measurement_id, sqrt(sum(y*y)) nn from gpts group by 1),
cosp as (
 select a.pid, a.sn, a.measurement_id ma, b.measurement_id mb, 1-least(greatest(sum(a.y*b.y)/(any_value(na.nn)*any_value(nb.nn)),-1e0),1e0) d
 from gpts a join gpts b on a.pid=b.pid and a.sn=b.sn and a.i=b.i and a.measurement_id<b.measurement_id
 join nrm na on na.measurement_id=a.measurement_id join nrm nb on nb.measurement_id=b.measurement_id
 group by 1,2,3,4
),
wc as (select pid, sn, avg(d) w, count(*) pairs from cosp group by 1,2),
pp as (
 select c.target_case_id, t.k, t.q, t.mu a, o.mu b, t.mu-o.mu d, t.sd st, o.sd sc, t.sd*t.sd+o.sd*o.sd v
 from cases c join mu t on t.pid=c.pid and t.sn=c.sn join mu o on o.pid=c.pid and o.sn=c.osn and o.k=t.k
),
msk as (
 select *, 1 k_ from pp where q between {mask1[0]!r} and {mask1[1]!r}
 union all select *, 2 from pp where q between 15.0 and 23.0
),
fl as (select target_case_id, k_, quantile_cont(v,0.05)+1e-12 f from msk group by 1,2),
mf as (
 select target_case_id, k_, sqrt(avg(d*d)) rms, sqrt(sum(d*d/greatest(v,f))/sum(1/greatest(v,f))) wrms,
  sqrt(avg(st*st)) sst, sqrt(avg(sc*sc)) ssc, sqrt(sum(d*d/(v+1e-12))) maha
 from msk join fl using (target_case_id,k_) group by 1,2
),
p14 as (
 select target_case_id, abs(max(a)-max(b)) d from pp where q between 135e-1 and 145e-1 group by 1 having count(*)>=3
),
pf as (
 select c.target_case_id, t.k, t.q, t.mu a, o.mu b
 from cases c join muf t on t.pid=c.pid and t.sn=c.sn join muf o on o.pid=c.pid and o.sn=c.osn and o.k=t.k
),
was as (
 select src, target_case_id, sum(abs(ca-cb)*(nq-q)) w from (
  select src, target_case_id, q, lead(q) over w nq, sum(a/ta) over w ca, sum(b/tb) over w cb from (
   select src, target_case_id, q, greatest(a,0) a, greatest(b,0) b,
    sum(greatest(a,0)) over (partition by src,target_case_id) ta, sum(greatest(b,0)) over (partition by src,target_case_id) tb
   from (select 1 src, target_case_id, q, a, b from pp union all select 2, target_case_id, q, a, b from pf))
  window w as (partition by src, target_case_id order by q rows between unbounded preceding and current row))
 where nq is not null group by 1,2
),
cf as (
 select target_case_id, 1-least(greatest(sum(a*b)/sqrt(sum(a*a)*sum(b*b)),-1e0),1e0) d from pf group by 1
),
btw as (
 select c.target_case_id, 1-least(greatest(sum(t.mu*o.mu)/sqrt(sum(t.mu*t.mu)*sum(o.mu*o.mu)),-1e0),1e0) d
 from cases c join mur t on t.pid=c.pid and t.sn=c.sn join mur o on o.pid=c.pid and o.sn=c.osn and o.i=t.i group by 1
),
raw as (
 select c.*, a.rms r1, a.wrms w1, a.sst st1, a.ssc sc1, a.maha h1, b.rms r2, b.wrms w2, b.sst st2, b.ssc sc2, b.maha h2,
  p14.d p14, abs(pt.peak-po.peak) mp, wa.w wmu, cf.d cfd, wb.w wfull, wt.w wit, wo.w wio, btw.d btw
 from cases c
 left join mf a on a.target_case_id=c.target_case_id and a.k_=1 left join mf b on b.target_case_id=c.target_case_id and b.k_=2
 left join p14 on p14.target_case_id=c.target_case_id
 left join pk pt on pt.pid=c.pid and pt.sn=c.sn left join pk po on po.pid=c.pid and po.sn=c.osn
 left join was wa on wa.target_case_id=c.target_case_id and wa.src=1
 left join was wb on wb.target_case_id=c.target_case_id and wb.src=2
 left join cf on cf.target_case_id=c.target_case_id left join btw on btw.target_case_id=c.target_case_id
 left join wc wt on wt.pid=c.pid and wt.sn=c.sn left join wc wo on wo.pid=c.pid and wo.sn=c.osn
),
ft as (
 select *, reason='' ok,
  coalesce((wit+wio)/2, wit, wio, 0e0) within_mean from (
  select *, case when cn=0 then 'contralateral_breast_unavailable'
   when {gate_few} then 'fewer_than_2_valid_measurements_per_breast'
   when wfull is null or w1 is null or w2 is null or mp is null then 'sk_core4_not_computable' else '' end reason from raw)
),
f as (
 select target_case_id, pid, sn, label, tn target_measurements, cn contralateral_measurements, ok::int symmetry_available,
  reason symmetry_reason, coalesce(wit,0e0) target_within_cosine_distance_mean,
  coalesce(wio,0e0) contralateral_within_cosine_distance_mean,
  case when ok then btw else 0e0 end between_breasts_cosine_distance_mean,
  case when ok then btw-within_mean else 0e0 end symmetry_cosine_score,
  {",".join(f"case when ok then coalesce({c},0e0) else 0e0 end {n}" for c, n in (
    ("r1", "sk_meanrms1"), ("w1", "sk_weightedrms1"), ("st1", "sk_sigma_target1"), ("sc1", "sk_sigma_contralateral1"),
    ("h1", "sk_mahalanobis1"), ("r2", "sk_meanrms2"), ("w2", "sk_weightedrms2"), ("st2", "sk_sigma_target2"),
    ("sc2", "sk_sigma_contralateral2"), ("h2", "sk_mahalanobis2"), ("p14", "sk_peak14_intensity_abs_delta"),
    ("mp", "sk_mean_peak_value_abs_delta"), ("wmu", "sk_wasserstein_distance_mu_tc"), ("cfd", "sk_cosine_distance_full_q2"),
    ("wfull", "sk_wasserstein_distance_full_q2")))}
 from ft
),
"""


PAIRS = pair_ctes((6.7, 23.0), (6.7, 15.0))
LEGACY = pair_ctes((7.5, 23.0), (7.0, 15.0), legacy=True)
CORE4 = ("sk_wasserstein_distance_full_q2", "sk_weightedrms1", "sk_weightedrms2", "sk_mean_peak_value_abs_delta")
ALL15 = (
    "sk_meanrms1", "sk_weightedrms1", "sk_sigma_target1", "sk_sigma_contralateral1", "sk_mahalanobis1", "sk_meanrms2",
    "sk_weightedrms2", "sk_sigma_target2", "sk_sigma_contralateral2", "sk_mahalanobis2", "sk_peak14_intensity_abs_delta",
    "sk_mean_peak_value_abs_delta", "sk_wasserstein_distance_mu_tc", "sk_cosine_distance_full_q2",
    "sk_wasserstein_distance_full_q2",
)


def base(name: str, select: str, *ctes: str) -> None:
    text = "".join((BASE, *ctes)).rstrip().rstrip(",")
    ORACLES[name] = f"with {text}\n{select}"


def plain(name: str, select: str) -> None:
    ORACLES[name] = select


base("case_table", """select c.target_case_id, c.pid "patientId", case c.sn when 'LEFT' then 'Left' else 'Right' end target_side,
 case c.osn when 'LEFT' then 'Left' when 'RIGHT' then 'Right' else '' end contralateral_side, label, specimens, measurements,
 age, age_available from cases c join roll using (pid)""")

# --- A -----------------------------------------------------------------------------------------

base("a1_measurement_scan", f"""select measurement_id, "patientId", side, "position", sample_thickness_mm, calibrant_thickness_mm,
 len(q_range)::int points, {r6("list_sum(radial_profile_data)", "profile_sum")} from m
 where "position" in ('P1','P2','P3') and sample_thickness_mm is not null and calibrant_thickness_mm between 2 and 40
 and poni_q_max_nm_inv >= 23""")

SETS = """
sets as (
 select '/cal/'||event_id::varchar||'.h5' file_path, event_id::varchar||'.h5' file_name, 's'||event_id::varchar session_uid,
  case when event_id%53=52 then null else date_trunc('second', ts) end started_at,
  'set_'||(user_id%3)::varchar set_name,
  case event_type when 'view' then 'Silver Behenate 1' when 'click' then 'silver behenate QC' else event_type end measurement_type_name,
  case when event_type in ('view','click') then 'CALIBRATION' else 'SAMPLE' end measurement_type_category,
  case when user_id%8=7 then null else (user_id%8)::varchar end data_batch,
  case when user_id%8 in (1,2,6) then 'k-beta' else 'k-alpha' end source_line, user_id::varchar nova_range,
  case when event_id%31=30 then null else value*2e0 end distance_mm, (event_id%5+1)::double exposure_time_s,
  event_id%7<>6 has_poni, event_id%11<>10 has_raw_file, event_id
 from events
),
agbh as (
 select * from sets where lower(measurement_type_name) like '%silver behenate%' and has_poni and has_raw_file
  and data_batch in ('3','4','5','7','2')
),
sc as (select *, distance_mm/1e4 score, coalesce(distance_mm/1e4 <= 75e-4, false) ok from sets),
rules(data_batch, source_line, kbeta_absent, calibrant_thickness_mm) as (values
 ('1','k-beta',false,40e0),('2','k-beta',false,40e0),('3','k-alpha',true,40e0),('4','k-alpha',true,40e0),
 ('5','k-alpha',true,40e0),('6','k-beta',false,40e0),('7','k-alpha',true,10e0),(null,'unknown',null,null))
"""


def sets(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = "with " + ",".join((SETS, *ctes)) + "\n" + select


sets("a2_session_catalogue", "select measurement_type_category, count(distinct session_uid) sessions, count(*) rows from sets group by 1")
sets("a3_calibration_manifest", """select file_path, file_name, session_uid, strftime(started_at,'%Y-%m-%d %H:%M:%S') started_at, set_name,
 measurement_type_name, measurement_type_category, data_batch, source_line, nova_range, null::varchar human1_version,
 null::varchar protocol_version, distance_mm, exposure_time_s, has_poni, has_raw_file from sets""")
sets("a4_batch_rules_json", """select u.data_batch, sets, source_line, kbeta_absent, calibrant_thickness_mm
 from (select data_batch, count(*) sets from sets group by 1) u left join rules r on u.data_batch is not distinct from r.data_batch""")

OOF = """
oof as (
 select 'C'||o_orderkey::varchar target_case_id, 'K'||o_custkey::varchar "patientId", (o_orderstatus='F')::int as label, s::int split_id,
  least(greatest(o_totalprice/6e5+((o_orderkey*7+s*13)%21-10)::double/1e2,1e-6),1e0-1e-6) p_cancer, 25e-2+s::double/1e2 threshold_target
 from orders, range(0,5) t(s)
),
o2 as (select *, (p_cancer>=threshold_target)::int y_pred_target from oof)
"""


def oof(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = "with " + ",".join((OOF, *ctes)) + "\n" + select


POOL = f"""select target_case_id, min("patientId") "patientId", min(label) as label, {r6("avg(p_cancer)", "p_cancer", 9)},
 {r6("avg(threshold_target)", "threshold_target")} from oof group by 1"""
oof("a5_csv_export", POOL)
oof("e10_oof_pooling", POOL)
base("a6_artifact_lineage", f"""select g.measurement_id, "patientId", product_status_group, {r6("s", "profile_sum")}
 from g join (select measurement_id, sum(y) s from gpts group by 1) using (measurement_id)""")
plain("a7_text_checksums", "select doc_id, sha256(text) sha256 from documents")
base("a10_exclusion_lists", """select k.kind, k.value, count(measurement_id) rows from (values ('linked_agbh_session_uid','cal_1'),
 ('linked_agbh_session_uid','cal_5'),('linked_agbh_session_uid','cal_9'),('started_at','2025-02-14'),('started_at','2025-03-04')) k(kind,value)
 left join m on (k.kind='linked_agbh_session_uid' and linked_agbh_session_uid=k.value)
  or (k.kind='started_at' and linked_agbh_session_uid is null and started_on::varchar=k.value) group by 1,2""")

# --- B -----------------------------------------------------------------------------------------

base("b1_predicates", " union all ".join(
    f"select '{op}' op, count(*) n from m where {cond}" for op, cond in (
        ("==", "side='Left'"), ("in", "\"position\" in ('P1','P2')"), ("not in", "\"position\"<>'P1'"),
        (">", "sample_thickness_mm>50"), (">=", "sample_thickness_mm>=50"), ("<=", "sample_thickness_mm<=50"),
        ("between", "calibrant_thickness_mm between 2 and 40"), ("notna", "age is not null"),
        ("date>=", "started_on>=date '2025-03-01'"), ("date in", "started_on in (date '2025-02-06', date '2025-02-14')"),
        ("date not in", "started_on not in (date '2025-02-06', date '2025-02-14')"))))
ID3 = 'measurement_id, "patientId", "position"'
base("b2_exclusion_fallback", f"""select {ID3}, linked_agbh_session_uid, started_on::varchar started_on from m
 where (linked_agbh_session_uid is null and started_on not in (date '2025-02-14', date '2025-03-04'))
  or linked_agbh_session_uid not in ('cal_1','cal_5','cal_9')""")
base("b3_position_filter", f"select {ID3} from m where \"position\" in ('P1','P2','P3')")
base("b4_sample_thickness", f"select {ID3}, sample_thickness_mm from m where sample_thickness_mm>0")
base("b5_calibrant_thickness", f"select {ID3}, calibrant_thickness_mm from m where calibrant_thickness_mm between 2 and 40")
base("b6_q_coverage", f"select {ID3}, poni_q_max_nm_inv from m where poni_q_max_nm_inv>=23")
base("b7_biopsy_rows", f"select {ID3} from m where biopsy")
base("b8_group_filter", f"select {ID3} from m where \"patientId\" in (select \"patientId\" from m where biopsy)")
base("b9_specimen_status", f"select {ID3}, specimen_status from m where specimen_status in ('BENIGN','NORMAL','CANCER','ATYPICAL','PRE_CANCEROUS')")
base("b10_label_filter_stats", """select count(*) rows_in, count(*) filter (product_status_group is not null) rows_kept,
 count(*) filter (product_status_group is null) rows_dropped from lab""")
FLAG = "case event_id%7 when 0 then 'TRUE' when 1 then 'yes' when 2 then '1' when 3 then '1.0' when 4 then 'no' when 5 then '' end"
plain("b11_boolean_coercion", f"""select raw, coalesce(lower(raw) in ('true','1','yes'), false) flag, false num_flag, count(*) n
 from (select {FLAG} raw from events) group by 1,2,3""")
base("b12_pair_filter", f"""select {ID3}, product_status_group from lab where "patientId" in (
 select "patientId" from (select "patientId", side, max(product_status_group) l from lab where product_status_group is not null group by 1,2)
 group by 1 having count(*)=2 and count(distinct l)=2)""")
base("b13_specimen_validity", f"""select {ID3}, "specimenId", c specimen_measurement_count from (
 select *, count(*) over (partition by "specimenId") c from qc) where c>=2 and "patientId" in (
  select "patientId" from (select "patientId", "specimenId" from qc group by 1,2 having count(*)>=2) group by 1 having count(*)>=2)""")
SIDE = ("case event_id%8 when 0 then 'Left' when 1 then ' right ' when 2 then 'L' when 3 then 'LEFT breast' "
        "when 4 then 'r' when 5 then '' when 6 then 'centre' end")
plain("b14_side_normalisation", f"""select raw, n, s side_norm, case s when 'LEFT' then 'Left' when 'RIGHT' then 'Right' else '' end side_display from (
 select raw, count(*) n, case when upper(trim(raw)) like 'LEFT%' then 'LEFT' when upper(trim(raw)) like 'RIGHT%' then 'RIGHT' end s
 from (select {SIDE} raw from events) group by 1)""")
plain("b15_side_exact", f"""select raw, count(*) n, case when lower(trim(raw)) in ('left','l') then 'left'
 when lower(trim(raw)) in ('right','r') then 'right' end side_exact from (select {SIDE} raw from events) group by 1""")
PDX = "max(product_status_group) over (partition by \"patientId\")"
base("b16_label_grouping", f"select {ID3}, product_status_group, product_status_group product_diagnosis, {PDX} patient_product_diagnosis from lab")
base("b17_binary_label", "select measurement_id, case product_status_group when 'BENIGN' then 0 when 'CANCER' then 1 end as label from lab")
base("b18_stage1_rows", """select count(*) rows, count(distinct "patientId") patients, count(*) filter (product_status_group='BENIGN') benign_rows,
 count(*) filter (product_status_group='CANCER') cancer_rows, count(distinct product_status_group)=2 two_classes from g where biopsy""")
base("b19_keep_columns", f"""select "patientId", "specimenId", side, "position", specimen_status, product_status_group,
 product_status_group product_diagnosis, {PDX} patient_product_diagnosis, age, biopsy, sample_thickness_mm, calibrant_thickness_mm,
 poni_q_max_nm_inv, measurement_id from lab""")
base("b21_numeric_coercion", """select "patientId", coalesce(median(v),0e0) median, max(v) is not null has_numeric from (
 select "patientId", try_cast(case when measurement_id%5=4 then 'n/a' else age::int::varchar end as double) v from m) group by 1""")
base("b22_consensus_metadata", """select "patientId", side, case when count(distinct o)=1 then min(o) end operator_id,
 case when count(distinct h)=1 then min(h) end hardware_version, null::varchar eoscan_version from (
 select "patientId", side, case when measurement_id%4<>3 then 'op'||((measurement_id//6)%3)::varchar end o,
  case when measurement_id%9=0 then 'hw2' else 'hw1' end h from m) group by 1,2""")
base("b23_first_text", """select measurement_id, case when measurement_id%3=1 then 'uid' when measurement_id%2=0 then 'sid' else 'unknown' end as value from m""")
ODD = "case when event_id%9 in (6,7,8) then null else value/7e0 end"
# Half-even on the exact binary value: the scaled product's own error is computed by splitting both factors.
plain("b24_report_rounding", f"""select event_id, case when x is null then null else (f + case when p - f > 5e-1 or (p - f = 5e-1 and (
 d > 0e0 or (d = 0e0 and f % 2 <> 0))) then 1 else 0 end)::double / 1e5::double + 0e0 end v from (
 select *, ((h*s1 - p) + h*s2 + (x-h)*s1) + (x-h)*s2 d from (
  select *, x*134217729e0 - (x*134217729e0 - x) h, x*1e5::double p, floor(x*1e5::double)::bigint f,
   1e5::double*134217729e0 - (1e5::double*134217729e0 - 1e5::double) s1,
   1e5::double - (1e5::double*134217729e0 - (1e5::double*134217729e0 - 1e5::double)) s2 from (
   select event_id, case when event_id % 5 = 0 then (event_id % 4001 - 2000)::double / 64e0 else {ODD} end x from events)))""")
plain("b29_finite_or_zero", f"select event_id, {r6(f'coalesce({ODD},0e0)', 'v')} from events")
sets("b25_calibrant_selection", "select session_uid, data_batch, measurement_type_name from agbh")
sets("b26_distance_filter", """select count(*) rows_in, count(*) filter (distance_mm<=200) rows_pass,
 count(*) filter (distance_mm is null or distance_mm>200) rows_dropped,
 string_agg(distinct data_batch, ',' order by data_batch) filter (distance_mm is null or distance_mm>200) dropped_batches from sets""")
CONT = """
c as (
 select o_custkey container_id, coalesce(nullif(trim(case when o_orderkey%97=0 then 'X' when o_orderkey%5=0 then ' ' else 'K'||o_custkey::varchar end),''),
   case when o_custkey%3<>0 then 'K'||o_custkey::varchar end) pid,
  case when o_custkey%41=0 then '0.2' else '0.3' end ver, case when o_custkey%43<>0 then 'xrd-session' end fmt,
  case when o_custkey%37=0 then 'other' else 'K'||o_custkey::varchar end want from orders
)"""
plain("b27_container_check", f"""with {CONT} select * from (select container_id, case when bool_or(ver<>'0.3') then 'schema_version'
 when bool_or(fmt is null or fmt<>'xrd-session') then 'format' when count(pid)=0 then 'no_patient' when count(distinct pid)>1 then 'several_patients'
 when min(pid)<>max(want) then 'other_patient' end reason from c group by 1) where reason is not null""")
plain("b28_patient_id_fallback", f"with {CONT} select pid patient_id, count(*) n from c group by 1")

# --- C -----------------------------------------------------------------------------------------

base("c1_geometry", f"""select measurement_id, {r6("d", "distance_m")},
 {r6("4*pi()/(56e-12*1e9)*sin(atan(sqrt(pow(greatest(0.01::double,512*55e-6-0.01::double),2)+pow(greatest(0.02::double,768*55e-6-0.02::double),2))/d)/2)", "poni_q_max")}
 from (select measurement_id, (15+measurement_id%10)::double/1e2 d from m)""")
PX = """
px as (
 select l_orderkey measurement_id, 2e0+21e0*(l_partkey%997)::double/997e0 q, l_quantity counts,
  l_extendedprice/1e2 >= 500 and (l_partkey%997)::double/997e0/2e0 > 4e-2 faulty from lineitem
),
pb as (
 select *, case when q>=2 and q<23 then floor((q-2e0)/21e0*100)::int end bin from px
),
bins as (
 select measurement_id, bin, avg(counts) intensity, sqrt(sum(counts))/count(*) sigma, count(*) pixels
 from pb where bin is not null and not faulty group by 1,2
),
allbins as (select measurement_id, bin, avg(counts) intensity from pb where bin is not null group by 1,2)
"""
plain("c2_faulty_pixels", f"with {PX} select measurement_id, count(*) filter (faulty) faulty, count(*) pixels from px group by 1")
plain("c3_q_bins", f"with {PX} select bin, count(*) n, {r6('avg(q)', 'mean_q')} from pb group by 1")
plain("c4_azimuthal_integration", f"with {PX} select measurement_id, bin, {r6('intensity')}, {r6('sigma')}, pixels from bins")
base("c5_thickness_correction", f"""select measurement_id, {r6("calibrant_thickness_mm/sample_thickness_mm", "thickness_factor")},
 sample_thickness_mm is not null thickness_adjusted,
 {r6("list_sum(radial_profile_data)*calibrant_thickness_mm/sample_thickness_mm", "profile_sum")} from m""")
SNR = f"with {PX}, snr as (select measurement_id, 20*log10(avg(intensity)/avg(sigma)) snr_db from bins group by 1)"
plain("c6_snr", f"{SNR} select measurement_id, {r6('snr_db')} from snr")
plain("c7_snr_gate", f"{SNR} select measurement_id, {r6('snr_db')} from snr where snr_db>=15")
base("c8_band_normalisation", f"""select measurement_id, {r6("1e0", "band_median")}, {r6("sum(y/b)", "profile_sum")}, {r6("sum(y)", "raw_sum")}
 from rawpts join band using (measurement_id) group by 1""")
base("c9_profile_gate", f"""select measurement_id, {r6("v", "radial_profile_value_at_q")}, {r6("nq", "radial_profile_nearest_q_nm_inv")},
 {r6("d", "radial_profile_q_delta_nm_inv")}, v>8e-1 radial_profile_value_pass from gate""")
base("c10_profile_check", """select count(*) rows, min(len(radial_profile_data))::int min_points, max(len(radial_profile_data))::int max_points,
 count(*) filter (list_aggregate(list_transform(radial_profile_data, lambda x: not isfinite(x)),'bool_or')) bad_rows from m""")
base("c11_roi_slice", f"""select measurement_id, count(*)::int n, {r6("min(q)", "q_lo")}, {r6("max(q)", "q_hi")}, {r6("sum(y)", "y_sum")}
 from rawpts where q between 67e-1 and 15e0 group by 1""")
base("c12_smoothing", f"select measurement_id, k::int i, {r6('y', 'v')} from sm",
     f"hat(r,c,w) as (values {hat()}),", smoothed("sm", "rawpts", 2.0, 23.0))


def lerp(name: str, src: str, key: str, lo: float, hi: float, points: int) -> str:
    """Interpolation of 64-point profiles (step 1/3 from 2) on a linear grid, clamped."""
    step = (hi - lo) / (points - 1)
    return f"""
{name}_g as (select i::int i, case when i={points - 1} then {hi!r}::double else {lo!r}::double + i::double*{step!r}::double end x from range(0,{points}) t(i)),
{name}_s as (select i, x, least(greatest(floor((x-2e0)*3e0)::int, 0), 62) j from {name}_g),
{name} as (
 select a.{key}, s.i, s.x, case when x<=a.q then a.y when x>=b.q then b.y else a.y+(b.y-a.y)/(b.q-a.q)*(x-a.q) end y
 from {name}_s s join {src} a on a.i=s.j join {src} b on b.{key}=a.{key} and b.i=s.j+1
),
"""


base("c13_interpolation", f"select measurement_id, i, {r6('y', 'v')} from ip", lerp("ip", "rawpts", "measurement_id", 1.0, 24.0, 47))
base("c14_near_minimum", f"select measurement_id, i::int i, {r6('y', 'v')} from (select *, k i from nz)",
     "raw2 as (select measurement_id, pid, sn, i k, q, y from rawpts),", normed("nz", "raw2"))
base("c15_min_max", f"""select measurement_id, i::int i, {r6("(y-lo)/(hi-lo)", "v")} from (
 select *, min(y) over w lo, max(y) over w hi from rawpts window w as (partition by measurement_id))""")
CAL = """
cal as (
 select vec_id, 's'||vec_id::varchar session_uid, (label%7+1)::varchar data_batch,
  (date '2025-02-06' + (vec_id//6)::int)::date::varchar as day, embedding from embeddings
),
cpts as (
 select vec_id, unnest(range(0,64)) i, unnest(list_transform(range(0,64), lambda i: 2e0+cast(i as double)/3e0)) q,
  unnest(list_transform(embedding, lambda x: 3e0+4e0*cast(x as double))) y from cal
),
"""


def cal(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = "with " + "".join((CAL, *ctes)).rstrip().rstrip(",") + "\n" + select


cal("c16_heat_map", f"""select h.vec_id, day, i, {r6("case when t>0 then y/t else y end", "v")} from (
 select *, max(y) over (partition by vec_id) t from hm) h join cal using (vec_id)""", lerp("hm", "cpts", "vec_id", 3.0, 21.0, 37))
base("c17_peak_value", f"""select measurement_id, {r6("max(y) filter (q between 13 and 148e-1)", "peak")},
 {r6("case when count(*) filter (q between 13 and 135e-1)>=3 then max(y) filter (q between 13 and 135e-1) end", "narrow_peak")} from rawpts group by 1""")
base("c18_peak_height", f"""select measurement_id, {r6("max(y) filter (q between 135e-1 and 145e-1) - median(y) filter ((q>=125e-1 and q<1325e-2) or (q>1475e-2 and q<=155e-1))", "peak_height")}
 from rawpts group by 1""")
base("c19_side_profiles", f"""select pid "patientId", sn side_norm, {r6("q")}, {r6("mu")}, {r6("sd")} from mu""", PAIRS)
base("c20_trapezoid", f"""select measurement_id, {r6("sum((greatest(y-3,0)+greatest(py-3,0))/2*(q-pq))", "area")} from (
 select *, lag(y) over w py, lag(q) over w pq from rawpts window w as (partition by measurement_id order by i)) where pq is not null group by 1""")

# --- D -----------------------------------------------------------------------------------------


def pair(name: str, *columns: str) -> None:
    base(name, "select target_case_id, " + ", ".join(r6(c) for c in columns) + " from f", PAIRS)


pair("d1_mean_rms", "sk_meanrms1", "sk_meanrms2")
pair("d2_weighted_rms", "sk_weightedrms1", "sk_weightedrms2")
pair("d3_replicate_sigma", "sk_sigma_target1", "sk_sigma_contralateral1", "sk_sigma_target2", "sk_sigma_contralateral2")
pair("d4_mahalanobis", "sk_mahalanobis1", "sk_mahalanobis2")
pair("d5_peak14_delta", "sk_peak14_intensity_abs_delta")
pair("d6_mean_peak_delta", "sk_mean_peak_value_abs_delta")
pair("d7_wasserstein_roi", "sk_wasserstein_distance_mu_tc")
pair("d8_wasserstein_full", "sk_wasserstein_distance_full_q2")
pair("d9_cosine_full", "sk_cosine_distance_full_q2")
pair("d10_within_cosine", "target_within_cosine_distance_mean", "contralateral_within_cosine_distance_mean")
pair("d11_between_cosine", "between_breasts_cosine_distance_mean", "symmetry_cosine_score")
base("d12_availability_gate", "select target_case_id, symmetry_available, symmetry_reason, target_measurements, contralateral_measurements, "
     + ", ".join(r6(c) for c in CORE4) + " from f", PAIRS)
base("d13_legacy_contract", "select target_case_id, symmetry_available, " + ", ".join(r6(c) for c in ALL15) + " from f", LEGACY)

# --- E -----------------------------------------------------------------------------------------

base("e1_target_cases", """select target_case_id, pid "patientId", sn target_side_norm, case sn when 'LEFT' then 'Left' else 'Right' end target_side,
 osn contralateral_side_norm, case osn when 'LEFT' then 'Left' when 'RIGHT' then 'Right' else '' end contralateral_side, label from cases""")
base("e2_logit_average", f"""select pid "patientId", sn side_norm, {r6("1/(1+exp(-avg(ln(p/(1-p)))))", "p")}, count(*) n from rowp group by 1,2""")
base("e3_case_scores", f"""select target_case_id, {r6("pm", "profile_p_cancer_probability_mean")}, {r6("la", "profile_p_cancer_logit_average")},
 ev.n profile_p_cancer_n_measurements from cases join ev using (pid, sn)""")
base("e4_patient_rollup", 'select pid "patientId", specimens, measurements, age, age_available from roll')
FULL = "full_f as (select f.*, ev.pm, ev.la, ev.n en, specimens, measurements, age, age_available from f join ev using (pid,sn) join roll using (pid)),"
base("e5_reliability", """select target_case_id, lo min_measurements_per_breast, (t>=2)::int target_measurements_ok, (c>=2)::int contralateral_measurements_ok,
 (s=1 and lo>=2)::int paired_measurements_ok, (en>=2)::int profile_measurements_ok,
 case when s=1 and lo>=2 then 'high' when t>=2 then 'medium' else 'low' end result_reliability,
 case when s=1 and lo>=2 then 'at least 2 valid measurements per breast; symmetry refinement applied'
  when symmetry_reason='sk_core4_not_computable' then 'symmetry features could not be computed; symmetry refinement not applied'
  when c=0 then 'contralateral breast unavailable after preprocessing; symmetry refinement not applied'
  when t>=2 then 'fewer than 2 valid contralateral-breast measurements; symmetry refinement not applied'
  else 'fewer than 2 valid target-breast measurements' end result_reliability_reason
 from (select *, target_measurements t, contralateral_measurements c, symmetry_available s, least(target_measurements, contralateral_measurements) lo from full_f)""", PAIRS, FULL)
base("e6_cohort_summary", """select coalesce(product_status_group,'<missing>') as label, count(*) rows, count(*) filter (biopsy) biopsy_rows from lab group by 1""")
base("e7_dataset_summary", """select (select count(*) from g) measurements, (select count(distinct "patientId") from g) patients,
 (select count(distinct "specimenId") from g) specimens, (select count(*) from g where biopsy) lr1_measurements,
 (select count(distinct "patientId") from g where biopsy) lr1_patients, count(distinct pid) final_patients, count(*) final_target_cases,
 count(*) filter (label=1) final_cancer_target_cases, count(*) filter (label=0) final_benign_target_cases from cases""")
sets("e8_batch_scores", f"""select data_batch, count(*) n, count(*) filter (ok) accepted, count(*) filter (not ok) rejected,
 {r6("min(score)", "score_min")}, {r6("median(score)", "score_median")}, {r6("avg(score)", "score_mean")}, {r6("max(score)", "score_max")}
 from sc group by 1""")

CURVE = """
cv as (
 select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over (partition by k) np, sum(neg) over (partition by k) nn,
  lead(pos) over (partition by k order by p desc) npos, lead(neg) over (partition by k order by p desc) nneg,
  row_number() over (partition by k order by p desc) rn
 from (select k, p, sum(y)::bigint pos, sum(1-y)::bigint neg from sv group by 1,2)
 window w as (partition by k order by p desc rows between unbounded preceding and current row)
),
rk as (
 select k, sum(neg*((tp-pos)::double+pos/2e0))/(max(np)::double*max(nn)) roc_auc, sum(pos*(tp::double/(tp+fp)))/max(np) pr_auc from cv group by 1
),
cf as (
 select k, count(*) filter (y=1 and hit) tp, count(*) filter (y=0 and not hit) tn, count(*) filter (y=0 and hit) fp,
  count(*) filter (y=1 and not hit) fn, avg((p-y)*(p-y)) brier_score, -avg(case when y=1 then ln(p) else ln(1-p) end) log_loss
 from (select *, p>=t hit from sv) group by 1
),
rt as (
 select *, tp::double/(tp+fn) sensitivity, tn::double/(tn+fp) specificity, (tp::double/(tp+fn)+tn::double/(tn+fp))/2 balanced_accuracy,
  tp::double/(tp+fp) ppv, tn::double/(tn+fn) npv from cf join rk using (k)
),
pt as (
 select k, p threshold, tp::double/np tpr, fp::double/nn fpr from cv where rn=1 or npos is null or pos<>npos or neg<>nneg
 union all select distinct k, 'inf'::double, 0e0, 0e0 from cv
),
th as (
 select k, first(threshold order by tpr-fpr desc, threshold desc) ty,
  first(threshold order by fpr, threshold desc) filter (tpr>=95e-2) tt from pt group by 1
)
"""
SV_OOF = "sv as (select split_id k, label y, p_cancer p, threshold_target t from oof)"
SV = "sv as (select 0 k, (o_orderstatus='F')::int y, least(greatest(o_totalprice/6e5,1e-6),1e0-1e-6) p, 25e-2 t from orders)"
SV_TIED = "sv as (select 0 k, (l_returnflag='R')::int y, (l_discount*1e2+1e0)/12e0 p, 5e-1 t from lineitem)"
STDS = ("roc_auc", "pr_auc", "brier_score", "log_loss", "sensitivity", "specificity")
TGT = ("sensitivity", "specificity")
tname = lambda c: f"{c}_target" if c in TGT else c
oof("e9_fold_summary", "select 'model' model_name, count(*) splits, "
    + ", ".join(f"{r6(f'avg({c})', tname(c) + '_mean')}, {r6(f'stddev_pop({c})', tname(c) + '_std')}" for c in STDS) + ", "
    + ", ".join(r6(f"avg({c})", f"{c}_target_mean") for c in ("balanced_accuracy", "ppv", "npv")) + ", "
    + ", ".join(r6(f"avg({c})", f"{n}_mean") for c, n in (
        ("tp", "true_positives"), ("tn", "true_negatives"), ("fn", "false_negatives"), ("fp", "false_positives")))
    + " from rt", SV_OOF, CURVE)
LOGIT = lambda p: f"ln(least(greatest({p},1e-6),1e0-1e-6)/(1e0-least(greatest({p},1e-6),1e0-1e-6)))"
STAB = f"""st as (
 select *, {LOGIT('p_cancer')}-{LOGIT('25e-2')} margin from (
  select target_case_id, median(p_cancer) p_cancer, greatest(avg(y_pred_target),1-avg(y_pred_target)) decision_stability from o2 group by 1))"""
oof("e11_decision_stability", f"select target_case_id, {r6('p_cancer', digits=9)}, {r6('decision_stability')}, {r6('margin')} from st", STAB)
base("e12_availability_warnings", """select count(*) filter (symmetry_available=0) unpaired_cases, count(*) filter (target_measurements<2) low_target_cases,
 count(*) filter (contralateral_measurements<2) low_contralateral_cases from full_f""", PAIRS, FULL)
sets("e13_selection_lists", """select distinct case when ok then 'accepted' else 'rejected' end||'_session_uids' as list, session_uid as value from sc
 union select distinct case when ok then 'accepted' else 'rejected' end||'_dates', started_at::date::varchar from sc where started_at is not null""")
sets("e14_run_counts", """select 'calibration_sets_total' item, count(*) n from sets union all select 'selected_agbh_sets', count(*) from agbh
 union all select 'integrated_agbh_sets', count(*) from agbh where distance_mm<=200
 union all select 'batch='||data_batch, count(*) from agbh where distance_mm<=200 group by data_batch
 union all select 'reference_agbh_sets', least(count(*),2) from agbh where started_at::date<=date '2024-01-20'""")


def curve_ctes(points: int) -> str:
    return lerp("gp", "cpts", "vec_id", 2.0, 23.0, points) + """
mm as (select vec_id, min(y) lo, max(y) hi from gp group by 1),
yn as (select vec_id, i, x q, case when hi>lo then (y-lo)/(hi-lo) else y-lo end y from gp join mm using (vec_id)),
rf as (select i, median(y) ref from yn where vec_id in (select vec_id from cal where data_batch='7' order by vec_id desc limit 2) group by 1),
"""


cal("e15_reference_curve", f"select i, {r6('ref')} from rf", curve_ctes(200))

# --- F -----------------------------------------------------------------------------------------

base("f1_features_with_scores", f"""select target_case_id, label, age, measurements, {r6("la", "profile_p_cancer_logit_average")},
 {r6("sk_weightedrms1")} from full_f""", PAIRS, FULL)
oof("f2_summary_with_intervals", "select * from (" + " union all ".join(
    f"select '{c}' metric, {r6(f'avg({c})', 'value')}, " + (
        f"{r6(f'quantile_cont({c},0.025)', 'ci_low')}, {r6(f'quantile_cont({c},0.975)', 'ci_high')}"
        if c in ("roc_auc", "brier_score") else "null::double ci_low, null::double ci_high") + " from rt"
    for c in ("roc_auc", "pr_auc", "brier_score", "log_loss")) + ")", SV_OOF, CURVE)
FOLD = """pat as (select pid, max(label) as label from cases group by 1),
fold as (
 select "repeat", pid, label, ((row_number() over (partition by "repeat" order by label, h, pid)-1)%5)::int fold
 from (select r::int "repeat", pid, label, md5('42:'||r::varchar||':'||pid) h from pat, range(0,20) t(r))
),"""
base("f3_fold_membership", """select ("repeat"*5+fold)::int split_id, count(*) rows, sum(measurement_id)::bigint id_sum from g join fold on fold.pid=g."patientId" group by 1""", FOLD)
sets("f4_manifest_enrichment", """select e.event_id, '/cal/'||(e.event_id-e.event_id%2)::varchar||'.h5' file_path, data_batch, source_line, nova_range, file_name,
 distance_mm, case when started_at<timestamp '2024-01-15' then 40e0 when started_at>=timestamp '2024-01-15' then 10e0 end agbh_calibrant_thickness_mm
 from events e left join sets s on s.file_path='/cal/'||(e.event_id-e.event_id%2)::varchar||'.h5'""")
base("f5_side_pairing", """select t.pid "patientId", t.sn side_norm, t.n side_rows, o.sn contralateral_side_norm, o.n contralateral_rows
 from sides t left join sides o on o.pid=t.pid and o.sn<>t.sn""")
base("f6_within_side_pairs", f"""select s.pid "patientId", s.sn side_norm, coalesce(pairs,0) pairs, {r6("w", "mean_distance")}
 from sides s left join wc using (pid, sn)""", PAIRS)
sets("f7_effective_thickness", """select session_uid, case when started_at<timestamp '2024-01-15' then 40e0 when started_at>=timestamp '2024-01-15' then 10e0 end agbh_calibrant_thickness_mm,
 'started_at < 2024-01-15: 40.0 mm; started_at >= 2024-01-15: 10.0 mm' agbh_calibrant_thickness_rule from sets""")
DRAW = """bc as (select target_case_id, pid, label y, la p, 3e-1 t from cases join ev using (pid, sn)),
ix as (select pid, row_number() over (order by substr(md5(pid),1,2), md5(pid), pid)-1 ix from (select distinct pid from bc)),
dr as (
 select b::int b, ('0x'||substr(md5('42:'||b::varchar||':'||ix::varchar),1,12))::bigint % (select count(*) from ix) ix from ix, range(0,2000) t(b)
),
bs as (select b k, bc.* from dr join ix using (ix) join bc using (pid)),
"""
base("f8_bootstrap_join", """select k b, count(*) cases, sum(y)::bigint positives, count(distinct target_case_id) distinct_cases from bs group by 1""", DRAW)

# --- G -----------------------------------------------------------------------------------------

sets("g1_first_k_per_batch", """select data_batch, session_uid, file_name from (
 select *, row_number() over (partition by data_batch order by started_at nulls last, file_name) rn from agbh) where rn<=7""")
sets("g2_latest_k", """select session_uid, file_name from (select * from agbh where data_batch in ('7','3') and started_at::date<=date '2024-01-20'
 order by started_at desc, file_name desc limit 5)""")
sets("g3_worst_calibration", f"select session_uid, {r6('score')} from (select * from sc where score is not null order by score desc, session_uid limit 1)")
plain("g4_score_percentiles", f"""with s as (select o_orderkey case_id, (o_orderstatus='F')::int y, least(greatest(o_totalprice/6e5,1e-6),1e0-1e-6) p from orders),
 u as (select case_id, p, y, case_id%3<>0 isref from s),
 c as (select case_id, isref, count(*) filter (isref) over w a, count(*) filter (isref and y=0) over w b, count(*) filter (isref and y=1) over w c
  from u window w as (order by p range between unbounded preceding and current row)),
 t as (select count(*) a, count(*) filter (y=0) b, count(*) filter (y=1) c from u where isref)
 select case_id, {r6("c.a::double/t.a", "percentile_all")}, {r6("c.b::double/t.b", "percentile_reference_class")},
 {r6("c.c::double/t.c", "percentile_target_class")} from c, t where not isref""")
plain("g5_reference_scores", f"""with {SV_TIED}, u as (select 'all_target_cases' population, p from sv
 union all select case when y=1 then 'cancer_target_cases' else 'benign_target_cases' end, p from sv)
 select population, {r6("p", "score")}, count(*) n from u group by population, p""")
sets("g6_stable_order", "select file_name, set_name, strftime(started_at,'%Y-%m-%d %H:%M:%S') started_at from agbh")
oof("g7_union_splits", f"select split_id, count(*) n, {r6('avg(p_cancer)', 'mean_p')} from oof group by 1")
base("g8_leakage_check", """select split_id, pid "patientId" from (
 select ("repeat"*5+f)::int split_id, pid, case when f=fold then 'test' else 'train' end role from fold, range(0,5) t(f)
 union all select ("repeat"*5+fold)::int, pid, 'train' from fold where pid like '%3')
 group by 1,2 having count(distinct role)=2""", FOLD)

# --- M -----------------------------------------------------------------------------------------

B3 = ("profile_p_cancer_logit_average", "age", "age_available")
base("m3a_design_matrix", "select target_case_id, "
     + ", ".join(r6(f"(case when (stddev_pop({c}) over ())>1e-12 then ({c}-avg({c}) over ())/(stddev_pop({c}) over ()) else {c}-avg({c}) over () end)", f"x_{c}") for c in B3) + ", "
     + ", ".join(r6(f"case when symmetry_available=1 then ({c}-avg({c}) filter (symmetry_available=1) over ())/(stddev_pop({c}) filter (symmetry_available=1) over ()) else 0e0 end", f"x_gated_{c}") for c in CORE4)
     + " from (select * replace (age::double as age), la profile_p_cancer_logit_average from full_f)", PAIRS, FULL)
INF = "nullif(t,'inf'::double)"
TH = (f"select {r6(INF.replace('(t,', '(ty,'), 'threshold_youden')}, {r6(INF.replace('(t,', '(coalesce(tt,ty),'), 'threshold_target')}, tt is not null target_reached from th")
plain("m4_thresholds", f"with {SV},{CURVE} {TH}")
plain("m4_thresholds_tied", f"with {SV_TIED},{CURVE} {TH}")
plain("m4_roc_points", f"with {SV},{CURVE} select {r6('threshold', digits=9)}, {r6('tpr')}, {r6('fpr')} from pt where isfinite(threshold)")
for tag, src in (("", SV), ("_tied", SV_TIED)):
    plain(f"m5_roc_auc{tag}", f"with {src},{CURVE} select {r6('roc_auc')} from rk")
    plain(f"m6_average_precision{tag}", f"with {src},{CURVE} select {r6('pr_auc')} from rk")
oof("m7_confusion", "select k split_id, tp, tn, fp, fn, " + ", ".join(r6(c) for c in ("sensitivity", "specificity", "balanced_accuracy", "ppv", "npv"))
    + " from rt", SV_OOF, CURVE)
oof("m8_losses", f"select k split_id, {r6('brier_score')}, {r6('log_loss')} from cf", SV_OOF, CURVE)
base("m11_folds", 'select "repeat", pid "patientId", label, fold from fold', FOLD)
oof("m13_predictions", f"""select target_case_id, "patientId", label, case label when 1 then 'CANCER' else 'BENIGN' end label_name, split_id,
 {r6("p_cancer", digits=9)}, {r6("threshold_target")}, y_pred_target from o2""")
BM = ("roc_auc", "pr_auc", "sensitivity", "specificity", "balanced_accuracy", "ppv", "npv", "brier_score", "log_loss")
BOOT_RATES = """
rt2 as (select k, roc_auc, pr_auc, brier_score, log_loss, tp::double/nullif(tp+fn,0) sensitivity, tn::double/nullif(tn+fp,0) specificity,
 (tp::double/nullif(tp+fn,0)+tn::double/nullif(tn+fp,0))/2 balanced_accuracy, tp::double/nullif(tp+fp,0) ppv, tn::double/nullif(tn+fn,0) npv
 from cf join rk using (k) where tp+fn>0 and tn+fp>0),
"""
base("m14_bootstrap_intervals", "select * from (" + " union all ".join(
    f"select '{c}' metric, {r6(f'quantile_cont({c},0.025)', 'ci_low')}, {r6(f'quantile_cont({c},0.975)', 'ci_high')}, count({c}) replicates from rt2" for c in BM) + ")",
    DRAW, "sv as (select * from bs),", CURVE.replace("max(np)::double*max(nn)", "nullif(max(np)::double*max(nn),0)").replace("/max(np) pr_auc", "/nullif(max(np),0) pr_auc")
    .replace("tp::double/(tp+fn) sensitivity", "0 sensitivity").replace("tn::double/(tn+fp) specificity", "0 specificity")
    .replace("(tp::double/(tp+fn)+tn::double/(tn+fp))/2 balanced_accuracy", "0 balanced_accuracy")
    .replace("tp::double/(tp+fp) ppv, tn::double/(tn+fn) npv", "0 ppv, 0 npv").rstrip() + ",", BOOT_RATES)
plain("m15_decision", f"with {SV.replace('select 0 k', 'select o_orderkey k')} select k case_id, case when p>=25e-2 then 'high' else 'low' end risk_level, p>=25e-2 biopsy_required from sv")
oof("m16_tier_policy", f"""select target_cases, unstable_target_cases, unstable_target_cases>=5 calibrated, {r6("b", "borderline_margin")},
 {r6("round_even(least(greatest(round_even(b*3e0/1e-1,0)*1e-1,1e-1),2e0),1)", "outer_margin")} from (
 select *, case when unstable_target_cases>=5 then round_even(least(greatest(round_even(md/1e-1,0)*1e-1,1e-1),2e0),1) else 5e-1 end b from (
  select count(*) target_cases, count(*) filter (decision_stability<1) unstable_target_cases, median(abs(margin)) filter (decision_stability<1) md from st))""", STAB)
plain("m17_tier_assignment", f"""with {SV.replace('select 0 k', 'select o_orderkey k')} select k case_id,
 (case when d<-5e-1 then 1 when d<0 then 2 when d<5e-1 then 3 when d<15e-1 then 4 else 5 end)::int tier
 from (select k, {LOGIT('p')}-{LOGIT('25e-2')} d from sv)""")
base("m24_parameter_diff", f"""select coalesce(l.param,r.param) param, coalesce(l.ix,r.ix) ix, {r6("l.v", "left_value")}, {r6("r.v", "right_value")},
 case when r.param is null then 'left_only' when l.param is null then 'right_only' else 'differs' end status
 from (select * from pm where not (param like '%7_Left' and ix='P1')) l full join
 (select param, ix, v0, case when param like '%5_Right' then v0+1e-3 else v0 end vv, case when ix='P4_R' then null when param like '%5_Right' then v0+1e-3 else v0 end v
  from pm where not (param like '%3_Left' and ix='P2')) r on l.param=r.param and l.ix=r.ix
 where r.param is null or l.param is null or (l.ix<>'P4_R' and abs(l.v-r.v)>1e-6)""",
     """pm as (select "specimenId" param, "position" ix, max(radial_profile_data[1]) v0, case when "position"='P4_R' then null else max(radial_profile_data[1]) end v
 from m group by 1,2),""")

# --- K -----------------------------------------------------------------------------------------

Q1 = f"(2e0*pi()/{5.838!r}::double)"
PEAKS = f"""
pkk as (select k::int ord, k*{Q1} alpha, k*{Q1}*0.886::double beta from range(1, floor(23e0/{Q1})::int+1) t(k)),
win as (
 select ord, alpha, beta, alpha+(alpha-beta) control from pkk
 where ord>=3 and beta-0.12::double>=2 and alpha+(alpha-beta)+0.12::double<=23
),
"""
cal("k1_peak_positions", f"""select ord, kind, {r6("centre")}, count(q) points, {r6("avg(y)", "mean_y")} from (
 select ord, 'alpha' kind, alpha centre from pkk union all select ord, 'beta', beta from pkk)
 left join cpts on abs(q-centre)<=0.17::double group by 1,2,centre""", PEAKS)
cal("k2_peak_windows", f"""select ord, {r6("alpha", "alpha_q")}, {r6("beta", "beta_q")}, {r6("control", "right_control_q")}, count(q) points,
 {r6("avg(y)", "mean_y")} from win left join cpts on abs(q-beta)<=0.12::double group by ord, alpha, beta, control""", PEAKS)
MASK = """
gr as (
 select i, x q, exists (select 1 from pkk where ord>=3 and x>=alpha-0.03::double and x<=alpha+0.18::double)
  and not exists (select 1 from win where x>=beta-0.12::double and x<=beta+0.12::double) fit from gp_g
),
"""
cal("k3_fit_mask", f"select vec_id, count(*) fit_points, {r6('avg(y)', 'fit_mean')} from yn join gr using (i) where fit group by 1", PEAKS, curve_ctes(1800), MASK)
cal("k4_fixed_shoulder", f"""select vec_id, {r6("a", "shoulder_positive_area")}, {r6("pk", "shoulder_peak_residual")}, {r6("sl", "reference_fit_scale")},
 {r6("ic", "reference_fit_offset")}, {r6("a/15e-1", "shoulder_mean_positive_residual")} from (
 select vec_id, sum(case when pq is not null then (greatest(r,0)+greatest(pr,0))/2*(q-pq) else 0e0 end) a, max(r) pk, any_value(sl) sl, any_value(ic) ic from (
  select *, lag(q) over w pq, lag(r) over w pr from (
   select yn.vec_id, yn.i, q, y-(sl*ref+ic) r, sl, ic from yn join rf using (i) join ft using (vec_id) where q between 8 and 95e-1)
  window w as (partition by vec_id order by i)) group by 1)""", curve_ctes(500),
    "ft as (select vec_id, regr_slope(y,ref) sl, regr_intercept(y,ref) ic from yn join rf using (i) where not (q between 8 and 95e-1) group by 1),")


def fit_ctes(shifts: tuple[float, ...]) -> str:
    step = 21.0 / 1799
    vals = ",".join(f"({s!r}::double)" for s in shifts)
    return f"""
sh(s) as (values {vals}),
mv as (
 select s, g.i, g.q, fit, case when t=0 then a.ref else a.ref+(b.ref-a.ref)*t end ref, g.q-cm cq from (
  select s, i, q, fit, floor(i-s/{step!r}::double)::int lo, i-s/{step!r}::double-floor(i-s/{step!r}::double) t, avg(q) over (partition by s) cm from gr, sh) g
 left join rf a on a.i=g.lo left join rf b on b.i=g.lo+1
),
mv2 as (select * from mv where ref is not null),
ne as (
 select vec_id, s, count(*)::double n, sum(ref*ref) rr, sum(ref*cq) rc, sum(cq*cq) cc, sum(ref) r, sum(cq) c, sum(ref*y) ry, sum(cq*y) cy, sum(y) y, sum(y*y) yy
 from yn join mv2 using (i) where fit group by 1,2 having count(*)>=10
),
so as (
 select *, rr*(n*cc-c*c)-r*(r*cc-c*rc)+rc*(r*c-n*rc) det, ry*(n*cc-c*c)-r*(y*cc-c*cy)+rc*(y*c-n*cy) da,
  rr*(y*cc-c*cy)-ry*(r*cc-c*rc)+rc*(r*cy-y*rc) db, rr*(n*cy-y*c)-r*(r*cy-y*rc)+ry*(r*c-n*rc) dc from ne
),
ff as (
 select vec_id, first(s order by e, s) s, first(sa order by e, s) sa, first(sb order by e, s) sb, first(sl order by e, s) sl, min(e) e from (
  select vec_id, s, da/det sa, db/det sb, dc/det sl, (yy-da/det*ry-db/det*y-dc/det*cy)/n e from so) group by 1
),
"""


cal("k5_reference_fit", f"""select vec_id, {r6("e", "fit_mean_square")}, {r6("s", "reference_q_shift_nm_inv")}, {r6("sa", "reference_fit_scale")},
 {r6("sb", "reference_fit_offset")}, {r6("sl", "reference_fit_linear_background")} from ff""", PEAKS, curve_ctes(1800), MASK, fit_ctes((-0.05, -0.025, 0.0, 0.025, 0.05)))
AREA = """
wn as (select ord, 1 side, beta centre from win union all select ord, 2, control from win),
rs as (select vec_id, ord, side, mv2.i, mv2.q, greatest(y-(sa*ref+sb+sl*cq),0) r from wn join mv2 on mv2.q>=centre-0.12::double and mv2.q<=centre+0.12::double
 join yn using (i) join ff using (vec_id)),
ar as (
 select vec_id, sum(case when side=1 then x else 0e0 end) la, sum(case when side=2 then x else 0e0 end) ra from (
  select vec_id, side, (r+lag(r) over w)/2*(q-lag(q) over w) x from rs window w as (partition by vec_id, ord, side order by i)) group by 1
),
ks as (select ar.*, greatest(la-ra,0) net, greatest(la-ra,0)/(2*0.12::double*(select count(*) from win)) score from ar),
"""
STUDY = (PEAKS, curve_ctes(1800), MASK, fit_ctes((0.0,)), AREA)
cal("k6_left_shoulder", f"""select vec_id, session_uid, data_batch, {r6("la", "kbeta_left_positive_area")}, {r6("ra", "right_control_positive_area")},
 {r6("net", "kbeta_left_net_area")}, {r6("score", "kbeta_left_mean_net_residual")}, {r6("sa", "reference_fit_scale")}, {r6("sb", "reference_fit_offset")},
 {r6("sl", "reference_fit_linear_background")}, (select count(*)::int from win) n_kbeta_windows,
 (select string_agg(ord::varchar, ',' order by ord) from win) window_orders from ks join ff using (vec_id) join cal using (vec_id)""", *STUDY)
cal("k6_window_rows", f"""select vec_id, ord, {r6("alpha", "alpha_q")}, {r6("beta", "beta_q")}, {r6("control", "right_control_q")},
 {r6("sum(x) filter (side=1)", "left_area")}, {r6("sum(x) filter (side=2)", "right_control_area")} from (
 select vec_id, ord, side, (r+lag(r) over w)/2*(q-lag(q) over w) x from rs window w as (partition by vec_id, ord, side order by i))
 join win using (ord) group by vec_id, ord, alpha, beta, control""", *STUDY)
cal("k7_pass_fail", f"""select vec_id, {r6("score", "agbh_monochromaticity_score")}, score<=75e-4 agbh_monochromaticity_pass,
 case when score<=75e-4 then 'accepted' else 'rejected' end agbh_monochromaticity_status from ks""", *STUDY)
cal("k8_selection_record", """select 'calibration_selection_v0_1' schema_version, 75e-4 max_score, 886e-3 beta_ratio, count(*) rows_total,
 count(*) filter (score<=75e-4) rows_accepted, count(*) filter (score>75e-4) rows_rejected, 'date in' date_op from ks""", *STUDY)
plain("k9_calibrant_integration", f"""with {PX} select measurement_id, count(*)::int points, {r6("sum(intensity)", "profile_sum")},
 {r6("2e0+(min(bin)+5e-1)*21e-2", "q_lo")}, {r6("2e0+(max(bin)+5e-1)*21e-2", "q_hi")} from allbins group by 1""")
sets("k10_batch_policy", """select session_uid, data_batch, case when data_batch in ('3','4','5','7') then 'use' when data_batch in ('1','2','6') then 'exclude'
 else 'review' end batch_policy from sets""")
sets("k11_reference_band", f"""select session_uid, {r6("score")}, {r6("lo", "band_min")}, {r6("md", "band_median")}, {r6("hi", "band_max")} from sc,
 (select min(score) lo, median(score) md, max(score) hi from sc where ok and data_batch='7')""")

# --- J -----------------------------------------------------------------------------------------

META = """
ml as (select measurement_id, "patientId"||'_'||upper(side)||'_'||"position" external_id, age, sample_thickness_mm thickness, specimen_status status from m),
mr as (select measurement_id, external_id, case when measurement_id%7=0 then age+1e0 else age end age, thickness, status from ml where measurement_id%10<>0),
l1 as (select external_id, count(*) n, arg_min(struct_pack(a:=age, t:=thickness, s:=status), measurement_id) v from ml group by 1),
r1 as (select external_id, count(*) n, arg_min(struct_pack(a:=age, t:=thickness, s:=status), measurement_id) v from mr group by 1),
jj as (
 select coalesce(l1.external_id, r1.external_id) external_id, l1.n ln, r1.n rn, l1.v lv, r1.v rv,
  case when l1.n is not null and r1.n is not null then (l1.v.a is distinct from r1.v.a)::int+(l1.v.t is distinct from r1.v.t)::int+(l1.v.s is distinct from r1.v.s)::int else 0 end w
 from l1 full join r1 on l1.external_id=r1.external_id
),
"""
base("j1_external_ids", """select measurement_id, external_id, nullif(regexp_extract(external_id,'^(.+)_(LEFT|RIGHT)_(P\\w+)$',1),'') ext_patient,
 nullif(regexp_extract(external_id,'^(.+)_(LEFT|RIGHT)_(P\\w+)$',2),'') ext_side, nullif(regexp_extract(external_id,'^(.+)_(LEFT|RIGHT)_(P\\w+)$',3),'') ext_position from ml""", META)
base("j2_reconciliation", """select sum(coalesce(ln,0))::bigint left_rows, sum(coalesce(rn,0))::bigint right_rows, count(ln) left_keys, count(rn) right_keys,
 count(*) filter (ln>1) left_duplicate_keys, count(*) filter (rn>1) right_duplicate_keys, count(*) filter (ln is not null and rn is not null) matched_keys,
 count(*) filter (rn is null) left_only_keys, count(*) filter (ln is null) right_only_keys, sum(w)::bigint mismatch_rows,
 count(*) filter (w>0) mismatched_keys from jj""", META)
for name in ("j2_mismatch_rows", "j2_mismatch_fields"):
    base(name, """select external_id, field, left_value, right_value from (
 select external_id, 'age' field, lv.a::decimal(18,6)::varchar left_value, rv.a::decimal(18,6)::varchar right_value, lv.a is distinct from rv.a differs, ln, rn from jj
 union all select external_id, 'thickness', lv.t::decimal(18,6)::varchar, rv.t::decimal(18,6)::varchar, lv.t is distinct from rv.t, ln, rn from jj
 union all select external_id, 'status', lv.s, rv.s, lv.s is distinct from rv.s, ln, rn from jj
) where ln is not null and rn is not null and differs""", META)
FIX = "case when measurement_id%3=0 then null else (measurement_id%50+20)::double end"
base("j3_backfill", f"""select measurement_id, coalesce(sample_thickness_mm, {FIX}) sample_thickness_mm, sample_thickness_mm sample_thickness_mm_old,
 sample_thickness_mm is null and {FIX} is not null sample_thickness_mm_backfilled from m""")
base("j3_backfill_summary", f"""select count(*) filter (sample_thickness_mm is null) missing_before,
 count(*) filter (sample_thickness_mm is null and {FIX} is not null) backfilled_rows,
 count(*) filter (coalesce(sample_thickness_mm, {FIX}) is null) missing_after from m""")


# --- U -----------------------------------------------------------------------------------------

base("u1_step_chain", f"""select c.measurement_id, c."patientId", product_status_group, px patient_product_diagnosis, n specimen_measurement_count,
 {r6("v", "radial_profile_value_at_q")}, {r6("s", "profile_sum")}
 from (select *, count(*) over (partition by "specimenId") n from lc) c
 join (select r.measurement_id, arg_min(y/b, abs(q-14)) v, sum(y/b) s from rawpts r join band using (measurement_id) group by 1) using (measurement_id)
 join (select "patientId", max(product_status_group) px from labelled group by 1) d on d."patientId"=c."patientId" where v>8e-1""",
     """labelled as (select * from lab where "position" in ('P1','P2','P3') and sample_thickness_mm is not null
  and calibrant_thickness_mm is not null and poni_q_max_nm_inv>=23 and specimen_status<>'NA'
  and case when linked_agbh_session_uid is null then started_on not in (date '2025-02-14', date '2025-03-04')
   else linked_agbh_session_uid not in ('cal_1','cal_5','cal_9') end),
lq as (select * from labelled where sample_thickness_mm>0 and calibrant_thickness_mm between 2 and 40),
lc as (select * from lq where "patientId" in (select "patientId" from lq where biopsy) and product_status_group is not null),""")
base("u2_prediction_route", f"""select measurement_id, "patientId", case when specimen_status in ('CANCER','ATYPICAL','PRE_CANCEROUS') then 'CANCER'
 when specimen_status in ('BENIGN','NORMAL') then specimen_status end product_status_group, c specimen_measurement_count,
 {r6("v", "radial_profile_value_at_q")} from (select *, count(*) over (partition by "specimenId") c from qc)
 join (select r.measurement_id, arg_min(y/b, abs(q-14)) v from rawpts r join band using (measurement_id) group by 1) using (measurement_id) where v>8e-1""")
base("u3_profile_hook", f"select measurement_id, {r6('max(y)-min(y)', 'spread')} from rawpts group by 1")
base("u3_case_hook", f"""select pid "patientId", case sn when 'LEFT' then 'Left' else 'Right' end side, {r6("max(y)-min(y)", "spread")} from rawpts group by pid, sn""")
