"""SQL twins of the queries that apply the fixed model, fit a model, or write reports.

The fixed numbers are those of ``bilatera.plans.frozen``, written out again. Fits are solved here by plain Newton or gradient steps in
recursive queries, not by the methods of the library.
"""

from __future__ import annotations

from .sql import BASE, CORE4, CURVE, FULL, LOGIT, OOF, PAIRS, SETS, SV, SV_OOF, r6

ORACLES: dict[str, str] = {}


def put(name: str, select: str, *ctes: str) -> None:
    text = "".join(ctes).rstrip().rstrip(",")
    ORACLES[name] = f"with recursive {text}\n{select}"


# --- the fixed model -----------------------------------------------------------------------------

FW = """
fw as (select i, ((7*i%11-5)::double/40e0)/(1e0+(i%3)::double/2e0) w, 1e0+(i%5)::double/1e1 mean from range(0,64) t(i)),
rp as (
 select measurement_id, pid, sn, 1/(1+exp(-(1e-1-(select sum(w*mean) from fw)+sum(y*w)))) p from gpts join fw using (i) group by 1,2,3
),
"""


def logit_mean(p: str) -> str:
    return f"1/(1+exp(-avg({LOGIT(p)})))"


def evidence(only: str = "") -> str:
    return f"""ev as (select pid, sn, avg(p) pm, {logit_mean('p')} la, count(*) n from rp {only} group by 1,2),
"""


def cut(text: str, first: str, last: str, new: str) -> str:
    a = text.index(first)
    return text[:a] + new + text[text.index(last, a):]


#: Training cohort: first-stage scores of biopsied rows by the fixed model.
COHORT = cut(BASE, "rowp as (", "roll as (", FW + evidence("where measurement_id in (select measurement_id from g where biopsy)"))

#: Prediction rows: technical filters only; both sides of every request, the other one with its gate off.
REQUESTS = """req as (
 select distinct "patientId" pid, case when substr("patientId",2)::bigint%2=0 then 'LEFT' else 'RIGHT' end sn from m
),
cases as (
 select t.pid||'::'||t.sn target_case_id, t.pid, t.sn, o.sn osn, null::int as label, t.n tn, coalesce(o.n,0) cn, 'target' role
 from req join sides t on t.pid=req.pid and t.sn=req.sn left join sides o on o.pid=t.pid and o.sn<>t.sn
 union all
 select o.pid||'::'||o.sn, o.pid, o.sn, t.sn, null, o.n, t.n, 'contralateral'
 from req join sides t on t.pid=req.pid and t.sn=req.sn join sides o on o.pid=t.pid and o.sn<>t.sn
),
"""
PREDICTION = cut(BASE, "kept as (", "rawpts as (", "cohort as (select * from qc),\n")
PREDICTION = cut(PREDICTION, "cases as (", "rowp as (", REQUESTS)
PREDICTION = cut(PREDICTION, "rowp as (", "roll as (", FW + evidence())

BASE3 = (("la", 0.5, 0.45, 0.2), ("age", 50.0, 55.0, 12.0), ("age_available", 1.0, 0.9, 0.3))
PAIRED = tuple(zip(CORE4, (0.5, 0.1, 0.1, 0.3), (0.3, 0.05, 0.05, 0.2)))


def final_score(coef: tuple[float, ...], intercept: float, gate: str) -> str:
    terms = [f"{w!r}::double*(({c})::double-{m!r})/{s!r}" for w, (c, _, m, s) in zip(coef, BASE3)]
    terms += [f"(case when {gate}=1 then {w!r}::double*({c}-{m!r})/{s!r} else 0e0 end)" for w, (c, m, s) in zip(coef[3:], PAIRED)]
    return f"1/(1+exp(-({intercept!r}::double+" + "+".join(terms) + ")))"


COEF, PLAIN_COEF = (1.2, 0.4, -0.3, 0.7, 0.5, -0.6, 0.2), (1.0, 0.3, -0.2, 0.0, 0.0, 0.0, 0.0)

put("m2_profile_scores", f"select measurement_id, {r6('p')} from rp", COHORT)
put("m23_routed_scores", f"""select target_case_id, case when symmetry_available=1 then 'paired' else 'fallback_no_symmetry' end model_route,
 {r6(f"case when symmetry_available=1 then {final_score(COEF, -0.2, 'symmetry_available')} else {final_score(PLAIN_COEF, -0.1, 'symmetry_available')} end", "p_cancer")},
 case when symmetry_available=1 then 45e-2 else 5e-1 end threshold from full_f""", COHORT, PAIRS, FULL)

# Calibration by Newton steps of bounded length; ``svx`` holds k, y and the logit.
NEWTON = f"""svx as (select k, y, {LOGIT('p')} x from sv),
nw as (
 select distinct k, 0 step, 0e0 a, 1e0 b from svx
 union all
 select k, step+1, a-da*least(1e0, 5e-1/greatest(abs(da),abs(db),1e-9)), b-db*least(1e0, 5e-1/greatest(abs(da),abs(db),1e-9)) from (
  select k, step, a, b, (h11*g0-h01*g1)/(h00*h11-h01*h01) da, (h00*g1-h01*g0)/(h00*h11-h01*h01) db from (
   select k, step, a, b, sum(m-y) g0, sum((m-y)*x)+b/1e6 g1, sum(m*(1-m)) h00, sum(m*(1-m)*x) h01, sum(m*(1-m)*x*x)+1e-6 h11
   from (select nw.k, step, a, b, y, x, 1/(1+exp(-(a+b*x))) m from nw join svx on svx.k=nw.k where step<25) group by 1,2,3,4))
),
"""
put("m9_calibration", f"select k split_id, {r6('a', 'calibration_intercept')}, {r6('b', 'calibration_slope')} from nw where step=25",
    OOF.rstrip() + ",", SV_OOF + ",", NEWTON)
put("m10_fit_record", f"""select 'in_sample_not_independent' evaluation_status, tp+tn+fp+fn target_cases, tp+fn cancer_target_cases, tn+fp benign_target_cases,
 45e-2 decision_threshold, {", ".join(r6(c) for c in ("roc_auc", "pr_auc", "sensitivity", "specificity", "balanced_accuracy", "ppv", "npv", "brier_score", "log_loss"))},
 {r6("a", "calibration_intercept")}, {r6("b", "calibration_slope")}, tp true_positives, tn true_negatives, fn false_negatives, fp false_positives
 from rt join nw using (k) where step=25""", COHORT, PAIRS, FULL,
    f"sv as (select 0 k, label y, {final_score(COEF, -0.2, 'symmetry_available')} p, 45e-2 t from full_f),", CURVE.replace("cf as (", "cfm as (").replace("from cf join", "from cfm join").rstrip() + ",", NEWTON)

# --- requests, scores, reports -------------------------------------------------------------------

MADE = """mt as (
 select pid, sn, case when count(distinct o)=1 then min(o) end operator_id, 's'||pid session_uid, min(started_on)::varchar started_at
 from (select "patientId" pid, upper(side) sn, started_on, case when measurement_id%4<>3 then 'op'||substr("patientId",5,1) end o from g) group by 1,2
),
asked as (
 select f.*, cases.role, cases.osn, ev.pm, ev.la, ev.n en, specimens, measurements, age, age_available, operator_id, session_uid, started_at,
  case when symmetry_available=1 and target_measurements>=2 and contralateral_measurements>=2 then 'high' when target_measurements>=2 then 'medium' else 'low' end lv,
  case when symmetry_available=1 and target_measurements>=2 and contralateral_measurements>=2 then 'at least 2 valid measurements per breast; symmetry refinement applied'
   when symmetry_reason='sk_core4_not_computable' then 'symmetry features could not be computed; symmetry refinement not applied'
   when contralateral_measurements=0 then 'contralateral breast unavailable after preprocessing; symmetry refinement not applied'
   when target_measurements>=2 then 'fewer than 2 valid contralateral-breast measurements; symmetry refinement not applied'
   else 'fewer than 2 valid target-breast measurements' end rs
 from f join cases using (target_case_id) join ev on ev.pid=f.pid and ev.sn=f.sn join roll on roll.pid=f.pid left join mt on mt.pid=f.pid and mt.sn=f.sn
),
"""
SIDE = lambda c: f"case {c} when 'LEFT' then 'Left' when 'RIGHT' then 'Right' else '' end"
put("m18_request_features", f"""select pid "patientId", target_case_id, {SIDE('sn')} target_side, {SIDE('osn')} contralateral_side,
 {r6("la", "profile_p_cancer_logit_average")}, {r6("pm", "profile_p_cancer_probability_mean")}, en profile_p_cancer_n_measurements, {r6("age")}, age_available,
 specimens, measurements, symmetry_available, symmetry_reason, target_measurements, contralateral_measurements, {", ".join(r6(c) for c in CORE4)},
 lv result_reliability, rs result_reliability_reason, operator_id, session_uid, started_at from asked where role='target'""", PREDICTION, PAIRS, MADE)

SCORED = f"""{SV},
rd as (select p rp, y ry from sv),
rq0 as (
 select * replace (case when role='contralateral' then 0 else symmetry_available end as symmetry_available,
  case when role='contralateral' then 'low' else lv end as lv,
  case when role='contralateral' then 'SK symmetry refinement is intentionally unavailable for contralateral scoring' else rs end as rs) from asked
),
rq1 as (select *, {final_score(COEF, -0.2, "symmetry_available")} pc from rq0),
rq2 as (
 select rq1.*, {LOGIT("pc")}-{LOGIT("45e-2")} d, (select count(*) from rd where rp<=pc)::double/(select count(*) from rd) qa,
  (select count(*) from rd where ry=0 and rp<=pc)::double/(select count(*) from rd where ry=0) qb,
  (select count(*) from rd where ry=1 and rp<=pc)::double/(select count(*) from rd where ry=1) qc from rq1
),
rq3 as (select *, case when d<-5e-1 then 1 when d<0 then 2 when d<5e-1 then 3 when d<15e-1 then 4 else 5 end::int tier, case when pc>=45e-2 then 'high' else 'low' end lvl from rq2),
"""
REQ = (PREDICTION, PAIRS, MADE, SCORED)
put("m19_two_sided_scores", f"""select pid "patientId", role, {SIDE('sn')} target_side, symmetry_available, {r6("pc", "p_cancer")}, lvl target_class_risk_level,
 pc>=45e-2 biopsy_required, tier, lv result_reliability, {r6("qa", "percentile_all")}, {r6("qb", "percentile_reference_class")}, {r6("qc", "percentile_target_class")} from rq3""", *REQ)
ID = lambda case: f"substr(sha256('two_stage_gated_v1|'||{case}),1,16)"
put("m20_profile_evidence", f"""select {ID("c.pid||'::'||case when role='target' then c.sn else c.osn end")} report_id, lower(c.sn) side, role, measurement_id, round_even(p,5) p
 from cases c join rp on rp.pid=c.pid and rp.sn=c.sn""", PREDICTION)


def number(x: str) -> str:
    """Report number as text."""
    return f"coalesce(round_even({x},5)::varchar,'unknown')"


META = {
    "patient_id": "t.pid", "target_side": "lower(t.sn)", "patient_age": f"case when t.age_available=1 then {number('t.age')} else 'unknown' end",
    "patient_age_available": "t.age_available=1", "session_id": "coalesce(t.session_uid,'unknown')", "scan_date_time": "coalesce(t.started_at,'unknown')",
    "operator_id": "coalesce(t.operator_id,'unknown')", **{c: "'unknown'" for c in (
        "hardware_version", "eoscan_version", "experimental_protocol_version", "mammography_suspicious_field", "mammography_conclusion")},
    "measurement_summary__target_valid_measurements": "t.target_measurements", "measurement_summary__contralateral_available": "t.contralateral_measurements>0",
    "measurement_summary__contralateral_valid_measurements": "t.contralateral_measurements",
}
METRICS = {"dataset": "'train_on_all_target_breast_cases'", "validation": "'not_performed'", "sensitivity": "'0.95'", "specificity": "'0.625'"}
HEAD = {"created_at": "'2026-01-01T00:00:00+01:00'", "analysis_author": "'author'", "prediction_comment": "''"}


def columns(fields: dict[str, str]) -> str:
    return ",\n ".join(f'{x} as "{n}"' for n, x in fields.items())


put("m21_external_report", "select " + columns({
    "output_type": "'external_report'", "report_version": "'0.6'", "report_id": ID("t.target_case_id"), **HEAD,
    **{k: META[k] for k in ("patient_id", "patient_age", "target_side", "mammography_suspicious_field", "scan_date_time", "operator_id", "hardware_version", "eoscan_version")},
    "model_name": "'two_stage_gated'", "model_version": "'1'", **{f"model_metrics__{k}": v for k, v in METRICS.items()},
    "risk_probability": "round_even(t.pc,5)", "target_class_risk_level": "t.lvl", "decision_threshold": "45e-2", "biopsy_required": "t.pc>=45e-2",
    "reliability": "t.lv", "reliability_reason": "t.rs",
}) + " from rq3 t where t.role='target'", *REQ)


def breast(role: str, a: str) -> dict[str, str]:
    has = f"{a}.target_case_id is not null"
    word = lambda x: f"coalesce({x},'unknown')"
    known = lambda x: f"case when {has} then {x} else 'unknown' end"
    out = {
        "available": has, "side": word(f"lower({a}.sn)"), "azimuthal_integration_profile__p_cancer": number(f"{a}.la"),
        "azimuthal_integration_profile__measurement_evidence__report_id": f"case when {has} then {ID('t.target_case_id')} end",
        "azimuthal_integration_profile__measurement_evidence__side": word(f"lower({a}.sn)"),
        "azimuthal_integration_profile__measurement_evidence__rows": f"coalesce({a}.en,0)",
        "final_prediction__p_cancer": number(f"{a}.pc"), "final_prediction__reference_class": "'BENIGN'", "final_prediction__target_class": "'CANCER'",
    }
    if role == "target":
        out |= {"final_prediction__target_class_risk_level": f"{a}.lvl", "final_prediction__biopsy_required": f"{a}.pc>=45e-2"}
    return out | {
        "final_prediction__level": word(f"'TRA '||{a}.tier::varchar"),
        "final_prediction__score_percentiles__reference_population": known("'train_on_all_target-breast_cases'"),
        "final_prediction__score_percentiles__all": known(number(f"{a}.qa")),
        "final_prediction__score_percentiles__reference_class": known(number(f"{a}.qb")),
        "final_prediction__score_percentiles__target_class": known(number(f"{a}.qc")),
        "reliability__level": word(f"{a}.lv"), "reliability__reason": word(f"{a}.rs"), "symmetry__available": f"coalesce({a}.symmetry_available=1,false)",
        "model_execution__scoring_path": f"case when not ({has}) then 'unknown' when {a}.symmetry_available=1 then 'azimuthal_integration_age_with_symmetry' else 'azimuthal_integration_age' end",
    } | ({"reason": f"case when not ({has}) then 'contralateral breast is unavailable after preprocessing' end"} if role == "contralateral" else {})


INTERNAL = "select " + columns({
    "output_type": "'internal_clinical_report'", "report_version": "'0.9'", "report_id": ID("t.target_case_id"), **HEAD,
    "model__id": "'two_stage_gated_v1'", "model__name": "'two_stage_gated'", "model__version": "'1'", **{f"model_metrics__{k}": v for k, v in METRICS.items()},
    "decision_threshold__threshold_id": "'target_sensitivity_0.95'", "decision_threshold__threshold": "45e-2", "decision_threshold__applies_to": "'target.final_prediction'",
    **{f"scan_metadata__{k}": v for k, v in META.items()},
    **{f"breast_predictions__{role}__{k}": v for role, a in (("target", "t"), ("contralateral", "o")) for k, v in breast(role, a).items()},
}) + " from rq3 t left join rq3 o on o.pid=t.pid and o.role='contralateral' where t.role='target'"
put("m22_internal_report", INTERNAL, *REQ)
put("a8_report_sink", INTERNAL, *REQ)

# --- fits: accelerated gradient steps on the penalised loss --------------------------------------


def gradient_fit(p: int, steps: int, ridge: float = 10.0) -> str:
    """CTE ``fit`` with the coefficients ``b`` (first the intercept, which has no penalty) for rows xs (y, w, x of ``p`` + 1 numbers)."""
    n = p + 1
    return f"""
lip as (select 25e-2*sum(w*list_dot_product(x,x))+{ridge!r} l from xs),
mom as (select l, (sqrt(l/{ridge!r})-1)/(sqrt(l/{ridge!r})+1) th from lip),
it as (
 select 0 step, list_transform(range(0,{n}), lambda i: 0e0) b, list_transform(range(0,{n}), lambda i: 0e0) pr
 union all
 select step+1, list(nb order by i), any_value(b) from (
  select step, b, i, v[i]-(sum(r*x[i])+case when i=1 then 0e0 else {ridge!r}*v[i] end)/any_value(l) nb from (
   select step, b, v, l, x, w*(1/(1+exp(-list_dot_product(v,x)))-y) r from (
    select step, b, l, list_transform(range(1,{n + 1}), lambda i: b[i]+th*(b[i]-pr[i])) v from it, mom where step<{steps}) t, xs), range(1,{n + 1}) u(i)
  group by step, b, v, i) group by step
),
fit as (select b from it where step={steps}),
"""


BALANCED = "case when y=1 then n/(2e0*np) else n/(2e0*(n-np)) end"
put("m1_profile_fit", f"""select 'lr1.mean' param, i::int ix, {r6("mean", "value", 4)} from st union all select 'lr1.scale', i::int, {r6("sc", "value", 4)} from st
 union all select 'lr1.coef', (i-2)::int, {r6("b[i]", "value", 4)} from fit, range(2,66) t(i) union all select 'lr1.intercept', 0, {r6("b[1]", "value", 4)} from fit""",
    BASE, f"""s1p as (select p.measurement_id, p.i, (product_status_group='CANCER')::int y from gpts p join g using (measurement_id) where biopsy),
st as (select i, avg(y0) mean, case when stddev_pop(y0)<=1e-12*(1+abs(avg(y0))) then 1e0 else stddev_pop(y0) end sc from (select i, gp2.y y0 from s1p join gpts gp2 using (measurement_id, i)) group by i),
xs0 as (select s.measurement_id, any_value(s.y) y, [1e0] || list((gp2.y-mean)/sc order by i) x from s1p s join gpts gp2 using (measurement_id, i) join st using (i) group by 1),
xs as (select y, {BALANCED} w, x from xs0, (select count(*)::double n, sum(y)::double np from xs0)),
""",
    gradient_fit(64, 500))

NAMED = (("la", "profile_p_cancer_logit_average"), ("age", "age"), ("age_available", "age_available"))
STATS = [(f"lr2.{c}", c) for c in (
    *[f"{k}_{n}" for _, n in NAMED for k in ("fill", "mean", "std")], *[f"{k}_{n}" for n in CORE4 for k in ("mean", "std")])]
put("m3_gated_fit", " union all ".join(f"select '{label}' param, 0 ix, {r6(column, 'value', 4)} from gs" for label, column in STATS)
    + f" union all select 'lr2.coef', (i-2)::int, {r6('b[i]', 'value', 4)} from fit, range(2,9) t(i) union all select 'lr2.intercept', 0, {r6('b[1]', 'value', 4)} from fit",
    COHORT, PAIRS, FULL, "gs as (select " + ", ".join(
        [f"median({c}::double) fill_{n}, avg({c}::double) mean_{n}, stddev_pop({c}::double) std_{n}" for c, n in NAMED]
        + [f"avg({n}) filter (symmetry_available=1) mean_{n}, stddev_pop({n}) filter (symmetry_available=1) std_{n}" for n in CORE4]) + " from full_f),\n",
    "xs0 as (select label y, [1e0, " + ", ".join(
        [f"({c}::double-mean_{n})/case when std_{n}>1e-12 then std_{n} else 1e0 end" for c, n in NAMED]
        + [f"case when symmetry_available=1 then ({n}-mean_{n})/case when std_{n}>1e-12 then std_{n} else 1e0 end else 0e0 end" for n in CORE4]) + "] x from full_f, gs),\n",
    f"xs as (select y, {BALANCED} w, x from xs0, (select count(*)::double n, sum(y)::double np from xs0)),\n", gradient_fit(7, 300))

# --- pooled evaluation -----------------------------------------------------------------------------

POOLED = ("roc_auc", "pr_auc", "sensitivity", "specificity", "balanced_accuracy", "ppv", "npv", "brier_score", "log_loss")
# Replicate -1 is the pooled table itself.
put("m26_pooled_summary", "select * from (" + " union all ".join(
    f"select '{c}' metric, {r6(f'max({c}) filter (k=-1)', 'pooled')}, {r6(f'quantile_cont({c},0.025) filter (k>=0)', 'ci_low')}, "
    f"{r6(f'quantile_cont({c},0.975) filter (k>=0)', 'ci_high')}, count({c}) filter (k>=0) replicates, any_value(pn) patients, any_value(cn) cases from rt, sizes"
    for c in POOLED) + ")",
    OOF.rstrip() + ",", """
bc as (select target_case_id, min("patientId") pid, min(label) y, avg(p_cancer) p, avg(threshold_target) t from oof group by 1),
sizes as (select count(distinct pid) pn, count(*) cn from bc),
ix as (select pid, row_number() over (order by md5(pid), pid)-1 ix from (select distinct pid from bc)),
dr as (select b::int b, ('0x'||substr(md5('42:'||b::varchar||':'||ix::varchar),1,12))::bigint % (select count(*) from ix) ix from ix, range(0,200) t(b)),
sv as (select b k, y, p, t from dr join ix using (ix) join bc using (pid) union all select -1, y, p, t from bc),
""", CURVE)

# --- files, selections, pixels -----------------------------------------------------------------------

put("a7_file_digests", "select c_nationkey::int nation, octet_length(encode(v)) length, sha256(v) sha256 from t",
    "t as (select c_nationkey, c_nationkey||','||count(*)||','||sum(c_custkey)||chr(10) v from customer group by 1)")
put("k8_selection_round_trip", """select file_name, linked_agbh_session_uid from r
 where case when linked_agbh_session_uid is null then d is null or d not in (select started_at::date from sc where not ok and started_at is not null)
 else linked_agbh_session_uid not in (select session_uid from sc where not ok) end""", SETS.rstrip() + ",", """
r as (select file_name, case when event_id%10=7 then null else 's'||(event_id//2)::varchar end linked_agbh_session_uid, started_at::date d from sets)""")
put("u1_pixel_route", f"""select measurement_id, "patientId", {r6("qm", "poni_q_max_nm_inv")}, {r6("tf", "thickness_factor")}, {r6("db", "snr_db")},
 {r6("v", "radial_profile_value_at_q")}, points, {r6("s", "profile_sum")} from (
 select measurement_id, any_value("patientId") "patientId", any_value(qm) qm, any_value(tf) tf, any_value(db) db, arg_min(y/md, abs(q-14)) v, count(*)::int points, sum(y/md) s
 from (select *, median(y) over (partition by measurement_id) md from pr) group by 1) where v>5e-1""", BASE, """
geo as (
 select *, calibrant_thickness_mm/sample_thickness_mm tf, 4*pi()/(56e-12*1e9)*sin(atan(sqrt(pow(greatest(0.01::double,512*55e-6-0.01::double),2)+pow(greatest(0.02::double,768*55e-6-0.02::double),2))/((10+measurement_id%10)::double/1e2))/2) qm
 from lab where "position" in ('P1','P2','P3') and sample_thickness_mm>0 and calibrant_thickness_mm between 2 and 40
),
pxl as (
 select l_orderkey measurement_id, floor((2e0+21e0*(l_partkey%997)::double/997e0-2e0)/21e0*100)::int bin, l_extendedprice/1e2 counts,
  (l_partkey%997)::double/997e0/2e0 radius from lineitem
),
bn as (select measurement_id, bin, avg(counts) y, sqrt(sum(counts))/count(*) sg from pxl where not (counts>=500 and radius>4e-2) group by 1,2),
pr as (
 select geo.measurement_id, "patientId", qm, tf, 2e0+(bin+5e-1)*21e-2 q, y*tf y, 20*log10(avg(y) over w/avg(sg) over w) db
 from geo join bn using (measurement_id) where qm>=23 window w as (partition by geo.measurement_id) qualify db>=20
),
""")
