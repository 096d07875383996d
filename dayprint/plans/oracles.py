"""Plain SQL for the named queries, written apart from the Spark jobs."""

import re

from dayprint.constants import (
    DOMAINS,
    EXTREME_THRESHOLDS,
    FACTOR_DESCRIPTIONS,
    FEATURES,
    LEVELS,
    NUMERIC_FEATURES,
    RANGES,
)
from dayprint.functions.explanations import CONTEXT, NOTES, OBSERVATIONS
from dayprint.functions.suggestions import (
    CORE_FIELDS,
    CORE_TEXTS,
    RENEWABLE_CUTOFF,
    SERVICE_FIELDS,
    SERVICE_TEXTS,
)

Y, LV = "carbon_footprint_kg", "carbon_impact_level"
FEATURE_LIST = ", ".join(FEATURES)
CORRELATED = NUMERIC_FEATURES + [Y]
MODE_W = "case transport_mode when 'Walk' then 0.1 when 'Bike' then 0.2 when 'Bus' then 0.5 when 'EV' then 0.7 when 'Car' then 1.0 end::double"
FOOD_W = "case food_type when 'Veg' then 0.2 when 'Mixed' then 0.5 when 'Non-Veg' then 0.8 end::double"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def level_of(x: str, low: float = 6.5, high: float = 10.5) -> str:
    return f"case when {x} < {low} then 'Low' when {x} <= {high} then 'Medium' when {x} > {high} then 'High' else 'Medium' end"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def decimal_round(x: str, places: int) -> str:
    """Rounds the shortest decimal text of a number, half away from zero."""
    return f"round(cast(cast({x} as varchar) as decimal(38,18)), {places})::double"


# Named parts; each may use the ones it mentions.
CTES: dict[str, str] = {}

CTES["activity"] = """
with b as (select event_id, user_id, ts, event_type, value, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events),
f as (select event_id as record_id, user_id, cast(ts as date) as activity_date,
 case when substr(dayname(cast(ts as date)),1,1)='S' then 'Weekend' else 'Weekday' end as day_type,
 case event_type when 'view' then 'Walk' when 'click' then 'Bike' when 'signup' then 'Bus' when 'error' then 'EV' else 'Car' end as transport_mode,
 least(round(value/cast(5 as double),2),cast(98 as double)) as distance_km,
 cast(2 as double) + ((event_id*37)%181)/cast(10 as double) as electricity_kwh,
 cast(k as double) as renewable_usage_pct,
 case ((event_id*31)%97)%3 when 0 then 'Veg' when 1 then 'Mixed' else 'Non-Veg' end as food_type,
 ((event_id*13)%121)/cast(10 as double) as screen_time_hours,
 cast(0.1 as double)+((event_id*7)%19)/cast(10 as double) as waste_generated_kg,
 cast(((event_id*17)%89)%6 as int) as eco_actions,
 ((event_id*101)%211-105)/cast(70 as double) as noise from b),
g as (select *, cast(3.500013 as double)
 + cast(case transport_mode when 'Walk' then 0.1 when 'Bike' then 0.2 when 'Bus' then 0.5 when 'EV' then 0.7 else 1.0 end as double)*distance_km*cast(0.12 as double)
 + electricity_kwh*(100-renewable_usage_pct)/100*cast(0.35 as double)
 + cast(case food_type when 'Veg' then 0.2 when 'Mixed' then 0.5 else 0.8 end as double)*2
 + waste_generated_kg*cast(0.8 as double) + screen_time_hours*cast(0.1 as double) - eco_actions*cast(0.15 as double) + noise as y from f)
select record_id,user_id,activity_date,day_type,transport_mode,distance_km,electricity_kwh,renewable_usage_pct,food_type,screen_time_hours,waste_generated_kg,eco_actions,
 round(y,4) as carbon_footprint_kg,
 case when round(y,4)<cast(6.5 as double) then 'Low' when round(y,4)<=cast(10.5 as double) then 'Medium' else 'High' end as carbon_impact_level from g
"""
CTES["activity_raw"] = """
select record_id, user_id, carbon_footprint_kg,
 case when record_id%41=3 then 'Holiday' when record_id%43=5 then null else day_type end as day_type,
 case when record_id%37=2 then 'Rocket' else transport_mode end as transport_mode,
 case when record_id%29=1 then '150.0' when record_id%31=7 then 'invalid' else cast(distance_km as varchar(30)) end as distance_km,
 case when record_id%47=9 then '-5.0' when record_id%53=11 then null else cast(electricity_kwh as varchar(30)) end as electricity_kwh,
 cast(renewable_usage_pct as varchar(30)) as renewable_usage_pct, food_type,
 case when record_id%59=13 then '25.0' else cast(screen_time_hours as varchar(30)) end as screen_time_hours,
 cast(waste_generated_kg as varchar(30)) as waste_generated_kg,
 case when record_id%61=17 then '15' else cast(eco_actions as varchar(30)) end as eco_actions
from activity
"""
CTES["coerced"] = (
    "select record_id, carbon_footprint_kg as measured_kg, day_type, transport_mode, food_type, "
    + ", ".join(f"try_cast({c} as double) as {c}" for c in NUMERIC_FEATURES)
    + " from activity_raw"
)
MISSING = [f"case when {c} is null then 'Missing required field: {c}' end" for c in FEATURES]
DOMAIN = [
    f"case when {c} not in ({', '.join(map(q, v))}) then {q(c + ' must be one of: [' + ', '.join(repr(x) for x in v) + ']')} end"
    for c, v in DOMAINS.items()
]
RANGE = [
    f"case when not ({c} between {lo} and {hi}) then '{c} must be between {lo} and {hi}' end"
    for c, (lo, hi) in RANGES.items()
]
ANY_MISSING = " or ".join(f"{c} is null" for c in FEATURES)


def joined(parts: list[str], sep: str) -> str:
    return f"concat_ws('{sep}', {', '.join(parts)})"


CTES["checked"] = f"""
select *, case when {ANY_MISSING} then {joined(MISSING, '; ')} else {joined(DOMAIN + RANGE, '; ')} end as messages,
 case when {ANY_MISSING} then {joined(MISSING, ', ')} else {joined(DOMAIN + RANGE, ', ')} end as comma_messages,
 (select count(x) from unnest(case when {ANY_MISSING} then [{', '.join(MISSING)}] else [{', '.join(DOMAIN + RANGE)}] end) t(x))::int as n_errors,
 coalesce({', '.join(MISSING + DOMAIN + RANGE)}) as first_message
from coerced
"""
CTES["sp"] = "select *, case when substr(md5(record_id::varchar || ':42'),1,8) < '33333333' then 'test' else 'train' end as split from activity"
CTES["seg"] = f"""
select transport_mode, food_type, round(avg({Y}),6) as segment_mean,
 {', '.join(f"round(avg(case when {LV}='{v}' then 1.0 else 0.0 end),6) as p_{v.lower()}" for v in LEVELS)}
from sp where split='train' group by all
"""
CTES["lin"] = f"select round(regr_slope({Y}, electricity_kwh),6) as slope, round(regr_intercept({Y}, electricity_kwh),6) as intercept from sp where split='train'"
CTES["pred"] = f"""
select *, {level_of('segment_mean')} as segment_level, {level_of('linear_pred')} as linear_level
from (select sp.*, segment_mean, p_low, p_medium, p_high, {decimal_round('intercept + slope*electricity_kwh', 6)} as linear_pred
 from sp left join seg using (transport_mode, food_type) cross join lin)
"""
CTES["test"] = "select * from pred where split='test'"
CTES["longp"] = f"""
select record_id, split, 'linear' as algorithm, {Y} as label, linear_pred as prediction, {LV} as level, linear_level as predicted_level from pred
union all select record_id, split, 'segment', {Y}, segment_mean, {LV}, segment_level from pred
"""
CTES["stats"] = f"select avg({Y}) as m, stddev_samp({Y}) as s, min({Y}) as lo, max({Y}) as hi from sp where split='train'"


def reg_metrics(label: str, pred: str) -> dict[str, str]:
    e = f"({label}-{pred})"
    r2 = f"1 - sum({e}*{e})/nullif(sum({label}*{label}) - sum({label})*avg({label}),0)"
    return {
        "n": "count(*)",
        "mse": f"avg({e}*{e})",
        "rmse": f"sqrt(avg({e}*{e}))",
        "mae": f"avg(abs({e}))",
        "mape": f"avg(abs({e})/nullif(abs({label}),0))",
        "r2": r2,
        "mean_residual": f"avg({e})",
        "std_residual": f"stddev_pop({e})",
        "within_1kg_pct": f"avg(case when abs({e})<=1.0 then 1.0 else 0.0 end)*100",
        "within_2kg_pct": f"avg(case when abs({e})<=2.0 then 1.0 else 0.0 end)*100",
        "explained_variance": r2,
        "explained_variance_true": f"1 - var_pop({e})/nullif(var_pop({label}),0)",
    }


def metric_columns(label: str, pred: str, names: list[str] | None = None) -> str:
    found = reg_metrics(label, pred)
    return ", ".join(
        (f"{found[n]} as {n}" if n == "n" else f"round({found[n]},6) as {n}")
        for n in (names or list(found))
    )


CTES["base_metrics"] = f"""
select 'regression' as task, model, metric, value from (
 select algorithm as model, {metric_columns('label', 'prediction', ['rmse', 'r2', 'mae'])}
 from longp where split='test' group by algorithm) unpivot (value for metric in (rmse, r2, mae))
"""
CTES["wide_metrics"] = """
select task, model, max(value) filter (metric='r2') as r2, max(value) filter (metric='rmse') as rmse, max(value) filter (metric='mae') as mae
from base_metrics group by task, model
"""
CTES["confusion"] = f"select {LV} as label, linear_level as prediction, count(*) as n from test group by all"
CTES["per_class"] = """
select class, coalesce(hits/nullif(predicted,0),0)::double as precision, coalesce(hits/nullif(support,0),0)::double as recall,
 coalesce(2*coalesce(hits/nullif(predicted,0),0)*coalesce(hits/nullif(support,0),0)/nullif(coalesce(hits/nullif(predicted,0),0)+coalesce(hits/nullif(support,0),0),0),0)::double as f1,
 support::bigint as support, hits::bigint as hits
from (select class, coalesce(sum(case when label=class then n end),0) as support,
 coalesce(sum(case when prediction=class then n end),0) as predicted, coalesce(sum(case when label=class and prediction=class then n end),0) as hits
 from confusion cross join (select label as class from confusion union select prediction from confusion) group by class)
"""


def suggestion_list(level: str, variant: str) -> str:
    fields, texts = {
        "core": (CORE_FIELDS, CORE_TEXTS),
        "service": (SERVICE_FIELDS, SERVICE_TEXTS),
    }[variant]
    cut = RENEWABLE_CUTOFF[variant]
    rules = [
        ("transport", f"{level}='High' and transport_mode='Car' and distance_km>5"),
        ("renewables", f"{level}='High' and renewable_usage_pct<{cut}"),
        ("diet", f"{level}='High' and food_type='Non-Veg'"),
        ("electricity", f"{level}='Medium' and electricity_kwh>8"),
        ("waste", f"{level}='Medium' and waste_generated_kg>0.7"),
        ("habits", f"{level}='Medium' and eco_actions<3"),
        ("keep_going", f"{level} not in ('High','Medium')"),
        ("full_renewables", f"{level} not in ('High','Medium') and renewable_usage_pct<100"),
        ("screens", "screen_time_hours>6"),
    ]
    cases = [
        f"case when {cond} then {{{', '.join(f'{q(f)}: {q(t)}' for f, t in zip(fields, texts[name]))}}} end"
        for name, cond in rules
    ]
    return f"list_filter([{', '.join(cases)}], lambda s: s is not null)[1:3]"


# Long contributions of the clean records, in feature order.
CTES["raw_parts"] = f"""
select record_id, coalesce({MODE_W},0.5)*(distance_km/10) as c0,
 electricity_kwh*(100-renewable_usage_pct)/100*0.3::double as c1, coalesce({FOOD_W},0.5) as c2,
 waste_generated_kg*0.4::double as c3, eco_actions*(-0.15::double) as c4, screen_time_hours*0.1::double as c5 from activity
"""
CTES["core_parts"] = """
select record_id, unnest([0,1,2,3,4,5]) as ord,
 unnest(['transport','energy','food','waste','eco_actions','screen_time']) as feature,
 unnest([round(c0*f,3),round(c1*f,3),round(c2*f,3),round(c3*f,3),round(c4*f,3),round(c5*f,3)]) as value
from (select *, case when t>0 then 8.0::double/t else 1.0 end as f from
 (select *, 0.0::double+abs(c0)+abs(c1)+abs(c2)+abs(c3)+abs(c4)+abs(c5) as t from raw_parts))
"""
CTES["service_parts"] = f"""
select record_id, unnest([0,1,2,3,4,5,6,7,8]) as ord, unnest([{', '.join(map(q, FEATURES))}]) as feature,
 unnest([case day_type when 'Weekend' then -0.1::double else 0.0 end, coalesce({MODE_W},0.0), distance_km*0.05::double,
  electricity_kwh*0.3::double, renewable_usage_pct*(-0.02::double), coalesce({FOOD_W},0.0),
  screen_time_hours*0.1::double, waste_generated_kg*0.4::double, eco_actions*(-0.15::double)]) as value from activity
"""
for _name, _pct in (("core", decimal_round("abs(value)/total*100", 1)), ("service", "abs(value)/total*100")):
    # The total adds the parts in feature order, as the other side does.
    CTES[f"{_name}_ranked"] = f"""
select record_id, feature as factor, pct as percentage,
 (row_number() over (partition by record_id order by pct desc, ord) - 1)::int as position
from (select p.*, {_pct} as pct from {_name}_parts p join
 (select record_id, list_reduce(list_prepend(0.0::double, list(abs(value) order by ord)), lambda a, b: a + b) as total from {_name}_parts group by record_id) using (record_id)
 where total>0)
"""
CTES["core_top"] = """
select record_id, max(factor) filter (position=0) as f1, max(percentage) filter (position=0) as p1,
 max(factor) filter (position=1) as f2, max(percentage) filter (position=1) as p2 from core_ranked group by record_id
"""
CTES["service_top"] = CTES["core_top"].replace("core_ranked", "service_ranked")


def fixed(x: str, places: int) -> str:
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,18)), {places})::decimal(20,{places}) as varchar)"


CTES["folded"] = """
select a.*, (case when rn < extra*(small+1) then rn//(small+1) else extra + (rn-extra*(small+1))//greatest(small,1) end)::int as fold
from (select *, row_number() over (order by record_id)-1 as rn, (count(*) over ())//5 as small, (count(*) over ())%5 as extra from activity) a
"""
CTES["sfolded"] = f"""
with cls as (select {LV} as lv, count(*) as n, min(record_id) as first_id from activity group by 1),
line as (select lv, coalesce(sum(n) over (order by first_id rows between unbounded preceding and 1 preceding),0) as start from cls),
placed as (select a.*, row_number() over (partition by {LV} order by record_id)-1 as rn, start from activity a join line on lv={LV}),
dealt as (select {LV} as lv, (start+rn)%5 as f, count(*) as c from placed group by 1,2),
ends as (select lv, f, sum(c) over (partition by lv order by f) as e from dealt)
select p.* exclude (rn, start), (select count(*) from ends where lv={LV} and e<=rn)::int as fold from placed p
"""


def cross_validated(folded: str) -> str:
    return f"""
select f.*, round((tot.s-own.s)/(tot.n-own.n),6) as pred from {folded} f
join (select transport_mode, food_type, fold, sum({Y}) as s, count(*) as n from {folded} group by all) own using (transport_mode, food_type, fold)
join (select transport_mode, food_type, sum({Y}) as s, count(*) as n from {folded} group by all) tot using (transport_mode, food_type)
"""


CTES["cv_r"] = cross_validated("folded")
CTES["cv_c"] = cross_validated("sfolded")
CTES["cv_r_scores"] = f"select fold, {metric_columns(Y, 'pred', ['n', 'r2'])} from cv_r group by fold"

# Means and deviations of the fitted encoder, and the encoded dirty records.
CTES["moments"] = (
    "select "
    + ", ".join(
        f"median({c}) as med_{c}, avg({c}) as m_{c}, stddev_pop({c}) as s_{c}"
        for c in NUMERIC_FEATURES
    )
    + " from activity"
)
ONE_HOT = [
    (c, v, f"{c}_{v}".replace("-", "_")) for c in ("day_type", "transport_mode", "food_type")
    for v in sorted(DOMAINS[c])
]
CTES["encoded"] = (
    "select record_id, "
    + ", ".join(f"(coalesce({c}, med_{c})-m_{c})/s_{c} as {c}" for c in NUMERIC_FEATURES)
    + ", "
    + ", ".join(f"coalesce(({c}={q(v)})::int,0)::double as {a}" for c, v, a in ONE_HOT)
    + " from coerced cross join moments"
)
CTES["scored_raw"] = f"""
select c.*, segment_mean as footprint, {level_of('segment_mean')} as lv, greatest(p_low,p_medium,p_high) as cc,
 case when segment_mean between stats.lo and stats.hi then greatest(0.5,least(0.95,exp(-0.5*((segment_mean-m)/s)*((segment_mean-m)/s)))) else 0.7 end as rc
from checked c left join seg using (transport_mode, food_type) cross join stats
"""
CTES["batch"] = f"""
select *, case when n_errors=0 then footprint end as {Y}, case when n_errors=0 then lv else 'Error' end as {LV},
 case when n_errors=0 then (rc+cc)/2 end as confidence,
 case when n_errors>0 then 'Validation failed: ' || comma_messages end as error from scored_raw
"""


def sql(body: str) -> str:
    """``body`` behind the named parts it needs, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, part in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(part)

    visit(body)
    parts = [f"{name} as materialized ({CTES[name]})" for name in CTES if name in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


O: dict[str, str] = {}
ACTIVITY_COLUMNS = ", ".join(["user_id", *FEATURES, Y, LV])

O["read_activity"] = f"select {ACTIVITY_COLUMNS} from activity"
_presence = " union all ".join(
    f"select {i}::int as position, '{c}' as column_name, "
    + (
        "0::bigint"
        if c in ("waste_generated_kg", "food_type")
        else f"(select count({c}) from activity_raw)"
    )
    + " as present_rows"
    for i, c in enumerate(FEATURES)
)
O["required_columns"] = f"select *, present_rows=0 as is_missing from ({_presence})"
O["records_to_frame"] = f"select record_id, {FEATURE_LIST} from coerced"
CTES["clean_scored"] = f"""
select a.*, segment_mean as pf, {level_of('segment_mean')} as pl, greatest(p_low,p_medium,p_high) as cc, p_high
from activity a left join seg using (transport_mode, food_type)
"""
CTES["all_stats"] = f"select avg({Y}) as m, stddev_samp({Y}) as s, min({Y}) as lo, max({Y}) as hi from activity"
O["write_scored"] = f"""
select record_id, pf as {Y}, pl as {LV}, {decimal_round('(rc+cc)/2', 6)} as confidence, suggestions, null::varchar as error from
 (select *, case when pf between lo and hi then greatest(0.5,least(0.95,exp(-0.5*((pf-m)/s)*((pf-m)/s)))) else 0.7 end as rc,
  to_json({suggestion_list('pl', 'core')})::varchar as suggestions from clean_scored cross join all_stats)
"""
_line = f"(select regr_intercept({Y}, electricity_kwh) from sp where split='train') + (select regr_slope({Y}, electricity_kwh) from sp where split='train')*electricity_kwh"
O["save_load_models"] = f"select record_id, round({_line},5) as prediction from sp where split='test'"
_far = _line.replace("electricity_kwh", "distance_km")
O["model_versions"] = f"""
select v::int as version, record_id, round(case v when 1 then {_line} else {_far} end, 5) as prediction
from sp cross join (values (1), (2)) t(v) where split='test'
"""
O["metrics_store"] = "select * from base_metrics"
_required = ["regression_linear", "regression_segment", "preprocessor", "label_encoder",
             "best_regression_model", "best_classification_model"]
O["artefact_audit"] = f"""
select r.position::int as position, r.name, found.name is not null as exists, coalesce(ok,false) as loadable,
 case when found.name is null then 'File not found' when not ok then 'Model has no metrics' end as error
from (values {', '.join(f"({i}, '{n}')" for i, n in enumerate(_required))}) r(position, name)
left join (select task || '_' || model as name, bool_and(value is not null) as ok from base_metrics group by 1) found on found.name=r.name
"""
O["golden_samples"] = f"""
select record_id, transport_mode, pf as {Y}, p_high, (i-1)::int as position, list_extract(s, i)['category'] as category, list_extract(s, i)['action'] as action
from (select *, {suggestion_list('pl', 'core')} as s from clean_scored), unnest(range(1, len(s)+1)) u(i)
"""
O["model_info"] = """
select 'regression_' || model as name, task, model, r2, rmse, model = (select model from wide_metrics order by r2 desc, model limit 1) as is_best from wide_metrics
"""

O["features_targets"] = f"select record_id, {FEATURE_LIST}, {Y}, {LV} from activity"
_kinds = {**{c: "categorical" if c in DOMAINS else "numeric" for c in FEATURES}, Y: "numeric", LV: "categorical"}
O["columns_by_dtype"] = " union all ".join(
    f"select '{c}' as column_name, (select count({c}) from activity) as non_null, '{k}' as kind"
    for c, k in _kinds.items()
)
O["coerce_numeric"] = f"select record_id, {', '.join(NUMERIC_FEATURES)} from coerced"
O["null_fill_missing"] = (
    "select record_id, "
    + ", ".join(
        f"null::varchar as {c}" if c == "day_type"
        else f"null::double as {c}" if c == "waste_generated_kg" else c
        for c in FEATURES
    )
    + " from activity"
)
O["check_required"] = f"select record_id, {joined(MISSING, '; ')} as messages from coerced"
O["check_domain"] = f"select record_id, {joined(DOMAIN, '; ')} as messages from coerced"
O["check_range"] = f"select record_id, {joined(RANGE, '; ')} as messages from coerced"
O["validate_all"] = "select record_id, n_errors=0 as is_valid, n_errors, messages from checked"
O["validate_first"] = "select record_id, first_message as error from checked"
O["quarantine"] = f"""
select record_id, n_errors=0 as is_valid, case when n_errors>0 then 'Validation failed: ' || comma_messages end as error,
 null::double as {Y}, case when n_errors>0 then 'Error' end as {LV}, transport_mode, distance_km from checked
"""
O["quarantine_service"] = f"""
select record_id, first_message is null as is_valid, first_message as error, case when first_message is not null then 'Error' end as {LV} from checked
"""
O["impact_level"] = f"""
select record_id, {level_of('y')} as {LV}, {level_of('y', 5.0, 9.0)} as narrow_level
from (select record_id, case when record_id%50<>0 then {Y} end as y from activity)
"""


def feature(name: str, expression: str, places: bool = True) -> None:
    O[name] = f"select record_id, {r6(expression) if places else expression} as {name} from coerced"


feature("transport_impact_score", f"distance_km*({MODE_W})")
feature("energy_efficiency", "electricity_kwh*(100-renewable_usage_pct)/100")
feature("waste_per_activity", "waste_generated_kg/(eco_actions+1)")
feature("transport_electricity_interaction", "distance_km*electricity_kwh")
feature("renewable_waste_interaction", "(100-renewable_usage_pct)*waste_generated_kg")
feature("is_weekend", "coalesce((day_type='Weekend')::int,0)", False)
feature("renewable_bucket", "case when renewable_usage_pct<25 then '0-25' when renewable_usage_pct<50 then '25-50' when renewable_usage_pct<75 then '50-75' when renewable_usage_pct<=100 then '75-100' end", False)
feature("log_distance", "ln(1+distance_km)")
SUSTAIN = f"(renewable_usage_pct/100 + eco_actions/5.0::double + (1-distance_km*({MODE_W})/(select max(distance_km*({MODE_W})) from {{src}})) + (case food_type when 'Veg' then 1.0 when 'Mixed' then 0.5 when 'Non-Veg' then 0.0 end)::double)/4"
O["sustainability_score"] = f"select record_id, round({SUSTAIN.format(src='activity')},6) as sustainability_score from activity"
CTES["train_only"] = "select * from sp where split='train'"
O["engineer_features"] = f"""
select record_id, round(distance_km*({MODE_W}),6) as transport_impact_score,
 round(electricity_kwh*(100-renewable_usage_pct)/100,6) as energy_efficiency, round(waste_generated_kg/(eco_actions+1),6) as waste_per_activity,
 round({SUSTAIN.format(src='train_only')},6) as sustainability_score, round(distance_km*electricity_kwh,6) as transport_electricity_interaction,
 round((100-renewable_usage_pct)*waste_generated_kg,6) as renewable_waste_interaction, (day_type='Weekend')::int as is_weekend from activity
"""
O["impute_median"] = (
    "select record_id, "
    + ", ".join(f"round(coalesce({c}, (select median({c}) from coerced)),6) as {c}" for c in NUMERIC_FEATURES)
    + " from coerced"
)
O["impute_constant"] = "select record_id, " + ", ".join(
    f"coalesce({c},'missing') as {c}" for c in DOMAINS
) + " from coerced"
O["standard_scale"] = (
    "select record_id, "
    + ", ".join(f"round(({c}-m_{c})/s_{c},6) as {c}" for c in NUMERIC_FEATURES)
    + " from activity cross join moments"
)
O["one_hot"] = f"select record_id, {', '.join(a for _, _, a in ONE_HOT)} from encoded"
O["preprocess"] = (
    f"select record_id, {', '.join(f'round({c},6) as {c}' for c in NUMERIC_FEATURES)}, {', '.join(a for _, _, a in ONE_HOT)} from encoded"
)
O["feature_names"] = " union all ".join(
    f"select '{name}' as feature, (select round(avg({column}),6) from encoded) as mean, {i}::int as slot"
    for i, (name, column) in enumerate(
        [(c, c) for c in NUMERIC_FEATURES] + [(f"{c}_{v}", a) for c, v, a in ONE_HOT]
    )
)
O["label_codec"] = f"""
select record_id, (case {LV} when 'Low' then 0 when 'Medium' then 1 else 2 end)::double as label,
 (case {LV} when 'Low' then 0 when 'Medium' then 1 else 2 end)::double as label_by_rule,
 case record_id%5 when 0 then 'Low' when 1 then 'Medium' when 2 then 'High' else 'Medium' end as decoded from activity
"""

O["stratified_split"] = f"""
select record_id, {LV}, case when rn <= round(n*0.2::double) then 'test' else 'train' end as split from
 (select record_id, {LV}, row_number() over (partition by {LV} order by md5(record_id::varchar || ':42'), record_id) as rn,
  count(*) over (partition by {LV}) as n from activity)
"""
O["hash_split"] = "select record_id, split from sp"
O["kfold_regression"] = "select fold, n, r2 from cv_r_scores"
O["kfold_classification"] = f"select fold, count(*) as n, round(avg(case when {level_of('pred')}={LV} then 1.0 else 0.0 end),6) as accuracy from cv_c group by fold"
O["kfold_summary"] = "select round(avg(r2),6) as cv_mean, round(stddev_pop(r2),6) as cv_std from cv_r_scores"
O["stratified_folds"] = "select record_id, fold from sfolded"
O["validation_metrics"] = f"select split, {metric_columns(Y, 'segment_mean', ['n', 'rmse', 'r2'])}, round(avg(case when segment_level={LV} then 1.0 else 0.0 end),6) as accuracy from pred group by split"

O["linear_regression"] = f"""
select count(*) as n, round(regr_slope({Y}, electricity_kwh),5) as slope, round(regr_intercept({Y}, electricity_kwh),5) as intercept,
 round(regr_slope({Y}, electricity_kwh),5) as fitted_slope, round(regr_intercept({Y}, electricity_kwh),5) as fitted_intercept from train_only
"""
O["best_model"] = """
select * from (select task, model, r2, rmse, mae, 'r2' as chosen_by from wide_metrics order by r2 desc, model limit 1)
union all select * from (select task, model, r2, rmse, mae, 'rmse' as chosen_by from wide_metrics order by rmse, model limit 1)
"""
O["score_footprint"] = f"select record_id, round({_line},5) as {Y} from sp"


def bell(p: str, mean: str, std: str, lo: str, hi: str) -> str:
    z = f"(({p}-{mean})/{std})"
    return f"case when {p} between {lo} and {hi} then greatest(0.5,least(0.95,exp(-0.5*{z}*{z}))) else 0.7 end"


O["regression_confidence"] = f"""
select record_id, round({bell('linear_pred', 'm', 's', 'lo', 'hi')},6) as confidence,
 round({bell('linear_pred', 'm', '2.5', '1.79', '16.02')},6) as confidence_with_defaults, 0.7::double as confidence_without_stats
from test cross join stats
"""
O["class_confidence"] = "select record_id, greatest(p_low,p_medium,p_high) as confidence, 0.7::double as without_probabilities from test"
O["overall_confidence"] = f"select record_id, {decimal_round(f"({bell('segment_mean', 'm', 's', 'lo', 'hi')} + greatest(p_low,p_medium,p_high))/2", 6)} as confidence from test cross join stats"
O["service_confidence"] = "select record_id, round(cc,6) as confidence from clean_scored"
O["resolve_model"] = "select record_id, linear_pred as best, segment_mean as exact, linear_pred as other from test"
_summary = {
    "transport": "transport_mode || ' (' || distance_km || ' km)'",
    "energy": "electricity_kwh || ' kWh, ' || renewable_usage_pct || '% renewable'",
}
O["score_batch"] = f"""
select b.record_id, {Y}, {LV}, {decimal_round('confidence', 6)} as confidence, case when n_errors=0 then round(rc,6) end as regression_confidence,
 case when n_errors=0 then round(cc,6) end as classification_confidence,
 case when n_errors=0 then to_json({suggestion_list('lv', 'core')})::varchar end as suggestions,
 case when n_errors=0 then round(c0*case when t>0 then 8.0/t else 1 end,3) end as transport,
 case when n_errors=0 then {_summary['energy']} end as energy, case when n_errors=0 then '2024-01-15T12:30:45.000000' end as timestamp, error
from batch b join (select record_id, coalesce({MODE_W},0.5)*(distance_km/10) as c0,
 abs(coalesce({MODE_W},0.5)*(distance_km/10)) + abs(electricity_kwh*(100-renewable_usage_pct)/100*0.3::double) + abs(coalesce({FOOD_W},0.5))
 + abs(waste_generated_kg*0.4::double) + abs(eco_actions*0.15::double) + abs(screen_time_hours*0.1::double) as t from coerced) parts using (record_id)
"""
O["input_summary"] = f"""
select record_id, {_summary['transport']} as transport, {_summary['energy']} as energy, food_type as food,
 screen_time_hours || ' hours' as screen_time, waste_generated_kg || ' kg' as waste, eco_actions, day_type from activity
"""
O["batch_prediction_id"] = "select record_id, 'batch_20240115_123045_' || case when record_id<10000 then lpad(record_id::varchar,4,'0') else record_id::varchar end as batch_id from activity"
O["prediction_id"] = """select a.record_id,
 'pred_20240115_123045_' || lpad(((('0x' || substr(md5(a.record_id::varchar), 1, 13))::bigint) % 10000)::varchar, 4, '0') as prediction_id, b.batch_id
from activity a join (""" + O["batch_prediction_id"] + """) b using (record_id)"""
CTES["line_fit"] = f"select regr_slope({Y}, electricity_kwh) as k, regr_intercept({Y}, electricity_kwh) as i, avg(electricity_kwh) as x from train_only"
O["explain_linear"] = """
select record_id, round(i + k * electricity_kwh, 5) as prediction, round(k * (electricity_kwh - x), 5) as electricity_share from activity, line_fit
"""
CTES["fold_fit"] = f"""
select a.fold, regr_slope({Y}, electricity_kwh) as k, regr_intercept({Y}, electricity_kwh) as i
from (select distinct fold from folded) a join folded b on a.fold <> b.fold group by a.fold
"""
CTES["fold_r2"] = f"""
select fold, count(*) as n, 1 - sum(({Y} - i - k * electricity_kwh) ** 2) / (var_pop({Y}) * count(*)) as r2 from folded join fold_fit using (fold) group by fold
"""
O["cross_validation"] = "select fold, n, round(r2, 5) as r2, round(avg(r2) over (), 5) as cv_mean, round(stddev_pop(r2) over (), 5) as cv_std from fold_r2"
# What every fit promises, for each record.
O["rf_regressor"] = "select record_id, true as in_training_range from test"
O["gbt_regressor"] = f"select count(*) as n, round(avg({Y}),4) as mean_prediction, round(avg({Y}),4) as mean_label from train_only"
O["robust_regressor"] = "select count(*) as n, true as linear_beats_mean, true as kernel_beats_mean from test"
O["kernel_svc"] = "select count(*) as n, true as beats_half, count(*) as sum_to_one, true as own_class_likelier from test"
O["svc_probabilities"] = f"""
select level, (select count(*) from train_only) as n, count(*) as of_level, 0.0::double as mean_residual, 0.0::double as mean_weighted_residual
from (select {LV} as level from train_only) group by level
"""
CTES["fold_plane"] = f"""
select fold, (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) as k1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) as k2, m1, m2, my
from (select a.fold, covar_pop({Y}, electricity_kwh) as cy1, covar_pop({Y}, distance_km) as cy2, covar_pop(electricity_kwh, distance_km) as c12,
      var_pop(electricity_kwh) as v1, var_pop(distance_km) as v2, avg(electricity_kwh) as m1, avg(distance_km) as m2, avg({Y}) as my
      from (select distinct fold from folded) a join folded b on a.fold <> b.fold group by a.fold)
"""
O["linear_folds"] = f"""
select fold, count(*) as n, round(1 - sum(({Y} - my - k1 * (electricity_kwh - m1) - k2 * (distance_km - m2)) ** 2) / (var_pop({Y}) * count(*)), 5) as r2
from folded join fold_plane using (fold) group by fold
"""
O["catalog_cross_validation"] = """
select f || t as name, fold::integer as fold, true as beats_guessing, true as mean_is_mean
from (values ('random_forest'), ('xgboost'), ('lightgbm')) a(f), (values ('_reg'), ('_clf')) b(t), range(5) r(fold) where (select count(*) from train_only) > 0
"""
for _name in ("rf_classifier", "gbt_classifier"):
    O[_name] = "select record_id, true as known_level, true as sums_to_one, true as likeliest from test"
O["logistic_regression"] = f"select {LV} as level, count(*) as n, true as meets_count from train_only group by {LV}"
O["linear_svc"] = "select record_id, true as known_level, true as sums_to_one from test"
O["score_level"] = "select record_id, true as known_level, true as confidence_is_its_probability from test"
O["ensemble_predict"] = "select record_id, true as mean_is_mean, true as weighted_is_between from test"
O["train_all"] = """
select task, model, metric, true as beats_guessing from (values ('random_forest'), ('xgboost'), ('lightgbm'), ('catboost')) m(model),
 (values ('regression', 'mse'), ('regression', 'rmse'), ('regression', 'r2'), ('classification', 'accuracy'), ('classification', 'precision_macro'),
  ('classification', 'recall_macro'), ('classification', 'f1_macro')) t(task, metric) where (select count(*) from test) > 0
"""
O["model_catalog"] = """
select f.algorithm || case task when 'regression' then '_reg' else '_clf' end as name, task as model_type, f.algorithm, hyperparameter, value::double as value,
 case task when 'regression' then 'train_r2' else 'train_accuracy' end as metric, true as beats_guessing
from (values ('random_forest', 'n_estimators', 100), ('random_forest', 'max_depth', 10), ('random_forest', 'min_samples_split', 5), ('xgboost', 'n_estimators', 100),
 ('xgboost', 'max_depth', 6), ('xgboost', 'learning_rate', 0.1), ('lightgbm', 'n_estimators', 100), ('lightgbm', 'num_leaves', 31), ('lightgbm', 'learning_rate', 0.1))
 f(algorithm, hyperparameter, value), (values ('regression'), ('classification')) t(task) where (select count(*) from train_only) > 0
"""
O["importance_topk"] = "select 16::bigint as features, 1.0::double as total, 10::bigint as listed, true as largest where (select count(*) from train_only) > 0"
O["sampled_attribution"] = "select record_id, 16::bigint as features, true as adds_up from train_only"
O["score_batch_ml"] = """
select record_id, case when n_errors > 0 then 'Validation failed: ' || comma_messages end as error, case when n_errors = 0 then true end as in_training_range,
 true as known_level, case when n_errors = 0 then true end as is_confidence from checked
"""
O["global_explanation"] = """
select section, n::bigint as rows, total::double as importance_total
from (values ('model', 3, null), ('performance', 2, null), ('feature_importance', 16, 1.0)) t(section, n, total) where (select count(*) from train_only) > 0
"""
O["explain_sample"] = "select record_id, 10 as contributions, true as shares_of_one, true as sums_to_one from activity"
for _name in ("explain_forest", "explain_boosting", "explain_classes"):
    O[_name] = "select record_id, 16 as features, true as adds_up, true as explained from activity"
O["kernel_attribution"] = "select record_id, 16 as features, true as adds_up, true as small_error from train_only"
O["explain_stump"] = f"""
select a.record_id, round(g.m - t.m, 5) as share, round(t.m, 5) as expected
from activity a join (select day_type, avg({Y}) as m from train_only group by day_type) g using (day_type), (select avg({Y}) as m from train_only) t
"""
# Two coefficients from the moments, by the normal equations.
CTES["plane"] = f"""
select (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) as k1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) as k2, m1, m2
from (select covar_pop({Y}, electricity_kwh) as cy1, covar_pop({Y}, distance_km) as cy2, covar_pop(electricity_kwh, distance_km) as c12,
      var_pop(electricity_kwh) as v1, var_pop(distance_km) as v2, avg(electricity_kwh) as m1, avg(distance_km) as m2 from train_only)
"""
O["kernel_linear"] = "select record_id, round(k1 * (electricity_kwh - m1), 4) as share_electricity, round(k2 * (distance_km - m2), 4) as share_distance from activity, plane"
O["score_distinct"] = f"select record_id, segment_mean as {Y}, {level_of('segment_mean')} as {LV} from activity left join seg using (transport_mode, food_type)"
O["cached_scores"] = O["score_distinct"]
CTES["seen"] = """
select day(activity_date) % 2 as batch, transport_mode, food_type, floor(distance_km/10) as d, renewable_usage_pct, count(*) as n from activity group by all
"""
O["cache_statistics"] = """
select batch::int as batch, sum(n)::bigint as rows, count(*) as distinct_inputs, count(*) filter (hit) as hits,
 count(*) filter (not hit) as misses, round(count(*) filter (hit) / count(*), 6) as hit_rate
from (select *, batch = 1 and count(*) over (partition by transport_mode, food_type, d, renewable_usage_pct) = 2 as hit from seen)
group by 1
"""
O["repeat_statistics"] = """
select sum(n)::bigint as rows, count(*) as distinct_inputs, sum(n-1)::bigint as hits, round(sum(n-1)/sum(n),6) as hit_rate
from (select count(*) as n from activity group by day_type, transport_mode, food_type, eco_actions)
"""
O["vote_mean"] = f"select record_id, {decimal_round('(linear_pred+segment_mean)/2', 7)} as prediction from test"
_likely = "case when p_low>=p_medium and p_low>=p_high then 'Low' when p_medium>=p_high then 'Medium' else 'High' end"
_votes = lambda vs: "(select v from unnest([" + ",".join(vs) + "]) t(v) group by v order by count(*) desc, case v when 'Low' then 0 when 'Medium' then 1 else 2 end limit 1)"
O["vote_majority"] = f"""
select record_id, {_votes(['linear_level', 'segment_level', 'likely'])} as three_votes, {_votes(['linear_level', 'mean_level'])} as two_votes
from (select *, {_likely} as likely, {level_of('(linear_pred+segment_mean)/2')} as mean_level from test)
"""
CTES["weights"] = f"""
select round(1-avg(({Y}-linear_pred)*({Y}-linear_pred))/var_pop({Y}),6) as wl, round(1-avg(({Y}-segment_mean)*({Y}-segment_mean))/var_pop({Y}),6) as ws from test
"""
O["vote_weighted"] = """
select record_id, round((linear_pred*wl+segment_mean*ws)/(wl+ws),6) as prediction, round((linear_pred*wl+segment_mean*0.5)/(wl+0.5),6) as with_default_weight
from test cross join weights
"""
_hard = {v: f"(linear_level='{v}')::int" for v in LEVELS}
O["vote_soft"] = (
    "select *, case when mean_low>=mean_medium and mean_low>=mean_high then 'Low' when mean_medium>=mean_high then 'Medium' else 'High' end as prediction from (select record_id, "
    + ", ".join(f"{decimal_round(f'({_hard[v]}+p_{v.lower()})/2', 6)} as mean_{v.lower()}" for v in LEVELS)
    + ", "
    + ", ".join(f"round(({_hard[v]}*0.4::double+p_{v.lower()}*0.8::double)/(0.4::double+0.8::double),6) as weighted_{v.lower()}" for v in LEVELS)
    + " from test)"
)


def plausible_warnings(y: str, lv: str) -> str:
    parts = [
        f"case when not ({y} between 1.0 and 20.0) then 'Carbon footprint (' || {fixed(y, 2)} || ' kg) outside typical range (1.0-20.0 kg)' end",
        f"case when {y} is not null and {level_of(y)} <> {lv} then 'Impact level ''' || {lv} || ''' doesn''t match expected level ''' || {level_of(y)} || ''' for footprint ' || {fixed(y, 2)} || ' kg' end",
        "case when transport_mode='Walk' and distance_km>30 then 'Walking distance (' || distance_km || ' km) seems unusually high' end",
        "case when transport_mode='Bike' and distance_km>50 then 'Biking distance (' || distance_km || ' km) seems unusually high' end",
    ] + [
        f"case when {c}>{t} then '{c} (' || {c} || ') seems unusually high' end"
        for c, t in EXTREME_THRESHOLDS.items()
    ]
    return joined(parts, "; ")


O["make_prediction"] = f"""
select record_id, pf as {Y}, pl as {LV}, round(cc,6) as confidence, true as is_plausible, {plausible_warnings('pf', 'pl')} as warnings,
 '2024-01-15T12:30:45.000000' as timestamp from clean_scored
"""
O["stream_score"] = f"""
select record_id, pf as {Y}, pl as {LV}, {decimal_round(f"({bell('pf', 'm', 's', 'lo', 'hi')}+cc)/2", 6)} as confidence from clean_scored cross join stats
"""

O["stream_score_once"] = O["score_distinct"]
O["stream_level_counts"] = f"""
select {LV}, count(*) as total from ({O["score_distinct"]}) group by 1
"""

O["suggestions_core"] = f"select record_id, to_json({suggestion_list(LV, 'core')})::varchar as suggestions from activity"
O["suggestions_service"] = f"select record_id, to_json({suggestion_list(LV, 'service')})::varchar as suggestions from activity"
O["contributions"] = "select record_id, feature, value from core_parts"
O["contributions_service"] = "select record_id, feature, round(value,6) as value from service_parts"
O["contribution_pct"] = "select record_id, position, factor, round(percentage,6) as percentage from core_ranked"
O["contribution_pct_service"] = "select record_id, position, factor, round(percentage,6) as percentage from service_ranked where position<5"
O["top_factors"] = "select record_id, position, factor, round(percentage,6) as percentage from core_ranked where position<3"
O["key_factors"] = (
    "select record_id, position, factor, round(percentage,6) as percentage, case factor "
    + " ".join(f"when {q(k)} then {q(v)}" for k, v in FACTOR_DESCRIPTIONS.items())
    + " else factor end as description from service_ranked where position<3"
)
_obs = {
    "car": "transport_mode='Car' and distance_km>10",
    "renewables": "renewable_usage_pct<30",
    "diet": f"food_type='Non-Veg' and {LV} in ('Medium','High')",
    "habits": "eco_actions<2",
}
O["explain_text"] = f"""
select record_id, concat_ws(chr(10), 'Your daily carbon footprint is estimated at ' || {fixed(Y, 1)} || ' kg CO₂, which is classified as **' || {LV} || '** impact.',
 case {LV} when 'Low' then {q(CONTEXT['Low'])} when 'Medium' then {q(CONTEXT['Medium'])} else {q(CONTEXT['High'])} end,
 chr(10) || 'The main contributor to your footprint is **' || f1 || '** (' || {fixed('p1', 1)} || '% of total impact).',
 'Followed by **' || f2 || '** (' || {fixed('p2', 1)} || '%).',
 case when {' or '.join(f'({c})' for c in _obs.values())} then chr(10) || '**Key observations:**' end,
 {', '.join(f"case when {c} then {q('- ' + OBSERVATIONS[n])} end" for n, c in _obs.items())}) as explanation
from activity left join core_top using (record_id)
"""
O["explain_text_service"] = f"""
select record_id, 'Your predicted carbon footprint is ' || {fixed(Y, 1)} || ' kg CO₂ per day, which is classified as ' || {LV} || ' impact.' || chr(10) || chr(10)
 || coalesce('The main factor contributing to your footprint is ''' || f1 || ''' (' || {fixed('p1', 1)} || '%). ' || coalesce('Followed by ''' || f2 || ''' (' || {fixed('p2', 1)} || '%).', ''), '')
 || {' || '.join(f"case when {_obs[n]} then chr(10) || chr(10) || {q('Note: ' + t)} else '' end" for n, t in NOTES.items())} as explanation
from activity left join service_top using (record_id)
"""
CTES["odd"] = f"""
select *, case when record_id%7=0 then 'Low' else {level_of('fp')} end as lv from
 (select record_id, transport_mode, distance_km, electricity_kwh, screen_time_hours, waste_generated_kg, renewable_usage_pct*1.02::double as renewable_usage_pct,
  eco_actions-1 as eco_actions, round(distance_km*0.1::double + electricity_kwh*0.4::double + eco_actions, 4) as fp from coerced)
"""
O["plausibility_checks"] = f"""
select record_id, not (coalesce(renewable_usage_pct>100,false) or coalesce(eco_actions<0,false)) as is_valid, {plausible_warnings('fp', 'lv')} as warnings,
 concat_ws('; ', case when renewable_usage_pct>100 then 'Renewable usage (' || renewable_usage_pct || '%) cannot exceed 100%' end,
  case when eco_actions<0 then 'Eco actions (' || eco_actions || ') cannot be negative' end) as errors from odd
"""
_w = {"distance_km": 0.05, "electricity_kwh": 0.3, "renewable_usage_pct": -0.02, "screen_time_hours": 0.1, "waste_generated_kg": 0.4, "eco_actions": -0.15}
O["linear_attribution"] = "select record_id, " + ", ".join(
    f"round({w}*({c}-(select avg({c}) from train_only)),6) as attribution_{c}" for c, w in _w.items()
) + " from activity"
_plan = "3.5 + coalesce({m},0.5)*({d}/10) + {e}*(100-{r})/100*0.3::double + coalesce({f},0.5) + waste_generated_kg*0.4::double + eco_actions*(-0.15::double) + screen_time_hours*0.1::double"


def plan(d="distance_km", e="electricity_kwh", r="renewable_usage_pct", f=None) -> str:
    return _plan.format(m=f"({MODE_W})", d=d, e=e, r=r, f=f or f"({FOOD_W})")


_cases = {
    "halve_car_use": plan(d="(case when transport_mode='Car' then distance_km/2 else distance_km end)"),
    "renewables_25_to_75": plan(r="(case when renewable_usage_pct<=25 then 75 else renewable_usage_pct end)"),
    "electricity_minus_30_pct": plan(e="(electricity_kwh*0.7::double)"),
    "non_veg_to_veg": plan(f="(case food_type when 'Mixed' then 0.5 else 0.2 end)::double"),
}
_affected = {
    "halve_car_use": "transport_mode = 'Car' and distance_km <> 0",
    "renewables_25_to_75": "renewable_usage_pct <= 25",
    "electricity_minus_30_pct": "electricity_kwh <> 0",
    "non_veg_to_veg": "food_type = 'Non-Veg'",
}
O["what_if"] = " union all ".join(
    f"select '{n}' as scenario, count(*) as rows, round(avg({p}),6) as mean_footprint, round(avg({p})-avg({plan()}),6) as mean_change, (select count(*) from activity where {_affected[n]}) as affected_rows from activity"
    for n, p in _cases.items()
)

O["regression_metrics"] = f"select {metric_columns(Y, 'segment_mean')} from test"
O["confusion_matrix"] = f"""
select a.v as label, b.v as prediction, (select count(*) from test where {LV}=a.v and linear_level=b.v) as n
from (values ('Low'),('Medium'),('High')) a(v) cross join (values ('Low'),('Medium'),('High')) b(v)
"""
O["classification_metrics"] = "select round(sum(hits)/sum(support),6) as accuracy, round(avg(precision),6) as precision_macro, round(avg(recall),6) as recall_macro, round(avg(f1),6) as f1_macro from per_class"
O["per_class_metrics"] = "select class, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, support from per_class"
O["classification_report"] = """
select class, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, support from per_class
union all select 'accuracy', round(sum(hits)/sum(support),6), round(sum(hits)/sum(support),6), round(sum(hits)/sum(support),6), sum(support)::bigint from per_class
union all select 'macro avg', round(avg(precision),6), round(avg(recall),6), round(avg(f1),6), sum(support)::bigint from per_class
union all select 'weighted avg', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6), round(sum(f1*support)/sum(support),6), sum(support)::bigint from per_class
"""


def auc(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""select {k}class, (sum(case when level=class then rk end) - sum((level=class)::int)*(sum((level=class)::int)+1)/2.0)/nullif(sum((level=class)::int)::double*sum((level<>class)::int),0) as roc_auc
 from (select *, rank() over (partition by {k}class order by score) + (count(*) over (partition by {k}class, score)-1)/2.0 as rk from {source}) group by {k}class"""


CTES["seg_scores"] = " union all ".join(
    f"select {LV} as level, '{v}' as class, p_{v.lower()} as score from test" for v in LEVELS
)
O["roc_auc_by_class"] = f"select class, round(roc_auc,6) as roc_auc from ({auc('seg_scores')})"
O["roc_auc_ovr"] = f"select round(avg(roc_auc),6) as roc_auc from ({auc('seg_scores')})"
O["compare_models"] = f"select algorithm || '_regression' as model_name, 'regression' as model_type, algorithm, {metric_columns('label', 'prediction')} from longp where split='test' group by algorithm"
CTES["both_scores"] = " union all ".join(
    f"select 'segment' as algorithm, {LV} as level, '{v}' as class, p_{v.lower()} as score from test union all select 'linear', {LV}, '{v}', (linear_level='{v}')::int::double from test"
    for v in LEVELS
)
CTES["both_cells"] = "select algorithm, level as label, predicted_level as prediction, count(*) as n from longp where split='test' group by all"
CTES["both_class"] = """
select algorithm, class, hits, support, coalesce(hits/nullif(predicted,0),0) as p, coalesce(hits/nullif(support,0),0) as r from
 (select algorithm, class, coalesce(sum(case when label=class then n end),0) as support, coalesce(sum(case when prediction=class then n end),0) as predicted,
  coalesce(sum(case when label=class and prediction=class then n end),0) as hits
  from both_cells join (select algorithm, label as class from both_cells union select algorithm, prediction from both_cells) using (algorithm) group by algorithm, class)
"""
O["compare_classifiers"] = f"""
select m.algorithm || '_classification' as model_name, 'classification' as model_type, m.algorithm, accuracy, precision_macro, recall_macro, f1_macro, roc_auc from
 (select algorithm, round(sum(hits)/sum(support),6) as accuracy, round(avg(p),6) as precision_macro, round(avg(r),6) as recall_macro,
  round(avg(coalesce(2*p*r/nullif(p+r,0),0)),6) as f1_macro from both_class group by algorithm) m
 join (select algorithm, round(avg(roc_auc),6) as roc_auc from ({auc('both_scores', 'algorithm')}) group by algorithm) a using (algorithm)
"""


def stat_rows(section: str, pairs: dict[str, str], source: str, where: str = "true") -> str:
    return " union all ".join(
        f"select '{section}' as section, '{n}' as name, {decimal_round(f'({x})::double', 6)} as value from {source} where {where}"
        for n, x in pairs.items()
    )


def level_rows(section: str, value: str, where: str) -> str:
    return f"select '{section}' as section, {LV} as name, round(({value})::double,6) as value from batch where {where} group by {LV}"


O["analyze_predictions"] = " union all ".join(
    [
        stat_rows("totals", {
            "total_predictions": "count(*)",
            "successful_predictions": "count(*) - count(error)",
            "failed_predictions": "count(error)",
            "success_rate": "coalesce((count(*)-count(error))*100.0/nullif(count(*),0),0)",
        }, "batch"),
        stat_rows("footprint_statistics", {
            "mean": f"avg({Y})", "std": f"stddev_pop({Y})", "min": f"min({Y})", "max": f"max({Y})",
            "median": f"median({Y})", "q1": f"quantile_cont({Y},0.25)", "q3": f"quantile_cont({Y},0.75)",
        }, "batch", "n_errors=0"),
        level_rows("impact_level_distribution", "count(*)", "n_errors=0"),
        level_rows("impact_level_percentages", "count(*)*100.0/(select count(*) from batch where n_errors=0)", "n_errors=0"),
        stat_rows("confidence_statistics", {
            "mean": "avg(confidence)", "min": "min(confidence)", "max": "max(confidence)", "median": "median(confidence)",
        }, "batch", "n_errors=0"),
        "select 'error_analysis' as section, 'Validation Error' as name, count(*)::double as value from batch where n_errors>0 having count(*)>0",
    ]
)
O["error_types"] = """
select case when lower(e) like '%validation%' then 'Validation Error' when lower(e) like '%model%' then 'Model Error' else 'Other Error' end as error_type, count(*) as n
from (select case when record_id%83=0 then 'Model best_regression not found' when record_id%89=0 then 'Unexpected end of input' else error end as e from batch)
where e is not null group by 1
"""
O["analyze_batch"] = " union all ".join(
    [
        stat_rows("totals", {
            "total_samples": "count(*)", "error_count": "count(error)", "error_rate": "count(error)*100.0/count(*)",
        }, "batch"),
        stat_rows("footprint_stats", {
            "mean": f"avg({Y})", "std": f"stddev_samp({Y})", "min": f"min({Y})", "max": f"max({Y})", "median": f"median({Y})",
        }, "batch"),
        level_rows("impact_distribution", "count(*)", "true"),
        level_rows("impact_percentages", "count(*)*100.0/(select count(*) from batch)", "true"),
    ]
)
O["footprint_correlations"] = " union all ".join(
    f"select '{c}' as variable, round(corr({c}, measured_kg),6) as correlation from coerced" if c != Y
    else f"select '{Y}' as variable, 1.0::double as correlation"
    for c in CORRELATED
)
O["correlation_matrix"] = " union all ".join(
    f"select '{a}' as x, '{b}' as y, round(corr({a},{b}),6) as correlation from activity"
    for a in CORRELATED for b in CORRELATED
)
O["null_counts"] = " union all ".join(
    f"select '{c}' as column_name, count(*)-count({c}) as nulls from coerced" for c in FEATURES
)
O["describe"] = " union all ".join(
    f"select '{c}' as variable, count({c}) as count, round(avg({c}),6) as mean, round(stddev_samp({c}),6) as std, round(min({c}),6) as min, round(max({c}),6) as max, "
    f"round(quantile_cont({c},0.25),6) as q1, round(median({c}),6) as median, round(quantile_cont({c},0.75),6) as q3 from coerced"
    for c in NUMERIC_FEATURES
)
_counts = " union all ".join(
    f"select '{c}' as variable, {c} as category, count(*) as n from activity group by {c}"
    for c in [*DOMAINS, LV]
)
O["value_counts"] = _counts
O["histogram"] = f"""
select bin::int as bin, round(lo+bin*w,6) as bin_start, round(lo+(bin+1)*w,6) as bin_end, count(*) as n from
 (select least(floor(({Y}-lo)/w),29) as bin, lo, w from activity cross join (select min({Y}) as lo, (max({Y})-min({Y}))/30 as w from activity)) group by bin, lo, w
"""


def box(column: str, order: list[str]) -> str:
    pos = "case category " + " ".join(f"when '{v}' then {i+1}" for i, v in enumerate(order)) + " end::int"
    return f"""
select '{column}' as variable, category, n, round(q1,6) as q1, round(median,6) as median, round(q3,6) as q3, round(q1-1.5*(q3-q1),6) as low_fence, round(q3+1.5*(q3-q1),6) as high_fence,
 min(y) filter (y between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) as whisker_low, max(y) filter (y between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) as whisker_high,
 count(*) filter (not (y between q1-1.5*(q3-q1) and q3+1.5*(q3-q1))) as outliers, {pos} as position
from (select {column} as category, {Y} as y from activity) a join (select {column} as category, count(*) as n, quantile_cont({Y},0.25) as q1, median({Y}) as median, quantile_cont({Y},0.75) as q3 from activity group by 1) using (category)
group by category, n, q1, median, q3"""


_boxes = {"transport_mode": DOMAINS["transport_mode"], "food_type": DOMAINS["food_type"], LV: LEVELS}
O["box_stats"] = " union all ".join(
    f"select variable, category, n, q1, median, q3, whisker_low, whisker_high, outliers, position, low_fence, high_fence from ({box(c, v)})"
    for c, v in _boxes.items()
)
O["segment_means"] = " union all ".join(
    f"select '{c}' as segment, {c} as category, '{m}' as measure, count({m}) as n, round(avg({m}),6) as mean from activity group by {c}"
    for c, m in [("transport_mode", Y), ("food_type", Y), ("day_type", Y), (LV, "renewable_usage_pct")]
)
O["scatter_grid"] = f"select floor(renewable_usage_pct/5)*5 as x, floor({Y}) as y, count(*) as n from activity group by all"
O["scatter_sample"] = f"""
select record_id, {LV}, renewable_usage_pct, {Y}, cast(row_number() over (partition by {LV} order by md5(record_id::varchar || ':42'), record_id) as integer) as rank
from activity where renewable_usage_pct is not null and {Y} is not null qualify rank <= 100
"""
O["dataset_profile"] = " union all ".join(
    [
        "select 'size' as section, 'n_samples' as name, count(*)::double as value from activity",
        "select 'size', 'n_features', 9::double",
        stat_rows(Y, {
            "mean": f"avg({Y})", "std": f"stddev_samp({Y})", "min": f"min({Y})", "max": f"max({Y})",
            "median": f"median({Y})", "q1": f"quantile_cont({Y},0.25)", "q3": f"quantile_cont({Y},0.75)",
        }, "activity"),
        f"select variable, category, n::double from ({_counts})",
    ]
)
O["prediction_statistics"] = (
    f"select round(avg({Y}),6) as average_footprint, min({Y}) as footprint_min, max({Y}) as footprint_max, "
    + ", ".join(f"round(count(*) filter ({LV}='{v}')*100.0/count(*),6) as {v.lower()}_pct" for v in LEVELS)
    + ", round(avg(renewable_usage_pct),6) as average_renewable_usage, (select transport_mode from activity group by 1 order by count(*) desc, 1 limit 1) as most_common_transport from activity"
)
O["metrics_summary"] = f"""
select 'regression' as task, algorithm as model, round(max(r2) filter (split='train'),6) as train_r2, round(max(r2) filter (split='test'),6) as test_r2,
 round(max(r2) filter (split='train') - max(r2) filter (split='test'),6) as overfitting
from (select algorithm, split, {reg_metrics('label', 'prediction')['r2']} as r2 from longp group by 1,2) group by algorithm
"""
O["impact_by_mode"] = f"""
select transport_mode, {level_of('measured_kg')} as {LV}, count(*) as n, round(avg(measured_kg),6) as mean_footprint, round(avg(electricity_kwh),6) as mean_electricity
from checked where n_errors=0 group by 1, 2
"""

ORACLES = {name: sql(body) for name, body in O.items()}
