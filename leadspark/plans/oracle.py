"""DuckDB twins of the registered queries (correctness oracle).

Plain SQL over the driver tables, with the same parameter values as the Spark
code.  Shared building blocks are CTE texts combined per query.
"""

from __future__ import annotations

from leadspark.plans import params as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _inlist(vals) -> str:
    return ", ".join(_q(v) if isinstance(v, str) else str(v) for v in vals)


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


SITE = "(case when {k} <= 40 then 0 else {k} // 4 end)"
LAT = (f"case when {{k}} % 11 = 0 then null else cast(({SITE} * 104729) % 16000000 - 8000000 + ({{k}} % 4) * 2"
       " + {shift} as double) / 100000.0 end")
LON = f"cast(({SITE} * 15485863) % 36000000 - 18000000 + ({{k}} % 4) as double) / 100000.0"
ZIP = "lpad(cast({n} * 37 as varchar), 5, '0')"

MASTER = f"""master as (
  select cast(c_custkey as varchar) as MDM_CUST_KEY,
         {LAT.format(k='c_custkey', shift=0)} as ADDR_LATITUDE,
         {LON.format(k='c_custkey')} as ADDR_LONGITUDE,
         {ZIP.format(n='c_nationkey')} as ADDR_ZIP,
         c_mktsegment as SDS_CUST_CLASS1,
         c_name as ACCT_OFFICE_NAME,
         cast(c_custkey as varchar) || ' MAIN ST' as ADDR_STREETADDR,
         unnest(case when c_custkey % 50 = 0 then ['CITY ', 'TOWN '] else ['CITY '] end)
           || cast(c_nationkey as varchar) as ADDR_CITY,
         'ST' || cast(c_nationkey as varchar) as ADDR_STATE,
         lpad(cast(c_custkey as varchar), 10, '5') as CONT_FULLPHONE,
         'c' || cast(c_custkey as varchar) || '@example.com' as CONT_EMAIL
  from customer)"""

DEALER = f"""dealer as (
  select p_brand as COMPANY,
         cast(o_custkey as varchar) as SHIP_TO_MDM_CUST_KEY,
         {LAT.format(k='o_custkey', shift='(case when o_orderkey % 16 = 0 then 50000 else 0 end)')} as SHIP_TO_MDM_ADDR_LATITUDE,
         {LON.format(k='o_custkey')} as SHIP_TO_MDM_ADDR_LONGITUDE,
         {ZIP.format(n='c_nationkey')} as SHIP_TO_ZIP,
         'L0_' || cast(p_size % 4 as varchar) as L0_DESC_NEW, p_type as L1_DESC_NEW,
         case when split_part(p_name, ' ', 1) = 'small' then 'SPARE PARTS' else p_name end as L2_DESC_NEW,
         cast(year(o_orderdate) as integer) as CAL_445_YYYY, o_orderdate as ORDER_DATE,
         case when l_returnflag = 'R' then -cast(l_extendedprice as decimal(18,2))
              else cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) end
           as EXT_IVC_COST_USD,
         o_orderpriority as ITEM_COMMISSION_CAT, l_linenumber as PRODUCT_NUMBER,
         c_mktsegment as SDS_CUST_CLASS1
  from lineitem join orders on l_orderkey = o_orderkey
       join part on l_partkey = p_partkey
       join customer on o_custkey = c_custkey)"""

DIRECT = f"""direct as (
  select case event_id % 101 when 0 then null when 1 then '' when 2 then {_q(P.UNMATCHED_KEY)}
              else cast(user_id as varchar) end as MDM_CUST_KEY,
         {ZIP.format(n='(user_id % 25)')} as ADDR_ZIP,
         {_q(P.DIRECT_L1)} as P_CAT_L1_DESC, event_type as P_CAT_L2_DESC,
         cast(year(ts) as integer) as CAL_445_YYYY,
         cast(value as decimal(18,2)) * 100 as GROSS_SALES_USD,
         case when user_id % 7 = 0 then 'INTERNAL' else 'CUSTOMER' end as CUST_CLASS_L1
  from events)"""


def _opco_case() -> str:
    whens = " ".join(f"when COMPANY in ({_inlist(m)}) then {_q(g)}" for g, m in P.OPCO_MAP.items())
    return f"case {whens} else COMPANY end"


def channel_a(profile: P.SalesProfile, name: str = "ch_a") -> str:
    members = [m for ms in profile.opco_map.values() for m in ms]
    l2 = "L1_DESC_NEW" if profile.l2_from_l1 else "L2_DESC_NEW"
    spare = ""
    if profile.excluded_l2:
        spare = f"and L2_DESC_NEW not in ({_inlist(profile.excluded_l2)})"
    return f"""{name} as (
  select {_opco_case()} as OPCO, SHIP_TO_MDM_CUST_KEY as MDM_CUST_KEY,
         SHIP_TO_MDM_ADDR_LATITUDE as LATITUDE, SHIP_TO_MDM_ADDR_LONGITUDE as LONGITUDE,
         SHIP_TO_ZIP as ZIP, L1_DESC_NEW as L1_DESC, {l2} as L2_DESC, CAL_445_YYYY as YYYY,
         sum(EXT_IVC_COST_USD) as SALES
  from dealer
  where CAL_445_YYYY in ({_inlist(profile.dealer_years)})
    and COMPANY in ({_inlist(members)})
    and L0_DESC_NEW in ({_inlist(profile.l0_values)})
    and L1_DESC_NEW in ({_inlist(profile.l1_values)})
    {spare}
    and (ITEM_COMMISSION_CAT in ({_inlist(profile.commission_classes)})
         or PRODUCT_NUMBER in ({_inlist(profile.product_numbers)})
         and SDS_CUST_CLASS1 = {_q(profile.customer_class)})
  group by {_opco_case()}, SHIP_TO_MDM_CUST_KEY, SHIP_TO_MDM_ADDR_LATITUDE,
           SHIP_TO_MDM_ADDR_LONGITUDE, SHIP_TO_ZIP, L1_DESC_NEW, L2_DESC_NEW, CAL_445_YYYY)"""


def channel_b(profile: P.SalesProfile, name: str = "ch_b") -> str:
    return f"""{name} as (
  select {_q(profile.direct_tag)} as OPCO, n.MDM_CUST_KEY as MDM_CUST_KEY,
         c.ADDR_LATITUDE as LATITUDE, c.ADDR_LONGITUDE as LONGITUDE, n.ADDR_ZIP as ZIP,
         n.P_CAT_L1_DESC as L1_DESC, n.P_CAT_L2_DESC as L2_DESC, n.CAL_445_YYYY as YYYY,
         sum(n.GROSS_SALES_USD) as SALES
  from direct n left join master c on n.MDM_CUST_KEY = c.MDM_CUST_KEY
  where n.CAL_445_YYYY in ({_inlist(profile.direct_years)})
    and n.P_CAT_L2_DESC in ({_inlist(profile.direct_l2_values)})
    and n.CUST_CLASS_L1 = {_q(profile.direct_class)}
  group by n.MDM_CUST_KEY, c.ADDR_LATITUDE, c.ADDR_LONGITUDE, n.ADDR_ZIP,
           n.P_CAT_L1_DESC, n.P_CAT_L2_DESC, n.CAL_445_YYYY)"""


def sales_ctes(profile: P.SalesProfile) -> str:
    return ",\n".join([MASTER, DEALER, DIRECT, channel_a(profile), channel_b(profile), """sales as (
  select OPCO, MDM_CUST_KEY, LATITUDE, LONGITUDE, ZIP, L1_DESC, L2_DESC, YYYY,
         cast(SALES as decimal(38,4)) as SALES from ch_a
  union all
  select OPCO, MDM_CUST_KEY, LATITUDE, LONGITUDE, ZIP, L1_DESC, L2_DESC, YYYY,
         cast(SALES as decimal(38,4)) as SALES from ch_b)"""])


SALES_COLS = ("OPCO, MDM_CUST_KEY, LATITUDE, LONGITUDE, ZIP, L1_DESC, L2_DESC, YYYY, "
              "round(cast(SALES as double), 4) as SALES")


def feature_ctes() -> str:
    """CTEs up to ``ft`` (the labelled feature table) and ``wh`` (whisker)."""
    t = P.TARGET_CATEGORY
    piv = ",\n         ".join(
        f"round(cast(sum(SALES) filter (where cat = {_q(v)}) as double), 4) as {_ident(v)}"
        for v in P.PIVOT_VALUES)
    others = [v for v in P.PIVOT_VALUES if v != t]
    keep = ", ".join(f"coalesce({_ident(v)}, 0) as {_ident(v)}" for v in others)
    thr = P.TARGET_THRESHOLD
    return sales_ctes(P.FEATURES) + f""",
pos as (
  select MDM_CUST_KEY, L1_DESC || ' ' || L2_DESC as cat, SALES from sales
  where MDM_CUST_KEY is not null and SALES > 0),
wide as (
  select MDM_CUST_KEY,
         {piv}
  from pos group by MDM_CUST_KEY),
flo as (
  select *, case when {_ident(t)} < {thr} then 0 else {_ident(t)} end as tfloor
  from wide where MDM_CUST_KEY != {_q(P.UNMATCHED_KEY)}),
qv as (
  select tfloor as v, row_number() over (order by tfloor) - 1 as i, count(*) over () as n
  from flo where tfloor >= {thr}),
qq as (
  select max(n) as n,
         max(case when i = floor((n - 1) * 0.25) then v end) as lo1,
         max(case when i = floor((n - 1) * 0.25) + 1 then v end) as hi1,
         max(case when i = floor((n - 1) * 0.75) then v end) as lo3,
         max(case when i = floor((n - 1) * 0.75) + 1 then v end) as hi3
  from qv),
wh as (
  select q1, q3, q3 + {P.WHISKER_K} * (q3 - q1) as upper from (
    select case when (n - 1) * 0.25 - floor((n - 1) * 0.25) = 0 then lo1
                else lo1 + (coalesce(hi1, lo1) - lo1) * ((n - 1) * 0.25 - floor((n - 1) * 0.25)) end as q1,
           case when (n - 1) * 0.75 - floor((n - 1) * 0.75) = 0 then lo3
                else lo3 + (coalesce(hi3, lo3) - lo3) * ((n - 1) * 0.75 - floor((n - 1) * 0.75)) end as q3
    from qq)),
ft as (
  select MDM_CUST_KEY, {keep},
         coalesce(case when tfloor >= wh.upper then 0 else tfloor end, 0) as {P.TARGET_OUT},
         case when coalesce(case when tfloor >= wh.upper then 0 else tfloor end, 0) >= {thr}
              then 1 else 0 end as {P.LABEL}
  from flo, wh)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# -- scoring + enrichment ----------------------------------------------------------

def _clean(name: str) -> str:
    for ch in P.NAME_CHARS:
        name = name.replace(ch, "_")
    return name


def lead_ctes() -> str:
    """``scored``, ``leads`` (cleaned names) and ``fact`` (leads + master)."""
    cols = (["MDM_CUST_KEY"] + [v for v in P.PIVOT_VALUES if v != P.TARGET_CATEGORY]
            + [P.TARGET_OUT, P.LABEL, "lead_gen_prob"])
    sel = ", ".join(f"{_ident(c)} as {_ident(_clean(c))}" for c in cols)
    return feature_ctes() + f""",
scored as (
  select *, least(1.0, cast({_ident(P.RULE_SCORE_COLUMN)} as double) / {float(P.RULE_SCORE_SCALE)}) as lead_gen_prob
  from ft),
leads as (
  select {sel} from scored where {P.LABEL} = 0 and lead_gen_prob > {P.LEAD_THRESHOLD_ALL}),
fact as (
  select l.*, m.* exclude (MDM_CUST_KEY) from leads l left join master m on l.MDM_CUST_KEY = m.MDM_CUST_KEY),
fact_sel as (
  select MDM_CUST_KEY, {', '.join(P.CONTACT_COLS)}, ADDR_LATITUDE, ADDR_LONGITUDE, lead_gen_prob,
         {', '.join(P.FACT_FEATURES)}
  from fact where SDS_CUST_CLASS1 = {_q(P.FACT_CLASS)})"""


TS = "'%Y-%m-%d %H:%M:%S'"


def dim_ctes() -> str:
    inst = []
    for t in P.INSTALL_TYPES:
        inst.append(f"cast(cast(max(ORDER_DATE) filter (where L1_DESC_NEW = {_q(t)}) as date) as varchar) as {t}_maxdate")
        inst.append(f"cast(cast(min(ORDER_DATE) filter (where L1_DESC_NEW = {_q(t)}) as date) as varchar) as {t}_min")
    impl = ", ".join(
        f"case when event_type = {_q(t)} then round(cast(cast(value as decimal(18,2)) * 100 as double), 2) end"
        f" as IMPL_{t.upper()}" for t in P.EVENT_TYPES)
    return f"""install as (
  select SHIP_TO_MDM_CUST_KEY as ship_to_mdm_cust_key, {', '.join(inst)}, count(*) as INSTALL_LINES
  from dealer where L1_DESC_NEW in ({_inlist(P.INSTALL_TYPES)})
    and PRODUCT_NUMBER in ({_inlist(P.INSTALL_LINES)}) group by SHIP_TO_MDM_CUST_KEY),
contracts as (
  select cast(o_custkey as varchar) as BILL_MDM_KEY, cast(o_orderkey as varchar) as SLA_SKU,
         o_orderpriority as SLA_PRIORITY, o_totalprice as SLA_VALUE, o_orderkey as SLA_ORDER
  from orders where o_orderstatus = {_q(P.CONTRACT_STATUS)}),
contracts1 as (
  select * exclude (rn) from (select *, row_number() over (partition by BILL_MDM_KEY order by SLA_ORDER) as rn
  from contracts) where rn = 1),
tech1 as (
  select * exclude (rn) from (
    select cast(user_id as varchar) as MDM_ID, strftime(ts, {TS}) as TECH_CALL_TS, value as TECH_CALL_VALUE,
           event_id as TECH_EVENT, row_number() over (partition by user_id order by event_id) as rn
    from events where event_type = {_q(P.TECH_EVENT_TYPE)}) where rn = 1),
territory as (
  select substr(lpad(cast(n_nationkey * 37 as varchar), 5, '0'), 1, 3) as TERR_ZIP3, n_name as TERR_NATION,
         n_regionkey as TERR_REGION, 'REP ' || cast(n_nationkey as varchar) as TERR_REP
  from nation),
ext1 as (
  select * exclude (rn) from (
    select cast(o_custkey as varchar) as mdm_site_key, 'EXT-' || cast(o_orderkey as varchar) as EXT_ID,
           o_orderkey as EXT_ROW, row_number() over (partition by o_custkey order by o_orderkey) as rn
    from orders) where rn = 1),
impl_a as (
  select * exclude (rn) from (
    select cast(user_id as varchar) as IMPL_KEY, {impl}, row_number() over (partition by user_id order by event_id) as rn
    from events) where rn = 1),
impl_b as (
  select * exclude (rn) from (
    select cast(user_id as varchar) as IDB_KEY, value as IDB_VALUE, strftime(ts, {TS}) as IDB_FIRST_SIGNUP,
           row_number() over (partition by user_id order by event_id) as rn
    from events where event_type = 'signup') where rn = 1)"""


def star_sql(first_how: str, s: str = "s") -> str:
    """The chain of seven lookups; its steps are named ``s`` and a number."""
    j = "join" if first_how == "inner" else "left join"
    return f"""{s}1 as (
  select f.*, i.INSTALL_LINES from fact_sel f {j} install i on f.MDM_CUST_KEY is not distinct from i.ship_to_mdm_cust_key),
{s}2 as (
  select s.*, c.SLA_PRIORITY, c.SLA_VALUE from {s}1 s left join contracts1 c on s.MDM_CUST_KEY is not distinct from c.BILL_MDM_KEY),
{s}3 as (
  select s.*, t.TECH_CALL_TS, t.TECH_CALL_VALUE from {s}2 s left join tech1 t on s.MDM_CUST_KEY is not distinct from t.MDM_ID),
{s}4 as (
  select s.*, t.TERR_NATION, t.TERR_REP from (select *, substr(ADDR_ZIP, 1, 3) as ZIP3 from {s}3) s
  left join territory t on s.ZIP3 is not distinct from t.TERR_ZIP3),
{s}5 as (
  select s.*, e.EXT_ID from {s}4 s left join ext1 e on s.MDM_CUST_KEY is not distinct from e.mdm_site_key),
{s}6 as (
  select s.*, a.IMPL_PURCHASE, a.IMPL_SIGNUP from {s}5 s left join impl_a a on s.MDM_CUST_KEY is not distinct from a.IMPL_KEY),
{s}7 as (
  select s.*, b.IDB_VALUE, b.IDB_FIRST_SIGNUP from {s}6 s left join impl_b b on s.MDM_CUST_KEY is not distinct from b.IDB_KEY)"""


def star_totals_sql(first_how: str) -> str:
    """``star_sql`` and, as ``s9``, all events of a customer: money by type, signups and the earliest of them.

    The implant records kept first stay beside them, under names of their own.
    """
    impl = ", ".join(
        f"round(cast(sum(cast(value as decimal(18,2)) * 100) filter (where event_type = {_q(t)}) as double), 2)"
        f" as IMPL_{t.upper()}" for t in P.EVENT_TYPES)
    return star_sql(first_how) + f""",
impl_t as (
  select cast(user_id as varchar) as IMPL_KEY, {impl} from events group by user_id),
idb_t as (
  select cast(user_id as varchar) as IDB_KEY, count(*) as IDB_SIGNUPS, strftime(min(ts), {TS}) as IDB_FIRST_SIGNUP
  from events where event_type = 'signup' group by user_id),
s8 as (
  select s.* exclude (IMPL_PURCHASE, IMPL_SIGNUP, IDB_FIRST_SIGNUP), s.IMPL_PURCHASE as IMPL_KEPT_PURCHASE,
         s.IMPL_SIGNUP as IMPL_KEPT_SIGNUP, s.IDB_FIRST_SIGNUP as IDB_KEPT_SIGNUP, a.IMPL_PURCHASE, a.IMPL_SIGNUP
  from s7 s left join impl_t a on s.MDM_CUST_KEY is not distinct from a.IMPL_KEY),
s9 as (
  select s.*, b.IDB_SIGNUPS, b.IDB_FIRST_SIGNUP from s8 s left join idb_t b on s.MDM_CUST_KEY is not distinct from b.IDB_KEY)"""


USERS = f"""ulist_m as (
  select MDM_CUST_KEY as mk, ACCT_OFFICE_NAME as CUSTOMER_NAME, CONT_FULLPHONE, ADDR_STREETADDR as STREET,
         ADDR_CITY as CITY, ADDR_STATE as STATE, ADDR_ZIP as ZIP, CONT_EMAIL from master),
ua as (
  select u.USER_KEY, m.* exclude (mk), u.IMPLANT_QTY from (
    select cast(user_id as varchar) as USER_KEY, count(*) as IMPLANT_QTY from events
    where event_type = 'purchase' and value >= {P.IMPLANT_LEAST} group by user_id) u left join ulist_m m on u.USER_KEY = m.mk),
ub as (
  select u.USER_KEY, m.* exclude (mk), u.IMPLANT_USD from (
    select cast(user_id as varchar) as USER_KEY,
           round(cast(sum(cast(value as decimal(18,2)) * 100) as double), 2) as IMPLANT_USD from events
    where event_type = 'signup' and value >= {P.IMPLANT_LEAST} group by user_id) u left join ulist_m m on u.USER_KEY = m.mk),
users as (
  select coalesce(a.USER_KEY, b.USER_KEY) as USER_KEY,
         a.CUSTOMER_NAME as CUSTOMER_NAME_x, a.CONT_FULLPHONE as CONT_FULLPHONE_x, a.STREET as STREET_x,
         a.CITY as CITY_x, a.STATE as STATE_x, a.ZIP as ZIP_x, a.CONT_EMAIL as CONT_EMAIL_x, a.IMPLANT_QTY,
         b.CUSTOMER_NAME as CUSTOMER_NAME_y, b.CONT_FULLPHONE as CONT_FULLPHONE_y, b.STREET as STREET_y,
         b.CITY as CITY_y, b.STATE as STATE_y, b.ZIP as ZIP_y, b.CONT_EMAIL as CONT_EMAIL_y, b.IMPLANT_USD
  from ua a full outer join ub b on a.USER_KEY = b.USER_KEY)"""


def md5_int(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::bigint"


def split_ctes() -> str:
    """``split``: scored feature rows tagged train/test by md5 bucket."""
    cut = int(round(P.SPLIT_WEIGHTS[0] / sum(P.SPLIT_WEIGHTS) * 2 ** 32))
    b = md5_int(f"MDM_CUST_KEY || ':' || '{P.SEED}'")
    return lead_ctes() + f""",
split as (
  select *, case when {b} < {cut} then 'train' else 'test' end as split from scored)"""


def oversample_ctes() -> str:
    h = md5_int(f"MDM_CUST_KEY || ':' || '{P.SEED}' || ':' || 'oversample'")
    return f"""tr as (select * exclude (split, lead_gen_prob) from split where split = 'train'),
oc as (select {P.LABEL} as lab, count(*) as n from tr group by {P.LABEL}),
om as (select max(n) as mx from oc),
orank as (
  select tr.*, row_number() over (partition by {P.LABEL} order by {h}, MDM_CUST_KEY) - 1 as rk from tr),
ocp as (
  select orank.*, (om.mx // oc.n) + case when rk < om.mx % oc.n then 1 else 0 end as copies
  from orank join oc on orank.{P.LABEL} = oc.lab cross join om),
over as (select * exclude (rk, copies), cast(unnest(range(0, copies)) as integer) as COPY from ocp)"""


def metric_sql(pred_expr: str, src: str = "split where split = 'test'") -> str:
    """Select list + FROM producing accuracy, weighted precision/recall, f1, n."""
    return f"""(
with pr as (select cast({P.LABEL} as double) as l, {pred_expr} as p from {src}),
cm as (select l, p, count(*) as n from pr group by l, p),
t1 as (select l as c, sum(n) as n_true from cm group by l),
t2 as (select p as c, sum(n) as n_pred from cm group by p),
t3 as (select l as c, n as tp from cm where l = p),
per as (select c, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp
        from t1 full join t2 using (c) full join t3 using (c)),
tot as (select sum(n_true) as N from per),
m as (select *, case when n_pred > 0 then tp / n_pred else 0.0 end as pp,
                case when n_true > 0 then tp / n_true else 0.0 end as rr from per, tot)
select round(sum(tp) / first(N), 12) as accuracy,
       round(sum(n_true / N * pp), 12) as weighted_precision,
       round(sum(n_true / N * rr), 12) as weighted_recall,
       round(sum(n_true / N * case when pp + rr > 0 then 2.0 * pp * rr / (pp + rr) else 0.0 end), 12) as f1,
       cast(first(N) as bigint) as n
from m)"""
