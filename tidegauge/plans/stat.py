"""Statistics queries."""
from pyspark.sql import functions as F

from tidegauge.functions.hashing import POISSON_TOP
from tidegauge.operators import stats as S
from tidegauge.operators.convergence import convergence
from tidegauge.operators.neighbour_mi import neighbour_information
from tidegauge.operators.unit_root import augmented_dickey_fuller
from tidegauge.plans.common import DAILY, LI_KEYS, MONTHLY, daily, monthly, u_sql
from tidegauge.plans.registry import query, rnd, table

# the same tail formulas as closed sums: Simpson's rule for the Student density, a finite sum for even chi-square dof
T_TAIL = """greatest(0, 1 - 2*(select sum(case when i in (0,2000) then 1 when i%2=1 then 4 else 2 end
 * exp(lgamma((df+1)/2)-lgamma(df/2)-0.5::DOUBLE*ln(df*pi()))*power(1+power(abs(t)*i/2000,2)/df,-(df+1)/2))*abs(t)/2000/3 from range(2001) r(i)))"""
MOM = """(select count(*) filter (o_orderstatus='F') na, count(*) filter (o_orderstatus='O') nb, avg(o_totalprice) filter (o_orderstatus='F') ma, avg(o_totalprice) filter (o_orderstatus='O') mb,
 var_samp(o_totalprice) filter (o_orderstatus='F') va, var_samp(o_totalprice) filter (o_orderstatus='O') vb from orders)"""
WELCH = f"(select *, (ma-mb)/sqrt(va/na+vb/nb) t, power(va/na+vb/nb,2)/(power(va/na,2)/(na-1)+power(vb/nb,2)/(nb-1)) df from {MOM})"


@query("stat_1", f"select na, nb, round(t,6) t, round(df,3) df, round({T_TAIL},6) p from {WELCH}")
def stat_1(spark, sf):
    out = S.two_group_test(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return out.select(F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"), rnd("t").alias("t"), rnd("df", 3).alias("df"), rnd("p").alias("p"))


@query("stat_2", f"select round(ma,4) mean_a, round(mb,4) mean_b, round((ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)),6) cohens_d from {MOM}")
def stat_2(spark, sf):
    out = S.two_group_test(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return out.select(rnd("mean_a", 4).alias("mean_a"), rnd("mean_b", 4).alias("mean_b"), rnd("cohens_d").alias("cohens_d"))


CHI = """(with o as (select o_orderstatus a, o_orderpriority b, count(*) o from orders group by 1,2), r as (select a, sum(o) r from o group by 1), c as (select b, sum(o) c from o group by 1), n as (select sum(o) n from o)
 select any_value(n)::BIGINT n, 8 dof, sum(power(o-r*c/n,2)/(r*c/n)) chi2, min(r*c/n) min_expected from o join r using(a) join c using (b), n)"""


@query("stat_3", f"select n, dof::BIGINT dof, round(chi2,6) chi2, round(min_expected,6) min_expected, round(exp(-chi2/2)*(1+chi2/2+power(chi2/2,2)/2+power(chi2/2,3)/6),6) p from {CHI}")
def stat_3(spark, sf):
    out = S.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return out.select("n", "dof", rnd("chi2").alias("chi2"), rnd("min_expected").alias("min_expected"), rnd("p").alias("p"))


@query("stat_4", f"select round(sqrt(chi2/(n*2)),6) cramers_v from {CHI}")
def stat_4(spark, sf):
    return S.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(rnd("cramers_v").alias("cramers_v"))


@query("stat_5", f"""select l_returnflag, n, round(mean_diff,6)+0.0 mean_diff, round(t,6)+0.0 t, wins, ties, round({T_TAIL},6) p from (select *, mean_diff/(sd/sqrt(n)) t, (n-1)::DOUBLE df from
 (select l_returnflag, count(*) n, avg(l_discount-l_tax) mean_diff, stddev_samp(l_discount-l_tax) sd, count(*) filter (l_discount-l_tax>0) wins, count(*) filter (l_discount=l_tax) ties from lineitem group by 1))""")
def stat_5(spark, sf):
    out = S.paired_test(table(spark, sf, "lineitem"), F.col("l_discount"), F.col("l_tax"), ["l_returnflag"])
    return out.select("l_returnflag", "n", rnd("mean_diff").alias("mean_diff"), rnd("t").alias("t"), "wins", "ties", rnd("p").alias("p"))


def poisson_sql(u: str) -> str:
    """SQL text of the Poisson(1) inversion."""
    terms, cdf, p = [], 0.0, 2.718281828459045 ** -1
    for k in range(POISSON_TOP):
        cdf += p
        terms.append(f"({u} >= {cdf!r}::DOUBLE)::INT")
        p /= k + 1
    return "(" + "+".join(terms) + ")"


ROWS_6 = 50_000


@query("stat_6", f"""with o as (select row_number() over (order by o_orderkey) rk, count(*) over () n, o_totalprice v, o_orderstatus s from orders),
 d as (select floor({u_sql('i')}*n)::BIGINT+1 rk, count(*) w from range(1,{ROWS_6 + 1}) t(i), (select count(*) n from orders) group by 1),
 w as (select 'as given' sample, 1 w, v, s from o union all select 'resampled', w, v, s from o join d using (rk)),
 g as (select sample, sum(w) rows, sum(w) filter (s='F') na, sum(w) filter (s='O') nb, sum(w*v) filter (s='F') sa, sum(w*v) filter (s='O') sb, sum(w*v*v) filter (s='F') qa, sum(w*v*v) filter (s='O') qb from w group by 1),
 m as (select *, sa/na ma, sb/nb mb, (qa-sa*sa/na)/(na-1) va, (qb-sb*sb/nb)/(nb-1) vb from g),
 v as (select sample, rows, na, nb, (ma-mb)/sqrt(va/na+vb/nb) t, power(va/na+vb/nb,2)/(power(va/na,2)/(na-1)+power(vb/nb,2)/(nb-1)) df, (ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)) d from m)
 select sample, rows::BIGINT n, na::BIGINT na, nb::BIGINT nb, round(t,5) t, round({T_TAIL},6) p, round(d,6) cohens_d from v""")
def stat_6(spark, sf):
    """The same effect on the table and on 50,000 draws from it with replacement: t grows and p falls, d stays."""
    from tidegauge.operators.splits import resample
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    both = orders.select(F.lit("as given").alias("sample"), "o_totalprice", "o_orderstatus", F.lit(1).cast("long").alias("w")).union(
        resample(orders, "o_orderkey", ROWS_6).select(F.lit("resampled"), "o_totalprice", "o_orderstatus", "copies"))
    out = S.two_group_test(both, "o_totalprice", "o_orderstatus", "F", "O", ["sample"], F.col("w")).join(both.groupBy("sample").agg(F.sum("w").alias("n")), "sample")
    return out.select("sample", "n", F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"), rnd("t", 5).alias("t"), rnd("p").alias("p"), rnd("cohens_d").alias("cohens_d"))


WEEKED = "(select *, datediff('day', timestamp '2024-01-01', ts)//7 wk from events)"


def weeked(spark, sf):
    """Events with the week number since the first day."""
    return table(spark, sf, "events").withColumn("wk", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7))


def _psi_sql():
    edges = ",".join(f"quantile_cont(value,{i / 10})" for i in range(1, 10))
    rc = "[" + ",".join(f"count(*) filter (b={i})" for i in range(10)) + "]"
    return f"""(with e as (select event_type, [{edges}] e from events where ts < timestamp '2024-01-08' group by 1),
 b as (select w.event_type, wk, len(list_filter(e, lambda x: x <= value)) b from {WEEKED} w join e using (event_type)),
 r as (select event_type, {rc} rc, count(*) rn from b where wk=0 group by 1), c as (select event_type, wk, {rc} c, count(*) n from b group by 1,2)
 select event_type, wk, n, list_sum(list_transform(range(1,11), lambda i: (greatest(c[i]/n,0.0001::DOUBLE)-greatest(rc[i]/rn,0.0001::DOUBLE))*ln(greatest(c[i]/n,0.0001::DOUBLE)/greatest(rc[i]/rn,0.0001::DOUBLE)))) psi
 from c join r using (event_type))"""


PSI = _psi_sql()
KS = f"""(with v as (select distinct event_type, value from events), r as (select event_type, value from events where ts < timestamp '2024-01-08'),
 w as (select distinct event_type, wk from {WEEKED}),
 rc as (select event_type, value, count(*) c from r group by 1,2), cc as (select event_type, wk, value, count(*) c from {WEEKED} group by 1,2,3),
 g as (select v.event_type, wk, v.value, coalesce(rc.c,0) r, coalesce(cc.c,0) c from v join w using (event_type) left join rc using (event_type, value) left join cc using (event_type, wk, value)),
 s as (select *, sum(r) over o / sum(r) over p fr, sum(c) over o / sum(c) over p fc, sum(r) over p nr, sum(c) over p nc from g
   window p as (partition by event_type, wk), o as (partition by event_type, wk order by value))
 select event_type, wk, max(abs(fr-fc)) d, any_value(nc)::BIGINT n, any_value(nr)::BIGINT n_ref from s group by 1,2)"""
KS_P = """(case when d*d*n*n_ref/(n+n_ref) < 0.04 then 1.0::DOUBLE else least(greatest(2*list_sum(list_transform(range(1,101), lambda k: (case when k%2=1 then 1.0::DOUBLE else -1.0::DOUBLE end)*exp(-2.0::DOUBLE*k*k*d*d*n*n_ref/(n+n_ref)))),0),1) end)"""


@query("stat_7", f"select event_type, wk, n, round(psi,6)+0.0 psi, case when psi<0.1 then 'stable' when psi<0.25 then 'moderate shift' else 'significant drift' end as label from {PSI}")
def stat_7(spark, sf):
    from tidegauge.functions.scalar import psi_label
    e = weeked(spark, sf)
    out = S.psi(e.where("wk = 0"), e, "value", ["event_type"], ["wk"])
    return out.select("event_type", "wk", "n", rnd("psi").alias("psi"), psi_label(F.col("psi")).alias("label"))


@query("stat_8", f"select event_type, wk, n, n_ref, round(d,6) d, round({KS_P},6) p from {KS}")
def stat_8(spark, sf):
    e = weeked(spark, sf)
    out = S.ks(e.where("wk = 0"), e, "value", ["event_type"], ["wk"])
    return out.select("event_type", "wk", "n", "n_ref", rnd("d").alias("d"), rnd("p").alias("p"))


@query("stat_9", """with m as (select sum(l_quantity*l_quantity) a, sum(l_quantity*l_extendedprice) b, sum(l_quantity*l_discount) c, sum(l_extendedprice*l_extendedprice) d,
 sum(l_extendedprice*l_discount) e, sum(l_discount*l_discount) f from lineitem), t as (select *, a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) det from m)
 select 'l_quantity' feature, round(a*(d*f-e*e)/det,6) vif from t union all select 'l_extendedprice', round(d*(a*f-c*c)/det,6) from t union all select 'l_discount', round(f*(a*d-b*b)/det,6) from t""")
def stat_9(spark, sf):
    return S.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("vif", rnd("vif"))


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # fixed values: order priorities


@query("stat_10", """with k as (select count(distinct o_orderpriority)::INT k from orders) select 'all levels' design, k+1 as columns, k as rank from k union all select 'one level dropped', k, k from k""")
def stat_10(spark, sf):
    o = table(spark, sf, "orders")
    dummies = [F.when(F.col("o_orderpriority") == v, 1.0).otherwise(0.0) for v in LEVELS]
    return S.design_rank(o, [F.lit(1.0), *dummies], "all levels").unionByName(S.design_rank(o, [F.lit(1.0), *dummies[1:]], "one level dropped"))


@query("stat_11", "select round(sqrt((1+abs(corr(l_quantity,l_extendedprice)))/(1-abs(corr(l_quantity,l_extendedprice)))),6) condition from lineitem")
def stat_11(spark, sf):
    return S.condition_number(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).select(rnd("condition").alias("condition"))


@query("stat_12", " union all ".join(f"select '{f}' feature, round(regr_r2(l_extendedprice,{f}),6) r2 from lineitem" for f in ("l_quantity", "l_discount", "l_tax")))
def stat_12(spark, sf):
    return S.single_r2(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).withColumn("r2", rnd("r2"))


# Student quantile from the normal one (Cornish-Fisher), as SQL text
_Z = 1.959963984540054
T_CRIT = f"({_Z} + {(_Z**3 + _Z) / 4}/df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96}/df^2 + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384}/df^3 + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160}/df^4)::DOUBLE"


def ols_sql(source, y, x, by=""):
    b = f"{by}, " if by else ""
    return f"""(select {b} n, slope, intercept, sqrt((syy-slope*sxy)/df/sxx) stderr, df from (select {b} regr_count({y},{x}) n, regr_slope({y},{x}) slope, regr_intercept({y},{x}) intercept,
 regr_sxx({y},{x}) sxx, regr_syy({y},{x}) syy, regr_sxy({y},{x}) sxy, (regr_count({y},{x})-2)::DOUBLE df from {source} {'group by ' + by if by else ''}))"""


@query("stat_13", f"select n::BIGINT n, round(slope,4) slope, round(intercept,3) intercept, round(stderr,4) stderr, round(slope-{T_CRIT}*stderr,3) low, round(slope+{T_CRIT}*stderr,3) high from {ols_sql('lineitem', 'l_extendedprice', 'l_quantity')}")
def stat_13(spark, sf):
    o = S.simple_ols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return o.select("n", rnd("slope", 4).alias("slope"), rnd("intercept", 3).alias("intercept"), rnd("stderr", 4).alias("stderr"), rnd("low", 3).alias("low"), rnd("high", 3).alias("high"))


@query("stat_14", f"select series, n::BIGINT n, round(slope,5) phi, round(stderr,5) stderr, round(slope-{T_CRIT}*stderr,4) low, round(slope+{T_CRIT}*stderr,4) high from {ols_sql(f'(select *, lag(y) over (partition by series order by m) prev from {MONTHLY})', 'y', 'prev', 'series')}")
def stat_14(spark, sf):
    o = S.ar1(monthly(table(spark, sf, "orders")), "series", "m", "y")
    return o.select("series", "n", rnd("slope", 5).alias("phi"), rnd("stderr", 5).alias("stderr"), rnd("low", 4).alias("low"), rnd("high", 4).alias("high"))


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONGL = "(" + " union all ".join(f"select '{c}' feature, l_returnflag, {c} x from lineitem" for c in FEATS) + ")"


@query("stat_15", f"""with g as (select feature, l_returnflag, count(*) n, avg(x) m, var_pop(x) v from {LONGL} group by 1,2), t as (select feature, sum(n) n, count(*) k, sum(n*m)/sum(n) mm, sum(n*v) ssw from g group by 1)
 select feature, round((sum(g.n*power(m-mm,2))/(any_value(k)-1))/(any_value(ssw)/(any_value(t.n)-any_value(k))),5) f from g join t using (feature) group by 1 order by 2 desc, 1 limit 3""")
def stat_15(spark, sf):
    return S.k_best(S.anova_f(table(spark, sf, "lineitem"), "l_returnflag", FEATS), 3).withColumn("f", rnd("f", 5))


@query("stat_16", f"""with e as (select feature, [{','.join(f'quantile_cont(x,{i / 10})' for i in range(1, 10))}] e from {LONGL} group by 1),
 c as (select feature, l_returnflag, len(list_filter(e, lambda q: q <= x)) b, count(*) n from {LONGL} join e using (feature) group by 1,2,3),
 p as (select *, sum(n) over (partition by feature) t, sum(n) over (partition by feature, l_returnflag) nl, sum(n) over (partition by feature, b) nb from c)
 select feature, round(sum(n/t*ln(n*t/(nl*nb))),6) mi from p group by 1""")
def stat_16(spark, sf):
    return S.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", FEATS).withColumn("mi", rnd("mi"))


@query("stat_16_near")
def stat_16_near(spark, sf):
    """The same by distances to the third nearest line of the class."""
    return neighbour_information(table(spark, sf, "lineitem"), LI_KEYS, "l_returnflag", FEATS).withColumn("mi", rnd("mi"))


ACF = f"""(with c as (select series, m, y-avg(y) over (partition by series) c from {MONTHLY}), i as (select *, row_number() over (partition by series order by m) i, count(*) over (partition by series) n from c),
 d as (select series, sum(c*c) d from i group by 1)
 select a.series, (b.i-a.i)::INT as lag, any_value(a.n) n, sum(a.c*b.c)/any_value(d) acf from i a join i b on a.series=b.series and b.i between a.i+1 and a.i+36 join d on d.series=a.series group by 1,2)"""


@query("stat_17", f"""select series, lag, round(acf,6)+0.0 acf, round(1.959963984540054::DOUBLE*sqrt((1+2*coalesce(sum(acf*acf) over (partition by series order by lag rows between unbounded preceding and 1 preceding),0))/n),6) band from {ACF}""")
def stat_17(spark, sf):
    a = S.autocorrelation(monthly(table(spark, sf, "orders")), "series", "m", "y")
    return a.select("series", "lag", rnd("acf").alias("acf"), rnd("band").alias("band"))


@query("stat_18", f"""with recursive r as (select series, list(acf*n/(n-lag) order by lag) r from {ACF} group by 1),
 d(series, r, k, phi, a) as (select series, r, 1, [r[1]], r[1] from r union all select series, r, k+1,
  list_concat([phi[i]-t*phi[k+1-i] for i in range(1, k+1)], [t]), t from
  (select *, (r[k+1]-list_sum([phi[i]*r[k+1-i] for i in range(1, k+1)]))/(1-list_sum([phi[i]*r[i] for i in range(1, k+1)])) t from d where k < len(r)))
 select series, k as lag, round(a,6)+0.0 pacf from d""")
def stat_18(spark, sf):
    a = S.autocorrelation(monthly(table(spark, sf, "orders")), "series", "m", "y")
    return S.partial_autocorrelation(a, "series").select("series", "lag", rnd("pacf").alias("pacf"))


@query("stat_19", f"""with a as (select series, m, y-lag(y) over w dy, lag(y) over w y1 from {MONTHLY} window w as (partition by series order by m)),
 b as (select *, lag(dy) over (partition by series order by m) d1 from a), c as (select * from b where d1 is not null),
 s as (select series, count(*) n, covar_pop(y1,y1)*count(*) s11, covar_pop(d1,d1)*count(*) s22, covar_pop(y1,d1)*count(*) s12, covar_pop(y1,dy)*count(*) s1y, covar_pop(d1,dy)*count(*) s2y, covar_pop(dy,dy)*count(*) syy from c group by 1),
 t as (select *, s11*s22-s12*s12 det, (s1y*s22-s2y*s12)/(s11*s22-s12*s12) b1, (s2y*s11-s1y*s12)/(s11*s22-s12*s12) b2 from s)
 select series, n, round(b1/sqrt((syy-b1*s1y-b2*s2y)/(n-3)*s22/det),5) stat, b1/sqrt((syy-b1*s1y-b2*s2y)/(n-3)*s22/det) < -2.86 stationary from t""")
def stat_19(spark, sf):
    out = S.dickey_fuller(monthly(table(spark, sf, "orders")), "series", "m", "y")
    return out.select("series", "n", rnd("stat", 5).alias("stat"), "stationary")


@query("stat_19_aic")
def stat_19_aic(spark, sf):
    """Lag order by information criterion, the statistic at that order, and its tail probability."""
    out = augmented_dickey_fuller(monthly(table(spark, sf, "orders")), "series", "m", "y")
    return out.select("series", "n", "lags", rnd("stat", 5).alias("stat"), rnd("p").alias("p"), "stationary")


@query("stat_20", f"""with p as (select value x, row_number() over (order by {u_sql('event_id')}, event_id) pos from events),
 m as (select size, (pos-1)//size s, avg(x) m, count(*) c from p, (select unnest([10,30,100]) size) group by 1,2 having c=size)
 select size, count(*) samples, round(avg(m),6) mean, round(stddev_samp(m),6) sd, round((select stddev_pop(value) from events)/sqrt(size),6) expected_se from m group by 1""")
def stat_20(spark, sf):
    d = S.sampling_distribution(table(spark, sf, "events"), "event_id", "value", [10, 30, 100])
    return d.select("size", "samples", rnd("mean").alias("mean"), rnd("sd").alias("sd"), rnd("expected_se").alias("expected_se"))


@query("stat_21", f"""with w as (select rep, value, {poisson_sql(u_sql('event_id', 'rep'))} w from events, range(1,401) r(rep)), m as (select rep, sum(w*value)/sum(w) mean from w group by 1)
 select round(avg(mean),6) mean, round(stddev_samp(mean),6) sd, round(quantile_cont(mean,0.025),6) low, round(quantile_cont(mean,0.975),6) high from m""")
def stat_21(spark, sf):
    m = S.bootstrap_interval(S.bootstrap_means(table(spark, sf, "events"), "event_id", "value", 400))
    return m.select(*[rnd(c).alias(c) for c in ("mean", "sd", "low", "high")])


@query("stat_22", f"""with s as (select avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_discount) md, stddev_pop(l_discount) sd from lineitem),
 z as (select rep, (l_quantity-mq)/sq a, (l_discount-md)/sd b, l_extendedprice y, {poisson_sql(u_sql(*LI_KEYS, 'rep'))}::DOUBLE w from lineitem, s, range(1,301) r(rep)),
 m as (select rep, sum(w) w, sum(w*a)/sum(w) ma, sum(w*b)/sum(w) mb, sum(w*y)/sum(w) my, sum(w*a*a) aa, sum(w*b*b) bb, sum(w*a*b) ab, sum(w*a*y) ay, sum(w*b*y) by_ from z group by 1),
 c as (select rep, aa-w*ma*ma aa, bb-w*mb*mb bb, ab-w*ma*mb ab, ay-w*ma*my ay, by_-w*mb*my by_ from m)
 select rep::INT rep, 'l_quantity' feature, round((ay*bb-by_*ab)/(aa*bb-ab*ab),4) coef from c union all select rep, 'l_discount', round((by_*aa-ay*ab)/(aa*bb-ab*ab),4) from c""")
def stat_22(spark, sf):
    out = S.bootstrap_coefficients(table(spark, sf, "lineitem"), LI_KEYS, ["l_quantity", "l_discount"], "l_extendedprice", 300)
    return out.withColumn("coef", rnd("coef", 4))


@query("stat_23", """with d as (select event_type param, user_id%4 as chain, event_id, value from events), q as (select param, quantile_cont(value,0.025) low, quantile_cont(value,0.5) median, quantile_cont(value,0.975) high from d group by 1),
 p as (select param, chain, count(*) n, avg(value) m, var_samp(value) v from d group by 1,2),
 g as (select param, sum(n) draws, avg(n) len, avg(v) w, var_samp(m) bn, sum(n*m)/sum(n) mean from p group by 1),
 b as (select param, chain, floor(sqrt(n)) s, floor((pos-1)/floor(sqrt(n))) k, avg(value) bm, count(*) c from (select *, row_number() over (partition by param, chain order by event_id) pos, count(*) over (partition by param, chain) n from d) group by 1,2,3,4 having c=s),
 t as (select param, var_samp(bm)*avg(s) tau from b group by 1)
 select param, draws::BIGINT draws, round(mean,6) mean, round(median,6) median, round(low,6) low, round(high,6) high, round(sqrt(((len-1)/len*w+bn)/w),6) rhat, round(least(draws*w/tau,draws),3) ess from g join q using (param) join t using (param)""")
def stat_23(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_type").alias("param"), (F.col("user_id") % 4).alias("chain"), "event_id", "value")
    s = S.summarise_draws(d, "param", "chain", "event_id", "value")
    return s.select("param", "draws", *[rnd(c).alias(c) for c in ("mean", "median", "low", "high", "rhat")], rnd("ess", 3).alias("ess"))


@query("stat_23_rank")
def stat_23_rank(spark, sf):
    """The summary that samplers report: split chains, rank-normalised R-hat, bulk and tail sizes, shortest interval."""
    d = table(spark, sf, "events").select(F.col("event_type").alias("param"), (F.col("user_id") % 4).alias("chain"), "event_id", "value")
    c = convergence(d, "param", "chain", "event_id", "value")
    return c.select("param", "draws", *[rnd(x).alias(x) for x in ("mean", "sd", "hdi_low", "hdi_high", "mcse_mean", "rhat")], rnd("ess_bulk", 3).alias("ess_bulk"), rnd("ess_tail", 3).alias("ess_tail"))


@query("stat_24", f"""with p as (select *, lag(y) over (partition by series order by d) prev from {DAILY}), q as (select * from p where prev is not null),
 f as (select series, slope, intercept, stderr, stderr*sqrt(sxx) sigma from (select series, slope, intercept, stderr, (select regr_sxx(y,prev) from q where q.series=o.series) sxx from {ols_sql('q', 'y', 'prev', 'series')} o)),
 s as (select q.series, strftime(q.d,'%Y-%m-%d') d, y, intercept + (slope+stderr*(sqrt(-2*ln(greatest({u_sql('q.series', 'draw', seed=7)},1e-12::DOUBLE)))*cos(2*pi()*{u_sql('q.series', 'draw', seed=8)})))*prev + sigma*(sqrt(-2*ln(greatest({u_sql('q.series', "strftime(q.d,'%Y-%m-%d')", 'draw', seed=11)},1e-12::DOUBLE)))*cos(2*pi()*{u_sql('q.series', "strftime(q.d,'%Y-%m-%d')", 'draw', seed=12)})) s from q join f using (series), range(1,101) r(draw))
 select series, d, any_value(y) y, round(quantile_cont(s,0.05),4) low, round(quantile_cont(s,0.95),4) high from s group by 1,2""")
def stat_24(spark, sf):
    b = S.predictive_band(daily(table(spark, sf, "events")), "series", "d", "y", 100)
    return b.select("series", F.date_format("d", "yyyy-MM-dd").alias("d"), "y", rnd("low", 4).alias("low"), rnd("high", 4).alias("high"))


@query("stat_25", """with s as (select user_id, count(*) n, avg(value) mean from events group by 1), p as (select *, 1/100.0::DOUBLE+n/2500.0::DOUBLE prec from s)
 select user_id, n, round(mean,6) mean, round((40/100.0::DOUBLE+n*mean/2500.0::DOUBLE)/prec,6) posterior_mean, round(sqrt(1/prec),6) posterior_sd, round((1/100.0::DOUBLE)/prec,6) shrinkage from p""")
def stat_25(spark, sf):
    c = S.conjugate_normal(table(spark, sf, "events"), "user_id", "value", 40.0, 10.0, 50.0)
    return c.select("user_id", "n", *[rnd(x).alias(x) for x in ("mean", "posterior_mean", "posterior_sd", "shrinkage")])


@query("stat_26", """with m as (select regr_count(l_extendedprice,l_quantity)::BIGINT n, regr_syy(l_extendedprice,l_quantity) sst, regr_sxy(l_extendedprice,l_quantity) sxy, regr_sxx(l_extendedprice,l_quantity) sxx from lineitem)
 select n, round((sst-sxy*sxy/sxx)/1e6,3) sse_m, round(sst/1e6,3) sst_m, round(sxy*sxy/sxx/sst,6) r2, true as identity from m""")
def stat_26(spark, sf):
    s = S.sum_of_squares(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return s.select("n", rnd(F.col("sse") / 1e6, 3).alias("sse_m"), rnd(F.col("sst") / 1e6, 3).alias("sst_m"), rnd("r2").alias("r2"), "identity")
