"""Registered queries on depths, likelihoods, states, solutions and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytofold.functions import likelihood as lk
from cytofold.operators import bias as bs
from cytofold.operators import decoding as dc
from cytofold.operators import depth as dp
from cytofold.operators import evaluation as ev
from cytofold.operators import model as md
from cytofold.operators import segments as sg
from cytofold.operators import solutions as sl
from cytofold.plans.fixtures import Tables
from cytofold.plans.queries import COUNTS, ENDS, REINDEX, count_table, query, r

KEYS = ["sample_id", "chromosome", "start", "end"]
CT = f'{COUNTS}, ct as (select *, "end" - start as length from ctab)'
H = (0.02, 0.01, 0.02)


def counted(t: Tables) -> DataFrame:
    return count_table(t).withColumn("length", F.col("end") - F.col("start"))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


DEPTHS = f"""{CT}, dep as (select *, case when major_readcount + minor_readcount > 0 then minor_readcount / (major_readcount + minor_readcount) else 0 end as ratio from ct),
    depths as (select *, readcount * (1 - ratio) / length as major_depth, readcount * ratio / length as minor_depth, readcount / length as total_depth from dep)"""


@query(f'with {DEPTHS} select sample_id, chromosome, start, "end", round(ratio, 6) as allele_ratio, round(major_depth, 6) as major_depth, round(minor_depth, 6) as minor_depth, round(total_depth, 6) as total_depth from depths')
def segment_depths(t):
    return rounded(dp.segment_depths(counted(t)).select(*KEYS, "allele_ratio", "major_depth", "minor_depth", "total_depth"), ["allele_ratio", "major_depth", "minor_depth", "total_depth"])


FLAGS = f"""{DEPTHS}, q as (select *, major_readcount + minor_readcount as ar, length / ("end" - start + 1) as lr from depths), cut as (select sample_id, quantile_cont(length, 0.1) as c1, quantile_cont(ar, 0.1) as c2, quantile_cont(lr, 0.1) as c3 from q group by 1),
    flagged as (select q.*, length > c1 and ar > c2 and lr > c3 as high_quality from q join cut using (sample_id))"""


@query(f'with {FLAGS} select sample_id, chromosome, start, "end", high_quality from flagged')
def quality_flags(t):
    return dp.quality_flags(counted(t)).select(*KEYS, "high_quality")


@query(f'with {FLAGS} select sample_id, chromosome, start, "end", length, round(major_depth, 6) as major, round(minor_depth, 6) as minor, round(total_depth, 6) as total, high_quality from flagged where length > 0 and ar > 0')
def read_depth(t):
    return rounded(dp.read_depth(counted(t)), ["major", "minor", "total"])


@query(f'with {CT} select sample_id, chromosome, start, "end", round((major_readcount + minor_readcount) / (readcount + 1), 6) as phi from ct')
def genotypable_proportion(t):
    return rounded(dp.genotypable_proportion(counted(t)).select(*KEYS, "phi"), ["phi"])


@query(f"""with {CT}, p as (select *, (major_readcount + minor_readcount) / (readcount + 1) as phi from ct) select sample_id, chromosome, start, "end", round((major_readcount / (phi * length + 1e-16) - 0.02) / 0.03, 4) as mean_major,
    round((minor_readcount / (phi * length + 1e-16) - 0.02) / 0.03, 4) as mean_minor, round((readcount / (length + 1e-16) - 0.04) / 0.03, 4) as mean_total from p""")
def mean_copy_number(t):
    rows = dp.mean_copy_number(counted(t), (F.lit(0.02), F.lit(0.03)))
    return rounded(rows.select(*KEYS, "mean_major", "mean_minor", "mean_total"), ["mean_major", "mean_minor", "mean_total"], 4)


STATED = """st as (select *, 1 as major_0, 1 as minor_0, 0.02e0 as h_0, 0.01e0 as h_1, 0.02e0 as h_2, 0.4e0 as phi, major_raw * 0.03 + 0.02 as major_depth, minor_raw * 0.03 + 0.02 as minor_depth from cn_profiles)"""


def stated(t: Tables) -> DataFrame:
    rows = t.cn_profiles.withColumns({"major_0": F.lit(1), "minor_0": F.lit(1), "h_0": F.lit(0.02), "h_1": F.lit(0.01), "h_2": F.lit(0.02), "phi": F.lit(0.4)})
    return rows.withColumns({"major_depth": F.col("major_raw") * 0.03 + 0.02, "minor_depth": F.col("minor_raw") * 0.03 + 0.02})


@query(f"""with {STATED}, e as (select *, 0.02 + 0.01 * major_1 + 0.02 * major_2 as de, 0.02 + 0.01 * minor_1 + 0.02 * minor_2 as me from st)
    select sample_id, chromosome, start, "end", round((major_depth - 0.02) / 0.03, 6) + 0e0 as major_raw, round((minor_depth - 0.02) / 0.03, 6) + 0e0 as minor_raw, round(de, 6) + 0e0 as major_depth_e, round(me, 6) + 0e0 as minor_depth_e, round(de + me, 6) + 0e0 as total_depth_e,
    round((de + me) * length, 4) + 0e0 as total_e, round((de - 0.02) / 0.03, 6) + 0e0 as major_raw_e, round((me - 0.02) / 0.03, 6) + 0e0 as minor_raw_e, abs(major_1 - major_2) as major_diff, abs(minor_1 - minor_2) as minor_diff from e""")
def cn_table(t):
    names = ["major_raw", "minor_raw", "major_depth_e", "minor_depth_e", "total_depth_e", "major_raw_e", "minor_raw_e"]
    rows = rounded(rounded(dp.cn_table(stated(t)).select(*KEYS, *names, "total_e", "major_diff", "minor_diff"), names), ["total_e"], 4)
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in (*names, "total_e")})  # zero without a sign, as in the SQL


MU = f"""{STATED}, mu as (select *, (0.02 + 0.01 * major_1 + 0.02 * major_2) * 0.4 * length + 1e-16 as major_mu, (0.02 + 0.01 * minor_1 + 0.02 * minor_2) * 0.4 * length + 1e-16 as minor_mu,
    (0.04 + 0.01 * (major_1 + minor_1) + 0.02 * (major_2 + minor_2)) * length + 1e-16 as total_mu, (0.02 + 0.01 * minor_1 + 0.02 * minor_2) / (0.04 + 0.01 * (major_1 + minor_1) + 0.02 * (major_2 + minor_2)) as p,
    (c_custkey * 31 + start // 100) % 900 as x, (c_custkey * 17 + start // 50) % 60 as mk, (c_custkey * 17 + start // 50) % 60 + (c_custkey + start // 70) % 80 as n from st)"""


def with_mu(t: Tables) -> DataFrame:
    rows = dp.expected_read_counts(stated(t))
    k = (F.col("c_custkey") * 17 + F.expr("start div 50")) % 60
    return rows.withColumns({"x": (F.col("c_custkey") * 31 + F.expr("start div 100")) % 900, "mk": k, "n": k + (F.col("c_custkey") + F.expr("start div 70")) % 80})


@query(f'with {MU} select sample_id, chromosome, start, "end", round(major_mu, 4) as major_mu, round(minor_mu, 4) as minor_mu, round(total_mu, 4) as total_mu from mu')
def expected_read_counts(t):
    return rounded(with_mu(t).select(*KEYS, "major_mu", "minor_mu", "total_mu"), ["major_mu", "minor_mu", "total_mu"], 4)


@query(f'with {MU} select sample_id, chromosome, start, "end", round(greatest(1e-16, least(1 - 1e-16, p)), 6) as p from mu')
def expected_allele_ratio(t):
    return rounded(with_mu(t).select(*KEYS, "p"), ["p"])


@query(f"""with {DEPTHS} select sample_id, chromosome, start, "end", length >= 300 as segment_length_mask, (major_readcount + minor_readcount) / (readcount + 1e-16) >= 0.3 as genotyped_mask, round_even(least(greatest((total_depth - 0.04) / 0.03, 0), 1e6), 0) <= 4 as amplification_mask, total_depth <= 0.2 as depth_mask from depths""")
def segment_masks(t):
    rows = dp.segment_depths(counted(t)).withColumn("total_raw", (F.col("total_depth") - 0.04) / 0.03)
    return dp.masks(rows, 300, 0.3, 4, 0.2).select(*KEYS, "segment_length_mask", "genotyped_mask", "amplification_mask", "depth_mask")


def masked(t: Tables) -> DataFrame:
    return dp.masks(dp.segment_depths(counted(t)).withColumn("total_raw", (F.col("total_depth") - 0.04) / 0.03), 300, 0.3, 4, 0.2)


@query(f"with {CT} select sample_id, count(*) filter (where length >= 300) as n, count(*) as of_all from ct group by 1")
def segment_length_mask(t):
    return masked(t).groupBy("sample_id").agg(F.count_if("segment_length_mask").alias("n"), F.count("*").alias("of_all"))


@query(f"with {CT} select sample_id, count(*) filter (where (major_readcount + minor_readcount) / (readcount + 1e-16) >= 0.3) as n, count(*) as of_all from ct group by 1")
def genotyped_mask(t):
    return masked(t).groupBy("sample_id").agg(F.count_if("genotyped_mask").alias("n"), F.count("*").alias("of_all"))


@query(f"with {DEPTHS} select sample_id, count(*) filter (where round_even(least(greatest((total_depth - 0.04) / 0.03, 0), 1e6), 0) <= 4) as n, count(*) as of_all from depths group by 1")
def amplification_mask(t):
    return masked(t).groupBy("sample_id").agg(F.count_if("amplification_mask").alias("n"), F.count("*").alias("of_all"))


@query(f'with {CT} select sample_id, chromosome, start, "end" from ct where length > 200')
def min_length_filter(t):
    return counted(t).where("length > 200").select(*KEYS)


@query('select sample_id, chromosome, start, "end" from cn_profiles where length * 1.2 > 7000 and length > 0.75 * ("end" - start)')
def plot_segment_filter(t):
    return t.cn_profiles.where((F.col("length") * 1.2 > 7000) & (F.col("length") > 0.75 * (F.col("end") - F.col("start")))).select(*KEYS)


@query("select sample_id, chromosome, start, \"end\" from cn_profiles where chromosome = '2' and \"end\" > 15000 and start < 40000 and length >= 5000")
def region_filter(t):
    return t.cn_profiles.where("chromosome = '2' and `end` > 15000 and start < 40000 and length >= 5000").select(*KEYS)


@query(f'with {CT} select sample_id, chromosome, start, "end", round(major_readcount / minor_readcount, 6) as ratio from ct where minor_readcount > 0')
def drop_nonfinite(t):
    ratio = F.try_divide("major_readcount", "minor_readcount")
    rows = counted(t).withColumn("ratio", F.when(F.abs(ratio) != float("inf"), F.nanvl(ratio, F.lit(None).cast("double")))).dropna(subset=["ratio"])
    return rounded(rows.select(*KEYS, "ratio"), ["ratio"])


@query("""with g as (select sample_id, major_raw as v, sum(length) as w from cn_profiles group by all), c as (select *, sum(w) over (partition by sample_id order by v) as cum, sum(w) over (partition by sample_id) as tot from g)
    select sample_id, round(min(v), 6) as value from c where cum >= 0.9 * tot group by 1""")
def weighted_percentile(t):
    return rounded(dp.weighted_percentile(t.cn_profiles, ["sample_id"], "major_raw", "length", 0.9), ["value"])


@query("""with g as (select sample_id, major_raw as v, sum(length) as w from cn_profiles group by all), c as (select *, sum(w) over (partition by sample_id order by v) as cum, sum(w) over (partition by sample_id) as tot from g),
    q as (select sample_id, min(case when cum >= 0.01 * tot then v end) as lo, min(case when cum >= 0.99 * tot then v end) as hi from c group by 1) select sample_id, round(lo - 0.25 * (hi - lo), 6) as lower, round(hi + 0.25 * (hi - lo), 6) as upper from q""")
def scatter_limits(t):
    of = lambda q, n: dp.weighted_percentile(t.cn_profiles, ["sample_id"], "major_raw", "length", q).withColumnRenamed("value", n)
    margin = 0.25 * (F.col("hi") - F.col("lo"))
    return of(0.01, "lo").join(of(0.99, "hi"), "sample_id").select("sample_id", r(F.col("lo") - margin).alias("lower"), r(F.col("hi") + margin).alias("upper"))


CLUSTERS = 5
BEST = "\n".join(
    f"d{k} as materialized (select c.sample_id, c.b, min({{'v': d.best.v + c.c, 'a': c.a}}) as best from d{k - 1} d join cost c on c.sample_id = d.sample_id and c.a = d.b group by all)," for k in range(2, CLUSTERS + 1)
)
CUTS = "e5 as (select sample_id, max(i) as e5 from pre group by 1),\n" + "\n".join(f"e{k - 1} as (select e{k}.*, d{k}.best.a as e{k - 1} from e{k} join d{k} on d{k}.sample_id = e{k}.sample_id and d{k}.b = e{k}.e{k})," for k in range(CLUSTERS, 1, -1))


@query(f"""with {FLAGS}, rd as (select sample_id, length, minor_depth as x from flagged where length > 0 and ar > 0), low as (select rd.* from rd join (select sample_id, quantile_cont(x, 0.95) as top from rd group by 1) using (sample_id) where x < top),
    span as (select sample_id, min(x) as lo, max(x) as hi from low group by 1), cells as (select sample_id, lo, least(floor((x - lo) / (hi - lo) * 1024), 1023) as cell, sum(length) as w, sum(length * (x - lo)) as m, sum(length * (x - lo) * (x - lo)) as q from low join span using (sample_id) group by all),
    pre as (select sample_id, lo, row_number() over o as i, sum(w) over o as cw, sum(m) over o as cm, sum(q) over o as cq from cells window o as (partition by sample_id order by cell rows unbounded preceding) union all select sample_id, lo, 0, 0, 0, 0 from span),
    cost as materialized (select x.sample_id, x.i as a, y.i as b, (y.cq - x.cq) - (y.cm - x.cm) * (y.cm - x.cm) / (y.cw - x.cw) as c from pre x join pre y on x.sample_id = y.sample_id and x.i < y.i),
    d1 as (select sample_id, b, {{'v': c, 'a': a}} as best from cost where a = 0), {BEST} {CUTS}
    found as (select e1.sample_id, x.lo + (y.cm - x.cm) / (y.cw - x.cw) as centre, y.cw - x.cw as w from e1 cross join range(5) k join pre x on x.sample_id = e1.sample_id and x.i = [0, e1, e2, e3, e4][k.range + 1] join pre y on y.sample_id = e1.sample_id and y.i = [e1, e2, e3, e4, e5][k.range + 1])
    select sample_id, round(centre, 6) as centre from (select *, sum(w) over (partition by sample_id) as total from found) where w >= 0.01 * total""")
def minor_modes(t):
    return rounded(dp.minor_modes(dp.read_depth(counted(t))), ["centre"])


# Likelihoods. The SQL uses DuckDB's own lgamma.


@query(f'with {MU} select sample_id, chromosome, start, "end", round(lgamma(x + 0.25), 6) as log_gamma from mu')
def log_gamma(t):
    return with_mu(t).select(*KEYS, r(lk.log_gamma(F.col("x") + 0.25)).alias("log_gamma"))


def nb(x: str, mu: str, size: str) -> str:
    return f"(lgamma({x} + {size}) - lgamma({x} + 1) - lgamma({size}) + {x} * ln({mu} / ({size} + {mu})) + {size} * ln({size} / ({size} + {mu})))"


def bb(k: str, n: str, p: str, m: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + lgamma({k} + {m} * ({p})) + lgamma({n} - {k} + {m} * (1 - ({p}))) - lgamma({n} + {m}) + lgamma({m}) - lgamma({m} * ({p})) - lgamma({m} * (1 - ({p}))))"


def mixed(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"


def scored(t: Tables, value) -> DataFrame:
    return with_mu(t).select(*KEYS, r(value, 4).alias("loglik"))


LL = f'with {MU} select sample_id, chromosome, start, "end", round(EXPR, 4) as loglik from mu'


@query(LL.replace("EXPR", "x * ln(total_mu) - total_mu - lgamma(x + 1) + mk * ln(major_mu) - major_mu - lgamma(mk + 1) + (n - mk) * ln(minor_mu) - minor_mu - lgamma(n - mk + 1)"))
def poisson_loglik(t):
    return scored(t, lk.poisson(F.col("x"), F.col("total_mu")) + lk.poisson(F.col("mk"), F.col("major_mu")) + lk.poisson(F.col("n") - F.col("mk"), F.col("minor_mu")))


@query(LL.replace("EXPR", nb("x", "total_mu", "500.0")))
def negbin_loglik(t):
    return scored(t, lk.negbin(F.col("x"), F.col("total_mu"), F.lit(500.0)))


@query(LL.replace("EXPR", mixed(f"(ln(0.99) + {nb('x', 'total_mu', '500.0')})", f"(ln(0.01) + {nb('x', 'total_mu', '10.0')})")))
def negbin_mixture_loglik(t):
    return scored(t, lk.negbin_mixture(F.col("x"), F.col("total_mu"), F.lit(500.0), F.lit(10.0)))


@query(LL.replace("EXPR", "lgamma(n + 1) - lgamma(mk + 1) - lgamma(n - mk + 1) + mk * ln(p) + (n - mk) * ln(1 - p)"))
def binomial_loglik(t):
    return scored(t, lk.binomial(F.col("mk"), F.col("n"), F.col("p")))


@query(LL.replace("EXPR", bb("mk", "n", "p", "200.0")))
def betabin_loglik(t):
    return scored(t, lk.betabin(F.col("mk"), F.col("n"), F.col("p"), F.lit(200.0)))


@query(LL.replace("EXPR", mixed(f"(ln(0.99) + {bb('mk', 'n', 'p', '200.0')})", "(ln(0.01) - ln(n + 1))")))
def betabin_uniform_loglik(t):
    return scored(t, lk.betabin_uniform(F.col("mk"), F.col("n"), F.col("p"), F.lit(200.0)))


HDEL = "(greatest(major_1, minor_1, major_2, minor_2) = 0)"
LOH = "(least(major_1, minor_1) = 0 and least(major_2, minor_2) = 0)"
LOGLIK_MU = f"(case when {HDEL} then 1e-5 * length else total_mu end)"
LOGLIK_P = f"(case when {LOH} then 0.01 else p end)"


@query(f"""with {MU}, b as (select *, {LOGLIK_MU} as m_, {LOGLIK_P} as p_ from mu), c as (select *, ln(0.99) + {nb('x', 'm_', '500.0')} as a1, ln(0.01) + {nb('x', 'm_', '10.0')} as a2, ln(0.99) + {bb('mk', 'n', 'p_', '500.0')} as b1, ln(0.01) - ln(n + 1) as b2 from b)
    select sample_id, chromosome, start, "end", round(case when length >= 5000 then {mixed('a1', 'a2')} else 0 end + case when n > 10 then {mixed('b1', 'b2')} else 0 end, 4) as loglik from c""")
def segment_loglik(t):
    rows = with_mu(t).withColumns({"readcount": F.col("x"), "minor_readcount": F.col("mk"), "major_readcount": F.col("n") - F.col("mk"), "total_mask": F.col("length") >= 5000, "allele_mask": F.col("n") > 10})
    return rounded(md.segment_loglik(rows, H).select(*KEYS, "loglik"), ["loglik"], 4)


@query(f"""with {MU}, w as (select *, ln(0.99) + {nb('x', 'total_mu', '500.0')} as a, ln(0.01) + {nb('x', 'total_mu', '10.0')} as b from mu), g as (select *, case family when 0 then x / total_mu - 1 when 1 then x / total_mu - (x + 500) / (500 + total_mu)
    else (x / total_mu - (x + 500) / (500 + total_mu)) / (1 + exp(b - a)) + (x / total_mu - (x + 10) / (10 + total_mu)) * (1 - 1 / (1 + exp(b - a))) end as s from w cross join (select 0 as family union all select 1 union all select 2) f)
    select sample_id, family, round(sum(s * 2 * length), 2) as grad_0, round(sum(s * (major_1 + minor_1) * length), 2) as grad_1, round(sum(s * (major_2 + minor_2) * length), 2) as grad_2 from g group by all""")
def depth_gradient(t):
    rows = with_mu(t).withColumns({"readcount": F.col("x"), "total_0": F.lit(2), "total_1": F.col("major_1") + F.col("minor_1"), "total_2": F.col("major_2") + F.col("minor_2")})
    parts = [md.depth_gradient(rows, ["sample_id"], family=f).withColumn("family", F.lit(n)) for n, f in enumerate(("poisson", "negbin", "mixture"))]
    return rounded(md.union_all(parts), ["grad_0", "grad_1", "grad_2"], 2)


CN_MAX = 12
STATES = f"""states as (select row_number() over (order by a, b, c, d) - 1 as state, a as major_1, b as minor_1, c as major_2, d as minor_2 from (select a.range as a, b.range as b, c.range as c, d.range as d from range({CN_MAX + 1}) a, range({CN_MAX + 1}) b, range({CN_MAX + 1}) c, range({CN_MAX + 1}) d)
    where a + b <= {CN_MAX} and c + d <= {CN_MAX} and abs(a - c) <= 1 and abs(b - d) <= 1 and (a > b or (a = b and c >= d)))"""


def many_clones(clones: int) -> str:
    """States of any number of clones: states<clones>, with their copies as a list ``cn``."""
    number = range(1, clones + 1)
    near = " and ".join(f"greatest({', '.join(f'x{m}.{a}' for m in number)}) - least({', '.join(f'x{m}.{a}' for m in number)}) <= 1" for a in ("ma", "mi"))
    own, swapped = (f"[{', '.join(f'x{m}.{a}' for m in number for a in order)}]" for order in (("ma", "mi"), ("mi", "ma")))
    return f"states{clones} as materialized (select row_number() over (order by cn) - 1 as state, cn from (select {own} as cn from {', '.join(f'pair x{m}' for m in number)} where {near} and {own} >= {swapped}))"


PAIR = f"pair as (select a.range as ma, b.range as mi from range({CN_MAX + 1}) a, range({CN_MAX + 1}) b where a.range + b.range <= {CN_MAX})"
EVERY = ", ".join([PAIR, *(many_clones(m) for m in (1, 2, 3))])
#: A third clone for the profiles, which hold two: it has the alleles of the first, swapped.
COPIES = ["major_1", "minor_1", "major_2", "minor_2", "minor_1", "major_1"]


def in_sql(clones: int) -> str:
    """The copies of a profile's row as a list, the larger of it and its swap."""
    own, swapped = (f"[{', '.join(COPIES[2 * m + k] for m in range(clones) for k in order)}]" for order in ((0, 1), (1, 0)))
    return f"greatest({own}, {swapped})"


NUMBERED = ", ".join(f"""num{m} as (select sample_id, chromosome, start, length, state from (select *, {in_sql(m)} as cn from cn_profiles) join states{m} using (cn))""" for m in (1, 2, 3))


def numbered(t: Tables, clones: int) -> tuple[DataFrame, DataFrame]:
    """All states of so many clones up to twelve copies, and the profiles with the number of their state."""
    states = md.copy_states(t.spark, CN_MAX, 1, clones)
    rows = t.cn_profiles.withColumns({"major_3": F.col("minor_1"), "minor_3": F.col("major_1")})
    return states, md.number_states(rows, states).where("state is not null").select("sample_id", "chromosome", "start", "length", "state")


@query(f"with {EVERY}, {NUMBERED} " + " union all ".join(f"select {m} as clones, state, array_to_string(cn, ',') as copies, count(n.length) as n, cast(coalesce(sum(n.length), 0) as bigint) as length from states{m} left join num{m} n using (state) group by state, cn" for m in (1, 2, 3)))
def copy_states(t):
    """All states of one, two and three clones, with the profiles' segments and lengths in each."""
    parts = []
    for m in (1, 2, 3):
        states, rows = numbered(t, m)
        held = rows.groupBy("state").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
        copies = F.concat_ws(",", *(F.col(c).cast("string") for c in md.cn_columns(m)))
        listed = states.join(held, "state", "left").select(F.lit(m).cast("long").alias("clones"), F.col("state").cast("long").alias("state"), copies.alias("copies"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))
        parts.append(listed)
    return md.union_all(parts)


def brk_in_sql(clones: int) -> str:
    number = range(1, clones + 1)
    cn = f"[{', '.join(f'x{m}.range' for m in number)}]"
    near = f"greatest({', '.join(f'x{m}.range' for m in number)}) - least({', '.join(f'x{m}.range' for m in number)}) <= 1"
    return f"(select {clones} as clones, row_number() over (order by cn) - 1 as brk_state, cn from (select {cn} as cn from {', '.join(f'range({CN_MAX + 1}) x{m}' for m in number)} where {near}))"


STEPS = "steps as (select abs(major_1 + minor_1 - lag(major_1 + minor_1) over w) as d1, abs(major_2 + minor_2 - lag(major_2 + minor_2) over w) as d2 from cn_profiles window w as (partition by sample_id, chromosome order by start))"


@query(f"""with {STEPS}, st as ({' union all '.join(f'select * from {brk_in_sql(m)}' for m in (1, 2, 3))}), seen as (select cn, count(*) as n from (select unnest([[d1], [d1, d2], [d1, d2, d1]]) as cn from steps where d1 is not null) group by 1)
    select clones, brk_state, array_to_string(cn, ',') as copies, coalesce(n, 0) as n from st left join seen using (cn)""")
def breakpoint_states(t):
    """All breakpoint states of one, two and three clones, with the boundaries of the profiles whose totals change so."""
    w = Window.partitionBy("sample_id", "chromosome").orderBy("start")
    total = lambda m: F.col(f"major_{m}") + F.col(f"minor_{m}")
    steps = t.cn_profiles.select(*(F.abs(total(m) - F.lag(total(m)).over(w)).alias(f"cn_{m}") for m in (1, 2))).where("cn_1 is not null").withColumn("cn_3", F.col("cn_1"))
    parts = []
    for m in (1, 2, 3):
        states = md.breakpoint_states(t.spark, CN_MAX, 1, m)
        columns = [f"cn_{k}" for k in range(1, m + 1)]
        seen = steps.groupBy(*columns).agg(F.count("*").alias("n"))
        listed = states.join(seen, columns, "left").select(F.lit(m).cast("long").alias("clones"), F.col("brk_state").cast("long").alias("brk_state"), F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("copies"), F.coalesce("n", F.lit(0)).alias("n"))
        parts.append(listed)
    return md.union_all(parts)


COSTS = f"""{STATES}, costs as (select x.state as state_a, y.state as state_b, abs(x.major_1 + x.minor_1 - y.major_1 - y.minor_1) + abs(x.major_2 + x.minor_2 - y.major_2 - y.minor_2) as tot,
    abs(x.major_1 - y.major_1) + abs(x.minor_1 - y.minor_1) + abs(x.major_2 - y.major_2) + abs(x.minor_2 - y.minor_2) as kept, abs(x.major_1 - y.minor_1) + abs(x.minor_1 - y.major_1) + abs(x.major_2 - y.minor_2) + abs(x.minor_2 - y.major_2) as flip
    from states x, states y)"""


def cost_in_sql(clones: int) -> str:
    """(state_a, state_b, cost) of all pairs of states of so many clones."""
    number = range(clones)
    total = " + ".join(f"abs(x.cn[{2 * m + 1}] + x.cn[{2 * m + 2}] - y.cn[{2 * m + 1}] - y.cn[{2 * m + 2}])" for m in number)
    kept = " + ".join(f"abs(x.cn[{k}] - y.cn[{k}])" for k in range(1, 2 * clones + 1))
    flip = " + ".join(f"abs(x.cn[{2 * m + 1 + k}] - y.cn[{2 * m + 2 - k}])" for m in number for k in (0, 1))
    return f"cost{clones} as (select x.state as state_a, y.state as state_b, {total} + least({kept} - ({total}), {flip} - ({total})) as cost from states{clones} x, states{clones} y)"


MOVES = ", ".join(f"mv{m} as (select state as state_b, lag(state) over (partition by sample_id, chromosome order by start) as state_a from num{m}), seen{m} as (select state_a, state_b, count(*) as n from mv{m} where state_a is not null group by all)" for m in (1, 2, 3))


@query(f"""with {EVERY}, {NUMBERED}, {MOVES}, {', '.join(cost_in_sql(m) for m in (1, 2, 3))}
    {' union all '.join(f'select {m} as clones, state_a, state_b, cost, coalesce(n, 0) as n from cost{m} left join seen{m} using (state_a, state_b)' for m in (1, 2))}
    union all select 3, state_a, null, sum(cost), coalesce(sum(n), 0) from cost3 left join seen3 using (state_a, state_b) group by state_a""")
def state_transition_costs(t):
    """Costs between all states of one and two clones, of three their sums by the first state (3.2 million pairs); and how often profiles move so."""
    parts = []
    for m in (1, 2, 3):
        states, rows = numbered(t, m)
        w = Window.partitionBy("sample_id", "chromosome").orderBy("start")
        seen = rows.select(F.lag("state").over(w).alias("state_a"), F.col("state").alias("state_b")).where("state_a is not null").groupBy("state_a", "state_b").agg(F.count("*").alias("n"))
        pairs = md.state_transition_costs(states).join(seen, ["state_a", "state_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if m == 3:
            pairs = pairs.groupBy("state_a").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).withColumn("state_b", F.lit(None))
        parts.append(pairs.select(F.lit(m).cast("long").alias("clones"), *(F.col(c).cast("long").alias(c) for c in ("state_a", "state_b", "cost", "n"))))
    return md.union_all(parts)


def sql_score() -> str:
    depth = "(0.04 + 0.01 * (major_1 + minor_1) + 0.02 * (major_2 + minor_2))"
    p = f"((0.02 + 0.01 * minor_1 + 0.02 * minor_2) / {depth})"
    n, k, mu = "(major_readcount + minor_readcount)", "minor_readcount", f"({depth} * length)"
    allele = lambda m: f"(0.5 * {bb(k, n, p, m)} + 0.5 * {bb('major_readcount', n, p, m)})"
    total = f"0.99 * {nb('readcount', mu, '500.0')} + 0.01 * {nb('readcount', mu, '10.0')}"
    return f"{total} + case when {n} > 0 then 0.99 * {allele('500.0')} + 0.01 * {allele('10.0')} else 0 end - (cast(major_1 <> major_2 as int) + cast(minor_1 <> minor_2 as int)) * length * 1e-4"


SCORES = f"""{CT}, {STATES}, scores as (select ct.sample_id, ct.chromosome, s.segment_idx, st.state, {sql_score()} as score from ct join segments s on s.chromosome = ct.chromosome and s.start = ct.start and s."end" = ct."end"
    cross join states st where ct.sample_id <> 'normal')"""


def scored_segments(t: Tables) -> DataFrame:
    return counted(t).where("sample_id <> 'normal'").join(t.segments.select("segment_idx", "chromosome", "start", "end"), ["chromosome", "start", "end"])


def scores_of(t: Tables) -> DataFrame:
    return md.segment_state_scores(scored_segments(t), md.copy_states(t.spark, CN_MAX, 1), H, divergence_weight=1e-4)


@query(f"with {SCORES} select sample_id, segment_idx, state, round(score, 4) as score from scores")
def segment_state_scores(t):
    return scores_of(t).select("sample_id", "segment_idx", F.col("state").cast("long").alias("state"), r("score", 4).alias("score"))


@query(f"with {SCORES}, x as (select *, row_number() over (partition by sample_id, segment_idx order by round(score, 8) desc, state) as k from scores) select sample_id, segment_idx, state from x where k = 1")
def segment_map_state(t):
    rows = md.segment_map_state(scores_of(t).withColumn("score", r("score", 8)), ["sample_id", "segment_idx"])
    return rows.withColumn("state", F.col("state").cast("long"))


def sql_parts() -> str:
    """total_u and allele_vw of a segment and a state."""
    depth = "(0.04 + 0.01 * (major_1 + minor_1) + 0.02 * (major_2 + minor_2))"
    p, n, mu = f"((0.02 + 0.01 * minor_1 + 0.02 * minor_2) / {depth})", "(major_readcount + minor_readcount)", f"({depth} * length)"
    totals = [f"{nb('readcount', mu, size)} as total_{u}" for u, size in enumerate(("500.0", "10.0"))]
    return ", ".join(totals + [f"case when {n} > 0 then {bb(k, n, p, size)} else 0 end as allele_{v}{w}" for v, size in enumerate(("500.0", "10.0")) for w, k in enumerate(("minor_readcount", "major_readcount"))])


POST = f"""{SCORES}, top as (select *, max(score) over (partition by sample_id, segment_idx) as best from scores), pst as (select sample_id, chromosome, segment_idx, state, exp(score - best) / sum(exp(score - best)) over (partition by sample_id, segment_idx) as posterior from top)"""
PARTS = ("total_0", "total_1", "allele_00", "allele_01", "allele_10", "allele_11")
RESP = f"""{POST}, ll as (select ct.sample_id, s.segment_idx, st.state, {sql_parts()} from ct join segments s on s.chromosome = ct.chromosome and s.start = ct.start and s."end" = ct."end" cross join states st where ct.sample_id <> 'normal'),
    ex as (select sample_id, segment_idx, {', '.join(f'sum(posterior * {c}) as {c}' for c in PARTS)} from pst join ll using (sample_id, segment_idx, state) group by all),
    r1 as (select *, 1 / (1 + exp(ln(0.99) + total_0 - ln(0.01) - total_1)) as p_outlier_total, 1 / (1 + exp(ln(0.99) + 0.5 * allele_00 + 0.5 * allele_01 - ln(0.01) - 0.5 * allele_10 - 0.5 * allele_11)) as p_outlier_allele from ex),
    resp as (select *, 1 / (1 + exp((1 - p_outlier_allele) * (allele_00 - allele_01) + p_outlier_allele * (allele_10 - allele_11))) as p_allele_swap from r1)"""
RESPONSES = ["p_outlier_total", "p_outlier_allele", "p_allele_swap"]


def posteriors_of(t: Tables) -> DataFrame:
    w = Window.partitionBy("sample_id", "segment_idx")
    rows = scores_of(t).withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    return rows.select("sample_id", "segment_idx", "state", (F.col("_e") / F.sum("_e").over(w)).alias("posterior"))


def responsibilities_of(t: Tables) -> DataFrame:
    """From one product of segments and states, which the likelihoods and the scores share."""
    rows = md.segment_state_likelihoods(scored_segments(t), md.copy_states(t.spark, CN_MAX, 1), H)
    subclonal = (F.col("major_1") != F.col("major_2")).cast("int") + (F.col("minor_1") != F.col("minor_2")).cast("int")
    mean = lambda a, b: 0.99 * a + 0.01 * b
    allele = lambda v: 0.5 * (F.col(f"allele_{v}0") + F.col(f"allele_{v}1"))
    score = mean(F.col("total_0"), F.col("total_1")) + mean(allele(0), allele(1)) - subclonal * F.col("length") * 1e-4
    w = Window.partitionBy("sample_id", "segment_idx")
    rows = rows.withColumn("_score", score).withColumn("_e", F.exp(F.col("_score") - F.max("_score").over(w))).withColumn("posterior", F.col("_e") / F.sum("_e").over(w))
    return md.outlier_responsibilities(rows, ["sample_id", "segment_idx"])


@query(f"with {RESP} select sample_id, segment_idx, {', '.join(f'round({c}, 6) as {c}' for c in RESPONSES)} from resp")
def outlier_responsibilities(t):
    return rounded(responsibilities_of(t), RESPONSES)


@query(f"""with {RESP}, f as (select state from states where {LOH}), e as (select sample_id, segment_idx, sum(posterior) as w from pst where state in (select state from f) group by all), o as (select sample_id, segment_idx, w * (1 - p_outlier_allele) as w from e join resp using (sample_id, segment_idx))
    select sample_id, segment_idx, round(w / sum(w) over (partition by sample_id), 8) as weight from o""")
def state_class_weights(t):
    flagged = md.copy_states(t.spark, CN_MAX, 1).where(md.is_loh()).select("state")
    regular = responsibilities_of(t).withColumn("factor", 1 - F.col("p_outlier_allele"))
    return rounded(md.state_class_weights(posteriors_of(t), flagged, ["sample_id"], regular), ["weight"], 8)


#: Units of a score and penalties in them, of boundaries without and with a breakpoint; whole numbers, so that both engines add up the same.
UNIT, PENALTIES = 10_000, (20_000, 5_000)
LINKED = f"""{SCORES}, {COSTS.removeprefix(STATES + ', ')}, {ENDS}, ch as (select segment_idx, min(segment_idx) over (partition by chromosome, run) as chain from (select *, sum(new) over (partition by chromosome order by segment_idx) as run from (
    select segment_idx, chromosome, case when start - lag("end") over w <= 1000 then 0 else 1 end as new from segments window w as (partition by chromosome order by segment_idx)) x) y),
    cut as (select distinct chromosome, position from brk), kinds as (select s.segment_idx, chain, case when cut.position is null then {PENALTIES[0]} else {PENALTIES[1]} end as penalty from segments s join ch using (segment_idx) left join cut on cut.chromosome = s.chromosome and cut.position = s.start),
    sc as materialized (select sample_id, chain, segment_idx, penalty, dense_rank() over (partition by sample_id, chain order by segment_idx) as n, state, cast(round(score * {UNIT}) as bigint) as score from scores join kinds using (segment_idx)),
    moves as materialized (select state_a, state_b, tot + least(kept - tot, flip - tot) as cost from costs)"""


def chained(t: Tables) -> DataFrame:
    """Scores by chain, and which transitions lead into a segment: 1 where a breakpoint lies at its start."""
    scores = scores_of(t).withColumn("score", F.round(F.col("score") * UNIT))
    ends = t.breakpoints.select(F.expr("stack(2, chromosome_1, position_1, chromosome_2, position_2) as (chromosome, start)")).distinct()
    steps = t.segments.join(ends.withColumn("_cut", F.lit(1)), ["chromosome", "start"], "left").select("segment_idx", F.coalesce("_cut", F.lit(0)).alias("step"))
    return md.state_arrays(scores, ["sample_id"]).join(sg.chain_of_segments(t.segments, 1000), "segment_idx").join(steps, "segment_idx")


def transitions(t: Tables) -> np.ndarray:
    costs = md.cost_matrix(md.state_transition_costs(md.copy_states(t.spark, CN_MAX, 1)))
    return np.stack([-p * costs for p in PENALTIES])


@query(f"""with recursive {LINKED}, v as (select sample_id, chain, n, state, score as value, cast(-1 as bigint) as back from sc where n = 1 union all
    select sample_id, chain, n, state, sc.score - best.m as value, best.s as back from (select v.sample_id, v.chain, v.n + 1 as n, m.state_b as state, min({{'m': k.penalty * m.cost - v.value, 's': v.state}}) as best
        from v join (select distinct sample_id, chain, n, penalty from sc) k on k.sample_id = v.sample_id and k.chain = v.chain and k.n = v.n + 1 join moves m on m.state_a = v.state group by all) b join sc using (sample_id, chain, n, state)),
    l as (select sample_id, chain, n, min({{'m': -value, 's': state}}) as best from v group by all), f as (select sample_id, chain, max(n) as n from v group by all),
    path as (select sample_id, chain, n, best.s as state from l join f using (sample_id, chain, n) union all select p.sample_id, p.chain, p.n - 1, v.back from path p join v on v.sample_id = p.sample_id and v.chain = p.chain and v.n = p.n and v.state = p.state where p.n > 1)
    select sample_id, chain, segment_idx, path.state from path join (select distinct sample_id, chain, n, segment_idx from sc) using (sample_id, chain, n)""")
def decode_chain(t):
    rows = dc.decode_chain(chained(t), ["sample_id", "chain"], transitions(t))
    return rows.withColumn("state", F.col("state").cast("long"))


@query(f"""with recursive {LINKED}, kd as materialized (select distinct sample_id, chain, n, penalty from sc), z as (select sample_id, chain, max(n) as last from kd group by all),
    al as (select sample_id, chain, n, state, score / {UNIT} as value from sc where n = 1 union all
    select sample_id, chain, n, state, sc.score / {UNIT} + b.top + ln(b.total) from (select v.sample_id, v.chain, v.n + 1 as n, m.state_b as state, any_value(v.top) as top, sum(exp(v.value - v.top - k.penalty * m.cost / {UNIT})) as total
        from (select *, max(value) over (partition by sample_id, chain) as top from al) v join kd k on k.sample_id = v.sample_id and k.chain = v.chain and k.n = v.n + 1 join moves m on m.state_a = v.state group by all) b join sc using (sample_id, chain, n, state)),
    bw as (select sample_id, chain, n, state, cast(0 as double) as value from sc join z using (sample_id, chain) where n = last union all
    select sample_id, chain, n, state, top + ln(total) from (select v.sample_id, v.chain, v.n - 1 as n, m.state_a as state, any_value(v.top) as top, sum(exp(v.value - v.top - k.penalty * m.cost / {UNIT})) as total
        from (select *, max(value) over (partition by sample_id, chain) as top from (select bw.sample_id, bw.chain, bw.n, bw.state, bw.value + sc.score / {UNIT} as value from bw join sc using (sample_id, chain, n, state))) v
        join kd k on k.sample_id = v.sample_id and k.chain = v.chain and k.n = v.n and v.n > 1 join moves m on m.state_b = v.state group by all) b),
    both_ways as (select sample_id, chain, n, state, al.value + bw.value as value from al join bw using (sample_id, chain, n, state)), weights as (select *, exp(value - max(value) over (partition by sample_id, chain, n)) as p from both_ways)
    select sample_id, chain, segment_idx, weights.state, round(p / sum(p) over (partition by sample_id, chain, n), 6) as posterior from weights join (select distinct sample_id, chain, n, segment_idx from sc) using (sample_id, chain, n)""")
def chain_posteriors(t):
    arrays = chained(t).withColumn("scores", F.transform("scores", lambda s: s / UNIT))
    rows = dc.chain_posteriors(arrays, ["sample_id", "chain"], transitions(t) / UNIT)
    return rounded(rows.withColumn("state", F.col("state").cast("long")), ["posterior"])


@query("select segment_idx, case chromosome when '5' then 'X' else chromosome end as chromosome, 1 as normal_major, case when chromosome = '5' then 0 else 1 end as normal_minor from segments")
def normal_copies(t):
    named = t.segments.withColumn("chromosome", F.when(F.col("chromosome") == "5", "X").otherwise(F.col("chromosome")))
    return md.normal_copies(named, male=True).select("segment_idx", "chromosome", "normal_major", "normal_minor")


@query("select sample_id, chromosome, start, case when major_1 >= minor_1 and major_1 >= minor_2 then 0 when minor_1 >= minor_2 then 1 else 2 end as argmax from cn_profiles")
def argmax_column(t):
    return md.argmax_column(t.cn_profiles, ["major_1", "minor_1", "minor_2"]).select("sample_id", "chromosome", "start", "argmax")


# Solutions


@query("""with x as (select *, max(cast(proportion_divergent < 0.5 as int)) over (partition by sample_id) as anyok from solutions), y as (select *, row_number() over (partition by sample_id order by elbo desc, init_id) as k from x where proportion_divergent < 0.5 or anyok = 0)
    select sample_id, init_id, elbo, ploidy, proportion_divergent from y where k = 1""")
def select_best_solution(t):
    return sl.select_best_solution(t.solutions).select("sample_id", "init_id", "elbo", "ploidy", "proportion_divergent")


@query("with y as (select *, row_number() over (partition by sample_id order by elbo desc, init_id) as k from solutions where proportion_divergent <= 0.6 and ploidy > 1.7 and ploidy < 4.5) select sample_id, init_id, elbo, ploidy from y where k = 1")
def export_best_solution(t):
    return sl.export_best_solution(t.solutions, 0.6, 1.7, 4.5).select("sample_id", "init_id", "elbo", "ploidy")


@query("select sample_id, init_id, round(h_0 / (h_0 + h_1 + h_2), 6) as mix_0, round(h_1 / (h_0 + h_1 + h_2), 6) as mix_1, round(h_2 / (h_0 + h_1 + h_2), 6) as mix_2 from solutions")
def mixture_fractions(t):
    return sl.mixture_fractions(t.solutions).select("sample_id", "init_id", *(r(F.get("mix", F.lit(k))).alias(f"mix_{k}") for k in range(3)))


MODES = "modes as (select distinct sample_id, 0.01e0 * (1 + init_id % 5) as centre from solutions)"
CANDS = f"""{MODES}, low as (select sample_id, min(centre) as h_normal from modes group by 1), cand as (select m.sample_id, h_normal, (centre - h_normal) * s.sc as h_tumour, row_number() over (partition by m.sample_id order by centre, s.sc desc) - 1 as mode_idx
    from modes m join low l on l.sample_id = m.sample_id and m.centre > l.h_normal cross join (select 1.0e0 as sc union all select 0.5e0) s)"""


def candidates(t: Tables) -> DataFrame:
    modes = t.solutions.select("sample_id", (0.01 * (1 + F.col("init_id") % 5)).alias("centre")).distinct()
    return sl.candidate_depths(modes)


@query(f"with {CANDS} select sample_id, mode_idx, round(h_normal, 6) as h_normal, round(h_tumour, 6) as h_tumour from cand")
def candidate_depths(t):
    return rounded(candidates(t).withColumn("mode_idx", F.col("mode_idx").cast("long")), ["h_normal", "h_tumour"])


PLOIDY = f"""{CANDS}, d as (select c_custkey % 3 as sample_id, major_raw * 0.02 + 0.01 as major, minor_raw * 0.02 + 0.01 as minor, length from cn_profiles),
    pl as (select c.sample_id, mode_idx, h_normal, h_tumour, sum((major + minor - 2 * h_normal) / h_tumour * length) / sum(length) as ploidy from cand c join d on d.sample_id = c.sample_id group by all)"""


def ploidies(t: Tables) -> DataFrame:
    depths = t.cn_profiles.select((F.col("c_custkey") % 3).cast("int").alias("sample_id"), (F.col("major_raw") * 0.02 + 0.01).alias("major"), (F.col("minor_raw") * 0.02 + 0.01).alias("minor"), "length")
    return sl.estimate_ploidy(candidates(t), depths)


@query(f"with {PLOIDY} select sample_id, mode_idx, round(ploidy, 6) as ploidy from pl")
def estimate_ploidy(t):
    return rounded(ploidies(t).select("sample_id", F.col("mode_idx").cast("long").alias("mode_idx"), "ploidy"), ["ploidy"])


@query(f"""with {PLOIDY}, o as (select *, greatest(1.6 - ploidy, ploidy - 4.5, 0) as off from pl), k as (select *, min(off) over (partition by sample_id) as least_off from o), g as (select *, min(2 * h_normal + 6.25 * h_tumour) over (partition by sample_id) as max_depth from k where off = least_off)
    select sample_id, mode_idx, m.x as mix_frac, d.x as divergence_weight, round(max_depth, 6) as max_depth, round(h_tumour * m.x, 6) as h_1, round(h_tumour * (1 - m.x), 6) as h_2 from g, (select 0.45e0 as x union all select 0.2e0) m, (select 1e-6 as x union all select 1e-7) d""")
def init_grid(t):
    rows = sl.init_grid(ploidies(t), (0.45, 0.2), (1e-6, 1e-7), 1.6, 4.5, 6)
    return rounded(rows.select("sample_id", F.col("mode_idx").cast("long").alias("mode_idx"), "mix_frac", "divergence_weight", "max_depth", "h_1", "h_2"), ["max_depth", "h_1", "h_2"])


@query(f"with {CT} select sample_id, round(sum(case when readcount / length <= 0.2 then length else 0 end) / sum(length), 6) as proportion, sum(case when readcount / length <= 0.2 then length else 0 end) / sum(length) >= 0.75 as passes from ct where length > 0 group by 1")
def depth_coverage_check(t):
    rows = counted(t)
    limits = rows.select("sample_id").distinct().withColumn("max_depth", F.lit(0.2))
    return rounded(sl.depth_coverage_check(rows, limits), ["proportion"])


@query("""select sample_id, round(sum((major_1 + minor_1 + major_2 + minor_2) / 2.0 * length) / sum(length), 6) as ploidy, round(sum((cast(major_1 <> major_2 as int) + cast(minor_1 <> minor_2 as int)) * length) / (2.0 * sum(length)), 6) as proportion_divergent, 3 as num_clones, count(*) as num_segments from cn_profiles group by 1""")
def solution_stats(t):
    return rounded(sl.solution_stats(t.cn_profiles, ["sample_id"]), ["ploidy", "proportion_divergent"])


@query("with a as (select distinct init_id % 4 as ploidy_init from solutions), b as (select distinct h_1 from solutions) select ploidy_init, h_1, row_number() over (order by ploidy_init, h_1) - 1 as param_id from a, b")
def param_grid(t):
    s = t.solutions
    return sl.param_grid([s.select((F.col("init_id") % 4).alias("ploidy_init")).distinct(), s.select("h_1").distinct()]).withColumn("param_id", F.col("param_id").cast("long"))


@query("""with u as (select sample_id, fragment_id, (((fragment_id % 1000003) * 7919 + 104729) % 1000003 + 1) / 1000004.0 as u, mapping_quality as w from fragments where mapping_quality > 0), k as (select *, row_number() over (partition by sample_id order by -ln(u) / w, fragment_id) as n from u) select sample_id, fragment_id from k where n <= 50""")
def weighted_sample(t):
    return sl.weighted_sample(t.fragments, ["sample_id"], "fragment_id", "mapping_quality", 50).select("sample_id", "fragment_id")


@query("""with x as (select sample_id, init_id, elbo as validity, 0.3e0 as n, 0.9e0 as t_1, case when init_id % 2 = 0 then null else 0.4e0 end as t_2 from solutions), y as (select *, row_number() over (partition by sample_id order by validity, init_id) as k from x)
    select sample_id, init_id, round(n, 6) as mix_0, round(case when t_2 is null then 0.7 * t_1 else 0.7 * t_2 end, 6) as mix_1, round(0.7 * abs(t_1 - t_2), 6) as mix_2 from y where k = 1""")
def best_caller_init(t):
    rows = t.solutions.select("sample_id", "init_id", F.col("elbo").alias("validity"), F.lit(0.3).alias("n"), F.lit(0.9).alias("t_1"), F.when(F.col("init_id") % 2 != 0, F.lit(0.4)).alias("t_2"))
    return sl.best_caller_init(rows).select("sample_id", "init_id", *(r(F.get("mix", F.lit(k))).alias(f"mix_{k}") for k in range(3)))


@query("""with x as (select sample_id, init_id, row_number() over (partition by sample_id order by elbo + ploidy, init_id) as k from solutions) select sample_id, s.range as segment, (init_id + s.range * 3) % 5 as total from x, range(4) s where k = 1""")
def best_nll_solution(t):
    copies = F.array_join(F.array(*(((F.col("init_id") + 3 * k) % 5).cast("string") for k in range(4))), ":")
    rows = sl.best_nll_solution(t.solutions.select("sample_id", "init_id", F.col("elbo").alias("nll"), F.col("ploidy").alias("baf_nll"), copies.alias("copies")))
    return rows.select("sample_id", F.col("segment").cast("long").alias("segment"), F.col("total").cast("long").alias("total"))


@query("select sample_id, count(*) as n, max(elbo) as elbo from (select sample_id, elbo from solutions union all select sample_id, elbo + 1 from solutions) x group by 1")
def collate_solutions(t):
    rows = md.union_all([t.solutions, t.solutions.withColumn("elbo", F.col("elbo") + 1)])
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("elbo").alias("elbo"))


@query("select sample_id, init_id, h_0, h_1, h_2 from solutions where sample_id = 1 and init_id = 7")
def load_solution(t):
    return t.solutions.where("sample_id = 1 and init_id = 7").select("sample_id", "init_id", "h_0", "h_1", "h_2")


# Genome metrics and evaluation


@query("""select sample_id, sum(case when least(major_1, minor_1) = 0 then length else 0 end) as length_loh, sum(case when greatest(major_1, minor_1) = 0 then length else 0 end) as length_hdel, sum(case when major_1 + minor_1 >= 6 then length else 0 end) as length_hlamp,
    round(sum(case when least(major_1, minor_1) = 0 then length else 0 end) / sum(length), 6) as proportion_loh, round(sum(case when greatest(major_1, minor_1) = 0 then length else 0 end) / sum(length), 6) as proportion_hdel, round(sum(case when major_1 + minor_1 >= 6 then length else 0 end) / sum(length), 6) as proportion_hlamp from cn_profiles group by 1""")
def genome_state_lengths(t):
    return rounded(ev.genome_state_lengths(t.cn_profiles, ["sample_id"]), ["proportion_loh", "proportion_hdel", "proportion_hlamp"])


@query("select sample_id, sum((cast(major_2 > major_1 as int) + cast(minor_2 > minor_1 as int)) * length) as length_divergent, round(sum((cast(major_2 > major_1 as int) + cast(minor_2 > minor_1 as int)) * length) / sum(length), 6) as proportion_divergent from cn_profiles group by 1")
def clone_divergence(t):
    swapped = t.cn_profiles.select("sample_id", "length", F.col("major_2").alias("major_1"), F.col("minor_2").alias("minor_1"), F.col("major_1").alias("major_2"), F.col("minor_1").alias("minor_2"))
    return rounded(ev.clone_divergence(swapped, ["sample_id"]), ["proportion_divergent"])


@query("select sample_id, round(sum((major_1 + minor_1) * length) / sum(length), 6) as ploidy from cn_profiles group by 1")
def genome_ploidy(t):
    return rounded(ev.genome_ploidy(t.cn_profiles, ["sample_id"]), ["ploidy"])


@query("select s.sample_id, k.range as state, round(coalesce(sum(case when least(major_1, 6) = k.range then length end), 0) / sum(length), 6) as proportion from cn_profiles s, range(7) k group by all")
def state_distribution(t):
    rows = ev.state_distribution(t.cn_profiles, ["sample_id"], "major_1").withColumn("state", F.col("state").cast("long"))
    return rounded(rows, ["proportion"])


PATH = "path as (select c_custkey as clone, chromosome as chain, k as ord, (k * 3 + c_custkey) % 12 as segment, case when (k + c_custkey) % 5 = 0 then -1 else 1 end as orient, major_1 % 2 as allele from cn_profiles)"


def path_of(t: Tables) -> DataFrame:
    """The chromosomes of each customer's clone as paths of segments."""
    segment, orient = (F.col("k") * 3 + F.col("c_custkey")) % 12, F.when((F.col("k") + F.col("c_custkey")) % 5 == 0, -1).otherwise(1)
    return t.cn_profiles.select(F.col("c_custkey").alias("clone"), F.col("chromosome").alias("chain"), F.col("k").alias("ord"), segment.alias("segment"), orient.alias("orient"), (F.col("major_1") % 2).alias("allele"))


@query(f"with {PATH} select clone, segment, allele, count(*) as copies from path group by all")
def segment_copy_number(t):
    return ev.segment_copy_number(path_of(t))


PATHB = f"""{PATH}, e as (select clone, segment as n1, case when orient > 0 then 1 else 0 end as s1, coalesce(lead(segment) over w, first_value(segment) over w) as n2, case when coalesce(lead(orient) over w, first_value(orient) over w) > 0 then 0 else 1 end as s2 from path window w as (partition by clone, chain order by ord)),
    cn as (select clone, case when (n1, s1) <= (n2, s2) then n1 else n2 end as n_1, case when (n1, s1) <= (n2, s2) then s1 else s2 end as side_1, case when (n1, s1) <= (n2, s2) then n2 else n1 end as n_2, case when (n1, s1) <= (n2, s2) then s2 else s1 end as side_2 from e),
    pb as (select clone, n_1, side_1, n_2, side_2, count(*) as copies from cn where not (side_1 = 1 and side_2 = 0 and n_2 = n_1 + 1) group by all)"""


PIECES = "pc as (select chromosome, pos // 500 as segment, string_agg(base, '' order by pos) as seq from genome_bases group by all), steps as (select c_custkey as clone, p.chromosome as chain, k as ord, (k * 17 + c_custkey) % (c.length // 500) as segment, case when (k + c_custkey) % 5 = 0 then -1 else 1 end as orient from cn_profiles p join chromosomes c on c.chromosome = p.chromosome)"


@query(f"""with {PIECES}, n as (select *, (row_number() over (partition by clone, chain order by ord) - 1) // 4 as part from steps)
    select clone, chain, part, string_agg(case when orient < 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end, '' order by ord) as sequence from n join pc on pc.chromosome = n.chain and pc.segment = n.segment group by all""")
def path_sequences(t):
    pieces = bs.genome_chunks(t.genome_bases, 500).select("chromosome", F.expr("chunk_start div 500").alias("segment"), "seq")
    lengths = t.chromosomes.select(F.col("chromosome").alias("chain"), "length")
    steps = path_of(t).join(lengths, "chain").withColumn("segment", F.expr("(ord * 17 + clone) % (length div 500)"))
    named = lambda c: F.concat_ws(":", c, "segment").alias("segment")
    return ev.path_sequences(steps.withColumn("segment", named("chain")), pieces.select(named("chromosome"), "seq"), 4, block=5).withColumn("part", F.col("part").cast("long"))


def path_edges(t: Tables) -> DataFrame:
    n = path_of(t).select(F.col("segment").alias("left")).distinct()
    return ev.path_breakpoints(path_of(t), n.withColumn("right", F.col("left") + 1), block=5)


@query(f"with {PATHB} select * from pb")
def path_breakpoints(t):
    return path_edges(t)


@query(f"with {PATHB} select n_1, side_1, n_2, side_2, sum(copies) as copies from pb group by all")
def collapse_allele_breakpoints(t):
    return path_edges(t).groupBy("n_1", "side_1", "n_2", "side_2").agg(F.sum("copies").alias("copies"))


BAL = f"""{PATHB}, tot as (select (k * 3 + c_custkey) % 12 as segment_idx, count(*) % 2 as total from cn_profiles group by 1), nd as (select distinct n_1 * 1000 + n_2 * 10 + side_1 * 2 + side_2 as prediction_id, n_1, side_1, n_2, side_2 from pb),
    en as (select prediction_id, n_1 as n, side_1 as side from nd union all select prediction_id, n_2, side_2 from nd), ch as (select prediction_id, abs(h.total - o.total) as d from en join tot h on h.segment_idx = en.n join tot o on o.segment_idx = (case when side = 1 then n + 1 else n + 11 end) % 12)"""


@query(f"with {BAL} select prediction_id from ch group by 1 having sum(d) = 0")
def balanced_breakpoints(t):
    totals = t.cn_profiles.groupBy(((F.col("k") * 3 + F.col("c_custkey")) % 12).alias("segment_idx")).agg((F.count("*") % 2).alias("total"))
    ident = F.col("n_1") * 1000 + F.col("n_2") * 10 + F.col("side_1") * 2 + F.col("side_2")
    return ev.balanced_breakpoints(path_edges(t).select(ident.alias("prediction_id"), "n_1", "side_1", "n_2", "side_2").distinct(), totals, 12)


EVAL = """cuts as (select distinct sample_id, chromosome, p from (select sample_id, chromosome, start as p from cn_profiles union all select sample_id, chromosome, "end" from cn_profiles union all select sample_id, chromosome, start from cn_profiles_pred union all select sample_id, chromosome, "end" from cn_profiles_pred)),
    atoms as (select sample_id, chromosome, p as start, lead(p) over (partition by sample_id, chromosome order by p) as "end" from cuts),
    ev as (select a.sample_id, a."end" - a.start as l, x.k as kx, y.k as ky, list_sort([x.major_1, x.minor_1]) as t1, list_sort([x.major_2, x.minor_2]) as t2, list_sort([y.major_1, y.minor_1]) as p1, list_sort([y.major_2, y.minor_2]) as p2 from atoms a
    join cn_profiles x on x.sample_id = a.sample_id and x.chromosome = a.chromosome and x.start <= a.start and a."end" <= x."end" join cn_profiles_pred y on y.sample_id = a.sample_id and y.chromosome = a.chromosome and y.start <= a.start and a."end" <= y."end")"""


@query(f"""with {EVAL} select sample_id, round(sum(case when (t1 = p1 and t2 = p2) or (t1 = p2 and t2 = p1) then l else 0 end) / sum(l), 6) as proportion_cn_correct, round(sum(case when t1 = p1 then l else 0 end) / sum(l), 6) as proportion_dom_cn_correct,
    round(sum(case when (t1 = t2) = (p1 = p2) then l else 0 end) / sum(l), 6) as proportion_clonal_correct, round(sum(case when (t1 = t2) = (p1 = p2) then l else 0 end) / sum(l), 6) as proportion_subclonal_correct,
    round(sum((list_sum(p1) + list_sum(p2)) / 2.0 * l) / sum(l), 6) as pred_ploidy, round(sum((list_sum(t1) + list_sum(t2)) / 2.0 * l) / sum(l), 6) as true_ploidy,
    round(sum((cast(p1[1] <> p2[1] as int) + cast(p1[2] <> p2[2] as int)) / 2.0 * l) / sum(l), 6) as pred_proportion_divergent, round(sum((cast(t1[1] <> t2[1] as int) + cast(t1[2] <> t2[2] as int)) / 2.0 * l) / sum(l), 6) as true_proportion_divergent from ev group by 1""")
def evaluate_cn(t):
    rows = ev.evaluate_cn(t.cn_profiles, t.cn_profiles_pred, ["sample_id"], swap=True)
    return rounded(rows, [c for c in rows.columns if c != "sample_id"])


@query(f"with {EVAL} select sample_id, round(sum(case when (kx % 5 = 0) = (((ky * 7) % 10) / 10.0 > 0.5) then l else 0 end) / sum(l), 6) as correct_outlier_proportion from ev group by 1")
def evaluate_outliers(t):
    truth = t.cn_profiles.withColumn("is_outlier", F.col("k") % 5 == 0)
    pred = t.cn_profiles_pred.withColumn("p_outlier", (F.col("k") * 7 % 10) / 10)
    return rounded(ev.evaluate_outliers(truth, pred, ["sample_id"]), ["correct_outlier_proportion"])


@query("""with x as (select prediction_id, prediction_id // 50 % 3 as true_1, prediction_id // 100 % 2 as true_2, prediction_id % 350 = 0 as is_balanced from breakpoints), y as (select prediction_id, prediction_id // 50 % 2 as cn_1, prediction_id // 100 % 2 as cn_2 from breakpoints where prediction_id % 150 <> 0),
    z as (select x.*, coalesce(cn_1, 0) as cn_1, coalesce(cn_2, 0) as cn_2 from x left join y using (prediction_id) where not is_balanced), w as (select *, (true_1 = cn_1 and true_2 = cn_2) or (true_1 = cn_2 and true_2 = cn_1) as ok, true_1 > 0 or true_2 > 0 as tp, cn_1 > 0 or cn_2 > 0 as pp, least(true_1, true_2) = 0 as tz, least(cn_1, cn_2) = 0 as pz from z)
    select round(avg(cast(ok as int)), 6) as brk_cn_correct_proportion, count(*) filter (where tp) as brk_cn_present_num_true, count(*) filter (where pp) as brk_cn_present_num_pos, count(*) filter (where tp and pp) as brk_cn_present_num_true_pos,
    count(*) filter (where tp and tz) as brk_cn_subclonal_num_true, count(*) filter (where pp and pz) as brk_cn_subclonal_num_pos, count(*) filter (where tp and tz and pp and pz) as brk_cn_subclonal_num_true_pos from w""")
def evaluate_brk_cn(t):
    ids = t.breakpoints.select("prediction_id")
    truth = ids.selectExpr("prediction_id", "prediction_id div 50 % 3 as true_1", "prediction_id div 100 % 2 as true_2", "prediction_id % 350 = 0 as is_balanced")
    pred = ids.where("prediction_id % 150 <> 0").selectExpr("prediction_id", "prediction_id div 50 % 2 as cn_1", "prediction_id div 100 % 2 as cn_2")
    return rounded(ev.evaluate_brk_cn(truth, pred, swap=True), ["brk_cn_correct_proportion"])


@query("""with x as (select sample_id, init_id, greatest(h_1, h_2) as a, least(h_1, h_2) as b from solutions), y as (select sample_id, init_id, case when init_id % 2 = 0 then h_1 else greatest(h_1, h_2) end as c, case when init_id % 2 = 0 then h_1 else least(h_1, h_2) end as d from solutions)
    select concat(x.sample_id, '-', x.init_id) as sample_id, a as true_1, b as true_2, c as pred_1, d as pred_2, b / a > 0.75 as allow_swap from x join y on x.sample_id = y.sample_id and x.init_id = y.init_id""")
def evaluate_mixture(t):
    name = F.concat_ws("-", "sample_id", "init_id").alias("sample_id")
    truth = t.solutions.select(name, F.array("h_1", "h_2").alias("true_mix"))
    pred = t.solutions.select(name, F.when(F.col("init_id") % 2 == 0, F.array("h_1")).otherwise(F.array("h_1", "h_2")).alias("pred_mix"))
    at = lambda c, k: F.get(c, F.lit(k))
    return ev.evaluate_mixture(truth, pred).select("sample_id", at("true_mix", 0).alias("true_1"), at("true_mix", 1).alias("true_2"), at("pred_mix", 0).alias("pred_1"), at("pred_mix", 1).alias("pred_2"), "allow_swap")


@query("""select 'tool_a' as tool, sample_id, round(avg(major_1), 6) as score, max(c_custkey) as sim_seed from cn_profiles group by 1, 2 union all select 'tool_b', sample_id, round(avg(major_1), 6), max(c_custkey) from cn_profiles_pred group by 1, 2""")
def merge_evaluations(t):
    parts = [x.groupBy("sample_id").agg(r(F.avg("major_1")).alias("score")).withColumn("tool", F.lit(n)) for n, x in (("tool_a", t.cn_profiles), ("tool_b", t.cn_profiles_pred))]
    settings = t.profiles.groupBy("sample_id").agg(F.max("c_custkey").alias("sim_seed"))
    return md.union_all(parts).join(settings, "sample_id").select("tool", "sample_id", "score", "sim_seed")


@query(f"""with {REINDEX} select a.sample_id, a.chromosome, a.start, a."end", x.major_1 + x.minor_1 as total_1, x.major_1 as major_1, x.minor_1 as minor_1, y.major_2 + y.minor_2 as total_2, y.major_2 as major_2, y.minor_2 as minor_2 from atoms a
    join cn_profiles x on x.sample_id = a.sample_id and x.chromosome = a.chromosome and x.start <= a.start and a."end" <= x."end" join cn_profiles_pred y on y.sample_id = a.sample_id and y.chromosome = a.chromosome and y.start <= a.start and a."end" <= y."end" """)
def combine_clone_segmentations(t):
    """Clone 1 from one segmentation, clone 2 from another, on their common refinement."""
    clone = lambda rows, n: rows.select("sample_id", "chromosome", "start", "end", F.col("k").alias("idx"), (F.col(f"major_{n}") + F.col(f"minor_{n}")).alias(f"total_{n}"), f"major_{n}", f"minor_{n}")
    names = lambda n: [f"total_{n}", f"major_{n}", f"minor_{n}"]
    return sg.reindex_segments(clone(t.cn_profiles, 1), clone(t.cn_profiles_pred, 2), ["sample_id", "chromosome"], (names(1), names(2))).drop("idx_1", "idx_2")


@query("""select sample_id, chromosome, start, "end", round((major_1 * 0.01 + major_2 * 0.03) / 0.04, 6) as major_expected, round((minor_1 * 0.01 + minor_2 * 0.03) / 0.04, 6) as minor_expected, abs(major_1 - major_2) as major_diff, abs(minor_1 - minor_2) as minor_diff from cn_profiles""")
def mixture_expected_cn(t):
    """Expected copies over the tumour clones, their fractions renormalised."""
    mean = lambda a: r((F.col(f"{a}_1") * 0.01 + F.col(f"{a}_2") * 0.03) / 0.04).alias(f"{a}_expected")
    return t.cn_profiles.select(*KEYS, mean("major"), mean("minor"), *(F.abs(F.col(f"{a}_1") - F.col(f"{a}_2")).alias(f"{a}_diff") for a in ("major", "minor")))


@query("select sample_id, init_id, h_0 as n, round(h_1 * 0.3, 6) as c_1, round(h_1 * 0.7, 6) as c_2 from solutions")
def clone_depths(t):
    rows = sl.clone_depths(t.solutions.select("sample_id", "init_id", F.col("h_0").alias("h_normal"), F.col("h_1").alias("h_tumour"), F.lit(0.3).alias("mix_frac")))
    return rows.select("sample_id", "init_id", F.col("h_0").alias("n"), r("h_1").alias("c_1"), r("h_2").alias("c_2"))


# Bias


@query("select chromosome, pos, sum(case when base in ('G', 'C') then 1 else 0 end) over (partition by chromosome order by pos) as gc from genome_bases")
def gc_cumsum(t):
    return bs.gc_cumsum(bs.genome_chunks(t.genome_bases)).withColumn("gc", F.col("gc").cast("long"))


@query("select chromosome, pos, sum(case when base in ('G', 'C') then 1 else 0 end) over (partition by chromosome order by pos rows between 91 preceding and current row) as gc from genome_bases")
def gc_window_counts(t):
    return bs.gc_window_counts(bs.genome_chunks(t.genome_bases), 100, 4).withColumn("gc", F.col("gc").cast("long"))


@query('select m.chromosome, m.start, count(*) as n from mappability m join fragments f on f.chromosome = m.chromosome and f.start >= m.start and f.start < m."end" where quality >= 30 group by all')
def mappability_indicator(t):
    ok = bs.mappable(t.mappability, t.chromosomes, 30)
    return bs.covered(t.fragments, ok, "start").groupBy("chromosome", (F.expr("start div 1000") * 1000).alias("start")).agg(F.count("*").alias("n"))


SAMPLES = """cs as (select chromosome, length, sum(length) over (order by chromosome_idx) as e from chromosomes), gs as (select chromosome, k * 829348951 % 400000 - (e - length) as position, length from (select range as k from range(20000)), cs where k * 829348951 % 400000 >= e - length and k * 829348951 % 400000 < e),
    win as (select chromosome, pos, sum(case when base in ('G', 'C') then 1 else 0 end) over (partition by chromosome order by pos rows between 91 preceding and current row) as gc from genome_bases),
    gsam as (select s.sample_id, gs.chromosome, gs.position, win.gc / 92.0 as gc_percent, (select count(*) from fragments f where f.sample_id = s.sample_id and f.chromosome = gs.chromosome and f.start = gs.position) as read_count from gs join win on win.chromosome = gs.chromosome and win.pos = gs.position + 95
    cross join (select distinct sample_id from fragments) s where gs.position + 95 < gs.length and exists (select 1 from mappability m where m.chromosome = gs.chromosome and m.quality >= 1 and gs.position >= m.start and gs.position < m."end"))"""


def samples_of(t: Tables) -> DataFrame:
    return bs.gc_samples(bs.genome_chunks(t.genome_bases), t.mappability, t.chromosomes, t.fragments, 100, 4, 20_000)


@query(f"with {SAMPLES} select sample_id, chromosome, position, round(gc_percent, 6) as gc_percent, read_count from gsam")
def gc_samples(t):
    return rounded(samples_of(t), ["gc_percent"])


BINNED = f"""{SAMPLES}, bn as (select sample_id, cast(round_even(gc_percent * 100, 0) as int) as gc_bin, sum(read_count) as s, count(*) as n from gsam group by all),
    binned as (select x.sample_id, cast(g.range as int) as gc_bin, coalesce(s, 0) as sum, coalesce(n, 0) as len, coalesce(s / n, 0) as mean from (select distinct sample_id from gsam) x cross join range(101) g left join bn on bn.sample_id = x.sample_id and bn.gc_bin = g.range)"""


@query(f"with {BINNED} select sample_id, gc_bin, sum, len, round(mean, 6) as mean from binned")
def gc_binned_counts(t):
    return rounded(bs.gc_binned_counts(samples_of(t)), ["mean"])


def lowess_sql(passes: int = 3) -> str:
    """Local lines by sums over the 20 nearest of 101 bins, then rounds of bisquare weights."""
    parts = ["""pt as (select sample_id, cast(gc_bin as double) as x, mean as y from binned), nr as (select a.sample_id, a.x as x0, b.x, b.y, abs(b.x - a.x) as d, row_number() over (partition by a.sample_id, a.x order by abs(b.x - a.x), b.x) as k from pt a join pt b using (sample_id)),
    lw as (select *, pow(1 - pow(d / max(d) over (partition by sample_id, x0), 3), 3) as w from nr where k <= 20), rb0 as (select sample_id, x, 1e0 as b from pt)"""]
    for n in range(passes + 1):
        parts.append(f"""sm{n} as (select sample_id, x0, sum(w * b) as s, sum(w * b * x) as sx, sum(w * b * y) as sy, sum(w * b * x * x) as sxx, sum(w * b * x * y) as sxy from lw join rb{n} using (sample_id, x) group by all),
    ft{n} as (select pt.sample_id, x, y, case when s <> 0 then sy / s + (case when abs(s * sxx - sx * sx) > 1e-12 then (s * sxy - sx * sy) / (s * sxx - sx * sx) else 0 end) * (x - sx / s) else y end as f from sm{n} join pt on pt.sample_id = sm{n}.sample_id and pt.x = x0),
    sc{n} as (select sample_id, 6 * quantile_cont(abs(y - f), 0.5) as h from ft{n} group by 1), rb{n + 1} as (select sample_id, x, case when h = 0 then 1 when abs(y - f) < h then pow(1 - pow((y - f) / h, 2), 2) else 0 end as b from ft{n} join sc{n} using (sample_id))""")
    return ", ".join(parts) + f" select sample_id, cast(x as int) as gc_bin, round(f / nullif(max(f) over (partition by sample_id), 0), 6) as smoothed from ft{passes}"


@query(f"with {BINNED}, {lowess_sql()}")
def gc_lowess(t):
    return rounded(bs.gc_lowess(bs.gc_binned_counts(samples_of(t))), ["smoothed"])


@query("""with b as (select s.segment_idx, s.chromosome, s.start, s."end", 1 + count(f.fragment_id) as bias from segments s left join fragments f on f.chromosome = s.chromosome and f.start >= s.start and f.start < s."end" group by all)
    select segment_idx, round(bias / sum(bias) over () * sum("end" - start) over (), 4) as length from b""")
def biased_length(t):
    from cytofold.operators.intervals import find_contained_positions

    n = find_contained_positions(t.segments, t.fragments.select("chromosome", F.col("start").alias("position"))).groupBy("segment_idx").agg(F.count("*").alias("n"))
    rows = t.segments.join(n, "segment_idx", "left").withColumn("bias", 1 + F.coalesce("n", F.lit(0)))
    return rounded(bs.biased_length(rows, []).select("segment_idx", "length"), ["length"], 4)


BIAS = """cum as (select chromosome, pos, sum(case when base in ('G', 'C') then 1 else 0 end) over (partition by chromosome order by pos) as gc from genome_bases), pm as (select cum.*, m.quality >= 1 as ok from cum join mappability m on m.chromosome = cum.chromosome and pos >= m.start and pos < m."end"),
    ls as (select 168 + 10 * range as ln from range(7)), ws as (select ln, c.range as c, (1 - abs(least(floor(c.range / (ln - 8) * 100), 100) - 45) / 100) / (select sum(1 - abs(range - 45) / 100) from range(101)) as w from ls, range(221) c where c.range <= ln - 8),
    pl as (select s.segment_idx, ln, g1.gc - g0.gc as c from segments s join pm p on p.chromosome = s.chromosome and p.pos >= s.start and p.pos < s."end" join ls on p.pos + ln < s."end" join pm m on m.chromosome = p.chromosome and m.pos = p.pos + ln - 50 join cum g1 on g1.chromosome = p.chromosome and g1.pos = p.pos + ln - 4
    join cum g0 on g0.chromosome = p.chromosome and g0.pos = p.pos + 4 where p.ok and m.ok), bb as (select segment_idx, sum(w * exp(-0.5 * pow((ln - 200) / 13, 2)) / (13 * sqrt(2 * pi()))) as b from pl join ws using (ln, c) group by 1)"""


@query(f"with {BIAS} select s.segment_idx, round(coalesce(b, 0), 6) as bias from segments s left join bb on bb.segment_idx = s.segment_idx")
def segment_bias(t):
    curve = t.spark.range(101).select(F.col("id").cast("int").alias("gc_bin"), (1 - F.abs(F.col("id") - 45) / 100).alias("smoothed"))
    rows = bs.segment_bias(t.segments, bs.genome_chunks(t.genome_bases), t.mappability, t.chromosomes, curve, 200.0, 13.0, 4, 50)
    return rounded(rows.select("segment_idx", "bias"), ["bias"])


@query("""with x as (select fragment_id, "end" - start as l, fragment_id % ("end" - start + 1) as c from fragments), s as (select range as b, (1 - abs(range - 45) / 100) / sum(1 - abs(range - 45) / 100) over () as w from range(101))
    select fragment_id, round(w, 8) as weight from x join s on b = least(floor(c / l * 100), 100)""")
def gc_probability(t):
    curve = t.spark.range(101).select(F.col("id").cast("int").alias("gc_bin"), (1 - F.abs(F.col("id") - 45) / 100).alias("smoothed"))
    rows = t.fragments.select("fragment_id", (F.col("end") - F.col("start")).alias("length"), (F.col("fragment_id") % (F.col("end") - F.col("start") + 1)).cast("int").alias("gc_count"))
    return rows.join(bs.gc_probability(curve, rows.select("length").distinct()), ["length", "gc_count"]).select("fragment_id", r("gc_weight", 8).alias("weight"))


TEXT = "km as (select chromosome, pos as start, string_agg(base, '') over (partition by chromosome order by pos rows between current row and 11 following) as kmer from genome_bases), kk as (select * from km where length(kmer) = 12 and kmer not like '%N%')"


def kmers_of(t: Tables) -> DataFrame:
    return bs.kmers(bs.genome_chunks(t.genome_bases), 12)


@query(f"with {TEXT} select chromosome, start, kmer, concat(chromosome, ':', start) as id from kk")
def kmers(t):
    return kmers_of(t).select("chromosome", "start", "kmer", "id")


@query(f"with {TEXT}, c as (select *, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as c from kk) select chromosome, start as position from c qualify count(*) over (partition by c) = 1")
def unique_kmer_hits(t):
    return bs.unique_kmers(bs.genome_chunks(t.genome_bases), 12)


@query(f"with {TEXT} select id, rc from (select concat(chromosome, ':', start) as id, reverse(translate(kmer, 'ACGT', 'TGCA')) as rc from kk) x")
def reverse_complement(t):
    return kmers_of(t).select("id", bs.reverse_complement(F.col("kmer")).alias("rc"))
