"""Registered queries over the derived domain tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytofold.operators import breakpoints as bp
from cytofold.operators import counts as ct
from cytofold.operators import haplotypes as hp
from cytofold.operators import intervals as iv
from cytofold.operators import segments as sg
from cytofold.plans.fixtures import Tables, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the domain tables under its name, with the SQL it must agree with."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql)
        return build

    return register


def r(column, digits: int = 6):
    """A rounded double, so that both engines agree on the last digit."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits)


def good(t: Tables) -> DataFrame:
    return ct.read_quality_filter(t.fragments)


GOOD = "good as (select * from fragments where mapping_quality >= 1)"
SEG = 'seg as (select *, lag("end") over (partition by chromosome order by start, "end") as prev_end, lead(start) over (partition by chromosome order by start, "end") as next_start from segments)'
COUNTED = f"""{GOOD}, {SEG}, hits as (select f.sample_id, s.segment_idx, count(*) as n from good f join seg s on f.chromosome = s.chromosome and f.start >= s.start and f."end" <= s."end" and (s.prev_end is null or f.start > s.prev_end) group by all),
counted as (select x.sample_id, s.segment_idx, s.chromosome, s.start, s."end", coalesce(n, 0) as readcount from (select distinct sample_id from good) x cross join segments s left join hits h on h.sample_id = x.sample_id and h.segment_idx = s.segment_idx)"""
ENDS = "brk as (select prediction_id, 0 as side, chromosome_1 as chromosome, strand_1 as strand, position_1 as position from breakpoints union all select prediction_id, 1, chromosome_2, strand_2, position_2 from breakpoints)"


# Scans and projections


@query("select fragment_id, start, \"end\" from fragments where chromosome = '1' and mapping_quality >= 1 and is_duplicate = 0")
def scan_fragments(t):
    return ct.read_quality_filter(t.fragments.where("chromosome = '1'"), filter_duplicates=True).select("fragment_id", "start", "end")


@query("select fragment_id, position, is_alt from alleles where chromosome = '1'")
def scan_alleles(t):
    return t.alleles.where("chromosome = '1'").select("fragment_id", "position", "is_alt")


@query("select distinct chromosome from fragments")
def list_chromosomes(t):
    return t.fragments.select("chromosome").distinct()


@query("select sample_id, count(*) as n, sum(\"end\" - start) as bases from fragments where is_duplicate = 0 and mapping_quality >= 20 group by 1")
def read_quality_filter(t):
    kept = ct.read_quality_filter(t.fragments, True, 20)
    return kept.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("select name, is_first, pos from alignments where abs(insert_size) <= 1000 and insert_size <> 0 and cigar <> '20S80M'")
def concordant_alignment_filter(t):
    return ct.concordant_alignments(t.alignments).select("name", "is_first", "pos")


@query("select sample_id, chromosome, concat('r', fragment_id) as name, start, \"end\", mapping_quality, is_duplicate from fragments where fragment_id % 13 <> 0")
def pair_reads_to_fragments(t):
    return ct.pair_reads(ct.concordant_alignments(t.alignments))


# Segmentation


@query('select segment_idx, chromosome, start, "end" from segments')
def create_segments(t):
    return sg.create_segments(t.chromosomes, t.gaps, t.breakpoints, 10_000)


@query('select c.chromosome_idx, s.chromosome, s.start, s."end" from segments s join chromosomes c using (chromosome)')
def segment_order(t):
    return sg.segment_order(t.segments, t.chromosomes).select("chromosome_idx", "chromosome", "start", "end")


@query("""with b as (select chromosome, 1000 * k as start, 1000 * k + 1000 as "end" from chromosomes cross join (select range as k from range(100)) where 1000 * k < length),
    bb as (select *, lag("end") over (partition by chromosome order by start) as prev_end from b), good as (select * from fragments where mapping_quality >= 1),
    h as (select f.sample_id, b.chromosome, b.start, count(*) as n from good f join bb b on f.chromosome = b.chromosome and f.start >= b.start and f."end" <= b."end" and (prev_end is null or f.start > prev_end) group by all)
    select s.sample_id, b.chromosome, b.start, b."end", coalesce(n, 0) as readcount from (select distinct sample_id from good) s cross join b left join h on h.sample_id = s.sample_id and h.chromosome = b.chromosome and h.start = b.start""")
def bin_read_counts(t):
    return iv.contained_counts(sg.fixed_bins(t.chromosomes, 1000), good(t), ["sample_id"], width=1000)


@query('select chromosome, 3000 * k as start, 3000 * k + 3000 as "end" from (select chromosome, max("end") as length from fragments group by 1) cross join (select range as k from range(40)) where 3000 * k < length')
def fixed_bins(t):
    return sg.fixed_bins(t.fragments.groupBy("chromosome").agg(F.max("end").alias("length")), 3000)


REINDEX = """cuts as (select distinct sample_id, chromosome, p from (select sample_id, chromosome, start as p from cn_profiles union all select sample_id, chromosome, "end" from cn_profiles
    union all select sample_id, chromosome, start from cn_profiles_pred union all select sample_id, chromosome, "end" from cn_profiles_pred)),
    atoms as (select sample_id, chromosome, p as start, lead(p) over (partition by sample_id, chromosome order by p) as "end" from cuts)"""


@query(f"""with {REINDEX} select a.sample_id, a.chromosome, a.start, a."end", x.k as idx_1, y.k as idx_2 from atoms a join cn_profiles x on x.sample_id = a.sample_id and x.chromosome = a.chromosome and x.start <= a.start and a."end" <= x."end"
    join cn_profiles_pred y on y.sample_id = a.sample_id and y.chromosome = a.chromosome and y.start <= a.start and a."end" <= y."end" """)
def reindex_segments(t):
    return sg.reindex_segments(t.cn_profiles.withColumnRenamed("k", "idx"), t.cn_profiles_pred.withColumnRenamed("k", "idx"), ["sample_id", "chromosome"])


RUNS = """runs as (select *, sum(new) over (partition by sample_id, chromosome order by start) as run from (select *, case when major_1 is distinct from lag(major_1) over w or minor_1 is distinct from lag(minor_1) over w
    or lag(1) over w is null then 1 else 0 end as new from (select *, least(major_1, 2) as major_1c from cn_profiles) window w as (partition by sample_id, chromosome order by start)))"""


@query(f"""with {RUNS} select sample_id, chromosome, major_1, minor_1, min(start) as start, max("end") as "end", sum(length) as length, min_by(k, start) as k, round(sum(major_raw * length) / (sum(length) + 1e-16), 6) as major_raw
    from runs group by sample_id, chromosome, run, major_1, minor_1""")
def aggregate_adjacent(t):
    rows = sg.aggregate_adjacent(t.cn_profiles, ["sample_id"], ["major_1", "minor_1"], ["k"], ["major_raw"])
    return rows.withColumn("major_raw", r("major_raw"))


@query("""with x as (select *, case when major_1 is distinct from lag(major_1) over w or minor_1 is distinct from lag(minor_1) over w or major_2 is distinct from lag(major_2) over w or minor_2 is distinct from lag(minor_2) over w or lag(1) over w is null then 1 else 0 end as new
    from cn_profiles window w as (partition by sample_id, chromosome order by start)), y as (select *, sum(new) over (partition by sample_id, chromosome order by start) as run from x)
    select sample_id, chromosome, min(start) as start, max("end") as "end" from y group by sample_id, chromosome, run""")
def perfect_segments(t):
    return sg.perfect_segments(t.cn_profiles, ["sample_id"], ["major_1", "minor_1", "major_2", "minor_2"])


STATES = "pos as (select chromosome, position, (ref_n + position // 50) % 2 as minor, 1 + (position // 1500) % 2 as major, case when (position // 2000) % 3 = 0 then null else ((position // 2000) % 3) * 0.4e0 end as prevalence from (select chromosome, position, 0 as ref_n from alleles group by chromosome, position))"


@query(f"""with {STATES}, p as (select chromosome, position, minor, major, coalesce(prevalence, 1e0) as prevalence from pos),
    q as (select *, case when minor <> lag(minor) over w or major <> lag(major) over w or prevalence <> lag(prevalence) over w or lag(1) over w is null then 1 else 0 end as new from p window w as (partition by chromosome order by position)),
    z as (select *, sum(new) over (partition by chromosome order by position) as run from q),
    s as (select chromosome, minor, major, prevalence, min(position) as start, max(position) as "end" from z group by chromosome, run, minor, major, prevalence)
    select chromosome, start, "end", case when prevalence >= 0.5 then major else 1 end as major_1, case when prevalence >= 0.5 then minor else 1 end as minor_1, case when prevalence < 0.5 then major else 1 end as major_2, case when prevalence < 0.5 then minor else 1 end as minor_2,
    round(least(prevalence, 1 - prevalence), 6) as alt_prevalence from s""")
def state_runs(t):
    rows = t.alleles.select("chromosome", "position").distinct()
    third = F.floor(F.col("position") / 2000) % 3
    pos = rows.select("chromosome", "position", (F.floor(F.col("position") / 50) % 2).alias("minor"), (1 + F.floor(F.col("position") / 1500) % 2).alias("major"), F.when(third != 0, third * 0.4).alias("prevalence"))
    return sg.state_runs(pos, 5_000).withColumn("alt_prevalence", r("alt_prevalence"))


@query("with s as (select distinct major_1 + minor_1 as total from cn_profiles) select total, m.range as minor, total - m.range as major, row_number() over (order by total, m.range) - 1 as state from s join range(20) m on m.range <= total // 2")
def state_map(t):
    return sg.state_map(t.cn_profiles.select((F.col("major_1") + F.col("minor_1")).alias("total")).distinct()).withColumn("state", F.col("state").cast("long"))


@query("""with s as (select *, sum("end" - start) over (order by segment_idx) as e from segments) select f.fragment_id, f.start as position, s.segment_idx, s.chromosome, f.start - (s.e - (s."end" - s.start)) + s.start as original
    from fragments f join s on f.start >= s.e - (s."end" - s.start) and f.start < s.e""")
def segment_remap(t):
    return sg.segment_remap(t.segments, t.fragments.select("fragment_id", F.col("start").alias("position")), 5_000)


@query("""with x as (select chromosome, start // 50 as k, cast((start * 37) % 3 as int) as q from fragments), y as (select chromosome, k as position, max(q) as quality from x group by all),
    z as (select *, position - row_number() over (partition by chromosome, quality order by position) as g from y) select chromosome, quality, min(position) as start, max(position) + 1 as "end" from z group by chromosome, quality, g""")
def mappability_runs(t):
    rows = t.fragments.groupBy("chromosome", F.expr("start div 50").alias("position")).agg(F.max((F.col("start") * 37 % 3).cast("int")).alias("quality"))
    return sg.position_runs(rows, "quality", 100)


# Interval joins


@query(f"with {COUNTED} select sample_id, segment_idx, chromosome, start, \"end\", readcount from counted")
def segment_read_counts(t):
    return ct.segment_read_counts(t.segments, t.fragments)


@query(f'with {SEG} select s.chromosome, s.start, s."end", count(f.fragment_id) as readcount from seg s left join fragments f on f.chromosome = s.chromosome and f.start >= s.start and f."end" <= s."end" and (s.prev_end is null or f.start > s.prev_end) group by all')
def contained_counts(t):
    return iv.contained_counts(t.segments.drop("segment_idx"), t.fragments, [])


@query('select s.segment_idx, s.chromosome, s.start, s."end", count(f.fragment_id) as n from segments s left join fragments f on f.chromosome = s.chromosome and s.start < f.start and f.start < s."end" group by all')
def overlapping_counts(t):
    return iv.overlapping_counts(t.segments, t.fragments.withColumnRenamed("start", "position").drop("end"))


@query('select f.fragment_id, f.start as position, coalesce(s.segment_idx, -1) as segment_idx from fragments f left join segments s on s.chromosome = f.chromosome and s.start <= f.start and f.start < s."end"')
def find_contained_positions(t):
    return iv.find_contained_positions(t.segments, t.fragments.select("chromosome", "fragment_id", F.col("start").alias("position"))).drop("chromosome")


@query(f'with {SEG} select f.fragment_id, coalesce(s.segment_idx, -1) as segment_idx from fragments f left join seg s on s.chromosome = f.chromosome and f.start >= s.start and (s.next_start is null or f.start < s.next_start) and f."end" <= s."end" and (s.prev_end is null or f."end" > s.prev_end)')
def find_contained_segments(t):
    return iv.find_contained_segments(t.segments, t.fragments.select("chromosome", "fragment_id", "start", "end")).select("fragment_id", "segment_idx")


@query('select f.fragment_id, p.position, p.gt from fragments f join snps p on p.chromosome = f.chromosome and f.start <= p.position and p.position < f."end"')
def interval_position_overlap(t):
    return iv.interval_position_overlap(t.fragments, t.snps, width=500).select("fragment_id", "position", "gt")


@query("select fragment_id, start + x.range as value from (select fragment_id, start, fragment_id % 4 as length from fragments) join range(4) x on x.range < length")
def vrange(t):
    return iv.vrange(t.fragments.select("fragment_id", "start", (F.col("fragment_id") % 4).cast("long").alias("length"))).select("fragment_id", "value")


@query('select fragment_id from fragments f where not exists (select 1 from gaps g where g.chromosome = f.chromosome and f.start >= g.start and f.start < g."end")')
def gap_anti_join(t):
    return iv.in_gaps(t.fragments, t.gaps, "start", "left_anti").select("fragment_id")


# Breakpoints


@query(f"with {ENDS} select prediction_id, side as prediction_side, chromosome, strand, position from brk")
def breakends(t):
    return bp.breakends(t.breakpoints)


MATCHED = """a as (select prediction_id as i, 0 as s, chromosome_1 as c, strand_1 as d, position_1 as p from breakpoints union all select prediction_id, 1, chromosome_2, strand_2, position_2 from breakpoints),
    b as (select prediction_id as i, 0 as s, chromosome_1 as c, strand_1 as d, position_1 as p from breakpoints_b union all select prediction_id, 1, chromosome_2, strand_2, position_2 from breakpoints_b)"""


@query(f"""with {MATCHED} select a.i as prediction_id_1, b.i as prediction_id_2 from a join b on a.c = b.c and a.d = b.d and b.p >= a.p - 400 and b.p < a.p + 400 group by all having count(*) = 2 and count(distinct a.s) = 2 and count(distinct b.s) = 2""")
def match_breakpoints(t):
    return bp.match_breakpoints(t.breakpoints, t.breakpoints_b, 400)


@query(f"""with {MATCHED}, m as (select x.i, y.i as j, x.s as s1, y.s as s2, abs(x.p - y.p) as d from a x join b y on x.c = y.c and x.d = y.d and abs(x.p - y.p) <= 300),
    z as (select m.i, m.j, row_number() over (partition by m.i order by m.d + n.d, m.j) as k from m join m n on n.i = m.i and n.j = m.j and m.s1 = 0 and n.s1 = 1 and m.s2 <> n.s2)
    select p.prediction_id, z.j as db_id from breakpoints p left join z on z.i = p.prediction_id and z.k = 1""")
def query_breakpoint_db(t):
    return bp.query_breakpoint_db(t.breakpoints, t.breakpoints_b, 300)


CLOSEST = f"""{ENDS}, e as (select chromosome, segment_idx, 0 as side, '-' as strand, start as position from segments union all select chromosome, segment_idx, 1, '+', "end" from segments),
    pairs as (select b.prediction_id, b.side as prediction_side, e.segment_idx, e.side, e.position as end_position, abs(e.position - b.position) as d, b.position, min(e.position) over w as lo, max(e.position) over w as hi,
        row_number() over (partition by b.prediction_id, b.side order by abs(e.position - b.position), e.position desc, e.segment_idx desc) as k from brk b join e on e.chromosome = b.chromosome and e.strand = b.strand window w as (partition by b.prediction_id, b.side)),
    closest as (select prediction_id, prediction_side, segment_idx, side, end_position, case when position < lo or position > hi then -d else d end as dist from pairs where k = 1)"""


@query(f"with {CLOSEST} select * from closest")
def closest_segment_end(t):
    return bp.closest_segment_end(t.segments, t.breakpoints)


ADJ = """adj as (select segment_idx as l, nxt as rr from (select segment_idx, "end", lead(segment_idx) over w as nxt, lead(start) over w as ns from segments window w as (partition by chromosome order by segment_idx)) where ns - "end" <= 1000)"""
NODES = f"""{CLOSEST}, {ADJ}, nodes as (select x.prediction_id, x.segment_idx as n_1, x.side as side_1, y.segment_idx as n_2, y.side as side_2, x.dist + y.dist as dist from closest x join closest y on x.prediction_id = y.prediction_id and x.prediction_side = 0 and y.prediction_side = 1
    where x.dist + y.dist <= 2000 and not (x.segment_idx = y.segment_idx and x.side = y.side) and not exists (select 1 from adj where (l = x.segment_idx and x.side = 1 and rr = y.segment_idx and y.side = 0) or (l = y.segment_idx and y.side = 1 and rr = x.segment_idx and x.side = 0)))"""


@query(f"with {NODES} select * from nodes")
def breakpoint_segments(t):
    return bp.breakpoint_segments(t.segments, t.breakpoints, sg.wild_type_adjacencies(t.segments, 1000))


@query(f"with {ADJ} select l as \"left\", rr as \"right\" from adj")
def wild_type_adjacencies(t):
    return sg.wild_type_adjacencies(t.segments, 1000)


@query("""with x as (select segment_idx, chromosome, case when start - lag("end") over w <= 1000 then 0 else 1 end as new from segments window w as (partition by chromosome order by segment_idx)), y as (select *, sum(new) over (order by segment_idx) as run from x)
    select chromosome, min(segment_idx) as first, max(segment_idx) + 1 as last from y group by chromosome, run""")
def chains(t):
    return sg.chains(t.segments, 1000)


@query("""select *, case when chromosome_1 <> chromosome_2 then 'translocation' when strand_1 = strand_2 then 'inversion' when (position_1 < position_2 and strand_1 = '+') or (position_1 > position_2 and strand_2 = '+') or (position_1 = position_2) then 'deletion' else 'duplication' end as type from breakpoints""")
def breakpoint_type(t):
    return bp.breakpoint_type(t.breakpoints)


@query(f"""with {NODES}, n as (select prediction_id, n_1 as n, side_1 as side from nodes union all select prediction_id, n_2, side_2 from nodes), m as (select *, case when side = 1 then n else n - 1 end as n_left from n)
    select prediction_id, n, side, n_left, case when side = 1 then 1 else -1 end as orient, row_number() over (partition by n_left order by prediction_id, n, side) - 1 as rank, case when exists (select 1 from adj where l = n_left) then 0 else 1 end as is_telomere from m""")
def breakend_boundaries(t):
    adjacent = sg.wild_type_adjacencies(t.segments, 1000)
    nodes = bp.breakpoint_segments(t.segments, t.breakpoints, adjacent).select("prediction_id", F.expr("stack(2, n_1, side_1, n_2, side_2) as (n, side)"))
    return bp.breakend_boundaries(nodes, adjacent)


@query("select * from breakpoints where chromosome_1 in (select chromosome from segments where start > 85000) and chromosome_2 in (select chromosome from segments where start > 85000)")
def breakpoint_chromosome_filter(t):
    return bp.breakpoint_chromosome_filter(t.breakpoints, t.segments.where("start > 85000"))


# SNPs and haplotypes


SNPC = "c as (select sample_id, chromosome, position, count(*) filter (where is_alt = 0) as ref_count, count(*) filter (where is_alt = 1) as alt_count from alleles group by all)"


@query(f"with {SNPC} select * from c")
def snp_counts(t):
    return ct.snp_counts(t.alleles, ["sample_id"])


@query("select chromosome, position, count(*) filter (where is_alt = 0) as ref_count, count(*) filter (where is_alt = 1) as alt_count from alleles where sample_id <> 'normal' group by all")
def pooled_tumour_snp_counts(t):
    return ct.snp_counts(t.alleles.where("sample_id <> 'normal'"), [])


GENO = f"""{SNPC}, g as (select chromosome, position, ref_count, alt_count, pow(0.01, alt_count) * pow(0.99, ref_count) as a, pow(0.5, alt_count + ref_count) as b, pow(0.01, ref_count) * pow(0.99, alt_count) as d from c where sample_id = 'normal'),
    geno as (select chromosome, position, ref_count, alt_count, cast(a / (a + b + d) >= 0.9 as int) as AA, cast(b / (a + b + d) >= 0.9 as int) as AB, cast(d / (a + b + d) >= 0.9 as int) as BB from g)"""


@query(f"with {GENO} select * from geno")
def snp_genotypes(t):
    return hp.snp_genotypes(ct.snp_counts(t.alleles.where("sample_id = 'normal'"), []))


@query("""with c as (select chromosome, position, count(*) filter (where is_alt = 0) as ref_count, count(*) filter (where is_alt = 1) as alt_count from alleles where sample_id <> 'normal' group by all having count(*) > 20),
    tail as (select chromosome, position, ref_count, alt_count, sum(case when k.range >= ref_count then m else 0 end) as pa, sum(case when k.range >= alt_count then m else 0 end) as pb
    from (select *, ref_count + alt_count as n from c), range(200) k, lateral (select exp(lgamma(n + 1) - lgamma(k.range + 1) - lgamma(n - k.range + 1) + k.range * ln(0.01) + (n - k.range) * ln(0.99)) as m) where k.range <= n group by all)
    select chromosome, position, ref_count, alt_count, cast(pa < 1e-16 and not pb < 1e-16 as int) as AA, cast(pa < 1e-16 and pb < 1e-16 as int) as AB, cast(not pa < 1e-16 and pb < 1e-16 as int) as BB from tail""")
def tumour_genotypes(t):
    return hp.tumour_genotypes(ct.snp_counts(t.alleles.where("sample_id <> 'normal'"), []), min_total=20)


@query("""with h as (select *, coalesce(abs(allele1 - lag(allele1) over (partition by sample_no, chromosome order by position)), 0) as ch from phasing_samples where allele1 <> allele2),
    f as (select chromosome, position, avg(ch) as f from h group by all), g as (select *, greatest(f, 1 - f) as confidence, case when f > 0.5 then 1 else 0 end as cp, lag(1) over (partition by chromosome order by position) is null as fresh from f),
    y as (select *, sum(case when confidence < 0.95 or fresh then 1 else 0 end) over (order by chromosome, position) - 1 as hap_label, sum(cp) over (partition by chromosome order by position) % 2 as a1 from g)
    select chromosome, position, hap_label, a1 as allele1, 1 - a1 as allele2, round(confidence, 6) as confidence from y""")
def haplotype_blocks(t):
    return hp.haplotype_blocks(t.phasing_samples).withColumn("confidence", r("confidence"))


@query("""with h as (select *, coalesce(abs(allele1 - lag(allele1) over (partition by sample_no, chromosome order by position)), 0) as ch from phasing_samples where allele1 <> allele2),
    f as (select chromosome, position, avg(ch) as f, max_by(allele1, sample_no) as allele1, max_by(allele2, sample_no) as allele2 from h group by all)
    select chromosome, position, sum(case when greatest(f, 1 - f) < 0.95 then 1 else 0 end) over (partition by chromosome order by position) as hap_label, allele1, allele2 from f""")
def haplotype_blocks_last_draw(t):
    return hp.haplotype_blocks_last_draw(t.phasing_samples)


@query("""with s as (select *, row_number() over (partition by chromosome, position order by sample_no desc) as k from phasing_samples) select chromosome, position, position // 4000 as hap_label, allele1 as allele, 0 as allele_id from s where k = 1
    union all select chromosome, position, position // 4000, allele2, 1 from s where k = 1""")
def haplotype_long(t):
    last = t.phasing_samples.groupBy("chromosome", "position").agg(F.max_by("allele1", "sample_no").alias("allele1"), F.max_by("allele2", "sample_no").alias("allele2"))
    return hp.haplotype_long(last.withColumn("hap_label", F.expr("position div 4000")))


HAPJ = f"{GOOD}, j as (select a.sample_id, a.chromosome, a.fragment_id, a.position, h.hap_label, h.allele_id, f.start, f.\"end\" from alleles a join haplotypes h on h.chromosome = a.chromosome and h.position = a.position and h.allele = a.is_alt join good f on f.fragment_id = a.fragment_id)"


@query(f"with {HAPJ} select sample_id, chromosome, fragment_id, position, hap_label, allele_id from j")
def haplotype_allele_join(t):
    return ct.haplotype_allele_join(t.alleles, t.haplotypes, good(t)).select("sample_id", "chromosome", "fragment_id", "position", "hap_label", "allele_id")


ALC = f"""{HAPJ}, {SEG}, one as (select *, row_number() over (partition by fragment_id order by position, hap_label, allele_id) as k from j),
    ac as (select f.sample_id, s.chromosome, s.start, s."end", f.hap_label, f.allele_id, count(*) as readcount from one f join seg s on f.k = 1 and s.chromosome = f.chromosome and f.start >= s.start and (s.next_start is null or f.start < s.next_start)
    and f."end" <= s."end" and (s.prev_end is null or f."end" > s.prev_end) group by all)"""
PHASED = f"""{ALC}, blk as (select sample_id, chromosome, start, "end", hap_label, sum(case allele_id when 0 then readcount else 0 end) as r0, sum(case allele_id when 1 then readcount else 0 end) as r1 from ac group by all),
    ratio as (select sample_id, chromosome, start, "end", sum(abs(r0 - r1)) / sum(r0 + r1) as q from blk group by all), pick as (select *, row_number() over (partition by chromosome, start, "end" order by q desc, sample_id) as k from ratio),
    ph as (select ac.*, case when allele_id = case when r0 >= r1 then 0 else 1 end then 1 else 0 end as is_allele_a from ac join pick p on p.k = 1 and p.chromosome = ac.chromosome and p.start = ac.start and p."end" = ac."end"
    join blk on blk.sample_id = p.sample_id and blk.chromosome = ac.chromosome and blk.start = ac.start and blk."end" = ac."end" and blk.hap_label = ac.hap_label)"""


def allele_counts_of(t: Tables) -> DataFrame:
    return ct.allele_read_counts(t.segments, t.alleles, t.haplotypes, good(t))


@query(f"with {ALC} select * from ac")
def allele_read_counts(t):
    return allele_counts_of(t)


@query(f"with {PHASED} select * from ph")
def phase_segments(t):
    return ct.phase_segments(allele_counts_of(t))


COUNTS = f"""{PHASED}, hits as (select f.sample_id, s.segment_idx, count(*) as n from good f join seg s on f.chromosome = s.chromosome and f.start >= s.start and f."end" <= s."end" and (s.prev_end is null or f.start > s.prev_end) group by all),
    ab as (select sample_id, chromosome, start, "end", sum(case is_allele_a when 1 then readcount else 0 end) as a, sum(case is_allele_a when 0 then readcount else 0 end) as b from ph group by all),
    ctab as (select x.sample_id, s.chromosome, s.start, s."end", coalesce(n, 0) as readcount, greatest(coalesce(a, 0), coalesce(b, 0)) as major_readcount, least(coalesce(a, 0), coalesce(b, 0)) as minor_readcount, cast(coalesce(a, 0) >= coalesce(b, 0) as int) as major_is_allele_a
    from (select distinct sample_id from good) x cross join segments s left join hits h on h.sample_id = x.sample_id and h.segment_idx = s.segment_idx left join ab on ab.sample_id = x.sample_id and ab.chromosome = s.chromosome and ab.start = s.start and ab."end" = s."end")"""


def count_table(t: Tables) -> DataFrame:
    return ct.segment_allele_counts(ct.segment_read_counts(t.segments, t.fragments), ct.phase_segments(allele_counts_of(t)))


@query(f"with {COUNTS} select * from ctab")
def segment_allele_counts(t):
    return count_table(t)


@query('select sample_id, round(avg("end" - start), 6) as fragment_mean, round(stddev_pop("end" - start), 6) as fragment_stddev from fragments where mapping_quality >= 1 group by 1')
def fragment_stats(t):
    return ct.fragment_stats(good(t)).select("sample_id", r("fragment_mean").alias("fragment_mean"), r("fragment_stddev").alias("fragment_stddev"))


@query(f"with {COUNTED} select a.chromosome, a.start, a.\"end\", a.readcount as normal_count, b.readcount as tumour_count from counted a join counted b on a.segment_idx = b.segment_idx and a.sample_id = 'normal' and b.sample_id = 'tumour_1'")
def normal_tumour_counts(t):
    of = lambda s: F.max(F.when(F.col("sample_id") == s, F.col("readcount")))
    return ct.segment_read_counts(t.segments, t.fragments).groupBy("chromosome", "start", "end").agg(of("normal").alias("normal_count"), of("tumour_1").alias("tumour_count"))


@query(f"with {GENO} select c.* from c where sample_id <> 'normal' and exists (select 1 from geno where geno.chromosome = c.chromosome and geno.position = c.position and AB = 1)")
def het_positions_filter(t):
    counts = ct.snp_counts(t.alleles, ["sample_id"])
    het = hp.snp_genotypes(counts.where("sample_id = 'normal'")).where("AB = 1").select("chromosome", "position")
    return counts.where("sample_id <> 'normal'").join(het, ["chromosome", "position"], "left_semi")
