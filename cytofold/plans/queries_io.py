"""Registered queries on sources, sinks, streams, views and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.operators import breakpoints as bp
from cytofold.operators import counts as ct
from cytofold.operators import depth as dp
from cytofold.operators import haplotypes as hp
from cytofold.operators import intervals as iv
from cytofold.operators import model as md
from cytofold.operators import resampling as rs
from cytofold.operators import segments as sg
from cytofold.plans.fixtures import Tables
from cytofold.plans.queries import ADJ, GENO, NODES, SNPC, query, r
from cytofold.sources import seqio
from cytofold.sources.storage import new_path
from cytofold.streaming import incremental


def normal_counts(t: Tables) -> DataFrame:
    return ct.snp_counts(t.alleles.where("sample_id = 'normal'"), [])


@query("select * from breakpoints")
def read_breakpoints(t):
    path = new_path(t.spark, "breakpoints")
    seqio.write_tsv(t.breakpoints, path)
    return seqio.read_breakpoints(t.spark, path)


@query('select cast(s.segment_idx % 500 as int) as bin, s.chromosome, s.start, s."end", s."end" - s.start as size from segments s')
def read_gap_table(t):
    path = new_path(t.spark, "gaps")
    rows = t.segments.select((F.col("segment_idx") % 500).cast("int").alias("bin"), "chromosome", "start", "end", F.lit(1).alias("ix"), F.lit("N").alias("n"), (F.col("end") - F.col("start")).alias("size"), F.lit("x").alias("type"), F.lit("no").alias("bridge"))
    seqio.write_tsv(rows, path, header=False, compression="gzip")
    return seqio.read_gap_table(t.spark, path).select("bin", "chromosome", "start", "end", "size")


@query('select chromosome, chromosome_idx, max(f."end") as length from fragments f join chromosomes using (chromosome) where chromosome_idx < 4 group by all')
def read_chromosome_lengths(t):
    path = new_path(t.spark, "index")
    seqio.write_tsv(t.fragments.groupBy("chromosome").agg(F.max("end").alias("length")).withColumn("offset", F.lit(0)), path, header=False)
    return seqio.read_chromosome_lengths(t.spark, path, t.chromosomes.where("chromosome_idx < 4"))


@query("select cast(prediction_id as string) as prediction_id, chromosome_1, cast(position_1 as string) as position_1 from breakpoints")
def read_table_raw(t):
    path = new_path(t.spark, "raw")
    seqio.write_tsv(t.breakpoints, path)
    return seqio.read_tsv(t.spark, path).select("prediction_id", "chromosome_1", "position_1")


@query("select fragment_id, concat('chr', chromosome) as with_prefix, chromosome from fragments")
def normalise_gap_names(t):
    named = seqio.normalise_names(t.fragments.select("fragment_id", "chromosome"), prefix=True).withColumn("with_prefix", F.col("chromosome"))
    return seqio.normalise_names(named)


@query("select chromosome, position, 'A' as ref, a as alt from (select distinct chromosome, position, unnest(['C', case when position % 3 = 0 then 'GG' else 'T' end]) as a from alleles where position % 5 <> 0) x where a <> 'GG'")
def snp_panel(t):
    sites = t.alleles.select("chromosome", "position").distinct()
    rows = sites.select("chromosome", "position", F.when(F.col("position") % 5 == 0, "AT").otherwise("A").alias("ref"), F.array(F.lit("C"), F.when(F.col("position") % 3 == 0, "GG").otherwise("T")).alias("alts"))
    return seqio.snp_panel(rows)


@query("select count(*) filter (where l_suppkey % 7 = 0) as bad_prefix, count(*) filter (where l_suppkey % 7 = 0 or l_suppkey % 9 = 0) as unknown from lineitem")
def check_chromosome_names(t):
    name = F.when(F.col("l_suppkey") % 7 == 0, "chr1").when(F.col("l_suppkey") % 9 == 0, "GL1").otherwise("1")
    return seqio.check_chromosome_names(t.lineitem.select(name.alias("chromosome")), t.chromosomes)


@query('select sample_id, chromosome, fragment_id, start, "end", case when fragment_id % 3 = 0 then 60 else mapping_quality end as mapping_quality, 0 as is_duplicate from fragments')
def write_seqdata(t):
    path = new_path(t.spark, "seqdata")
    quality = F.when(F.col("fragment_id") % 3 != 0, F.col("mapping_quality"))
    seqio.write_seqdata(t.fragments.select("sample_id", "chromosome", "fragment_id", "start", "end", quality.alias("mapping_quality")), path)
    return seqio.read_seqdata(t.spark, path)


@query("select chromosome, fragment_id from fragments where chromosome in ('1', '3')")
def merge_seqdata(t):
    return md.union_all([t.fragments.where(F.col("chromosome") == c).select("chromosome", "fragment_id") for c in ("1", "3")])


@query("""with p as (select cast(hap as int) as file_no, chromosome, fragment_id % 1000003 as fragment_id, start from fragments), m as (select file_no, chromosome, max(fragment_id) + 1 as top from p group by all)
    select p.file_no, p.chromosome, p.fragment_id + coalesce((select sum(top) from m where m.chromosome = p.chromosome and m.file_no < p.file_no), 0) as fragment_id, p.start from p""")
def merge_overlapping_seqdata(t):
    parts = t.fragments.select(F.col("hap").alias("file_no"), "chromosome", (F.col("fragment_id") % 1_000_003).cast("long").alias("fragment_id"), "start")
    return seqio.merge_overlapping(parts).select("file_no", "chromosome", "fragment_id", "start")


@query("select segment_idx, chromosome, (row_number() over (partition by chromosome order by start) - 1) // 20 as part from segments")
def split_table(t):
    return seqio.split_table(t.segments, "chromosome", ["start"], 20).select("segment_idx", "chromosome", "part")


@query("select prediction_id, position_1, null as extra from breakpoints union all select prediction_id, position_1, 1 from breakpoints_b")
def merge_tables(t):
    return md.union_all([t.breakpoints.select("prediction_id", "position_1"), t.breakpoints_b.select("prediction_id", "position_1", F.lit(1).alias("extra"))])


@query("""with b as (select *, row_number() over (partition by sample_id order by elbo desc, init_id) as k from solutions), c as (select sample_id, count(*) as n_cn, sum((major_1 + minor_1) * length) as copies from (select cast(c_custkey % 3 as int) as sample_id, major_1, minor_1, length from cn_profiles) group by 1),
    q as (select cast((prediction_id // 50) % 3 as int) as sample_id, count(*) as n_brk, sum((prediction_id // 100) % 2) as brk_copies from breakpoints group by 1)
    select b.sample_id, init_id, elbo, ploidy, round(h_0 + h_1 + h_2, 6) as total, round(h_1 / (h_0 + h_1 + h_2), 6) as mix_1, n_cn, copies, n_brk, brk_copies from b join c using (sample_id) join q using (sample_id) where k = 1""")
def write_results(t):
    from cytofold.operators.solutions import export_best_solution

    best = export_best_solution(t.solutions, max_divergent=2.0)
    cn = t.cn_profiles.select((F.col("c_custkey") % 3).cast("int").alias("sample_id"), "chromosome", "start", "end", "length", "major_1", "minor_1")
    brk = t.breakpoints.select(F.expr("cast((prediction_id div 50) % 3 as int)").alias("sample_id"), "prediction_id", F.expr("(prediction_id div 100) % 2").alias("cn_1"))
    path = new_path(t.spark, "results")
    seqio.write_results(best, cn, brk, path)
    meta = t.spark.read.schema("sample_id int, init_id long, elbo double, ploidy double, h array<double>, mix array<double>").json(f"{path}/meta")
    sums = seqio.read_tsv(t.spark, f"{path}/cn", "sample_id int, init_id long, chromosome string, start long, `end` long, length long, major_1 long, minor_1 long").groupBy("sample_id", "init_id")
    sums = sums.agg(F.count("*").alias("n_cn"), F.sum((F.col("major_1") + F.col("minor_1")) * F.col("length")).alias("copies"))
    ends = seqio.read_tsv(t.spark, f"{path}/brk_cn", "sample_id int, init_id long, prediction_id long, cn_1 long").groupBy("sample_id", "init_id").agg(F.count("*").alias("n_brk"), F.sum("cn_1").alias("brk_copies"))
    total, mix = r(F.aggregate("h", F.lit(0.0), lambda a, b: a + b)).alias("total"), r(F.get("mix", F.lit(1))).alias("mix_1")
    return meta.join(sums, ["sample_id", "init_id"]).join(ends, ["sample_id", "init_id"]).select("sample_id", "init_id", "elbo", "ploidy", total, mix, "n_cn", "copies", "n_brk", "brk_copies")


@query("select distinct h.chromosome, h.position, concat_ws('_', h.chromosome, h.position, 'A', 'G') as id, '0/1' as gt from haplotypes h join alleles a on a.chromosome = h.chromosome and a.position = h.position")
def het_snp_vcf_rows(t):
    seen = t.haplotypes.join(t.alleles.select("chromosome", "position").distinct(), ["chromosome", "position"], "left_semi")
    return seqio.het_snp_vcf_rows(seen, t.snps).select("chromosome", "position", "id", "gt")


@query(f"with {GENO} select chromosome, concat(chromosome, ':', position) as id, AA, AB, BB from geno where AA + AB + BB = 1")
def genotype_gen_rows(t):
    return seqio.genotype_gen_rows(hp.snp_genotypes(normal_counts(t)), t.snps).select("chromosome", "id", "AA", "AB", "BB")


@query(f"with {SNPC} select chromosome as chr, position as pos, 'A' as ref, ref_count as refCount, 'T' as nonref, alt_count as nonrefCount from c where sample_id = 'normal'")
def titan_allele_rows(t):
    return seqio.caller_allele_rows(normal_counts(t), "titan")


@query(f"with {SNPC} select chromosome as chrom, position, ref_count, alt_count, ref_count + alt_count as total, 'AB' as genotype from c where sample_id = 'normal'")
def theta_allele_rows(t):
    return seqio.caller_allele_rows(normal_counts(t), "theta")


@query(f"with {SNPC} select chromosome, position, least(ref_count, alt_count) as minor_count, ref_count + alt_count as total_count from c where sample_id = 'normal'")
def baf_rows(t):
    return seqio.caller_allele_rows(normal_counts(t), "baf")


@query("""with b as (select chromosome, 5000 * k as start, 5000 * k + 5000 as "end", lag(5000 * k + 5000) over (partition by chromosome order by k) as pe from chromosomes cross join (select range as k from range(20)) where 5000 * k < length)
    select b.chromosome, b."end" as position, count(f.fragment_id) as readcount from b left join fragments f on f.chromosome = b.chromosome and f.start >= b.start and f."end" <= b."end" and (pe is null or f.start > pe) group by all""")
def cna_rows(t):
    return iv.contained_counts(sg.fixed_bins(t.chromosomes, 5000), t.fragments, []).select("chromosome", F.col("end").alias("position"), "readcount")


@query(f"with {SNPC} select * from c")
def stream_snp_counts(t):
    source, out = new_path(t.spark, "stream-in"), new_path(t.spark, "stream-out")
    t.alleles.repartition(3, "fragment_id").write.parquet(source)
    stream = t.spark.readStream.schema(t.alleles.schema).option("maxFilesPerTrigger", 2).parquet(source)
    incremental.stream_snp_counts(stream, out, new_path(t.spark, "stream-state")).awaitTermination()
    return incremental.total_counts(t.spark.read.parquet(out))


@query("select sample_id, chromosome, fragment_id, mapping_quality from fragments")
def stream_write_seqdata(t):
    source, out = new_path(t.spark, "stream-in"), new_path(t.spark, "stream-out")
    t.fragments.repartition(3, "fragment_id").write.parquet(source)
    stream = t.spark.readStream.schema(t.fragments.schema).option("maxFilesPerTrigger", 2).parquet(source)
    incremental.stream_write_seqdata(stream, out, new_path(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).select("sample_id", F.col("chromosome").cast("string").alias("chromosome"), "fragment_id", "mapping_quality")


# Views


@query("with o as (select chromosome, sum(length) over (order by chromosome_idx) - length as s from chromosomes) select p.sample_id, p.chromosome, p.start + s as plot_start, p.\"end\" + s as plot_end, round(2 * sqrt(p.length / 1e6), 6) as size from cn_profiles p join o using (chromosome)")
def cn_view(t):
    placed = dp.concat_position(t.cn_profiles, sg.concat_coordinates(t.chromosomes), ["start", "end"])
    return placed.select("sample_id", "chromosome", "plot_start", "plot_end", r(2 * F.sqrt(F.col("length") / 1e6)).alias("size"))


@query("select f.chromosome, round(sum(length) over (order by f.chromosome), 1) as \"end\", n from (select chromosome, count(*) as n from fragments group by 1) f join chromosomes using (chromosome)")
def concat_coordinates(t):
    n = t.fragments.groupBy("chromosome").agg(F.count("*").alias("n"))
    return sg.concat_coordinates(t.chromosomes).join(n, "chromosome").select("chromosome", F.col("end").cast("double").alias("end"), "n")


@query('select sample_id, chromosome, "end" as x0, nx as x1, round((major_raw + nv) / 2, 6) as value from (select *, lead(start) over w as nx, lead(major_raw) over w as nv from cn_profiles window w as (partition by sample_id, chromosome order by start)) where nx is not null')
def segment_connectors(t):
    return sg.segment_connectors(t.cn_profiles, ["sample_id"], "major_raw").withColumn("value", r("value"))


@query("""with b as (select prediction_id, 0 as prediction_side, chromosome_1 as chromosome, strand_1 as strand, position_1 as position, chromosome_2 as other_chromosome, position_2 as other_position from breakpoints union all select prediction_id, 1, chromosome_2, strand_2, position_2, chromosome_1, position_1 from breakpoints),
    o as (select chromosome, sum(length) over (order by chromosome_idx) - length as s from chromosomes) select b.*, position + s as plot_position from b join o using (chromosome)""")
def breakend_view(t):
    ends = bp.breakends(t.breakpoints)
    other = ends.select("prediction_id", (1 - F.col("prediction_side")).alias("prediction_side"), F.col("chromosome").alias("other_chromosome"), F.col("position").alias("other_position"))
    return dp.concat_position(ends.join(other, ["prediction_id", "prediction_side"]), sg.concat_coordinates(t.chromosomes), ["position"])


@query("select chromosome, row_number() over (order by try_cast(chromosome as int) is null, try_cast(chromosome as int), chromosome) as rank from (select distinct case when l_suppkey % 13 = 0 then 'X' when l_suppkey % 17 = 0 then 'MT' else cast(l_suppkey % 12 + 1 as string) end as chromosome from lineitem) x")
def sort_chromosome_names(t):
    from pyspark.sql import Window

    name = F.when(F.col("l_suppkey") % 13 == 0, "X").when(F.col("l_suppkey") % 17 == 0, "MT").otherwise((F.col("l_suppkey") % 12 + 1).cast("string"))
    number = F.col("chromosome").try_cast("int")
    return t.lineitem.select(name.alias("chromosome")).distinct().withColumn("rank", F.row_number().over(Window.orderBy(number.isNull(), number, "chromosome")).cast("long"))


@query(f"""with {NODES}, cn as (select segment_idx, segment_idx % 4 as total_1, segment_idx * 3 % 5 as total_2 from segments), en as (select prediction_id, n_1 as n, side_1 as side from nodes union all select prediction_id, n_2, side_2 from nodes),
    w as (select l as n, 1 as side, rr as o from adj union all select rr, 0, l from adj) select prediction_id, min(greatest(c.total_1 - coalesce(d.total_1, 0), 0)) as cn_1, min(greatest(c.total_2 - coalesce(d.total_2, 0), 0)) as cn_2
    from en left join w using (n, side) join cn c on c.segment_idx = en.n left join cn d on d.segment_idx = w.o group by 1""")
def decode_breakpoints_naive(t):
    adjacent = sg.wild_type_adjacencies(t.segments, 1000)
    cn = t.segments.select("segment_idx", (F.col("segment_idx") % 4).alias("total_1"), (F.col("segment_idx") * 3 % 5).alias("total_2"))
    return md.decode_breakpoints_naive(cn, adjacent, bp.breakpoint_segments(t.segments, t.breakpoints, adjacent))


@query("""with ch as (select prediction_id, b.range * 2 - 1 as orient, (prediction_id // 50 + b.range) % 5 - 2 as d_1, (prediction_id // 100 + b.range * 2) % 5 - 2 as d_2 from breakpoints, range(2) b), st as (select row_number() over (order by a.range, b.range) - 1 as s, a.range as cn_1, b.range as cn_2 from range(4) a, range(4) b where abs(a.range - b.range) <= 1),
    x as (select prediction_id, s, cn_1, cn_2, sum(10 * (abs(d_1 - orient * cn_1) + abs(d_2 - orient * cn_2))) as c from ch, st group by all) select prediction_id, cn_1, cn_2 from x qualify row_number() over (partition by prediction_id order by c, s) = 1""")
def decode_breakpoints_by_transition(t):
    rows = t.breakpoints.select("prediction_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("b"))
    changes = rows.selectExpr("prediction_id", "b * 2 - 1 as orient", "(prediction_id div 50 + b) % 5 - 2 as d_1", "(prediction_id div 100 + b * 2) % 5 - 2 as d_2")
    found = md.decode_breakpoints_by_transition(changes, md.breakpoint_states(t.spark, 3, 1))
    return found.select("prediction_id", F.col("cn_1").cast("long").alias("cn_1"), F.col("cn_2").cast("long").alias("cn_2"))


@query(f"with {NODES} select prediction_id, n_1, n_2, coalesce(case when prediction_id % 100 = 0 then 2 end, 0) as cn_1 from nodes")
def annotate_solution_brk(t):
    nodes = bp.breakpoint_segments(t.segments, t.breakpoints, sg.wild_type_adjacencies(t.segments, 1000))
    cn = t.breakpoints.where("prediction_id % 100 = 0").select("prediction_id", F.lit(2).alias("cn_1"))
    return nodes.join(cn, "prediction_id", "left").fillna(0, ["cn_1"]).select("prediction_id", "n_1", "n_2", "cn_1")


@query("""select f.fragment_id, p.position, case when p.gt = 2 or (p.gt = 1 and f.hap = 1) then 1 else 0 end as is_alt from fragments f join snps p on p.chromosome = f.chromosome and p.position >= f.start and p.position < f."end" and (p.position < f.start + 75 or p.position >= f."end" - 75)""")
def fragment_snp_calls(t):
    pairs = iv.interval_position_overlap(t.fragments, t.snps, width=500).where("position < start + 75 or position >= `end` - 75")
    return pairs.select("fragment_id", "position", F.when((F.col("gt") == 2) | ((F.col("gt") == 1) & (F.col("hap") == 1)), 1).otherwise(0).alias("is_alt"))


@query("""with a as (select *, case when cigar = '5S95M' then pos + 5 when cigar = '20S80M' then pos + 20 else pos end as s, pos + 100 as e from alignments where cigar <> '20S80M')
    select distinct a.sample_id, a.fragment_id, p.position, case when err = 0 then 1 - (case p.gt when 0 then 0 when 2 then 1 else hap end) else (case p.gt when 0 then 0 when 2 then 1 else hap end) end as is_alt from a join snps p on p.chromosome = a.chromosome and p.position > a.s and p.position <= a.e""")
def allele_calls(t):
    clip = ct.leading_clip("cigar")
    reads = ct.concordant_alignments(t.alignments).select("sample_id", "chromosome", "fragment_id", "hap", "err", (F.col("pos") + clip + 1).alias("start"), (F.col("pos") + 101).alias("end"))
    true = F.when(F.col("gt") == 0, 0).when(F.col("gt") == 2, 1).otherwise(F.col("hap"))
    calls = iv.interval_position_overlap(reads, t.snps, width=500, longest=101)
    return calls.select("sample_id", "fragment_id", "position", F.when(F.col("err") == 0, 1 - true).otherwise(true).alias("is_alt")).distinct()


TARGETS = """cps as (select chromosome, start, "end", c_custkey % 3 as genome, major_1 as a, minor_1 as b from cn_profiles), cpa as (select chromosome, start, "end", 0 as allele, genome, sum(a) as n from cps group by all union all select chromosome, start, "end", 1, genome, sum(b) from cps group by all),
    tgt as (select chromosome, start, "end", cast(allele as int) as allele, sum(n * (0.0001e0 * (1 + genome))) as read_depth from cpa where n > 0 group by all)"""


def depth_targets(t: Tables) -> DataFrame:
    """Depths of the segments of the copy-number profiles, each customer's being a genome of one of three kinds."""
    rows = t.cn_profiles.select("chromosome", "start", "end", (F.col("c_custkey") % 3).alias("genome"), F.explode(F.array(F.struct(F.lit(0).alias("allele"), F.col("major_1").alias("n")), F.struct(F.lit(1).alias("allele"), F.col("minor_1").alias("n")))).alias("a"))
    copies = rows.where("a.n > 0").select("chromosome", "start", "end", "a.allele", "genome", F.explode(F.sequence(F.lit(1).cast("long"), "a.n")))
    return rs.resample_depth_targets(copies, copies.select("genome").distinct().withColumn("haploid_depth", 0.0001 * (1 + F.col("genome"))))


@query(f'with {TARGETS} select chromosome, start, "end", allele, round(read_depth, 6) as read_depth from tgt')
def resample_depth_targets(t):
    return depth_targets(t).withColumn("read_depth", r("read_depth"))


@query("""with sg as (select segment_idx, chromosome, start, "end", allele, case allele when 0 then 0.75e0 * (segment_idx % 5) else 0.5e0 * (segment_idx % 3) end as rate, lag("end") over (partition by chromosome, allele order by start) as prev_end, lead(start) over (partition by chromosome, allele order by start) as next_start from segments cross join (select 0 as allele union all select 1) a),
    rt as (select rate, k, case when rate > 0 then exp(k * ln(rate) - rate - lgamma(k + 1)) else cast(k = 0 as int) end as p from (select distinct rate from sg), (select range as k from range(70)) g), lv as (select rate, k, sum(p) over (partition by rate order by k) as upto from rt),
    f as (select f.chromosome, f.start, f."end", f.fragment_id, sg.allele, sg.rate, (cast(concat('0x', substr(md5(concat_ws('|', '17', f.fragment_id, sg.allele)), 1, 14)) as bigint) >> 3) / 9007199254740992e0 as u from fragments f join sg on sg.chromosome = f.chromosome and f.start >= sg.start and (sg.next_start is null or f.start < sg.next_start) and f."end" <= sg."end" and (sg.prev_end is null or f."end" > sg.prev_end)),
    dr as (select f.*, k as copy from f join lv on lv.rate = f.rate and f.u > lv.upto)
    select chromosome, start, "end", cast(allele as int) as allele, row_number() over (partition by chromosome order by start, fragment_id, allele, copy) - 1 as fragment_id from dr""")
def poisson_resample(t):
    targets = t.segments.withColumn("allele", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rate", F.when(F.col("allele") == 0, 0.75 * (F.col("segment_idx") % 5)).otherwise(0.5 * (F.col("segment_idx") % 3)))
    return rs.poisson_resample(t.fragments, targets.drop("segment_idx"))


CURVES = {c: f"case when i in (0, 2001) then 0 else sum(w * exp(-0.5 * pow((x - {c}) / bw_{c}, 2)) / (bw_{c} * sqrt(2 * pi()))) / any_value(tw) end" for c in ("minor", "major", "total")}
WIDTHS = ", ".join(f"0.01e0 * sqrt((s2_{c} / tw - m_{c} * m_{c}) / (1 - w2 / (cast(tw as double) * tw))) as bw_{c}" for c in CURVES)


@query(f"""with ab as (select sample_id, minor_raw * 0.03e0 + 0.02e0 as minor, major_raw * 0.03e0 + 0.02e0 as major, cast(length as bigint) as w from cn_profiles where length > 0), rw as (select *, minor + major as total from ab),
    st as (select sample_id, sum(w) as tw, sum(w * w) as w2, {", ".join(f"sum(w * {c}) / sum(w) as m_{c}, sum(w * {c} * {c}) as s2_{c}" for c in CURVES)} from rw group by 1),
    cu as (select sample_id, total, sum(w) over (partition by sample_id order by total) as c from rw), tp as (select cu.sample_id, min(total) as top from cu join st using (sample_id) where c >= 0.95 * tw group by 1),
    gd as (select sample_id, cast(g.range as int) as i, top * least(greatest(g.range - 1, 0), 1999) / 1999 as x, tw, {WIDTHS} from tp join st using (sample_id) cross join range(2002) g)
    select sample_id, i, round(x, 6) as x, {", ".join(f"round({text}, 3) as {c}" for c, text in CURVES.items())} from gd join rw using (sample_id) group by sample_id, i, x, {", ".join(f"bw_{c}" for c in CURVES)}""")
def density_curves(t):
    depth = lambda c: F.col(f"{c}_raw") * 0.03 + 0.02
    rows = t.cn_profiles.where("length > 0").select("sample_id", "length", depth("minor").alias("minor"), depth("major").alias("major"))
    found = dp.density(rows.withColumn("total", F.col("minor") + F.col("major")), ["sample_id"], ["minor", "major", "total"], "length", "total")
    cut = lambda c, digits: (F.rint(F.col(c) * 10.0**digits) / 10.0**digits).alias(c)  # noqa: E731  (as the SQL rounds; faster than by decimals)
    return found.select("sample_id", "i", cut("x", 6), *(cut(c, 3) for c in ("minor", "major", "total")))
