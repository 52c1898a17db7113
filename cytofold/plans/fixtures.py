"""Domain tables derived from the star-schema tables, as text both engines run.

The text is DuckDB's; for Spark, integer division, the quoted column ``end`` and
row generators are spelled its way. Tables are CTEs in the order below.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR = "region nation customer supplier part orders lineitem events".split()

FIXTURES: dict[str, str] = {
    "chromosomes": "select cast(k + 1 as string) as chromosome, cast(k as int) as chromosome_idx, 100000 - 10000 * k as length from ROWS(5)",
    "gaps": """select chromosome, length // 2 as start, length // 2 + 1500 as "end" from chromosomes""",
    "snps": "select chromosome, 250 * k + 1 as position, 'A' as ref, 'G' as alt, cast(k % 3 as int) as gt from ROWS(400) cross join chromosomes where 250 * k + 1 < length",
    "haplotypes": "select chromosome, position, cast(a.k as int) as allele, position // 20000 as hap_label, cast(a.k as int) as allele_id from snps cross join ROWS(2) a where gt = 1",
    "fragments": """select sample_id, chromosome, fragment_id, start, start + 100 + qty * 8 as "end", mapping_quality, is_duplicate, hap, err from (
        select case l_returnflag when 'A' then 'normal' when 'N' then 'tumour_1' else 'tumour_2' end as sample_id, cast(1 + l_suppkey % 5 as string) as chromosome,
        ((((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber) * 100 + cast(l_quantity as bigint)) as fragment_id,
        (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863) % (100000 - 10000 * (l_suppkey % 5)) as start, cast(l_quantity as bigint) as qty,
        cast(round(l_discount * 100) as int) * 6 as mapping_quality, case when l_linenumber = 7 then 1 else 0 end as is_duplicate, cast(l_linenumber % 2 as int) as hap, l_orderkey % 101 as err from lineitem) q""",
    "mutations": "select chromosome, start as pos, min((fragment_id // 10000000) % 4) as v from fragments group by chromosome, start",
    "genome_bases": """select g.chromosome, g.pos, case when g.pos >= length // 2 and g.pos < length // 2 + 1500 then 'N' when v is not null then substr('ACGT', cast(1 + v as int), 1)
        when (g.pos * 7919) % 101 < 35 + ((g.pos // 5000) % 7) * 5 then case when g.pos % 2 = 0 then 'G' else 'C' end
        when g.pos % 2 = 0 then 'A' else 'T' end as base from (select chromosome, length, p.k as pos from ROWS(100000) p cross join chromosomes where p.k < length) g
        left join mutations m on m.chromosome = g.chromosome and m.pos = g.pos""",
    "mappability": """select chromosome, 1000 * k as start, least(1000 * k + 1000, length) as "end", cast((k * 37) % 61 as int) as quality from ROWS(100) cross join chromosomes where 1000 * k < length""",
    "alleles": """select sample_id, chromosome, fragment_id, position, cast(case when err = 0 then 1 - t else t end as int) as is_alt from (
        select f.sample_id, f.chromosome, f.fragment_id, p.position, f.err, case p.gt when 0 then 0 when 2 then 1 else f.hap end as t
        from (select *, start // 2000 as b from fragments union all select *, start // 2000 + 1 as b from fragments) f
        join (select *, position // 2000 as b from snps) p on f.chromosome = p.chromosome and f.b = p.b and p.position >= f.start and p.position < f."end") q""",
    "phasing_samples": """select cast(n as int) as sample_no, chromosome, position, cast(((position // 4000) % 2 + flip) % 2 as int) as allele1, cast(1 - ((position // 4000) % 2 + flip) % 2 as int) as allele2
        from (select s.k as n, chromosome, position, case when (s.k * 13 + alts * 7 + n) % 41 = 0 then 1 else 0 end as flip from (
        select a.chromosome, a.position, count(*) as n, sum(is_alt) as alts from alleles a join snps p on p.chromosome = a.chromosome and p.position = a.position where gt = 1 group by a.chromosome, a.position) c cross join ROWS(20) s) q""",
    "alignments": """select sample_id, chromosome, concat('r', fragment_id) as name, cast(1 - m.k as int) as is_first, case when m.k = 0 then start else "end" - 100 end as pos,
        case when m.k = 0 then "end" - start else start - "end" end as insert_size, mapping_quality, case when fragment_id % 13 = 0 then '20S80M' when fragment_id % 7 = 0 then '5S95M' else '100M' end as cigar,
        1 as is_primary, 1 as is_proper_pair, 1 as is_mapped, 0 as is_failed_qc, is_duplicate, fragment_id, hap, err from fragments cross join ROWS(2) m""",
    "breakpoints": """select o_orderkey as prediction_id, cast(1 + o_custkey % 5 as string) as chromosome_1, case when (o_orderkey // 50) % 2 = 0 then '+' else '-' end as strand_1, (o_orderkey * 7919 + o_custkey * 31) % 60000 as position_1,
        cast(1 + (o_custkey + case when o_orderkey % 200 = 0 then 1 else 0 end) % 5 as string) as chromosome_2, case when (o_orderkey // 100) % 2 = 0 then '-' else '+' end as strand_2, (o_orderkey * 7919 + o_custkey * 38) % 60000 as position_2
        from orders where o_orderkey % 50 = 0""",
    "breakpoints_b": """select prediction_id + 1 as prediction_id, chromosome_1, strand_1, position_1 + prediction_id % 997 - 498 as position_1, chromosome_2, strand_2, position_2 + prediction_id % 499 - 249 as position_2 from breakpoints""",
    "changes": """select chromosome, position from chromosomes cross join ROWS(10) s cross join (select 0 as x) z, lateral (select s.k * 10000 as position) where s.k * 10000 < length""",
    "segments": """select cast(row_number() over (order by chromosome_idx, start) - 1 as bigint) as segment_idx, chromosome, start, "end" from (
        select c.chromosome, c.chromosome_idx, position as start, lead(position) over (partition by c.chromosome order by position) as "end" from (
        select chromosome, s.k * 10000 as position from chromosomes cross join ROWS(10) s where s.k * 10000 < length union select chromosome, length from chromosomes union select chromosome, start from gaps union select chromosome, "end" from gaps
        union select chromosome_1, position_1 from breakpoints union select chromosome_2, position_2 from breakpoints) p join chromosomes c on p.chromosome = c.chromosome) q
        where "end" is not null and not exists (select 1 from gaps g where g.chromosome = q.chromosome and q.start >= g.start and q.start < g."end")""",
    "profiles": "select concat('c', c_custkey) as sample_id, c_custkey, chromosome, length as chromosome_length from customer cross join chromosomes",
    "cn_profiles": """select *, ("end" - start) as length, major_1 + case when (k + c_custkey) % 4 = 0 then 1 else 0 end as major_2, minor_1 as minor_2, major_1 + noise as major_raw, minor_1 + noise as minor_raw,
        major_1 + case when (k + c_custkey) % 4 = 0 then 1 else 0 end / 2e0 as major_raw_e, cast(minor_1 as double) as minor_raw_e from (
        select sample_id, c_custkey, b.k, chromosome, 7000 * b.k as start, least(7000 * (b.k + 1), chromosome_length) as "end", 1 + (b.k * 7 + c_custkey) % 3 as major_1, (b.k * 5 + c_custkey) % 2 as minor_1,
        (((b.k * 11 + c_custkey) % 9) - 4) / 20e0 as noise from profiles cross join ROWS(15) b where 7000 * b.k < chromosome_length) q""",
    "cn_profiles_pred": """select *, ("end" - start) as length, major_1 + case when (k + c_custkey) % 4 = 0 then 1 else 0 end as major_2, minor_1 as minor_2 from (
        select sample_id, c_custkey, b.k + 1 as k, chromosome, 9000 * b.k as start, least(9000 * (b.k + 1), chromosome_length) as "end", 1 + ((b.k + 1) * 7 + c_custkey) % 3 as major_1, ((b.k + 1) * 5 + c_custkey) % 2 as minor_1
        from profiles cross join ROWS(12) b where 9000 * b.k < chromosome_length) q""",
    "solutions": """select cast(s_suppkey % 3 as int) as sample_id, s_suppkey // 3 as init_id, s_acctbal as elbo, 1.5 + (s_suppkey % 50) / 10e0 as ploidy, s_nationkey / 25e0 as proportion_divergent,
        cast(0.02 as double) as h_0, cast(0.01 * (1 + s_suppkey % 4) as double) as h_1, cast(0.01 * (1 + s_suppkey % 3) as double) as h_2 from supplier""",
}
del FIXTURES["changes"]


#: The id of a fragment as the text above has it, and the same number beyond 63 bits.
LONG_ID = "((((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber) * 100 + cast(l_quantity as bigint))"
WIDE_ID = "cast(cast(l_orderkey as decimal(19, 0)) * 10000000000000 + (l_partkey * 10000000 + l_suppkey * 1000 + l_linenumber * 100 + cast(l_quantity as bigint)) as decimal(38, 0))"


def needed(text: str) -> list[str]:
    """Fixtures that a text names, with those they name themselves, in order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        now = todo.pop()
        for name, body in FIXTURES.items():
            if name not in found and re.search(rf"\b{name}\b", now):
                found.add(name)
                todo.append(body)
    return [n for n in FIXTURES if n in found]


def rows_for(text: str, column: str) -> str:
    return re.sub(r"ROWS\((\d+)\)(?: (\w)\b)?", lambda m: f"(select {column} as k from range({m[1]})) {m[2] or 'g'}", text)


def duck(text: str) -> str:
    """A DuckDB query over fixtures, with their CTEs before it."""
    text = text.strip()
    own = text[5:] if text.lower().startswith("with ") else None
    recursive = "recursive " if own and own.startswith("recursive ") else ""
    own = own and own.removeprefix(recursive)
    ctes = ",\n".join(f"{n} as ({FIXTURES[n]})" for n in needed(text))
    if not ctes:
        return rows_for(text, "range")
    return rows_for(f"with {recursive}{ctes}, {own}" if own else f"with {ctes}\n{text}", "range")


def to_spark(text: str) -> str:
    return rows_for(text, "id").replace("//", "div").replace('"end"', "`end`")


#: Customers to a partition; each has 65 segments of copy-number profiles.
CUSTOMERS = 5_000


def spread(customers: DataFrame) -> DataFrame:
    """Customers in as many partitions as their number asks for: their file is small, but what is derived from them isn't."""
    parts = math.ceil(customers.count() / CUSTOMERS)
    return customers.repartition(parts) if parts > 1 else customers


class Tables:
    """The fixtures as lazy DataFrames over one folder of tables: ``Tables(spark, sf_dir).fragments``.

    Ids of fragments are longs while the largest of them is one; on larger tables
    they are decimal(38, 0).
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def wide_ids(self) -> bool:
        """Whether an id of a fragment can be beyond 63 bits; decided by the largest keys."""
        keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        order, part, supp, line, quantity = self.lineitem.agg(*(F.max(k) for k in keys)).first()
        if order is None:
            return False
        return order * 10**13 + part * 10**7 + supp * 10**3 + line * 100 + int(quantity) >= 2**63

    def __getattr__(self, name: str) -> DataFrame:
        if name in STAR:
            rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(rows) if name == "customer" else rows
        if name not in FIXTURES:
            raise AttributeError(name)
        return self.sql(f"select * from {name}")

    def sql(self, text: str) -> DataFrame:
        names = needed(text)
        star = {t: getattr(self, t) for t in STAR if any(re.search(rf"\b{t}\b", x) for x in [text, *(FIXTURES[n] for n in names)])}
        ctes = ",\n".join(f"{n} as ({FIXTURES[n]})" for n in names)
        full = to_spark(f"with {ctes}\n{text}" if ctes else text)
        if "fragments" in names and self.wide_ids:
            full = full.replace(LONG_ID, WIDE_ID)
        for t in star:
            full = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", full)
        return self.spark.sql(full, **star)
