"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytofold.llm.common import documents
from cytofold.llm.exact_dedup import exact_dedup
from cytofold.llm.fingerprints import document_fingerprints
from cytofold.llm.language_id import identify
from cytofold.llm.language_model import lm_scores
from cytofold.llm.line_dedup import line_dedup
from cytofold.llm.mixing import mix_sources
from cytofold.llm.near_dedup import near_dedup
from cytofold.llm.packing import pack
from cytofold.llm.quality_classifier import quality_scores
from cytofold.llm.quality_rules import STOP_WORDS, THRESHOLDS, quality_rules
from cytofold.llm.token_files import round_trip
from cytofold.llm.vector_codes import vector_codes
from cytofold.llm.whitening import whitened_components


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("broken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).drop("spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).withColumn("dropped", F.array_join("dropped", ","))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(embeddings(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fingerprints": op11_fingerprints,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}

STOPS = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))
BROKEN = " or ".join(
    f"(n_words >= {least} and ({' or '.join([f'{metric} < {low}'] * (low is not None) + [f'{metric} > {high}'] * (high is not None))}))" for _, metric, low, high, least in THRESHOLDS
)

#: Nearest entries of the parts ``p`` in the codebooks ``b{k}``, and the codebooks of the next round.
APART = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
ASSIGN = f"a{{k}} as materialized (select rid, part, any_value(v) as v, min({{{{'d': {APART}, 'e': entry}}}}) as best from p join b{{k}} using (part) group by rid, part)"
REFINE = """m{k} as (select part, entry, i, cast(floor(sum(x) / count(*)) as bigint) as x from (select part, best.e as entry, unnest(v) as x, unnest(range(len(v))) as i from a{k}) group by all),
    b{n} as materialized (select b{k}.part, b{k}.entry, coalesce(m.c, b{k}.c) as c from b{k} left join (select part, entry, list(x order by i) as c from m{k} group by all) m using (part, entry))"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
        with w as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
        win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from w, unnest(range(1, len(ws) - 3)) u(i)),
        rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1),
        cov as (select doc_id, sum(least(5, nxt - i)) as n from (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + 5) as nxt from rep) group by 1),
        m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations,
            len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, len(list_filter(ws, lambda x: x in ({STOPS}))) as n_stop_words from w left join cov on cov.doc_id = w.doc_id),
        r as (select *, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word_length, coalesce(n_symbols / nullif(n_words, 0), 0) as symbol_ratio, coalesce(n_exclamations / nullif(n_words, 0), 0) as exclamation_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_ratio,
            coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) as stop_word_ratio, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
        select *, not base_failed and not ({BROKEN}) as kept from r
    """,
    "op3_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)
    """,
    "op4_mixing": r"""
        with d as (select doc_id, source, coalesce(concat('0', source), '1') as skey, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size,
            cast(concat('0x', substr(md5(concat_ws('|', '17', cast(doc_id as varchar), text)), 1, 15)) as bigint) as shuffled from documents),
        s as (select skey, cast(sum(size) as bigint) as source_size, cast([3, 1, 2][(row_number() over (order by skey) - 1) % 3 + 1] as double) as weight from d group by 1),
        filled as (select *, 2 * source_size as cap, sum(2 * source_size) over below as capped, sum(weight) over () - coalesce(sum(weight) over below, 0) as open, 1.5e0 * sum(source_size) over () as budget
            from s window below as (order by 2 * source_size / weight, skey rows between unbounded preceding and 1 preceding)),
        levels as (select (budget - coalesce(capped, 0)) / open as level, cap / weight as reached from filled),
        level as (select arg_min(level, reached) as level from levels where level <= reached),
        t as (select skey, source_size, case when level is null or cap <= weight * level then cast(cap as double) else weight * level end as target from filled, level),
        q as (select d.*, t.source_size, t.target, (e.range * t.source_size + sum(size) over (partition by d.skey, e.range order by shuffled, doc_id rows unbounded preceding)) / target as finish from d join t using (skey), range(2) e),
        r as (select doc_id, size, sum(size) over (order by finish, shuffled, doc_id rows unbounded preceding) as run from q where size > 0 and target > 0),
        n as (select doc_id, count(*) as copies from r where run <= (select sum(target) from t) + 1e-6 group by 1)
        select d.doc_id, size, source_size, target, coalesce(copies, 0) * size as taken, source, cast(coalesce(copies, 0) as int) as copies from d join t using (skey) left join n on n.doc_id = d.doc_id
    """,
    "op5_near_dedup": r"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(ws) - 3, 2))) u(i) where len(ws) > 0),
        n as (select doc_id, count(*) as n from s group by 1),
        m as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select a, b from m join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
        e as (select a, b from l union all select b, a from l),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on e.a = r.b)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d join (select a, min(b) as component_id from r group by 1) c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
    """,
    "op8_line_dedup": r"""
        with x as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
        l as (select doc_id, i, trim(line, concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ')) as line from x where regexp_matches(line, '[^\x20\x09-\x0D]')),
        u as (select line, length(line) as n, min({'d': doc_id, 'i': i}) as first from l group by all),
        k as (select distinct line, n, first, h, side, case side when 0 then left(line, h) else substr(line, n - h + 1, h) end as half from u, unnest([n // 2, (n - 1) // 2]) a(h), range(2) b(side)),
        p as (select distinct a.line, a.first as a_first, b.line as other, b.first as b_first from k a join k b on a.h = b.h and a.side = b.side and a.half = b.half and abs(a.n - b.n) <= 1 and a.line <> b.line),
        e as (select *, greatest(length(line), length(other)) as m, length(line) as x, length(other) as y from p),
        near as (select line, min(b_first) as near from e where len(list_filter(range(m), lambda i: left(line, i) = left(other, i) and right(line, x - i - cast(x = m as int)) = right(other, y - i - cast(y = m as int)))) > 0 group by 1),
        v as (select u.line, least(u.first, coalesce(near.near, u.first)) as first from u left join near using (line)),
        g as (select l.doc_id, l.i from l join v using (line) where v.first < {'d': l.doc_id, 'i': l.i})
        select d.doc_id, coalesce(a.n, 0) as n_lines, coalesce(b.n, 0) as n_dropped, coalesce(b.dropped, '') as dropped from documents d left join (select doc_id, count(*) as n from l group by 1) a using (doc_id)
        left join (select doc_id, count(*) as n, string_agg(i, ',' order by i) as dropped from g group by 1) b using (doc_id)
    """,
    "op12_vector_codes": f"""
        with k as materialized (select row_number() over (order by vec_id, embedding) as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as materialized (select rid, t.range as part, x[t.range * (len(x) // 16) + 1 : (t.range + 1) * (len(x) // 16)] as v from k, range(16) t),
        b0 as (select part, rid - 1 as entry, v as c from p where rid <= 64),
        {ASSIGN.format(k=0)}, {REFINE.format(k=0, n=1)}, {ASSIGN.format(k=1)}, {REFINE.format(k=1, n=2)}, {ASSIGN.format(k=2)},
        books as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b2),
        coded as (select rid, string_agg(printf('%02x', best.e), '' order by part) as code, cast(sum(best.d) as bigint) as error from a2 group by 1)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join k using (rid), books
    """,
}
