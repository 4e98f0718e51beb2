"""SQL for DuckDB that gives the rows of ``queries.QUERIES``, where SQL can express them over whole tables."""

from __future__ import annotations

from corpusgraph.functions.text import sql_strip as _strip

_P4 = f"""
with parts as (
    select unnest([{{'kind': 'entity_type', 'term': head_type}}, {{'kind': 'entity_type', 'term': tail_type}},
                   {{'kind': 'relation', 'term': relation}}]) as p,
           nullif({_strip("pmid")}, '') as record
    from triples
), counts as (
    select p.kind as kind, {_strip("p.term")} as term, count(*) as occurrences, count(distinct record) as records
    from parts where {_strip("p.term")} != '' group by 1, 2
), total as (select count(distinct nullif({_strip("pmid")}, '')) as total from triples),
marked as (
    select kind, term, occurrences, records,
           case when records < 3 then 'rare' when records > total * 0.4 then 'common' end as mark
    from counts, total
)"""

SQL: dict[str, str] = {
    "p4_found": f"{_P4} select kind, term, mark from marked where mark is not null",
    "p4_term_frequencies": f"{_P4} select kind, term, occurrences, records, mark from marked",
}

_PMID = f"try_cast(nullif(regexp_extract(lower({_strip('pmid')}), '^(?:pmid)?[\\s:#=]*0*([0-9]{{1,18}})$', 1), '') as bigint)"

SQL["p5_sample"] = f"""
with keys as (select distinct {_PMID} as pmid from articles),
placed as (select pmid, ('0x' || md5(pmid::varchar)[1:4])::int as bucket from keys where pmid is not null),
ranked as (select range as bucket, row_number() over (order by md5('0:' || range), range) as place from range(65536))
select pmid, bucket from placed join ranked using (bucket) where place <= ceil(65536 * 0.05)"""


_SPIKES = """
sizes as (select distinct source, text, length(text) as chars, strlen(text) as bytes from documents where source is not null and length(text) > 0),
counts as (select source, measure, size, count(*) as texts
           from (select source, 'chars' as measure, chars as size from sizes union all select source, 'bytes', bytes from sizes) group by all),
windows as (select *, floor(ln(size::double) * 1000) as scale, sum(texts) over (partition by source, measure) as every from counts),
near as (select *, (sum(texts) over (partition by source, measure order by scale range between 50 preceding and 50 following) - texts)
                   / greatest(1.0, size * 0.1) as around from windows),
spikes as (select source, measure, size, texts, around from near where texts >= 5 and texts >= every * 0.01 and texts >= around * 8)"""

SQL["p9_length_spikes"] = f"with {_SPIKES} select source, measure, size, texts, around::double as around from spikes"

# Likeness by brute force: every pair of records that share a sequence of words, with what they share counted.
_PAIRS = """
texts as (select rec_id, batch, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{L}\\p{N}]+') as w from articles),
sets as (select rec_id, batch, list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')]
                                             else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s from texts),
tokens as (select rec_id, batch, len(s) as n, unnest(s) as t from sets),
shared as (select a.rec_id as x, b.rec_id as y, any_value(a.batch) as bx, any_value(b.batch) as by_, count(*) as c, any_value(a.n) + any_value(b.n) as n
           from tokens a join tokens b on a.t = b.t and a.rec_id < b.rec_id group by 1, 2),
alike as (select * from shared where c >= 0.5 * (n - c))"""

SQL["p2_found"] = f"with {_PAIRS} select x as rec_id_a, y as rec_id_b from alike"
SQL["p6_found"] = f"""
with {_PAIRS}, numbers as (select rec_id, batch, {_PMID} as number from articles)
select a.batch, a.rec_id from numbers a where exists (select 1 from numbers b where b.number = a.number and b.batch < a.batch)
union select bx, x from alike where by_ < bx union select by_, y from alike where bx < by_"""
