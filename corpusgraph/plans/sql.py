"""SQL for DuckDB that gives the rows of ``queries.QUERIES``."""

from __future__ import annotations

from corpusgraph.functions.text import WHITE_CLASS, sql_strip as strip
from corpusgraph.operators.merging import FOREIGN_MARK, PREPRINTS
from corpusgraph.operators.routing import TYPE_NAMES
from corpusgraph.operators.validation import REQUIRED
from corpusgraph.plans.queries import CHART, KEYS, RARE, SAMPLE

_T = "t as (select *, id1::bigint as line from triples)"


def _places(columns: list[str]) -> str:
    n = len(columns)
    return "places as (" + " union all ".join(f"select {c} as v, line * {n} + {i} as place from t" for i, c in enumerate(columns)) + ")"


def _counts(columns: list[str], stripped: bool = True) -> str:
    """Values with their count and first place, as ``counts``."""
    value = strip("v") if stripped else "v"
    test = f"{value} != ''" if stripped else "v is not null"
    return f"{_T}, {_places(columns)}, counts as (select {value} as value, count(*) as count, min(place) as first from places where {test} group by 1)"


def _ranked(source: str, order: str) -> str:
    return f"select value, count, row_number() over (order by {order}) as rank from {source}"


_TYPES = ["head_type", "tail_type"]
_SEEN = "count desc, first"

SQL: dict[str, str] = {
    "entity_type_counts": f"with {_counts(_TYPES)} {_ranked('counts', _SEEN)}",
    "raw_entity_type_counts": f"with {_counts(_TYPES, False)} {_ranked('counts', _SEEN)}",
    "relation_counts": f"with {_counts(['relation'])} {_ranked('counts', _SEEN)}",
    "raw_relation_counts": f"with {_counts(['relation'], False)} {_ranked('counts', _SEEN)}",
    "rare_entity_types": f"with {_counts(_TYPES)} {_ranked(f'counts where count < {RARE}', 'count, value')}",
    "chart_data": f"with {_counts(_TYPES, False)} {_ranked(f'counts where count >= {CHART}', 'count, first')}",
    "journal_counts": f"""with counts as (select {strip("coalesce(journal, 'None')")} as value, count(*) as count from articles group by 1)
        {_ranked("counts where value != ''", 'count desc, value')}""",
    "unique_entities": """select count(distinct head) as unique_heads, count(distinct tail) as unique_tails,
        (select count(*) from (select head from triples where head is not null union select tail from triples where tail is not null)) as total_unique from triples""",
    "entity_summary": """
        with types as (select head_type as v from triples union all select tail_type from triples)
        select 'triples' as metric, count(*) as value from triples union all
        select 'entity_types', count(distinct v) from types union all
        select 'relation_types', count(distinct relation) from triples union all
        select 'unique_heads', count(distinct head) from triples union all
        select 'unique_tails', count(distinct tail) from triples union all
        select 'total_unique', count(*) from (select head from triples where head is not null union select tail from triples where tail is not null)""",
    "token_range": """
        select min(completion_tokens) as min_tokens, max(completion_tokens) as max_tokens,
               (select pmid from usage_log where completion_tokens is not null order by completion_tokens, logged_at limit 1) as min_key,
               (select pmid from usage_log where completion_tokens is not null order by completion_tokens desc, logged_at limit 1) as max_key,
               median(completion_tokens)::double as median_tokens, avg(completion_tokens) as mean_tokens,
               count(completion_tokens) as valid, count(*) - count(completion_tokens) as invalid from usage_log""",
}

# Articles

_JUDGED = f"""
keyed as (select *, {strip("pmid")} as k, case when period = '2021_2026' then 0 else 1 end as root from articles),
judged as (select *, case
    when coalesce(k, '') = '' or row_number() over (partition by k order by root, batch, rec_id) > 1 then 'dedup'
    when coalesce({strip("abstract")}, '') = '' or contains(abstract, '{FOREIGN_MARK}') then 'abstract'
    when coalesce(journal, '') = '{PREPRINTS}' then 'journal' else 'kept' end as verdict from keyed)"""
_TEXT = strip(f"""regexp_replace(coalesce({strip("title")}, '') || ' ' || coalesce({strip("abstract")}, ''), '{WHITE_CLASS}+', ' ', 'g')""")
_TASKS = f"""
named as (select coalesce({strip("pmid")}, 'None') as k, rec_id as place, {_TEXT} as whole from articles),
todo as (select case when k = '' then 'missing_pmid_' || place else k end as pmid, place, whole from named)"""
_PENDING = f"{_TASKS}, asked as (select * from todo where pmid not in (select {strip('pmid')} from usage_log where {strip('pmid')} != ''))"
_FREE = f"""
seen as (select distinct {strip("pmid")} as k from sample_history where pmid is not null),
keyed as (select *, {strip("pmid")} as k from articles),
free as (select *, row_number() over (partition by k order by rec_id) as nth from keyed where k != '' and k not in (select k from seen))"""

SQL |= {
    "merge_first_wins": f"with {_JUDGED} select rec_id, k as pmid from judged where verdict = 'kept'",
    "merge_drop_reasons": f"""with {_JUDGED} select batch, count(*) as total, count(*) filter (verdict = 'kept') as kept,
        count(*) filter (verdict = 'dedup') as dedup, count(*) filter (verdict = 'abstract') as abstract, count(*) filter (verdict = 'journal') as journal
        from judged group by batch""",
    "merge_with_ids": f"""with {_JUDGED} select (row_number() over (order by root, batch, rec_id))::varchar as "ID", replace(period, '_', '-') as "Time", rec_id
        from judged where verdict = 'kept'""",
    "sample_excluding_history": f"with {_FREE} select rec_id, k as pmid from free where nth = 1 order by md5(k || ':7'), k limit {SAMPLE}",
    "sample_state_totals": f"""
        with h as (select coalesce({strip("pmid")}, '') as k, sample_no from sample_history),
        a as (select coalesce({strip("pmid")}, '') as k from articles), {_FREE}
        select (select count(distinct sample_no) from h) as samples, (select count(distinct k) from h where k != '') as sampled_keys,
               (select count(*) from h where k = '') as sampled_missing, (select coalesce(max(sample_no), 0) + 1 from h) as next_sample,
               count(*) as rows, count(*) filter (k = '') as missing, count(*) filter (k != '' and k in (select k from seen)) as drawn_before,
               (select count(*) from free where nth > 1) as repeated, (select count(*) from free where nth = 1) as candidates from a""",
    "normalize_truncate": f"""with {_TASKS} select pmid, place, md5(left(whole, 800)) as input_md5, length(whole) as original_len, length(whole) > 800 as is_truncated from todo""",
    "resume_pending": f"with {_PENDING} select pmid, place from asked",
    "extract_with_stub": f"""with {_PENDING}, cut as (select pmid, place, string_split(left(whole, 8000), ' ') as w from asked)
        select pmid, place, pmid as own_pmid, w[1] as head, w[-1] as tail from cut""",
    "extraction_usage": f"""with {_PENDING} select pmid, len(string_split(left(whole, 8000), ' ')) as completion_tokens, '2026-01-01T00:00:00+00:00' as timestamp from asked""",
    "extraction_run_counts": f"""with {_PENDING} select (select count(*) from todo) as total, (select count(*) from todo) - count(*) as skipped,
        count(*) as success, 0::bigint as failed, count(*) as triples, count(*) filter (length(whole) > 8000) as truncated from asked""",
    "parse_model_output": "select id1, head, relation, tail from triples",
    "parse_article_xml": f"""select {strip("pmid")} as "PMID", coalesce({strip("doi")}, '') as "DOI", coalesce({strip("journal")}, '') as "Journal",
        coalesce({strip("title")}, '') as "Title", {strip("'AIM: ' || " + "coalesce(" + strip("abstract") + ", '')")} as "Abstract"
        from articles where {strip("pmid")} != ''""",
}

# Cleaning


def _reasons(null_key: bool) -> str:
    parts = []
    for key in REQUIRED:
        c = KEYS.get(key, key)
        blank = f"{c} is null" if key == "score" else f"{c} is null or {strip(c)} = ''"
        if null_key:
            parts.append(f"case when {c} is null then 'Missing {key} key' end")
        parts.append(f"case when {blank} then 'Missing {key} value' end")
    return f"checked as (select *, nullif(concat_ws('; ', {', '.join(parts)}), '') as reason from t)"


def _renamed(column: str) -> str:
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in TYPE_NAMES.items()) + f" else {column} end"


_CHANGED = " + ".join(f"(case when {_renamed(c)} != {c} then 1 else 0 end)" for c in _TYPES)
_ROUTED = f"""{_counts(_TYPES)}, rares as (select value from counts where count < {RARE}),
routed as (select t.*, coalesce({strip("head_type")} in (select value from rares), false) or coalesce({strip("tail_type")} in (select value from rares), false) as rare from t)"""
_DEFINED = f"{_T}, known as (select term from vocab where kind = 'relation'), split as (select t.*, coalesce({strip('relation')} in (select term from known), false) as defined from t)"
_RULES = f"""{_DEFINED}, odd as (select distinct {strip("relation")} as r from split where not defined and {strip("relation")} != ''),
rules as (select r, ['Match', 'Reverse', 'Delete'][('0x' || md5(r)[1:4])::int % 3 + 1] as action from odd)"""

SQL |= {
    "add_ids": f"""with {_T} select (row_number() over (order by line))::varchar as "ID1", (row_number() over (partition by pmid order by line))::varchar as "ID2", line, pmid from t""",
    "format_errors": f"with {_T}, {_reasons(False)} select id1, reason from checked where reason is not null",
    "format_verdict_counts": f"with {_T}, {_reasons(False)} select coalesce(reason, 'correct') as verdict, count(*) as triples from checked group by 1",
    "format_error_examples": f"with {_T}, {_reasons(False)} select id1, reason from checked where reason is not null order by line limit 10",
    "format_error_lines": f"with {_T}, {_reasons(True)} select id1, reason from checked where reason is not null",
    "rare_type_split": f"with {_ROUTED} select id1, rare from routed",
    "rare_type_judge": f"""with {_ROUTED}, left_over as (select head_type as v from routed where not rare union all select tail_type from routed where not rare),
        again as (select {strip("v")} as v, count(*) as n from left_over where {strip("v")} != '' group by 1)
        select count(*) filter (n < {RARE}) as rare_types, case when count(*) filter (n < {RARE}) > 0 then 'Yes' else 'No' end as any_rare from again""",
    "amend_types": f"select id1, {', '.join(f'{_renamed(c)} as {c}' for c in _TYPES)}, ({_CHANGED})::bigint as changed from triples",
    "amend_and_append": f"""with {_ROUTED} select id1, head_type, tail_type, 0::bigint as part from routed where not rare union all
        select id1, {_renamed("head_type")}, {_renamed("tail_type")}, 1 from routed where rare""",
    "relation_vocab_split": f"with {_DEFINED} select id1, defined from split",
    "relation_stats_defined": f"with {_counts(['relation'])} {_ranked('counts where value in (select term from vocab where kind = ' + repr('relation') + ')', _SEEN)}",
    "relation_stats_undefined": f"with {_counts(['relation'])} {_ranked('counts where value not in (select term from vocab where kind = ' + repr('relation') + ')', _SEEN)}",
    "relation_stats_unused": f"with {_counts(['relation'])} select term as value from vocab where kind = 'relation' and term not in (select value from counts)",
    "apply_relation_rules": f"""with {_RULES} select id1, head, head_type, relation, tail, tail_type, 0::bigint as part from split where defined union all
        select id1, case when action = 'Reverse' then tail else head end, case when action = 'Reverse' then tail_type else head_type end, 'associated_with',
               case when action = 'Reverse' then head else tail end, case when action = 'Reverse' then head_type else tail_type end, 1
        from split join rules on relation = r where not defined and action != 'Delete'""",
    "rule_action_histogram": f"with {_RULES} select action, count(*) as count from t join rules on relation = r group by 1",
}

# Diagnostics

_RUNS = f"""{_T}, keyed as (select coalesce(pmid, 'None') as key, line from t),
islands as (select key, line, line - row_number() over (partition by key order by line) as run from keyed),
runs as (select key, min(line) as start_line, max(line) as end_line, count(*) as record_count from islands group by key, run)"""
_REPEATED = f"""{_RUNS}, several as (select key, count(*) as segments from runs group by key having count(*) > 1),
repeats as (select runs.*, segments, row_number() over (partition by key order by start_line) as segment from runs join several using (key))"""
_COMPARED = f"""
a as (select distinct {strip("pmid")} as key from sample_history where {strip("pmid")} != ''),
b as (select distinct {strip("pmid")} as key from usage_log where {strip("pmid")} != ''),
sides as (select key, case when key in (select key from b) then 'shared' else 'only_a' end as side from a union all
          select key, 'only_b' from b where key not in (select key from a))"""

SQL |= {
    "pmid_segments": f"with {_RUNS} select * from runs",
    "repeated_pmids": f"with {_REPEATED} select * from repeats",
    "repeated_target_pmids": f"with {_REPEATED} select * from repeats where key in (select {strip('pmid')} from usage_log)",
    "distinct_first_seen": f"""with {_T}, firsts as (select {strip("pmid")} as key, min(line) as first from t where {strip("pmid")} != '' group by 1)
        select key, first, row_number() over (order by first) as rank from firsts""",
    "pmid_set_comparison": f"with {_COMPARED} select s.side, count(key) as keys from (values ('shared'), ('only_a'), ('only_b')) s(side) left join sides using (side) group by 1",
    "numeric_first_sort": f"""with {_COMPARED} select key, side, row_number() over (order by not regexp_matches(key, '^[0-9]+$'), try_cast(key as decimal(38, 0)) nulls first, key) as rank from sides""",
    "vocab_conformance": """
        with used as (select 'entity_type' as kind, head_type as term from triples union select 'entity_type', tail_type from triples union select 'relation', relation from triples)
        select kind, term, 'not_defined' as side from used where term is not null and (kind, term) not in (select (kind, term) from vocab) union all
        select kind, term, 'not_used' from vocab where (kind, term) not in (select (kind, term) from used where term is not null)""",
}
