"""Queries over the sources and sinks: whole tables written to the shared folder in each format and read again."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.prompts import system_prompt
from corpusgraph.functions.text import is_blank, pystrip
from corpusgraph.functions.text import sql_strip as strip
from corpusgraph.operators import counting, extraction, ordinals, routing, validation
from corpusgraph.plans import queries as q
from corpusgraph.plans import sql
from corpusgraph.session import shared_dir
from corpusgraph.sources import files, harvest, json_arrays, jsonl, lines, sinks, vocabulary
from corpusgraph.streaming.extraction import extract_stream

#: Records of one array file here, and the number of the first one.
PER_FILE, FIRST = 300, 141


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}"


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Triples with the keys of a record."""
    return q._triples(spark, folder).select(F.col("id1").alias("ID1"), F.col("pmid").alias("PMID"), "head", "tail", "score", "line")


def jsonl_strict(spark: SparkSession, folder: str) -> DataFrame:
    where = _folder(spark)
    sinks.write_records(_records(spark, folder).drop("line"), where, 500)
    return jsonl.texts(jsonl.read_jsonl(spark, [where], ["ID1", "PMID", "head", "score"]), ["ID1", "PMID", "head", "score"]).select("ID1", "PMID", "head", "score")


def jsonl_appended(spark: SparkSession, folder: str) -> DataFrame:
    """The records in two deliveries to one folder."""
    where, rows = _folder(spark), _records(spark, folder)
    for half in (0, 1):
        sinks.append_records(rows.where(F.col("line") % 2 == half).drop("line"), where)
    return jsonl.texts(jsonl.read_jsonl(spark, [where], ["ID1", "tail"]), ["ID1", "tail"]).select("ID1", "tail")


def _faulty(spark: SparkSession, folder: str) -> str:
    """Lines of which one in five each is broken, no object, or blank."""
    where, at = _folder(spark), F.col("line") % 5
    whole = F.to_json(F.struct("ID1", "head"))
    raw = F.when(at == 1, F.concat(F.lit("{"), whole)).when(at == 2, F.lit("[1, 2]")).when(at == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), whole, F.lit(" ")))
    sinks.write_raw(_records(spark, folder).select(raw.alias("raw")), where)
    return where


def jsonl_lenient(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.texts(jsonl.read_jsonl(spark, [_faulty(spark, folder)], ["ID1", "head"], "lenient"), ["ID1", "head"]).select("ID1", "head")


def jsonl_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.line_counts(jsonl.read_jsonl(spark, [_faulty(spark, folder)], ["ID1"], "diagnostic"))


def asserted_text(spark: SparkSession, folder: str) -> DataFrame:
    """Heads that are text or null, which is made sure of."""
    where = _folder(spark)
    sinks.write_records(_records(spark, folder).drop("line"), where)
    read = jsonl.read_jsonl(spark, [where], ["ID1", "head"]).select(F.col("ID1.text").alias("ID1"), F.col("head.kind").alias("kind"), F.col("head.text").alias("head"))
    return validation.assert_text(read, "kind", "head").select("ID1", "head")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    where = _folder(spark)
    raw = F.concat(F.lit("\t "), "ID1", F.lit("|"), F.md5(F.coalesce("head", F.lit(""))), F.lit(" \xa0"))
    sinks.write_raw(_records(spark, folder).select(raw.alias("raw")), where)
    return lines.read_lines(spark, [where]).select("raw")


def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """The ordinals of triples with and without a defined relation, in two folders."""
    yes, no = _folder(spark), _folder(spark)
    sinks.write_split(q._by_relation(spark, folder).withColumn("raw", F.col("id1")), F.col("defined"), yes, no)
    read = [lines.read_list(spark, [where]).withColumn("side", F.lit(side)) for where, side in ((yes, "defined"), (no, "other"))]
    return read[0].unionByName(read[1])


def sorted_list(spark: SparkSession, folder: str) -> DataFrame:
    """Keys one on each line, with the place at which they are read."""
    where = _folder(spark)
    keys = q._compared(spark, folder).select("key")
    sinks.write_list(keys, where, *q.comparing.numeric_first("key"))
    return ordinals.with_ordinal(lines.read_lines(spark, [where]), "rank", "part", "line").select(F.col("raw").alias("key"), "rank")


def csv_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A table with quotes and commas in its values, written with a header and read as rules are."""
    where = _folder(spark)
    quoted = F.concat(F.lit('"'), F.md5(F.coalesce("relation", F.lit(""))), F.lit('", '), "id1")
    sinks.write_table(q._triples(spark, folder).select(F.concat(F.lit(" "), "id1").alias("relation"), quoted.alias("note"), F.when(F.col("line") % 2 == 0, F.col("id1")).alias("rest")), where)
    return vocabulary.read_rules(spark, where)


def tsv_report(spark: SparkSession, folder: str) -> DataFrame:
    """A report in one file with tabs."""
    where = f"{_folder(spark)}/report.tsv"
    counts = counting.value_counts(q._triples(spark, folder), q.TYPES, "line")
    sinks.export_report(counts.select(F.md5("value").alias("value"), "count").orderBy("value"), where)
    return spark.read.option("header", True).option("sep", "\t").csv(where).select("value", F.col("count").cast("bigint").alias("count"))


def array_files(spark: SparkSession, folder: str) -> DataFrame:
    """Articles in numbered files of one JSON array each, read with the number of their file and their place in it."""
    where = _folder(spark)
    named = q._articles(spark, folder).select(F.col("rec_id").alias("n"), F.col("pmid").alias("PMID"), F.col("title").alias("Title"), F.col("abstract").alias("Abstract"))
    numbered = ordinals.with_ordinal(named, "n", "n")
    sinks.write_arrays(numbered, "n", where, PER_FILE, FIRST)
    read = json_arrays.read_arrays(spark, files.listed(spark, where, "*/*.txt"), ["PMID", "Title", "Abstract"])
    number = F.regexp_extract("file", "file=([0-9]+)/", 1)
    return read.select(number.alias("number"), "place", "PMID", "Title", F.md5("Abstract").alias("abstract_md5"))


def array_export(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of journals as one pretty array in one file, read as the only file of a folder."""
    where = _folder(spark)
    sinks.export_rows(q.journal_counts(spark, folder).select("rank", "value", "count"), f"{where}/Journals_0007.json")
    read = json_arrays.read_arrays(spark, files.json_files(spark, where), ["value", "count"])
    return read.select(json_arrays.batch_name().alias("batch"), "value", F.col("count").cast("bigint").alias("count"))


def conformance_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The conformance report as one JSON object, read again, with the place of each term."""
    where = f"{_folder(spark)}/report.json"
    sinks.export_object(q.conformance_report(spark, folder), where)
    report = spark.read.option("multiLine", True).json(where)
    arrays = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("array<string>").alias("terms")) for n in report.columns if n not in ("records", "diff")]
    arrays += [F.struct(F.lit(n).alias("name"), F.col(f"diff.`{n}`").cast("array<string>").alias("terms")) for n in report.select("diff.*").columns]
    return report.select("records", F.explode(F.array(*arrays)).alias("a")).select("records", "a.name", F.posexplode("a.terms").alias("place", "term"))


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """What was counted while the triples were written."""
    rows, seen = sinks.observed(_records(spark, folder).drop("line"), triples=F.count("*"), without_pmid=F.count_if(is_blank("PMID")), score=F.sum("score"))
    sinks.write_records(rows, _folder(spark))
    return sinks.metrics(spark, seen)


def prompt_vocabularies(spark: SparkSession, folder: str) -> DataFrame:
    """Both vocabularies written into a prompt, and read off it."""
    terms = {k: [r["term"] for r in q._vocabulary(spark, folder, k).orderBy("term").collect()] for k in ("entity_type", "relation")}
    table = {k: "\n".join(f"| `{t}` | x |" for t in v) for k, v in terms.items()}
    where = f"{_folder(spark)}/prompt.md"
    sinks.put(spark, where, "\n".join(["# Task", vocabulary.ENTITIES, table["entity_type"], "", vocabulary.RELATIONS, table["relation"], "", vocabulary.OUTPUT, "| `none` |", "## Input", "{text}"]))
    prompt = spark.read.text(where, wholetext=True).collect()[0]["value"]
    assert vocabulary.relations(prompt) == vocabulary.vocabularies(prompt)["relation"]
    return vocabulary.vocabulary_table(spark, system_prompt(prompt, True))


def strict_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The undefined relations by rules of which every one must have its own, looked up as it is written."""
    odd = q._by_relation(spark, folder).where("not defined").where(~is_blank("relation"))
    stripped = odd.withColumn("relation", pystrip("relation"))
    cleaned = routing.apply_rules(stripped, q._rules(spark, folder), strict=True)
    return cleaned.select("id1", "head", "relation", "tail", "action")


def text_token_range(spark: SparkSession, folder: str) -> DataFrame:
    """Counts that come as text: whole numbers, also with underscores or padded, fractions, words and nothing."""
    log = q._table(spark, folder, "usage_log")
    at, n = F.col("prompt_tokens") % 4, F.col("completion_tokens").cast("string")
    text = F.when(at == 0, F.concat(F.lit(" "), n, F.lit(" "))).when(at == 1, F.concat(n, F.lit(".7"))).when(at == 2, F.concat(F.lit("1_"), n)).when(at == 3, n)
    return counting.token_range(log.withColumn("completion_tokens", counting.whole_number(text)), "completion_tokens", "pmid", F.unix_micros(F.to_timestamp("logged_at")))


def stamped_usage(spark: SparkSession, folder: str) -> DataFrame:
    """The usage rows of a run, whose stamp is the present in ISO form, UTC."""
    *_, results = q._run(spark, folder)
    return extraction.usage(results).select("pmid", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(?:Z|\+00:00)$").alias("stamped"))


class Moody:
    """A model that refuses some calls and answers others with prose, but to the same text in the end as the stub does."""

    def __init__(self) -> None:
        self.calls: dict[str, int] = {}

    def __call__(self, system: str, user: str) -> extraction.Answer:
        n = self.calls[user] = self.calls.get(user, 0) + 1
        if n == 1 and len(user) % 2:
            raise extraction.QuotaError("slow down")
        if n <= 2 and len(user) % 3 == 0:
            return extraction.Answer("I can't say [yet")
        return extraction.StubExtractor()(system, user)


def _at_once(seconds: float) -> None:
    """No waiting."""


def extract_with_retries(spark: SparkSession, folder: str) -> DataFrame:
    """As with the stub, from a model that has to be asked again."""
    todo = q._tasks(spark, folder)
    asked = extraction.pending(todo, q._table(spark, folder, "usage_log"))
    found = extraction.triples(q.durable(extraction.extract(asked, Moody(), "system", retry=extraction.Retry(sleep=_at_once))))
    return found.select("pmid", "place", F.get_json_object("raw", "$.PMID").alias("own_pmid"), F.get_json_object("raw", "$.head").alias("head"), F.get_json_object("raw", "$.tail").alias("tail"))


def extract_stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Every article of the table, asked about as a stream of its file."""
    where = _folder(spark)
    source = _folder(spark)
    articles = q._articles(spark, folder).select("rec_id", "pmid", "title", "abstract")
    articles.write.parquet(source)
    stream = spark.readStream.schema(articles.schema).parquet(source)
    extract_stream(stream, "pmid", "title", "abstract", "rec_id", extraction.StubExtractor(), "system", f"{where}/out", f"{where}/state").awaitTermination()
    return extraction.usage(spark.read.schema(extraction.RESULT).parquet(f"{where}/out/results"), F.lit("")).select("pmid", "completion_tokens")


@dataclass(frozen=True)
class Calendar:
    """A service with so many records a day as the day of the month, and one day with far more."""

    first: date = date(2020, 1, 1)
    busy: date = date(2020, 1, 20)
    many: int = 3000

    def _ids(self, query: str) -> list[int]:
        days = [date(*map(int, d)) for d in re.findall(r'"(\d+)/(\d+)/(\d+)"', query)]
        low, high = map(int, m.groups()) if (m := re.search(r"\((\d+):(\d+)\[UID\]", query)) else harvest.IDS
        out = []
        for n in range((days[1] - days[0]).days + 1):
            day = days[0] + timedelta(n)
            out += [(day - self.first).days * 10_000 + i for i in range(1, 1 + (self.many if day == self.busy else day.day))]
        return [i for i in out if low <= i <= high]

    def count(self, query: str) -> int:
        return len(self._ids(query))

    def fetch(self, query: str, start: int, size: int) -> str:
        return "<S>" + "".join(f"<PubmedArticle><PMID>{i}</PMID></PubmedArticle>" for i in self._ids(query)[start : start + size]) + "</S>"


def harvested(spark: SparkSession, folder: str) -> DataFrame:
    """All records of ninety days of an invented service, in leaves of at most 200, each once."""
    harvest.register(spark, Calendar(), "calendar")
    options = {"term": "immune", "from": "2020-01-01", "to": "2020-03-30", "leaf": "200", "page": "50", "pause": "0", "highId": "1000000"}
    return spark.read.format("calendar").options(**options).load().select(F.col("PMID").cast("bigint").alias("pmid"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        jsonl_strict, jsonl_appended, jsonl_lenient, jsonl_diagnostic, asserted_text, raw_lines, split_files, sorted_list, csv_rules, tsv_report, array_files,
        array_export, conformance_terms, run_metrics, prompt_vocabularies, strict_rules, text_token_range, stamped_usage, extract_with_retries, extract_stream_usage, harvested,
    )
}

_WHOLE = "id1::bigint % 5"
_STUB = sql.SQL["extract_with_stub"]
_TERMS = {"head_types": "head_type", "tail_types": "tail_type", "relations": "relation"}


def _report() -> str:
    used = [f"select '{n}' as name, {c} as term from triples" for n, c in _TERMS.items()] + [f"select 'entity_types_union', {c} from triples" for c in q.TYPES]
    for kind, columns in (("entity", q.TYPES), ("relation", ["relation"])):
        name = "entity_type" if kind == "entity" else kind
        data = " union ".join(f"select {c} as term from triples where {c} is not null" for c in columns)
        vocab = f"select term from vocab where kind = '{name}'"
        used += [f"select '{kind}_not_in_prompt', term from (({data}) except {vocab})", f"select '{kind}_in_prompt_but_missing_in_data', term from ({vocab} except ({data}))"]
    return f"""with used as ({" union ".join(used)}) select (select count(*) from triples) as records, name,
        (row_number() over (partition by name order by term) - 1)::int as place, term from used where term is not null"""


SQL: dict[str, str] = {
    "jsonl_strict": """select id1 as "ID1", pmid as "PMID", head, score::varchar as score from triples""",
    "jsonl_appended": """select id1 as "ID1", tail from triples""",
    "jsonl_lenient": f"""select id1 as "ID1", head from triples where {_WHOLE} in (0, 4)""",
    "jsonl_diagnostic": f"""select case {_WHOLE} when 1 then 'invalid' when 2 then 'not_object' when 3 then 'blank' else 'ok' end as status, count(*) as lines from triples group by 1""",
    "asserted_text": """select id1 as "ID1", head from triples""",
    "raw_lines": "select id1 || '|' || md5(coalesce(head, '')) as raw from triples",
    "split_files": f"""select id1 as key, case when {strip("relation")} in (select term from vocab where kind = 'relation') then 'defined' else 'other' end as side from triples""",
    "sorted_list": sql.SQL["numeric_first_sort"].replace("select key, side, ", "select key, ", 1),
    "csv_rules": """select id1 as relation, '"' || md5(coalesce(relation, '')) || '", ' || id1 as note, case when id1::bigint % 2 = 0 then id1 end as rest from triples""",
    "tsv_report": f"with {sql._counts(q.TYPES)} select md5(value) as value, count from counts",
    "array_files": f"""with n as (select *, row_number() over (order by rec_id) - 1 as n from articles)
        select lpad(({FIRST} + n // {PER_FILE})::varchar, 4, '0') as number, n % {PER_FILE} as place, pmid as "PMID", title as "Title", md5(abstract) as abstract_md5 from n""",
    "array_export": f"select '0007' as batch, value, count from ({sql.SQL['journal_counts']})",
    "conformance_terms": _report(),
    "run_metrics": f"""select 'triples' as metric, count(*) as value from triples union all
        select 'without_pmid', count(*) from triples where coalesce({strip("pmid")}, '') = '' union all select 'score', sum(score)::bigint from triples""",
    "prompt_vocabularies": "select kind, term from vocab",
    "strict_rules": f"""with {sql._RULES} select id1, case when action = 'Reverse' then tail else head end as head, 'associated_with' as relation,
        case when action = 'Reverse' then head else tail end as tail, action from split join rules on {strip("relation")} = r where not defined and action != 'Delete'""",
    "extract_with_retries": _STUB,
    "extract_stream_usage": f"with {sql._TASKS} select pmid, len(string_split(left(whole, 8000), ' ')) as completion_tokens from todo",
    "stamped_usage": f"select pmid, true as stamped from ({sql.SQL['extraction_usage']})",
    "text_token_range": f"""with usage_log as (select * replace (case prompt_tokens % 4 when 1 then null when 2 then ('1' || completion_tokens)::bigint else
        case when prompt_tokens is not null then completion_tokens end end as completion_tokens) from usage_log) {sql.SQL["token_range"]}""",
    "harvested": """select d.range * 10000 + i.range as pmid from range(90) d, range(1, 3001) i
        where i.range <= case when d.range = 19 then 3000 else day(date '2020-01-01' + d.range::int) end""",
}
