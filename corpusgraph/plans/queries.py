"""Queries over the test tables, at least one for every operator. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.model_output import parse_answer
from corpusgraph.functions.text import is_blank, pystrip
from corpusgraph.operators import comparing, counting, extraction, merging, ordinals, routing, runs, sampling, validation
from corpusgraph.session import durable
from corpusgraph.sources import article_xml

Query = Callable[[SparkSession, str], DataFrame]

TYPES = ["head_type", "tail_type"]
#: Types and relations under so many occurrences are rare, charts begin at so many, samples hold so many.
RARE, CHART, SAMPLE = 20, 50, 500
#: Columns of the table that stand for the required keys of a triple.
KEYS = {"ID1": "id1", "ID2": "id2", "PMID": "pmid"}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "articles")


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    """The triples with ``line``, their place in the file they stand for."""
    return _table(spark, folder, "triples").withColumn("line", F.col("id1").cast("bigint"))


def _vocabulary(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return _table(spark, folder, "vocab").where(F.col("kind") == kind).select("term")


def _delivered() -> list[Column]:
    """The order of deliveries: the later period first, then batches, then records."""
    return [F.when(F.col("period") == "2021_2026", 0).otherwise(1), F.col("batch"), F.col("rec_id")]


# Frequencies


def entity_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.value_counts(_triples(spark, folder), TYPES, "line"))


def raw_entity_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.value_counts(_triples(spark, folder), TYPES, "line", strip=False))


def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.value_counts(_triples(spark, folder), ["relation"], "line"))


def raw_relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.value_counts(_triples(spark, folder), ["relation"], "line", strip=False))


def rare_entity_types(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.below(counting.value_counts(_triples(spark, folder), TYPES, "line"), RARE), "rising_name")


def chart_data(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.at_least(counting.value_counts(_triples(spark, folder), TYPES, "line", strip=False), CHART), "rising_first_seen")


def journal_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.ranked(counting.literal_counts(_articles(spark, folder), "journal"), "name")


def unique_entities(spark: SparkSession, folder: str) -> DataFrame:
    return counting.unique_entities(_triples(spark, folder))


def entity_summary(spark: SparkSession, folder: str) -> DataFrame:
    return counting.summary(_triples(spark, folder), TYPES, "relation")


def token_range(spark: SparkSession, folder: str) -> DataFrame:
    at = F.unix_micros(F.to_timestamp("logged_at"))
    return counting.token_range(_table(spark, folder, "usage_log"), "completion_tokens", "pmid", at)


# Articles


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return merging.judged(_articles(spark, folder), "pmid", "abstract", "journal", _delivered())


def merge_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where("verdict = 'kept'").select("rec_id", pystrip("pmid").alias("pmid"))


def merge_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return merging.drop_reasons(_judged(spark, folder), "batch")


def merge_with_ids(spark: SparkSession, folder: str) -> DataFrame:
    articles = _articles(spark, folder)
    roots = [articles.where(F.col("period") == p).drop("period") for p in ("2021_2026", "2016_2020")]
    both = merging.union_roots(roots, "Time", ["2021-2026", "2016-2020"])
    order = [F.col("root"), F.col("batch"), F.col("rec_id")]
    return merging.numbered(merging.merged(both, "pmid", "abstract", "journal", order), order).select("ID", "Time", "rec_id")


def sample_excluding_history(spark: SparkSession, folder: str) -> DataFrame:
    free = sampling.pool(_articles(spark, folder), "pmid", _table(spark, folder, "sample_history"), "pmid", [F.col("rec_id")])
    return sampling.drawn(free, "pmid", SAMPLE, seed=7).select("rec_id", pystrip("pmid").alias("pmid"))


def sample_state_totals(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.totals(_articles(spark, folder), "pmid", _table(spark, folder, "sample_history"), "pmid", "sample_no")


def normalize_truncate(spark: SparkSession, folder: str) -> DataFrame:
    todo = extraction.tasks(_articles(spark, folder), "pmid", "title", "abstract", "rec_id", 800)
    return todo.select("pmid", "place", F.md5("input_text").alias("input_md5"), "original_len", "is_truncated")


# Extraction


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.tasks(_articles(spark, folder), "pmid", "title", "abstract", "rec_id")


def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.pending(_tasks(spark, folder), _table(spark, folder, "usage_log")).select("pmid", "place")


def _run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    todo = _tasks(spark, folder)
    asked = extraction.pending(todo, _table(spark, folder, "usage_log"))
    return todo, asked, durable(extraction.extract(asked, extraction.StubExtractor(), "system"))


def extract_with_stub(spark: SparkSession, folder: str) -> DataFrame:
    *_, results = _run(spark, folder)
    found = extraction.triples(results)
    return found.select("pmid", "place", F.get_json_object("raw", "$.PMID").alias("own_pmid"), F.get_json_object("raw", "$.head").alias("head"), F.get_json_object("raw", "$.tail").alias("tail"))


def extraction_usage(spark: SparkSession, folder: str) -> DataFrame:
    *_, results = _run(spark, folder)
    return extraction.usage(results, F.lit("2026-01-01T00:00:00+00:00")).select("pmid", "completion_tokens", "timestamp")


def extraction_run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.run_counts(*_run(spark, folder))


def parse_model_output(spark: SparkSession, folder: str) -> DataFrame:
    """The triples as a model would answer them: fenced, bare, or in prose with brackets before and after."""
    array = F.to_json(F.array(F.struct("head", "relation", "tail")))
    kind = F.col("line") % 3
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(kind == 1, array).otherwise(F.concat(F.lit("The triples are\n"), array, F.lit("\nas asked [sic].")))
    parsed = _triples(spark, folder).select("id1", parse_answer(answer).alias("a")).select("id1", F.explode("a.triples").alias("t"))
    return parsed.select("id1", *[F.get_json_object("t", f"$.{c}").alias(c) for c in ("head", "relation", "tail")])


def parse_article_xml(spark: SparkSession, folder: str) -> DataFrame:
    """The articles written as XML with markup in their titles, and read again."""

    def safe(c: str) -> Column:
        out = F.coalesce(c, F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    parts = ["<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>", safe("pmid"), "</PMID><Article><Journal><Title>", safe("journal"), "</Title></Journal><ArticleTitle><i>", safe("title"), "</i> </ArticleTitle><Abstract><AbstractText Label='AIM'>", safe("abstract"), "</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>", safe("doi"), "</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"]
    documents = _articles(spark, folder).select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))
    return article_xml.articles(documents).select("PMID", "DOI", "Journal", "Title", "Abstract")


# Cleaning


def add_ids(spark: SparkSession, folder: str) -> DataFrame:
    return ordinals.add_ids(_triples(spark, folder).drop("id1", "id2"), "pmid", "line").select("ID1", "ID2", "line", "pmid")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return validation.check_columns(_triples(spark, folder), KEYS)


def format_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).where("reason is not null").select("id1", "reason")


def format_verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).groupBy(F.coalesce("reason", F.lit("correct")).alias("verdict")).agg(F.count("*").alias("triples"))


def format_error_examples(spark: SparkSession, folder: str) -> DataFrame:
    return validation.examples(_checked(spark, folder), "line").select("id1", "reason")


def format_error_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The triples as lines of JSON without the keys of null values, checked as lines."""
    names = {v: k for k, v in KEYS.items()}
    raw = F.to_json(F.struct(*[F.col(KEYS.get(k, k)).alias(names.get(k, k)) for k in validation.REQUIRED]))
    return validation.check_lines(_triples(spark, folder).select("id1", raw.alias("raw"))).where("reason is not null").select("id1", "reason")


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_rare_types(_triples(spark, folder), TYPES, "line", RARE)


def rare_type_split(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("id1", "rare")


def rare_type_judge(spark: SparkSession, folder: str) -> DataFrame:
    """Whether what the split left as correct still has rare types."""
    return validation.has_rare_types(counting.value_counts(_routed(spark, folder).where("not rare"), TYPES, "line"), RARE)


def amend_types(spark: SparkSession, folder: str) -> DataFrame:
    return routing.rename_types(_triples(spark, folder), TYPES).select("id1", *TYPES, F.col("changed").cast("bigint").alias("changed"))


def amend_and_append(spark: SparkSession, folder: str) -> DataFrame:
    routed = _routed(spark, folder)
    amended = routing.rename_types(routed.where("rare"), TYPES)
    return routing.append(routed.where("not rare"), amended).select("id1", *TYPES, F.col("part").cast("bigint").alias("part"))


def _by_relation(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_relations(_triples(spark, folder), "relation", _vocabulary(spark, folder, "relation"))


def relation_vocab_split(spark: SparkSession, folder: str) -> DataFrame:
    return _by_relation(spark, folder).select("id1", "defined")


def _statistics(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        counts = counting.value_counts(_triples(spark, folder), ["relation"], "line")
        found = routing.relation_statistics(counts, _vocabulary(spark, folder, "relation"))[name]
        return found if name == "unused" else counting.ranked(found)

    return query


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for every relation outside the vocabulary, its action by the hash of its name."""
    odd = _by_relation(spark, folder).where("not defined").select(pystrip("relation").alias("relation")).where(~is_blank("relation")).distinct()
    digit = F.conv(F.substring(F.md5("relation"), 1, 4), 16, 10).cast("int") % 3
    action = F.element_at(F.array(*map(F.lit, routing.ACTIONS)), digit + 1)
    return routing.check_rules(odd.select("relation", action.alias("matching_manual_type"), F.lit("associated_with").alias("matching_manual_relation")))


def apply_relation_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The defined triples, and the others as the rules have them; padded and missing relations have no rule and drop."""
    split = _by_relation(spark, folder)
    cleaned = routing.apply_rules(split.where("not defined"), _rules(spark, folder), strict=False)
    return routing.append(split.where("defined"), cleaned).select("id1", "head", "head_type", "relation", "tail", "tail_type", F.col("part").cast("bigint").alias("part"))


def rule_action_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return routing.action_counts(_triples(spark, folder), _rules(spark, folder))


# Diagnostics


def pmid_segments(spark: SparkSession, folder: str) -> DataFrame:
    return runs.runs(_triples(spark, folder), F.coalesce("pmid", F.lit("None")), "line")


def repeated_pmids(spark: SparkSession, folder: str) -> DataFrame:
    return runs.repeated(runs.runs(_triples(spark, folder), F.coalesce("pmid", F.lit("None")), "line"))


def repeated_target_pmids(spark: SparkSession, folder: str) -> DataFrame:
    """Only the keys of the usage log."""
    targets = _table(spark, folder, "usage_log").select(F.col("pmid").alias("key"))
    return runs.repeated(runs.runs(_triples(spark, folder), F.coalesce("pmid", F.lit("None")), "line"), targets)


def distinct_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return ordinals.with_ordinal(ordinals.first_seen(_triples(spark, folder), F.col("pmid"), "line"), "rank", "first")


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.compared(comparing.keys(_table(spark, folder, "sample_history"), "pmid"), comparing.keys(_table(spark, folder, "usage_log"), "pmid"))


def pmid_set_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.sizes(_compared(spark, folder))


def numeric_first_sort(spark: SparkSession, folder: str) -> DataFrame:
    return ordinals.with_ordinal(_compared(spark, folder), "rank", *comparing.numeric_first("key"))


def _used(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    triples = _triples(spark, folder)
    return {"entity_type": triples.select(F.explode(F.array(*TYPES)).alias("term")), "relation": triples.select(F.col("relation").alias("term"))}


def vocab_conformance(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.conformance(_used(spark, folder), {k: _vocabulary(spark, folder, k) for k in ("entity_type", "relation")})


def conformance_report(spark: SparkSession, folder: str) -> DataFrame:
    triples = _triples(spark, folder)
    columns = [triples.select(F.col(c).alias("term")) for c in (*TYPES, "relation")]
    return comparing.report(*columns, vocab_conformance(spark, folder), triples)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        entity_type_counts, raw_entity_type_counts, relation_counts, raw_relation_counts, rare_entity_types, chart_data, journal_counts,
        unique_entities, entity_summary, token_range, merge_first_wins, merge_drop_reasons, merge_with_ids, sample_excluding_history,
        sample_state_totals, normalize_truncate, resume_pending, extract_with_stub, extraction_usage, extraction_run_counts,
        parse_model_output, parse_article_xml, add_ids, format_errors, format_verdict_counts, format_error_examples, format_error_lines,
        rare_type_split, rare_type_judge, amend_types, amend_and_append, relation_vocab_split, apply_relation_rules,
        rule_action_histogram, pmid_segments, repeated_pmids, repeated_target_pmids, distinct_first_seen, pmid_set_comparison,
        numeric_first_sort, vocab_conformance, conformance_report,
    )
} | {f"relation_stats_{n}": _statistics(n) for n in ("defined", "undefined", "unused")}
