"""Triples routed by their types and relations, and rewritten by rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip
from corpusgraph.operators.counting import below, value_counts

#: Names of entity types that are put right.
TYPE_NAMES = {"clinical_trial": "method", "phenology": "phenotype", "health_factor": "health_factors", "pathogen": "species", "physology": "physiology"}
#: What a rule can do.
ACTIONS = ("Match", "Reverse", "Delete")


def route_rare_types(triples: DataFrame, columns: list[str], order: str, threshold: int) -> DataFrame:
    """``triples`` with ``rare``: true if a stripped value of any of ``columns`` occurs under ``threshold`` times in all.

    The rare values join once for each column; a triple is marked, never copied.
    """
    rare = below(value_counts(triples, columns, order), threshold).select("value")
    out, marks = triples, []
    for c in columns:
        mark = f"__rare_{c}"
        side = rare.select(F.col("value").alias(f"__value_{c}"), F.lit(True).alias(mark))
        out = out.join(side, pystrip(F.col(c).cast("string")) == F.col(f"__value_{c}"), "left").drop(f"__value_{c}")
        marks.append(F.coalesce(F.col(mark), F.lit(False)))
    either = marks[0]
    for m in marks[1:]:
        either = either | m
    return out.withColumn("rare", either).drop(*[f"__rare_{c}" for c in columns])


def route_relations(triples: DataFrame, relation: str, vocabulary: DataFrame, term: str = "term", most: int = 100_000) -> DataFrame:
    """``triples`` with ``defined``: whether the stripped relation is in the vocabulary. Null is not.

    A vocabulary is written by hand; it is broadcast below ``most`` rows and joined by shuffle above.
    """
    known = vocabulary.select(F.col(term).alias("__term")).where("__term is not null").distinct()
    if known.limit(most + 1).count() <= most:
        known = F.broadcast(known)
    joined = triples.join(known.withColumn("__known", F.lit(True)), pystrip(F.col(relation).cast("string")) == F.col("__term"), "left")
    return joined.withColumn("defined", F.coalesce("__known", F.lit(False))).drop("__term", "__known")


def relation_statistics(counts: DataFrame, vocabulary: DataFrame, term: str = "term") -> dict[str, DataFrame]:
    """``defined`` and ``undefined``: the used relations in and outside the vocabulary; ``unused``: (value) never used."""
    known = vocabulary.select(F.col(term).alias("value")).where("value is not null").distinct()
    return {
        "defined": counts.join(known, "value", "left_semi"),
        "undefined": counts.join(known, "value", "left_anti"),
        "unused": known.join(counts, "value", "left_anti"),
    }


def rename_types(triples: DataFrame, columns: list[str], names: Mapping[str, str] = TYPE_NAMES) -> DataFrame:
    """``triples`` with values of ``columns`` renamed, compared as they are, and ``changed``, how many were."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    changed, out = F.lit(0), {}
    for c in columns:
        new = F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))
        changed = changed + F.when(new != F.col(c), 1).otherwise(0)
        out[c] = new
    return triples.withColumns(out | {"changed": changed})


def append(*parts: DataFrame) -> DataFrame:
    """The parts one below the other, with ``part``, their place; columns that one lacks are null in it."""
    out = None
    for at, df in enumerate(parts):
        df = df.withColumn("part", F.lit(at))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def check_rules(rules: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rules`` (relation, matching_manual_type, matching_manual_relation), stripped, or ValueError.

    Relations must be there and differ, types be one of the actions, and a relation to map to be given unless the action
    is Delete. An empty table of rules is refused. Rules are written by hand: above ``most`` they are refused.
    """
    needed = ["relation", "matching_manual_type", "matching_manual_relation"]
    absent = [c for c in needed if c not in rules.columns]
    if absent:
        raise ValueError(f"the rules lack {', '.join(absent)}")
    clean = rules.select(*[F.coalesce(pystrip(c), F.lit("")).alias(c) for c in needed])
    bad = F.count_if
    found = clean.agg(
        F.count("*").alias("rows"),
        F.countDistinct("relation").alias("relations"),
        bad(F.col("relation") == "").alias("without a relation"),
        bad(~F.col("matching_manual_type").isin(*ACTIONS)).alias("with another action"),
        bad((F.col("matching_manual_type") != "Delete") & (F.col("matching_manual_relation") == "")).alias("without a relation to map to"),
    ).collect()[0]
    wrong = [f"{found[n]} {n}" for n in found.__fields__[2:] if found[n]]
    if found["relations"] != found["rows"]:
        wrong.append(f"{found['rows'] - found['relations']} repeated")
    if not found["rows"] or found["rows"] > most or wrong:
        raise ValueError("rules: " + ("; ".join(wrong) or f"{found['rows']} rows"))
    return clean


def apply_rules(triples: DataFrame, rules: DataFrame, relation: str = "relation", ends: tuple[str, str] = ("head", "tail"), types: tuple[str, str] = ("head_type", "tail_type"), strict: bool = True) -> DataFrame:
    """``triples`` with their relation and ends as the rules say, and ``action``; deleted ones are left out.

    Match gives the relation its mapped name, Reverse also swaps both ends and both types. The relation is looked up as it
    is, unstripped. A triple whose relation has no rule fails the query if ``strict``; else it is left out. A mapped
    relation isn't held against the vocabulary.
    """
    table = rules.select(F.col("relation").alias("__relation"), F.col("matching_manual_type").alias("action"), F.col("matching_manual_relation").alias("__mapped"))
    joined = triples.join(table, F.col(relation) == F.col("__relation"), "left")
    if strict:
        name = F.coalesce(F.concat(F.lit("no rule for relation '"), F.col(relation), F.lit("'")), F.lit("no rule for a triple without relation"))
        # The check is part of the column that decides which rows stay, so it can't be pruned away.
        joined = joined.withColumn("action", F.coalesce("action", F.raise_error(name)))
    kept = joined.where("action is not null and action != 'Delete'")
    turned = F.col("action") == "Reverse"
    swapped = {}
    for a, b in (ends, types):
        swapped[a] = F.when(turned, F.col(b)).otherwise(F.col(a))
        swapped[b] = F.when(turned, F.col(a)).otherwise(F.col(b))
    return kept.withColumns(swapped | {relation: F.col("__mapped")}).drop("__relation", "__mapped")


def action_counts(triples: DataFrame, rules: DataFrame, relation: str = "relation") -> DataFrame:
    """(action, count): how many triples each action meets; relations are counted before they meet the rules."""
    used = triples.groupBy(F.col(relation).alias("relation")).agg(F.count("*").alias("n"))
    return used.join(rules, "relation").groupBy(F.col("matching_manual_type").alias("action")).agg(F.sum("n").alias("count"))
