import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import comparing, counting, extraction, keys, merging, ordinals, routing, runs, sampling, validation

ARTICLE = "rec int, root int, pmid string, abstract string, journal string, batch string"


def test_first_wins_before_filters(spark, got):
    df = spark.createDataFrame(
        [
            (1, 0, "1", " ", "J", "a"), (2, 1, "1", "good", "J", "a"), (3, 0, " 2 ", "good", "J", "a"), (4, 0, "2", "good", "J", "b"),
            (5, 0, " ", "good", "J", "b"), (6, 0, None, "good", "J", "b"), (7, 0, "3", "的", "J", "b"), (8, 0, "4", "good", merging.PREPRINTS, "b"),
            (9, 0, "5", "good", merging.PREPRINTS + ".", None), (10, 0, "6", None, None, None),
        ], ARTICLE,
    )
    judged = merging.judged(df, "pmid", "abstract", "journal", [F.col("root"), F.col("rec")])
    assert got(judged, "rec", "verdict") == sorted(
        [(1, "abstract"), (2, "dedup"), (3, "kept"), (4, "dedup"), (5, "dedup"), (6, "dedup"), (7, "abstract"), (8, "journal"), (9, "kept"), (10, "abstract")], key=repr
    )
    assert got(merging.drop_reasons(judged, "batch")) == [("a", 3, 1, 1, 1, 0), ("b", 5, 0, 3, 1, 1), (None, 2, 1, 0, 1, 0)]
    once = merging.merged(df, "pmid", "abstract", "journal", [F.col("root"), F.col("rec")])
    assert got(merging.merged(once, "pmid", "abstract", "journal", [F.col("root"), F.col("rec")])) == got(once)


def test_union_and_numbers(spark, got):
    a, b = spark.createDataFrame([(1, None), (2, "own")], "x int, Time string"), spark.createDataFrame([(3,)], "x int")
    both = merging.union_roots([a, b], "Time", ["new", "old"])
    assert got(both) == sorted([(1, "new", 0), (2, "own", 0), (3, "old", 1)], key=repr)
    assert got(merging.numbered(both, [F.desc("x")]), "ID", "x") == [("1", 3), ("2", 2), ("3", 1)]
    assert "ID" in merging.numbered(a.withColumn("ID", F.lit("9")), [F.col("x")]).columns


def test_ordinals_over_many_partitions_and_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 3 * F.col("id") % 2).alias("k"), (F.lit(5000) - F.col("id")).alias("o"))
    numbered = ordinals.with_ordinal(df.repartition(13), "n", "o").orderBy("o").collect()
    assert [r.n for r in numbered] == list(range(1, 5001))
    inside = ordinals.with_ordinal_in(df.repartition(7), "n", "k", "o").collect()
    by = {}
    for r in sorted(inside, key=lambda r: r.o):
        by[r.k] = by.get(r.k, 0) + 1
        assert r.n == by[r.k]


def test_ids(spark, got):
    df = spark.createDataFrame([(1, "a", "old"), (2, None, "old"), (3, "a", "old"), (4, " a", "old"), (5, None, "x")], "line int, pmid string, ID2 string")
    assert got(ordinals.add_ids(df, "pmid", "line"), "ID1", "ID2", "pmid") == [("1", "1", "a"), ("2", "1", None), ("3", "2", "a"), ("4", "1", " a"), ("5", "2", None)]
    assert got(ordinals.add_ids(df.limit(0), "pmid", "line")) == []


def test_pool_sample_and_totals(spark, got):
    articles = spark.createDataFrame([(1, "1", "x"), (2, " 1", "y"), (3, "2", "x"), (4, "", "x"), (5, None, "x"), (6, "3", "x")], "rec int, pmid string, k string")
    history = spark.createDataFrame([(1, " 2 "), (3, ""), (3, None), (1, "2"), (1, "9")], "no int, pmid string")
    pool = sampling.pool(articles, "pmid", history, "pmid", [F.col("rec")])
    assert got(pool, "rec") == [(1,), (6,)]
    one = sampling.drawn(pool, "pmid", 1, seed=1)
    assert got(one) == got(sampling.drawn(pool.repartition(5), "pmid", 1, seed=1)) and one.count() == 1
    assert sampling.drawn(pool, "pmid", 9).count() == 2 and sampling.drawn(pool.limit(0), "pmid", 3, seed=1).count() == 0
    assert got(sampling.totals(articles, "pmid", history, "pmid", "no")) == [(2, 2, 2, 4, 6, 2, 1, 1, 2)]


def test_line_checks(spark, got):
    full = '{"ID1":1,"ID2":"1","PMID":"1","head":"a","head_type":"b","relation":"c","tail":"d","tail_type":"e","source_sentence":"f","score":0}'
    lines = [full, "", "bad", "[1]", full.replace('"head":"a",', ""), full.replace('"a"', "[]").replace('"f"', '" "'), "{}", full.replace(":0}", ":false}")]
    df = validation.check_lines(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "line int, raw string"))
    found = {r.line: r.reason for r in df.collect()}
    assert [found[i] for i in (0, 1, 2, 3, 7)] == [None, "Missing line value", "Invalid JSON", "JSON value is not an object", None]
    assert found[4] == "Missing head key; Missing head value" and found[5] == "Missing head value; Missing source_sentence value"
    assert found[6].count(";") == 19 and found[6].startswith("Missing ID1 key; Missing ID1 value; Missing ID2 key")
    right, wrong = validation.split(df)
    assert right.count() + wrong.count() == len(lines) and validation.check_lines(right).where("reason is not null").count() == 0
    assert got(validation.examples(df, "line", 2), "line") == [(1,), (2,)]


def test_missing_columns_and_text_assertion(spark):
    df = validation.check_columns(spark.createDataFrame([("1",)], "ID1 string"))
    assert df.collect()[0].reason.startswith("Missing ID2 key; Missing ID2 value")
    wrong = spark.createDataFrame([("a", "string"), ("[1]", "array")], "v string, kind string")
    assert validation.assert_text(wrong.limit(1), "kind", "v").count() == 1
    with pytest.raises(Exception, match="v is a array"):
        validation.assert_text(wrong, "kind", "v").collect()


def test_ties_stand_as_first_seen(spark, got):
    df = spark.createDataFrame([(1, "x", "b"), (2, "a", "x")], "line int, h string, t string")
    assert got(counting.ranked(counting.value_counts(df, ["h", "t"], "line"))) == [("a", 1, 3), ("b", 1, 2), ("x", 2, 1)]
    with pytest.raises(ValueError):
        counting.at_least(df, -1)


def test_token_range(spark, got):
    df = spark.createDataFrame([("a", "5", 1), ("b", "9", 2), ("c", "9", 3), ("d", None, 4), ("e", "x", 5), ("f", "12.7", 6), ("g", "2", 7)], "k string, n string, o int")
    assert got(counting.token_range(df, "n", "k", F.col("o"))) == [(2, 9, "g", "b", 7.0, 6.25, 4, 3)]
    assert got(counting.token_range(df.limit(0), "n", "k", F.col("o"))) == [(None, None, None, None, None, None, 0, 0)]


def test_entities(spark, got):
    df = spark.createDataFrame([("a", "b", "r", "x", "y"), ("b", None, "r", "x", None)], "head string, tail string, relation string, h string, t string")
    assert got(counting.unique_entities(df)) == [(2, 1, 2)]
    assert dict(got(counting.summary(df, ["h", "t"], "relation"))) == {"triples": 2, "entity_types": 2, "relation_types": 1, "unique_heads": 2, "unique_tails": 1, "total_unique": 2}


def test_rare_types_at_the_threshold(spark, got):
    data = [(i, " a", "b") for i in range(3)] + [(3, None, "c"), (4, "a", "c"), (5, "b", "")]
    df = spark.createDataFrame(data, "id int, h string, t string").withColumn("rare", F.lit("clash"))
    found = dict(got(routing.route_rare_types(df, ["h", "t"], "id", 4), "id", "rare"))
    assert found == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_relations_and_rules(spark, got):
    triples = spark.createDataFrame([(1, "h", "ht", " uses ", "t", "tt"), (2, "h", "ht", "rev", "t", "tt"), (3, "h", "ht", "del", "t", "tt"), (4, "h", "ht", "map", "t", "tt"), (5, "h", "ht", None, "t", "tt")], "id int, head string, head_type string, relation string, tail string, tail_type string")
    vocabulary = spark.createDataFrame([("uses",), ("other",)], "term string")
    assert got(routing.route_relations(triples, "relation", vocabulary), "id", "defined") == [(1, True), (2, False), (3, False), (4, False), (5, False)]
    columns = "relation string, matching_manual_type string, matching_manual_relation string"
    rules = routing.check_rules(spark.createDataFrame([(" rev", "Reverse", "by"), ("del", "Delete", None), ("map", "Match", "to")], columns))
    done = routing.apply_rules(triples.where("id in (2, 3, 4)"), rules)
    assert got(done, "id", "head", "head_type", "relation", "tail") == [(2, "t", "tt", "by", "h"), (4, "h", "ht", "to", "t")]
    twice = routing.apply_rules(done.where("id = 2").drop("action"), routing.check_rules(spark.createDataFrame([("by", "Reverse", "rev")], columns)))
    assert got(twice, *triples.columns) == got(triples.where("id = 2"))
    for some in ("id = 1", "id = 5"):
        with pytest.raises(Exception, match="no rule"):
            routing.apply_rules(triples.where(some), rules).collect()
    assert got(routing.action_counts(triples, rules)) == [("Delete", 1), ("Match", 1), ("Reverse", 1)]
    for bad in ([("a", "Match", "")], [("a", "No", "b")], [("a", "Delete", ""), ("a ", "Delete", "")], [("", "Delete", "")], []):
        with pytest.raises(ValueError):
            routing.check_rules(spark.createDataFrame(bad, columns))
    with pytest.raises(ValueError, match="lack"):
        routing.check_rules(spark.createDataFrame([("a",)], "relation string"))


def test_types_renamed_and_appended(spark, got):
    df = spark.createDataFrame([("pathogen", "physology"), ("gene", None), (" pathogen", "clinical_trial")], "h string, t string")
    out = routing.rename_types(df, ["h", "t"])
    assert got(out) == sorted([("species", "physiology", 2), ("gene", None, 0), (" pathogen", "method", 1)], key=repr)
    assert got(routing.append(df.limit(1), df.select("h").limit(1)), "h", "t", "part") == sorted([("pathogen", "physology", 0), ("pathogen", None, 1)], key=repr)


def test_runs_skip_blank_lines(spark, got):
    lines = spark.createDataFrame([(1, 1, "A"), (2, None, None), (3, 2, "A"), (4, 3, "B"), (5, 4, "A")], "line int, dense int, k string")
    found = runs.runs(lines, F.col("k"), "line", "dense")
    assert got(found) == [("A", 1, 3, 2), ("A", 5, 5, 1), ("B", 4, 4, 1)]
    assert got(runs.repeated(found), "key", "start_line", "segment") == [("A", 1, 1), ("A", 5, 2)]
    nobody, other = spark.createDataFrame([(" ",)], "key string"), spark.createDataFrame([("B",)], "key string")
    assert runs.repeated(found, nobody).count() == 2 and runs.repeated(found, other).count() == 0
    assert len(runs.collected(runs.repeated(found)).collect()[0].segments) == 2


def test_sets_and_orders(spark, got):
    a, b = spark.createDataFrame([("10",), ("9 ",), ("x",), ("",)], "k string"), spark.createDataFrame([("9",), ("2",), (None,)], "k string")
    both = comparing.compared(comparing.keys(a, "k"), comparing.keys(b, "k"))
    assert got(both) == [("10", "only_a"), ("2", "only_b"), ("9", "shared"), ("x", "only_a")]
    assert got(comparing.sizes(both)) == [("only_a", 2), ("only_b", 1), ("shared", 1)]
    assert got(comparing.sizes(both.limit(0))) == [("only_a", 0), ("only_b", 0), ("shared", 0)]
    assert [r.key for r in both.orderBy(*comparing.numeric_first("key")).collect()] == ["2", "9", "10", "x"]


class Broken:
    def __call__(self, system, user):
        if "refused" in user:
            raise extraction.QuotaError("429")
        return extraction.Answer("no json" if "broken" in user else '[{"PMID": "own"}, {}]', None, 2, 2)


def test_extraction_derives_all_from_one_table(spark, got):
    articles = spark.createDataFrame([("1", "a", "b", 1), ("", "broken", None, 2), ("3", "refused", None, 3), ("4", "x" * 9000, None, 4)], "pmid string, t string, a string, p bigint")
    todo = extraction.tasks(articles, "pmid", "t", "a", "p")
    assert got(todo, "pmid", "original_len", "is_truncated") == [("1", 3, False), ("3", 7, False), ("4", 9000, True), ("missing_pmid_2", 6, False)]
    quiet = extraction.Retry(sleep=lambda s: None)
    results = extraction.extract(todo, Broken(), "s", 2, quiet).cache()
    assert got(results, "pmid", "status", "tries") == [("1", "success", 1), ("3", "failed", 3), ("4", "success", 1), ("missing_pmid_2", "failed", 3)]
    assert got(extraction.triples(results), "pmid", "nth", "raw")[:2] == [("1", 0, '{"PMID": "own"}'), ("1", 1, '{"PMID": "1"}')]
    assert got(extraction.usage(results, F.lit("t"))) == [("1", 0, 2, 2, "t"), ("4", 0, 2, 2, "t")]
    assert extraction.failures(results).count() == 2 and got(extraction.truncations(todo)) == [("4", 9000, 8000)]
    again = extraction.pending(todo, extraction.state(results))
    assert got(again, "pmid") == [("3",), ("missing_pmid_2",)]
    assert got(extraction.run_counts(todo, todo, results)) == [(4, 0, 2, 2, 4, 1)]
    results.unpersist()


def test_waits_double():
    waits = []
    answer = extraction.Retry(sleep=waits.append).call(Broken(), "", "broken")
    assert waits == [1.0, 2.0] and answer[0] is None


def test_keys_take_turns():
    ring = keys.KeyRing(["a", "b"], at_once=1, in_all=2)
    assert [ring.take(), ring.take(), ring.take()] == [0, 1, None]
    ring.give_back(0)
    ring.refuse(1)
    assert ring.take() == 0 and not ring.refresh(["a", "c"]) and ring.take() == 2
    ring.give_back(0)
    assert ring.take() is None and not ring.spent() and ring.report() == {"keys": 3, "refused": 1, "calls": 4}
    assert keys.key_status(429) == "exhausted" and keys.key_status(None) == keys.key_status(500) == "available"
