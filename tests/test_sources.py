import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from corpusgraph.sources import article_xml, files, harvest, json_arrays, jsonl, lines, sinks, vocabulary

GOOD = '{"PMID": "1", "x": 1.50}'


def write(path, content, **mode):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_lines_are_physical_and_files_in_order(spark, tmp_path, got):
    b = write(tmp_path / "b.txt", "x\r\n\r\ny\rz\n")
    a = write(tmp_path / "a.txt", "\n".join(f"l{i}" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = lines.read_lines(spark, [b, a]).cache()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got(found.where("part = 1"), "line", "raw") == [(1, "x"), (2, ""), (3, "y"), (4, "z")]
    assert found.where("part = 0 and raw != concat('l', line)").count() == 0 and found.where("part = 0").count() == 4000
    assert lines.read_lines(spark, []).count() == 0 and lines.read_list(spark, [b]).count() == 3


def test_jsonl_modes(spark, tmp_path, got):
    path = write(tmp_path / "t.jsonl", f"{GOOD}\n\n[1]\nbad\n  {GOOD}  \n")
    assert got(jsonl.read_jsonl(spark, [path], ["PMID"], "diagnostic"), "line", "status") == [(1, "ok"), (2, "blank"), (3, "not_object"), (4, "invalid"), (5, "ok")]
    lenient = jsonl.read_jsonl(spark, [path], ["PMID", "x"], "lenient")
    assert got(jsonl.texts(lenient, ["PMID", "x"]), "line", "raw", "PMID", "x") == [(1, GOOD, "1", "1.5"), (5, GOOD, "1", "1.5")]
    with pytest.raises(Exception, match="line 3"):
        jsonl.read_jsonl(spark, [path], ["PMID"]).collect()
    fine = write(tmp_path / "fine.jsonl", f"﻿{GOOD}\r\n\r\n{GOOD}\r\n")
    assert jsonl.read_jsonl(spark, [fine], ["PMID"]).count() == 2
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, [fine], [], "other")


def test_arrays_of_records(spark, tmp_path, got):
    b = write(tmp_path / "pubmed_batch_0002.json", json.dumps([{"PMID": "3"}, 5, {"PMID": None, "Title": "t"}]))
    a = write(tmp_path / "pubmed_batch_0001.json", json.dumps([{"PMID": "1", "y": [1]}]))
    found = json_arrays.read_arrays(spark, [b, a], ["PMID", "Title"])
    assert got(found.withColumn("batch", json_arrays.batch_name()), "part", "place", "PMID", "Title", "batch") == [(0, 0, "1", None, "0001"), (1, 0, "3", None, "0002"), (1, 2, None, "t", "0002")]
    with pytest.raises(Exception, match="no JSON array"):
        json_arrays.read_arrays(spark, [write(tmp_path / "o.json", "{}")], ["PMID"]).collect()
    assert json_arrays.read_arrays(spark, []).count() == 0


def test_which_files(spark, tmp_path):
    for n in (2, 10, 1):
        write(tmp_path / f"PubMed_abstract_sampled_5000_{n}.json", "[]")
    write(tmp_path / "other.json", "[]")
    found, following = files.sample_files(spark, str(tmp_path))
    assert [f.rpartition("_")[2] for f in found] == ["1.json", "2.json", "10.json"] and following == 11
    assert len(files.json_files(spark, str(tmp_path))) == 4 and len(files.json_files(spark, str(tmp_path / "other.json"))) == 1
    os.mkdir(tmp_path / "empty")
    write(tmp_path / "a.txt", "")
    for bad in ("empty", "none"):
        with pytest.raises(FileNotFoundError):
            files.json_files(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        files.json_files(spark, str(tmp_path / "a.txt"))


PROMPT = """# P
## Predefined Entity Types
| name | means |
|---|---|
| `gene` | a |
| `cell_type` | b |
## Predefined Relation Types
| `binds_to` | x |
| not a row |
## Output Format
| `ignored` | x |
"""


def test_vocabularies(spark, got):
    assert vocabulary.vocabularies(PROMPT) == {"entity_type": ["cell_type", "gene"], "relation": ["binds_to"]}
    assert vocabulary.relations(PROMPT) == ["binds_to"] and vocabulary.relations("none") == []
    assert got(vocabulary.vocabulary_table(spark, PROMPT)) == [("entity_type", "cell_type"), ("entity_type", "gene"), ("relation", "binds_to")]
    for bad in (PROMPT.replace("## Output Format", ""), PROMPT.replace("`", "")):
        with pytest.raises(ValueError):
            vocabulary.vocabularies(bad)


def test_rules_with_a_mark_of_byte_order(spark, tmp_path, got):
    path = write(tmp_path / "r.csv", "﻿relation,matching_manual_type,matching_manual_relation,more\n a ,Match,\"b,c\",x\n")
    assert got(vocabulary.read_rules(spark, path), "relation", "matching_manual_type", "matching_manual_relation") == [("a", "Match", "b,c")]


XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID> 7 </PMID><Article><Journal><ISOAbbreviation>J</ISOAbbreviation><JournalIssue><PubDate><Year>2020</Year><Month>Jan</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>b</i> c</ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText></Abstract>
<AuthorList><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>L</LastName><Initials>I</Initials></Author><Author><ForeName>No</ForeName></Author></AuthorList>
<PublicationTypeList><PublicationType>Review</PublicationType><PublicationType> </PublicationType><PublicationType>Letter</PublicationType></PublicationTypeList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">own</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">cited</ArticleId><ArticleId IdType="pmc">P</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
<PubmedArticle><PMID/></PubmedArticle>
<PubmedArticle><PMID>8</PMID><Journal><Title>T</Title><JournalIssue><PubDate><MedlineDate>2020 Jan-Feb</MedlineDate><Year>1</Year></PubDate></JournalIssue></Journal></PubmedArticle></PubmedArticleSet>"""


def test_article_xml(spark, got):
    one, two = article_xml.parse_articles(XML)
    assert list(one.values()) == ["7", "", "own", "J", "Review; Letter", "2020-Jan", "Group; L I", "A b c", "AIM: x y"]
    assert (two["PMID"], two["Journal"], two["Date"], two["Abstract"]) == ("8", "T", "2020 Jan-Feb", "")
    assert article_xml.parse_articles(XML, nested_ids=True)[0]["DOI"] == "cited" and article_xml.parse_articles("<a>") == []
    documents = spark.createDataFrame([(XML,), ("<broken",), (None,)], "value string")
    assert got(article_xml.articles(documents), "PMID") == [("7",), ("8",)]


def day_counts(query):
    """A service with 3 records a day, and 40 on the 5th, by record number."""
    import re

    low, high = (date(*map(int, d.split("/"))) for d in re.findall(r'"([\d/]+)"\[PDAT', query))
    ids = re.search(r"\((\d+):(\d+)\[UID", query)
    total = 0
    for d in range(low.toordinal(), high.toordinal() + 1):
        n = 40 if date.fromordinal(d).day == 5 else 3
        total += sum(int(ids[1]) <= i <= int(ids[2]) for i in range(1, n + 1)) if ids else n
    return total


class Service:
    def count(self, query):
        return day_counts(query)

    def fetch(self, query, start, size):
        n = day_counts(query)
        return "<S>" + "".join(f"<PubmedArticle><PMID>{abs(hash(query)) % 10**9}-{i}</PMID></PubmedArticle>" for i in range(start, min(n, start + size))) + "</S>"


def test_leaves_cover_the_range_once():
    leaves = harvest.plan(day_counts, "immune", date(2020, 1, 1), date(2020, 1, 9), leaf=10, ids=(1, 64))
    assert all(0 < x.size <= 10 for x in leaves) and sum(x.size for x in leaves) == 8 * 3 + 40 and len({x.query for x in leaves}) == len(leaves)
    assert harvest.plan(lambda q: 0, "t", date(2020, 1, 1), date(2020, 1, 2)) == []
    stuck = harvest.plan(lambda q: 99, "t", date(2020, 1, 1), date(2020, 1, 1), leaf=10, ids=(1, 2))
    assert [x.size for x in stuck] == [99, 99]


def test_harvest_source(spark, monkeypatch):
    monkeypatch.setenv("PYTHONHASHSEED", "0")
    harvest.register(spark, Service(), "fake_literature")
    df = spark.read.format("fake_literature").options(term="immune", leaf="10", page="4", pause="0", highId="64").option("from", "2020-01-01").option("to", "2020-01-09").load()
    assert df.count() == 8 * 3 + 40 and df.columns[0] == "PMID"


def test_patience():
    waits, answers = [], iter([OSError(), OSError(), 5])

    def ask():
        x = next(answers)
        if isinstance(x, OSError):
            raise x
        return x

    assert harvest.patient(ask, sleep=waits.append) == 5 and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        harvest.patient(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)
    assert harvest.credentials({"email": "a@b", "api_key": " k "}) == ("a@b", "k")
    with pytest.raises(ValueError):
        harvest.credentials({"email": "a@b", "api_key": " "})


def test_writers(spark, tmp_path, got):
    df = spark.createDataFrame([(i, None if i else "ü") for i in range(7)], "a int, b string")
    sinks.write_records(df.coalesce(1), str(tmp_path / "r"), per_file=3)
    parts = sorted((tmp_path / "r").glob("*.json"))
    assert len(parts) == 3 and parts[0].read_text().splitlines()[0] == '{"a":0,"b":"ü"}'
    sinks.append_records(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 14
    raw = spark.createDataFrame([(f" {GOOD} ", True), ("x", None)], "raw string, f boolean")
    sinks.write_split(raw, F.col("f"), str(tmp_path / "y"), str(tmp_path / "n"))
    assert got(spark.read.text(str(tmp_path / "y"))) == [(GOOD,)] and got(spark.read.text(str(tmp_path / "n"))) == [("x",)]
    table = spark.createDataFrame([('a"b', 1)], "relation string, count long")
    sinks.write_table(table.coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text() == 'relation,count\n"a""b",1\n'
    sinks.write_list(spark.createDataFrame([("b",), ("a",)], "k string"), str(tmp_path / "l"), F.col("k"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    assert sinks.export_rows(df, str(tmp_path / "e.json")) == 7 and json.load(open(tmp_path / "e.json"))[0]["b"] == "ü"
    assert sinks.export_report(table.limit(0), str(tmp_path / "t.tsv")) == 0 and open(tmp_path / "t.tsv").read() == "\n"
    assert sinks.export_report(table, str(tmp_path / "t2.tsv")) == 1 and open(tmp_path / "t2.tsv").read() == 'relation\tcount\n"a""b"\t1\n'
    with pytest.raises(ValueError):
        sinks.export_rows(df, str(tmp_path / "x"), most=3)
    assert not sinks.export_chart(spark.createDataFrame([], "value string, count long, first long"), str(tmp_path / "c.pdf"), "t")


def test_a_chart_leaves_no_value_out(spark, tmp_path):
    counts = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], "value string, count long, first long")
    with pytest.raises(ValueError, match="more than 2 values"):
        sinks.export_chart(counts, str(tmp_path / "c.png"), "t", most=2)
