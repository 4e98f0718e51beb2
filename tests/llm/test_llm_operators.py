import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgraph.functions.text import pmid_number
from corpusgraph.llm import canonical, contamination, history, language, near_duplicates, packing, shingles, stable_sample, term_frequency, truncation

def extra():
    """A column whose name an operator might use itself."""
    return F.lit("clash")


# Term frequencies


def test_terms_by_bitmaps(spark, got):
    data = [("1", "a", "x"), ("1", " a\xa0", None), (" 1", "A", "​a"), (None, "a", ""), ("2", "  ", "x"), ("", "b", "x")]
    df = spark.createDataFrame(data, "pmid string, h string, t string").withColumn("kind", extra()).withColumn("term", extra()).withColumn("n", extra())
    found = term_frequency.term_frequencies(df, "pmid", {"h": "e", "t": "e"}, rare_below=2, common_above=0.9)
    assert got(found, "term", "occurrences", "records", "mark") == sorted([("a", 3, 1, "rare"), ("A", 1, 1, "rare"), ("​a", 1, 1, "rare"), ("b", 1, 0, "rare"), ("x", 3, 2, "common")], key=repr)
    assert term_frequency.term_frequencies(df.limit(0), "pmid", {"h": "e"}).count() == 0
    by_batch = term_frequency.term_frequencies(df, "pmid", {"h": "e", "t": "e"}, 2, 0.9, batch=F.coalesce("pmid", F.lit("")))
    assert got(by_batch) == got(found)


def test_dense_containers_and_union(spark, got):
    rows = spark.range(6000).select(F.col("id").cast("string").alias("r"), F.lit("all").alias("t"), F.when(F.col("id") % 7 == 0, "some").alias("u"))
    numbers = term_frequency.number_records(rows.select(F.col("r").alias("record")), buckets=2)
    assert numbers.select("container", "position").distinct().count() == 6000
    parts = [term_frequency.layout(term_frequency.occurrences(rows.where(c), "r", {"t": "k", "u": "k"}), numbers) for c in ("r < 4000", "r >= 3000")]
    assert parts[0].where("bitmap is not null").count() > 0 and parts[0].where("bitmap is not null and list is not null").count() == 0
    both = term_frequency.union(parts)
    assert got(term_frequency.frequencies(both), "term", "occurrences", "records") == [("all", 7000, 6000), ("some", sum(i % 7 == 0 for i in range(4000)) + sum(i % 7 == 0 for i in range(3000, 6000)), 858)]


# Canonical values


TERMS = [("gene", "a locus; also locus"), ("cell_type", "a population; also leukocyte_subset"), ("RNA", None), ("inhibits", "holds back; also suppresses, blocks")]
MEANT = {
    "Gene": "gene", "genes": "gene", "LOCUS": "gene", "cell  type": "cell_type", "cellType": "cell_type", "type_of_cell": "cell_type", "celtype": "cell_type", "ｇｅｎｅ": "gene", "gene​": "gene",
    "`gene`": "gene", "type=gene": "gene", "gene (inferred)": "gene", "R.N.A.": "RNA", "blocked": "inhibits", "inhbits": "inhibits", "leukocyte subset": "cell_type",
    "does_not_inhibit": "unmatched", "not_inhibits": "unmatched", "???": "unmatched", "12": "unmatched", "n/a": "unmatched", "price": "unmatched", "type": "unmatched", "x" * 5000: "unmatched",
}


def test_values_find_their_terms(spark, got):
    vocabulary = spark.createDataFrame([("k", t, n) for t, n in TERMS], "kind string, term string, note string")
    data = [(i, v) for i, v in enumerate([*MEANT, "gene", None, " ", "Gene"])]
    df = spark.createDataFrame(data, "id int, c string").withColumn("kind", extra()).withColumn("value", extra())
    found = {r.id: r.term for r in canonical.canonical_rows(df, "id", vocabulary, {"c": "k"}).collect()}
    assert found == {i: MEANT[v] for i, v in data if v in MEANT}
    assert canonical.canonical_rows(df.limit(0), "id", vocabulary, {"c": "k"}).count() == 0
    assert {r.term for r in canonical.canonical_rows(df, "id", vocabulary.limit(0), {"c": "k"}).collect()} == {"unmatched"}


def test_slips_and_cosines():
    index = canonical.Index(canonical.spellings([("cell_type", "x; also leukocyte_subset"), ("protein", None), ("RNA", None)]))
    assert canonical.slips("abcd") == sorted({"bcd", "acd", "abd", "abc", "aabcd", "abbcd", "abccd", "abcdd", "bacd", "acbd", "abdc"}) and canonical.slips("rna") == []
    at = index.terms.index("protein")
    assert index.scores("protein")[at] > 0.999 and index.scores("protien")[at] > 0.999 and 0 < index.scores("protiens")[at] < 0.999 and index.scores("xyz").max() == 0
    matcher = canonical.Matcher(index)
    assert 0.1 < matcher.threshold < 0.9
    # Held-out misspellings: one letter changed, which no form of the index has.
    found = [matcher.match(w[:i] + "x" + w[i + 1 :])[0] == t for w, t in (("cell_type", "cell_type"), ("protein", "protein"), ("leukocyte_subset", "cell_type")) for i in range(1, len(w) - 1) if w[i] != "_"]
    assert sum(found) >= 0.75 * len(found)
    assert matcher.match("price") == (canonical.UNMATCHED, matcher.match("price")[1]) and matcher.match("not_protein")[0] == canonical.UNMATCHED


# Samples


def test_sample_keeps_members(spark):
    some = spark.range(4000).select(F.col("id").cast("string").alias("pmid")).withColumn("bucket", extra()).withColumn("key", extra())
    more = some.unionByName(spark.createDataFrame([("PMID: 00017",), (None,), (" ",), ("5000",)], "pmid string").withColumn("bucket", extra()).withColumn("key", extra())).repartition(7)
    key = pmid_number("pmid")

    def taken(df, share, seed="0"):
        return {r.key for r in stable_sample.sample(df, key, share, seed).collect()}

    small = taken(some, 0.1)
    assert small <= taken(more, 0.1) <= taken(more, 0.2) and 250 < len(small) < 550
    assert taken(some, 0) == set() and taken(some, 1) == set(range(4000)) and taken(some, 0.1, "1") != small
    n = stable_sample.buckets_for(some, key, 300)
    first = {r.key for r in stable_sample.sample_of_buckets(some, key, n).collect()}
    later = stable_sample.buckets_for(more, key, 200, at_least=n)
    assert 300 <= len(first) <= 320 and later == n and first <= {r.key for r in stable_sample.sample_of_buckets(more, key, later).collect()}
    assert stable_sample.buckets_for(some.limit(0), key, 5) == stable_sample.BUCKETS and taken(some.limit(0), 0.5) == set()
    with pytest.raises(ValueError):
        stable_sample.sample(some, key, 1.5)


# Near duplicates and history


def bag(text, n):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def likeness(a, b, n):
    x, y = bag(a, n), bag(b, n)
    return len(x & y) / len(x | y)


def corpus(seed=1, size=60):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(900)]
    out = []
    for i in range(size):
        if out and i % 3:
            words = (rng.choice(out[-6:]) or "").split()
            for _ in range(rng.randrange(4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(lexicon)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choices(lexicon, k=rng.choice([1, 2, 5, 40, 90]))))
    return [*out, None, "", "  ", out[3].upper() + "!", out[3], "été É", "ÉTÉ é", "x" * 30_000]


@pytest.mark.parametrize(("length", "threshold"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_are_those_of_brute_force(spark, got, length, threshold):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", extra()).withColumn("same", extra()).repartition(5)
    found, members = near_duplicates.near_duplicates(df, "id", F.col("text"), length, threshold)
    pairs = set(got(near_duplicates.expanded(found, members)))
    assert pairs == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if likeness(texts[i], texts[j], length) >= threshold}
    parents = list(range(len(texts)))

    def root(i):
        while parents[i] != i:
            i = parents[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parents[b] = a
    grouped = near_duplicates.grouped(df, "id", F.col("text"), length, threshold)
    assert dict(got(grouped, "key", "group")) == {i: root(i) for i in range(len(texts))}
    assert near_duplicates.grouped(df.limit(0), "id", F.col("text")).count() == 0


def test_no_link_of_a_large_family_is_missed(spark, got):
    """A third of the rows rework one text, each place in one of two ways, so that no shingle of the family is rare."""
    rng = random.Random(5)
    family = [" ".join(f"w{j}{'x' if rng.random() < 0.12 else ''}" for j in range(60)) for _ in range(240)]
    texts = family + [" ".join(rng.choices([f"v{j}" for j in range(400)], k=20)) for _ in range(480)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bags = [bag(t, 3) for t in texts]
    want = {(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if 2 * len(bags[i] & bags[j]) >= len(bags[i] | bags[j])}
    found, members = near_duplicates.near_duplicates(df, "id", F.col("text"), 3, 0.5)
    assert set(got(near_duplicates.expanded(found, members))) == want and len(want) > 500


def test_many_copies_make_one_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "one text that fills half of all rows").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" words here"))).alias("t"))
    found, members = near_duplicates.near_duplicates(df, "id", F.col("t"))
    assert found.count() == 0 and members.where("class = 0").count() == 1500 and members.where("copies = 1500").count() == 1500


def shuffled(spark):
    """Bytes that tasks of this session have written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_near_duplicates_move_only_rarest_shingles(spark, got, monkeypatch):
    """Per text of 160 shingles hardly more than four bytes of each move, however many passes the pairs take."""
    monkeypatch.setattr(near_duplicates.anchors, "SAMPLE", 100)
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(60)], k=160)) for _ in range(3000)]
    texts += [t.replace("w1 ", "w99 ") for t in texts[:100]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    df = df.localCheckpoint()
    before = shuffled(spark)
    found, members = near_duplicates.near_duplicates(df, "id", F.col("text"), 3, 0.5)
    pairs = got(near_duplicates.expanded(found, members))
    assert {(i, 3000 + i) for i in range(100)} == set(pairs) and shuffled(spark) - before < 2500 * len(texts)
    monkeypatch.setattr(near_duplicates.anchors, "PASS_BYTES", 2000)
    monkeypatch.setattr(near_duplicates.anchors, "PASS_SHARE", 0)
    found, members = near_duplicates.near_duplicates(df.where("id % 3000 < 100"), "id", F.col("text"), 3, 0.5)
    assert got(near_duplicates.expanded(found, members)) == pairs


def test_anchors_of_long_texts_and_common_tokens():
    """Sets of over 65,535 tokens, and pairs whose keys or tokens agree by chance in 32 bits, lose nothing."""
    n = np.array([70_000, 69_999])
    need = near_duplicates.anchors.needed(n, 0.5)
    token, h = np.repeat(np.arange(need[0], dtype=np.uint32), 2), np.tile(np.array([7, 7], np.uint32), need[0])
    parts = list(near_duplicates.anchors.met(token, h, np.tile(n, need[0]), np.repeat(np.arange(need[0]), 2), 0.5, 0, near_duplicates.anchors.SHARES))
    ids, sums = near_duplicates.anchors._summed([p[0] for p in parts], [p[1] for p in parts])
    assert ids.tolist() == [(7 << 32) | 7] and sums.tolist() == [near_duplicates.anchors.WHOLE]


@pytest.mark.parametrize("cuts", [[], ["b2"], ["b1", "b2", "b3"]])
def test_history_finds_what_all_batches_at_once_hold(spark, got, cuts):
    texts = corpus(2, 48)
    data = [(i, f"b{i % 4}", t, None if i % 5 else f"PMID:00{i % 10}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "id long, b string, t string, p string").withColumn("key", extra()).withColumn("number", extra())
    found = history.replay(df, "id", "b", F.col("t"), pmid_number("p"), cuts, 3, 0.5)

    def number(p):
        return p and int(p[5:])

    want = {(b, i) for i, b, t, p in data for j, c, u, q in data if c < b and (likeness(t, u, 3) >= 0.5 or (p and number(p) == number(q)))}
    assert set(got(found, "batch", "key")) == want and found.count() == len(want)


def test_history_is_taken_up_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "one two three four"), (2, "b", "one two three four five"), (3, "b", "none of these words")], "id long, b string, t string")
    add = lambda h, where: h.add(df.where(where), "id", "b", F.col("t"), F.lit(None).cast("bigint"))
    path = f"file://{tmp_path}/index"
    add(history.History(spark, path, 3, 0.5), "b = 'a'")
    again = history.History(spark, path, 3, 0.5)
    assert again.steps == 1 and [tuple(r) for r in add(again, "b = 'b'").collect()] == [("b", 2, "alike")]
    assert add(again, "b = 'c'").count() == 0 and again.found().count() == 1 and history.History(spark, path, 3, 0.5).steps == 3


def test_history_keeps_no_token_sets(spark, tmp_path):
    """The index takes less than the eight bytes of each of the 160 shingles of its texts, and a step leaves nothing else."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(60)], k=162)) for _ in range(2000)]
    df = spark.createDataFrame([(i, "a" if i < 1990 else "b", t) for i, t in enumerate([*texts[:1990], *texts[:10]])], "id long, b string, t string")
    index = history.History(spark, f"file://{tmp_path}/index", 3, 0.5, buckets=4)
    found = [index.add(df.where(F.col("b") == b), "id", "b", F.col("t"), F.lit(None).cast("bigint")) for b in "ab"]
    assert [f.count() for f in found] == [0, 10] and not {"incoming", "near", "first", "pairs"} & {p.name for p in (tmp_path / "index").iterdir()}
    assert sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet")) < 160 * 8 * len(texts)


def test_history_keeps_pairs_exactly_at_the_threshold(spark, got):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, "a", text(35)), (2, "b", text(28))], "id long, b string, t string")
    found = history.replay(df, "id", "b", F.col("t"), F.lit(None).cast("bigint"), ["b"], 1, 0.8)
    assert got(found) == [("b", 2, "alike")]


def test_shingles(spark):
    df = spark.createDataFrame([("A-b, C d",), ("a",), (None,)], "t string")
    sizes = [r[0] for r in df.select(F.size(shingles.shingles(shingles.words(F.col("t")), 3))).collect()]
    assert sizes == [2, 1, 1]


# Languages

SENTENCES = {
    "en": ["The cells of the patients were measured with great care in this study.", "We asked whether the treatment reduces the number of the cells.", "No difference between the groups was found after three weeks."],
    "de": ["Die Zellen der Patienten wurden in dieser Studie sorgfältig gemessen.", "Wir fragten, ob die Behandlung die Zahl der Zellen senkt.", "Zwischen den Gruppen zeigte sich nach drei Wochen kein Unterschied."],
    "fr": ["Les cellules des patients ont été mesurées avec soin dans cette étude.", "Nous avons demandé si le traitement réduit le nombre des cellules.", "Aucune différence entre les groupes n'a été trouvée après trois semaines."],
    "es": ["Las células de los pacientes se midieron con cuidado en este estudio.", "Preguntamos si el tratamiento reduce el número de las células.", "No se encontró ninguna diferencia entre los grupos después de tres semanas."],
    "pt": ["As células dos pacientes foram medidas com cuidado neste estudo.", "Perguntamos se o tratamento reduz o número das células.", "Não foi encontrada nenhuma diferença entre os grupos depois de três semanas."],
    "it": ["Le cellule dei pazienti sono state misurate con cura in questo studio.", "Abbiamo chiesto se il trattamento riduce il numero delle cellule.", "Non è stata trovata alcuna differenza tra i gruppi dopo tre settimane."],
    "zh": ["本研究仔细测量了患者的细胞。", "我们询问治疗是否减少了细胞的数量。", "三周后各组之间没有发现差异。"],
}


@pytest.fixture(scope="module")
def model(spark, tables):
    articles = spark.read.parquet(tables.replace("sf0.001", "sf0.01") + "/articles.parquet")
    return language.train(articles, "rec_id", ["title", "abstract"], "lang")


def test_held_out_sentences(model):
    texts, want = zip(*[(s, language.LANGUAGES.index(c)) for c, some in SENTENCES.items() for s in some], strict=True)
    p = model.probabilities(list(texts))
    assert np.mean(p.argmax(1) == np.array(want)) >= 0.85
    assert model.judge(["12 %", "abc", ""])[0].tolist() == [-1, -1, -1]


def test_wrong_and_missing_labels(spark, tables, model, got):
    articles = spark.read.parquet(tables.replace("sf0.001", "sf0.01") + "/articles.parquet")
    pure = [r for r in articles.where("lang in ('en', 'de', 'fr') and length(abstract) > 600").orderBy("rec_id").limit(200).collect()]
    taken = {c: next(r.abstract for r in pure if r.lang == c and model.judge([r.abstract])[0][0] == language.LANGUAGES.index(c)) for c in ("en", "de")}
    data = [
        (1, "eng", None, taken["en"]), (2, " EN-us", None, taken["de"]), (3, None, " ", taken["de"]), (4, "und", None, taken["en"]),
        (5, "ja", None, taken["en"]), (6, "en", None, taken["en"] + " " + taken["de"]), (7, None, None, None), (8, "de", "", ""), (9, None, "x", "No abstract available."),
    ]
    df = spark.createDataFrame(data, "id int, lang string, title string, abstract string").withColumn("key", extra()).withColumn("share", extra())
    found = got(language.mislabelled(df, "id", ["title", "abstract"], "lang", model), "key", "lang", "problem")
    assert {x for x in found if x[0] != 6} == {(2, "de", "wrong"), (3, "de", "missing"), (4, "en", "missing"), (5, "en", "missing")}
    assert {(2, "de"), (6, "de"), (6, "en")} <= {x[:2] for x in found}
    assert language.mislabelled(df.limit(0), "id", ["title", "abstract"], "lang", model).count() == 0
    stretches = language.segments(df.where("id = 6"), "id", ["title", "abstract"], model).collect()
    assert {s.lang for s in stretches} == {"en", "de"} and all(0.5 <= s.confidence <= 1 for s in stretches)


def test_no_labels_no_languages(spark):
    df = spark.createDataFrame([(1, None, "The cells of the patients were measured.")], "id int, lang string, t string")
    model = language.train(df, "id", ["t"], "lang")
    assert language.segments(df, "id", ["t"], model).count() == 0


def test_sentences_and_labels():
    assert [s for _, s in language.sentences("METHODS: One two. Three four.Five six\nSeven")] == ["One two.", "Three four.", "Five six", "Seven"]
    assert [s for _, s in language.sentences("背景: 一二三。四五。")] == ["一二三。", "四五。"] and language.sentences(None) == []


# Containers


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=60))
def test_no_limit_is_exceeded(items):
    demands = np.array([(t, 1, min(t, x)) for t, x in items], np.int64).reshape(-1, 3)
    container, position = packing.fill(demands, np.array([50, 7, 40])) if len(demands) and demands[:, 2].max(initial=0) <= 40 else (np.zeros(0), np.zeros(0))
    for c in set(container.tolist()):
        inside = container == c
        assert (demands[inside].sum(0) <= [50, 7, 40]).all() and sorted(position[inside]) == list(range(inside.sum()))


def test_packing(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 5, 90, 400, 1000, 2048, 2049, 7000]) for _ in range(600)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "key int, tokens long").withColumn("container", extra()).withColumn("piece", extra())
    found = packing.pack(df, per_group=150).toPandas()
    assert set(found.key) == set(range(601)) and not found[["key", "piece"]].duplicated().any()
    assert (found.groupby("key").tokens.sum() == [s or 0 for s in sizes]).all()
    whole = found.groupby("container").tokens.sum()
    assert whole.max() <= 2048 and set(whole.index) == set(range(len(whole))) and len(whole) <= 1.03 * whole.sum() / 2048 + 2
    assert (found.groupby("key").piece.count() == [max(1, -(-(s or 0) // 2048)) for s in sizes]).all()
    assert all(sorted(p) == list(range(len(p))) for _, p in found.groupby("container").position)
    again = packing.pack(df.repartition(6), per_group=150).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, found.to_numpy().tolist()))
    assert packing.pack(df.limit(0)).count() == 0


def test_limits_on_segments_and_loss_bind(spark):
    rows = [(i, 10, 10 if i % 3 else 0) for i in range(400)] + [(1000 + i, 300, 290) for i in range(40)]
    packed = packing.pack(spark.createDataFrame(rows, "key int, tokens long, loss long"), 1000, 12, 800).join(spark.createDataFrame(rows, "key int, t long, loss long"), "key")
    filled = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss").alias("l")).collect()
    assert sum(r.n for r in filled) == 440 and all(r.t <= 1000 and r.n <= 12 and r.l <= 800 for r in filled)
    assert max(r.n for r in filled) == 12 and max(r.l for r in filled) > 600 and len(filled) <= -(-440 // 12) * 1.15


def test_loss_of_markup_and_copies(spark, got):
    rows = [(1, "a <b>bold</b> word"), (2, "a bold word"), (3, "a bold word"), (4, None), (5, None)]
    found = {r.key: (r.tokens, r.loss) for r in packing.token_counts(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert found[1][0] > found[1][1] > 0 and found[2] == (3, 3) and found[3] == (3, 0) and found[4] == found[5] == (0, 0)


def test_tokens_round_trip(spark):
    encoding = packing.tokenizer(packing.RANKS)
    text = "Cells’ été 中文 <|endoftext|>\n\n"
    assert encoding.decode(encoding.encode_ordinary(text)) == text
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "word " * 30_000)], "id int, text string")
    counts = {r.key: r.tokens for r in packing.token_counts(df, "id", "text").collect()}
    assert counts[1] == len(encoding.encode_ordinary(text)) and counts[2] == counts[3] == 0 and counts[4] > 29_000


# Held-out items


def test_only_places_without_other_words_are_looked_up(monkeypatch):
    items = contamination.load_items([(7, " ".join(f"w{i}" for i in range(20)), None)])
    lookup = contamination.Lookup(items, contamination.RUN)
    hashed = []
    monkeypatch.setattr(contamination, "_hashes", lambda rows, real=contamination._hashes: hashed.append(len(rows)) or real(rows))
    ids = [np.array([*[-1] * 50, *range(3, 15), -1, *range(11), *[-1] * 50], np.int32), np.array([*range(11), -1], np.int32), np.arange(20, dtype=np.int32)]
    assert lookup.found([i.tobytes() for i in ids]) == {(0, 7), (2, 7)} and sum(hashed) == 1 + 9


def test_leaks(spark, got):
    names = [f"zanqu{chr(97 + i)}telin" for i in range(12)]
    passage = f"Serum {names[0]} rose when {names[1]} was given to the mice and the level of {names[2]} fell by half in all the {names[3]} cells that were left."
    words = passage.split()
    changed = " ".join(w if i not in (2, 9) else "other" for i, w in enumerate(words[:16]))
    filler = "the level of this was given to the mice and rose in all cells that were left by half "
    texts = {
        1: filler + passage + filler, 2: "<p>" + passage.upper().replace(" ", "\n") + "</p>", 3: filler + " ".join(words[4:17]) + " " + filler, 4: filler + " ".join(words[4:13]) + " end",
        5: changed, 6: passage.replace(names[0], names[5]).replace(names[1], names[6]).replace(names[2], names[7]).replace(names[3], names[8]), 7: None, 8: "", 9: filler * 400, 10: filler * 300 + passage,
        11: passage.replace("e", "&#101;"), 12: passage,
    }
    rows = [(i, t) for i, t in texts.items()] + [(100 + i, filler + f"number {i}") for i in range(1200)]
    documents = spark.createDataFrame(rows, "id long, text string").withColumn("key", extra()).withColumn("ids", extra())
    items = spark.createDataFrame([(7, passage, None), (8, "short one", "What is it?"), (9, None, None)], "item long, p string, q string")
    found = contamination.leaks(documents, "id", "text", items, "item", ["p", "q"])
    assert got(found) == [(1, 7), (2, 7), (3, 7), (10, 7), (11, 7), (12, 7), (5, 7)] or set(got(found)) == {(i, 7) for i in (1, 2, 3, 5, 10, 11, 12)}
    assert got(contamination.reported(found, items, "item")) == [(7, 7), (8, 0), (9, 0)]
    assert contamination.leaks(documents.limit(0), "id", "text", items, "item", ["p", "q"]).count() == 0
    assert contamination.leaks(documents, "id", "text", items.limit(0), "item", ["p", "q"]).count() == 0
    assert set(got(contamination.leaks(documents, "id", "text", items, "item", ["p", "q"], at_once=1))) == set(got(found))


def test_leaks_of_a_third_of_all_rows(spark, got):
    """A passage that leaked into a third of the rows, as it is and reworked, and one without any telling word."""
    names = [f"zanqu{chr(97 + i)}telin" for i in range(12)]
    common = "the level of this was given to the mice and rose in all cells that were left by half"
    passage = f"Serum {names[0]} rose when {names[1]} was given to the mice and the level of {names[2]} fell by half in all the {names[3]} cells that were left."
    other = f"After a week {names[0]} was seen again and {names[1]} was lost in most of the mice."
    own = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    changed = passage.split()
    changed[2] = changed[9] = "other"
    lost = other.split()
    lost[4] = "found"
    texts = [f"{own[i]} {passage if i % 3 else ' '.join(changed)} {own[i]}" for i in range(200)] + [f"{own[i]} {common} {own[i]} again" for i in range(200, 600)]
    texts += [" ".join(lost), other, common + " " + common, passage.replace(names[0], names[5]).replace(names[1], names[6]).replace(names[2], names[7]).replace(names[3], names[8])]
    documents = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    items = spark.createDataFrame([(1, passage), (2, other), (3, common)], "item long, p string")
    found = contamination.leaks(documents, "id", "text", items, "item", ["p"])
    want = {(i, 1) for i in range(200)} | {(i, 3) for i in range(200, 600)} | {(600, 2), (601, 2), (602, 3)}
    assert set(got(found)) == want and found.count() == len(want)
    few = documents.where("id in (0, 1, 2, 600, 601) or id between 200 and 280")
    assert set(got(contamination.leaks(few, "id", "text", items, "item", ["p"]))) == {x for x in want if x[0] in (0, 1, 2, 600, 601) or 200 <= x[0] <= 280}


def test_answers_of_paraphrases_agree(spark, got):
    """A common word that the answer names must not be changed in a paraphrase."""
    passage = "serumlevel zanquatelin fell in mice given water with brandolex food every day then"
    changed = passage.replace("fell", "rose")
    rng, filler = random.Random(8), "in the end the level fell rose in mice that were given water every day together "
    rows = [(1, passage), (2, changed), *[(10 + i, filler + " ".join(rng.choices(filler.split(), k=20))) for i in range(300)]]
    documents = spark.createDataFrame(rows, "id long, text string")
    items = spark.createDataFrame([(7, passage, "It has fallen, serumlevel falls"), (8, passage, "water stayed every where")], "item long, p string, a string")
    assert (2, 7) in got(contamination.leaks(documents, "id", "text", items, "item", ["p"], "a"))
    other = documents.withColumn("text", F.when(F.col("id") == 2, F.replace("text", F.lit("water"), F.lit("bread"))).otherwise(F.col("text")))
    assert set(got(contamination.leaks(other, "id", "text", items, "item", ["p"], "a"))) == {(1, 7), (1, 8), (2, 7)}


def test_latent_space_finds_what_a_random_one_loses(spark):
    rng = random.Random(3)
    names = [f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    passages = [" ".join(rng.choice(names if j % 3 == 0 else ["the", "level", "of", "cells", "rose", "in", "mice"]) for j in range(24)) for _ in range(50)]
    rows = [(i, p, None) for i, p in enumerate(passages)]
    items = contamination.load_items(rows)
    idf = np.array([6.0 if w.startswith("name") else 0.3 for w in items.vocabulary])
    table = spark.createDataFrame([(i, p) for i, p, _ in rows], "item long, p string")
    space = contamination.latent_space(table, ["p"], items.vocabulary, idf, 96)
    other = np.linalg.qr(np.random.default_rng(1).normal(size=space.shape))[0].astype(np.float32)
    windows = np.concatenate([items.runs, np.full((len(items.runs), contamination.WINDOW - contamination.RUN), -1, np.int32)], 1)[::5].copy()
    windows[:, 4] = -1  # one word in twelve is changed
    recall = {}
    for name, basis in (("latent", space), ("random", other)):
        searcher = contamination.Searcher(items, idf.astype(np.float32), basis, np.zeros(len(idf), bool), 0.35, 0.2)
        w, q = searcher.candidates(windows)
        hit = {i for i, j in zip(w, q, strict=True) if abs(int(searcher.picked[j]) - 5 * i) < contamination.ITEM_STEP}
        recall[name] = len(hit) / len(windows)
        # The cells lose next to nothing against brute force.
        latent = searcher._latent(windows)
        every = int((latent @ searcher.queries.T >= 0.35).sum())
        assert len(w) >= 0.9 * every
    assert recall["latent"] >= 0.9 and recall["random"] <= 0.6


def test_common_subsequences():
    runs = np.array([[1, 2, 3, 4]] * 3)
    texts = np.array([[9, 1, 2, 9, 3, 4], [4, 3, 2, 1, 9, 9], [1, 9, 9, 2, 9, 4]])
    assert contamination._common(runs, texts).tolist() == [4, 1, 3]


def test_changes_are_edit_distances():
    runs = np.array([[1, 2, 3, 4]] * 4)
    texts = np.array([[9, 1, 2, 3, 4, 9], [1, 2, 9, 3, 4, 9], [1, 3, 4, 9, 9, 9], [1, 9, 9, 9, 9, 9]])
    assert contamination._changes(runs, texts).tolist() == [0, 1, 1, 3]


# Cut texts


def ends_of_texts():
    """(key, text, source, kind): texts of a source with a limit, whole ones, broken ones and ones with regular closers."""
    rng = random.Random(4)
    words = "cells genes mice level serum rose fell after before given small large tissue found healthy groups measured during weeks under".split()

    def sentences(n):
        made = (" ".join(rng.choices(words, k=rng.randrange(5, 14))) for _ in range(n))
        return " ".join(s.capitalize() + "." for s in made)

    closers = ["See the list. [12]", "It rose. (n = 4)", "It rose. doi:10.1/x.3", "It rose. — the editors", "It rose.\nKeywords: cells, genes, mice", "It rose. Scale bar, 20 µm"]
    rows = [(f"limit{i}", sentences(9)[:150], "limited", "note") for i in range(60)]
    rows += [(f"whole{i}", sentences(rng.randrange(1, 9)), "limited" if i % 2 else "free", "note") for i in range(200)]
    rows += [(f"closer{i}", f"{sentences(2)} {closers[i % len(closers)]}", "free", "note") for i in range(90)]
    rows += [(f"title{i}", " ".join(rng.choices(words, k=8)).capitalize(), "free", "title") for i in range(40)]
    rows += [(f"broken{i}", sentences(rng.randrange(3, 9))[: -rng.randrange(9, 30)].rstrip(". "), "free", "note") for i in range(30)]
    rows += [("sign1", "It was seen that…", "free", "note"), ("sign2", sentences(2) + " It was (more)", "free", "note"), ("long", sentences(4000) + " And th", "free", "note")]
    return rows


def test_cut_texts(spark, got):
    rows = ends_of_texts() + [("null", None, "free", "note"), ("blank", " ", None, None), ("zh", "他们上升了。", "free", None), ("quote", 'He said "yes."', "free", "note"), ("tag", "It rose.</p>\n", "free", "note")]
    copy = next(r for r in rows if r[0] == "broken3")
    df = spark.createDataFrame([*rows, ("brokencopy", *copy[1:])], "id string, text string, source string, kind string").withColumn("chars", extra()).withColumn("tail", extra())
    found = {r.id: (r.reason, r.sign) for r in truncation.truncated(df, "id", "text", "source", "kind").collect()}
    limited = {r[0] for r in rows if r[0].startswith("limit") and not r[1].rstrip().endswith(".")}
    broken = {r[0] for r in rows if r[0].startswith("broken")} | {"brokencopy", "long"}
    assert {k for k, v in found.items() if v[0] == "limit"} == limited and found["sign1"] == found["sign2"] == ("transfer", True)
    taken = {k for k, v in found.items() if v == ("transfer", False)}
    assert len(taken & broken) >= 0.9 * len(broken) and len(taken - broken) <= 0.1 * len(taken)
    # Without the spikes there is neither a limit nor anything to learn from.
    nothing = truncation.length_spikes(df.limit(0), "text", "source")
    assert set(got(truncation.truncated(df, "id", "text", "source", "kind", limits=nothing), "id")) == {("sign1",), ("sign2",)}
    shares = {r.source: (r.texts, r.by_limit) for r in truncation.source_shares(df, truncation.truncated(df, "id", "text", "source", "kind"), "text", "source").collect()}
    assert shares["limited"] == (160, len(limited)) and shares["free"][1] == 0
    assert truncation.truncated(df.limit(0), "id", "text", "source", "kind").count() == 0


def test_spikes_in_lengths(spark):
    limited = [(f"c{i}", f"Text {i} of this source {'goes on and on ' * 9}"[:100], "limited") for i in range(30)]
    free = [(f"f{i}", f"Number {'i' * (i * 7 % 41)} {i} is here.", "limited" if i % 2 else "free") for i in range(80)]
    spikes = truncation.length_spikes(spark.createDataFrame([*limited, *free], "id string, text string, source string"), "text", "source")
    assert {(r.source, r.measure, r.size) for r in spikes.collect()} == {("limited", "chars", 100), ("limited", "bytes", 100)}
    copies = spark.createDataFrame([(i, "the same text for all", "s") for i in range(50)], "id int, text string, source string")
    assert truncation.length_spikes(copies, "text", "source").count() == 0
