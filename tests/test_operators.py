import itertools
import random

import pytest
from pyspark.sql import functions as F

from litmill.functions import keys, labels, people
from litmill.operators import filters, graph, lift, merge, ranking
from litmill.operators.components import connected_components
from litmill.plans import stages


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_keys(spark):
    c = F.col("v")
    for value, wanted in {" HTTPS://doi.org/10.1/AB).": "10.1/ab", None: "", "10.": "", "doi:10.5/x.y": "10.5/x.y"}.items():
        assert one(spark, keys.doi_key(c), v=value) == wanted
    assert one(spark, keys.doi_without_resolver(c), v=" https://doi.org/10.1/A ") == "10.1/a"
    assert one(spark, keys.title_words_key(c), v="  The  «Näme»: a-b_c 1 ") == "the näme ab_c 1"
    assert one(spark, keys.title_letters_key(c), v="Ünïx 2!") == "nx2"
    assert one(spark, keys.shortened(c, 3), v="abcd") == "abc [...]" and one(spark, keys.shortened(c, 4), v="abcd") == "abcd"
    assert one(spark, keys.number(c), v="2020") == 2020.0 and all(one(spark, keys.number(c), v=x) is None for x in ("2020 Mar", "2020d", "1e3f", "NaN", "Infinity", "", None)) and one(spark, keys.number(c), v=" 1e3 ") == 1000.0
    assert one(spark, keys.venue_name(c, F.lit("V")), v=" ") == "V" and one(spark, keys.last_segment(c), v="https://a/W1") == "W1"
    assert one(spark, keys.collapsed(c), v="a\u0000 b\n\nc ") == "a b c"


def test_people(spark):
    c = F.col("v")
    assert one(spark, people.split_authors(c), v="A, B; ; C D") == ["A, B", "C D"] and one(spark, people.split_authors(c), v='["X Y"]') == ["X Y"] and one(spark, people.split_authors(c), v=None) == []
    assert one(spark, people.surnames(c), v=["Li, Wei", "Wei Li", "Kim"]) == ["li", "kim"]
    assert tuple(one(spark, people.split_name(c), v="Li, Wei")) == ("Wei", "Li") and tuple(one(spark, people.split_name(c), v="Ana Maria Cruz")) == ("Ana Maria", "Cruz")
    assert tuple(one(spark, people.split_name(c), v="Plato")) == ("", "Plato") and tuple(one(spark, people.split_name(c), v=",x")) == ("", ",x")
    text = '[{"first_name":"Ana","last_name":"Cruz","position":1,"is_corresponding":true,"orcid":"0","institutions":[{"institution":"U","country":"ES"},{"institution":"U","country":"FR"}]},{"first_name":"","last_name":""}]'
    assert len(one(spark, people.people(c), v=text)) == 1 and one(spark, people.people(c), v=text[:40]) == [] and one(spark, people.people(c), v=None) == []
    assert one(spark, people.places(people.people(c), "country"), v=text) == ["ES", "FR"] and one(spark, people.corresponding_author(people.people(c)), v=text) == "Ana Cruz"
    assert one(spark, people.any_orcid(people.people(c)), v=text) and one(spark, people.network_names(people.people(c)), v=text) == ["cruz ana"]
    assert list(one(spark, people.name_keys(c), v=["Bé  A", "bé a", "Zoë"])) == ["be a", "zoe"]
    assert one(spark, people.ascii_label(c), v="Łukasz Žižek–Øst Иван") == "Lukasz Zizek-Ost Ivan" and one(spark, people.abbreviated(c), v="batty michael") == "B. Batty" and one(spark, people.author_label(c), v="haas ellen c.") == "Haas E." and one(spark, people.author_label(c), v="lab 3") == "Lab 3." or one(spark, people.author_label(c), v="lab3 x") == "(unnamed)"
    assert one(spark, people.json_list(c), v='["a", "b"]') == ["a", "b"] and one(spark, people.json_list(c), v='["a"') == [] and one(spark, people.json_list(c), v="x") == []


def test_labels(spark):
    c = F.col("v")
    for value, wanted in {"Article, Retracted Publication": "retraction", "incollection": "book", "": "unknown", None: "unknown", " ; ": "unknown", "Meeting;Book": "book", "zzz": "other"}.items():
        assert one(spark, labels.doc_type(c), v=value) == wanted, value
    for value, wanted in {"t1": "T01", "P7": None, "T007": "T07", "12": "T12", "T33": None, "": None, None: None, "T00": None}.items():
        assert one(spark, labels.code(c, "T", 32), v=value) == wanted, value
    assert one(spark, labels.canonical_label(c, ["Health"], [("epidem", "Health")], "Other"), v="closest is health!") == "Health"
    assert one(spark, labels.canonical_label(c, ["Health"], [("epidem", "Health")], "Other"), v=None) == "Other"
    assert one(spark, labels.entity_parts(c), v="Farmers and  firms; agents/Firms & .x") == ["farmers", "firms"]
    assert one(spark, labels.retryable(c, F.lit("Read timed out")), v="Error") and not one(spark, labels.retryable(c, F.lit("bad")), v=None)
    assert tuple(one(spark, labels.first_json_object(c), v='x {"a": {"b": "}"}} y')) == ('{"a": {"b": "}"}}', None) and tuple(one(spark, labels.first_json_object(c), v='x {bad} {"a": 1}')) == (None, "malformed JSON")
    assert tuple(one(spark, labels.first_json_object(c), v='{"topic": 1, "extra": {"agent": "A02"}, "llm_used":')) == (None, "unbalanced JSON (truncated)") and one(spark, labels.first_json_object(c), v=None)[1] == "empty model output"


def test_filters(spark):
    c = F.col("v")
    assert one(spark, filters.foreign_script(c), v="Модель x") and not one(spark, filters.foreign_script(c), v="Model Ω") and not one(spark, filters.foreign_script(c), v="12") and not one(spark, filters.foreign_script(c), v=None)
    assert one(spark, filters.dropped_type(c), v="Article; REVIEW") and not one(spark, filters.dropped_type(c), v=None)
    df = spark.createDataFrame([(i,) for i in range(10)], "n int")
    rows = filters.ledger(df, [("even", F.col("n") % 2 == 0), ("null", F.lit(None).cast("boolean")), ("small", F.col("n") < 4)]).orderBy("step_no").collect()
    assert [(r["removed"], r["remaining"], r["pct_removed"]) for r in rows] == [(5, 5, 50.0), (0, 5, 0.0), (2, 3, 40.0)]
    assert [r["removed"] for r in filters.ledger(df.limit(0), [("a", F.lit(True))]).collect()] == [0]
    rules = filters.EvidenceRules("abm", (r"\bagent", "model"), ambiguous=(("m", "mason"),), excluded=(("x", "laser"), ("y", "plasma")))
    reasons = {"abm laser plasma": "excluded: y", "mason": "ambiguous: m", "agent model mason": None, "nothing": "no evidence"}
    for text, wanted in reasons.items():
        assert one(spark, filters.drop_reason(c, rules), v=text) == wanted


RECORDS = "rec_id bigint, title string, abstract string, year string, journal string, venue string, authors string, source string, uid string, pmid string, keywords string, mesh_terms string, doc_type string, doi string, times_cited int"


def record(i, title="T", doi=None, authors="", source="", cited=None, abstract=None):
    return (i, title, abstract, "2000", "J", None, authors, source, f"u{i}", None, None, None, None, doi, cited)


def test_merge(spark):
    rows = [record(2, "b", "10.1/X.", "A; B", "s2;s1", 3), record(1, " ", "https://doi.org/10.1/x", "B;C", "s1", None, "abs"), record(3, "c", None, "", "", 1)]
    out = merge.doi_merge(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.merge_key, r.first_id, r.n_merged, r.title, r.abstract, r.authors, r.source, r.times_cited) == ("10.1/x", 1, 2, "b", "abs", "B;C;A", "s1;s2", 3)
    assert merge.title_merge(spark.createDataFrame(rows, RECORDS)).count() == 2 and merge.doi_merge(spark.createDataFrame([], RECORDS)).count() == 0


def greedy(rows):
    reps, out = [], {}
    for i, names in sorted(rows):
        hit = next((o for o, n in reps if not n or not names or n & names), None)
        if hit is None:
            reps.append((i, names))
        out[i] = i if hit is None else hit
    return out


def test_same_title_representatives(spark):
    rng = random.Random(4)
    rows = [(i, "Same", rng.sample("abcdef", rng.randint(0, 3))) for i in range(40)] + [(99, " ", ["a"])]
    df = spark.createDataFrame(rows, "rec_id bigint, title string, names array<string>")
    got = {r["rec_id"]: r["rep"] for r in merge.same_title_representatives(df, F.col("names")).collect()}
    assert got == {**greedy([(i, set(n)) for i, _, n in rows[:-1]]), 99: 99}


def test_first_by_any_key(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, *"abcd"]), rng.choice([None, *"wxyz"])) for i in range(30)]
    kept, seen = [], set()
    for i, a, b in rows:
        own = {("a", a)} if a else set()
        own |= {("b", b)} if b else set()
        if not own & seen:
            seen |= own
            kept.append(i)
    df = spark.createDataFrame(rows, "rec_id bigint, a string, b string")
    assert sorted(r[0] for r in merge.first_by_any_key(df, ["a", "b"], "rec_id").select("rec_id").collect()) == kept


def test_joins(spark):
    df = spark.createDataFrame([(1, "k", ""), (2, "k", "own"), (3, "", None), (4, None, None)], "id int, key string, text string")
    lookup = spark.createDataFrame([("k", "found"), ("", "never")], "key string, text string")
    assert {r["id"]: r["text"] for r in merge.fill_from(df, lookup, "key", ["text"]).collect()} == {1: "found", 2: "own", 3: None, 4: None}
    assert {r["id"]: r["text"] for r in merge.fill_from(df, lookup, "key", [], ["text"]).collect()} == {1: "found", 2: "found", 3: None, 4: None}
    new, old = spark.createDataFrame([(1, "A b", None), (2, "c", "10.1/q"), (3, "Ж", "")], "id int, title string, doi string"), spark.createDataFrame([("a B!", None), ("z", "DOI:10.1/Q"), ("Щ", None)], "title string, doi string")
    assert [r["id"] for r in merge.without_known(new, old).collect()] == [3]
    _, report = merge.aligned(spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string"), spark.createDataFrame([(1, "a"), (3, "c")], "i int, t string"), "i", ["t"])
    assert tuple(report.first()) == (3, 2)
    left = spark.createDataFrame([(1, "night train"), (2, "night train"), (3, ""), (4, None)], "left_id int, left_title string")
    right = spark.createDataFrame([(5, "night trains", True), (6, "night trains", False), (8, "night trains", True), (7, "other", True), (9, None, True)], "right_id int, right_title string, has_abstract boolean")
    assert sorted((r["left_id"], r["right_id"]) for r in merge.best_fuzzy_match(left, right).collect()) == [(1, 5), (2, 5)]
    assert merge.first_of(df, ["key"], ["id"]).count() == 3


def test_ranking(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "n string, v int")
    assert {r["n"]: r["avg_rank"] for r in ranking.average_rank(df, "v").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}
    assert tuple(ranking.concentration(df, "v").first()) == (4, 12, 2)
    assert [r["n"] for r in ranking.top_in_group(df, ["v"], ["n"], 1).orderBy("n").collect()] == ["a", "b", "d"]
    assert ranking.top_percent(df, ["n"], 1, 2).count() == 2
    seen = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("z", None)], "k string, p int")
    assert [tuple(r) for r in ranking.cumulative_first_seen(seen, "k", "p").orderBy("p").collect()] == [(1, 1, 1), (2, 1, 2)]


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(2)
    pairs = [p for p in itertools.combinations([f"n{i:02d}" for i in range(14)], 2) if rng.random() < 0.25]
    return pairs, spark.createDataFrame([(a, b, 1.0 + (i % 3)) for i, (a, b) in enumerate(pairs)], "source string, target string, weight double")


def test_graph(spark, edges):
    pairs, df = edges
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r["node"]: r for r in graph.clustering(df).collect()}
    for n, around in near.items():
        triangles = sum(b in near[a] for a, b in itertools.combinations(sorted(around), 2))
        d = len(around)
        assert got[n]["triangles"] == triangles and got[n]["coefficient"] == pytest.approx(2 * triangles / (d * (d - 1)) if d > 1 else 0)
    assert {r["node"]: r["degree"] for r in graph.degrees(df).collect()} == {n: len(x) for n, x in near.items()}
    assert {r["source"] + r["target"] for r in graph.pruned(df, 4).collect()} == {a + b for a, b in pairs if len(near[a]) >= 4 and len(near[b]) >= 4}
    row = graph.density(df).first()
    assert (row["nodes"], row["edges"]) == (len(near), len(pairs))
    every = df.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("community", F.lit(1))
    assert graph.modularity(df, every).first()[0] == pytest.approx(0)
    alone = every.withColumn("community", F.col("node"))
    m = len(pairs)
    assert graph.modularity(df, alone, False).first()[0] == pytest.approx(-sum((len(x) / (2 * m)) ** 2 for x in near.values()))
    assert graph.partition_agreement(every, alone).first()["pairs_both"] == 0
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(df, sources=50).collect()}
    assert max(between.values()) > 0 and set(between) == set(near)
    central = {r["node"]: r["centrality"] for r in graph.eigenvector_centrality(df, rounds=5).collect()}
    assert sum(v * v for v in central.values()) == pytest.approx(1)


def test_pair_edges(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b", "a", "c"],), (["a"],), ([],)], "m array<string>")
    got = {(r["source"], r["target"]): (round(r["weight"], 4), r["papers"]) for r in graph.pair_edges(df, "m").collect()}
    assert got == {("a", "b"): (0.75 + 0.6, 2), ("b", "c"): (0.75, 1), ("a", "c"): (round(0.6 * 0.75, 4), 1)}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), (7, 8), (8, 10), (10, 11), (11, 12), (None, 1)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 7: 7, 8: 7, 10: 7, 11: 7, 12: 7}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_lift(spark):
    df = spark.createDataFrame([("g", "x", 1), ("g", "x", 1), ("g", "y", 2), ("h", "x", 3), ("h", None, 4)], "g string, v string, d int")
    got = {(r["g"], r["v"]): (r["n_docs"], round(r["lift"], 4)) for r in lift.lifts(df, "g", "v", "d").collect()}
    assert got == {("g", "x"): (1, 1.0), ("g", "y"): (1, 2.0), ("h", "x"): (1, 1.0)}
    assert lift.contrast(df, "g", "v").where("g = 'g'").first()["v"] == "x"
    assert lift.signatures(lift.lifts(df, "g", "v", "d"), "g", "v", 1, 1.5, 1, 1).count() == 2


def test_growth(spark):
    rows = [(2001, ["a", "b"]), (2001, ["c"]), (2002, ["c", "d", "e"]), (2004, ["b", "c"]), (2005, ["f"])]
    found = graph.growth(spark.createDataFrame(rows, "year int, names array<string>"), "year", "names").orderBy("year").collect()
    assert [(r["year"], r["nodes"], r["edges"], round(r["giant_share"], 3)) for r in found] == [(2001, 3, 1, 100.0), (2002, 5, 4, 60.0), (2004, 5, 5, 100.0), (2005, 6, 5, 100.0)]
    assert found[0]["mean_degree"] == 1 and found[0]["mean_weighted_degree"] == 0.75


def test_classification(spark):
    c = F.col("v")
    good = '{"topic": "T6", "agent": 2, "agent_type": "A02", "llm_used": false, "llm_role": "L05"}'
    read = lambda v: one(spark, labels.classification(c), v=v)
    assert tuple(read(good)) == ("T06", "A02", "A02", 0, "L01", None)
    for text, error in [(good.replace("A02", "A03"), "agent_type must match agent"), (good.replace("false", "2"), "invalid llm_used"), (good.replace("T6", "T33"), "unrecognised T code"), ('{"topic": 1}', "missing field(s): agent, agent_type, llm_used, llm_role"), (None, "no JSON object"), (good.replace("L05", "M1"), "unrecognised L code")]:
        assert read(text)["error"] == error and read(text)["topic"] is None
    assert read(good.replace("false", '"yes"'))["llm_used"] == 1 and read(good.replace("false", '"no"'))["llm_used"] == 0


def test_rebuilt_text_and_kinds(spark):
    c = F.col("v")
    df = spark.sql("select map('based', array(1), 'agent', array(0, 3), 'model', array(2, 3)) as m, cast(null as map<string,array<int>>) as x")
    assert df.select(keys.rebuilt_text(F.col("m")), keys.rebuilt_text(F.col("x"))).first() == ("agent based model model", "")
    assert one(spark, labels.agent_kinds(c), v="cars and care homes; drones, not_applicable / x") == ["Vehicles", "Vehicles", "Vehicles"] and one(spark, labels.agent_kinds(c), v=None) == []
    assert one(spark, people.region(c), v="TR") == "Europe" and one(spark, people.region(c), v=None) == "Other" and one(spark, people.country_name(c), v=" xx") == "XX"


def test_authorships(spark):
    c = F.col("v")
    place = lambda n: (n, "DE", None, "r1")
    rows = [([(("Ann Lee", "0"), "Lee, Ann", "first", True, [place("Uni"), place(" ")]), (("", None), None, None, None, None), (("Bo", None), None, "last", None, [place("UNI"), place("Lab")])],), (None,)]
    made = spark.createDataFrame(rows, f"v {people.AUTHORSHIPS}").select(people.authorships(c).alias("x")).collect()
    assert [(a["first_name"], a["last_name"], a["position"]) for a in made[0]["x"]["authors"]] == [("Ann", "Lee", 1), ("", "Bo", 3)]
    assert [a["institution"] for a in made[0]["x"]["affiliations"]] == ["Uni", "Lab"] and made[1]["x"]["authors"] == []


def test_merged_stage(spark):
    """Surnames first, titles then: the representatives' authors are united, not those they stand for."""
    rows = [(1, "T", "Li, A."), (2, "t", "Li, B.; Wu, C."), (3, "T!", "Wu, D."), (4, "T", "Kim, E."), (5, "T", None), (6, "", "Li, A."), (7, None, None)]
    df = spark.createDataFrame([(*r, None, None, None, None, None, str(r[0]), None, None, None, None, None, 1) for r in rows], "rec_id bigint, title string, authors string, doi string, abstract string, year string, journal string, venue string, source string, uid string, pmid string, keywords string, mesh_terms string, doc_type string, times_cited int")
    out = {r["first_id"]: r for r in stages.merge_sources(df).collect()}
    assert set(out) == {1, 6, 7} and out[1]["n_merged"] == 5 and out[1]["authors"] == "Li, A.;Wu, D.;Kim, E." and out[1]["source"] == "1;2;5;3;4"


def test_small_plans(spark, tmp_path):
    from litmill.sources import read_ledger
    from litmill.streaming import log

    (tmp_path / "l.csv").write_text("stage,step,removed,remaining,pct_removed,csv,note\nclean,a,1,2,33.33,,\nmerge,b,0,2,0.0,,x\n")
    assert [r["stage"] for r in read_ledger(spark, str(tmp_path / "l.csv"), "clean").collect()] == ["merge"]
    done = spark.createDataFrame([(1, "v1", 5, 5), (2, "v1", 3, 9), (3, "v2", None, None)], "y int, query_version string, fetched int, total int")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,)], "y int")
    assert sorted(map(tuple, log.incomplete(log.current_progress(done, "v1"), wanted, "y").collect())) == [(2, 4), (3, 1), (4, 1)]
    report = spark.createDataFrame([(0.06,)], "stale_share double")
    assert log.discard_stale(done, report).count() == 0 and log.discard_stale(done, report, 0.1).count() == 3
    ranked = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(50)], "i int, a double, b double")
    from litmill.operators import ranking

    got = {r["i"]: r["avg_rank"] for r in ranking.average_rank(ranked, "a").collect()}
    values = sorted((i % 7 for i in range(50)), reverse=True)
    assert all(got[i] == values.index(i % 7) + (values.count(i % 7) + 1) / 2 for i in range(50)) and ranking.rank_shift(ranked, "a", "a", 0).first()["shifted"] == 0
