"""Near duplicates, survivors and name variants."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litmill.llm import meeting, neardup, survivor, variants

TITLE = "Exploring hoarding policies for local platforms with multi-agent simulation"
AUTHORS = "Malincez, I. M.; Helensdeskog, A.; Lorarellan, R."


def test_same_publication():
    same = lambda t, a: neardup.same_publication(TITLE, AUTHORS, t, a)
    assert same(TITLE.upper() + " [v2]", "Imran M. Malincez; Aiko Helensdeskog; Richard Lorarellan")
    assert same("Exploring haording policies for platforms local with multiagent simulations", "Malincez IM; Helensdekog A; et al.")
    assert same("<i>" + TITLE + "…</i>", "Lorarellan Richard; Malincez Imran M.")
    assert not same(TITLE, "Calodez, S.; Olevpak, D.") and not same("Exploring trust policies for rural markets with multi-agent simulation", AUTHORS)
    assert not same(TITLE, "Malincez, K.; et al.") and same(TITLE, "Malincez, I.; et al.") and not same(TITLE, "Malincez, I.")
    assert not neardup.same_publication(TITLE + ". Part I", AUTHORS, TITLE + ". Part II", AUTHORS) and not neardup.same_publication(TITLE + ". 2018 report", AUTHORS, TITLE + ". 2021 report", AUTHORS)
    assert not neardup.same_publication(TITLE, None, TITLE.lower(), "") and not neardup.same_publication("Editorial", None, "Editorial", "") and not neardup.same_publication(None, None, None, None)


def test_signatures_meet():
    counts = neardup.feature_counts([TITLE, TITLE + "s"], [AUTHORS, AUTHORS], 1 << 12)
    a, b, c = neardup.signatures([TITLE, TITLE + "s", ""], [AUTHORS, AUTHORS, None], counts, 3, 32)
    assert (a == b).sum() >= 2 and (a == c).sum() == 0 and np.array_equal(a, neardup.signatures([TITLE], [AUTHORS], counts, 3, 32)[0])


def test_score():
    """One similarity with one threshold: people by initials only don't count, slips in every word do no harm."""
    slips = "Exploringg hoardinng policiess for loocal platfforms with mullti-agennt simulaation"
    assert neardup.publication_score(TITLE, AUTHORS, slips, AUTHORS) == 1.0 and neardup.publication_score(TITLE, AUTHORS, None, AUTHORS) == 0.0
    assert neardup.author_share("Lee, A.; B., P.", "Lee, Ann; Bauer, Paul") == 1.0 and neardup.author_share("Lee, A.; B., P.", "Lee, Ann; Kim, Zoe") == 0.5
    assert neardup.author_share("A., B.", "A. B.") == 1.0 and neardup.author_share("", "x") == 0.0 and neardup.author_share("Lee A; et al.", "Lee A; Kim B; Wu C") == 1.0


def test_groups(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    rows, wanted = [], set()
    for k in range(120):
        title, authors = " ".join(word() for _ in range(7)), "; ".join(f"{word().title()}, {rng.choice('ABCD')}." for _ in range(3))
        rows.append((k * 10, title, authors))
        if k % 3 == 0:
            cut = title.split()
            del cut[rng.randrange(7)]
            rows.append((k * 10 + 1, " ".join(cut).upper(), authors))
            wanted.add((k * 10, k * 10 + 1))
    rows += [(5001, "Hot title by the same people " + str(n), "Same, A.; Also, B.") for n in range(3)]
    rows += [(6000 + n, "Copied to the letter everywhere", "Copy, C.") for n in range(40)] + [(7001, None, "x"), (7002, "", None), (None, "t t t t", "x"), (7003, "Editorial", ""), (7004, "Editorial", "")]
    df = spark.createDataFrame(rows, "rec_id bigint, title string, authors string").withColumns({"rep": F.lit(1), "group_id": F.lit("x"), "h1": F.lit(0)})
    groups = neardup.publication_groups(df)
    found = {(r[0], r[1]) for r in neardup.group_pairs(groups).collect()}
    copies = set(itertools.combinations(range(6000, 6040), 2))
    assert copies <= found and not {p for p in found - copies - wanted if p[0] < 5000 or p[0] > 7000} and len(found & wanted) >= 0.95 * len(wanted)
    assert neardup.publication_groups(df.limit(0)).count() == 0


def test_long_lists(spark):
    """Lists over the bound lose no pair that shares enough coordinates."""
    posts = [(i, [1, 2, 3 + i // 6, 100 + i]) for i in range(60)]
    reps = spark.createDataFrame([(i,) for i in range(60)], "rep bigint")
    table = spark.createDataFrame(posts, "rep bigint, posts array<bigint>")
    pairs = neardup.candidate_pairs(reps, lambda some: table.join(some, "rep", "left_semi"), neardup.NearDupConfig(long_list=8, least_matches=3))
    found = {tuple(r) for r in pairs.collect()}
    assert {(a, b) for a, b in itertools.combinations(range(60), 2) if a // 6 == b // 6} <= found


def test_long_pair_lists(spark):
    """Where many records share the same two coordinates, those that share no more meet as well, however far apart by id."""
    table = spark.createDataFrame([(i * 7, [1, 2, 100 + i, 200 + i % 30]) for i in range(60)], "rep bigint, posts array<bigint>")
    for block_rows in (7, 256):
        config = neardup.NearDupConfig(long_list=8, least_matches=2, block_rows=block_rows)
        found = [tuple(r) for r in neardup.candidate_pairs(table.select("rep"), lambda some: table.join(some, "rep", "left_semi"), config).collect()]
        assert len(found) == len(set(found)) and set(found) == set(itertools.combinations(range(0, 420, 7), 2))


@pytest.mark.parametrize(("least", "size"), [(2, 60), (3, 60), (2, 400), (4, 200)])
def test_all_pairs_at_the_threshold(spark, least, size):
    """Whatever the lengths of the lists, every pair that shares as many coordinates as asked for is retained."""
    rng = random.Random(least * size)
    hot = range(6)
    posts = [(i * 3, sorted({*rng.sample(hot, rng.randint(0, 4)), *(10 + rng.randrange(size // 5) for _ in range(3)), *(1000 + rng.randrange(size) for _ in range(3))})) for i in range(size)]
    table = spark.createDataFrame(posts, "rep bigint, posts array<bigint>")
    config = neardup.NearDupConfig(long_list=6, least_matches=least, block_rows=16)
    found = [tuple(r) for r in neardup.candidate_pairs(table.select("rep"), lambda some: table.join(some, "rep", "left_semi"), config).collect()]
    wanted = {(a, b) for (a, x), (b, y) in itertools.combinations(posts, 2) if len(set(x) & set(y)) >= least}
    assert len(found) == len(set(found)) and wanted <= set(found)


WHOLE = "We study the spread of rules. The model has many agents. Results hold for all seeds. Prices rise when trust falls."


def test_consensus():
    cut = WHOLE[:60] + "…"
    doubled = WHOLE[:88] + " " + WHOLE[:88]
    best = lambda *v: survivor.consensus([(x, 1.0) for x in v])
    assert best(cut, WHOLE, WHOLE[:30]) == 1 and best(doubled, WHOLE) == 1 and best(WHOLE[:57] + " [...]", cut) == 0 and best(WHOLE) == 0
    assert best("a b c x e f", "a b c d e f", "a b c d e f g") in (1, 2) and best("", "x") == 1
    assert survivor.whole_part(doubled)[0] == survivor.whole_part(WHOLE[:88])[0]


def test_survivors(spark):
    t = lambda d: f"2025-01-{d:02d} 00:00:00"
    rows = [
        (1, WHOLE[:40] + "...", 5, "HTTPS://doi.org/10.1234/AB.1.", t(1)), (2, WHOLE, 0, None, t(9)), (3, "No abstract available.", 7, "10.1234/ab.1", t(3)), (4, None, -1, "pending", None),
        (5, "", None, "", t(1)), (6, "[Abstract not available]", 3, "10,12", None), (7, "Alone.", 1, "10.1234/z", t(1)),
    ]
    df = spark.createDataFrame(rows, "rec_id bigint, abstract string, times_cited int, doi string, at string").selectExpr("rec_id", "abstract", "times_cited", "doi", "timestamp(at) as collected_at", "'c' as value", "1 as id")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)], "rec_id bigint, group_id bigint")
    assert sorted(tuple(r) for r in survivor.survivors(df, groups).collect()) == [(1, 2, 3, "10.1234/ab.1"), (5, -1, 6, "")]
    assert survivor.survivors(df.limit(0), groups).count() == 0
    # groups of more values than one task takes: the same survivors
    words = WHOLE.split()
    near = [(g, 100 * g + i, " ".join(w if (k + i) % 11 else w + "x" for k, w in enumerate(words[: len(words) - i % 3]))) for g in (1, 2) for i in range(1, 30)]
    many = spark.createDataFrame(near + [(g, 100 * g + 50, WHOLE) for g in (1, 2)] + [(3, 1, "One."), (3, 2, None)], "group_id bigint, id bigint, value string")
    got = [sorted(tuple(r) for r in survivor.consensus_values(many, survivor.SurvivorConfig(gathered_values=n)).collect()) for n in (4, 64)]
    assert got[0] == got[1] == [(1, 150, WHOLE), (2, 250, WHOLE), (3, 1, "One.")]


COMMON = frozenset(["leonard", "bruna", "natalia", "anne", "marie", "omar", "rosa"])


def test_one_person():
    same = lambda a, b: variants.one_person(a, b, COMMON)[0]
    for a, b in [("leonard peditelund", "l. peditelund"), ("peditelund, leonard", "dr. leonard peditelund jr."), ("anne-marie volorik", "annemarie volorik"), ("nata. fonagero", "natalia fonagero"), ("leonard peditelund", "len peditelund"), ("leonard peditelund", "leonard peditelnud"), ("leonard b. peditelund", "leonard peditelund"), ("leo​nard реditelund", "leonard peditelund"), ("omar k", "omar k.")]:
        assert same(a, b) or a == "omar k", (a, b)
    for a, b in [("bruna peditelund", "natalia peditelund"), ("omar r. volorik", "rosa volorik"), ("leonard a. volorik", "leonard b. volorik"), ("b. volorik", "n. volorik"), ("leonard volorik", "leonard peditelund"), ("volorik", "peditelund")]:
        assert not same(a, b), (a, b)


def test_near_words(spark):
    words = ["volorik", "volorkik", "volroik", "volorak", "peditelund", "ab", "abc"]
    got = {(r[0], r[1]) for r in variants.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {("volorik", "volorkik"), ("volorik", "volroik"), ("volorik", "volorak"), ("volorak", "volorik")} <= got and not any("peditelund" in p for p in got)


def test_name_variants(spark):
    given = ["leonard", "bruna", "natalia", "omar", "rosa", "emre"]
    rng = random.Random(2)
    base = {f"{g} {''.join(rng.choices('abcdefghij', k=9))}ov" for g in given for _ in range(12)}
    family = ["volorikson", "peditelund"]
    extra = [("leonard volorikson", "o1"), ("l. volorikson", None), ("volorikson leonard", None), ("leonard voloriksno", None), ("bruna peditelund", "o2"), ("natalia peditelund", "o3"), ("b. peditelund", None), ("omar peditelund", None), ("o. peditelund", "o3"), ("", None), (None, "x")]
    names = spark.createDataFrame([(n, None) for n in sorted(base)] + extra, "entry string, orcid string")
    found = {tuple(r) for r in variants.variant_pairs(variants.name_variants(names, variants.VariantConfig(given_least=5))).collect()}
    wanted = {tuple(sorted(p)) for p in itertools.combinations(["leonard volorikson", "l. volorikson", "volorikson leonard", "leonard voloriksno"], 2)} | {("b. peditelund", "bruna peditelund")}
    assert wanted <= found and not {p for p in found if any(f in p[0] for f in family)} - wanted - {("o. peditelund", "omar peditelund")}
    assert variants.name_variants(names.limit(0)).count() == 0


def test_frequent_family_name(spark):
    """A family name that many spellings hold is one still; a frequent given name is none where it stands first."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghklmnprstv", k=9))
    names = [f"{word()} zhang" for _ in range(30)] + [f"leonard {word()}" for _ in range(20)] + ["xiaoqing zhang", "x. zhang", "leonard", "qiu leonard", "q. leonard", "leonard xerolan"]
    df = spark.createDataFrame([(n, None) for n in names], "entry string, orcid string")
    found = {tuple(r) for r in variants.variant_pairs(variants.name_variants(df, variants.VariantConfig(given_least=5))).collect()}
    assert found == {("x. zhang", "xiaoqing zhang"), ("q. leonard", "qiu leonard")}
    assert [variants.parse_name(n).placed for n in ("x. zhang", "zhang x.", "zhang, xiaoqing", "dr. li zhang jr.", "zhang, x.")] == ["zhang", "", "zhang", "zhang", "zhang"]


def test_assignment_is_optimal():
    """Words pair at the least cost in all, not greedily; against every assignment of small names."""
    a, b = variants.Name(("abcdexgx", "azcdefgz"), (), ""), variants.Name(("azcdexgh", "abcdyxgh"), (), "")
    cost = lambda x, y: variants.align(x, y, frozenset())[0]
    rng = random.Random(11)
    forms = ["leonard", "leonrad", "len", "leo", "bruna", "bruno", "volorik", "volorki", "peditelund", "anna", "anne"]

    def brute(x, y):
        best = 9.0
        for order in itertools.permutations(range(len(y.words))):
            for used in range(min(len(x.words), len(y.words)) + 1):
                for mine in itertools.combinations(range(len(x.words)), used):
                    prices = [variants._price("w", x.words[i], "w", y.words[order[k]], frozenset()) for k, i in enumerate(mine)]
                    left_x = [w for i, w in enumerate(x.words) if i not in mine]
                    left_y = [y.words[j] for j in order[used:]]
                    if None in prices:
                        continue
                    joined = variants._slip("".join(left_x), "".join(left_y)) if left_x and left_y else None
                    if joined is False or used + bool(joined) < 2:
                        continue
                    extra = 0.34 * ("".join(left_x) != "".join(left_y)) if joined else 0.34 * (len(left_x) + len(left_y))
                    best = min(best, sum(prices) + extra)
        return best

    for _ in range(300):
        x, y = (variants.Name(tuple(rng.choices(forms, k=rng.randint(1, 4))), (), "") for _ in range(2))
        assert abs(cost(x, y) - brute(x, y)) < 1e-9, (x, y)
    assert cost(a, b) == brute(a, b)
    many = variants.Name((), (), "ab" * 40)
    assert variants.align(many, many, frozenset())[0] == 0.0


def test_places_and_chains(spark):
    """Known places of work keep like names apart, and decide between persons; a chain of slips is cut at the most frequent spelling."""
    at = lambda *bits: [sum(1 << b for b in bits), 0, 0, 0, 0, 0, 0, 0]
    rows = [
        ("anna volorik", None, 9, at(1)), ("anna volorikk", None, 1, at(1)), ("anna vollorik", None, 2, at(2)), ("a. volorik", None, 1, at(1)), ("volorik, anna", None, 1, None),
        ("karl mendelov", "o1", 3, at(3)), ("karl mendelow", None, 2, at(3)), ("karl mendelo", "o2", 1, at(3)), ("k. mendelov", None, 1, at(4)),
        ("ivo peditelund", None, 1, None), ("ivo peditelumd", None, 1, None),
    ]
    names = spark.createDataFrame(rows, "entry string, orcid string, n bigint, places array<bigint>")
    found = {tuple(r) for r in variants.variant_pairs(variants.name_variants(names)).collect()}
    anna = {tuple(sorted(p)) for p in itertools.combinations(["anna volorik", "anna volorikk", "a. volorik", "volorik, anna"], 2)}
    assert anna <= found and not any("vollorik" in x for p in found for x in p)
    assert ("karl mendelov", "karl mendelow") in found and ("karl mendelo", "karl mendelov") not in found and ("karl mendelo", "karl mendelow") not in found
    assert not any("k. mendelov" in p or "ivo peditelund" in p for p in found)


def test_written_names(spark):
    person = "array<struct<first_name:string,last_name:string,orcid:string>>"
    df = spark.createDataFrame([("ann lee;bo li", [("Ann", "Lee", "1"), ("Bo", "Li", "")]), ("ann lee", [("Ánn", "Lee", "1")]), ("", None), (None, [])], f"name_key string, authors_list {person}")
    assert {r["entry"]: r["orcid"] for r in variants.written_names(df).collect()} == {"ann lee": "1", "bo li": None}


@pytest.mark.parametrize("name", ["á", "", "DR.", "x" * 3000])
def test_names_of_any_kind(name):
    assert variants.parse_name(name) is not None and neardup.same_name(name, name) in (True, False, None)


def test_every_pair_that_can_be_one_person_meets(spark):
    """Of names with slips, short forms, initials and parted words, the pairs linked are those of a comparison of every pair."""
    rng = random.Random(3)
    given, family = "maria jose john robert bob katarina catarina michael micheal bill william mike marta".split(), "smith macdonald oxley volorik peditelund".split()
    names = {"jose maria oxley", "maria jose o.", "maria mac donald", "maria macdonald", "bob. smith", "robert smith", "micheal o.", "michael oxley", "marta marta m.", "marta marta smith"}
    while len(names) < 150:
        words = [rng.choice(given), *([rng.choice(given)] if rng.random() < 0.5 else []), rng.choice(family)]
        typed = [w if (k := rng.random()) < 0.6 else w[0] + "." if k < 0.8 else w[:3] + "." if k < 0.88 else w[:2] + w[3:] for w in words]
        names.add(" ".join(typed) if rng.random() < 0.7 else f"{typed[-1]}, {' '.join(typed[:-1])}")
    config = variants.VariantConfig(given_least=12)
    df = spark.createDataFrame([(n, None, None, None) for n in sorted(names)], "entry string, orcid string, n bigint, places array<bigint>")
    parsed = [(n, variants.parse_name(n)) for n in sorted(names)]
    words = [w for _, p in parsed for w in {*p.words, *p.glued}]
    frequent = frozenset(w for w in words if words.count(w) > 12)
    shown = sum(bool(p.placed) for _, p in parsed)
    assert frequent and shown
    firsts = frozenset(w for w in frequent if sum(p.placed == w for _, p in parsed) < 0.5 * sum(bool(p.placed) and w in {*p.words, *p.glued} for _, p in parsed))
    counted = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "word string, n bigint")
    met = {(r["a"], r["b"]) for r in variants._met(variants._posts(variants._parsed(df), variants._kin(counted, config), sorted(firsts))).collect()}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if variants.one_person(a, b, frequent, config, firsts)[0]}
    assert wanted and not wanted - met


def test_one_person_by_another_assignment():
    """A pair is one person's if any assignment within the limit has a family word or two matched ones, not only the cheapest."""
    rng, most = random.Random(7), variants.VariantConfig().most_cost
    tokens = ["maria", "marta", "mar.", "m.", "smith", "smit", "s.", "jose", "j.", "oxley"]
    frequent, found = frozenset(["maria", "marta", "jose"]), 0
    for _ in range(3000):
        a, b = (" ".join(rng.choices(tokens, k=rng.randint(2, 4))) for _ in range(2))
        cost, family, matched = variants.align(variants.parse_name(a), variants.parse_name(b), frequent, None, True)
        same = variants.one_person(a, b, frequent)[0]
        assert same == (cost <= most and (family > 0 or matched > 1)), (a, b)
        found += same
    assert found


def _met_names(spark, rows, config=variants.VariantConfig(given_least=5)):
    """What meets of ``(entry, orcid, n, places)``, and the frequent and given words, as in ``name_variants``."""
    entries = variants._parsed(spark.createDataFrame(rows, "entry string, orcid string, n bigint, places array<bigint>"))
    parsed = [variants.parse_name(r[0]) for r in rows]
    words = [w for p in parsed for w in {*p.words, *p.glued}]
    frequent = frozenset(w for w in words if words.count(w) > config.given_least)
    firsts = frozenset(w for w in frequent if sum(p.placed == w for p in parsed) < 0.5 * sum(bool(p.placed) and w in {*p.words, *p.glued} for p in parsed))
    counted = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "word string, n bigint")
    return variants._met(variants._posts(entries, variants._kin(counted, config), sorted(firsts))).collect(), frequent, firsts


def test_a_common_given_name_alone_is_no_meeting(spark):
    """Names with a given name in common and different others are not compared; one word parted in another place is met, however long the names."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("bcdfghklmnprstvaeiou", k=9))
    pairs = [("maria mac donald", "maria macdonald"), ("maria van der berg-holm", "maria vanderbergholm"), ("maria o. lindqvistholm", "maria o. lindqvits holm"), ("ana bea cia dora eva fay mac donald", "ana bea cia dora eva fay macdonald")]
    names = sorted({f"maria {word()} {word()}" for _ in range(60)} | {f"maria {word()}" for _ in range(60)} | {n for p in pairs for n in p})
    met, frequent, firsts = _met_names(spark, [(n, None, None, None) for n in names])
    found = {(r["a"], r["b"]) for r in met}
    assert "maria" in firsts and {tuple(sorted(p)) for p in pairs} <= found and len(found) < 20
    assert all(variants.one_person(a, b, frequent, variants.VariantConfig(), firsts)[0] for a, b in pairs)


def test_what_is_known_keeps_names_apart(spark):
    """Identifiers and places, few, many, none or unknown, keep the same names apart as in a look at every pair."""
    rng = random.Random(4)
    rows = []
    for name in [f"maria {c}. smith" for c in "abcdefghijklmnop"] + [f"smith, maria {c}." for c in "abcdefghijklmnop"]:
        bits = rng.choice([None, [], [rng.randrange(12) * 40], rng.sample(range(0, 480, 40), 2), [63, rng.randrange(512)], rng.sample(range(512), 30)])
        places = None if bits is None else [(lambda x: x - (1 << 64) if x >> 63 else x)(sum(1 << b % 64 for b in set(bits) if b // 64 == k)) for k in range(8)]
        rows.append((name, rng.choice([None, None, "o1", "o2"]), rng.randrange(9), places))
    met, _, _ = _met_names(spark, rows)
    wanted = set()
    for (a, i, na, p), (b, j, nb, q) in itertools.combinations(sorted(rows), 2):
        same, at_one = bool(i and j and i == j), p is not None and q is not None and any(x & y for x, y in zip(p, q))
        if not (i and j and i != j) and (same or at_one or p is None or q is None):
            wanted.add((a, b, na, nb, same, at_one))
    assert {tuple(r) for r in met} == wanted and len(met) == len(wanted) and 50 < len(wanted) < 32 * 31 / 2


def test_nothing_that_one_person_accepts_is_ruled_out():
    rng = random.Random(13)
    tokens = "maria marta jose joseph bob robert rob mac donald macdonald oxley volorik volroik jo john mcdon ald smith smit micheal michael mike m. s. j. ma. mich. jos. mei-ling de el-hadi hadi".split()
    found = 0
    for _ in range(6000):
        a, b = (" ".join(rng.choices(tokens, k=rng.randint(1, 4))) for _ in range(2))
        same = variants.one_person(a, b, frozenset(["maria", "marta", "jose", "john"]))[0]
        assert not same or variants.may_be_one(variants.parse_name(a), variants.parse_name(b)), (a, b)
        found += same
    assert found


def test_meetings():
    """Of the rows of a group one that leads and one that follows meet, once; whole keys stay together over batches."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        group, lead, follow = rng.integers(0, 3, n), rng.random(n) < 0.6, rng.random(n) < 0.6
        got = [frozenset(p) for i, j in meeting.meetings(group, lead, follow, int(rng.choice([1, 5, 1000]))) for p in zip(i.tolist(), j.tolist())]
        wanted = {frozenset((i, j)) for i in range(n) for j in range(n) if i != j and group[i] == group[j] and lead[i] and follow[j]}
        assert len(got) == len(wanted) and set(got) == wanted
        keys = np.sort(rng.integers(0, 6, 40))
        batches = [pa.RecordBatch.from_arrays([pa.array(x)], names=["key"]) for x in np.split(keys, np.sort(rng.integers(0, 40, 6)))]
        tables = [t.column("key").to_pylist() for t in meeting.by_key(iter(batches), int(rng.integers(1, 20)))]
        assert sum(tables, []) == keys.tolist() and all(set(x).isdisjoint(y) for x, y in itertools.combinations(tables, 2))
