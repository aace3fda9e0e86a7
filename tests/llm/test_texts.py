"""Quality, look-alikes, language, leaks and mixing."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import language, leakage, lookalike, mixing, quality

PROSE = "The model shows that the adoption of new rules among farmers is slow. It is not clear if this holds for all of the regions, but the results are robust to the choice of seed."


def kind(text):
    return quality.measure([text])[2][0]


def test_text_kinds():
    assert kind(PROSE) == kind(PROSE + "\n- one thing\n- another\n" + PROSE) == "prose"
    assert kind("Die Studie zeigt die Annahme der neuen Regeln unter den Betrieben, und das Ergebnis ist für alle Regionen nicht klar. Es ist von der Wahl abhängig.") == "prose"
    assert kind("Модель показывает, как правила влияют на выбор и на цены в районах. Это не зависит от числа агентов и от того, как они связаны.") == "prose"
    assert kind("- red apples\n- green pears\n- plums\n1) figs\n2) dates") == kind("Keywords: trust; the price of land; learning; risk; fairness; exit") == "list"
    assert kind("| a | b |\n| --- | --- |\n| x | 1.5 |\n| y | 2.5 |") == kind("alpha = 0.5\nbeta = 7\ngamma = n.s.") == kind("a,b,c\nx,1,2\ny,3,4") == "table"
    assert kind("3f20: ff a0 11 b2 c4 d5\n3f30: 00 11 22 33 44 55") == kind("==========\n**********") == kind("xq zvkrtpl bnmqwrt hjklpq wrtzx ghjkl mnbvcx") == "junk"
    assert kind("T h e m o d e l s h o w s t h a t t h e p r i c e i s h i g h i n a l l") == kind(" ".join(["The same sentence is here again."] * 12)) == "junk"
    assert kind(None) == kind("") == kind(" \n ") == "empty"


def test_statistics(spark):
    df = spark.createDataFrame([(1, PROSE, "x"), (1, PROSE, "x"), (None, None, "y"), (2, "", "z"), (3, "word " * 60000, "long"), (4, "word " * 4_000_000, "longer")], "doc_id bigint, text string, text_kind string")
    rows = quality.text_statistics(df).collect()
    assert sorted((r["doc_id"] or 0, r["text_kind"]) for r in rows)[:4] == [(0, "empty"), (1, "prose"), (1, "prose"), (2, "empty")]
    assert quality.nonprose(df.limit(0)).count() == 0 and [r for r in rows if r["doc_id"] == 3][0]["n_words"] == 60000
    assert quality.measure([])[2] == [] and quality.character_counts(["a1_€", ""]).tolist() == [[4, 1, 2, 1], [0, 0, 0, 0]]


def test_published_rules():
    """Each published threshold leaves its reason; those that prose breaks too decide nothing."""
    reasons = lambda text: set(quality.measure([text])[1][0])
    assert "few_words" in reasons("The end.") and quality.measure(["The end."])[2] == ["prose"] and "stop_words" in reasons("El modelo crece.")
    assert "bullet_lines" in reasons("- a thing\n- more\n- last") and "ellipsis_lines" in reasons("so it goes…\nand on...") and "symbols_per_word" in reasons("# # a b")
    assert "long_mean_word" in reasons("abcdefghijklmno pqrstuvwxyzabcd") and "short_mean_word" in reasons("a b c d") and "alphabetic_words" in reasons("1 2 3 x") and "placeholder" in reasons("x { y") and "repeated_lines" in reasons("a\na\na") and "unmarked_lines" in reasons("no mark")
    whole, alone = quality.measure([PROSE, None, "- a\n- b", PROSE]), [quality.measure([t]) for t in (PROSE, None, "- a\n- b", PROSE)]
    assert whole[2] == [x[2][0] for x in alone] and all(whole[0][n].tolist() == [x[0][n][0] for x in alone] for n in whole[0])


FORMS = {
    "Ｏｍａｒ": "Omar", "José": "José", "O’Neil": "O'Neil", "Ana Cruz": "Ana Cruz", "Jean‑Luc": "Jean-Luc", "Of​fice": "Office", "Oﬃce": "Office",
    "Оmаr Bell": "Omar Bell", "Универcитет": "Университет", "Πανεπιστήμιo": "Πανεπιστήμιο", "𝖬ina": "Mina",
}
PLAIN = ["Omar", "José", "Łódź", "Москва", "Πανεπιστήμιο", "研究院", "", "a  b", "St Mary's", None]


def test_canonical_text(spark):
    df = spark.createDataFrame([(k, "r", "o") for k in [*FORMS, *PLAIN]], "item string, row string, ordinary string")
    got = {r["item"]: r["x"] for r in lookalike.canonical_text(df, "item", "x").collect()}
    assert got == {**FORMS, **{p: p for p in PLAIN}}
    assert lookalike.canonical_text(df.limit(0), "item", "ordinary").count() == 0


def test_odd_items(spark):
    author = '{"first_name":"Om%sr","last_name":"Bell","position":%s}'
    rows = [
        (1, "[" + author % ("а", 1) + "," + author % ("a", 2) + "]", ["Uni­versity", "Université", None]), (2, '[{"first_name":"а', []), (3, None, None), (4, "", ["x"]),
        (5, '[{"first_name":null,"last_name":"\\uff21","position":3}]', ["ok"]), (6, '{"first_name":"аx"}', []),
    ]
    df = spark.createDataFrame(rows, "rec_id bigint, authors_std string, institutions array<string>").withColumn("item", F.lit(1))
    assert sorted((r["rec_id"], r["field_name"], r["item_pos"]) for r in lookalike.odd_items(df).collect()) == [(1, "authors_std", 1), (1, "institutions", 1), (5, "authors_std", 3)]


SAMPLES = {
    "en": "the model shows how prices of the houses change when rules are new and agents learn from their neighbours",
    "de": "das Modell zeigt wie sich die Preise der Häuser ändern wenn die Regeln neu sind und die Agenten lernen",
    "fr": "le modèle montre comment les prix des maisons changent quand les règles sont nouvelles et les agents apprennent",
}


@pytest.fixture(scope="module")
def filters():
    rng = random.Random(1)
    rows = []
    for lang, text in SAMPLES.items():
        words = text.split()
        for k in range(60):
            start = rng.randrange(len(words) - 6)
            wrong = k % 12 == 0
            rows.append(("de" if wrong and lang == "en" else lang, " ".join(words[start : start + 8])))
    return language.LanguageFilters.fit(rows)


def test_segments(filters):
    names = filters.config.languages
    of = lambda t: [names[x] if x >= 0 else None for x, _ in filters.segments([t])[0]]
    assert of(SAMPLES["en"]) == ["en"] and of(SAMPLES["de"]) == ["de"] and of(SAMPLES["fr"]) == ["fr"]
    assert of(f"{SAMPLES['en']}. {SAMPLES['fr']} (12 / 3). {SAMPLES['en']}.") == ["en", "fr", "en"]
    assert of(f"{SAMPLES['de']} / {SAMPLES['en']}") == ["de", "en"] and of("") == [] and of(" \n") == [] and of("42 ???") == [None]
    assert language.LanguageFilters.fit([]).segments(["xyz"]) is not None


def test_wrong_labels(spark, filters):
    rows = [(1, "en", SAMPLES["en"], None), (2, "de", SAMPLES["en"], ""), (3, "und", SAMPLES["fr"], SAMPLES["fr"]), (4, "en", SAMPLES["en"], SAMPLES["de"]), (5, None, "", None), (6, " EN ", SAMPLES["en"], "42")]
    df = spark.createDataFrame(rows, "rec_id bigint, lang string, title string, abstract string").withColumn("field_name", F.lit(0))
    found = language.wrong_labels(language.text_languages(df, filters, "rec_id", ["title", "abstract"], "lang"))
    assert sorted((r["rec_id"], r["field_name"], r["seg_no"], r["lang"]) for r in found.collect()) == [(2, "title", 1, "en"), (3, "abstract", 1, "fr"), (3, "title", 1, "fr"), (4, "abstract", 1, "de"), (4, "title", 1, "en")]
    fitted = language.fit_filters(df, "lang", ["title", "abstract"], "rec_id")
    assert language.text_languages(df.limit(0), fitted, "rec_id", ["title", "abstract"], "lang").count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 3), (7, 3), (300, 4), (2000, 30)):
        text = rng.integers(1, sigma, n)
        full = np.append(text, 0).astype(np.int64)
        assert leakage.suffix_array(full, max(1, int(sigma - 1).bit_length())).tolist() == sorted(range(n + 1), key=lambda i: full[i:].tolist())
        index = leakage.FMIndex(text, sigma, 4)
        for _ in range(15):
            at = int(rng.integers(0, n))
            p = text[at : at + int(rng.integers(1, 5))]
            low, high = index.search(p[None, :].astype(np.int64))
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]
    same = np.ones(64, np.int64)
    assert leakage.suffix_array(np.append(same, 0), 1).tolist() == list(range(64, -1, -1))


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    items = [(i, " ".join(f"{word()} {word()}, the" for _ in range(25))) for i in range(1, 6)] + [(9, None), (10, " ")]
    first = items[0][1].split()
    third = " ".join(first[20:52])
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (1, f"{noise(40)} {items[0][1]} {noise(40)}"), (1, f"{noise(40)} {items[0][1]} {noise(40)}"), (2, third.upper().replace(",", "") + " " + noise(9)), (3, " ".join(first[:9]) + noise(50)), (4, None), (5, ""),
        (6, items[1][1].replace(" ", " [3] ", 4) + "\n\n" + noise(30) + items[2][1]), (7, noise(20000)),
    ]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("share", F.lit(0))
    held = spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.leaks(corpus, held, leakage.LeakConfig(shard_words=500)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (6, 2), (6, 3)]
    whole = next(r for r in found if r["doc_id"] == 1)
    assert [docs[k][1][s.start : s.end] for k, s in [(0, whole["spans"][0])]][0][:20] == items[0][1][:20]
    assert leakage.leaks(corpus, held.limit(0)).count() == 0 and leakage.leaks(corpus.limit(0), held).count() == 0
    blocks = leakage.leaks(corpus, held, leakage.LeakConfig(block_words=100))
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == sorted((r["doc_id"], r["item_id"]) for r in found)


@pytest.mark.parametrize("block_words", [10, 150, 2_000_000])
def test_shared_passages(spark, block_words):
    """A document that holds what two items share is reported for both, however the items are parted; texts of the same pattern are not."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    half, pattern = text(33), "between {} and {} per cent of {} switch before {} sets in and the {} of {} does not change when {} are {}"
    items = [(1, half + " " + text(37)), (2, half + " " + text(37)), (3, text(60))] + [(10 + k, pattern.format(*(word() for _ in range(8)))) for k in range(20)]
    docs = [(1, text(20) + " " + half + " " + text(20)), (2, pattern.format(*(word() for _ in range(8)))), (3, " ".join(items[2][1].split()[10:34]) + " " + text(9)), (4, " ".join(reversed(items[2][1].split())))]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), leakage.LeakConfig(block_words=block_words))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (1, 2), (3, 3)]


def test_order_is_heaviest():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.randrange(8), rng.randrange(8), 3, rng.choice([0.5, 1.0])) for _ in range(rng.randint(1, 9))]
        best = max((sum(r[3] for r in part) for n in range(10) for part in itertools.combinations(rows, n) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(sorted(part), sorted(part)[1:]))), default=0)
        assert abs(sum(r[3] for r in leakage._in_order(rows)) - best) < 1e-9


def test_poisson_table():
    config = mixing.MixConfig(bins=200)
    table = mixing.poisson_table(config, 3)
    rates = np.geomspace(config.least_rate, config.most_rate, 200)
    assert np.allclose(table[1], np.exp(-rates) * (1 + rates)) and (np.diff(table, axis=1) <= 1e-12).all()


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, "big" if i % 10 else "small", "word " * rng.randint(5, 60)) for i in range(900)] + [(9001, None, "word"), (9002, "big", None), (9003, "big", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("m", "big", 0.6, 3), ("m", "small", 0.4, 3), ("m", "none", 0.1, 2), ("m", "small", 0.4, 3), (None, "big", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, targets)
    shares = {(r["mix_id"], r["source"]): r for r in mix.shares.collect()}
    assert abs(shares["m", "big"]["actual_share"] - 0.6) < 0.005 and abs(shares["m", "small"]["actual_share"] - 0.4) < 0.005
    assert shares["m", "none"]["actual_share"] == 0 and shares["m", "small"]["actual_tokens"] == 3 * shares["m", "small"]["held_tokens"]
    rows = mix.rows.collect()
    assert max(r["copy_no"] for r in rows) <= 3 and len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert sum(r["n_tokens"] for r in rows if r["source"] == "big") == shares["m", "big"]["actual_tokens"]
    assert mixing.mix_sources(df.limit(0), targets).rows.count() == 0
