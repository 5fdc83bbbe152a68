"""Cover density against all stretches tried, and Portuguese stems."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import search


def brute(text, alternatives):
    """Every stretch that has all items of an alternative and holds no shorter such stretch."""
    words = text.split()
    items = [[x.split() for x, yes in own if yes] for own in alternatives]
    asked = {w for own in items for x in own for w in x}
    inside = lambda p, q, x: any(words[i : i + len(x)] == x for i in range(p, q - len(x) + 2))
    full = lambda p, q: any(all(inside(p, q, x) for x in own) for own in items if own)
    total = 0.0
    for p, q in itertools.combinations_with_replacement(range(len(words)), 2):
        if full(p, q) and not full(p + 1, q) and not full(p, q - 1):
            total += 0.1 / (1 + sum(w not in asked for w in words[p : q + 1]))
    return round(total, 6)


@pytest.mark.parametrize("query", ["a", "a b", '"a b"', '"a b" c', "a b or c", '"a b a" or "c c" d -z', "a b c d", '"a a"', "-a"])
def test_covers(spark, query):
    rng = random.Random(query)
    rows = [(i, " ".join(rng.choice("abcdexy") for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "a"), (503, "b a b"), (502, "a")]
    alternatives = search.parsed(query)
    docs = spark.createDataFrame(rows, "id long, text string")
    ranks = docs.select("id", "text", F.round(search.cover_rank(search.folded(F.col("text")), alternatives), 6).alias("r")).collect()
    assert [r.r for r in ranks] == [brute(t or "", alternatives) for _, t in rows]
    found = [(r.id, r.score) for r in search.ranked(docs, query, 200).collect()]
    padded = lambda t: f" {t or ''} "
    fits = lambda t: any(all((f" {x} " in padded(t)) == yes for x, yes in own) for own in alternatives)
    assert found == sorted(((i, brute(t or "", alternatives)) for i, t in rows if fits(t)), key=lambda r: (-r[1], r[0]))


def test_near_words_rank_higher(spark):
    docs = spark.createDataFrame([(1, "saldo da conta"), (2, "conta de luz e depois o saldo"), (3, "saldo " + "x " * 50 + "conta"), (4, "conta saldo conta saldo")], "id long, text string")
    assert [r.id for r in search.ranked(docs, "conta saldo").collect()] == [4, 1, 2, 3]


FAMILIES = [
    "informação informações", "animal animais", "papel papéis", "lençol lençóis", "funil funis", "homem homens", "mulher mulheres", "luz luzes", "casa casas", "pão pães",
    "rápido rápida rápidos rapidamente", "trabalho trabalhos trabalhar trabalhando trabalhado trabalhou trabalham trabalhava", "vender vendendo vendido vendeu", "conta contas contar",
]


def test_inflected_words_meet(spark):
    for family in FAMILIES:
        folded = family.translate(str.maketrans(search.MARKED, search.PLAIN)).split()
        assert len({search.stem_of(w) for w in folded}) == 1, family
    docs = spark.createDataFrame([(i, f) for i, f in enumerate(FAMILIES)], "id long, text string")
    assert [r.id for r in search.ranked(docs, "mulheres", stemming=True).collect()] == [6]
    assert [r.id for r in search.ranked(docs, "trabalhando", stemming=True).collect()] == [11]
    assert [r.id for r in search.ranked(docs, '"rapidamente rapido"', stemming=True).collect()] == [10]
    assert [r.id for r in search.ranked(docs, '"rapida casas"', stemming=True).collect()] == []
    assert search.ranked(docs, "carro", stemming=True).count() == 0


def test_expression_and_word_agree(spark):
    words = "a de os mais anzois trens meses lapis assim dificilmente amou comeu partiu maria strasse straße ideia x2 oes".split()
    found = spark.createDataFrame([(" " + " ".join(words) + " ",)], "t string").select(search.stemmed(F.col("t"))).first()[0]
    assert found.split() == [search.stem_of(w.replace("ß", "ss")) for w in words]


def test_listed_words_have_the_stem():
    rng = random.Random(4)
    ends = [e for own in search.SHED for e in own]
    words = {rng.choice(["", "x", "ca", "mor", "papel", "re2", "luz"]) + rng.choice(["", "a", "il", "ss"]) + "".join(rng.choices(ends, k=rng.randrange(4))) for _ in range(6000)} - {""}
    of = {s: search.inflected(s) for s in set(map(search.stem_of, words))}
    assert all(w in of[search.stem_of(w)] for w in words)
    assert all(search.stem_of(w) == s for s in rng.sample(sorted(of), 60) for w in of[s])


def fold(text):
    plain = (text or "").lower().translate(str.maketrans(search.MARKED, search.PLAIN))
    return " " + re.sub("[^a-z0-9ß]+", " ", plain).strip() + " "


@pytest.mark.parametrize("query", ["the that", '"of the" that -moron or shin', '"a a"', "straße or ção", "-the", "sso or ss"])
def test_texts_as_typed(spark, query):
    rng = random.Random(query)
    words = ["of", "the", "The", "thé", "OF", "that", "thats", "moron", "shins", "Shin", "a", "Á", "straße", "strasse", "ção", "cao", "ß", "SSO", "ßo", "x2", "ofthe", "\u212aelvin", "\u0130", "\U0001f600"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "_", "\n", "\u00a0", "\u0301", "-"]) for _ in range(rng.randrange(30)))) for i in range(150)] + [(200, None), (201, ""), (202, "the"), (203, "that\x00the")]
    docs, alternatives = spark.createDataFrame(rows, "id long, text string"), search.parsed(query)
    for stemming in (False, True):
        own = search.stems(alternatives) if stemming else alternatives
        held = lambda t, own=own: any(all((f" {x} " in t) == yes for x, yes in a) for a in own)
        texts = {i: " ".join(search.stem_of(w.replace("ß", "ss")) for w in fold(t).split()) if stemming else fold(t).strip() for i, t in rows}
        firm = lambda t, a: all(f" {w[:search.FIRM]}" in fold(t).replace("ß", "ss") for x, yes in a if yes for w in x.replace("ß", "ss").split())
        expected = [(i, brute(texts[i], own)) for i, t in rows if held(f" {texts[i]} ") and (not stemming or any(firm(t, a) for a in alternatives))]
        assert [tuple(r) for r in search.ranked(docs, query, 300, stemming).collect()] == sorted(expected, key=lambda r: (-r[1], r[0]))
    wanted = list(dict.fromkeys(x for a in alternatives for x, yes in a if yes))
    count = lambda t: sum(t.replace(" ", "  ").count(f" {x.replace(' ', '  ')} ") for x in wanted)
    expected = [(i, count(fold(t))) for i, t in rows if any(all((f" {x} " in fold(t)) == yes for x, yes in a) for a in alternatives)]
    assert [tuple(r) for r in search.websearch(docs, query, 300).collect()] == sorted(expected, key=lambda r: (-r[1], r[0]))


def lowers(df):
    return df._jdf.queryExecution().executedPlan().toString().count("lower(")  # noqa: SLF001


def test_texts_are_lowered_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert lowers(search.websearch(docs, '"a b" -c or d')) == 1
    for stemming in (False, True):
        assert lowers(search.ranked(docs, '"a b" -c or d', stemming=stemming)) == 1
        assert search.ranked(docs, "", stemming=stemming).count() == 0
