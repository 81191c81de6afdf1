"""Name variants: the trie against brute force, word rules, families, chains, chunks and dirty rows."""

import random

import pytest

from geolathe.llm import names as N
from geolathe.llm import trie
from geolathe.llm.names import Lexicon, Name, distance, same, same_given, variants, words_of


def osa(a, b):
    two, p = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            v = min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            c.append(v)
        two, p = p, c
    return p[-1]


def words(r, letters, low, high, n):
    return sorted({(r.randint(0, 2), "".join(r.choice(letters) for _ in range(r.randint(low, high)))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_tries_equal_brute_force(seed, monkeypatch):
    r = random.Random(seed)
    if seed > 3:
        monkeypatch.setattr(trie, "STATES", 50)
    some, other = (words(r, "ab" if seed % 2 else "abc", 3, 9, 150) for _ in range(2))
    near = lambda x, y: osa(x, y) <= min(trie.allowed(x), trie.allowed(y))
    assert sorted(trie.near_words(some)) == sorted((g, x, y, osa(x, y)) for g, x in some for h, y in some if g == h and x < y and near(x, y))
    assert sorted(trie.near_words(some, other)) == sorted((g, x, y, osa(x, y)) for g, x in some for h, y in other if g == h and x != y and near(x, y))
    assert trie.near_words([]) == [] and trie.near_words(some, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_run_together_equals_brute_force(seed):
    r = random.Random(seed)
    parts, wholes = words(r, "ab", 3, 8, 120), words(r, "ab", 7, 14, 60)
    want = [[], []]
    for g, w in wholes:
        for k, p in parts:
            for c in range(4, len(w) - 3):
                if g == k and len(p) >= 4:
                    for i, piece in enumerate((w[:c], w[c:])):
                        if osa(p, piece) <= trie.allowed(p):
                            want[i].append((g, w, c, p, osa(p, piece)))
    heads, tails = trie.run_together(parts, wholes)
    assert sorted(heads) == sorted(want[0]) and sorted(tails) == sorted(want[1])


LEX = Lexicon({"coffee", "house", "school", "primary", "ca", "phe"}, {"zebotem", "levenal", "lekebal", "lelevam"})
PAIRS = [
    ("Zebotem Rusulath Coffee House", "ZEBOTEM RUSULATH COFFEE HOUSE *", True), ("Zebotem Rusulath Coffee House", "Coffee House Rusulath Zebotem", True), ("Zebotem Rusulath Coffee House", "Zebotm Rusulaht Coffee Hse", True), ("Zebotem Rusulath Coffee House", "ZebotemRusulath Coffee House", True),
    ("Zebotem Rusulath Coffee House", "Zebotem Rusulath", True), ("Alexander Zebotem Rusulath Coffee House", "Sasha Zebotem Rusulath CH", True), ("Alexander Zebotem Rusulath Coffee House", "A. Zebotem Rusulath Coffee House", True), ("Cà phê Lelevam Lekebal", "Ca phe Lekebal Lelevam", True),
    ("Zebotem Rusulath Coffee House", "Zebotem Kibralix Coffee House", False), ("Zebotem Rusulath Coffee House 1", "Zebotem Rusulath Coffee House 2", False), ("Alexander Zebotem Rusulath School", "Benjamin Zebotem Rusulath School", False), ("Zebotem Rusulath Coffee House", "Levenal Rusulath Coffee House", False),
    ("Alexander Zebotem Rusulath", "Alexander Levenal Kibralix", False), ("Coffee House", "Coffee House Zebotem", False),
]


SENSES = {"zebotm": (("zebotem",), []), "rusulaht": (("rusulath",), []), "zebotemrusulath": (("zebotemrusulath",), [frozenset(("zebotem", "rusulath"))])}


@pytest.mark.parametrize("a,b,want", PAIRS)
def test_same(a, b, want):
    x, y = (Name(*words_of(n), LEX, SENSES) for n in (a, b))
    assert same(x, y, LEX) is want and same(y, x, LEX) is want
    assert not want or x.keys() & y.keys()


def test_words():
    assert words_of("Ｃafé Сoffее-Hоuse ① (main), DE") == (["cafe", "coffee", "house"], ("1",))
    assert words_of("НАЧАЛЬНАЯ Школа")[0] == words_of("начальная школа")[0]
    assert distance("fezalind", "fzealind") == 1 and distance("abc", "abc") == 0 and distance("a", "abcdef", 2) == 3
    assert same_given("bob", "robert") and same_given("r", "robert") and not same_given("bob", "william")


P = "id string, site string, name string, category string, look string, family string"


def people(n, site="s"):
    r = random.Random(5)
    syl = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    pool = ["zebotem", "levenal", "lekebal", "fedavim"]
    kinds = [("coffee house", "cafe"), ("primary school", "school"), ("dental practice", "dentist"), ("pharmacy", "drug")]
    out = []
    for i in range(n):
        k, c = kinds[i % 4]
        out.append((f"i{i:05d}", site, f"{pool[i // 4 % 4]} {''.join(r.choice(syl) for _ in range(4))}x {k}".title(), c, "", ""))
    return out


def test_families_in_a_site(spark, rows, monkeypatch):
    base = people(400)
    w = base[10][2].split()
    extra = [("v1", "s", base[10][2].upper(), "cafe", "", ""), ("v2", "s", " ".join(w[2:] + w[1::-1]), "drug", "", ""), ("v3", "s", f"{w[0]}{w[1]} {' '.join(w[2:])}", None, "", ""), ("v4", "other", f"{w[1]} {w[0]}", "cafe", "", "")]
    extra += [("n1", "s", base[20][2] + " 1", "x", "", ""), ("n2", "s", base[20][2] + " 2", "x", "", ""), (None, "s", base[10][2], "x", "", ""), ("z", None, base[10][2], "x", "", ""), ("y", "s", None, "x", "", ""), ("e", "s", "", "x", "", ""), ("e2", "s", " ​ ", "x", "", "")]
    df = spark.createDataFrame(base + extra + extra, P)
    # i00010 and v1 differ in case only and are no pair; each pairs with both spellings, which pair with each other.
    want = sorted([("i00010", "v2"), ("i00010", "v3"), ("v1", "v2"), ("v1", "v3"), ("v2", "v3")])
    assert rows(variants(df)) == want
    monkeypatch.setattr(N, "BLOCK", 40)
    assert rows(variants(df)) == want


def test_empty(spark, rows):
    assert rows(variants(spark.createDataFrame([], P))) == []


def test_rare_words_of_which_one_is_near_a_common_word(spark, rows):
    # lovenel is within two edits of the common levenal, lovenels is not.
    extra = [("a", "s", "Lovenel Kibratix", "cafe", "", ""), ("b", "s", "Lovenels Kibratix", "cafe", "", "")]
    assert rows(variants(spark.createDataFrame(people(400) + extra, P))) == [("a", "b")]


def test_frequent_words_near_each_other_are_two_words(spark, rows):
    extra = [(f"f{i:02d}", "s", f"{w} {'bcdfghklmnprstvz'[i]}{'aeiou'[i % 5]}{'bdgklmnprstvz'[i % 13]}o{'klmnprs'[i % 7]}ar cafe", "cafe", "", "") for w in ("fedarim", "fedamir") for i in range(16)]
    # One more name shares a word with each; slips of the frequent word are read as it.
    extra += [("x", "t", "Fedarim Kibratix", "cafe", "", ""), ("y", "t", "Fedamir Kibratix", "cafe", "", ""), ("z", "t", "Fedarrim Kibratix", "cafe", "", "")]
    assert rows(variants(spark.createDataFrame(extra, P)).where("id_a > 'g'")) == [("x", "z")]


def test_spelling_and_run_tables(spark, rows):
    words = spark.createDataFrame([("fedarim", 60), ("fedamir", 60), ("fedarrim", 2), ("kibratix", 3), ("kibratixx", 2), ("fedarimkibratix", 1), ("kibratifedarrim", 1)], "word string, n bigint")
    spells = N.spelling_table(N.near_table(words))
    assert {(w, tuple(sorted(o))) for w, o in rows(spells)} == {("fedarrim", ("fedarim",)), ("kibratix", ("kibratix", "kibratixx")), ("kibratixx", ("kibratix", "kibratixx"))}
    two = {w: {tuple(p) for p in t} for w, t in rows(N.run_table(words, spells))}
    assert ("fedarim", "kibratix") in two["fedarimkibratix"] and ("fedarim", "kibratix") in two["kibratifedarrim"]


def test_blocks_of_one_length_meet(spark, rows, monkeypatch):
    r = random.Random(3)
    some = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 8))) for _ in range(300)})
    want = sorted((x, y, osa(x, y)) for x in some for y in some if x < y and osa(x, y) <= min(trie.allowed(x), trie.allowed(y)))
    words = spark.createDataFrame([(w, len(w)) for w in some], "word string, n bigint")
    assert rows(N.near_table(words), "x", "y", "d") == want
    monkeypatch.setattr(N, "BLOCK", 20)
    assert rows(N.near_table(words), "x", "y", "d") == want


def test_near_names_equal_all_pairs(spark, rows):
    """Every two names of a site that `same` links are found, those of dull words and with senses among them."""
    names = ["Zebotem Rusulath Cafe", "Rusulath-Zebotem", "Zebotem Rusulat Cafe", "The Main Gruppa", "Gruppa Main Limited", "Anna Zebotem Kibratix 3", "Kibratix Zebotem 3", "Kibratix Zebotem 4", "Zebotem Zebotem", "Nagofim Dulorep Sitakum", "Sitakum Dulorep Nagofim"]
    data = [("s", n.lower(), n, "x") for n in names] + [("t", names[0].lower(), names[0], "x")]
    df = N.parsed(spark.createDataFrame(data, "site string, look string, name string, category string"))
    words = df.select(N.F.explode(N.F.array_distinct("words")).alias("word")).groupBy("word").agg(N.F.count("*").alias("n"))
    lex, senses = N.lexicon(df, words), N._senses(N.sense_table(words).collect())
    taken = [Name(*words_of(n), lex, {w: v for w, v in senses.items() if w in words_of(n)[0]}) for n in names]
    want = sorted(("s", *sorted((a.lower(), b.lower()))) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if same(taken[i], taken[j], lex))
    assert len(want) >= 3 and rows(N.near_names(df)) == want
