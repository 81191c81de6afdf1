"""Variant spellings of one organisation's, practice's or person's business name within a site.

Method: a trie join of the words of all names, then a check of the names word by word, in any order. The distinct words are
sharded by length and hash; the tries of two shards are traversed together by the Levenshtein automaton and give all words
within the allowed edits. How often words stand in names tells a misspelling from a word of its own: a word is a spelling
of the nearest one that is far more frequent than slips are, two frequent words are two words however near, and rare words
near each other may be one. A long word may be two run together; its beginnings and ends meet the other words in tries, too.
Names of a site that share two words so resolved, and their numbers, meet and are held against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolathe.llm.glyphs import TWINS, with_forms
from geolathe.llm.trie import allowed, near_words, run_together
from geolathe.session import discard, materialize, ship

# Given names and what people call them.
NICKNAMES = """alexander alex xander sasha sandy sascha alejandro
alexandra alex sasha sandra
andreas andy andi
anna annie anni nina
anthony tony ant
antonio tonio toni antonio
benjamin ben benny benni benji
catherine cathy kate katie kitty cat
charles charlie chuck carl
charlotte lotte charlie lottie charly lotti
christine chris tina christa
christopher chris kit topher
daniel dan danny
david dave davy
dolores lola loli lolita
dorothea dora thea doro
edward ed eddie ted ned
elisabeth liz lisa beth betty sissi elsa lisbeth elli bess lizzie eliza
elizabeth liz lisa beth betty elsa bess lizzie eliza
emmanuel manu manny
francisco paco pancho curro kiko fran frasco
frederick fred freddy fritz
friedrich fritz fred friedel freddy fiete
gabriel gabe gabi
guadalupe lupe lupita guada
guillermo memo guille
heinrich heinz heiner henry
henry harry hank hal
ignacio nacho iggy
james jim jimmy jamie
jesus chucho chuy
johannes hans hannes jan jo johann hansi
john jack johnny jon
joseph joe joey jo sepp
josefa pepa pepi josefina fina sefa
josephine josie jo fifi josy josefine pepi
jose pepe
juan juanito
katherine kate kathy katie kitty kat kathi kay
karl charly kalle
leonard leo len lenny
ludwig lutz lude wiggerl luggi louis ludo
luis lucho
margaret peggy maggie meg greta marge margie madge daisy peg
maria mari mia mitzi
matthew matt
michael mike mick mikey micha michel mickey
nicholas nick nicky
patricia pat patty trish
peter pete
philip phil pip
rebecca becky
richard rick dick richie rich
robert rob bob bobby robbie bert
rosa rosi rosita
samuel sam sammy
stephen steve
susan sue susie
theodora thea dora theo teddy dori
theodor theo ted
theresa terry tess resi
thomas tom tommy
victoria vicky vic tori
walter walt
wilhelm willi willy wim
william bill will billy liam willy"""
# Titles, legal forms and other words that do not tell one place from another.
NOISE = set(
    "dr prof professor mr mrs ms mme mlle m herr frau sr sra don dona dipl ing med dent co company ltd limited inc llc corp group gmbh ag kg ohg ug mbh sa sas sarl srl sl spa bv nv plc pty cia cie und and et y e the main old new branch hq fam "
    "ong ba tien si bs ths gs tap doan cty ooo zao oao ip gruppa".split()
)
REMARK = re.compile(r"\([^()\d]{1,20}\)|,\s*[a-z]{2}\W*$|(?<!\w)\d+-(?=[^\W\d])")  # "(main)", ", de", the number in "2-wheel"
_word = re.compile(r"[^\W_]+")


def _twins() -> tuple[dict[str, str], dict[str, str]]:
    to_latin = {}
    for p in TWINS.split():
        if p[1].isascii() and p[1].isalpha() and p[0].isalpha():
            to_latin[p[0]] = p[1]
    to_cyr = {}
    for a, b in to_latin.items():
        if "Ѐ" <= a <= "ӿ" and a not in "ЬҮүӀӏԌԚԜԁԛԝһѕіјЅІЈ":
            to_cyr.setdefault(b, a)
    return to_latin, to_cyr


TO_LATIN, TO_CYRILLIC = _twins()
_MIX = {ord(k): v for k, v in TO_LATIN.items()}
_BACK = {ord(k): v for k, v in TO_CYRILLIC.items()}


class _Plain(dict):
    """What str.translate makes of a character behind NFKD: marks and invisible signs go, letters that do not come apart become plain. Filled as characters are met."""

    def __missing__(self, c: int):
        self[c] = None if unicodedata.category(chr(c)) in ("Cf", "Cc", "Mn") and chr(c) not in "\t\n\r" else c
        return self[c]


_PLAIN = _Plain({ord(k): v for k, v in {"đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "ı": "i", "'": None, "’": None}.items()})
_foreign = re.compile("[^\x00-\u024f]")


def fold(name: str) -> str:
    """Lower case without accents; wide and joined letters plain, invisible signs gone, look-alike letters in the script of their word."""
    if name.isascii():
        return name.lower().replace("'", "")
    s = unicodedata.normalize("NFKD", name).translate(_PLAIN)
    if _foreign.search(s):
        own = [c for c in s if ("Ѐ" <= c <= "ӿ") and c not in TO_LATIN]
        latin = sum(c.isascii() and c.isalpha() for c in s)
        s = s.translate(_BACK) if len(own) > latin // 2 and own else s.translate(_MIX)
    return s.casefold()


def words_of(name: str) -> tuple[list[str], tuple[str, ...]]:
    """Words and numbers of a name; bracketed remarks and signs are left out."""
    t = fold(name)
    if "(" in t or "," in t or "-" in t:
        t = REMARK.sub(" ", t)
    words, numbers = [], []
    for w in _word.findall(t):
        if w.isalpha():
            words.append(w)
        elif w.isdigit():
            numbers.append(w.lstrip("0") or "0")
        elif any(map(str.isdigit, w)):
            numbers.append(w)
        else:
            words.append(w)
    return words, tuple(sorted(numbers))


_formal: dict[str, set[str]] = defaultdict(set)
for _line in NICKNAMES.splitlines():
    _f, *_short = _line.split()
    for _n in _short:
        _formal[_n].add(_f)
    _formal[_f].add(_f)


def same_given(a: str, b: str) -> bool:
    """Equal up to nickname or initial."""
    if a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b)):
        return True
    if _formal.get(a, set()) & _formal.get(b, set()):
        return True
    return (len(a) == 1 and any(f.startswith(a) for f in _formal.get(b, ()))) or (len(b) == 1 and any(f.startswith(b) for f in _formal.get(a, ())))


@lru_cache(1 << 16)
def distance(a: str, b: str, bound: int = 3) -> int:
    """Edit distance with swaps of neighbours as one edit, up to bound + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > bound:
            return bound + 1
        two, one = one, row
    return one[-1]


def short_for(a: str, b: str) -> bool:
    """Whether a may be an abbreviation of the word b: same first letter, letters of b in order, shorter."""
    if not a or not b or a[0] != b[0] or len(a) >= len(b):
        return False
    it = iter(b)
    return all(c in it for c in a)


class Lexicon:
    """Common words of the corpus: those of a kind of business, short ones that tell nothing, and others."""

    def __init__(self, kinds: set[str], others: set[str] = frozenset(), noise: set[str] = frozenset()):
        self.kinds, self.others, self.noise = kinds, others, noise


Senses = dict[str, tuple[tuple[str, ...], list[frozenset[str]]]]  # word -> words it may be a spelling of, pairs it may run together


class Name:
    """A name taken apart. `senses` says what a word may stand for, where that is not itself alone: the words it is a spelling of, and pairs of words it runs together. A word that can only be the spelling of one other is read as that."""

    __slots__ = ("all", "words", "numbers", "kinds", "rest", "spells", "runs")

    def __init__(self, words: list[str], numbers: tuple[str, ...], lex: Lexicon, senses: Senses | None = None):
        self.all, self.numbers = words, tuple(numbers)
        self.words, self.kinds, self.rest, self.spells, self.runs = [], [], [], [], []
        read = [(w, *(senses or {}).get(w, ((w,), ()))) for w in words]
        read = [(one[0] if len(one) == 1 else w, one, two) for w, one, two in read]
        for w, one, two in [r for r in read if r[0] not in NOISE and r[0] not in lex.noise] or read:
            self.words.append(w)
            if any(x in lex.kinds for x in one):
                self.kinds.append(w)
            else:
                self.rest.append(w)
                self.spells.append(frozenset(one))
                self.runs.append(two)

    def proper(self, i: int) -> bool:
        """Whether a word of rest can tell two names apart: no short word and no given name."""
        return len(self.rest[i]) >= 4 and not any(x in _formal for x in self.spells[i])

    def keys(self) -> set[str]:
        """Every two proper words the name may hold, with its numbers."""
        at = [i for i in range(len(self.rest)) if self.proper(i)]
        two = {(x, y) for k, i in enumerate(at) for j in at[k + 1 :] for x in self.spells[i] for y in self.spells[j]}
        two |= {tuple(sorted(p)) * (2 // len(p)) for r in self.runs for p in r}
        return {" ".join((min(p), max(p), *self.numbers)) for p in two}


def _explained(u: list[str], other: Name, own: Name) -> list[str]:
    """Words of u that are no spelling or abbreviation of a kind of business, of the other name or their own."""
    both = other.kinds + own.kinds
    initials = "".join(w[0] for w in other.kinds)
    spelt = "".join(w[0] for w in other.all)  # with the words that tell nothing, in their places
    if len(u) > 1 and any(short_for("".join(u), k) for k in other.kinds):
        return []
    left = []
    for w in u:
        if 1 < len(w) <= 5 and initials and (w in spelt or (len(w) <= 4 and all(c in initials for c in w))):
            continue
        if len(w) == 1 and other.kinds and any(k.startswith(w) for k in other.kinds) and not own.kinds[:1] == other.kinds[:1]:
            continue
        if any(distance(w, k, 2) <= allowed(k) or short_for(w, k) or (w[:4] == k[:4] and 4 < len(w) < len(k)) for k in both if len(w) > 1):
            continue
        left.append(w)
    return left


def same(a: Name, b: Name, lex: Lexicon) -> bool:
    """Whether two names are spellings of one: equal numbers, two proper words in common, and nothing left of either but kinds of business and given names that agree."""
    if a.numbers != b.numbers:
        return False
    pairs = sorted((x != y, abs(i - j), i, j) for i, x in enumerate(a.rest) for j, y in enumerate(b.rest) if x == y or a.spells[i] & b.spells[j])
    left_a, left_b, strong = set(range(len(a.rest))), set(range(len(b.rest))), 0
    for _, _, i, j in pairs:
        if i in left_a and j in left_b:
            left_a.discard(i)
            left_b.discard(j)
            strong += a.proper(i) and b.proper(j)
    # Words run together: one word of a name is two of the other, in either order, or of both.
    for one, two, li, lj in ((a, b, left_a, left_b), (b, a, left_b, left_a)):
        for i in sorted(li):
            for want in one.runs[i]:
                held = [[k for k in sorted(lj) if w in two.spells[k]] for w in want]
                if len(held) == 1:
                    held *= 2
                if hit := next(((p, q) for p in held[0] for q in held[1] if p != q), None):
                    li.discard(i)
                    lj -= set(hit)
                    strong += 2
                    break
    for i in sorted(left_a):
        if j := next((j for j in sorted(left_b) if any(r in b.runs[j] for r in a.runs[i])), None):
            left_a.discard(i)
            left_b.discard(j)
            strong += 2
    if strong < 2:
        return False
    ua = _explained([a.rest[i] for i in sorted(left_a)], b, a)
    ub = _explained([b.rest[j] for j in sorted(left_b)], a, b)
    for x in list(ua):
        for y in ub:
            if same_given(x, y):
                ua.remove(x)
                ub.remove(y)
                break
    given = lambda u: all(x in _formal or len(x) == 1 for x in u)
    if (ua and ub) or not given(ua) or not given(ub):
        # A kind of business may be misspelt across its blanks: what is left of both names is compared as one string.
        ra = "".join(w for w in a.words if w in lex.kinds or w in [a.rest[i] for i in left_a])
        rb = "".join(w for w in b.words if w in lex.kinds or w in [b.rest[j] for j in left_b])
        if not (a.kinds or b.kinds) or min(len(ra), len(rb)) < 4 or distance(ra, rb, 2) > (1 if max(len(ra), len(rb)) < 6 else 2):
            return False
    return True


COMMON = 0.0005  # share of all names from which a word is common; so at most (words per name) / COMMON words are
COMMON_LEAST = 10
TELLS_KIND = 0.4  # nats by which the categories of a word's names differ from those of all names
OWN = 15  # names from which on a word is one of its own unless it is a slip of one far more frequent
TIMES = 4  # a slip is so many times rarer than its word at least,
SLIP_ONE, SLIP_TWO = 0.01, 0.001  # and of one edit, or two, at most this share of it, or SLIP_FEW names
SLIP_FEW = {1: 4, 2: 2}
BLOCK = 10_000  # words of one length in a shard of the tries


TEXTS = T.ArrayType(T.StringType())


def parsed(names: DataFrame) -> DataFrame:
    """names with the columns words and numbers of its column name."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [words_of(n) for n in b.column("name").to_pylist()]
            some = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w for w, _ in both], some), pa.array([list(n) for _, n in both], some)], names=[*b.schema.names, "words", "numbers"])

    return names.mapInArrow(parse, T.StructType([*names.schema, T.StructField("words", TEXTS), T.StructField("numbers", TEXTS)]))


def lexicon(names: DataFrame, words: DataFrame) -> Lexicon:
    """Learns the common words. names: words, category, one row per name; words: word, n, from how many names. Collects the common words only, whose number is bounded by COMMON, and counts of categories."""
    total, k = names.agg(F.count("*"), F.count_distinct("category")).first()
    common = [r["word"] for r in words.where(F.col("n") >= max(COMMON_LEAST, COMMON * total)).select("word").collect()]
    # The word NULL stands for all names of a category.
    held = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.array_distinct("words"), lambda w: w.isin(common)))
    by = names.where("category is not null").select(F.explode(held).alias("word"), "category").groupBy("word", "category").agg(F.count("*").alias("n"))
    own = Window.partitionBy("word")
    each = by.select("word", "category", "n", F.sum("n").over(own).alias("m"))
    base = each.where("word is null").select("category", (F.col("n") / F.col("m")).alias("p"))
    d = each.where("word is not null").join(base, "category").groupBy("word").agg(F.sum(F.col("n") / F.col("m") * F.log(F.col("n") / F.col("m") / F.col("p"))).alias("d"), F.max("m").alias("m"))
    # The expected divergence of a word that has nothing to do with categories is (k - 1) / 2m; it is taken off.
    found = {r["word"]: r["d"] - (k - 1) / (2 * r["m"]) for r in d.collect()}
    kinds = {w for w in common if found.get(w, 0.0) > TELLS_KIND}
    noise = {w for w in common if w not in kinds and len(w) <= 3}
    return Lexicon(kinds, set(common) - kinds - noise, noise)


def _cells(words: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """words with its length and, where more than BLOCK have one length, the number k of blocks and the own block c; and the lengths with their k."""
    w = words.withColumn("len", F.length("word"))
    k = w.groupBy("len").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    return w.join(k, "len").withColumn("c", F.pmod(F.xxhash64("word"), F.col("k")).cast("int")), k


def near_table(words: DataFrame) -> DataFrame:
    """(x, y, d, nx, ny), x < y: all words within the allowed edits of each other. words: word, distinct, of 4 letters and more, and n.

    A shard is a block of the words of one length; every two blocks of lengths at most two apart meet in a task of their own.
    """
    w, k = _cells(words.select("word", "n"))
    lens = k.select(F.col("len").alias("lb"), F.col("k").alias("kb"))
    near = F.col("lb").between(F.col("len") - 2, F.col("len") + 2)
    # A word stands on the left of its cells with blocks of its length or more, on the right of those with less.
    to = w.join(lens, near).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    own, other = F.struct("len", "c"), F.struct(F.col("lb").alias("len"), F.col("cb").alias("c"))
    cells = to.select("word", "n", F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), (own <= other).alias("left")).withColumn("alone", F.col("lo") == F.col("hi"))

    def meet(t: pa.Table) -> pa.Table:
        side: tuple[list, list] = ([], [])
        n = dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist()))
        for word, left in zip(t.column("word").to_pylist(), t.column("left").to_pylist()):
            side[not left].append((0, word))
        rows = near_words(side[0]) if t.column("alone")[0].as_py() else near_words(side[0], side[1])
        x, y = [min(r[1], r[2]) for r in rows], [max(r[1], r[2]) for r in rows]
        cols = {"x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "d": pa.array([int(r[3]) for r in rows], pa.int32())}
        return pa.table(cols | {"nx": pa.array([n[v] for v in x], pa.int64()), "ny": pa.array([n[v] for v in y], pa.int64())})

    return cells.groupBy("lo", "hi").applyInArrow(meet, "x string, y string, d int, nx bigint, ny bigint")


def spelling_table(near: DataFrame) -> DataFrame:
    """(word, one array<string>): what a word may stand for. near: as near_table gives it.

    A word that is as rare as a slip beside a word one edit away stands for that word, or several such. Any other word stands for
    itself; a rare one also for the rare words near it, and for frequent ones two edits away of which it may be a slip. What
    is a slip itself is no word to be a slip of. Words not listed stand for themselves only.
    """
    rarer = (F.col("ny") >= TIMES * F.col("nx")) & (F.col("nx") <= F.when(F.col("d") == 1, F.greatest(F.lit(SLIP_FEW[1]), SLIP_ONE * F.col("ny"))).otherwise(F.greatest(F.lit(SLIP_FEW[2]), SLIP_TWO * F.col("ny"))))
    kind = F.when(rarer & (F.col("d") == 1), 1).when(rarer & (F.col("ny") >= OWN), 2).when((F.col("nx") < OWN) & (F.col("ny") < OWN), 3)
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "d", F.col("ny").alias("nx"), F.col("nx").alias("ny")))
    both = materialize(both.select("x", "y", kind.alias("kind")).where("kind is not null"), "near")
    slips = both.where("kind = 1").select(F.col("x").alias("y")).distinct()
    of = both.join(slips, "y", "left_anti").groupBy("x").agg(F.collect_set(F.when(F.col("kind") == 1, F.col("y"))).alias("sure"), F.collect_set(F.when(F.col("kind") > 1, F.col("y"))).alias("may"))
    return of.select(F.col("x").alias("word"), F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.concat(F.array("x"), "may")).alias("one"))


def run_table(words: DataFrame, spells: DataFrame) -> DataFrame:
    """(word, two array<struct<x, y>>): long rare words that are two others run together, each within its allowed edits and both within two. words: word, n; spells: word, one."""
    slips = spells.where(~F.array_contains("one", F.col("word"))).select("word")
    own = words.join(slips, "word", "left_anti")
    wholes = own.where((F.length("word") >= 8) & (F.col("n") < OWN))
    (w, k), (p, kp) = _cells(wholes.select("word")), _cells(own.select("word"))
    # Every block of wholes meets every block of the words that may be a part of it.
    a = w.select("word", "len", "c", F.lit(True).alias("whole")).join(kp.select(F.col("len").alias("lb"), F.col("k").alias("kb")), F.col("lb") <= F.col("len") - 2).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    b = p.select("word", F.col("len").alias("lb"), F.col("c").alias("cb"), F.lit(False).alias("whole")).join(k.select("len", "k"), F.col("lb") <= F.col("len") - 2).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = a.select("word", "whole", "len", "c", "cb").unionByName(b.select("word", "whole", "len", "c", "cb"))

    def meet(t: pa.Table) -> pa.Table:
        side: tuple[list, list] = ([], [])
        for word, whole in zip(t.column("word").to_pylist(), t.column("whole").to_pylist()):
            side[whole].append((0, word))
        rows = [(*r, kind) for kind, rs in enumerate(run_together(*side)) for r in rs]
        cols = [[r[i] for r in rows] for i in range(1, 6)]
        return pa.table({n: pa.array(c, ty) for n, c, ty in zip(("word", "cut", "part", "d", "kind"), cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))})

    ends = materialize(cells.groupBy("len", "c", "cb").applyInArrow(meet, "word string, cut int, part string, d int, kind int"), "ends")
    h = ends.where("kind = 0").select("word", "cut", F.col("part").alias("x"), "d")
    t = ends.where("kind = 1").select("word", "cut", F.col("part").alias("y"), F.col("d").alias("e"))
    return h.join(t, ["word", "cut"]).where("d + e <= 2").groupBy("word").agg(F.collect_set(F.struct(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).alias("two"))


def sense_table(words: DataFrame) -> DataFrame:
    """(word, one, two): the words that do not only stand for themselves, see spelling_table and run_table. words: word, n."""
    long = words.where(F.length("word") >= 4)
    spells = materialize(spelling_table(near_table(long)), "spells")
    return materialize(spells.join(run_table(long, spells), "word", "full"), "senses")


KEYED = "site string, look string, words array<string>, numbers array<string>, senses array<struct<word:string,one:array<string>,two:array<struct<x:string,y:string>>>>"


def _senses(rows) -> Senses:
    return {r["word"]: (tuple(r["one"] or (r["word"],)), [frozenset((p["x"], p["y"])) for p in r["two"] or ()]) for r in rows or ()}


def near_names(names: DataFrame) -> DataFrame:
    """(site, a, b), a < b: the looks of a site whose names `same` links. names: site, look, words, numbers, category; several names may look the same."""
    words = materialize(names.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    lex = lexicon(names, words)
    senses = sense_table(words)
    common = sorted(lex.kinds | lex.others | lex.noise)
    # Common words are known here; only those that are spellings of others, and all that are not common, are looked up.
    settled = sorted(set(common) - {r["word"] for r in senses.where(F.col("word").isin(common)).select("word").collect()})
    ask = names.select("site", "look", F.explode(F.filter(F.array_distinct("words"), lambda w: (F.length(w) >= 4) & ~w.isin(settled))).alias("word"))
    found = ask.join(senses, "word").groupBy("site", "look").agg(F.collect_list(F.struct("word", "one", "two")).alias("senses"))

    dull = NOISE | lex.noise
    skip = dull | lex.kinds | set(_formal)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key = [], []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("words", "numbers", "senses")))):
                if row[2] or dull.issuperset(row[0]):
                    k = Name(row[0], row[1], lex, _senses(row[2])).keys()
                else:  # the same for words that stand for themselves only
                    own = sorted(w for w in row[0] if len(w) > 3 and w not in skip)
                    k = {" ".join((*p, *row[1])) for p in combinations(own, 2)}
                at += [i] * len(k)
                key += k
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(key, pa.string())], names=[*b.schema.names, "key"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken: dict[str, Name] = {}
            ok, cols = [], {c: b.column(c).to_pylist() for c in b.schema.names}

            def of(i: int, side: str) -> Name:
                x = cols[side][i]  # noqa: B023
                if x not in taken:  # noqa: B023
                    taken[x] = Name(cols[side + "words"][i], cols[side + "numbers"][i], lex, _senses(cols[side + "senses"][i]))  # noqa: B023
                return taken[x]  # noqa: B023

            site = None
            for i, s in enumerate(cols["site"]):
                if s != site:
                    taken.clear()
                    site = s
                ok.append(same(of(i, "a"), of(i, "b"), lex))
            yield b.select(["site", "a", "b"]).filter(pa.array(ok, pa.bool_()))

    k = names.select("site", "look", "words", "numbers").join(found, ["site", "look"], "left").mapInArrow(keyed, KEYED + ", key string")
    side = lambda s: k.select("site", "key", F.col("look").alias(s), *(F.col(c).alias(s + c) for c in ("words", "numbers", "senses")))
    met = side("a").join(side("b"), ["site", "key"]).where("a < b").drop("key")
    return met.mapInArrow(linked, "site string, a string, b string").distinct()


def variants(places: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: two ids of one site whose names are spellings of the same organisation, practice or business.

    places: id, site, name, category; others are ignored. Null ids, sites and names give no rows, nor do empty and blank
    names. Names that look the same or differ in case only are no pair. Repeated rows count once; empty tables give no rows.
    Links between spellings are closed: spellings tied over a third one are a pair too.
    """
    ship(places.sparkSession)
    p = places.select("id", "site", "name", "category").where(F.col("id").isNotNull() & F.col("site").isNotNull() & (F.length(F.trim("name")) > 0))
    distinct = p.groupBy("site", "name").agg(F.max("category").alias("category"))
    looks = with_forms(distinct, form="name").withColumn("look", F.lower("form")).where(F.length("look") > 0)
    looks = materialize(parsed(looks.select("site", "name", "look", "category")), "looks")
    families = closed(materialize(near_names(looks), "links"))
    a, b = families.withColumnRenamed("look", "la"), families.withColumnRenamed("look", "lb")
    pairs = a.join(b, ["site", "family"]).where("la < lb").select("site", "la", "lb")
    tied = looks.select("site", "look", "name").join(families.select("site", "look"), ["site", "look"], "left_semi")
    members = materialize(p.select("id", "site", "name").join(tied, ["site", "name"]).select("site", "look", "id").distinct(), "members")
    ids = pairs.join(members.select("site", F.col("look").alias("la"), F.col("id").alias("x")), ["site", "la"]).join(members.select("site", F.col("look").alias("lb"), F.col("id").alias("y")), ["site", "lb"])
    return ids.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def closed(links: DataFrame) -> DataFrame:
    """(site, look, family): components of the links by least label, jumping to the label's label; a few rounds, as families are small."""
    edges = materialize(links.unionAll(links.select("site", F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    kept = label = materialize(edges.groupBy("site", "a").agg(F.least(F.min("b"), F.col("a")).alias("family")), "labels")
    while True:
        seen = edges.join(label.select("site", F.col("a").alias("b"), "family"), ["site", "b"]).groupBy("site", "a").agg(F.min("family").alias("near"))
        new = label.join(seen, ["site", "a"]).select("site", "a", F.least("family", "near").alias("family"), (F.col("near") < F.col("family")).alias("moved"))
        new = materialize(new, "labels")
        moved = new.where("moved").limit(1).count()
        discard(kept)
        kept, label = new, new.drop("moved")
        if not moved:
            return label.withColumnRenamed("a", "look")
