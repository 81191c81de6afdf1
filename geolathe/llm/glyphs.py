"""One form for text that looks alike, in DuckDB SQL inside Arrow partitions.

The form keeps case, accents, raised and circled digits; it maps look-alike letters, wide and narrow forms and joined
letters to plain ones, drops what has no visible shape, writes any run of white space as one space and composes accents.
Two texts look the same exactly if their forms are equal. The form is meant for comparison: a word in Cyrillic keeps
those of its letters that have no Latin twin and gets the Latin twin of the others, on both sides alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolathe.session import ship

# Letters of other scripts that are drawn like a Latin letter or a digit, each followed by its twin.
TWINS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ЬЬ ӀI ԌG ԚQ ԜW "
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ҮY үy "
    "ЀÈ ЁË ЇÏ ѐè ёë їï "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϳj ϲc οo "
    "ΪÏ ΫŸ "
    "ÐĐ ƉĐ ‐- ‑- ‒- −- ՕO օo ѡw ɑa ɡg ᴏo ᴄc ᴠv ᴡw ᴢz ꜱs ｡。"
)
# Joined letters and their plain forms (beside those Unicode calls a small ligature).
JOINED = {"Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
# RE2 classes. Controls that are white space stay for SPACE.
HIDDEN = r"[\p{Cf}\x{0}-\x{8}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]+"
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}\x{2800}]+"


def _tables() -> tuple[str, str, dict[str, str]]:
    """From, to (one character each) and the joined letters, by rule from the Unicode tables."""
    one, many = {}, dict(JOINED)
    for c in (*range(0x3000, 0x3001), *range(0xFB00, 0xFB18), *range(0xFE30, 0xFE70), *range(0xFF00, 0xFFF0)):
        tag, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if tag in ("<wide>", "<narrow>", "<compat>") and rest:
            plain = "".join(chr(int(x, 16)) for x in rest.split())
            if tag == "<compat>" and "LIGATURE" not in unicodedata.name(chr(c), ""):
                continue
            if len(plain) == 1 and plain != " ":
                one[chr(c)] = plain
            elif len(plain) > 1:
                many[chr(c)] = plain
    # Letters drawn joined in Arabic (presentation forms) stand for the plain letters.
    for c in (*range(0xFB50, 0xFDFE), *range(0xFE70, 0xFEFD)):
        tag, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if tag in ("<initial>", "<medial>", "<final>", "<isolated>") and len(rest) == 4:
            one[chr(c)] = chr(int(rest, 16))
    for pair in TWINS.split():
        if pair[0] != pair[1]:
            one[pair[0]] = pair[1]
    one = {k: one.get(v, v) for k, v in one.items()}  # a wide look-alike
    # An accented letter whose bare letter has a twin is drawn like the twin with the accent.
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, mark = (unicodedata.decomposition(chr(c)).split(" ") + [""])[:2]
        if mark and not base.startswith("<") and (twin := one.get(chr(int(base, 16)))):
            whole = unicodedata.normalize("NFC", twin + chr(int(mark, 16)))
            if len(whole) == 1:
                one.setdefault(chr(c), whole)
    return "".join(one), "".join(one.values()), many


PLAIN = "^[!-~]+( [!-~]+)*$"  # visible ASCII with single blanks between, its own form


_q = lambda s: "'" + s.replace("'", "''") + "'"


def form_sql(col: str) -> str:
    """A DuckDB expression for the one form of `col`; NULL for NULL."""
    a, b, many = _tables()
    e = f"regexp_replace({col}, {_q(HIDDEN)}, '', 'g')"
    # NFC first turns letters with accents into single ones that the tables know; after the tables it runs again.
    e = f"translate(nfc_normalize({e}), {_q(a)}, {_q(b)})"
    joined = f"regexp_matches({e}, {_q('[' + ''.join(many) + ']')})"
    r = e
    for k, v in many.items():
        r = f"replace({r}, {_q(k)}, {_q(v)})"
    e = f"CASE WHEN {joined} THEN {r} ELSE {e} END"
    e = f"regexp_replace({e}, 'ı([\\x{{300}}-\\x{{314}}])', 'i\\1', 'g')"
    return f"trim(regexp_replace(nfc_normalize({e}), {_q(SPACE)}, ' ', 'g'))"


def with_forms(df: DataFrame, **cols: str) -> DataFrame:
    """df with new columns, each the one form of a text column: with_forms(df, form="name"). NULL stays NULL, empty and blank text become ''."""
    ship(df.sparkSession)
    names = df.columns
    # The SQL sees the distinct texts of a batch that are not plain.
    sql = f"SELECT v, {form_sql('v')} AS f FROM src"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        for b in batches:
            arrays, fields = list(b.columns), list(b.schema)
            for new, old in cols.items():
                v = b.column(b.schema.get_field_index(old)).cast(pa.string()).dictionary_encode()
                rest = v.dictionary.filter(pc.invert(pc.match_substring_regex(v.dictionary, PLAIN)))
                con.register("src", pa.table({"v": rest}))
                forms = con.sql(sql).to_arrow_table()
                con.unregister("src")
                by = dict(zip(forms.column("v").to_pylist(), forms.column("f").to_pylist()))
                out = pa.array([by.get(x, x) for x in v.dictionary.to_pylist()], pa.string()).take(v.indices)
                arrays.append(out)
                fields.append(pa.field(new, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    schema = T.StructType([*df.schema.fields, *(T.StructField(new, T.StringType()) for new in cols)])
    return df.select(*names).mapInArrow(run, schema)


def look_alikes(review: DataFrame, places: DataFrame) -> DataFrame:
    """(review_seq, id): reviews whose name differs from the place's as a string but looks the same.

    review: review_seq, id, name; places: id, name; others are ignored. Reviews of ids no place has, and null names, give no
    rows; repeated rows count once; empty tables give no rows.
    """
    r = review.select("review_seq", "id", F.col("name").alias("a")).where(F.col("a").isNotNull())
    p = places.select("id", F.col("name").alias("b")).where(F.col("b").isNotNull())
    both = r.join(p, "id").where(F.col("a") != F.col("b")).distinct()
    return with_forms(both, fa="a", fb="b").where(F.col("fa") == F.col("fb")).select("review_seq", "id").distinct()
