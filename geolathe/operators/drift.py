"""Schemas that drift between the files of a feed.

Every payload is parsed once into (path, type, value in one written form). Per file the fields and their types are
counted; each file is compared with the one of the next older release: a value-carrying evidence for every pair of a gone
and a fresh field is counted over the ids both files hold, and a tree edit distance between the two nested schemas turns
it into the cheapest script of adds, deletes, renames and moves. The scripts, followed through a feed, say which column
each path of each file belongs to; compiled to projections they read all files into one table.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolathe.functions.treedit import edit_script
from geolathe.session import materialize, ship

PRESENT = 0.2  # a file has a field if at least this share of its records hold a value
CARRIED = 0.75  # a field is renamed if at least this share of common ids carry an equal value
STEP = "\x1f"

FIELD = "struct<path:string,kind:string,value:string,raw:string>"
RECORD = f"feed string, release string, file_name string, line_no bigint, ingested_at timestamp, id string, fields array<{FIELD}>"
_FIELD = pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("raw", pa.string())])

_number = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


def written(v) -> str:
    """One form for a value however it is written: numbers as numbers, lists and paths by their steps, truth values and text trimmed."""
    if isinstance(v, list):
        return STEP.join(written(x) for x in v)
    if isinstance(v, dict):
        return STEP.join(f"{k}={written(x)}" for k, x in sorted(v.items()))
    if isinstance(v, bool):
        return "true" if v else "false"
    if v is None:
        return ""
    if isinstance(v, (int, float)):
        return _num(float(v)) if abs(v) < 1e300 else str(v)
    s = " ".join(v.split())
    if ">" in s:
        return STEP.join(written(x) for x in s.split(">"))
    if _number.fullmatch(s):
        return _num(float(s))
    return s.lower() if s.lower() in ("true", "false") else s


def _num(f: float) -> str:
    return f"{f:.10g}" if math.isfinite(f) else str(f)


def _kind(v) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "array" if isinstance(v, list) else "string"


def flatten(o: dict, at: str = "") -> Iterator[tuple[str, object]]:
    """Paths down to non-null values that aren't objects."""
    stack = [(at, o)]
    while stack:
        at, d = stack.pop()
        for k, v in d.items():
            p = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((p, v))
            elif v is not None:
                yield p, v


def _read(payload):
    try:
        o = json.loads(payload)
    except (ValueError, TypeError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def records(raw: DataFrame) -> DataFrame:
    """The readable records: one per (file_name, line_no); of several payloads of one line the first readable in order of text."""
    ship(raw.sparkSession)
    lines = raw.where(F.col("file_name").isNotNull()).groupBy("file_name", "line_no").agg(F.max(F.struct("ingested_at", "feed", "release")).alias("m"), F.array_sort(F.collect_set("payload")).alias("payloads"))
    lines = lines.select("m.feed", "m.release", "file_name", F.col("line_no").cast("long").alias("line_no"), "m.ingested_at", "payloads")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, ids, fields = [], [], []
            for i, payloads in enumerate(b.column("payloads").to_pylist()):
                o = next((o for p in payloads if (o := _read(p)) is not None), None)
                if o is None:
                    continue
                keep.append(i)
                v = o.pop("id", None)
                ids.append(None if v is None else written(v))
                fields.append([(p, _kind(x), written(x), x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for p, x in flatten(o)])
            at = pa.array(keep, pa.int64())
            flat = [x for f in fields for x in f]
            cols = list(zip(*flat)) if flat else [[], [], [], []]
            offsets = [0]
            for f in fields:
                offsets.append(offsets[-1] + len(f))
            values = pa.StructArray.from_arrays([pa.array([_utf8(x) for x in c], pa.string()) for c in cols], fields=list(_FIELD))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(at) for c in ("feed", "release", "file_name", "line_no", "ingested_at")), pa.array([None if x is None else _utf8(x) for x in ids], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                names=["feed", "release", "file_name", "line_no", "ingested_at", "id", "fields"],
            )

    return lines.mapInArrow(parse, RECORD)


def _utf8(s: str) -> str:
    """Lone surrogates, which JSON may hold, as question marks."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-8", "replace").decode()


def _release_key(c):
    """By date, then by number, so that .10 follows .9."""
    return F.struct(F.split(c, r"\.")[0], F.try_to_number(F.regexp_extract(c, r"\.(\d+)$", 1), F.lit("999999999")), c)


def schemas(recs: DataFrame) -> DataFrame:
    """feed, file_name, prev_file, fields map<path, kind>, prev_fields: each file's schema beside that of the next older release."""
    files = recs.groupBy("file_name").agg(F.max("feed").alias("feed"), F.max("release").alias("release"), F.count("*").alias("n"))
    counted = recs.select("file_name", F.explode("fields").alias("f")).groupBy("file_name", "f.path", "f.kind").agg(F.count("*").alias("m"))
    # Repeated paths cannot occur in one record, so the sum over kinds is the number of records with a value.
    by_path = counted.groupBy("file_name", "path").agg(F.sum("m").alias("m"), F.max_by("kind", F.struct("m", "kind")).alias("kind"))
    has = by_path.join(files.select("file_name", "n"), "file_name").where(F.col("m") >= PRESENT * F.col("n") - 1e-9)
    fields = has.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("path", "kind"))).alias("fields"))
    w = Window.partitionBy("feed").orderBy(_release_key(F.col("release")), "file_name")
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    full = files.join(fields, "file_name", "left").withColumn("fields", F.coalesce("fields", empty))
    return full.select("feed", "release", "file_name", "n", "fields", F.lag("file_name").over(w).alias("prev_file"), F.lag("fields").over(w).alias("prev_fields"))


def scripts(recs: DataFrame, files: DataFrame) -> DataFrame:
    """feed, file_name, prev_file, change_kind, old_path, field_path for each edit; renames across parents have kind 'moved'."""
    pairs = files.where(F.col("prev_file").isNotNull())
    gone = F.array_except(F.map_keys("prev_fields"), F.map_keys("fields"))
    fresh = F.array_except(F.map_keys("fields"), F.map_keys("prev_fields"))
    open_ = pairs.select("file_name", "prev_file", gone.alias("gone"), fresh.alias("fresh")).where((F.size("gone") > 0) & (F.size("fresh") > 0))
    pick = lambda names: F.transform(F.filter("fields", lambda f: F.array_contains(names, f["path"])), lambda f: F.struct(f["path"].alias("path"), f["value"].alias("value")))
    merge = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731  # records that repeat an id
    with_id = recs.where(F.col("id").isNotNull()).select("file_name", "id", "fields")
    new = with_id.join(open_.select("file_name", "fresh"), "file_name").select("file_name", "id", pick(F.col("fresh")).alias("now")).groupBy("file_name", "id").agg(merge("now").alias("now"))
    old = with_id.withColumnRenamed("file_name", "prev_file").join(open_, "prev_file").select("file_name", "id", pick(F.col("gone")).alias("was")).groupBy("file_name", "id").agg(merge("was").alias("was"))
    both = new.join(old, ["file_name", "id"]).select("file_name", "id", F.explode("was").alias("a"), "now").select("file_name", "id", "a", F.explode("now").alias("b"))
    # Per id a pair of paths counts once and is equal if any of its values are.
    per_id = both.groupBy("file_name", "id", F.col("a.path").alias("a"), F.col("b.path").alias("b")).agg(F.max((F.col("a.value") == F.col("b.value")).cast("int")).alias("same"))
    share = per_id.groupBy("file_name", "a", "b").agg(F.avg("same").alias("s")).where(F.col("s") >= CARRIED - 1e-9)
    share = share.groupBy("file_name").agg(F.collect_list(F.struct("a", "b", "s")).alias("share"))
    todo = pairs.join(share, "file_name", "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ev = {(s["a"], s["b"]): s["s"] for s in r["share"] or []}
                out += [(r["feed"], r["file_name"], r["prev_file"], *e) for e in edit_script(dict(r["prev_fields"]), dict(r["fields"]), ev)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["feed", "file_name", "prev_file", "change_kind", "old_path", "field_path"])

    return todo.select("feed", "file_name", "prev_file", "fields", "prev_fields", "share").mapInArrow(compare, "feed string, file_name string, prev_file string, change_kind string, old_path string, field_path string")


def changes(raw: DataFrame) -> DataFrame:
    """(file_name, field_path, change_kind): every change of a file against the next older release of its feed.

    raw: file_name, feed, release, line_no, payload, ingested_at; others are ignored. Unreadable payloads (null, empty, cut
    off, no object) are no records; lines repeated under one file_name and line_no are one. Empty tables give no rows.
    """
    recs = materialize(records(raw), "records")
    files = materialize(schemas(recs), "schemas")
    kind = F.when(F.col("change_kind") == "moved", "renamed").otherwise(F.col("change_kind"))
    return scripts(recs, files).select("file_name", "field_path", kind.alias("change_kind")).distinct()


FIXED = ("name", "category", "hierarchy", "confidence", "lon", "lat")
# The paths under which a column is known from the start; all others follow from the scripts.
SEEDS = {"name": ("name",), "category": ("category",), "hierarchy": ("hierarchy",), "confidence": ("confidence",), "lon": ("lon",), "lat": ("lat",)}


def lineage(edits: DataFrame) -> DataFrame:
    """path, column, n: every path that carries a fixed column in any file, by following renames and moves from its seed, and by how many files it is tied to it.

    Renames are counted over all feeds as (old path, new path); a path belongs to the column it is tied to by most files.
    The table is one row per distinct path that was ever renamed, far below the data; it is spread by repeated joins.
    """
    spark = edits.sparkSession
    e = edits.where(F.col("change_kind").isin("renamed", "moved")).groupBy("old_path", "field_path").agg(F.count("*").alias("n"))
    e = materialize(e.select(F.col("old_path").alias("a"), F.col("field_path").alias("b"), "n").unionAll(e.select("field_path", "old_path", "n")).groupBy("a", "b").agg(F.sum("n").alias("n")), "edges")
    known = spark.createDataFrame([(p, c, 1 << 40) for c, ps in SEEDS.items() for p in ps], "path string, column string, n bigint")
    size = 0
    while (n := known.count()) != size:
        size = n
        step = known.join(e, known.path == e.a).select(F.col("b").alias("path"), "column", F.least(known.n, e.n).alias("n"))
        best = known.unionAll(step).groupBy("path", "column").agg(F.max("n").alias("n"))
        known = materialize(best.groupBy("path").agg(F.max_by("column", F.struct("n", "column")).alias("column"), F.max("n").alias("n")), "lineage")
    return known.select("path", "column", "n")


def projections(files: DataFrame, edits: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_name, projection map<column, path>): each feed's scripts compiled to one projection per file.

    A feed's fields are followed from file to file through its own scripts. All paths of one field vote for its column by
    `paths`, so a path that other feeds use for something else does not mislead. A feed has a few files, so it is one group.
    """
    has = files.select("feed", "file_name", "prev_file", F.explode(F.map_keys("fields")).alias("path"))
    carried = edits.where(F.col("change_kind").isin("renamed", "moved")).select("file_name", F.col("field_path").alias("path"), F.col("old_path"))
    rows = has.join(carried, ["file_name", "path"], "left").join(paths, "path", "left")

    def compile_feed(t: pa.Table) -> pa.Table:
        by_file: dict[str, list[dict]] = {}
        after: dict[str | None, list[str]] = {}
        for r in sorted(t.to_pylist(), key=lambda r: (r["file_name"], r["path"])):
            if r["file_name"] not in by_file:
                after.setdefault(r["prev_file"], []).append(r["file_name"])
            by_file.setdefault(r["file_name"], []).append(r)
        # A file's predecessor may have no field at all and so no row.
        todo = [f for p, fs in after.items() if p not in by_file for f in fs]
        of: dict[tuple[str, str], int] = {}
        votes: list[dict[str, int]] = []
        for f in todo:
            for r in by_file[f]:
                field = of.get((r["prev_file"], r["old_path"] or r["path"]))
                if field is None:
                    field = len(votes)
                    votes.append({})
                of[f, r["path"]] = field
                if r["column"]:
                    votes[field][r["column"]] = votes[field].get(r["column"], 0) + r["n"]
            todo += after.get(f, [])
        best = [max(((n, c) for c, n in v.items()), default=(0, None)) for v in votes]
        took: dict[tuple[str, str], tuple[int, str]] = {}
        for (f, path), field in sorted(of.items()):
            n, c = best[field]
            if c and n > took.get((f, c), (0, ""))[0]:
                took[f, c] = (n, path)
        keys = sorted(took)
        return pa.table({"file_name": pa.array([f for f, _ in keys], pa.string()), "column": pa.array([c for _, c in keys], pa.string()), "path": pa.array([took[k][1] for k in keys], pa.string())})

    compiled = rows.groupBy("feed").applyInArrow(compile_feed, "file_name string, column string, path string")
    return compiled.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("column", "path"))).alias("projection"))


def unified(raw: DataFrame) -> DataFrame:
    """One table of all readable records with fixed columns id, name, category, hierarchy, confidence, lon, lat.

    Each file gets a projection: for each column the path of the file's own schema that carries it (the record's own paths
    where the file has none); lists and texts of category and hierarchy become "a > b", numbers in text become numbers, what is
    no number becomes NULL.
    """
    recs = materialize(records(raw), "records")
    files = materialize(schemas(recs), "schemas")
    edits = materialize(scripts(recs, files), "scripts")
    r = recs.join(projections(files, edits, lineage(edits)), "file_name", "left")
    by_path = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["path"], f)))
    r = r.withColumn("by_path", by_path)
    got = {c: F.try_element_at("by_path", F.coalesce(F.try_element_at("projection", F.lit(c)), F.lit(c))) for c in FIXED}
    steps = lambda c: F.replace(got[c]["value"], F.lit(STEP), F.lit(" > "))
    number = lambda c: got[c]["value"].try_cast("double")
    return r.select(
        "feed", "release", "file_name", "line_no", "id", got["name"]["raw"].alias("name"), steps("category").alias("category"), steps("hierarchy").alias("hierarchy"),
        number("confidence").alias("confidence"), number("lon").alias("lon"), number("lat").alias("lat"), "ingested_at",
    )
