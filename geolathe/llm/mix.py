"""Mixing sources to target weights, in tokens of a public tokenizer.

Of a plan, every source is to give target_share of total_ratio times all tokens. A source with S tokens that shall give W
uses each of its documents W / S times on average, at most max_repeats times: floor(W / S) times for certain, and the
fraction is rounded by pivotal dependent rounding. Two documents' fractions meet; token mass moves from one to the other
until one of them is 0 or 1, in a random direction whose odds leave both expectations as they are. The mass of all fractions
stays what it was, so a source misses its target by less than one document. Each bucket of a source leaves at most one
open document; these meet again level by level in a reduction tree until one is left, which a coin decides.

A source that is too small gives all it may; the others keep their own target and do not fill its gap, so the mix falls
short by that amount. Both the share of the wanted size and the share of the mix as it became are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.llm.encode import TOKENIZER, codec
from geolathe.session import materialize, ship

EPS = 1e-9
STATE = "plan_name string, source string, bucket bigint, doc_id bigint, tokens bigint, base bigint, p double"


def token_counts(docs: DataFrame, *, tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """doc_id, source, tokens of each document; 0 for a null or empty text."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, folder)
        for b in batches:
            n = [len(c.enc.encode_to_numpy(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return d.mapInArrow(count, "doc_id long, source string, tokens long")


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds the fractions p of items of mass w to 0 or 1 with sum(p * w) unchanged, but for one item that may stay open; gives its index or -1."""
    out = p.copy()
    u = rng.random(len(p))
    i = -1
    for j in range(len(p)):
        if not EPS < out[j] < 1 - EPS:
            out[j] = round(out[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = out[i], out[j]
        up = min((1 - a) * w[i], b * w[j])  # mass that can move from j to i
        down = min(a * w[i], (1 - b) * w[j])  # and from i to j
        if u[j] * (up + down) < down:
            a, b = a + up / w[i], b - up / w[j]
        else:
            a, b = a - down / w[i], b + down / w[j]
        a = 0.0 if a < EPS else 1.0 if a > 1 - EPS else a
        b = 0.0 if b < EPS else 1.0 if b > 1 - EPS else b
        out[i], out[j] = a, b
        i = i if 0 < a < 1 else j if 0 < b < 1 else -1
    return out, i


def _round_group(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what stays open at the end is then small, and so is the distance to the target.
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        key = f"{seed}|{pdf.plan_name.iloc[0]}|{pdf.source.iloc[0]}|{pdf.bucket.iloc[0]}|{len(pdf)}|{last}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(key))
        p, open_ = pivot(pdf["p"].to_numpy(float), pdf["tokens"].to_numpy(float), rng)
        if last and open_ >= 0:
            p[open_] = float(rng.random() < p[open_])
        return pdf.assign(p=p)

    return run


def mix(counts: DataFrame, targets: DataFrame, *, seed: int = 42, bucket_rows: int = 20_000, fan_in: int = 32) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: plan_name, source, doc_id, tokens, uses >= 1. shares: one row per plan and source of targets with
    target_share, max_repeats, supply_tokens, wanted_tokens, reached_tokens, chosen_docs, uses, reached_share (of the mix as it
    became) and share_of_wanted (of the wanted size).

    counts: doc_id, source, tokens; targets: plan_name, source, target_share, max_repeats, total_ratio. Documents without a
    source or without tokens are never chosen, but all tokens count for the size. Sources without documents reach 0. A null
    share, cap or ratio counts as 0. Several target rows of one plan and source are added up, with the highest cap.
    """
    counts = materialize(counts.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")), "tokens")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = targets.groupBy("plan_name", "source").agg(F.sum(z("target_share")).alias("target_share"), F.max(z("max_repeats")).cast("long").alias("max_repeats"), F.max(z("total_ratio")).alias("total_ratio"))
    usable = counts.where(F.col("source").isNotNull() & (F.col("tokens") > 0))
    supply = usable.groupBy("source").agg(F.sum("tokens").alias("supply_tokens"))
    t = t.join(supply, "source", "left").withColumns({"supply_tokens": F.coalesce("supply_tokens", F.lit(0)), "wanted_tokens": F.col("target_share") * F.col("total_ratio") * F.lit(total)})
    copies = F.least(F.col("max_repeats").cast("double"), F.col("wanted_tokens") / F.nullif(F.col("supply_tokens"), F.lit(0)))
    t = materialize(t.withColumn("copies", F.coalesce(copies, F.lit(0.0))), "targets")

    buckets = max(1, -(-n // bucket_rows))
    rows = usable.join(t.where("copies > 0").select("plan_name", "source", "copies"), "source")
    base = F.floor(F.col("copies") + EPS)
    rows = rows.select("plan_name", "source", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "tokens", base.alias("base"), F.greatest(F.col("copies") - base, F.lit(0.0)).alias("p"))
    level = materialize(rows.groupBy("plan_name", "source", "bucket").applyInPandas(_round_group(seed, buckets == 1), STATE), "round")
    done = [level.where("p = 0 or p = 1")]
    while buckets > 1:
        buckets = -(-buckets // fan_in)
        open_ = level.where("p > 0 and p < 1").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        level = materialize(open_.groupBy("plan_name", "source", "bucket").applyInPandas(_round_group(seed, buckets == 1), STATE), "round")
        done.append(level.where("p = 0 or p = 1"))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    chosen = all_.select("plan_name", "source", "doc_id", "tokens", (F.col("base") + F.col("p").cast("long")).alias("uses")).where("uses > 0")
    got = chosen.groupBy("plan_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached_tokens"), F.count("*").alias("chosen_docs"), F.sum("uses").alias("uses"))
    s = t.drop("copies").join(got, ["plan_name", "source"], "left").fillna(0, ["reached_tokens", "chosen_docs", "uses"])
    whole = s.groupBy("plan_name").agg(F.sum("reached_tokens").alias("mix_tokens"))
    shares = s.join(whole, "plan_name").select(
        "plan_name", "source", "target_share", "max_repeats", "supply_tokens", "wanted_tokens", "reached_tokens", "chosen_docs", "uses",
        F.coalesce(F.col("reached_tokens") / F.nullif(F.col("mix_tokens"), F.lit(0)), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.col("reached_tokens") / F.nullif(F.col("total_ratio") * F.lit(total), F.lit(0.0)), F.lit(0.0)).alias("share_of_wanted"),
    )
    return chosen, shares
