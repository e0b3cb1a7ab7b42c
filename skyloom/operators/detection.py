"""Merging catalogues of successive detection passes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.sphere import finite, positive, separation
from skyloom.operators.components import connected_components
from skyloom.operators.skyjoin import sky_neighbours, sky_pairs
from skyloom.plans.numbering import numbered
from skyloom.plans.shared import materialize


def _with_radius(df: DataFrame) -> DataFrame:
    return df.withColumn("BMAJ", F.coalesce(finite("BMAJ"), F.lit(0.0)) if "BMAJ" in df.columns else F.lit(0.0))


def shallow_then_deep(shallow: DataFrame, deep: DataFrame, id: str) -> DataFrame:
    """All of the shallow pass, and what the deep one adds away from it."""
    s, d = _with_radius(shallow), _with_radius(deep)
    seen = sky_pairs(s, d, id, id).select(F.col("ref_id").alias("__seen")).distinct()
    return s.unionByName(d.join(seen, F.col(id) == F.col("__seen"), "left_anti"), allowMissingColumns=True)


def replace_multiple(first: DataFrame, second: DataFrame, id: str) -> DataFrame:
    """Multi-component rows (S_Code M) give way to the single source (S) of the second pass that lies nearest, then is brightest; each of these is inserted once."""
    a, b = _with_radius(first), _with_radius(second)
    singles = b.where("S_Code = 'S'")
    hits = sky_pairs(a.where("S_Code = 'M'"), singles, id, id)
    hits = hits.join(singles.select(F.col(id).alias("ref_id"), F.coalesce(finite("Peak_flux"), F.lit(float("-inf"))).alias("__peak")), "ref_id")
    order = W.partitionBy("base_id").orderBy("sep_deg", F.desc("__peak"), "ref_id")
    hits = materialize(hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("base_id", "ref_id"), "multiple")
    kept = a.join(hits, F.col(id) == F.col("base_id"), "left_anti")
    new = b.join(hits.select(F.col("ref_id").alias("__ref")).distinct(), F.col(id) == F.col("__ref"), "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_residual(primary: DataFrame, residual: DataFrame, id: str, band: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue, matched pairs): residual detections away from the catalogue are appended as stage 3, rows that have one near them are marked."""
    p, r = _with_radius(primary), _with_radius(residual)
    pairs = materialize(sky_pairs(p, r, id, id), "residual")
    stage = F.coalesce(F.col("detect_stage").cast("int"), F.lit(2)) if "detect_stage" in p.columns else F.lit(2)
    left = pairs.select(F.col("base_id").alias("__hit")).distinct()
    p = p.withColumn("detect_stage", stage).join(left, F.col(id) == F.col("__hit"), "left")
    p = p.withColumn("resid_leftover", F.col("__hit").isNotNull()).drop("__hit")
    more = r.join(pairs.select(F.col("ref_id").alias("__hit")).distinct(), F.col(id) == F.col("__hit"), "left_anti")
    more = more.withColumns({"detect_stage": F.lit(3), "resid_leftover": F.lit(False), "band": F.coalesce(F.col("band"), F.lit(band)) if "band" in more.columns else F.lit(band)})
    take = lambda df, key, end: df.select(F.col(id).alias(key), *[F.col(c).alias(f"{c}_{end}") for c in ("RA", "DEC", "Peak_flux", "Total_flux", "BMAJ")])
    side = pairs.join(take(p, "base_id", "stage2").drop("Peak_flux_stage2", "Total_flux_stage2"), "base_id").join(take(r, "ref_id", "residual"), "ref_id").withColumn("band", F.lit(band))
    return p.unionByName(more, allowMissingColumns=True), side


def mark_leftovers(meta: DataFrame, matched: DataFrame, id: str = "meta_id") -> DataFrame:
    """Catalogue rows near a position at which residual flux was matched."""
    ends = "stage2" if "RA_stage2" in matched.columns else "residual"
    seeds = matched.select(F.col(f"RA_{ends}").alias("RA"), F.col(f"DEC_{ends}").alias("DEC"), F.coalesce(finite(f"BMAJ_{ends}"), F.lit(0.0)).alias("BMAJ")).distinct().withColumn("seed", F.xxhash64("RA", "DEC"))
    radius = F.coalesce(*[positive(c) for c in ("BMAJ", "BMAJ_match") if c in meta.columns], F.lit(0.0))
    hit = sky_pairs(meta, seeds, id, "seed", base_radius=radius).select(F.col("base_id").alias("__hit")).distinct()
    rows = meta.join(hit, F.col(id) == F.col("__hit"), "left")
    return rows.withColumn("resid_leftover", F.col("__hit").isNotNull()).drop("__hit")


def brightest_first(rows: DataFrame, id: str, flux: str, radius="BMAJ", reach: float = 1.0, blocked: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """Rows that a pass from the brightest to the faintest keeps, where each kept row drops its neighbours.

    Rounds in which every row without a brighter open neighbour is kept give the same set as
    the sequential pass. Only links from a fainter to a brighter row are carried, and those
    of settled rows are dropped, so rounds shrink. A brightness gradient along a chain needs a
    round for every other link: what is open after ``max_rounds`` is settled chain by chain,
    each in one task. Ties fall to the smaller id. Rows in reach of ``blocked`` (RA, DEC, BMAJ,
    id) start out dropped.
    """
    if blocked is not None:
        near = sky_pairs(rows, blocked, id, id, radius, radius, reach=reach).select(F.col("base_id").alias("__near")).distinct()
        rows = materialize(rows.join(near, F.col(id) == F.col("__near"), "left_anti"), "greedy")
    links = sky_neighbours(rows, id, radius, reach=reach).select("id1", "id2")
    shine = lambda end: rows.select(F.col(id).alias(f"id{end}"), F.coalesce(finite(flux), F.lit(float("-inf"))).alias(f"f{end}"))
    both = links.join(shine(1), "id1").join(shine(2), "id2")
    second = F.col("f2") > F.col("f1")  # the smaller id is the first
    pick = lambda one, other: F.when(second, F.col(one)).otherwise(F.col(other))
    links = materialize(both.select(pick("id1", "id2").alias("id"), pick("id2", "id1").alias("over"), F.greatest("f1", "f2").alias("f")), "greedy")
    dropped = None
    for n in range(max_rounds + 1):
        if not links.limit(1).count():
            break
        if n == max_rounds:
            gone = _chain_by_chain(links)
        else:
            winners = links.select("over").distinct().join(links.select(F.col("id").alias("over")).distinct(), "over", "left_anti")
            gone = links.join(winners, "over", "left_semi").select("id").distinct()
        gone = materialize(gone, "greedy")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        if n == max_rounds:
            break
        left = links.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "over"), "over", "left_anti")
        links = materialize(left.select("id", "over", "f"), "greedy")
    if dropped is None:
        return rows
    return rows.join(dropped.select(F.col("id").alias("__gone")), F.col(id) == F.col("__gone"), "left_anti")


def _chain_by_chain(links: DataFrame) -> DataFrame:
    """Ids that the pass drops among links (id, over, f: flux of over), each connected group in order."""
    kind = links.schema["id"].dataType.simpleString()
    number = lambda c: F.xxhash64(c)
    groups = connected_components(links.select(number("id").alias("src"), number("over").alias("dst")))
    placed = links.join(groups, number("id") == F.col("node")).select("id", "over", "f", "component")

    def run(rows):
        import pandas as pd

        under: dict = {}
        for i, o in zip(rows["id"], rows["over"]):
            under.setdefault(o, []).append(i)
        gone = set()
        for o in rows.sort_values(["f", "over"], ascending=[False, True])["over"].drop_duplicates():
            if o not in gone:
                gone.update(under[o])
        return pd.DataFrame({"id": sorted(gone)})

    return placed.groupBy("component").applyInPandas(run, f"id {kind}")


def crossband_actions(target: DataFrame, seeds: dict[str, DataFrame], id: str, near_fraction: float = 0.5, dip_ratio: float = 0.5) -> DataFrame:
    """What neighbouring bands ask of a band's catalogue: insert, replace or skip.

    A seed without a target in its beam, or only with targets beyond ``near_fraction`` of the
    beam, asks for an insertion, brightest first. Seeds near a target claim the nearest
    one; a target fainter than ``dip_ratio`` of its claims' median is to be replaced.
    """
    t = _with_radius(target)
    every = None
    for band, rows in seeds.items():
        part = _with_radius(rows).select(F.lit(band).alias("seed_band"), F.col(id).alias("seed_id"), finite("RA").alias("RA"), finite("DEC").alias("DEC"), "BMAJ", finite("Peak_flux").alias("seed_peak"))
        every = part if every is None else every.unionByName(part)
    every = materialize(every.where("RA IS NOT NULL AND DEC IS NOT NULL").withColumn("seed", F.xxhash64("seed_band", "seed_id")), "seeds")
    hits = sky_pairs(every, t, "seed", id)
    hits = hits.join(every.select(F.col("seed").alias("base_id"), F.col("BMAJ").alias("b0")), "base_id")
    hits = hits.join(t.select(F.col(id).alias("ref_id"), F.col("BMAJ").alias("b1"), finite("Peak_flux").alias("target_peak")), "ref_id")
    hits = hits.withColumn("near", F.col("sep_deg") <= near_fraction * F.greatest("b0", "b1"))
    order = W.partitionBy("base_id").orderBy(F.desc("near"), "sep_deg", F.desc_nulls_last("target_peak"), "ref_id")
    first = materialize(hits.withColumn("__n", F.row_number().over(order)).where("__n = 1"), "hits")
    rows = every.join(first.select(F.col("base_id").alias("seed"), "ref_id", "sep_deg", "near", "target_peak"), "seed", "left")
    claims = rows.where("near").groupBy("ref_id").agg(F.array_join(F.array_sort(F.collect_set("seed_band")), ",").alias("seed_band"), F.min(F.struct("seed_band", "seed_id"))["seed_id"].alias("seed_id"), F.percentile(positive("seed_peak"), 0.5).alias("seed_peak"), F.first("target_peak").alias("target_peak"))
    ratio = positive("target_peak") / positive("seed_peak")
    where = t.select(F.col(id).alias("ref_id"), F.col("RA").alias("seed_ra"), F.col("DEC").alias("seed_dec"))
    claimed = claims.join(where, "ref_id").select(
        F.when(ratio < dip_ratio, "replace").otherwise("skip").alias("action"), "seed_band", "seed_id", F.col("ref_id").alias("target_id"), "seed_ra", "seed_dec", "seed_peak", "target_peak", ratio.alias("peak_ratio"), F.lit(0.0).alias("sep_deg"),
        F.when(ratio.isNull(), "invalid_peak").when(ratio < dip_ratio, "phot_dip").otherwise("peak_ok").alias("reason"),
    )
    lone = rows.where(F.col("near").isNull() | ~F.col("near"))
    taken = t.join(claims.select(F.col("ref_id").alias("__c")), F.col(id) == F.col("__c"), "left_semi").select(F.col(id).alias("seed"), "RA", "DEC", "BMAJ")
    lone = brightest_first(lone, "seed", "seed_peak", reach=near_fraction, blocked=taken)
    inserts = lone.select(
        F.lit("insert").alias("action"), "seed_band", "seed_id", F.lit(None).cast(t.schema[id].dataType).alias("target_id"), F.col("RA").alias("seed_ra"), F.col("DEC").alias("seed_dec"), "seed_peak", "target_peak", F.lit(None).cast("double").alias("peak_ratio"), "sep_deg",
        F.when(F.col("near").isNull(), "no_beam_hit").otherwise("offset_only").alias("reason"),
    )
    return claimed.unionByName(inserts)


def apply_crossband(target: DataFrame, actions: DataFrame, id: str, fit: Callable[[DataFrame], DataFrame], max_abs: float = 1.0, max_fraction: float = 0.5) -> DataFrame:
    """The catalogue after replacing and inserting the forced fits that pass the residual gate.

    ``fit`` adds ok, forced_Peak, forced_Total, forced_RA, forced_DEC and forced_resid_rms
    to the actions. Inserted rows have negative ids.
    """
    done = fit(actions.where("action IN ('insert', 'replace')"))
    gate = F.col("ok") & (F.col("forced_resid_rms") <= F.greatest(F.lit(max_abs), max_fraction * F.abs("forced_Peak")))
    done = materialize(done.where(F.coalesce(gate, F.lit(False))), "forced")
    new = {"Peak_flux": "forced_Peak", "Total_flux": "forced_Total"}
    fixed = done.where("action = 'replace'").select(F.col("target_id").alias("__t"), *[F.col(v).alias(f"__{k}") for k, v in new.items()], F.col("seed_band").alias("__from"))
    rows = target.join(fixed, F.col(id) == F.col("__t"), "left")
    hit = F.col("__t").isNotNull()
    rows = rows.withColumns({k: F.coalesce(f"__{k}", k) for k in new} | {"forced": hit, "forced_mode": F.when(hit, "replace"), "forced_from_band": F.col("__from")}).drop("__t", "__from", *[f"__{k}" for k in new])
    added = numbered(done.where("action = 'insert'"), "__n", F.desc_nulls_last("seed_peak"), "seed_band", "seed_id", start=2).select(
        (-F.col("__n")).cast("long").alias(id), F.col("forced_RA").alias("RA"), F.col("forced_DEC").alias("DEC"), F.col("forced_Peak").alias("Peak_flux"), F.col("forced_Total").alias("Total_flux"),
        F.lit(True).alias("forced"), F.lit("insert").alias("forced_mode"), F.col("seed_band").alias("forced_from_band"),
    )
    return rows.unionByName(added, allowMissingColumns=True)


def adjacent_seeds(bands: Sequence[str], band: str) -> list[str]:
    """The neighbours of a band in an ordered list."""
    k = list(bands).index(band)
    return [bands[i] for i in (k - 1, k + 1) if 0 <= i < len(bands)]


def detection_distance(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """Distance of rows that share an id in two catalogues."""
    other = b.select(F.col(id), F.col("RA").alias("__ra"), F.col("DEC").alias("__dec"))
    return a.join(other, id).withColumn("sep_deg", separation("RA", "DEC", "__ra", "__dec")).drop("__ra", "__dec")
