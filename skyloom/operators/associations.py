"""Long-form associations of catalogue rows with external sources: extraction, classes, conflicts, replacement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sphere import finite, position_key
from skyloom.functions.text import clean, first_id
from skyloom.operators.match import Match

COLUMNS = ("meta_id", "catalog", "ref_id", "ref_ra", "ref_dec", "class_native", "sep_arcsec", "n_ref")


@dataclass(frozen=True)
class AssociationSpec:
    """Where a catalogue keeps the ids and classes of its rows."""

    catalog: str
    id_columns: tuple[str, ...]
    class_columns: tuple[str, ...] = ()
    detail_column: str | None = None


# Id and class columns of the catalogues.
SPECS = {
    s.catalog: s
    for s in (
        AssociationSpec("MilliQuas", ("Name",), ("class_primary", "Type"), "class_label"),
        AssociationSpec("NEDLVS", ("objname",), ("objtype",)),
        AssociationSpec("eRASS3", ("LS10_OBJID", "main_id_simbad"), ("class_gal_exgal",)),
        AssociationSpec("Freund2022", ("name_2rxs",)),
        AssociationSpec("Xu2022", ("RXGCC",), ("Class",)),
        AssociationSpec("2RXS", ("name",)),
        AssociationSpec("TeVCat", ("tevcat_name", "canonical_name", "id"), ("source_type",)),
        AssociationSpec("RFC", ("Name", "Comnam"), ("type",)),
    )
}

# Native classes of catalogues and the common label they mean.
RADIO = ("VLSSR", "NVSS", "VLASS", "LoDeSS", "GLEAM")
WHOLE = {"Freund2022": "star", "Xu2022": "cluster", "2RXS": "xray", "NEDLVS": "galaxy"}
TEV_AGN = ("HBL", "IBL", "FSRQ", "BLAZAR", "FRI")
TEV_OWN = ("", "TEVCAT", "UNID", "DARK", "PWN", "SHELL", "SNR/MOLEC. CLOUD", "COMPOSITE SNR", "PWN/TEV HALO", "TEV HALO", "SUPERBUBBLE", "PSR", "BINARY", "XRB", "MICROQUASAR", "MASSIVE STAR CLUSTER", "GRB")
RFC_CLASSES = {
    "radio": ("", "RFC"),
    "agn": ("QSO", "QSOc", "BLLac", "BZ", "BZc", "Q_Lens"),
    "galaxy": ("G", "GPair", "GTrpl", "GGroup", "G_Lens", "PofG"),
    "cluster": ("GClstr",),
    "star": ("*", "Blue*", "Red*", "V*", "!V*", "!*"),
    "xray": ("XrayS",),
}
LETTERS = {"S": "star", "Q": "agn", "A": "agn", "B": "agn", "K": "agn", "N": "agn"}
#: Native classes of the RFC that mean the same in any catalogue.
SHARED = ("G", "QSO", "QSOc", "BLLac", "BZ", "BZc", "GClstr", "XrayS")
COMMON = LETTERS | WHOLE | {"blazar": "agn", "eRASS3": "xray", "TeVCat": "tev"} | dict.fromkeys(RADIO, "radio") | {name: label for label, names in RFC_CLASSES.items() for name in names if name in SHARED}


def harmonized(catalog: Column, native: Column) -> Column:
    """The common class of a catalogue's own one."""
    cat, own = clean(catalog), clean(native)
    common = F.create_map(*[F.lit(x) for pair in COMMON.items() for x in pair])
    known = lambda c: F.try_element_at(common, c)
    code = own.try_cast("int")
    letter = F.upper(F.substring(own, 1, 1))
    rfc = known(own)
    for label, names in reversed(RFC_CLASSES.items()):
        rfc = F.when(own.isin(*names), label).otherwise(rfc)
    out = F.when(cat.isin(*RADIO), "radio")
    for name, label in WHOLE.items():
        out = out.when(cat == name, label)
    out = out.when(cat == "TeVCat", F.when(F.upper(own).isin(*TEV_AGN), "agn").when(F.upper(own).isin(*TEV_OWN), "tev").otherwise(F.coalesce(known(own), F.lit("tev"))))
    out = out.when(cat == "MilliQuas", F.coalesce(F.when(letter.isin(*LETTERS), known(letter)), known(own), F.lit("unknown")))
    out = out.when(cat == "RFC", F.coalesce(rfc, F.lit("unknown")))
    xray = F.when(F.lower(own) == "blazar", "agn").when(code.isNull(), F.when(own.isin("", "eRASS3"), "xray").otherwise("unknown")).when(code < 0, "star").when(code > 0, "galaxy").otherwise("xray")
    out = out.when(cat == "eRASS3", xray)
    return out.otherwise(F.coalesce(known(own), known(cat), F.lit("unknown")))


def harmonize(rows: DataFrame) -> DataFrame:
    missing = [c for c in ("catalog", "class_native") if c not in rows.columns]
    if missing:
        raise ValueError(f"associations lack {missing}")
    return rows.withColumn("class_harmonized", harmonized(F.col("catalog"), F.col("class_native")))


def conflicts(rows: DataFrame) -> DataFrame:
    """Per meta_id: associations, distinct common labels, and whether these disagree."""
    labels = F.array_sort(F.collect_set(F.when(F.col("class_harmonized") != "", F.col("class_harmonized"))))
    out = harmonize(rows).groupBy("meta_id").agg(F.count(F.lit(1)).alias("n_associations"), labels.alias("l"))
    return out.select("meta_id", "n_associations", F.size("l").cast("long").alias("n_harmonized"), F.array_join("l", ",").alias("harmonized_labels"), (F.size("l") >= 2).alias("conflict"))


def ids_of_classes(rows: DataFrame, classes: Sequence[str], column: str = "class_harmonized", exclusive: bool = False, catalogs: Sequence[str] | None = None, exclude_conflicts: bool = False) -> DataFrame:
    """Distinct meta_id with a matching class; if ``exclusive``, with no other class."""
    work = harmonize(rows) if column == "class_harmonized" else rows
    if catalogs is not None:
        work = work.where(F.col("catalog").isin(*catalogs))
    hit = F.coalesce(F.col(column).isin(*classes), F.lit(False))
    found = work.groupBy("meta_id").agg(F.max(hit.cast("int")).alias("some"), F.min(F.when(F.coalesce(F.col(column), F.lit("")) == "", 1).otherwise(hit.cast("int"))).alias("every"))
    found = found.where("some = 1 AND every = 1" if exclusive else "some = 1").select("meta_id")
    if exclude_conflicts:
        found = found.join(conflicts(rows).where("conflict"), "meta_id", "left_anti")
    return found


def select_classes(meta: DataFrame, rows: DataFrame, classes: Sequence[str], ranges: dict[str, tuple] | None = None, **how) -> DataFrame:
    """Catalogue rows of these classes whose columns lie in the (low, high) ranges; None is open."""
    out = meta.join(ids_of_classes(rows, classes, **how), "meta_id", "left_semi")
    for c, (low, high) in (ranges or {}).items():
        if low is not None:
            out = out.where(F.col(c) >= low)
        if high is not None:
            out = out.where(F.col(c) <= high)
    return out


def from_match(found: Match, spec: AssociationSpec, ref_id: str = "ref_id") -> DataFrame:
    """Associations of the rows with exactly one counterpart."""
    has = [c for c in (*spec.id_columns, *spec.class_columns) if c in found.footprint.columns]
    name = first_id(*[F.col(c) for c in spec.id_columns if c in has], position_key("RA", "DEC"))
    native = first_id(*[F.col(c) for c in spec.class_columns if c in has], F.lit(spec.catalog))
    ref = found.footprint.select(F.col(ref_id).alias("__ref"), name.alias("ref_id"), finite("RA").alias("ref_ra"), finite("DEC").alias("ref_dec"), native.alias("class_native"), *([F.col(spec.detail_column).alias("class_native_detail")] if spec.detail_column and spec.detail_column in found.footprint.columns else []))
    links = found.edges.groupBy("base_id").agg(F.count(F.lit(1)).alias("n_ref"), F.min("ref_id").alias("__ref"), F.min("sep_deg").alias("sep")).where("n_ref = 1")
    out = links.join(ref, "__ref").withColumns({"meta_id": F.col("base_id"), "catalog": F.lit(spec.catalog), "sep_arcsec": F.col("sep") * 3600})
    return out.select(*COLUMNS, *[c for c in ("class_native_detail",) if c in out.columns])


def from_attach(meta: DataFrame, survey: str) -> DataFrame:
    """Associations of a survey attached as a band, where the row has one counterpart."""
    ra, dec = F.col(f"RA_{survey}"), F.col(f"DEC_{survey}")
    rows = meta.where(F.col(f"n_assoc_{survey}") == 1)
    from skyloom.functions.sphere import separation

    return rows.select("meta_id", F.lit(survey).alias("catalog"), position_key(ra, dec).alias("ref_id"), ra.alias("ref_ra"), dec.alias("ref_dec"), F.lit(survey).alias("class_native"), (separation("RA", "DEC", ra, dec) * 3600).alias("sep_arcsec"), F.lit(1).cast("long").alias("n_ref"))


def replace_catalog(old: DataFrame, new: DataFrame, catalog: str) -> DataFrame:
    """``old`` with all rows of one catalogue exchanged for ``new``; an empty ``new`` removes them."""
    return old.where(F.col("catalog") != catalog).unionByName(new.withColumn("catalog", F.lit(catalog)), allowMissingColumns=True)


def write_catalog(path: str, new: DataFrame, catalog: str) -> None:
    """The same on a table partitioned by catalogue: only its partition is rewritten."""
    spark = new.sparkSession
    if new.limit(1).count():
        new.withColumn("catalog", F.lit(catalog)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("catalog").parquet(path)
        return
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalog={catalog}")
    part.getFileSystem(spark._jsc.hadoopConfiguration()).delete(part, True)


def class_table(rows: DataFrame) -> DataFrame:
    """Associations of each catalogue by common class, one column a class."""
    labels = sorted({*WHOLE.values(), "radio", "agn", "tev", "unknown"})
    return harmonize(rows).groupBy("catalog").pivot("class_harmonized", labels).count().na.fill(0)


def join_unique(meta: DataFrame, rows: DataFrame, catalog: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The columns of a catalogue's first association of each row (by ref_id, then by ``ties``)."""
    order = F.when(F.col("ref_id").isNotNull(), F.struct("ref_id", *ties))
    first = rows.where(F.col("catalog") == catalog).groupBy("meta_id").agg(F.min_by(F.struct(*columns), order).alias("r")).select("meta_id", "r.*")
    return meta.join(first, "meta_id", "left")
