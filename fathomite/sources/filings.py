"""Filings that have landed as files: finding one, reading it by items, transcripts and their local copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T, values as V
from . import files


def has_item(items: Column, item: str = V.RESULTS_ITEM) -> Column:
    """Whether a filing's items, a string or an array of strings, name ``item``; false for null."""
    return F.coalesce(F.contains(items.cast("string"), F.lit(item)), F.lit(False))


def find_filing(filings: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row (form, period_of_report) of ``wanted`` the filing of that form and period, the latest filed of several
    (then the greatest accession); all columns are null where there is none."""
    own = filings.withColumn("_f", F.struct(*filings.columns))
    best = own.groupBy("form", "period_of_report").agg(F.max_by("_f", F.struct("filing_date", "accession")).alias("_f"))
    rest = [c for c in filings.columns if c not in ("form", "period_of_report")]
    return wanted.join(best, ["form", "period_of_report"], "left").select(*wanted.columns, *(F.col(f"_f.{c}").alias(c) for c in rest))


def find_letter(filings: DataFrame, windows: DataFrame) -> DataFrame:
    """For each row (window_id, first, last) the 8-K filed inside the inclusive window that announces results; where none
    names that item, any 8-K of the window. The latest filed is taken (then the greatest accession)."""
    eights = filings.filter("form = '8-K'").withColumn("_r", has_item(F.col("items")).cast("int"))
    inside = windows.select("window_id", F.col("first").cast("date").alias("_a"), F.col("last").cast("date").alias("_b"), F.explode(F.sequence(F.trunc(F.col("first").cast("date"), "month"), F.col("last").cast("date"), F.expr("interval 1 month"))).alias("_m"))
    met = inside.join(eights.withColumn("_m", F.trunc("filing_date", "month")), "_m").filter(F.col("filing_date").between(F.col("_a"), F.col("_b")))
    best = met.groupBy("window_id").agg(F.max_by(F.struct(*filings.columns), F.struct("_r", "filing_date", "accession")).alias("_f"))
    return windows.select("window_id").join(best, "window_id", "left").select("window_id", "_f.*")


def read_landed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, modified, content) of landed files of any kind, bytes as they are."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("modificationTime").alias("modified"), "content")


def landed_text(landed: DataFrame, to_text=None) -> DataFrame:
    """(path, stem, text) of landed files: ``to_text`` is a Column function from bytes to text, for formats such as PDF that
    need a library; without one the bytes are UTF-8. Known speakers are put on lines of their own."""
    raw = to_text(F.col("content")) if to_text else F.decode("content", "UTF-8")
    return landed.select("path", "stem", T.label_speakers(raw).alias("text"))


def retained_items(items: DataFrame, legacy: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(document_id, form, section, text): the items of annual and quarterly reports that are kept.

    ``items`` is (document_id, form, section, text); amendments have the items of their base form. An item that is missing
    or blank is taken from ``legacy`` (document_id, part, item, text), where the form says which part it is in; items
    that are blank there too are left out. ``notes`` (document_id, text) adds the notes to the statements. Other forms
    are an error, as they have no items.
    """
    base = F.regexp_replace(F.upper("form"), "/.*$", "")
    wanted = F.lit(None).cast("array<struct<section:string,part:string>>")
    for form, parts in V.RETAINED_ITEMS.items():
        wanted = F.when(base == form, F.array(*(F.struct(F.lit(i).alias("section"), F.lit(p).alias("part")) for i, p in parts.items()))).otherwise(wanted)
    documents = items.select("document_id", "form").distinct()
    asked = documents.withColumn("_w", F.coalesce(wanted, F.raise_error(F.concat(F.lit("only annual and quarterly reports have items: "), "form")).cast("array<struct<section:string,part:string>>")))
    asked = asked.select("document_id", "form", F.inline("_w"))
    blank = lambda c: F.when(T.strip(F.col(c)) != "", F.col(c))
    new = items.groupBy("document_id", "section").agg(F.max(blank("text")).alias("_new"))
    old = legacy.groupBy("document_id", "part", F.col("item").alias("section")).agg(F.max(blank("text")).alias("_old"))
    rows = asked.join(new, ["document_id", "section"], "left").join(old, ["document_id", "part", "section"], "left")
    rows = rows.select("document_id", "form", "section", F.coalesce("_new", "_old").alias("text")).filter("text IS NOT NULL")
    if notes is not None:
        own = notes.join(documents, "document_id").filter(T.strip(F.col("text")) != "")
        rows = rows.unionByName(own.select("document_id", "form", F.lit("Notes to Financial Statements").alias("section"), "text"))
    return rows


def first_hit(rows: DataFrame, dated: list[str], undated: list[str], answers: DataFrame, key: str = "document_id") -> DataFrame:
    """For each row the first URL that answers with 200: those of dated templates, in order, before the others.

    ``answers`` (url, status) is what a crawl has recorded; nothing is fetched here.
    """
    tried = files.candidate_urls(rows, [*dated, *undated])
    ok = tried.join(answers.filter("status = 200").select("url").distinct(), "url", "left_semi")
    best = ok.groupBy(key).agg(F.min_by("url", "place").alias("url"))
    return rows.join(best, key, "left")


def local_copies(transcripts: DataFrame, landed: DataFrame) -> DataFrame:
    """Transcripts with local_path, the landed file whose name is the document's id, and status ``local`` where there is
    one. Of several files of one name the path that sorts first is taken."""
    own = landed.groupBy(F.col("stem").alias("document_id")).agg(F.min("path").alias("local_path"))
    rows = transcripts.drop("local_path").join(own, "document_id", "left")
    status = F.col("status") if "status" in transcripts.columns else F.lit(None).cast("string")
    return rows.withColumn("status", F.when(F.col("local_path").isNotNull(), "local").otherwise(status))
