"""Sources and sinks: facts as JSON lines, section folders, manifests, tagged filings, traces."""

from __future__ import annotations

import math
import time
import uuid
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FACT_SCHEMA = (
    "fact_id string, claim string, asserter string, source_document string, source_section string, verbatim_anchor string, fact_type string, "
    "period string, value double, unit string, concept_tag string, assertion_date date, confidence double"
)
RAW_SCHEMA = "concept string, unit string, decimals int, value double, instant date, period_start date, period_end date, dimensions map<string,string>"


def read_facts(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Fact records from JSON lines. Strict: a malformed line ends the job. Else it is skipped, and of rows with one id
    that of the last file in name order is kept."""
    reader = spark.read.schema(FACT_SCHEMA)
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    rows = reader.option("mode", "DROPMALFORMED").json(path).filter("fact_id IS NOT NULL").withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start"))
    last = rows.groupBy("fact_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("fact_id", "_file", "_at")]), F.struct("_file", "_at")).alias("_r"))
    return last.select("fact_id", "_r.*")


def write_facts(facts: DataFrame, path: str) -> None:
    """JSON lines in a folder for each source document; only the documents at hand are replaced."""
    facts.withColumn("document", F.col("source_document")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").json(path)


def publish_facts(facts: DataFrame, path: str) -> str:
    """Write whole documents' facts under ``path`` so that readers see a document in its former or in its new form.

    Files are staged in a folder of their own; when all are there, one file is added to the manifest, which names the
    documents, their numbers of rows and the folder. A writer that dies before has published nothing. A document that
    comes again is replaced; a null source_document is a document. Returns the folder's name.
    """
    spark, version = facts.sparkSession, uuid.uuid4().hex
    staged = f"{path}/data/version={version}"
    facts.withColumn("document", F.col("source_document")).write.partitionBy("document").json(staged)
    whole = spark.read.schema(f"{FACT_SCHEMA}, document string").json(staged).groupBy("document").agg(F.count("*").alias("n"))
    entry = whole.select("document", "n", F.lit(version).alias("version"), F.lit(time.time_ns()).alias("at"))
    entry.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(f"{path}/manifest")
    return version


def published_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, version, n) of each published document, in its last form: what a resumed run need not do again."""
    entries = spark.read.schema("document string, n bigint, version string, at bigint").json(f"{path}/manifest")
    return entries.groupBy("document").agg(F.max_by(F.struct("version", "n"), F.struct("at", "version")).alias("_e")).select("document", "_e.*")


def published_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all published documents. Staged files that no manifest names are not read."""
    rows = spark.read.schema(f"{FACT_SCHEMA}, version string, document string").json(f"{path}/data")
    last = published_documents(spark, path).select(F.col("document").alias("_d"), F.col("version").alias("_v"))
    return rows.join(last, (F.col("version") == F.col("_v")) & F.col("document").eqNullSafe(F.col("_d")), "left_semi").drop("version", "document")


def incomplete_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, n, n_found): published documents that have lost rows since, to be published again."""
    rows = spark.read.schema("version string, document string").json(f"{path}/data").groupBy("version", "document").agg(F.count("*").alias("n_found"))
    last = published_documents(spark, path)
    found = last.join(rows.withColumnRenamed("document", "_d").withColumnRenamed("version", "_v"), (F.col("version") == F.col("_v")) & F.col("document").eqNullSafe(F.col("_d")), "left")
    return found.select("document", "n", F.coalesce("n_found", F.lit(0)).alias("n_found")).filter("n <> n_found")


def pending(documents: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents whose output is not there yet."""
    return documents.join(done.select(key).distinct(), key, "left_anti")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, section, text) from ``path``/document/section.txt; a transcript comes as its two parts."""
    from ..functions import text as T

    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).withColumn("_p", F.split(F.col("_metadata.file_path"), "/"))
    rows = rows.select(F.element_at("_p", -2).alias("document_id"), F.regexp_replace(F.element_at("_p", -1), r"\.txt$", "").alias("section"), F.col("value").alias("text"))
    parts = T.split_transcript(F.col("text"))
    split = rows.filter("section = 'transcript'").select("document_id", F.inline(F.array(*(F.struct(F.lit(n).alias("section"), parts[n].alias("text")) for n in ("prepared_remarks", "qa")))))
    return rows.filter("section <> 'transcript'").unionByName(split.filter("text <> ''"))


def section_slug(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "_")


def list_filings(manifest: DataFrame, first: str, last: str, forms: tuple[str, ...] = ("10-K", "10-Q", "8-K")) -> DataFrame:
    """Filings of the given forms, amendments included, inside an inclusive window, in order."""
    return manifest.filter(F.regexp_replace("form", "/A$", "").isin(*forms) & F.col("filing_date").between(first, last)).orderBy("filing_date", "form", "document_id")


def quarters(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "quarter"), F.lit(last).cast("date"), F.expr("interval 3 months"))).alias("d"))
    return days.select(F.year("d").alias("year"), F.quarter("d").alias("quarter"))


def candidate_urls(rows: DataFrame, templates: list[str]) -> DataFrame:
    """One row for each URL template, in order; ``{year}``, ``{quarter}`` and ``{date}`` are filled in."""
    url = F.element_at(F.array(*map(F.lit, templates)), F.col("place") + 1)
    for name, value in (("{year}", F.col("year").cast("string")), ("{quarter}", F.col("quarter").cast("string")), ("{date}", F.date_format("release_date", "yyyy-MM-dd"))):
        url = F.replace(url, F.lit(name), value)
    return rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(templates) - 1)))).withColumn("url", url)


def choose_exhibit(attachments: DataFrame, by: str = "accession") -> DataFrame:
    """The release among a filing's attachments (document, description): by name first, then by description."""
    name, about = F.lower("document"), F.lower(F.coalesce("description", F.lit("")))
    named = name.rlike(r"ex-?99|99[._]1")
    fits = attachments.filter(named | about.rlike("shareholder|letter|press release")).withColumn("_r", F.when(name.rlike("ex-?99"), 0).when(named, 1).otherwise(2))
    return fits.groupBy(by).agg(F.min_by(F.struct(*attachments.columns), F.struct("_r", "document")).alias("_a")).select("_a.*")


def footnotes(text: Column, markers: list[str]) -> Column:
    """The text from the first marker found, tried in the order given."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(m)), F.substring(text, F.instr(text, F.lit(m)), F.length(text))) for m in markers))


def parse_xbrl(documents: DataFrame, id_col: str = "document_id", xml_col: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric facts of tagged instances: one row for each fact with a known context and a number.

    Prefixes come from the instance's own declarations and facts join contexts and units by id inside one document, so
    this is a map over documents (``mapInArrow``); XPath functions return one node at a time and would not do. An instance
    that is not well-formed has no rows (``malformed_xbrl`` lists them); NaN and infinite values are no numbers. Columns
    to ``keep`` come with each fact, so that documents need not be joined, and so made, once more.
    """
    import io

    import pyarrow as pa

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def parse(xml: str) -> list[dict]:
        prefixes, root = {}, None
        try:
            for event, item in ET.iterparse(io.StringIO(xml), events=("start-ns", "start")):
                if event == "start-ns":
                    prefixes.setdefault(item[1], item[0])
                elif root is None:
                    root = item
        except ET.ParseError:
            return []
        contexts, units, out = {}, {}, []
        for node in root.iter():
            kind = local(node.tag)
            if kind == "context":
                got = {local(x.tag): (x.text or "").strip() for x in node.iter()}
                own = {x.get("dimension"): (x.text or "").strip() for x in node.iter() if local(x.tag) == "explicitMember"}
                contexts[node.get("id")] = (got.get("instant"), got.get("startDate"), got.get("endDate"), own)
            elif kind == "unit":
                parts = [(x.text or "").strip().split(":")[-1] for x in node.iter() if local(x.tag) == "measure"]
                units[node.get("id")] = ("Per" if any(local(x.tag) == "divide" for x in node.iter()) else "*").join(parts) or "unknown"
        for node in root.iter():
            ref, text = node.get("contextRef"), (node.text or "").strip()
            if ref not in contexts or not text:
                continue
            try:
                value = float(text)
            except ValueError:
                continue
            if not math.isfinite(value):
                continue
            instant, start, end, own = contexts[ref]
            space = node.tag[1:].split("}")[0] if node.tag[0] == "{" else ""
            digits = node.get("decimals") or ""
            out.append({"concept": ":".join(filter(None, (prefixes.get(space), local(node.tag)))), "unit": units.get(node.get("unitRef"), "unknown") if node.get("unitRef") else "pure", "decimals": int(digits) if digits.lstrip("-").isdigit() else None, "value": value, "instant": instant, "period_start": start, "period_end": end, "dimensions": own})
        return out

    def run(batches):
        for batch in batches:
            made = [(at, i.as_py(), r) for at, (i, xml) in enumerate(zip(batch.column(0), batch.column(1), strict=True)) if xml.is_valid for r in parse(xml.as_py())]
            rows, places = [m[1:] for m in made], pa.array([m[0] for m in made], pa.int64())
            fields = ("concept", "unit", "decimals", "value", "instant", "period_start", "period_end")
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string())
            columns = [pa.array([i for i, _ in rows], pa.string())] + [pa.array([r[f] for _, r in rows], k) for f, k in zip(fields, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([list(r["dimensions"].items()) for _, r in rows], pa.map_(pa.string(), pa.string())), *(c.take(places) for c in batch.columns[2:])], names=[id_col, *fields, "dimensions", *keep])

    others = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    made = documents.select(F.col(id_col).cast("string").alias(id_col), xml_col, *keep).mapInArrow(run, f"{id_col} string, concept string, unit string, decimals int, value double, instant string, period_start string, period_end string, dimensions map<string,string>{others}")
    return made.withColumns({c: F.try_to_date(c, "yyyy-MM-dd") for c in ("instant", "period_start", "period_end")})


def malformed_xbrl(documents: DataFrame, id_col: str = "document_id", xml_col: str = "xml") -> DataFrame:
    """(id, error) of the instances that are not well-formed, for a report."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, errors = [], []
            for i, xml in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    ET.fromstring(xml.as_py() or "")
                except ET.ParseError as e:
                    ids.append(i.as_py())
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(errors, pa.string())], names=[id_col, "error"])

    return documents.select(F.col(id_col).cast("string").alias(id_col), xml_col).mapInArrow(run, f"{id_col} string, error string")


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Trace documents, bare or wrapped in an object with the one field ``canonical``."""
    raw = spark.read.text(path, wholetext=True)
    bare, wrapped = F.from_json("value", schema), F.from_json("value", f"canonical struct<{schema}>")["canonical"]
    return raw.select(F.coalesce(F.when(F.get_json_object("value", "$.canonical").isNotNull(), wrapped), bare).alias("trace")).select("trace.*")


def combine_corpora(*facts: DataFrame) -> DataFrame:
    """UNION ALL with ``seq``: earlier inputs first, each in the order of its own ids."""
    out = None
    for i, f in enumerate(facts):
        part = f.withColumn("_in", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("seq", F.struct("_in", "fact_id")).drop("_in")
