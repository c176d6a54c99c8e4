"""Traces as pages: one HTML document for each run, made on the executors by one projection and written there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

_STYLE = (
    "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ddd}"
    ".green{fill:#2b8a3e}.amber{fill:#e8960c}.red{fill:#c92a2a}"
)
#: What a trace may lack: an older one, or one of a run without refutation.
_OPTIONAL = {
    "query": "string", "rejection": "string", "complexity_tier": "string", "final_level": "string", "final_cause": "string", "answer_text": "string", "intensity": "string",
    "n_violations": "bigint", "disclosures": "array<string>",
    "hypotheses": "array<struct<hypothesis_id:string,targets_claim_id:string,strategy:string,refutation_verdict:string,hypothesis_text:string,evidence:array<string>>>",
}


def _text(value: Column) -> Column:
    return T.escape_html(F.coalesce(value.cast("string"), F.lit("–")))


def _element(name: str, *inner: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(F.lit(i) if isinstance(i, str) else i for i in inner), F.lit(f"</{name}>"))


def _each(items: Column, make) -> Column:
    """What ``make`` says of each item, in order; nothing for a null or empty array."""
    return F.coalesce(F.array_join(F.transform(items, make), ""), F.lit(""))


def _section(title: str, body: Column) -> Column:
    return F.when(body == "", "").otherwise(F.concat(_element("h2", title), body))


def _table(heads: tuple[str, ...], rows: Column) -> Column:
    return F.when(rows == "", "").otherwise(_element("table", _element("tr", *(_element("th", h) for h in heads)), rows))


def chart(passes: Column) -> Column:
    """Coverage by iteration as bars; a pass without a verdict has none."""

    def bar(p: Column, at: Column) -> Column:
        b = T.coverage_bar(F.round(p["coverage"], 2))
        place = lambda v: v.cast("string")
        drawn = F.concat(F.lit('<rect class="'), b["colour"], F.lit('" x="'), place(at * 10), F.lit('" y="'), place(26 - b["height"]), F.lit('" width="8" height="'), place(b["height"]), F.lit('"><title>'), F.format_string("%.2f", p["coverage"]), F.lit("</title></rect>"))
        return F.when(p["coverage"].isNotNull(), drawn).otherwise("")

    return F.concat(F.lit('<svg height="26">'), F.coalesce(F.array_join(F.transform(passes, bar), ""), F.lit("")), F.lit("</svg>"))


def page(c=F.col) -> Column:
    """The document of a trace row, by the columns that ``engine.run`` gives."""
    none = lambda column: F.coalesce(column, F.array())
    slots = c("slots")
    level, cause = F.coalesce(c("final_level"), c("level")), F.coalesce(c("final_cause"), c("cause"))
    figures = _table(("run", "tier", "level", "cause", "rejection", "refutation", "violations", "slots"), _element("tr", *(_element("td", _text(v)) for v in (c("run_id"), c("complexity_tier"), level, cause, c("rejection"), c("intensity"), c("n_violations"), F.size(none(slots))))))

    def slot_passes(s: Column) -> Column:
        one = lambda p: _element("tr", *(_element("td", v) for v in (_text(s["slot_id"]), _text(p["iteration"]), _text(F.size(none(p["candidates"]))), _text(F.format_string("%.2f", p["coverage"])), _text(p["verdict"]))))
        return _each(s["passes"], lambda p: F.when(p["coverage"].isNull(), _element("tr", _element("td", _text(s["slot_id"])), _element("td", _text(p["iteration"])), _element("td", _text(F.size(none(p["candidates"])))), "<td>–</td><td>–</td>")).otherwise(one(p)))

    def last(s: Column) -> Column:
        return F.element_at(F.filter(none(s["passes"]), lambda p: p["verdict"].isNotNull()), -1)["verdict"]

    ended = _each(slots, lambda s: _element("tr", _element("td", _text(s["slot_id"])), _element("td", _text(s["query"])), _element("td", F.coalesce(F.when(F.size(F.filter(none(s["passes"]), lambda p: p["verdict"].isNotNull())) > 0, _text(last(s))), F.lit("–"))), _element("td", chart(s["passes"]))))
    gaps = _each(slots, lambda s: _each(F.filter(s["passes"], lambda p: p["gap_description"].isNotNull()), lambda p: _element("li", _text(s["slot_id"]), " ", _text(p["iteration"]), ": ", _text(p["gap_description"]))))
    ids = lambda s: F.array_distinct(F.flatten(F.transform(none(s["passes"]), lambda p: F.transform(none(p["candidates"]), lambda x: x["id"].cast("string")))))
    seen = _each(slots, lambda s: F.when(F.size(ids(s)) > 0, _element("li", _text(s["slot_id"]), ": ", _text(F.array_join(ids(s), ", ")))).otherwise(""))
    probed = _each(c("hypotheses"), lambda h: _element("tr", *(_element("td", _text(v)) for v in (h["hypothesis_id"], h["targets_claim_id"], h["strategy"], h["refutation_verdict"], h["hypothesis_text"], F.array_join(none(h["evidence"]), ", ")))))
    listed = lambda body: F.when(body == "", "").otherwise(_element("ul", body))
    return F.concat(
        F.lit(f'<!doctype html><html><head><meta charset="utf-8"><style>{_STYLE}</style>'), _element("title", "Run ", _text(c("run_id"))), F.lit("</head><body>"), _element("h1", _text(c("query"))), figures,
        _section("Answer", T.paragraphs_html(F.coalesce(c("answer_text"), F.lit("")))), _section("Disclosures", listed(_each(c("disclosures"), lambda d: _element("li", _text(d))))),
        _section("Slots", _table(("slot", "question", "ended", "coverage"), ended)), _section("Passes", _table(("slot", "iteration", "candidates", "coverage", "verdict"), _each(slots, slot_passes))),
        _section("Gaps", listed(gaps)), _section("Refutation", _table(("hypothesis", "target", "strategy", "verdict", "text", "evidence"), probed)), _section("Retrieved", listed(seen)), F.lit("</body></html>"),
    )


def pages(traces: DataFrame) -> DataFrame:
    """(run_id, html) of traces as ``engine.run`` or ``engine.trace`` give them.

    Every text is escaped; columns that a trace lacks and null values are shown as a dash, empty sections are left out. The
    page depends on the row alone, so a rerun gives the same bytes.
    """
    rows = traces.withColumns({n: F.lit(None).cast(kind) for n, kind in _OPTIONAL.items() if n not in traces.columns})
    return rows.select("run_id", page().alias("html"))


def write_pages(traces: DataFrame, path: str) -> None:
    """One file for each run, in a folder ``run=<run_id>``; only the runs at hand are replaced."""
    made = pages(traces).withColumnRenamed("run_id", "run")
    made.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path)
