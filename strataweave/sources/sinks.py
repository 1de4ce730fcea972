"""Results out: pages as text, batch tables as CSV and JSON, reports for people."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns that a batch table begins with.
LEADING = ("file_path", "overall_score", "grade", "format", "total_entities", "total_connections", "critical_issues", "analysis_time_ms", "error")
#: The parts of a score, in the order that reports list them.
PARTS = ("integrity", "connectivity", "confidence", "sources", "content")


def write_pages(pages: DataFrame, path: str) -> None:
    """One text file a source, each page under its marker."""
    page = F.concat(F.lit("\n\n[Page "), F.col("page_number").cast("string"), F.lit("]\n\n"), F.col("text"))
    rows = pages.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_number", page.alias("p")))).alias("ps"))
    text = rows.select("source_id", F.array_join(F.transform("ps", lambda p: p["p"]), "").alias("value"))
    text.repartition("source_id").write.mode("overwrite").partitionBy("source_id").option("lineSep", "\n").text(path)


def ordered(table: DataFrame) -> DataFrame:
    """The leading columns first, the others by name."""
    first = [c for c in LEADING if c in table.columns]
    return table.select(*first, *sorted(c for c in table.columns if c not in first))


def write_csv(table: DataFrame, path: str) -> None:
    ordered(table).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """An append-only event log as JSON lines; `at` is the time of writing, in UTC."""
    stamped = events.withColumn("at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    stamped.write.mode("append").json(path)


def _first(table: DataFrame, most: int) -> tuple[list[dict], str]:
    """The first `most` rows, and a line on how many more there are ('' if none)."""
    rows = [r.asDict() for r in table.limit(most + 1).collect()]
    more = table.count() - most if len(rows) > most else 0
    return rows[:most], f"... and {more} more" if more else ""


def terminal_report(scores: DataFrame, most: int = 50, verbose: bool = False) -> str:
    """Scores as lines of text, the first `most` runs and how many more there are; verbose adds the parts."""
    out = []
    rows, more = _first(ordered(scores).orderBy("run_id"), most)
    for r in rows:
        out.append(f"{r['run_id']}: {r['score']:.1f} ({r['grade']})")
        if verbose:
            out += [f"  {k}: {r[k]:.1f}" for k in PARTS if r.get(k) is not None]
    return "\n".join([*out, more] if more else out)


def _page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def _table(rows: list[dict], names: list[str]) -> str:
    cells = lambda r, tag: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in r)
    return f"<table><tr>{cells(names, 'th')}</tr>" + "".join(f"<tr>{cells((r[n] for n in names), 'td')}</tr>" for r in rows) + "</table>"


def html_report(scores: DataFrame, title: str = "Quality", most: int = 1000) -> str:
    """Scores as a page, the first `most` runs: an overview, and for each run its parts with penalty, bonus and counts."""
    rows, more = _first(ordered(scores).orderBy("run_id"), most)
    names = list(rows[0]) if rows else list(scores.columns)
    first = [n for n in ("run_id", "score", "grade", *PARTS) if n in names]
    body = "<h2>Overview</h2>" + _table(rows, first) + (f"<p>{more}</p>" if more else "")
    rest = [n for n in names if n not in first]
    for r in rows if rest else ():
        body += f"<h2>{html.escape(str(r['run_id']))}</h2>" + _table([{"measure": n, "value": r[n]} for n in rest], ["measure", "value"])
    return _page(title, body)


def html_comparison(changes: DataFrame, title: str = "Comparison", most: int = 1000) -> str:
    """Changes as a page: a summary line, scores and drift of each pair."""
    rows, more = _first(changes.orderBy("key"), most)
    body = "".join(f"<p>{html.escape(r['summary'])}</p>" for r in rows if r.get("summary"))
    return _page(title, body + _table(rows, [c for c in changes.columns if c != "summary"]) + (f"<p>{more}</p>" if more else ""))


def comparison_report(changes: DataFrame, most: int = 1000) -> str:
    out = []
    rows, more = _first(changes.orderBy("key"), most)
    for r in rows:
        out.append(f"{r['key']}: {r['change']:+.1f} ({r['trend']}); better: {r['better'] or '-'}; worse: {r['worse'] or '-'}")
        if r.get("summary"):
            out += [f"  {r['summary']}", f"  churn {r['churn']:.3f}, most volatile {r['volatile'] or '-'}; {r['advice'] or 'no advice'}"]
    return "\n".join([*out, more] if more else out)


def render(saved: str, form: str) -> str:
    """A saved result (JSON object, or JSON lines of one) as json, html or terminal text; other forms are not there."""
    lines = [x for x in saved.splitlines() if x.strip()]
    try:
        data = json.loads(saved)
    except json.JSONDecodeError:
        data = [json.loads(x) for x in lines]
    rows = data if isinstance(data, list) else [data]
    if form == "json":
        return json.dumps(data, indent=2, ensure_ascii=False)
    flat = [{k: v if not isinstance(v, dict | list) else json.dumps(v, ensure_ascii=False) for k, v in r.items()} for r in rows]
    names = list(dict.fromkeys(n for r in flat for n in r))
    if form == "html":
        return _page("Quality", _table([{n: r.get(n) for n in names} for r in flat], names))
    if form == "terminal":
        return "\n".join(", ".join(f"{n}: {r[n]}" for n in names if r.get(n) is not None) for r in flat)
    raise NotImplementedError(form)
