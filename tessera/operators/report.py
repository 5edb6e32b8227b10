"""Reports as Markdown text, put together on the driver from small summary tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import groups as g
from tessera.operators import profile as p


@dataclass
class Report:
    """What a profile found. Everything here is bounded by columns and options, not by rows."""

    name: str
    rows: int
    processed: int
    columns: list[dict]
    samples: list[list[str]] = field(default_factory=list)
    groups: list[dict] = field(default_factory=list)
    correlations: list[tuple[str, str, float]] | None = None
    warnings: list[str] = field(default_factory=list)


def _by(rows, key) -> dict:
    found: dict = {}
    for row in rows:
        found.setdefault(row[key], []).append(row)
    return found


def analyze(table: DataFrame, order: list[str], name: str = "", options: p.ProfileOptions = p.ProfileOptions()) -> Report:
    """Profile a table: the first rows in the order of ``order`` columns (which are not profiled if
    their names begin with two underscores)."""
    hidden = tuple(c for c in order if c.startswith("__"))
    shown, warnings = p.capped_columns(table.select([c for c in table.columns if c not in hidden]), options.max_columns)
    counts = p.row_counts(table, options.max_rows).first()
    taken = p.first_rows(table, order, options.max_rows)
    if counts["processed"] < counts["rows"]:
        warnings.append(f"processed only {counts['processed']}/{counts['rows']} rows due to MaxRows")
    key = g.group_key(shown, list(options.group_by))
    keyed = taken.select(*shown.columns, *([key.alias("__group")] if key is not None else []))
    long = p.cells(keyed, options, ("__group",) if key is not None else ())
    if options.max_rows > 0:
        long = long.cache()  # bounded; all cells of a whole table are rather worked out again
    summary = p.column_summary(long)
    columns = [r.asDict() for r in summary.orderBy("pos").collect()]
    tops, unique = _by(p.top_values(long).orderBy("pos", "place").collect(), "pos"), {r["pos"]: r["n_unique"] for r in p.category_unique(long).collect()}
    numeric = [c for c in columns if c["kind"] == "numeric"]
    wide = long.where(F.col("pos").isin([c["pos"] for c in numeric]))
    if options.outliers and numeric:
        found = {r["pos"]: r for r in p.robust_outliers(wide, ["pos"], "number", options.outlier_threshold).collect()}
        for c in numeric:
            if c["pos"] in found:
                c |= {k: found[c["pos"]][k] for k in ("n_outliers", "max_abs_z", "threshold")}
    texts = {c["pos"]: shown.columns[c["pos"]] for c in columns if c["kind"] == "text"}
    examples = _by(p.examples_by_column(taken, texts, order).orderBy("pos", "place").collect(), "pos") if texts else {}
    for c in columns:
        c["top"], c["unique"] = [(r["value"], r["n"]) for r in tops.get(c["pos"], [])], unique.get(c["pos"], 0)
        if c["kind"] == "text":
            c["examples"] = [r["value"] for r in examples.get(c["pos"], [])]
    samples = [list(r) for r in p.head_sample(taken.select(*dict.fromkeys([*shown.columns, *hidden])), order, options.sample_rows).select(*shown.columns).collect()]
    report = Report(name, counts["rows"], counts["processed"], columns, samples, warnings=warnings)
    numbers = keyed.select(*(["__group"] if key is not None else []), *(_number(shown.columns[c["pos"]], options).alias(c["name"]) for c in numeric))
    names = [c["name"] for c in numeric]
    if key is not None:
        top = g.top_groups(keyed, "__group").collect()
        metrics = _by(g.group_metrics_top(g.group_numeric(wide, "__group"), "__group").orderBy("place").collect(), "__group")
        pairs = _by(g.correlations_per_group(numbers, names, "__group").orderBy("place").collect(), "__group") if options.correlations_per_group and len(names) > 1 else {}
        report.groups = [{"key": r["__group"], "n": r["n"], "metrics": metrics.get(r["__group"], []), "pairs": pairs.get(r["__group"], [])} for r in top]
    if options.correlations and len(names) > 1:
        report.correlations = [(r["a"], r["b"], r["r"]) for r in g.top_correlations(g.correlation_pairs(numbers, names)).collect()]
    long.unpersist()
    return report


def _number(header: str, options: p.ProfileOptions):
    from tessera.functions.values import convert_unit, parse_numeric, split_unit

    return convert_unit(parse_numeric(F.col(f"`{header}`").cast("string"), options.decimal, options.thousands), split_unit(header)[1], options.unit_targets)[0]


def _safe(value: str) -> str:
    return value.replace("\n", " ").replace("|", "/")


def _column_line(c: dict) -> str:
    name = (c["name"].strip() or "(unnamed)") + (f" [{c['unit']}]" if c["unit"] else "")
    total = c["non_null"] + c["missing"]
    line = f"- {name}: {c['kind']} (non-null {c['non_null']}, missing {100.0 * c['missing'] / total if total else 0.0:.1f}%)"
    if c["kind"] == "numeric":
        line += " — " + ", ".join(f"{k} {c[k] or 0.0:.4g}" for k in ("min", "max", "mean", "std"))
        if c.get("threshold"):
            line += f"; outliers: {c['n_outliers']} above |z|>{c['threshold']:.1f}" + (f" (max |z|≈{c['max_abs_z']:.2f})" if c["max_abs_z"] > 0 else "")
    elif c["kind"] == "categorical" and c["top"]:
        line += " — top: " + ", ".join(f"{_safe(v)}({n})" for v, n in c["top"]) + (f"; unique={c['unique']}" if c["unique"] > len(c["top"]) else "")
    elif c["kind"] == "text" and c.get("examples"):
        line += " — e.g., " + " | ".join(map(_safe, c["examples"]))
    return line


def markdown(report: Report) -> str:
    rows = f"~{report.rows} (processed {report.processed})" if 0 < report.processed < report.rows else str(report.rows)
    lines = ["[DATASET SUMMARY]", *([f"File: {report.name}"] if report.name else []), *([f"Rows: {rows}"] if report.rows else []), f"Columns: {len(report.columns)}"]
    lines += ["", "[SCHEMA]", *map(_column_line, report.columns)]
    if report.groups:
        lines += ["", "[GROUP-BY SUMMARY]"]
        for of in report.groups:
            lines += [f"- {of['key']} (n={of['n']})", *(f"  • {m['name']}: mean {m['mean']:.4g} (min {m['min']:.4g}, max {m['max']:.4g})" for m in of["metrics"])]
    if any(of["pairs"] for of in report.groups):
        lines += ["", "[PER-GROUP CORRELATIONS]"]
        for of in filter(lambda of: of["pairs"], report.groups):
            lines += [f"- {of['key']}:", *(f"  • {x['a']} ~ {x['b']}: r={x['r']:.3f}" for x in of["pairs"][:8])]
    if report.correlations is not None:
        lines += ["", "[CORRELATIONS]", *(f"- {a} ~ {b}: r={r:.3f}" for a, b, r in report.correlations)]
    if report.samples:
        row = lambda values: "| " + " | ".join(values) + " |"
        lines += ["", "[HEAD AND SAMPLE ROWS]", row(c["name"].strip() or "(unnamed)" for c in report.columns), row("---" for _ in report.columns), *(row(map(_safe, s)) for s in report.samples)]
    if report.warnings:
        lines += ["", "[NOTES]", *(f"- {w}" for w in report.warnings)]
    return "\n".join(lines) + "\n"


def sheet_slug(name: str) -> str:
    return re.sub(r"[^a-z0-9-]", "", re.sub(r"[ _-]", "-", name.lower())).strip("-") or "sheet"


def write_summary(text: str, folder: str, base: str, sheet: str = "") -> str:
    """Write ``base``.summary.md into a folder on the driver; a number is added where the name is taken."""
    os.makedirs(folder, exist_ok=True)
    stem = base + (f"__sheet-{sheet_slug(sheet)}" if sheet else "")
    path, n = os.path.join(folder, f"{stem}.summary.md"), 2
    while os.path.exists(path):
        path, n = os.path.join(folder, f"{stem}__{n}.summary.md"), n + 1
    with open(path, "x", encoding="utf-8") as out:
        out.write(text)
    return path


def evidence_markdown(project: dict, documents: list[dict], items: list[dict]) -> str:
    """The evidence report; ``project`` has name, path, provider, model, the numbers of the prompt and
    the retrieval settings (those that are missing or 0 are shown as not set)."""
    limit = lambda key, form: form.format(project[key]) if project.get(key) else "(none)"
    lines = ["## Evidence Report", "", "### Project", f"  Name : {project['name']}", f"  Path : {project.get('path', '')}", "", "### Provider / Model"]
    lines += [f"  Provider     : {project.get('provider') or '(default)'}", f"  Model        : {project.get('model', '')}", *([f"  Model Preset : {project['preset']}"] if project.get("preset") else []), f"  Max Tokens   : {project.get('max_tokens', 0)}", ""]
    lines += ["### Prompt Statistics", f"  Prompt tokens (approx) : {project.get('prompt_tokens', 0)}", f"  Max tokens requested   : {project.get('max_tokens', 0)}", f"  Prompt limit           : {limit('prompt_limit', '{} tokens')}", f"  Budget limit           : {limit('budget', '${:.4f}')}"]
    lines += [f"  Estimated max cost     : ~${project['cost']:.4f}"] if project.get("cost") else []
    lines += ["", "### Retrieval"]
    if project.get("retrieval"):
        lines += ["  Enabled        : yes", f"  Top-K          : {project.get('k', 0)}", f"  Min score      : {project.get('min_score', 0.0):.2f}", f"  Embed model    : {project.get('embed_model') or '(default)'}", f"  Embed provider : {project.get('embed_provider') or '(default)'}"]
    else:
        lines.append("  Enabled : no")
    lines += ["", "### Documents Included in Prompt", *(["  (none)"] if not documents else [])]
    for i, d in enumerate(documents, 1):
        label = f"{d['name']} — {d['description']}" if d.get("description") else d["name"]
        derived = not d.get("path")
        lines += [f"  {i}. {label}{' [derived]' if derived else ''}", f"     Source : {'(derived/analysis artifact)' if derived else d['path']}", f"     Tokens : ~{d['tokens']}"]
    if items:
        lines += ["", "## Retrieval evidence", "", f"  Top-K     : {project.get('k', 0)}", f"  Min score : {project.get('min_score', 0.0):.2f}", *([f"  Max chunks/doc : {project['per_document']}"] if project.get("per_document") else []), ""]
        for item in items:
            lines += [f"  {item['rank']}. [score={item['score']:.4f}] {item['doc_name']} (chunk {item['chunk_id']})", f"     Preview: {item['preview']}"]
    return "\n".join(lines) + "\n"
