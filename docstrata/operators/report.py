"""Timeline, recent activity and the project report. Tables with a row for each artifact, and texts of sections, are joined by
merging, as in direction.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vocabulary import SECTIONS


def timeline(dates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Events: where each artifact is placed, and what else its content dates."""
    rows = dates.join(artifacts.select("artifact_id", "original_filename").hint("merge"), "artifact_id")
    said = (F.col("source") == "content") & (F.coalesce("evidence", F.lit("")) != "")
    placed = rows.where("is_chosen").select("project_id", "artifact_id", F.col("ts").alias("event_date"), F.concat(F.lit("placement:"), F.col("source")).alias("source"), F.when(said, F.concat_ws(" — ", "original_filename", "evidence")).otherwise(F.col("original_filename")).alias("description"), "confidence")
    told = rows.where("not is_chosen and source = 'content'").select("project_id", "artifact_id", F.col("ts").alias("event_date"), F.lit("content_described").alias("source"), F.coalesce(F.nullif("evidence", F.lit("")), F.lit("(no evidence text captured)")).alias("description"), "confidence")
    return placed.unionByName(told)


def timeline_span(events: DataFrame) -> DataFrame:
    placed = events.where(F.col("source").startswith("placement:"))
    out = placed.groupBy("project_id").agg(F.min("event_date").alias("earliest"), F.max("event_date").alias("latest"))
    return out.withColumn("days", F.floor((F.unix_micros("latest") - F.unix_micros("earliest")) / F.lit(86_400_000_000)).cast("long"))


def recent_activity(events: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    placed = events.where(F.col("source").startswith("placement:"))
    top = placed.withColumn("rank", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("event_date"), "artifact_id"))).where(F.col("rank") <= n)
    line = F.format_string("- %s — %s (confidence %.2f)", F.date_format("event_date", "yyyy-MM-dd"), F.col("name"), F.col("confidence"))
    return top.join(names.select("artifact_id", "name").hint("merge"), "artifact_id").select("project_id", F.col("rank").cast("long").alias("rank"), "artifact_id", line.alias("line"))


def lines(rows: DataFrame, line: Column, order: list[Column], out: str) -> DataFrame:
    """project_id, out: the lines of a project in order."""
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy("project_id").orderBy(*order))).withColumn("_line", line)
    return numbered.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda s: s["_line"]), "\n").alias(out))


def overview(projects: DataFrame, classification: DataFrame, domains: DataFrame, phases: DataFrame, artifacts: DataFrame, span: DataFrame) -> DataFrame:
    """project_id, content of the overview section."""
    counts = artifacts.groupBy("project_id").agg(F.count("*").alias("n"))
    model = lines(phases, F.col("phase_name"), [F.col("ordinal")], "model").join(domains, "project_id")
    rows = projects.select("project_id").join(classification, "project_id", "left").join(model, "project_id", "left").join(counts, "project_id", "left").join(span, "project_id", "left")
    domain = F.when(F.col("domain").isNotNull(), F.concat(F.format_string("- **Domain:** %s (confidence %.2f)", "domain", "confidence"), F.when(F.col("confirmed"), " (confirmed)").otherwise(""))).otherwise("- **Domain:** not yet classified.")
    phase = F.when(F.col("model").isNotNull(), F.concat(F.lit("- **Phase model:** "), F.col("template_domain"), F.lit(" — "), F.replace("model", F.lit("\n"), F.lit(" → ")))).otherwise("- **Phase model:** not yet selected.")
    count = F.concat(F.lit("- **Artifacts:** "), F.coalesce("n", F.lit(0)).cast("string"))
    when = F.when(F.col("earliest").isNotNull(), F.concat(F.lit("- **Timeline span:** "), F.date_format("earliest", "yyyy-MM-dd"), F.lit(" to "), F.date_format("latest", "yyyy-MM-dd"), F.lit(" ("), F.col("days").cast("string"), F.lit(" days)"))).otherwise("- **Timeline span:** no dated artifacts yet.")
    return rows.select("project_id", F.concat_ws("\n", domain, phase, count, when).alias("content"))


def open_gaps_section(gaps: DataFrame) -> DataFrame:
    """project_id, content: open gaps, structural ones first, surest first."""
    line = F.concat(F.lit("- "), F.col("description"), F.format_string(" (confidence %.2f)", "confidence"))
    order = [F.desc("confidence"), F.col("description")]
    parts = [lines(gaps.where((F.col("status") == "open") & (F.col("type") == t)), line, order, c) for t, c in (("structural", "s"), ("promised_unfulfilled", "p"))]
    both = parts[0].join(parts[1], "project_id", "full_outer")
    s, p = F.concat(F.lit("**Structural:**\n"), F.col("s")), F.concat(F.lit("**Promised, unfulfilled:**\n"), F.col("p"))
    return both.select("project_id", F.concat_ws("\n\n", s, p).alias("content"))


def stale_section(labels: DataFrame, names: DataFrame) -> DataFrame:
    """project_id, content: superseded artifacts, surest first."""
    rows = labels.where("label = 'superseded'").join(names.select("artifact_id", "name").hint("merge"), "artifact_id")
    return lines(rows, F.format_string("- %s — %s (confidence %.2f)", "name", "label", "confidence"), [F.desc("confidence"), F.col("artifact_id")], "content")


def direction_section(projects: DataFrame, snapshots: DataFrame, current: DataFrame, names: DataFrame, narratives: DataFrame | None = None) -> DataFrame:
    """project_id, content: the narrative (project_id, narrative) where there is one, else the snapshot's
    summary and the names of the current artifacts (project_id, artifact_id, rn) in order. The wordings are
    fixed values."""
    listed = lines(current.join(names.select("artifact_id", "name").hint("merge"), "artifact_id"), F.concat(F.lit("- "), F.col("name")), [F.col("rn")], "listed")
    rows = projects.select("project_id").join(snapshots.select("project_id", "summary").hint("merge"), "project_id", "left").join(listed.hint("merge"), "project_id", "left")
    head = F.lit("\n\nArtifacts currently part of this direction:\n")
    plain = F.when(F.col("summary").isNull(), "Direction has not yet been inferred for this project.").otherwise(F.concat("summary", F.coalesce(F.concat(head, F.col("listed")), F.lit(""))))
    if narratives is None:
        return rows.select("project_id", plain.alias("content"))
    given = F.when(F.col("summary").isNotNull(), F.col("narrative"))
    return rows.join(narratives.select("project_id", "narrative").hint("merge"), "project_id", "left").select("project_id", F.coalesce(given, plain).alias("content"))


def activity_section(projects: DataFrame, recent: DataFrame) -> DataFrame:
    """project_id, content: the lines of recent_activity in order."""
    listed = recent.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("content"))
    return projects.select("project_id").join(listed.hint("merge"), "project_id", "left").select("project_id", F.coalesce("content", F.lit("No timeline activity recorded yet.")).alias("content"))


def to_render(current: DataFrame, prints: DataFrame) -> DataFrame:
    """project_id, section, action of the sections in prints (project_id, section, fingerprint of the inputs)
    against the current report's: carried where the fingerprint is unchanged, else rendered, or new."""
    old = current.select("project_id", "section", F.col("fingerprint").alias("was"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("fingerprint"), "carried").otherwise("rendered")
    return prints.join(old.hint("merge"), ["project_id", "section"], "left").select("project_id", "section", action.alias("action"))


def regenerate(current: DataFrame, prints: DataFrame, renderers: dict[str, Callable[[DataFrame], DataFrame]], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """project_id, section, action, content: sections of current (project_id, section, fingerprint, content)
    whose fingerprint is unchanged are carried over word for word. Only of projects with other ones is a
    section rendered: renderers take those projects (project_id) and give project_id, content."""
    todo = keep(to_render(current, prints))
    carried = todo.where("action = 'carried'").join(current.select("project_id", "section", "content").hint("merge"), ["project_id", "section"])
    out = carried.select("project_id", "section", "action", "content")
    for section, render in renderers.items():
        own = todo.where((F.col("section") == section) & (F.col("action") != "carried")).select("project_id", "section", "action")
        out = out.unionByName(own.join(render(own.select("project_id")).hint("merge"), "project_id").select("project_id", "section", "action", "content"))
    return out


def compose(projects: DataFrame, sections: DataFrame, version: Column, generated: Column) -> DataFrame:
    """project_id, markdown: title, version and all sections (project_id, section, content) in order."""
    pivoted = sections.groupBy("project_id").pivot("section", [s for s, _ in SECTIONS]).agg(F.first("content"))
    rows = projects.join(pivoted.hint("merge"), "project_id", "left")
    parts = [F.concat(F.lit("# Project Report — "), F.col("name")), F.concat(F.lit("_Version "), version.cast("string"), F.lit(", generated "), F.date_format(generated, "yyyy-MM-dd HH:mm"), F.lit(" UTC_")), F.lit("")]
    for section, title in SECTIONS:
        parts += [F.lit(f"## {title}"), F.coalesce(F.col(section), F.lit("No data.")), F.lit("")]
    return rows.select("project_id", F.concat(F.rtrim(F.regexp_replace(F.concat_ws("\n", *parts), r"\s+$", "")), F.lit("\n")).alias("markdown"))


def current_version(versions: DataFrame, sections: DataFrame) -> DataFrame:
    """project_id, version, section, content of each project's last version (project_id, version)."""
    last = versions.groupBy("project_id").agg(F.max("version").alias("version"))
    return sections.join(last.hint("merge"), "project_id")
