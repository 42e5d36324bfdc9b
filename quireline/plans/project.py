"""What a project's commands do, end to end: extract, check, hold, terms, commit and status."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.operators import memory, rendering, reports, selection, terms
from quireline.operators.checks import Rules, check_segments
from quireline.operators.context import system_prompt
from quireline.operators.segment_text import segment_text
from quireline.plans.export import rendered
from quireline.plans.extract import FORMATS, reused, segmented
from quireline.plans.translate import Provider, repair, translate
from quireline.sources import projects, settings
from quireline.sources.documents import read_documents
from quireline.sources.state import State, issue_lines, target_token, written

REPORTS = f"{projects.STATE_FOLDER}/reports"


def extract(state: State, docs: DataFrame, lang: str, config: Mapping, known: DataFrame | None = None, dnt: Sequence[str] = ()) -> int:
    """Segment documents (doc_id, source, format, eol, text) for a language under the project's options and save them; the commit.

    Wording is carried over from the stored state of the same documents, then taken from the memory ``known``.
    """
    options = settings.format_options(config, "text")
    mode, chapters = options["paragraph_mode"], tuple(options["chapter_patterns"])
    as_set = FORMATS | {"text": lambda d, text, terms_: segment_text(d, text, terms_, mode=mode, chapters=chapters)}
    told = docs.withColumns({"lang": F.lit(lang), "tone": F.lit(config["tone"])})
    segments, nodes = segmented(told, dnt, formats=as_set)
    operations = tuple((config.get("normalize") or {}).get(lang, ()))
    prior = state.current(lang=lang) if state.versions() else None
    out = reused(segments, lang, prior=prior, memory=known, operations=operations, dnt=dnt, keep_key=True)
    return state.replace(told.select("doc_id", "lang", "source", "format", "eol", "tone"), nodes, out.drop("outcome"))


def sources(spark: SparkSession, root: str, config: Mapping) -> DataFrame:
    """The documents below the project's ``sources`` folder, read by its formats and encodings."""
    names = {name: settings.format_options(config, name)["encodings"] for name in ("markdown", "text")}
    folder = os.path.join(root, projects.confined_path(str(config["sources"]), root))
    return read_documents(spark, folder, extensions=(config.get("formats") or {}).get("map"), encodings=names, root=root)


def draft(state: State, lang: str, config: Mapping, provider: Provider, mode: str = "draft", glossary: Sequence[Mapping] = (), style: tuple[str, Sequence[Mapping]] = ("", ()), ids: DataFrame | None = None, limit: int = 0, over_human: bool = False, dry_run: bool = False) -> DataFrame:
    """Ask a provider for a language's pending (or, by ``mode``, drafted) segments and store what is fit; a row for each segment.

    ``dry_run`` asks nobody and gives the segments and characters that would be sent.
    """
    segments = state.current(lang=lang)
    chosen = selection.select(segments, mode, ids, limit=limit, over_human=over_human, document=("doc_id", "lang"))
    if dry_run:
        return selection.size_of(chosen)
    batch, (preamble, notes) = config["batch"], style
    prompt = system_prompt(config["source_lang"], lang, config["tone"], mode, bool(batch["context"]), preamble=preamble)
    operations = tuple((config.get("normalize") or {}).get(lang, ()))
    out = written(translate(segments, chosen, lang, provider, prompt, batch["size"], glossary, notes, operations, mode), "drafts")
    state.write_targets(out.where("target IS NOT NULL").select("doc_id", "lang", "id", "target", "origin"), over_human)
    return out


def mend(state: State, rules: Rules, config: Mapping, provider: Provider) -> DataFrame:
    """Ask again for segments that fail a check, in rounds, and store each round; the segments as they stand then."""

    def save(rows: DataFrame, _: int) -> DataFrame:
        state.write_targets(rows.select("doc_id", "lang", "id", "target", "origin"))
        return state.current(lang=rules.lang).drop("issues")

    prompt = system_prompt(config["source_lang"], rules.lang, config["tone"], "repair", bool(config["batch"]["context"]))
    segments = state.current(lang=rules.lang).drop("issues")
    return repair(segments, rules, provider, save, config["batch"]["max_repair_rounds"], system=prompt, size=config["batch"]["size"], glossary=rules.glossary)


def check(state: State, rules: Rules, folder: str | None = None, doc_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, issues) of a language's documents, or one of them: issues are stored where wording has not changed meanwhile.

    With a folder, each report is a file there as well.
    """
    found = check_segments(state.current(doc_id, rules.lang).drop("issues"), rules)
    state.write_issues(found.select("doc_id", "lang", "id", issue_lines(F.col("issues")).alias("issues"), target_token(F.col("target")).alias("token")))
    each = reports.check_reports(found)
    if folder is not None:
        for row in each.toLocalIterator():  # one small row a document, as many files
            reports.write_report(row.asDict(recursive=True), folder)
    return each, found.select("doc_id", "lang", F.col("id").alias("seg"), F.inline("issues"))


def propose_terms(state: State, lang: str, config: Mapping, glossary: DataFrame, append_to: str | None = None, doc_id: str | None = None) -> DataFrame:
    """Terms of English sources that the glossary lacks, the most frequent first; with a path, appended to that glossary file.

    The rule is one of English capitals, so other source languages are refused.
    """
    if str(config.get("source_lang", "en")).split("-")[0].lower() != "en":
        raise ValueError(f"terms are found by English capitals; the source language is {config.get('source_lang')!r}")
    own = config.get("terms") or {}
    found = terms.candidate_terms(state.current(doc_id, lang), own.get("min_count", 2), tuple(own.get("abbreviations", ())), tuple(own.get("stopwords", ())), keys=("doc_id", "lang"))
    fresh = terms.ranked(terms.unknown_terms(found, glossary))
    if append_to is not None:
        distinct = fresh.groupBy("source").agg(F.sum("count").alias("count"))
        projects.append_glossary(append_to, [r["source"] for r in terms.ranked(distinct).toLocalIterator()])
    return fresh


def commit(state: State, lang: str, path: str, tone: str | None = None) -> int:
    """Append a language's wording to its memory, as far as the memory does not hold it just so; the number of the append."""
    spark = state.spark
    held = memory.latest(memory.keyed(memory.read_memory(spark, path))) if os.path.exists(path) else memory.latest(memory.keyed(spark.createDataFrame([], f"{memory.RECORD}, seq long")))
    segments = state.current(lang=lang)
    done = segments.withColumns({"slots": F.transform(F.array_sort(F.map_entries("slots"), lambda a, b: a.key.cast("int") - b.key.cast("int")), lambda e: e.value.original), "tone": F.lit(tone)})
    return memory.append(memory.to_commit(done, held), path)


def render(state: State, root: str, config: Mapping, lang: str, fallback: bool = False) -> list[str]:
    """Write a language's documents below a project's folder, each where the output pattern says; the paths."""
    facts, nodes, segments = (state.read(t, lang=lang) for t in ("documents", "nodes", "segments"))
    out = []
    for row in rendered(facts, nodes, segments, config["output_pattern"], fallback).select("path", "text").toLocalIterator():
        path = projects.confined_path(row["path"], root)
        projects.write_document(os.path.join(root, path), row["text"])
        out.append(path)
    return sorted(out)


def project_status(spark: SparkSession, path: str, lang: str | None = None) -> dict:
    """One project: its documents with counts and reports, its languages and totals; ``error`` instead, if it cannot be read."""
    entry = {"path": path, "name": os.path.basename(path.rstrip(os.sep)) or path, "source_lang": None, "targets": [], "documents": [], "languages": [], "totals": None, "untracked": [], "error": None}
    try:
        file = os.path.join(path, projects.CONFIG_FILE)
        config = settings.load_config(open(file, encoding="utf-8").read() if os.path.exists(file) else None)
        state = State(spark, os.path.join(path, projects.STATE_FOLDER, "state"))
        told = {"source_lang": config.get("source_lang"), "targets": [t for t in config["targets"] if isinstance(t, str)] if isinstance(config.get("targets"), list) else []}
        rows, languages, totals = [], [], None
        if state.versions():
            docs = state.read("documents", lang=lang)
            counts = reports.document_counts(state.current(lang=lang))
            folder = os.path.join(path, REPORTS)
            stored = reports.read_reports(spark, folder) if os.path.isdir(folder) and os.listdir(folder) else spark.createDataFrame([], "doc_id string, lang string, segments long, translated long, errors long, warnings long")
            every = reports.with_reports(docs.join(counts, ["doc_id", "lang"]), stored)
            every = every.withColumns({"project": F.lit(path), "errors": F.col("report.errors"), "warnings": F.col("report.warnings"), "output": rendering.output_path(str(config["output_pattern"]), F.col("lang"), F.col("source"))})
            rows = [r.asDict(recursive=True) for r in every.select("doc_id", "lang", "source", "output", "segments", "translated", "pending", "held", "checked", "stale", "errors", "warnings").orderBy("doc_id", "lang").toLocalIterator()]
            sums = [r.asDict() for r in reports.rollup(every).orderBy("lang").collect()]  # a row for each language, and one
            languages, totals = [r for r in sums if r["lang"] is not None], next((r for r in sums if r["lang"] is None), None)
        return entry | told | {"documents": rows, "languages": languages, "totals": totals, "untracked": _untracked(spark, path, config, state, told["targets"], lang)}
    except Exception as error:  # whatever one project's files hold, the others are still told of
        return entry | {"error": str(error) or type(error).__name__}


def _untracked(spark: SparkSession, path: str, config: Mapping, state: State, targets: Sequence[str], lang: str | None) -> list[dict]:
    """Source files and target languages that no stored document has; ``sources`` of the configuration is a folder below the project."""
    folder = config.get("sources")
    if not isinstance(folder, str) or not os.path.isdir(os.path.join(path, projects.confined_path(folder, path))):
        return []
    found = sources(spark, path, config).where("error IS NULL").select("doc_id", F.col("source").alias("label"))
    known = state.read("documents").select("doc_id", "lang") if state.versions() else spark.createDataFrame([], "doc_id string, lang string")
    pairs = reports.untracked(found, spark.createDataFrame([(t,) for t in targets], "lang string"), known)
    return [r.asDict() for r in (pairs.where(F.col("lang") == lang) if lang else pairs).orderBy("label", "lang").toLocalIterator()]


def status(spark: SparkSession, root: str, scan: bool = False, lang: str | None = None) -> list[dict]:
    """The project in a folder or, with ``scan``, all projects below it, by path."""
    return [project_status(spark, path, lang) for path in (projects.find_projects(root) if scan else [root])]
