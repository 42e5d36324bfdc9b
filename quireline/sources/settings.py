"""Settings of a project: configuration, glossary, protected terms and style sheet. All are small and read by the driver."""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.functions.masking import term_order
from quireline.functions.text import strip
from quireline.functions.values import ABBREVIATIONS, BATCH_SIZE, CHAPTERS, CONTEXT, DEFAULT_TONE, LENGTH_RATIOS, REPAIR_ROUNDS, STOPWORDS, STYLE_BLOCK_MAX, STYLE_PREAMBLE_MAX, TEXT_ENCODINGS
from quireline.operators.checks import Rules
from quireline.sources.projects import CONFIG_FILE, GLOSSARY_HEADER, STATE_FOLDER, language_tag

DEFAULTS: dict[str, Any] = {
    "source_lang": "en",
    "targets": ["zh-TW"],
    "tone": DEFAULT_TONE,
    "output_pattern": "i18n/{lang}/{path}",
    "length_ratio": {k: list(v) for k, v in LENGTH_RATIOS.items()},
    "normalize": {"zh-TW": ["punct", "pangu", "collapse_space"]},
    "lexicon_extra": {},
    "checks_disabled": [],
    "formats": {"map": {}, "text": {"encodings": list(TEXT_ENCODINGS), "paragraph_mode": "auto", "chapter_patterns": list(CHAPTERS)}},
    "terms": {"min_count": 2, "abbreviations": list(ABBREVIATIONS), "stopwords": list(STOPWORDS)},
    "providers": {"stub": {"kind": "stub", "model": "echo"}},
    "routing": {"draft": "stub", "polish": "stub", "repair": "stub"},
    "batch": {"size": BATCH_SIZE, "max_repair_rounds": REPAIR_ROUNDS, "context": CONTEXT},
}


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with ``over`` on top, block by block."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def load_config(text: str | None = None) -> dict:
    """The defaults with a JSON object over them."""
    given = json.loads(text) if text else {}
    if not isinstance(given, dict):
        raise ValueError("the configuration is not an object")
    return merged(DEFAULTS, given)


def _path(key: str) -> list[str]:
    parts = key.split(".")
    if not all(parts):
        raise ValueError(f"{key!r} has an empty part")
    return parts


def get_value(config: Mapping, key: str) -> Any:
    """The value at a dotted key."""
    for part in _path(key):
        if not isinstance(config, Mapping) or part not in config:
            raise KeyError(key)
        config = config[part]
    return config


def set_value(config: Mapping, key: str, value: Any) -> dict:
    """A copy with the value at a dotted key; a plain value on the way is not a block to write into."""
    head, *rest = _path(key)
    below = config.get(head)
    if rest and below is not None and not isinstance(below, Mapping):
        raise ValueError(f"{head!r} is not a block")
    return {**config, head: set_value(below or {}, ".".join(rest), value) if rest else value}


def unset_value(config: Mapping, key: str) -> dict:
    """A copy without a dotted key, and without blocks that this empties."""
    head, *rest = _path(key)
    if head not in config:
        return dict(config)
    out = {k: v for k, v in config.items() if k != head}
    if rest and isinstance(config[head], Mapping):
        below = unset_value(config[head], ".".join(rest))
        if below:
            out[head] = below
    return out


def providers(config: Mapping) -> list[dict]:
    """name, kind and model of the configured providers, by name."""
    return [{"name": n, "kind": (p or {}).get("kind"), "model": (p or {}).get("model")} for n, p in sorted((config.get("providers") or {}).items())]


def route(config: Mapping, stage: str, provider: str | None = None, model: str | None = None) -> tuple[str, str]:
    """(provider, model) of a stage: a call's own choice, else the routing entry, else the provider's model.

    An entry is a provider's name or {provider, model}; a stage without one takes that of ``draft``.
    """
    routing = config.get("routing") or {}
    entry = routing.get(stage, routing.get("draft", ""))
    name, routed = (entry.get("provider"), entry.get("model")) if isinstance(entry, Mapping) else (entry, None)
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"the routing of {stage!r} names no provider")
    if provider and provider != name.strip():
        name, routed = provider, None
    own = (config.get("providers") or {}).get(name.strip()) or {}
    return name.strip(), str(model or routed or own.get("model") or "")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """source, target, forbidden and severity of a comma list without quoting; comments, a header on the first line and short lines are skipped."""
    cells = F.transform(F.split("value", ","), strip)
    whole = spark.read.text(path, wholetext=True)  # a list of terms is a small file; its first line alone may be the header
    every = whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "value"))
    lines = every.where(~strip(F.col("value")).startswith("#") & (strip(F.col("value")) != "")).select("n", cells.alias("c"))
    lines = lines.where((F.size("c") >= 2) & ~((F.col("n") == 0) & (F.lower(F.element_at("c", 1)) == "source")))
    cell = lambda i: F.coalesce(F.try_element_at("c", F.lit(i)), F.lit(""))
    forbidden = F.filter(F.transform(F.split(cell(3), ";"), strip), lambda x: x != "")
    return lines.select(cell(1).alias("source"), cell(2).alias("target"), forbidden.alias("forbidden"), F.when(cell(4) == "", "error").otherwise(cell(4)).alias("severity"))


def protected_terms(text: str) -> list[str]:
    """The do-not-translate list of a text: one a line, ``#`` for comments, longest first."""
    return term_order(text.splitlines())


def style_sheet(text: str) -> tuple[str, list[dict]]:
    """(preamble, blocks of names and notes) of a style sheet; ``#`` lines are dropped, blocks without notes too."""
    sections: list[tuple[list[str], list[str]]] = [([], [])]
    for line in text.splitlines():
        bare = line.strip()
        head = re.fullmatch(r"\[(.+)\]", bare)
        if head:
            names = [n for n in map(str.strip, head[1].split(",")) if n]
            if not names:
                raise ValueError(f"a block header without a name: {bare!r}")
            sections.append((names, []))
        elif not bare.startswith("#"):
            sections[-1][1].append(line)
    notes = ["\n".join(body).strip() for _, body in sections]
    for (names, _), note in zip(sections, notes, strict=True):
        most = STYLE_BLOCK_MAX if names else STYLE_PREAMBLE_MAX
        if len(note) > most:
            raise ValueError(f"{names[0] if names else 'the preamble'}: more than {most} characters")
    return notes[0], [{"names": names, "notes": note} for (names, _), note in zip(sections[1:], notes[1:], strict=True) if note]


# What values a key takes, by its beginning: a test and what to say.
_KINDS: tuple[tuple[str, Any, str], ...] = (
    ("source_lang", lambda v: isinstance(v, str) and _is_tag(v), "a language tag"),
    ("targets", lambda v: isinstance(v, list) and all(isinstance(t, str) and _is_tag(t) for t in v), "a list of language tags"),
    ("tone", lambda v: isinstance(v, str) and v.strip() != "", "a name"),
    ("output_pattern", lambda v: isinstance(v, str) and "{" in v and not set(re.findall(r"\{([^{}]*)\}", v)) - {"lang", "path", "name"}, "a path with {lang}, {path} or {name}"),
    ("batch.size", lambda v: _is_count(v) and v > 0, "a whole number above 0"),
    ("batch.context", lambda v: _is_count(v), "a whole number, 0 or more"),
    ("batch.max_repair_rounds", lambda v: _is_count(v), "a whole number, 0 or more"),
    ("terms.min_count", lambda v: _is_count(v) and v > 0, "a whole number above 0"),
    ("length_ratio.", lambda v: isinstance(v, list) and len(v) == 2 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v) and 0 <= v[0] <= v[1], "two numbers, the lower first"),
    ("checks_disabled", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), "a list of rules"),
    ("formats.text.paragraph_mode", lambda v: v in ("auto", "line", "blank-line", "indent"), "auto, line, blank-line or indent"),
)


def _is_tag(value: str) -> bool:
    try:
        return language_tag(value) == value
    except ValueError:
        return False


def _is_count(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def checked_value(key: str, value: Any) -> Any:
    """A value that its key may have, or an error that says which it takes; keys without a rule take any."""
    for start, good, told in _KINDS:
        if (key == start or start.endswith(".") and key.startswith(start)) and not good(value):
            raise ValueError(f"{key} takes {told}, not {value!r}")
    return value


def write_setting(path: str, key: str, value: Any = None, unset: bool = False) -> dict:
    """Set (checked) or unset a dotted key in a configuration file, which is replaced at once; the file's new content."""
    own = json.loads(Path(path).read_text(encoding="utf-8")) if os.path.exists(path) else {}
    if not isinstance(own, dict):
        raise ValueError(f"{path} is not an object")
    own = unset_value(own, key) if unset else set_value(own, key, checked_value(key, value))
    with open(f"{path}.tmp", "w", encoding="utf-8", newline="\n") as file:
        file.write(json.dumps(own, ensure_ascii=False, indent=2) + "\n")
    os.replace(f"{path}.tmp", path)
    return own


def format_options(config: Mapping, name: str) -> dict:
    """A format's options: the user's block over the defaults; without encodings UTF-8 alone."""
    own = merged(DEFAULTS["formats"].get(name) or {}, (config.get("formats") or {}).get(name) or {})
    return own | {"encodings": tuple(own.get("encodings") or ("utf-8",))}


def rules_of(config: Mapping, lang: str, glossary: Sequence[Mapping] = (), dnt: Sequence[str] = ()) -> Rules:
    """The checks' settings of a language, from a configuration."""
    ratios = {k: tuple(v) for k, v in (config.get("length_ratio") or {}).items()}
    extra = {bad: tuple(row) for bad, row in (config.get("lexicon_extra") or {}).items()}
    return Rules(lang=lang, glossary=glossary, dnt=dnt, disabled=frozenset(config.get("checks_disabled") or ()), lexicon_extra=extra, length_ratios=ratios)


def scaffold(root: str) -> list[str]:
    """Make what a new project's folder lacks; the files made. What is there stays as it is."""
    files = {
        CONFIG_FILE: json.dumps(DEFAULTS, ensure_ascii=False, indent=2) + "\n",
        "config/glossary.csv": GLOSSARY_HEADER,
        "config/dnt.txt": "# terms that stay as they are, one a line\n",
        "config/style.txt": "# notes on style; [Name, Other name] begins the notes on a name\n",
    }
    for folder in (STATE_FOLDER, f"{STATE_FOLDER}/reports", "config"):
        os.makedirs(os.path.join(root, folder), exist_ok=True)
    made = []
    for name, content in files.items():
        with contextlib.suppress(FileExistsError), open(os.path.join(root, name), "x", encoding="utf-8", newline="\n") as file:
            file.write(content)
            made.append(name)
    return made
