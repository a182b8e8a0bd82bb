"""Options of an extraction: a frozen record that is shipped with the function that runs on the workers."""

from __future__ import annotations

import configparser
import datetime
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

FORMATS = ("csv", "html", "json", "markdown", "python", "txt", "xml", "xmltei")
#: Names in a configuration file, and the fields that they set.
CONFIG_FIELDS = {
    "MIN_EXTRACTED_SIZE": "min_extracted_size",
    "MIN_EXTRACTED_COMM_SIZE": "min_extracted_comments",
    "MIN_OUTPUT_SIZE": "min_output_size",
    "MIN_OUTPUT_COMM_SIZE": "min_output_comments",
    "MIN_FILE_SIZE": "min_file_size",
    "MAX_FILE_SIZE": "max_file_size",
    "MIN_DUPLCHECK_SIZE": "min_duplicate_size",
    "MAX_REPETITIONS": "max_repetitions",
    "MAX_TREE_SIZE": "max_tree_size",
    "SLEEP_TIME": "sleep_time",
    "DOWNLOAD_TIMEOUT": "download_timeout",
    "MAX_REDIRECTS": "max_redirects",
    "EXTRACTION_TIMEOUT": "extraction_timeout",
    "USER_AGENTS": "user_agents",
    "COOKIE": "cookie",
}


@dataclass(frozen=True)
class Options:
    output: str = "python"
    fast: bool = False
    focus: str = "balanced"
    comments: bool = True
    formatting: bool = False
    links: bool = False
    images: bool = False
    tables: bool = True
    dedup: bool = False
    lang: str | None = None
    url: str | None = None
    with_metadata: bool = False
    only_with_metadata: bool = False
    tei_validation: bool = False
    author_blacklist: frozenset = frozenset()
    url_blacklist: frozenset = frozenset()
    prune: tuple[str, ...] = ()
    date_params: dict = field(default_factory=dict)
    cleaned: tuple[str, ...] | None = None
    stripped: tuple[str, ...] | None = None
    min_extracted_size: int = 250
    min_extracted_comments: int = 1
    min_output_size: int = 1
    min_output_comments: int = 1
    min_file_size: int = 10
    max_file_size: int = 20_000_000
    min_duplicate_size: int = 100
    max_repetitions: int = 2
    max_tree_size: int | None = None
    closed_references: bool = False
    single_spaces: bool = False
    sleep_time: float = 5.0
    download_timeout: int = 30
    max_redirects: int = 2
    extraction_timeout: int = 30
    user_agents: tuple[str, ...] = ()
    cookie: str | None = None

    @classmethod
    def of(cls, *, output_format: str = "python", favor_precision: bool = False, favor_recall: bool = False, include_formatting: bool | None = None, **named) -> Options:
        """Options from the keyword arguments of the public functions. Recall goes before precision; Markdown implies formatting unless that is switched off."""
        if output_format not in FORMATS:
            raise AttributeError(f"unknown output format: {output_format}")
        renamed = {"include_comments": "comments", "include_links": "links", "include_images": "images", "include_tables": "tables", "deduplicate": "dedup", "target_language": "lang", "prune_xpath": "prune", "date_extraction_params": "date_params"}
        known = {f.name for f in fields(cls)}
        values = {}
        for name, value in named.items():
            name = renamed.get(name, name)
            if name not in known:
                raise TypeError(f"unknown option: {name}")
            if name in ("author_blacklist", "url_blacklist"):
                value = frozenset(value or ())
            elif name == "prune":
                value = (value,) if isinstance(value, str) else tuple(value or ())
            elif name == "date_params":
                value = dict(value or {})
            values[name] = value
        values["formatting"] = output_format == "markdown" if include_formatting is None else bool(include_formatting)
        values["focus"] = "recall" if favor_recall else "precision" if favor_precision else "balanced"
        if values.get("only_with_metadata") or values.get("url_blacklist") or values.get("author_blacklist") or output_format == "xmltei":
            values["with_metadata"] = True
        return cls(output=output_format, **values)

    def but(self, **changes) -> Options:
        return replace(self, **changes)


def read_config(path: str | None = None) -> dict:
    """The settings of an INI file (section ``DEFAULT``) as option values; a missing file is an error."""
    if path is None:
        return {}
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    parser = configparser.ConfigParser()
    parser.read(path)
    out = {}
    for name, value in parser.defaults().items():
        target = CONFIG_FIELDS.get(name.upper())
        if target is None or not value.strip():
            continue
        if target == "user_agents":
            out[target] = tuple(line.strip() for line in value.splitlines() if line.strip())
        elif target == "cookie":
            out[target] = value
        elif target == "sleep_time":
            out[target] = float(value)
        elif target == "max_tree_size":
            out[target] = int(value) if value.isdecimal() and int(value) > 0 else None
        else:
            out[target] = int(value)
    return out


def date_bounds(extensive: bool = True, today: str | None = None) -> dict:
    """Default parameters of the date search; pass ``today`` for results that don't change."""
    return {"original": True, "extensive": extensive, "latest": today or datetime.date.today().isoformat()}
