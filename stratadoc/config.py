"""Settings from the environment: a table of names, defaults and what values are allowed, checked when they are read."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

#: What a value may look like, and what it means.
_FLAGS = dict.fromkeys(("1", "true", "yes", "on"), True) | dict.fromkeys(("0", "false", "no", "off"), False)


@dataclass(frozen=True)
class Setting:
    """An environment variable: its default, its meaning (None: not allowed), and what is said of values that have none."""

    name: str
    default: object
    means: Callable[[str], object]
    asks: str

    def read(self, env: Mapping[str, str]) -> object:
        if self.name not in env:
            return self.default
        value = self.means(env[self.name].strip().casefold())
        if value is None:
            raise ValueError(f"{self.name}: {self.asks}")
        return value


def one_of(name: str, default: str, *allowed: str) -> Setting:
    return Setting(name, default, {a: a for a in allowed}.get, f"one of {', '.join(allowed)} is expected")


def yes_or_no(name: str, default: bool) -> Setting:
    return Setting(name, default, _FLAGS.get, f"one of {', '.join(_FLAGS)} is expected")


def at_least(name: str, default: int, least: int) -> Setting:
    return Setting(name, default, lambda v: int(v) if re.fullmatch(r"[+-]?[0-9]+", v) and int(v) >= least else None, f"a whole number from {least} is expected")


#: By the names of the fields of Settings.
SETTINGS = {
    "pdf_mode": one_of("PDF_MODE", "native", "native", "adaptive"),
    "allow_needs_review": yes_or_no("ALLOW_NEEDS_REVIEW", False),
    "max_chunk_words": at_least("MAX_CHUNK_WORDS", 350, 1),
    "fail_on_zero_chunks": yes_or_no("FAIL_ON_ZERO_CHUNKS", True),
}


@dataclass(frozen=True)
class Settings:
    """How documents are ingested; extraction prefers pages' own text, or adapts by page."""

    pdf_mode: str = SETTINGS["pdf_mode"].default
    allow_needs_review: bool = SETTINGS["allow_needs_review"].default
    max_chunk_words: int = SETTINGS["max_chunk_words"].default
    fail_on_zero_chunks: bool = SETTINGS["fail_on_zero_chunks"].default

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        return cls(**{f.name: SETTINGS[f.name].read(os.environ if env is None else env) for f in fields(cls)})


def selected_pages(total: int, *, start: int = 0, end: int | None = None, indexes: list[int] | None = None) -> list[int]:
    """Page indexes from 0: a range whose end is excluded, or a list, sorted and each once; what isn't in the document raises."""
    if indexes is not None and (start, end) != (0, None):
        raise ValueError("give a range of pages or a list, not both")
    chosen = sorted(set(range(start, total if end is None else end) if indexes is None else indexes))
    if not chosen or chosen[0] < 0 or chosen[-1] >= total:
        raise ValueError(f"no page, or not one of {total} pages")
    return chosen


def labelled_paths(values: list[str]) -> dict[str, str]:
    """label=path arguments; a value without a label or a path, or a label twice, raises."""
    out: dict[str, str] = {}
    for value in values:
        label, _, path = (x.strip() for x in value.partition("="))
        if not label or not path or label in out:
            raise ValueError(f"label=path is expected, each label once: {value}")
        out[label] = path
    return out


def page_numbers(value: str) -> list[int]:
    """Pages like 1,3-5 as a sorted list of numbers from 1, each once."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in value.split(","))):
        first, dash, last = (x.strip() for x in part.partition("-"))
        if not first.isdigit() or (dash and not last.isdigit()):
            raise ValueError(f"not a page or a range of pages: {part}")
        a, b = int(first), int(last) if dash else int(first)
        if a < 1 or b < a:
            raise ValueError(f"pages begin at 1 and ranges ascend: {part}")
        out.update(range(a, b + 1))
    if not out:
        raise ValueError("there is no page")
    return sorted(out)
