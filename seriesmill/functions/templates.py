"""Templates: dotted names to tagged ones, compiled to one CASE expression."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_pattern(glob: str) -> str:
    """A leading or trailing * leaves that end open, an inner * stands for part of one component; empty: any name with a dot."""
    if not glob:
        return r"\."
    begin, end = "^", r"\z"
    if glob.startswith("*"):
        begin, glob = "", glob[1:]
    if glob.endswith("*"):
        end, glob = "", glob[:-1]
    return begin + glob.replace(".", r"\.").replace("*", r"[^\.]*") + end


def _pairs(texts: Sequence[str]) -> dict[str, str]:
    out = {}
    for t in texts:
        if not t:
            continue
        key, sep, value = t.partition("=")
        if not sep:
            raise ValueError(f"a tag needs key=value: {t!r}")
        out[key] = value.partition("=")[0]
    return out


@dataclass(frozen=True)
class Template:
    """`[filter] template [tag=value,...]`"""

    pattern: str
    parts: tuple[str, ...]
    tags: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Template:
        words = re.split(" +", text.strip())
        if len(words) > 3 or not words[0]:
            raise ValueError(f"wrong template: {text!r}")
        glob, tags = "", ""
        if len(words) == 3:
            glob, body, tags = words
        elif len(words) == 2:
            glob, body, tags = ("", words[0], words[1]) if "=" in words[1] else (words[0], words[1], "")
        else:
            body = words[0]
        return cls(filter_pattern(glob), tuple(body.split(".")), _pairs(tags.split(",")))

    def matches(self, path: Column, size: Column) -> Column:
        fits = size >= len(self.parts) if self.parts[-1].endswith("*") else size == len(self.parts)
        return path.rlike(self.pattern) & fits

    def wire_form(self, names: Column, separator: str, common: dict[str, str]) -> Column:
        """`measurement;tag=value...`"""
        name: list[Column] = []
        tags: dict[str, list[Column]] = {k: [F.lit(v)] for k, v in (common | self.tags).items()}
        for i, part in enumerate(self.parts):
            here = F.get(names, F.lit(i))
            if part == "measurement*":
                name.append(F.array_join(F.slice(names, i + 1, F.size(names)), separator))
                break
            if part == "measurement":
                name += [here, F.lit(separator)]
            elif part:
                tags.setdefault(part, []).append(here)
        whole = F.regexp_replace(F.concat(*name) if name else F.lit(""), "_$", "")
        ends = [F.concat(F.lit(f";{k}="), F.concat_ws(separator, *v)) for k, v in tags.items()]
        return F.concat(whole, *ends)


def apply_templates(path: Column, templates: Sequence[Template], separator: str = ".", tags: Sequence[str] = (), compat: bool = False) -> Column:
    """Wire form of the first template that matches; a path with tags, or that none matches, stays (compat: becomes empty)."""
    common, names = _pairs(tags), F.split(path, r"\.", -1)
    size = F.size(names)
    out = F.when(F.contains(path, F.lit(";")), path)
    for t in templates:
        out = out.when(t.matches(path, size), t.wire_form(names, separator, common))
    return out.otherwise(F.lit("") if compat else path)
