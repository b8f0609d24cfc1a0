"""Configuration: TOML with defaults, units and a check of unknown keys."""

from __future__ import annotations

import re
import socket
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def duration(text: str) -> float:
    """Seconds of `1h30m`, `250ms`, `-1.5s`, `0`."""
    m = re.fullmatch(r"([+-]?)((?:[0-9]*\.?[0-9]+|[0-9]+\.)(?:ns|us|µs|ms|s|m|h))+", text)
    if text in ("0", "+0", "-0"):
        return 0.0
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"([0-9.]+)(ns|us|µs|ms|s|m|h)", text))
    return -total if m[1] == "-" else total


def size(text: str | int) -> int:
    """Bytes of `512m`, `4k`, `1g` or a plain number."""
    t = str(text).lower()
    m = re.fullmatch(r"([+-]?[0-9]+)([kmg]?)", t)
    if not m or int(m[1]) < 0:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]]


def compression(text: str) -> str:
    if text not in ("none", "lz4"):
        raise ValueError(f"compression {text!r} isn't supported")
    return text


@dataclass(frozen=True)
class AutoInterval:
    """`unhandled:interval,...`: the interval of the largest threshold that the number of unhandled files reaches."""

    rules: tuple[tuple[int, float], ...] = ()
    default: float = 1.0

    @classmethod
    def parse(cls, text: str, default: float = 1.0) -> AutoInterval:
        rules = []
        for part in filter(None, (p.strip() for p in text.split(","))):
            threshold, sep, interval = part.partition(":")
            if not sep or not re.fullmatch(r"[+-]?[0-9]+", threshold):
                raise ValueError(f"not an interval rule: {part!r}")
            rules.append((int(threshold), duration(interval)))
        return cls(tuple(sorted(rules, key=lambda r: r[0])), default)

    def interval(self, unhandled: int) -> float:
        return max(((t, i) for t, i in self.rules if unhandled >= t), key=lambda r: r[0], default=(0, self.default))[1]


#: Sections, their keys and defaults, as text where they have units.
DEFAULTS: dict[str, dict[str, Any]] = {
    "common": {"metric-prefix": "carbon.agents.{host}", "metric-endpoint": "local", "metric-interval": "1m0s", "max-cpu": 1},
    "data": {"path": "/data/spool/", "chunk-interval": "1s", "chunk-auto-interval": "", "chunk-max-size": 0, "compression": "none", "compression-level": 0, "utc-date": False},
    "udp": {"listen": ":2003", "enabled": True, "drop-future": "0s", "drop-past": "0s", "drop-longer-than": 0, "log-incomplete": False},
    "tcp": {"listen": ":2003", "enabled": True, "drop-future": "0s", "drop-past": "0s", "drop-longer-than": 0, "read-timeout": "2m0s"},
    "pickle": {"listen": ":2004", "enabled": True, "drop-future": "0s", "drop-past": "0s", "drop-longer-than": 0},
    "grpc": {"listen": ":2005", "enabled": False, "drop-future": "0s", "drop-past": "0s", "drop-longer-than": 0},
    "prometheus": {"listen": ":2006", "enabled": False, "drop-future": "0s", "drop-past": "0s", "drop-longer-than": 0},
    "telegraf-http-json": {"listen": ":2007", "enabled": False, "drop-future": "0s", "drop-past": "0s", "drop-longer-than": 0, "concat": "_"},
    "convert-to-tagged": {"enabled": False, "separator": "", "tags": [], "templates": []},
}
UPLOAD = {
    "type": "points", "table": "", "threads": 1, "url": "", "timeout": "1m0s", "cache-ttl": "12h0m0s", "zero-timestamp": False, "date": "", "tree-date": "1970-02-12",
    "disable-daily-index": False, "ignored-patterns": [], "ignored-tagged-metrics": [], "hash": "", "compression": "none", "compression-level": 0,
}
_DURATIONS = {"metric-interval", "chunk-interval", "drop-future", "drop-past", "read-timeout", "timeout", "cache-ttl"}


@dataclass
class Config:
    sections: dict[str, dict[str, Any]]
    uploads: dict[str, dict[str, Any]] = field(default_factory=dict)

    def drop_rules(self, receiver: str) -> dict[str, int]:
        """Arguments for operators.filters.drop_reason."""
        s = self.sections[receiver]
        return {"future": int(s["drop-future"]), "past": int(s["drop-past"]), "longest": s["drop-longer-than"]}


def _section(name: str, defaults: Mapping[str, Any], given: Mapping[str, Any], exact: bool) -> dict[str, Any]:
    if exact and (unknown := sorted(set(given) - set(defaults))):
        raise ValueError(f"unknown keys in [{name}]: {', '.join(unknown)}")
    out = {k: given.get(k, v) for k, v in defaults.items()}
    for k in out.keys() & _DURATIONS:
        out[k] = duration(str(out[k]))
    if "compression" in out:
        compression(out["compression"])
    if "chunk-max-size" in out:
        out["chunk-max-size"] = size(out["chunk-max-size"])
    if "chunk-auto-interval" in out:
        out["chunk-auto-interval"] = AutoInterval.parse(out["chunk-auto-interval"], out["chunk-interval"])
    return out


def parse(text: str, exact: bool = True) -> Config:
    given = tomllib.loads(text)
    if exact and (unknown := sorted(set(given) - set(DEFAULTS) - {"upload", "logging"})):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    sections = {name: _section(name, d, given.get(name, {}), exact) for name, d in DEFAULTS.items()}
    common = sections["common"]
    common["metric-prefix"] = common["metric-prefix"].replace("{host}", socket.gethostname().replace(".", "_"))
    uploads = {name: _section(f"upload.{name}", UPLOAD, u, exact) for name, u in given.get("upload", {}).items()}
    for name, u in uploads.items():
        if u["type"] not in ("points", "points-reverse", "index", "tagged", "tree", "series", "series-reverse"):
            raise ValueError(f"upload.{name}: unknown type {u['type']!r}")
    return Config(sections, uploads)


def default_toml() -> str:
    def value(v: Any) -> str:
        return str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)

    return "\n".join(f"[{name}]\n" + "".join(f"{k} = {value(v)}\n" for k, v in keys.items()) for name, keys in DEFAULTS.items())
