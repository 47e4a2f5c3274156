"""Settings in layers, sizes, times and argument lines: small texts that the driver reads."""

from __future__ import annotations

import os
import re
import tomllib


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, table by table."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(texts: list[str], prefix: str = "", env: dict[str, str] | None = None) -> dict:
    """TOML texts in order, then the environment's ``PREFIX_SECTION__KEY`` variables; later ones win."""
    out: dict = {}
    for t in texts:
        out = merged(out, tomllib.loads(t))
    for name, value in sorted((os.environ if env is None else env).items()):
        if prefix and name.startswith(prefix + "_"):
            *path, last = name[len(prefix) + 1 :].lower().split("__")
            try:
                v = tomllib.loads(f"v = {value}")["v"]
            except tomllib.TOMLDecodeError:
                v = value
            leaf: dict = {last: v}
            for p in reversed(path):
                leaf = {p: leaf}
            out = merged(out, leaf)
    return out


def size(text: str | int) -> int:
    """Bytes of ``100MB``, ``1.5 KiB``, ``7``; units are powers of 1024."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*([0-9.]+)\s*(|[KMG]?B|[KMG]|[KMG]IB)\s*", text.upper())
    if not m or not re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", m[1]):
        raise ValueError(f"`{text}` is not a size")
    return int(float(m[1]) * 1024 ** (" KMG".index(m[2][0]) if m[2] and m[2] != "B" else 0))


def split(line: str) -> list[str]:
    """Arguments between white space; quotes keep it, nothing is expanded."""
    out = []
    for m in re.finditer(r"""(?:[^\s"']|"[^"]*(?:"|$)|'[^']*(?:'|$))+""", line):
        out.append(re.sub(r"""\"([^"]*)(?:"|$)|'([^']*)(?:'|$)""", lambda q: q[1] if q[1] is not None else q[2], m[0]))
    return out


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h
