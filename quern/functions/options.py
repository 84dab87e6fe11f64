"""Parsing and clamping of request options, on the driver."""

from __future__ import annotations


def split_list(text: str) -> list[str]:
    return [x for raw in text.split(",") if (x := raw.strip().lower())]


def canonical_engine(name: str) -> str:
    return {"ddg": "duckduckgo"}.get(name, name)


def engine_set(text: str) -> set[str]:
    """Names of engines; ``none`` stands for no engine."""
    return {canonical_engine(x) for x in split_list(text)} - {"none"}


def engines_by_names(text: str, known: tuple[str, ...] = ("google", "bing", "duckduckgo")) -> list[str]:
    names = [canonical_engine(x) for x in split_list(text)]
    if unknown := [x for x in names if x not in known]:
        raise ValueError(f"unknown engine {unknown[0]!r}, known are {', '.join(known)}")
    if not names:
        raise ValueError("no engine selected")
    return names


def result_counts(text: str) -> dict[str, int]:
    """``google=20,bing=30`` as a mapping."""
    out = {}
    for pair in split_list(text):
        name, sign, value = pair.partition("=")
        if not sign or not value.strip().isdigit():
            raise ValueError(f"bad result count {pair!r}, want engine=count")
        out[canonical_engine(name.strip())] = int(value)
    return out


def clamp_page(limit: int | None, offset: int | None, most: int = 500, default: int = 50) -> tuple[int, int]:
    """A page size outside 1..most becomes the default, an offset below 0 becomes 0."""
    size = limit or 0
    return (size if 0 < size <= most else default), max(0, offset or 0)


def clamp_projection(limit: int | None, cap: int) -> int:
    cap = max(1, cap)
    return cap if not limit or limit <= 0 or limit > cap else limit


def clamp_k(k: int | None, default: int = 10, most: int = 100) -> int:
    return default if not k or k <= 0 else min(k, most)


def bool_or(value: bool | None, default: bool) -> bool:
    return default if value is None else value


def required(**values: str | None) -> None:
    """Raise where a required value is missing or blank."""
    for name, value in values.items():
        if value is None or not str(value).strip():
            raise ValueError(f"{name} is required")
