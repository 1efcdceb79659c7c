"""Gazetteer configurations: YAML to checked, frozen objects."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from placelink.plans import dependency

TYPES = {"text": "string", "integer": "bigint", "real": "double", "blob": "binary", "geometry": "string"}
PREDICATES = {"attribute": ("equals",), "spatial": ("within", "intersects", "contains")}


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    index: bool = False
    drop: bool = False
    srid: int | None = None
    expression: str | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"attribute {self.name!r} has unknown type {self.type!r}")
        if (self.type == "geometry") != (self.srid is not None):
            raise ValueError(f"attribute {self.name!r}: geometries need an srid, others take none")


@dataclass(frozen=True)
class Join:
    method: str
    kind: str
    predicate: str
    left: str
    right: str
    left_transform: str | None = None
    right_transform: str | None = None

    def __post_init__(self):
        if self.predicate not in PREDICATES.get(self.kind, ()):
            raise ValueError(f"unknown {self.kind} predicate {self.predicate!r}")
        moved = {self.left_transform, self.right_transform} - {None}
        if self.kind == "attribute" and moved:
            raise ValueError("attribute joins take no geometry transform")
        if moved - {"centroid"}:
            raise ValueError(f"unknown transform {sorted(moved)[0]!r}")


@dataclass(frozen=True)
class Source:
    name: str
    file: str
    kind: str
    url: str | None
    path: str | None
    separator: str | None
    skiprows: int
    original: tuple[Attribute, ...]
    derived: tuple[Attribute, ...]
    select: tuple[tuple[str, str | None], ...] | None
    joins: tuple[Join, ...]
    identifier: tuple[str, ...]
    names: tuple[tuple[str, str | None], ...]

    def __post_init__(self):
        if (self.url is None) == (self.path is None):
            raise ValueError(f"source {self.name!r} needs either a url or a path")
        shapes = [a.name for a in (*self.original, *self.derived) if a.type == "geometry"]
        if len(shapes) > 1:
            raise ValueError(f"source {self.name!r} has more than one geometry")
        if shapes and shapes != ["geometry"]:
            raise ValueError(f"the geometry of source {self.name!r} must be called 'geometry'")
        if self.kind == "tabular":
            if self.separator is None:
                raise ValueError(f"tabular source {self.name!r} needs a separator")
        elif self.kind == "spatial":
            if self.separator is not None or self.skiprows:
                raise ValueError(f"spatial source {self.name!r} takes neither separator nor skiprows")
            if not shapes:
                raise ValueError(f"spatial source {self.name!r} needs a geometry")
        else:
            raise ValueError(f"source {self.name!r} has unknown kind {self.kind!r}")
        for ref in (*self.identifier, *(n for n, _ in self.names)):
            if ref.split(".")[0] != self.name:
                raise ValueError(f"features of {self.name!r} must use its own columns, not {ref!r}")

    @property
    def srid(self) -> int | None:
        return next((a.srid for a in (*self.original, *self.derived) if a.type == "geometry"), None)

    @property
    def needs(self) -> set[str]:
        refs = [r for r, _ in self.select or ()] + [r for j in self.joins for r in (j.left, j.right)]
        return {r.split(".")[0] for r in refs}


@dataclass(frozen=True)
class Gazetteer:
    name: str
    sources: tuple[Source, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.name or not all(c.isalnum() or c in "_-" for c in self.name):
            raise ValueError("a gazetteer's name may have letters, digits, '_' and '-' only")
        known = [s.name for s in self.sources]
        if len(set(known)) < len(known):
            raise ValueError("names of sources must differ")
        for source in self.sources:
            for other in sorted(source.needs - set(known)):
                raise ValueError(f"the view of {source.name!r} uses unknown source {other!r}")

    def ordered(self) -> list[Source]:
        """Sources after those they need."""
        by = {s.name: s for s in self.sources}
        return [by[n] for n in dependency.order({s.name: s.needs for s in self.sources})]


def _reference(given) -> str:
    if isinstance(given, dict) and set(given) == {"source", "column"}:
        given = f"{given['source']}.{given['column']}"
    parts = str(given).split(".")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"column reference {given!r} must have the form 'source.column'")
    return ".".join(parts)


def _attribute(given: dict) -> Attribute:
    return Attribute(given["name"], given["type"], bool(given.get("index", False)), bool(given.get("drop", False)), given.get("srid"), given.get("expression"))


def _join(given: dict) -> Join:
    c = given["condition"]
    default = {"attribute": "equals", "spatial": "within"}.get(c.get("type"), "")
    return Join(given["method"], c.get("type", ""), c.get("predicate", default), _reference(c["left"]["column"]), _reference(c["right"]["column"]), c["left"].get("transform"), c["right"].get("transform"))


def parse(given: dict) -> Gazetteer:
    """A configuration from nested dictionaries; ``ValueError`` says what is wrong."""
    sources = []
    for s in given.get("sources", ()):
        view, features = s.get("view") or {}, s.get("features") or {}
        sources.append(
            Source(
                name=s["name"],
                file=s["file"],
                kind=s["kind"],
                url=s.get("url"),
                path=s.get("path"),
                separator=s.get("separator"),
                skiprows=int(s.get("skiprows", 0)),
                original=tuple(map(_attribute, s["attributes"]["original"])),
                derived=tuple(map(_attribute, s["attributes"].get("derived") or ())),
                select=tuple((_reference(i["column"]), i.get("alias")) for i in view["select"]) if view else None,
                joins=tuple(map(_join, view.get("join") or ())),
                identifier=tuple(_reference(i["column"]) for i in features.get("identifier", ())),
                names=tuple((_reference(i["column"]), i.get("separator")) for i in features.get("names", ())),
            )
        )
    return Gazetteer(given["name"], tuple(sources))


def load(path: str | Path) -> Gazetteer:
    """A configuration from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return parse(yaml.safe_load(file))


def safe_name(text: str) -> str:
    """A table name: what is neither letter, digit nor '_' is left out; must not be empty."""
    out = re.sub(r"[^0-9A-Za-z_]", "", text)
    if not out:
        raise ValueError(f"no table name can be made of {text!r}")
    return out
