"""Field catalog: which fields a record may have and what each operator does with them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

TYPES = ("generic", "year", "date", "float")
MERGES = ("no", "unique", "longest", "range", "all", "first")
MERGEKEYS = ("no", "optional", "required")
SETTINGS = ("no", "postproc", "parameter")
SORTKEYS = ("no", "text", "numeric", "skiparticle")


@dataclass(frozen=True)
class FieldSpec:
    """One field of the catalog."""

    name: str
    type: str = "generic"
    brief: bool = False
    termlist: bool = False
    rank: str | None = None
    sortkey: str = "no"
    merge: str = "no"
    mergekey: str = "no"
    setting: str = "no"
    facetrule: str | None = None
    limitmap: str | None = None
    limitcluster: str | None = None
    icurule: str | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a field needs a name")
        for option, allowed in (
            ("type", TYPES),
            ("merge", MERGES),
            ("mergekey", MERGEKEYS),
            ("setting", SETTINGS),
            ("sortkey", SORTKEYS),
        ):
            if getattr(self, option) not in allowed:
                raise ValueError(f"{self.name}: {option} must be one of {', '.join(allowed)}")
        if self.type == "year":
            object.__setattr__(self, "merge", "range")
        if self.sortkey != "no" and self.merge == "no":
            raise ValueError(f"{self.name}: a field that is not merged can not have a sort key")
        if self.sortkey == "skiparticle" and self.type != "generic":
            raise ValueError(f"{self.name}: skiparticle is only for generic fields")
        if self.merge in ("longest", "unique") and self.type != "generic":
            raise ValueError(f"{self.name}: merge={self.merge} is only for generic fields")
        if self.merge == "range" and self.type == "generic":
            raise ValueError(f"{self.name}: merge=range needs a number field")
        if self.sortkey != "no" and self.merge not in ("longest", "range"):
            raise ValueError(f"{self.name}: only longest and range give a sort key")
        if self.rank is not None:
            parse_weight(self.rank)

    @property
    def numeric(self) -> bool:
        return self.type != "generic"


def parse_weight(spec: str, qualifier: str | None = None) -> int:
    """Weight of `N` or `N field M`: M when the query term is qualified by `field`, else N."""
    parts = str(spec).split()
    if not parts or not parts[0].lstrip("+-").isdigit():
        raise ValueError(f"bad rank specification: {spec!r}")
    if len(parts) >= 3 and qualifier and parts[1] == qualifier:
        return int(parts[2])
    return int(parts[0])


@dataclass(frozen=True)
class Catalog:
    """Ordered fields plus the ranking options and the default sort of a service."""

    fields: tuple[FieldSpec, ...]
    chains: dict = field(default_factory=dict, compare=False)
    rank_cluster: bool = True
    rank_lead: float = 0.0
    rank_follow: float = 0.0
    rank_length: str = "linear"
    default_sort: tuple[tuple[str, bool], ...] = (("relevance", False),)
    session_timeout: int = 60

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("field names must be unique")
        if self.rank_length not in ("linear", "log", "none"):
            raise ValueError("rank_length must be linear, log or none")
        for f in self.fields:
            if f.limitcluster is not None and f.limitcluster not in names:
                raise ValueError(f"{f.name}: limitcluster names an unknown field {f.limitcluster}")

    def __iter__(self) -> Iterator[FieldSpec]:
        return iter(self.fields)

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def chain(self, role: str):
        """Text chain of a role or rule name."""
        from concord.functions.chains import DEFAULT_CHAINS

        found = self.chains.get(role, DEFAULT_CHAINS.get(role))
        if found is None:
            raise ValueError(f"unknown text chain {role!r}")
        return found
