"""Profiles: which indicators count, how much, and how a fund is built from the scores.

Every setting is one row of a table below: its name, default, kind and allowed range. One loop reads and checks
them, and one writer chooses TOML spellings by type.
"""

import json
import tomllib
from dataclasses import dataclass, field
from functools import singledispatch
from typing import NamedTuple

#: Fixed values.
CATEGORIES = ("economic", "social", "environmental")


class Setting(NamedTuple):
    """kind: number, flag, text, choice (of the tuple allowed) or list. allowed of a number: least, most, is the least itself allowed."""

    default: object
    kind: str
    allowed: tuple = ()

    def read(self, name: str, given):
        match self.kind:
            case "number":
                low, high, closed = self.allowed
                value = type(self.default)(given)
                fits = (value >= low if closed else value > low) and (high is None or value <= high)
            case "flag":
                value = given if isinstance(given, bool) else {"true": True, "false": False}.get(str(given).lower())
                fits = value is not None
            case "choice":
                value, fits = given, given in self.allowed
            case "list":
                value, fits = list(given), not isinstance(given, str)
            case _:
                value, fits = str(given), True
        if not fits:
            raise ValueError(f"{name} = {given!r} is out of range")
        return value


#: Names, defaults and ranges of a profile's own settings and of its fund's.
SCORING = {
    "name": Setting("profile", "text"), "description": Setting("", "text"), "min_weight_share": Setting(0.5, "number", (0, 1, True)),
    "sector_relative": Setting(False, "flag"), "min_year": Setting(2022, "number", (0, None, True)),
}
PORTFOLIO = {
    "method": Setting("tilt", "choice", ("tilt", "exclude")), "benchmark": Setting("equal", "choice", ("equal", "cap")), "tilt_strength": Setting(0.6, "number", (0, None, True)),
    "exclude_bottom_pct": Setting(0.1, "number", (0, 0.999999, True)), "max_weight": Setting(0.05, "number", (0, 1, False)), "sector_neutral": Setting(True, "flag"),
    "exclude_sub_industries": Setting([], "list"),
}


def checked(table: dict[str, Setting], given: dict, what: str) -> dict:
    """All settings of the table: those given, in range, and defaults for the rest."""
    if strangers := sorted(given.keys() - table.keys()):
        raise ValueError(f"{what} has no settings {strangers}; it has {sorted(table)}")
    return {k: s.read(k, given[k]) if k in given else s.default for k, s in table.items()}


@dataclass(frozen=True)
class Profile:
    name: str
    category_weights: dict = field(default_factory=lambda: dict.fromkeys(CATEGORIES, 1.0))
    indicator_weights: dict = field(default_factory=dict)
    sector_relative: bool = SCORING["sector_relative"].default
    min_year: int = SCORING["min_year"].default
    min_weight_share: float = SCORING["min_weight_share"].default
    portfolio: dict = field(default_factory=dict)
    description: str = ""

    def __post_init__(self):
        checked(SCORING, {k: getattr(self, k) for k in SCORING}, "a profile")
        weight = Setting(1.0, "number", (0, None, True))
        checked(dict.fromkeys(CATEGORIES, weight), self.category_weights, "categories")
        checked(dict.fromkeys(self.indicator_weights, weight), self.indicator_weights, "indicators")


#: A file's tables and the attributes they fill.
TABLES = {"categories": "category_weights", "indicators": "indicator_weights", "portfolio": "portfolio"}


def load_profile(text: str) -> Profile:
    """A profile from TOML: settings of SCORING, then the tables [categories] (1 where left out), [indicators] and [portfolio]."""
    given = tomllib.loads(text)
    tables = {name: given.pop(name, {}) for name in TABLES}
    tables["categories"] = dict.fromkeys(CATEGORIES, 1.0) | tables["categories"]
    return Profile(**checked(SCORING, given, "a profile"), **{TABLES[name]: body for name, body in tables.items()})


@singledispatch
def spelt(x) -> str:
    """x as TOML. A JSON string is a TOML string too."""
    return json.dumps(x, ensure_ascii=False)


@spelt.register
def _(x: float) -> str:
    return repr(x)


@spelt.register(list)
@spelt.register(tuple)
def _(x) -> str:
    return f"[{', '.join(spelt(y) for y in x)}]"


def to_toml(profile: Profile) -> str:
    """TOML text that load_profile() turns back into the same profile."""
    blocks = [("", {k: getattr(profile, k) for k in SCORING}), *((f"[{name}]\n", getattr(profile, attribute)) for name, attribute in TABLES.items())]
    return "\n".join(head + "".join(f"{k} = {spelt(v)}\n" for k, v in body.items()) for head, body in blocks if body)


def portfolio_settings(profile: Profile, overrides: dict | None = None, sub_industries: set | None = None) -> dict:
    """The fund's settings: defaults, under the profile's, under the overrides. Sub-industries must be among those given, if any are."""
    found = checked(PORTFOLIO, profile.portfolio | (overrides or {}), f"the fund of profile {profile.name}")
    if sub_industries is not None and (unknown := sorted(set(found["exclude_sub_industries"]) - sub_industries)):
        raise ValueError(f"unknown sub-industries {unknown}")
    return found
