"""Settings files: profiles, prepared profiles and properties, read from YAML or JSON and checked."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

# Keys of a profile, defaults, the names a profile may have, and sections that aren't the graph's.
PROFILE_KEYS = ("name", "weighting", "custom_model_files", "custom_model", "turn_costs", "navigation_mode")
DEFAULTS = {"graph.location": "graph-cache", "routing.snap_preventions_default": "tunnel, bridge, ferry"}
NAME = re.compile("[a-z0-9_-]+")
OTHER_SECTIONS = ("server", "logging")


@dataclass
class Profile:
    name: str
    weighting: str = "custom"
    custom_model_files: list = field(default_factory=list)
    custom_model: dict | None = None
    turn_costs: dict | None = None
    navigation_mode: str = ""
    hints: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict) -> Profile:
        """Keys that no profile has become hints."""
        known = {k: v for k, v in raw.items() if k in PROFILE_KEYS and v is not None}
        if not str(known.get("name", "")).strip():
            raise ValueError("a profile without a name")
        return cls(**known, hints={k: v for k, v in raw.items() if k not in PROFILE_KEYS})


@dataclass
class Settings:
    profiles: list[Profile] = field(default_factory=list)
    prepared: list[str] = field(default_factory=list)
    landmarks: list[dict] = field(default_factory=list)
    properties: dict = field(default_factory=dict)
    other: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict | None) -> Settings:
        """From a document that has everything at its root or in a single section of any name; one with other sections only has no settings of a graph."""
        raw = dict(raw or {})
        other = {k: raw.pop(k) or {} for k in OTHER_SECTIONS if k in raw}
        sections = [v for v in raw.values() if isinstance(v, dict)]
        own = dict(sections[0] if len(raw) == 1 and sections else raw)
        lists = {k: own.pop(k, None) or [] for k in ("profiles", "profiles_ch", "profiles_lm")}
        for kind in ("profiles_ch", "profiles_lm"):
            if any(not str((p or {}).get("profile") or "").strip() for p in lists[kind]):
                raise ValueError(f"an entry of {kind} names no profile")
        made = cls([Profile.of(p) for p in lists["profiles"]], [p["profile"] for p in lists["profiles_ch"]], lists["profiles_lm"], DEFAULTS | own, other)
        return made.checked()

    def checked(self) -> Settings:
        """The settings, or an error where names are wrong, repeated or unknown."""
        names = [p.name for p in self.profiles]
        for p in self.profiles:
            if not NAME.fullmatch(p.name):
                raise ValueError(f"a profile's name has small letters, digits, - and _ only: {p.name}")
            if p.weighting != "custom":
                raise ValueError(f"profile {p.name}: weighting {p.weighting} isn't known")
        by_landmarks = [x["profile"] for x in self.landmarks]
        for kind, given in (("profiles", names), ("profiles_ch", self.prepared), ("profiles_lm", by_landmarks)):
            if twice := sorted({n for n in given if given.count(n) > 1}):
                raise ValueError(f"{kind}: more than one {', '.join(twice)}")
            if unknown := sorted(set(given) - set(names)):
                raise ValueError(f"{kind}: unknown profile {', '.join(unknown)}")
        leans = {x["profile"]: x.get("preparation_profile") or "" for x in self.landmarks}
        for name, on in leans.items():
            if on and on not in names:
                raise ValueError(f"{name} leans on the unknown profile {on}")
            if on and (on not in leans or leans[on]):
                raise ValueError(f"{name} can't lean on {on}, which isn't prepared by itself")
        return self

    def text(self, key: str, default: str = "") -> str:
        value = self.properties.get(key, default)
        return json.dumps(value) if isinstance(value, bool) else str(value)

    def number(self, key: str, default: float = 0) -> float:
        value = self.properties.get(key, default)
        return type(default)(value) if value is not None else default

    def flag(self, key: str, default: bool = False) -> bool:
        return self.text(key, json.dumps(default)).strip().lower() == "true"

    def words(self, key: str) -> list[str]:
        """A value of words between commas, or a list."""
        value = self.properties.get(key, [])
        found = value if isinstance(value, list) else str(value).split(",")
        return [w for w in (str(x).strip() for x in found) if w]

    def profile(self, name: str) -> Profile:
        for p in self.profiles:
            if p.name == name:
                return p
        raise ValueError(f"the profile {name!r} isn't known; there are {[p.name for p in self.profiles]}")


def parse(text: str) -> Settings:
    """Settings of a YAML or JSON text. JSON needs nothing else; YAML needs its library."""
    try:
        return Settings.of(json.loads(text)) if text.strip() else Settings.of({})
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("settings that aren't JSON need the yaml library") from missing
        return Settings.of(yaml.safe_load(text))


def read(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
