"""The candidate profile: a small driver-side configuration value."""
from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from vacancia import rules
from vacancia.functions.text import tokenize_literal


@dataclass(frozen=True)
class Profile:
    name: str
    graduation: str = ""
    degree: str = ""
    citizenship: tuple[str, ...] = ()
    location_preference: tuple[str, ...] = ()
    experience_years: int = 0
    role_targets: tuple[str, ...] = ()
    hard_constraints: tuple[tuple[str, str], ...] = ()
    strong: tuple[str, ...] = ()
    working: tuple[str, ...] = ()
    exposure: tuple[str, ...] = ()
    highlights: tuple[str, ...] = field(default=())

    @staticmethod
    def from_dict(d: dict) -> "Profile":
        skills = d.get("skills", {})
        return Profile(
            name=d["name"], graduation=d.get("graduation", ""), degree=d.get("degree", ""),
            citizenship=tuple(d.get("citizenship", ())),
            location_preference=tuple(d.get("location_preference", ())),
            experience_years=int(d.get("experience_years", 0)),
            role_targets=tuple(d.get("role_targets", ())),
            hard_constraints=tuple((c["type"], c["value"]) for c in d.get("hard_constraints", ())),
            strong=tuple(skills.get("strong", ())), working=tuple(skills.get("working", ())),
            exposure=tuple(skills.get("exposure", ())), highlights=tuple(d.get("highlights", ())),
        )

    def constraint(self, kind: str) -> str | None:
        return next((v for k, v in self.hard_constraints if k == kind), None)

    def constraints(self, kind: str) -> list[str]:
        return [v for k, v in self.hard_constraints if k == kind]

    @property
    def skills(self) -> tuple[str, ...]:
        return self.strong + self.working


def load_profile(path: str | None = None) -> Profile:
    """Read a profile from ``path``, ``$VACANCIA_PROFILE`` or ``./profile.json``."""
    for candidate in (path, os.environ.get("VACANCIA_PROFILE"), "profile.json"):
        if candidate and os.path.exists(candidate):
            with open(candidate, encoding="utf-8") as fh:
                return Profile.from_dict(json.load(fh))
    raise FileNotFoundError("no profile: pass a path or set VACANCIA_PROFILE")


def expand_query(profile: Profile) -> list[str]:
    """Distinct query terms: role targets, strong and working skills, fixed role words."""
    words = [t for text in profile.role_targets + profile.skills for t in tokenize_literal(text)]
    return list(dict.fromkeys(words + list(rules.QUERY_EXPANSION)))
