"""Registered functions, each for all addresses or for some domains only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trailsift.functions import urls as u


@dataclass(frozen=True)
class Action:
    name: str
    build: Callable[..., Column]
    domains: tuple[str, ...]


class ActionRegistry:
    """Named column functions.  ``call`` gives NULL where the address is outside the action's domains."""

    def __init__(self, exclude: Sequence[str] = ()) -> None:
        self.exclude = frozenset(exclude)
        self.actions: dict[str, Action] = {}

    def action(self, name: str, domains: Sequence[str] = ()) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
        """Register a function that builds a column; excluded names are left out."""

        def register(build: Callable[..., Column]) -> Callable[..., Column]:
            if name not in self.exclude:
                self.actions[name] = Action(name, build, tuple(domains))
            return build

        return register

    def pandas_action(self, spark: SparkSession, name: str, fn, schema: str, domains: Sequence[str] = ()) -> None:
        """Register an Arrow-batched Python function, also under its name in SQL."""
        if name in self.exclude:
            return
        udf = F.pandas_udf(fn, schema)
        spark.udf.register(name, udf)
        self.actions[name] = Action(name, udf, tuple(domains))

    def call(self, name: str, url: Column, *arguments: Column) -> Column:
        action = self.actions[name]
        result = action.build(*arguments)
        if not action.domains:
            return result
        allowed = F.lit(False)
        for pattern in action.domains:
            allowed = allowed | u.domain_pattern_match(url, pattern)
        return F.when(allowed, result)


# Fields a site profile must have.
PROFILE_FIELDS = ["site_id", "item_link_selector", "item_id_regex", "manifest_template"]


@dataclass(frozen=True)
class SiteProfile:
    """One site as data: how its addresses, item links and detail pages are read."""

    site_id: str
    item_link_selector: str
    item_id_regex: str
    manifest_template: str
    results_host: str = ""
    results_path: str = ""
    search_url_base: str = ""
    host_suffixes: tuple[str, ...] = ()
    detail: dict | None = None

    @classmethod
    def of(cls, profile: dict) -> SiteProfile:
        missing = [f for f in PROFILE_FIELDS if not profile.get(f)]
        if missing:
            raise ValueError("profile lacks: " + ", ".join(missing))
        known = {k: v for k, v in profile.items() if k in cls.__dataclass_fields__}
        known["site_id"] = str(profile["site_id"]).strip().lower()
        known["host_suffixes"] = tuple(h.lower() for h in profile.get("host_suffixes", ()) if h)
        return cls(**known)

    def covers(self, url: Column) -> Column:
        names = "|".join(s.replace(".", r"\.") for s in self.host_suffixes)
        return u.host(url).rlike(rf"^(?:.*\.)?(?:{names})$") if names else F.lit(False)
