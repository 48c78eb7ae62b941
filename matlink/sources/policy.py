"""Category policies and dictionary from YAML, as plain values and as Spark literals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = Path(__file__).resolve().parent.parent / "policies"
_LEVEL_TEXT = {"core": "Must match", "ext": "Conflict vetoes; a value stated on one side only flags the pair"}


class PolicyError(ValueError):
    """A policy file says something that can't be meant; the message has file and problem."""


@dataclass(frozen=True)
class Policy:
    category: str
    version: int
    critical_default: bool
    core: tuple[str, ...]
    extended: tuple[str, ...]
    rule_text: dict[str, str] = field(default_factory=dict)

    def rows(self) -> list[tuple[str, str, str]]:
        """(attribute, level, rule text) in order."""
        named = [(a, "core") for a in self.core] + [(a, "ext") for a in self.extended]
        return [(a, level, self.rule_text.get(a, _LEVEL_TEXT[level])) for a, level in named]


@dataclass(frozen=True)
class Dictionary:
    abbreviations: dict[str, str]
    vocabulary: frozenset[str]
    protected: frozenset[str]
    units: dict[str, str]
    ambiguous_units: frozenset[str]
    headers: dict[str, str]


def parse_policies(text: str, name: str = "policies") -> dict[str, Policy]:
    """Policies by category; a rule text needs an attribute, and a category one policy."""
    out: dict[str, Policy] = {}
    for entry in yaml.safe_load(text) or []:
        try:
            p = Policy(entry["category"], int(entry["version"]), bool(entry["critical_default"]), tuple(entry["core"]), tuple(entry.get("extended") or ()), dict(entry.get("rule_text") or {}))
        except (KeyError, TypeError, ValueError) as e:
            raise PolicyError(f"{name}: incomplete policy: {e}") from e
        if stray := sorted(set(p.rule_text) - {*p.core, *p.extended}):
            raise PolicyError(f"{name}: {p.category}: rule text of no attribute: {', '.join(stray)}")
        if p.category in out:
            raise PolicyError(f"{name}: two policies of {p.category}")
        out[p.category] = p
    return out


def parse_dictionary(text: str, name: str = "words") -> Dictionary:
    raw = yaml.safe_load(text)
    vocabulary, protected = frozenset(raw["vocabulary"]), frozenset(raw["protected"])
    if both := sorted(vocabulary & protected):
        raise PolicyError(f"{name}: vocabulary and protected share {', '.join(both)}")
    units = {alias.upper(): unit for unit, aliases in raw["units"].items() for alias in aliases}
    headers = {alias: target for target, aliases in raw["headers"].items() for alias in [*aliases, target.replace("_", " ")]}
    return Dictionary(dict(raw["abbreviations"]), vocabulary, protected, units, frozenset(raw["ambiguous_units"]), headers)


@cache
def policies() -> dict[str, Policy]:
    return parse_policies((_HERE / "categories.yaml").read_text(), "categories.yaml")


@cache
def dictionary() -> Dictionary:
    return parse_dictionary((_HERE / "words.yaml").read_text(), "words.yaml")


def literal_map(pairs: dict) -> Column:
    """A small map of literals."""
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def policy_map(of: dict[str, Policy]) -> Column:
    """category -> array of (attr, level, text)."""
    entries = []
    for name, p in of.items():
        rows = [F.struct(F.lit(a).alias("attr"), F.lit(level).alias("level"), F.lit(text).alias("text")) for a, level, text in p.rows()]
        entries += [F.lit(name), F.array(*rows)]
    return F.create_map(*entries)


def policy_table(spark: SparkSession, of: dict[str, Policy]) -> DataFrame:
    """One row for each attribute of each policy."""
    rows = [(p.category, p.version, p.critical_default, i, a, level, text) for p in of.values() for i, (a, level, text) in enumerate(p.rows())]
    return spark.createDataFrame(rows, "category string, version int, critical_default boolean, pos int, attr string, level string, rule_text string")
