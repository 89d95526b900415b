"""The policy: which columns are personal, how each is masked, and the limits.

A policy is immutable; every change returns a new one. It is small (rules, not
data) and lives on the driver, where the masking plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any

from .functions import vocabulary as V
from .functions.names import Classification, name_classification
from .functions.prose import DEFAULT_RECOGNIZERS, Recognizer


@dataclass(frozen=True)
class Rule:
    """A manual decision about one column; ``pii_type="none"`` excludes it."""

    table: str
    column: str
    pii_type: str
    masking_style: str = "partial"


# An excluded column is neither masked nor announced. It is not the same as a
# column nothing is known about, whose name still speaks.
EXCLUDED = "excluded"

Entry = Classification | str


@dataclass(frozen=True)
class Policy:
    """Settings and classifications for a session.

    ``seed`` has no default on purpose: pseudonyms made with a well-known seed can
    be reversed by guessing. Without ``auto_detect`` reports list decisions only;
    results are still masked by name, which errs on the safe side. ``allowed_schemas``
    bounds what is reported on, not what a query may read. ``allowed_functions`` names the
    functions registered in the session that a read-only statement may call.
    """

    default_style: str = "partial"
    sample_size: int | None = 100  # None: the vote reads every value
    auto_detect: bool = True
    read_only: bool = True
    rules: tuple[Rule, ...] = ()
    allowed_schemas: tuple[str, ...] = ("public",)
    allowed_functions: tuple[str, ...] = ()
    max_rows: int = 1000
    default_schema: str = "public"
    seed: str | None = None
    mask_json_scalars: bool = False
    recognizers: tuple[Recognizer, ...] = DEFAULT_RECOGNIZERS
    entries: Mapping[tuple[str, str], Entry] = field(default_factory=dict)
    styles: Mapping[tuple[str, str], str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        entries, styles = dict(self.entries), dict(self.styles)
        for rule in self.rules:
            key = self._key(rule.table, rule.column)
            entries[key] = _manual(rule.pii_type)
            if rule.masking_style != "partial":
                styles[key] = rule.masking_style
        object.__setattr__(self, "entries", MappingProxyType(entries))
        object.__setattr__(self, "styles", MappingProxyType(styles))

    def table_key(self, table: str) -> str:
        """``Users`` -> ``public.users``; qualified names are only lower-cased."""
        table = table.lower()
        return table if "." in table else f"{self.default_schema}.{table}"

    def _key(self, table: str, column: str) -> tuple[str, str]:
        return self.table_key(table), column.lower()

    def rule(self, table: str, column: str) -> Rule | None:
        """The rule for this table and column; of several, the last one given."""
        key = self._key(table, column)
        return next((r for r in reversed(self.rules) if self._key(r.table, r.column) == key), None)

    def entry(self, table: str, column: str) -> Entry | None:
        """Classification, ``EXCLUDED``, or None when nothing is recorded."""
        return self.entries.get(self._key(table, column))

    def style(self, table: str | None, column: str) -> str:
        """Style override of the owning table, else the default style."""
        if table is None:
            return self.default_style
        return self.styles.get(self._key(table, column), self.default_style)

    def with_rule(
        self, table: str, column: str, masking_style: str = "partial", pii_type: str | None = None
    ) -> Policy:
        """Override the type (if given) and the style of one column."""
        key = self._key(table, column)
        entries, styles = dict(self.entries), dict(self.styles)
        if pii_type:
            entries[key] = _manual(pii_type)
        if masking_style:
            styles[key] = masking_style
        return replace(self, entries=entries, styles=styles, rules=())._with_rules(self.rules)

    def _with_rules(self, rules: tuple[Rule, ...]) -> Policy:
        """Keep the rule list for lookups without applying it over later overrides."""
        object.__setattr__(self, "rules", rules)
        return self

    def with_classifications(
        self, found: Mapping[tuple[str, str], Classification]
    ) -> Policy:
        """Record classifications; entries already present win."""
        entries = {self._key(t, c): info for (t, c), info in found.items()}
        entries.update(self.entries)
        return replace(self, entries=entries, rules=())._with_rules(self.rules)

    def resolve(
        self, output_name: str, owners: Iterable[tuple[str, str]] = ()
    ) -> tuple[Classification | None, tuple[str, str] | None]:
        """Classification of an output column and the base column it came from.

        The owning base columns are asked first, in order. If none has an entry, the
        base names and then the output name are judged.
        """
        owners = tuple(owners)
        for owner in owners:
            entry = self.entry(*owner)
            if entry == EXCLUDED:
                return None, owner
            if isinstance(entry, Classification):
                return entry, owner
        styled = [o for o in owners if self._key(*o) in self.styles]
        owner = next(iter(styled or owners), None)
        for _, base_name in owners:
            info = name_classification(base_name)
            if info is not None:
                return info, owner
        return name_classification(output_name), owner

    @classmethod
    def from_settings(cls, settings: Mapping[str, Any]) -> Policy:
        """A policy from a parsed settings mapping; unknown keys are an error.

        A connection string is passed over: sources are read apart from the policy.
        """
        known = {k: v for k, v in settings.items() if k != "connection_string"}
        if "default_masking_style" in known:
            known["default_style"] = known.pop("default_masking_style")
        rules = tuple(
            r if isinstance(r, Rule) else Rule(**r) for r in known.pop("column_rules", ())
        )
        for name in ("allowed_schemas", "allowed_functions"):
            if name in known:
                known[name] = tuple(known[name])
        return cls(rules=rules, **known)


def _manual(pii_type: str) -> Entry:
    if pii_type == V.NOT_PERSONAL:
        return EXCLUDED
    return Classification(
        pii_type,
        V.MANUAL_CONFIDENCE,
        "manual",
        is_free_text=pii_type == V.FREE_TEXT,
        is_json=pii_type == V.JSON_CONTAINER,
    )
