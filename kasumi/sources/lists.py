"""The dictionary's and the allowlist's YAML files."""

from __future__ import annotations

from pathlib import Path

import yaml

from kasumi import values as V
from kasumi.functions.text import normal
from kasumi.operators.allowlist import Allowlist
from kasumi.operators.dictionary import Dictionary, Term


def _blank_nan(text: str) -> str:
    return "" if text.strip().lower() == "nan" else text


def load_dictionary(path: str) -> Dictionary:
    """Sections by category; an item is a name or a map of canonical (or name), aliases, mask and embed."""
    terms = []
    for section, items in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items():
        category = V.SECTION_ALIAS.get(section, section)
        for item in items or []:
            held = {"canonical": item} if isinstance(item, str) else item
            terms.append(Term(str(held.get("canonical") or held.get("name") or ""), category, tuple(held.get("aliases") or ()), _blank_nan(str(held.get("mask") or "")), bool(held.get("embed"))))
    return Dictionary(terms)


def save_dictionary(path: str, dictionary: Dictionary) -> None:
    """Terms without a name go; the known sections first, each sorted by name; a bare term is written as its name."""
    sections: dict[str, list[tuple[str, str | dict]]] = {}
    for term in dictionary.terms:
        name = term.canonical.strip()
        if not name:
            continue
        more: dict = {}
        if aliases := [a.strip() for a in term.aliases if a.strip()]:
            more["aliases"] = aliases
        if term.mask.strip():
            more["mask"] = term.mask.strip()
        if term.embed:
            more["embed"] = True
        sections.setdefault(term.category or V.COMPANY, []).append((name, {"canonical": name, **more} if more else name))
    order = [s for s in V.SECTIONS if s in sections] + [s for s in sections if s not in V.SECTIONS]
    held = {s: [item for _, item in sorted(sections[s], key=lambda x: normal(x[0]))] for s in order}
    Path(path).write_text(yaml.safe_dump(held, allow_unicode=True, sort_keys=False, indent=2), encoding="utf-8")


def load_allow_entries(path: str) -> list[tuple[str, bool]]:
    """(surface, embed) of the file's section; blank ones and repetitions go."""
    found: dict[str, bool] = {}
    if Path(path).exists():
        for item in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get(V.ALLOW_SECTION) or []:
            surface, embed = (str(item.get("surface") or ""), bool(item.get("embed"))) if isinstance(item, dict) else (str(item), False)
            if _blank_nan(surface.strip()):
                found.setdefault(surface.strip(), embed)
    return list(found.items())


def load_allowlist(path: str) -> Allowlist:
    """An empty list if there is no file."""
    return Allowlist.of(load_allow_entries(path))


def save_allow_entries(path: str, entries: list[str | tuple[str, bool]]) -> None:
    """Sorted by key, each surface once, bare ones as text."""
    kept: dict[str, bool] = {}
    for entry in entries:
        surface, embed = (entry, False) if isinstance(entry, str) else entry
        if surface.strip():
            kept.setdefault(surface.strip(), embed)
    items = [{"surface": s, "embed": True} if embed else s for s, embed in sorted(kept.items(), key=lambda x: normal(x[0]))]
    Path(path).write_text(yaml.safe_dump({V.ALLOW_SECTION: items}, allow_unicode=True, sort_keys=False, indent=2), encoding="utf-8")
