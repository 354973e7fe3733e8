"""The step tree as read from JSON: completed, addressed, switched off.

Its record format is fixed: a node is ``{id, type: "operation", operationType, name, enabled, commands,
children}``, a command ``{id, type, config, order}``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

#: Entries that only a step has.
STEP_ENTRIES = {"children", "commands", "operationType"}
NODE_KINDS = ("setup", "dataset", "process", "root")


@dataclass(frozen=True)
class Command:
    id: str
    type: str
    config: Mapping[str, Any]
    order: float = 0


@dataclass(frozen=True)
class Node:
    id: str
    name: str
    kind: str = "process"
    enabled: bool = True
    commands: tuple[Command, ...] = ()
    children: tuple[Node, ...] = ()

    def ordered(self) -> list[Command]:
        return sorted(self.commands, key=lambda c: c.order)

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    def path(self, node_id: str) -> list[Node]:
        """Nodes from here down to ``node_id``."""
        if self.id == node_id:
            return [self]
        for child in self.children:
            below = child.path(node_id)
            if below:
                return [self, *below]
        return []


def read_tree(source: str | Mapping[str, Any] | list) -> Node:
    """A tree from JSON text or parsed JSON: a root node, an export with a ``tree`` or ``operations``
    entry, a bare list of nodes, or a single node, which is put below a root. What isn't a step is refused: nothing is left out."""
    payload = json.loads(source) if isinstance(source, str) else source
    if isinstance(payload, Mapping) and "tree" in payload:
        payload = payload["tree"]
    if isinstance(payload, Mapping) and isinstance(payload.get("operations"), list) and not STEP_ENTRIES & set(payload):
        payload = payload["operations"]
    if isinstance(payload, list):
        return _root(payload)
    if not isinstance(payload, Mapping) or not {"id", "name", *STEP_ENTRIES} & set(payload):
        raise ValueError("no step tree found")
    node = _node(payload)
    return node if node.kind == "root" else Node("root", "Project", "root", children=(node,))


def read_tree_file(path: str) -> Node:
    with open(path, encoding="utf-8") as f:
        return read_tree(f.read())


def _root(items: list) -> Node:
    return Node("root", "Project", "root", children=tuple(map(_node, items)))


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


def _listed(raw: Mapping[str, Any], entry: str) -> list:
    """The list under ``entry``; nothing there is an empty one."""
    value = raw.get(entry)
    if value is not None and not isinstance(value, list):
        raise ValueError(f"step '{raw['id']}': '{entry}' is no list")
    return value or []


def _node(raw: Any) -> Node:
    shown = json.dumps(raw, default=str)[:200]
    if not isinstance(raw, Mapping):
        raise ValueError(f"not a step: {shown}")
    if raw.get("type", "operation") != "operation":
        raise ValueError(f"a step of unknown type '{raw['type']}': {shown}")
    missing = [k for k in ("id", "name") if not _text(raw.get(k))]
    if missing:
        raise ValueError(f"a step without {' and '.join(missing)}: {shown}")
    return Node(
        id=raw["id"],
        name=raw["name"],
        kind=raw.get("operationType") if raw.get("operationType") in NODE_KINDS else "process",
        enabled=raw.get("enabled") is not False,
        commands=tuple(_command(c, i, raw["id"]) for i, c in enumerate(_listed(raw, "commands"))),
        children=tuple(map(_node, _listed(raw, "children"))),
    )


def _command(raw: Any, index: int, node_id: str) -> Command:
    if not isinstance(raw, Mapping):
        raise ValueError(f"step '{node_id}': not a command: {json.dumps(raw, default=str)[:200]}")
    config = raw.get("config")
    try:
        order = float(raw["order"])
    except (KeyError, TypeError, ValueError):
        order = index + 1
    return Command(
        id=_text(raw.get("id")) or f"{node_id}_command_{index}",
        type=_text(raw.get("type")) or "filter",
        config=config if isinstance(config, Mapping) else {},
        order=order,
    )


def set_enabled(tree: Node, node_id: str, enabled: bool, cascade: bool = False) -> Node:
    """Switch a node on or off. With ``cascade`` everything below a disabled node is disabled too."""

    def visit(node: Node, off: bool) -> Node:
        if node.id == node_id:
            node = replace(node, enabled=enabled)
        elif off and cascade:
            node = replace(node, enabled=False)
        return replace(node, children=tuple(visit(c, not node.enabled) for c in node.children))

    return visit(tree, False)


@dataclass(frozen=True)
class Sources:
    """What the tree's source commands call each table: its name, command id, link id, alias."""

    tables: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def of(tree: Node) -> Sources:
        names: dict[str, str] = {}
        for node in tree.walk():
            for c in node.commands:
                table = c.config.get("mainTable")
                if c.type == "source" and table:
                    for name in (table, c.id, c.config.get("linkId"), (c.config.get("alias") or "").strip()):
                        if name:
                            names[name] = table
        return Sources(names)

    def resolve(self, name: str) -> str:
        return self.tables.get(name, name)

    def names_of(self, table: str) -> list[str]:
        return [table, *(n for n, t in self.tables.items() if t == table)]
