"""The order in which tables are generated, and the foreign keys that wait."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from relgen.sources.model import ForeignKey, Model


class PlanError(ValueError):
    """No order exists."""


@dataclass
class Plan:
    order: list[str] = field(default_factory=list)
    deferred: list[tuple[str, ForeignKey]] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)


def topological_sort(tables: list[str], edges: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(ordered, unresolved): parents first; those without parents sorted, others as their last parent comes."""
    waiting = dict.fromkeys(tables, 0)
    children: dict[str, list[str]] = {t: [] for t in tables}
    for child, parent in edges:
        if child in waiting and parent in waiting:
            waiting[child] += 1
            children[parent].append(child)
    queue, order = deque(sorted(t for t in tables if not waiting[t])), []
    while queue:
        t = queue.popleft()
        order.append(t)
        for c in children[t]:
            if c != t:
                waiting[c] -= 1
                if not waiting[c]:
                    queue.append(c)
    return order, sorted(set(tables) - set(order))


def strong_components(tables: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components, those that others reach first (iterative, for chains of any length)."""
    ahead: dict[str, list[str]] = {t: [] for t in tables}
    back: dict[str, list[str]] = {t: [] for t in tables}
    for a, b in edges:
        if a in ahead and b in ahead:
            ahead[a].append(b)
            back[b].append(a)
    seen: set[str] = set()
    finished: list[str] = []
    for t in tables:
        stack = [(t, iter(back[t]))] if t not in seen else []
        seen.add(t)
        while stack:
            node, rest = stack[-1]
            if (n := next((x for x in rest if x not in seen), None)) is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(n)
                stack.append((n, iter(back[n])))
    out: list[list[str]] = []
    seen.clear()
    for t in reversed(finished):
        if t in seen:
            continue
        group, todo = [], [t]
        seen.add(t)
        while todo:
            x = todo.pop()
            group.append(x)
            for n in ahead[x]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out.append(group)
    return out


def build_plan(model: Model, rows: int) -> Plan:
    tables = [t.name for t in model.tables]
    links = [(t.name, fk) for t in model.tables for fk in t.foreign_keys]
    edges = [(t, fk.ref_table) for t, fk in links]
    order, rest = topological_sort(tables, edges)
    plan = Plan(order, rows=dict.fromkeys(tables, rows))
    cyclic: list[str] = []
    for group in strong_components(rest, edges):
        if len(group) == 1 and (group[0], group[0]) not in edges:
            continue
        inside = set(group)
        found = None
        for name, fk in links:
            columns = [model.table(name).column(c) for c in fk.columns]
            if name in inside and fk.ref_table in inside and all(c.nullable for c in columns):
                found = (name, fk)
                break
        if found is None:
            raise PlanError(f"tables {', '.join(sorted(group))} form a cycle of foreign keys that can't be null; make one of their columns nullable")
        first, last = found[0], found[1].ref_table
        cyclic += [first, *(x for x in group if x not in (first, last)), *([last] if last != first else [])]
        plan.deferred.append(found)
    # with one edge of each cycle broken the rest is acyclic, or holds another cycle
    known = set(order)
    open_edges = [(a, b) for a, fk in links for b in [fk.ref_table] if b not in known and not any(d[1] is fk for d in plan.deferred) and a != b]
    blocked = [t for t in rest if t not in cyclic]
    done, left = topological_sort(blocked, [(a, b) for a, b in open_edges if b not in cyclic])
    if left:
        raise PlanError(f"no order for {', '.join(left)}")
    plan.order = order + cyclic + done
    return plan
