"""A small reader of SMILES: enough for element counts, charge, rings and silicon rings.

No aromaticity model, no canonical form, no fingerprints: those belong to a chemistry backend,
whose results come in as columns.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ATOM = re.compile(r"\[(\d*)([A-Z][a-z]?|[a-z]{1,2}|\*)(@{0,2})(H\d*)?([+-]+\d*|)(?::\d+)?\]|(Br|Cl|[BCNOPSFI]|[bcnops])|(%\d\d|\d)|([-=#$:/\\~])|([().])")


def parse(smiles: str | None) -> tuple[list[str], list[tuple[int, int]], int] | None:
    """(elements, bonds, charge), or None where the text is no SMILES this reader knows."""
    if not smiles or not smiles.strip():
        return None
    text, atoms, bonds, charge, at = smiles.strip(), [], [], 0, 0
    last: int | None = None
    stack: list[int | None] = []
    open_: dict[str, int] = {}
    while at < len(text):
        m = _ATOM.match(text, at)
        if m is None:
            return None
        at = m.end()
        if m[2] or m[6]:
            atoms.append((m[2] or m[6]).capitalize())
            if m[5]:
                sign = 1 if m[5][0] == "+" else -1
                digits = m[5].lstrip("+-")
                charge += sign * (int(digits) if digits else len(m[5]))
            if last is not None:
                bonds.append((last, len(atoms) - 1))
            last = len(atoms) - 1
        elif m[7]:
            if last is None:
                return None
            k = m[7].lstrip("%")
            if k in open_:
                bonds.append((open_.pop(k), last))
            else:
                open_[k] = last
        elif m[9] == "(":
            stack.append(last)
        elif m[9] == ")":
            if not stack:
                return None
            last = stack.pop()
        elif m[9] == ".":
            last = None
    return None if open_ or stack or not atoms else (atoms, bonds, charge)


def smallest_rings(n: int, bonds: list[tuple[int, int]]) -> list[list[int]]:
    """The shortest ring through each bond that lies in one, each ring once."""
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in bonds:
        near[a].add(b)
        near[b].add(a)
    rings = {}
    for a, b in bonds:
        before, todo = {a: a}, deque([a])
        while todo and b not in before:
            x = todo.popleft()
            for y in sorted(near[x]):
                if y not in before and {x, y} != {a, b}:
                    before[y] = x
                    todo.append(y)
        if b in before:
            ring, x = [b], b
            while x != a:
                x = before[x]
                ring.append(x)
            rings[frozenset(ring)] = ring
    return list(rings.values())


def summary(smiles: str | None) -> dict | None:
    read = parse(smiles)
    if read is None:
        return None
    atoms, bonds, charge = read
    count = Counter(atoms)
    seen, parts = set(), 0
    near: dict[int, list[int]] = {i: [] for i in range(len(atoms))}
    for a, b in bonds:
        near[a].append(b)
        near[b].append(a)
    for i in near:
        if i not in seen:
            parts += 1
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    rings = smallest_rings(len(atoms), bonds)
    return {
        "elements": dict(count), "heavy_atoms": sum(v for k, v in count.items() if k != "H"), "formal_charge": charge, "ring_count": len(bonds) - len(atoms) + parts,
        "si_atoms": count.get("Si", 0), "si_ring_units": max((sum(atoms[i] == "Si" for i in r) for r in rings), default=0),
    }


_COUNTS = ("heavy_atoms", "formal_charge", "ring_count", "si_atoms", "si_ring_units")


def smiles_summary(smiles: Column) -> Column:
    """struct(elements, heavy_atoms, formal_charge, ring_count, si_atoms, si_ring_units); its fields are
    null for what is no SMILES. Arrow batches, a row of Python work each."""

    @F.pandas_udf("elements map<string,int>, " + ", ".join(f"{n} int" for n in _COUNTS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["elements", *_COUNTS]
        for texts in batches:
            yield pd.DataFrame([[None] * 6 if (s := summary(t)) is None else [s[n] for n in names] for t in texts], columns=names).astype({n: "Int32" for n in _COUNTS})

    return run(smiles)
