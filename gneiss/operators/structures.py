"""Patterns, features, ring systems and fingerprints of structures, from the columns of ``functions.molecule``.

A pattern is data: atoms with what they must be, each bound to an earlier one. ``matches`` compiles it into built-in array
functions: candidates for the first atom, then for each further one the neighbours that fit and aren't taken yet. A match is a set
of atoms; those that cover the same ones count once. There is no Python on the rows here and no exchange but the one
by which each distinct structure is read once (``read_structures``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.molecule import AROMATIC, molecule

# ---- patterns ----


def a(*symbols, at=None, bond=(1, AROMATIC), lacks=(), needs=(), **limits) -> dict:
    """An atom of a pattern: one of the symbols (any without), bound to the ``at``-th atom of the pattern by one of the orders of
    ``bond``; ``limits`` on aromatic, charge, h, degree, x (neighbours and hydrogens), ring (size of its smallest ring);
    patterns that must not (``lacks``) or must (``needs``) begin at it."""
    return {"symbols": symbols, "at": at, "bond": (bond,) if isinstance(bond, int) else bond, "lacks": lacks, "needs": needs, "limits": limits}


def _among(value: Column, allowed) -> Column:
    return value.isin(*allowed) if isinstance(allowed, tuple) else value == allowed


def _fits(atoms: Column, i: Column, spec: dict) -> Column:
    atom = F.get(atoms, i)
    found = F.lit(True)
    if spec["symbols"]:
        found = atom["symbol"].isin(*spec["symbols"])
    for name, allowed in spec["limits"].items():
        found &= _among(atom["degree"] + atom["h"] if name == "x" else atom[name], allowed)
    for pattern in spec["lacks"]:
        found &= F.size(_grown(atoms, F.array(F.array(i)), pattern)) == 0
    for pattern in spec["needs"]:
        found &= F.size(_grown(atoms, F.array(F.array(i)), pattern)) > 0
    return found


def _grown(atoms: Column, begun: Column, pattern) -> Column:
    """Matches that begin with those of the first atom; of that one only its own limits are left out."""

    def by(spec: dict):
        def further(m):
            near = F.get(atoms, F.get(m, F.lit(spec["at"])))["near"]
            fit = F.filter(near, lambda n: n["order"].isin(*spec["bond"]) & ~F.array_contains(m, n["to"]) & _fits(atoms, n["to"], spec))
            return F.transform(fit, lambda n: F.concat(m, F.array(n["to"])))

        return further

    out = begun
    for spec in pattern[1:]:
        out = F.flatten(F.transform(out, by(spec)))
    return out


def matches(atoms: Column, pattern) -> Column:
    """array<array<int>>: the atoms of each match, in the pattern's order; of matches with the same atoms, the first."""
    every = F.when(F.size(atoms) > 0, F.sequence(F.lit(0), F.size(atoms) - 1)).otherwise(F.array().cast("array<int>"))
    first = F.transform(F.filter(every, lambda i: _fits(atoms, i, pattern[0])), lambda i: F.array(i))
    found = _grown(atoms, first, pattern)
    if len(pattern) == 1:
        return found
    keyed = F.transform(found, lambda m: F.struct(F.array_sort(m).alias("atoms"), m.alias("m")))
    kept = F.aggregate(keyed, F.slice(keyed, 1, 0), lambda acc, k: F.when(F.exists(acc, lambda x: x["atoms"] == k["atoms"]), acc).otherwise(F.concat(acc, F.array(k))))
    return F.transform(kept, lambda k: k["m"])


C, N, O, S, P, SI = ("C",), ("N",), ("O",), ("S",), ("P",), ("Si",)  # noqa: E741
_CARBONYL = (a(), a(*O, at=0, bond=2, aromatic=False))
_ACYL = (a(), a(*C, at=0, aromatic=False), a(*O, at=1, bond=2, aromatic=False))
_NITRO = (a(), a(*O, at=0, bond=2), a(*O, at=0, charge=-1))
_HALOGENS = ("F", "Cl", "Br", "I")

# What each motif is, the atom that names it first.
MOTIFS = {
    "Aldehyde": (a(*C, x=3, h=1, aromatic=False), a(*O, at=0, bond=2), a(*C, at=0)),
    "Ketone": (a(*C, x=3, aromatic=False), a(*O, at=0, bond=2), a(*C, at=0), a(*C, at=0)),
    "Ester": (a(*C, x=3, aromatic=False), a(*O, at=0, bond=2), a(*C, at=0), a(*O, at=0, x=2, h=0, aromatic=False), a(*C, at=3)),
    "Carboxylic acid": (a(*C, x=3, aromatic=False), a(*O, at=0, bond=2), a(*O, at=0, h=1, x=2)),
    "Carboxylate": (a(*C, x=3, aromatic=False), a(*O, at=0, bond=2), a(*O, at=0, x=1, charge=-1)),
    "Amide": (a(*N, x=3, aromatic=False), a(*C, at=0, x=3, aromatic=False), a(*O, at=1, bond=2, x=1), a(*C, at=1)),
    "Nitrile": (a(*C, x=2, aromatic=False), a(*N, at=0, bond=3, x=1)),
    "Ether": (a(*O, degree=2, aromatic=False), a(*C, at=0), a(*C, at=0)),
    "Alcohol": (a(*O, x=2, h=1, aromatic=False), a(*C, at=0, aromatic=False, lacks=(_CARBONYL,))),
    "Phenol": (a(*O, x=2, h=1, aromatic=False), a(*C, at=0, aromatic=True)),
    "Amine": (a(*N, x=3, aromatic=False, h=(0, 1, 2), lacks=(_ACYL, _NITRO)),),
    "Siloxane": (a(*SI), a(*O, at=0, x=2), a(*SI, at=1)),
    "Silanol": (a(*SI), a(*O, at=0, x=2, h=1)),
    "Silyl alkyl peroxide": (a(*SI), a(*O, at=0, x=2), a(*O, at=1, x=2), a(*C, at=2)),
    "Phosphate ester": (a(*P, x=4), a(*O, at=0, bond=2), a(*O, at=0, x=2), a(*O, at=0, x=2), a(*O, at=0, x=2)),
    "Trialkylphosphine oxide": (a(*P, x=4), a(*O, at=0, bond=2, x=1), a(*C, at=0), a(*C, at=0), a(*C, at=0)),
    "Organic hydroperoxide": (a(*O, x=2, h=1), a(*O, at=0, x=2), a(*C, at=1)),
    "Dialkyl peroxide": (a(*O, x=2), a(*O, at=0, x=2), a(*C, at=0), a(*C, at=1)),
    "Sulfonamide": (a(*S, x=4, aromatic=False), a(*O, at=0, bond=2), a(*O, at=0, bond=2), a(*N, at=0, x=3)),
    "Sulfonic acid": (a(*S, x=4, aromatic=False), a(*O, at=0, bond=2), a(*O, at=0, bond=2), a(*O, at=0, h=1, x=2)),
    "Sulfonate": (a(*S, x=4, aromatic=False), a(*O, at=0, bond=2), a(*O, at=0, bond=2), a(*O, at=0, x=1, charge=-1)),
    "Halogenated compound": (a(*_HALOGENS),),
}
#: Motifs that are another one in another state.
SAME = {"Carboxylate": "Carboxylic acid", "Sulfonate": "Sulfonic acid"}

# Functional groups by name.
GROUPS = {
    "Hydroxyl": (a(*O, x=2, h=1, aromatic=False),),
    "Phenol": MOTIFS["Phenol"],
    "Alcohol": MOTIFS["Alcohol"],
    "Ether": MOTIFS["Ether"],
    "Aldehyde": MOTIFS["Aldehyde"],
    "Ketone": MOTIFS["Ketone"],
    "Carboxylic Acid": MOTIFS["Carboxylic acid"],
    "Ester": MOTIFS["Ester"],
    "Amide": MOTIFS["Amide"],
    "Anhydride": (a(*O, x=2, aromatic=False), a(*C, at=0, x=3, aromatic=False, needs=(_CARBONYL,)), a(*C, at=0, x=3, aromatic=False, needs=(_CARBONYL,))),
    "Amine": (a(*N, x=3, aromatic=False, h=(0, 1, 2), lacks=(_ACYL,)),),
    "Nitro": (a(*N, needs=(_NITRO,)),),
    "Nitrile": MOTIFS["Nitrile"],
    "Sulfoxide": (a(*S, x=3), a(*O, at=0, bond=2, x=1), a(*C, at=0), a(*C, at=0)),
    "Sulfone": (a(*S, x=4), a(*O, at=0, bond=2, x=1), a(*O, at=0, bond=2, x=1), a(*C, at=0), a(*C, at=0)),
    "Phosphate": MOTIFS["Phosphate ester"],
    "Siloxane": MOTIFS["Siloxane"],
    "Halogen": MOTIFS["Halogenated compound"],
    "Aromatic Ring": (a(aromatic=True),),
    "Aliphatic Chain": (a(*C, x=(2, 3, 4), aromatic=False, lacks=(_CARBONYL, (a(), a(*N, at=0, bond=(2, 3))), (a(), a(*S, at=0, bond=2)))),),
}

# Toxicophores by name.
TOXICOPHORES = {
    "Aldehyde": MOTIFS["Aldehyde"],
    "Alkyl halide": (a(*C, x=4, aromatic=False), a("Cl", "Br", "I", at=0)),
    "Aromatic amine": (a(*N, x=3, aromatic=False, h=(0, 1, 2)), a(at=0, aromatic=True)),
    "Azide": (a(*N, degree=2, charge=1), a(*N, at=0, bond=2), a(*N, at=0, bond=(1, 2), charge=-1)),
    "Epoxide": (a(*O, x=2, ring=3), a(*C, at=0, x=4, ring=3), a(*C, at=0, x=4, ring=3)),
    "Hydrazine": (a(*N, x=(2, 3), aromatic=False), a(*N, at=0, x=(2, 3), aromatic=False)),
    "Michael acceptor": (a(*C, x=3, aromatic=False), a(*C, at=0, bond=2, x=3, aromatic=False), a(*C, at=1, x=3, aromatic=False), a(*O, at=2, bond=2), a("C", "O", "N", "S", at=2)),
    "Nitrosamine": (a(*N, x=3, aromatic=False), a(*N, at=0, x=2, aromatic=False), a(*O, at=1, bond=2)),
    "Peroxide": (a(*O, x=2, aromatic=False), a(*O, at=0, x=2, aromatic=False)),
    "Sulfonyl halide": (a(*S, x=4), a(*O, at=0, bond=2), a(*O, at=0, bond=2), a("Cl", "Br", at=0)),
}

_AMIDE_LIKE = (a(), a("C", "S", at=0), a(*O, at=1, bond=2))
# What gives or takes a charge.
ACIDIC = (MOTIFS["Carboxylic acid"], MOTIFS["Carboxylate"], MOTIFS["Sulfonic acid"], MOTIFS["Sulfonate"], (a(*P, x=4), a(*O, at=0, bond=2), a(*O, at=0, h=1, x=2), a(*O, at=0, h=1, x=2)))
BASIC = ((a(*N, x=3, aromatic=False, lacks=(_AMIDE_LIKE, (a(), a(at=0, bond=2)))),), (a(*N, aromatic=True, h=0, charge=0),), (a(*N, x=2, aromatic=False), a(*C, at=0, bond=2, x=2)))
PERMANENT = (
    (a(*N, charge=1, lacks=((a(), a(*O, at=0, charge=-1)),)), a(at=0), a(at=0), a(at=0), a(at=0)),
    (a(*P, charge=1), a(at=0), a(at=0), a(at=0), a(at=0)),
    (a(*S, charge=1), a(at=0), a(at=0), a(at=0)),
)


def has(atoms: Column, pattern) -> Column:
    return F.size(matches(atoms, pattern)) > 0


def named(atoms: Column, patterns: dict) -> Column:
    """The names of the patterns that occur, in their order."""
    return F.array_compact(F.array(*[F.when(has(atoms, p), F.lit(name)) for name, p in patterns.items()]))


def groups(atoms: Column, patterns: dict = GROUPS) -> Column:
    """array<struct<name, atoms>>: the patterns that occur, with the atoms of all of their matches."""
    each = [F.struct(F.lit(name).alias("name"), F.array_sort(F.array_distinct(F.flatten(matches(atoms, p)))).alias("atoms")) for name, p in patterns.items()]
    return F.filter(F.array(*each), lambda g: F.size(g["atoms"]) > 0)


def ionisation(atoms: Column) -> tuple[Column, Column, Column]:
    """Whether a structure is charged for good, acidic, basic: the parts of ``chemistry.ionisation_label``."""

    def some(patterns) -> Column:
        out = F.lit(False)
        for p in patterns:
            out |= has(atoms, p)
        return out

    return some(PERMANENT), some(ACIDIC), some(BASIC)


# ---- ring systems ----


def topology(atoms: Column, rings: Column, alcohols: Column) -> Column:
    """struct of the ring system: its class and modifiers, ring counts and sizes, pairs of rings by how many atoms they share, and
    what the alcohols (``alcohols``, matches of that motif) stand on."""
    n = F.size(rings)
    aromatic = F.size(F.filter(rings, lambda r: F.forall(r, lambda i: F.get(atoms, i)["aromatic"])))
    sizes = F.transform(rings, lambda r: F.size(r))
    inside = F.array_distinct(F.flatten(rings))
    hetero = F.size(F.filter(inside, lambda i: ~F.get(atoms, i)["symbol"].isin("C", "H")))
    pairs = F.flatten(F.transform(rings, lambda r, k: F.transform(F.slice(rings, k + 2, 1 << 20), lambda q: F.size(F.array_intersect(r, q)))))
    shared = F.filter(pairs, lambda s: s > 0)
    top = F.coalesce(F.array_max(sizes), F.lit(0))
    parts = F.struct(n.alias("n"), aromatic.alias("aromatic"), hetero.alias("hetero"), shared.alias("shared"), F.size(F.filter(shared, lambda s: s > 1)).alias("fused"), F.size(F.filter(shared, lambda s: s == 1)).alias("spiro"), top.alias("top"), sizes.alias("sizes"))

    def told(x: Column) -> Column:
        kind = (
            F.when(x["n"] == 0, F.lit("Acyclic")).when(x["top"] >= 12, F.lit("Macrocyclic")).when(x["n"] == 1, F.lit("Monocyclic")).when(x["fused"] > 0, F.lit("Fused Polycyclic"))
            .when(x["spiro"] > 0, F.lit("Spirocyclic")).when(x["n"] == 2, F.lit("Bicyclic")).otherwise(F.lit("Polycyclic"))
        )
        marks = F.array_compact(F.array(
            F.when(x["aromatic"] > 0, F.lit("Aromatic")), F.when(x["hetero"] > 0, F.lit("Heterocyclic")), F.when(x["fused"] > 0, F.lit("Fused")),
            F.when(x["spiro"] > 0, F.lit("Spiro")), F.when(x["top"] >= 12, F.lit("Macrocyclic")),
        ))
        return F.struct(
            kind.alias("topology_class"), F.when(F.size(marks) > 0, F.array_join(marks, "; ")).otherwise(F.lit("None")).alias("topology_modifiers"),
            F.when(x["n"] == 0, F.lit("Open-chain")).otherwise(kind).alias("ring_system"), F.format_string("%d ring(s), %d aromatic ring(s)", x["n"], x["aromatic"]).alias("ring_profile"),
            x["n"].alias("ring_count"), x["aromatic"].alias("aromatic_ring_count"), x["sizes"].alias("ring_sizes"), x["hetero"].alias("hetero_ring_atoms"), x["shared"].alias("shared_atoms"),
            x["fused"].alias("fused_pairs"), x["spiro"].alias("spiro_pairs"),
        )

    ring_part = F.get(F.transform(F.array(parts), told), F.lit(0))
    carbons = F.transform(alcohols, lambda m: F.get(m, F.lit(1)))
    bound = lambda i: F.filter(F.get(atoms, i)["near"], lambda b: F.get(atoms, b["to"])["symbol"] == "C")
    most = F.array_max(F.transform(carbons, lambda i: F.size(bound(i))))
    substitution = F.when(F.size(carbons) == 0, F.lit("Not applicable")).when(most >= 3, F.lit("Tertiary Alcohol")).when(most == 2, F.lit("Secondary Alcohol")).otherwise(F.lit("Primary Alcohol"))
    stands = F.transform(carbons, lambda i: F.when(F.get(atoms, i)["ring"] > 0, F.lit("Cyclic Alcohol")).when(F.exists(bound(i), lambda b: F.get(atoms, b["to"])["ring"] > 0), F.lit("Ring-substituted Alcohol")).otherwise(F.lit("Acyclic Alcohol")))
    context = F.coalesce(F.get(F.filter(F.array(*[F.lit(x) for x in ("Cyclic Alcohol", "Ring-substituted Alcohol", "Acyclic Alcohol")]), lambda c: F.array_contains(stands, c)), F.lit(0)), F.lit("Not applicable"))
    return F.struct(ring_part.alias("rings"), substitution.alias("alcohol_substitution"), context.alias("alcohol_context"), F.array_sort(F.array_distinct(stands)).alias("alcohol_contexts"))


# ---- features ----

#: Rings and bridges from which a structure is called macrocyclic, or a polyether (``policies.classification``).
THRESHOLDS = {"polyether_min_ether_bridges": 3, "macrocyclic_min_ring_size": 12, "macrocyclic_min_ether_bridges": 4}
#: What a structure without any motif is called by the first element that it has.
REST = {"P": "Organophosphorus compound — not further classified", "S": "Sulfur-containing compound — not further classified", "Si": "Silicon-containing compound — not further classified", "N": "Nitrogen-containing compound — not further classified", "O": "Oxygen-containing compound — not further classified"}


def motif_columns(atoms: Column) -> Column:
    """struct of the matches of all motifs, by place in ``MOTIFS``."""
    return F.struct(*[matches(atoms, p).alias(f"m{k}") for k, p in enumerate(MOTIFS.values())])


def features(atoms: Column, rings: Column, motifs: Column, thresholds: dict = THRESHOLDS) -> tuple[Column, Column]:
    """(array of feature names in order, map from name to atoms) from the motifs' matches."""
    macrocycle = thresholds["macrocyclic_min_ring_size"]
    of = {name: motifs[f"m{k}"] for k, name in enumerate(MOTIFS)}
    for state, name in SAME.items():
        of[name] = F.concat(of[name], of.pop(state))
    amides = of["Amide"]
    none = F.array().cast("array<int>")
    in_ring = lambda i: F.get(atoms, i)["ring"] > 0
    some = lambda name: F.size(of[name]) > 0
    spread = lambda name: F.array_sort(F.array_distinct(F.flatten(of[name])))
    at = lambda name, k: F.exists(of[name], lambda m: in_ring(F.get(m, F.lit(k))))
    near = lambda i: F.get(atoms, i)["near"]
    atom = lambda i: F.get(atoms, i)
    every = F.when(F.size(atoms) > 0, F.sequence(F.lit(0), F.size(atoms) - 1)).otherwise(none)
    of_ring = lambda r, symbol: F.size(F.filter(r, lambda i: atom(i)["symbol"] == symbol))

    alcohol_c = F.transform(of["Alcohol"], lambda m: F.get(m, F.lit(1)))
    si_rings = F.filter(rings, lambda r: (of_ring(r, "Si") > 0) & (of_ring(r, "O") > 0))
    ring_atoms = lambda rs: F.array_sort(F.array_distinct(F.flatten(rs)))
    bound = lambda r, i: F.exists(near(i), lambda b: (atom(b["to"])["symbol"] == "O") & F.array_contains(r, b["to"]))
    oxasilinanes = F.filter(rings, lambda r: (F.size(r) == 6) & (of_ring(r, "Si") == 1) & (of_ring(r, "O") == 1) & (of_ring(r, "C") == 4) & F.exists(r, lambda i: (atom(i)["symbol"] == "Si") & bound(r, i)))
    acyl = lambda i: (atom(i)["symbol"] == "C") & F.exists(near(i), lambda b: (b["order"] == 2) & (atom(b["to"])["symbol"] == "O"))
    imide = F.exists(every, lambda i: (atom(i)["symbol"] == "N") & (F.size(F.filter(near(i), lambda b: acyl(b["to"]))) >= 2))
    oxygens = lambda i: F.filter(near(i), lambda b: (b["order"] == 1) & (atom(b["to"])["symbol"] == "O"))
    di_ethers = F.filter(every, lambda i: (atom(i)["symbol"] == "C") & (atom(i)["charge"] == 0) & (F.size(oxygens(i)) >= 2) & ~F.exists(oxygens(i), lambda b: atom(b["to"])["h"] > 0))
    acetals, ketals = F.filter(di_ethers, lambda i: atom(i)["h"] > 0), F.filter(di_ethers, lambda i: atom(i)["h"] == 0)
    cyclic = lambda xs: F.exists(xs, lambda i: in_ring(i) | F.exists(oxygens(i), lambda b: in_ring(b["to"])))
    saturated = lambda i: (atom(i)["symbol"] == "C") & ~atom(i)["aromatic"] & ~F.exists(near(i), lambda b: b["order"] > 1)
    alkoxy = lambda m: F.size(F.filter(near(F.get(m, F.lit(0))), lambda b: (atom(b["to"])["symbol"] == "O") & F.exists(near(b["to"]), lambda c: saturated(c["to"]))))
    largest = F.coalesce(F.array_max(F.transform(rings, lambda r: F.size(r))), F.lit(0))

    # (name, whether it is there, its atoms), in order. Those without atoms of their own refine another.
    rows = [(name, some(name), spread(name)) for name in ("Aldehyde", "Ketone", "Ester", "Carboxylic acid", "Amide", "Nitrile", "Ether", "Alcohol", "Phenol", "Amine", "Siloxane", "Silanol", "Silyl alkyl peroxide")]
    rows += [("Cyclic alcohol", F.exists(alcohol_c, in_ring), None), ("Ring-substituted alcohol", F.exists(alcohol_c, lambda i: ~in_ring(i) & F.exists(near(i), lambda b: in_ring(b["to"]))), None)]
    rows += [(name, some(name), spread(name)) for name in ("Phosphate ester", "Trialkylphosphine oxide", "Organic hydroperoxide", "Dialkyl peroxide", "Sulfonamide", "Sulfonic acid", "Halogenated compound")]
    rows += [
        ("Cyclic ketone", at("Ketone", 0), None), ("Cyclic aldehyde", at("Aldehyde", 0), None), ("Cyclic ether", at("Ether", 1) | at("Ether", 2), None),
        ("Polyether", F.size(of["Ether"]) >= thresholds["polyether_min_ether_bridges"], None), ("Macrocyclic polyether", (F.size(of["Ether"]) >= max(thresholds["macrocyclic_min_ether_bridges"], thresholds["polyether_min_ether_bridges"])) & (largest >= macrocycle), None),
        ("Cyclic siloxane", some("Siloxane") & (F.size(si_rings) > 0), ring_atoms(si_rings)),
        ("Macrocyclic siloxane", some("Siloxane") & F.exists(si_rings, lambda r: F.size(r) >= macrocycle), ring_atoms(si_rings)),
        ("1,2-Oxasilinane", F.size(oxasilinanes) > 0, ring_atoms(oxasilinanes)),
        ("Lactone", at("Carboxylic acid", 0) | at("Ester", 0), None), ("Lactam", F.exists(amides, lambda m: in_ring(F.get(m, F.lit(1)))), None), ("Imide", imide, None),
        ("Acetal", F.size(acetals) > 0, acetals), ("Ketal", F.size(ketals) > 0, ketals), ("Cyclic acetal", cyclic(acetals), None), ("Cyclic ketal", cyclic(ketals), None),
        ("Trialkyl phosphate", F.exists(of["Phosphate ester"], lambda m: alkoxy(m) >= 3), spread("Phosphate ester")),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(there, F.lit(False)).alias("there"), (own if own is not None else none).alias("atoms"), F.lit(own is not None).alias("own")) for name, there, own in rows]), lambda x: x["there"])

    symbols = F.array_distinct(F.transform(F.filter(atoms, lambda x: x["symbol"] != "H"), lambda x: x["symbol"]))
    rest = F.when(symbols == F.array(F.lit("C")), F.lit("Hydrocarbon"))
    for symbol, name in REST.items():
        rest = rest.when(F.array_contains(symbols, symbol), F.lit(name))

    def named_features(xs: Column) -> Column:
        names = F.transform(xs, lambda x: x["name"])
        specific = F.exists(names, lambda x: x != "Halogenated compound")
        return F.when(specific | rest.isNull(), names).otherwise(F.concat(names, F.array(rest)))

    own = F.filter(found, lambda x: x["own"])
    places = F.map_from_arrays(F.transform(own, lambda x: x["name"]), F.transform(own, lambda x: x["atoms"]))
    return F.get(F.transform(F.array(found), named_features), F.lit(0)), places


# ---- fingerprints and counts ----


def circular(atoms: Column, radius: int = 2, width: int = 1024) -> Column:
    """Bits of the neighbourhoods of all atoms up to ``radius`` bonds away, folded to ``width``; they don't depend on the order
    of the atoms."""
    def value(x: Column) -> Column:
        return F.xxhash64(x["symbol"], x["aromatic"], x["charge"], x["h"], x["degree"], x["ring"] > 0)

    now = F.transform(atoms, value)
    every = now
    for _ in range(radius):
        before = now
        # The neighbours' values in order of bond and value, hashed one into the other.
        around = lambda x, v: F.aggregate(F.array_sort(F.transform(x["near"], lambda b: F.struct(b["order"].alias("o"), F.get(v, b["to"]).alias("v")))), F.lit(0).cast("long"), lambda acc, n: F.xxhash64(acc, n["o"], n["v"]))
        step = F.transform(F.array(F.struct(atoms.alias("atoms"), before.alias("v"))), lambda s: F.transform(s["atoms"], lambda x, i: F.xxhash64(F.get(s["v"], i), around(x, s["v"]))))
        now = F.get(step, F.lit(0))
        every = F.concat(every, now)
    return F.array_sort(F.array_distinct(F.transform(every, lambda v: F.pmod(v, F.lit(width)).cast("int"))))


# Standard atomic weights.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.99, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Br": 79.904, "I": 126.904}


def descriptors(atoms: Column) -> Column:
    """struct of counts: heavy atoms, hydrogen donors and acceptors, rotatable bonds, charge, share of saturated carbons, weight."""
    heavy = F.filter(atoms, lambda x: x["symbol"] != "H")
    hetero = F.filter(atoms, lambda x: x["symbol"].isin("N", "O"))
    carbons = F.filter(atoms, lambda x: x["symbol"] == "C")
    saturated = F.filter(carbons, lambda x: (x["degree"] + x["h"] == 4) & ~x["aromatic"])
    ends = lambda i: F.get(atoms, i)
    free = lambda x: (x["degree"] > 1) & ~F.exists(x["near"], lambda b: b["order"] == 3)
    turns = F.flatten(F.transform(atoms, lambda x, i: F.filter(x["near"], lambda b: (b["to"] > i) & (b["order"] == 1) & ~b["ring"] & free(x) & free(ends(b["to"])))))
    weight = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])
    known = F.aggregate(atoms, F.lit(0.0), lambda acc, x: acc + F.try_element_at(weight, x["symbol"]) + x["h"] * WEIGHTS["H"])
    count = lambda xs: F.size(xs).cast("int")
    return F.struct(
        count(heavy).alias("heavy_atoms"), count(F.filter(hetero, lambda x: x["h"] > 0)).alias("donors"), count(hetero).alias("acceptors"), count(turns).alias("rotatable_bonds"),
        F.aggregate(atoms, F.lit(0), lambda acc, x: acc + x["charge"]).alias("formal_charge"),
        F.when(F.size(carbons) > 0, F.round(F.size(saturated) / F.size(carbons), 3)).otherwise(F.lit(0.0)).alias("saturated_share"), F.round(known, 3).alias("weight"),
    )


# ---- tables ----


def read_structures(df: DataFrame, smiles: str) -> DataFrame:
    """(structure, molecule) of each distinct text: the only exchange, and the only Python."""
    known = df.select(F.trim(F.col(smiles)).alias("structure")).where("structure <> ''").distinct()
    return known.withColumn("molecule", molecule(F.col("structure")))


def profiled(df: DataFrame, smiles: str, radius: int = 2, width: int = 1024) -> DataFrame:
    """``df`` with the struct ``found`` of all that its structure says: valid, canonical, parent, scaffold, bits, features and their
    atoms, silicon counts, functional groups, toxicophores, ionisation parts, topology, descriptors. Each distinct structure is worked on once;
    rows without a readable one have ``found.valid`` false or no ``found``."""
    m = read_structures(df, smiles)
    atoms, rings = F.col("molecule.atoms"), F.col("molecule.rings")
    one = m.withColumn("motifs", motif_columns(atoms))
    names, places = features(atoms, rings, F.col("motifs"))
    alcohols = F.col(f"motifs.m{list(MOTIFS).index('Alcohol')}")
    permanent, acidic, basic = ionisation(atoms)
    silicon = lambda xs: F.size(F.filter(xs, lambda i: F.get(atoms, i)["symbol"] == "Si"))
    found = F.struct(
        F.size(F.filter(atoms, lambda x: x["symbol"] == "Si")).alias("si_atoms"), F.coalesce(F.array_max(F.transform(rings, silicon)), F.lit(0)).alias("si_ring_units"),
        atoms.isNotNull().alias("valid"), F.col("molecule.canonical").alias("canonical"), F.col("molecule.parent").alias("parent"), F.col("molecule.scaffold").alias("scaffold"),
        circular(atoms, radius, width).alias("bits"), names.alias("features"), places.alias("feature_atoms"), groups(atoms).alias("groups"), F.array_sort(named(atoms, TOXICOPHORES)).alias("toxicophores"),
        permanent.alias("permanent"), acidic.alias("acidic"), basic.alias("basic"), topology(atoms, rings, alcohols).alias("topology"), descriptors(atoms).alias("descriptors"),
    )
    packed = one.select(F.col("structure").alias("_structure"), found.alias("found"))
    return df.join(packed, F.trim(F.col(smiles)) == F.col("_structure"), "left").drop("_structure")
