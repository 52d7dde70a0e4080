"""Structures: reading, rings, canonical form, patterns and fingerprints, against brute force on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import molecule
from gneiss.operators import cluster, structures

TEXTS = (
    "CCO CC(=O)C CC(=O)OC CC(=O)O CC(=O)[O-].[Na+] CC#N c1ccccc1O C1=CC=CC=C1 C1=CC2=CC=CC=C2C=C1 C[Si](C)(C)O[Si](C)(C)C C[Si]1(C)O[Si](C)(C)O[Si](C)(C)O[Si](C)(C)O1 COP(=O)(OC)OC "
    "CP(=O)(C)C COOC CS(=O)(=O)N C1CCC2(CC1)CCCC2 C1CC2CCC1C2 c1ccc(cc1)-c1ccccc1 Cn1cnc2c1c(=O)n(C)c(=O)n2C O=[N+]([O-])c1ccccc1 C12C3C4C1C5C2C3C45 CC(C)(C)c1ccc(O)cc1 "
    "C1COCCOCCOCCOCCO1 O=C1C=CC(=O)C=C1 C[N+](C)(C)CC(=O)[O-] CC(C)CC(C)(C)C c1ccc(cc1)c1ccc(cc1)c1ccccc1 FC(F)(F)c1cc(Cl)ccc1N=[N+]=[N-] C1CC1CO OC1CCCCC1 C1OC1C N[C@@H](C)C(=O)O F/C=C/F"
).split(" ")


def shuffled(rng, atoms):
    """The same atoms in another order."""
    place = list(range(len(atoms)))
    rng.shuffle(place)
    out = [None] * len(atoms)
    for i, a in enumerate(atoms):
        out[place[i]] = molecule.Atom(a.symbol, a.aromatic, a.charge, a.h, {place[j]: o for j, o in a.near.items()})
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_canonical_text_of_any_order(text):
    rng, atoms = random.Random(1), molecule.read(text)
    want = molecule.write(atoms)
    assert all(molecule.write(shuffled(rng, atoms)) == want for _ in range(15))
    again = molecule.read(want)
    assert molecule.write(again) == want and sorted(map(molecule._kind, again)) == sorted(map(molecule._kind, atoms))


def test_canonical_text_of_random_graphs():
    """Different texts for graphs that no numbering maps onto one another, equal ones for those that one does."""
    rng, seen = random.Random(4), {}

    def graph(n):
        atoms = [molecule.Atom(rng.choice("CN"), h=0) for _ in range(n)]
        for i in range(1, n):
            j = rng.randrange(i)
            atoms[i].near[j] = atoms[j].near[i] = 1
        for _ in range(rng.randint(0, 3)):
            i, j = rng.sample(range(n), 2)
            if j not in atoms[i].near:
                atoms[i].near[j] = atoms[j].near[i] = rng.choice([1, 2])
        return atoms

    def form(atoms):
        n = len(atoms)
        return min(tuple((atoms[p[i]].symbol, tuple(atoms[p[i]].near.get(p[j], 0) for j in range(i))) for i in range(n)) for p in itertools.permutations(range(n)))

    for _ in range(120):
        atoms = graph(rng.randint(2, 6))
        text = molecule.write(atoms)
        assert molecule.write(shuffled(rng, atoms)) == text
        assert seen.setdefault(text, form(atoms)) == form(atoms)
    assert len(set(seen.values())) == len(seen)


def test_smallest_rings_of_small_graphs():
    """As many rings as are independent, and none could be smaller: their lengths are the least of all bases of cycles."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(3, 7)
        atoms = [molecule.Atom("C") for _ in range(n)]
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.45]
        for i, j in pairs:
            atoms[i].near[j] = atoms[j].near[i] = 1
        bit = {frozenset(p): 1 << k for k, p in enumerate(pairs)}
        cycles = set()
        for size in range(3, n + 1):
            for ring in itertools.permutations(range(n), size):
                if ring[0] == min(ring) and ring[1] < ring[-1] and all(frozenset((ring[i - 1], ring[i])) in bit for i in range(size)):
                    cycles.add((size, sum(bit[frozenset((ring[i - 1], ring[i]))] for i in range(size))))
        basis, want = [], []
        for size, mark in sorted(cycles):
            for b in basis:
                mark = min(mark, mark ^ b)
            if mark:
                basis.append(mark)
                want.append(size)
        assert sorted(len(r) for r in molecule.rings(atoms)) == want


@pytest.mark.parametrize("text", [None, "", " ", "bad(", "C1CC", "C(", ")", "Q", "C11", "1C"])
def test_no_structure(text):
    assert molecule.described(text) is None


def brute(atoms, pattern):
    """Atom sets of all injections of a pattern."""

    def fits(i, spec):
        a = atoms[i]
        value = {"aromatic": a.aromatic, "charge": a.charge, "h": a.h, "degree": len(a.near), "x": len(a.near) + a.h, "ring": smallest[i]}
        if spec["symbols"] and a.symbol not in spec["symbols"]:
            return False
        if any(value[k] not in v if isinstance(v, tuple) else value[k] != v for k, v in spec["limits"].items()):
            return False
        begins = lambda p: any(m[0] == i for m in found([{**p[0], "symbols": (), "limits": {}}, *p[1:]]))
        return not any(begins(p) for p in spec["lacks"]) and all(begins(p) for p in spec["needs"])

    def found(p):
        out = []
        for m in itertools.permutations(range(len(atoms)), len(p)):
            if all(s["at"] is None or atoms[m[s["at"]]].near.get(m[k]) in s["bond"] for k, s in enumerate(p)) and all(fits(i, s) for i, s in zip(m, p, strict=True)):
                out.append(m)
        return out

    rings = molecule.rings(atoms)
    smallest = [min((len(r) for r in rings if i in r), default=0) for i in range(len(atoms))]
    return {frozenset(m) for m in found(pattern)}


def test_patterns_equal_all_injections(spark):
    """Every pattern on every small structure."""
    small = [s for s in TEXTS if len(molecule.read(s)) <= 8] + ["CNN", "CC(=O)Cl", "C=CC(=O)C", "CN(C)N=O", "C1OC1", "CS(=O)(=O)Cl", "CC(=O)OC(C)=O", "CS(C)=O", "OO", "COO", "CO[Si]", "C[Si]O", "c1ccnc1", "NC=O", "CC(N)=O", "OP(=O)(O)O", "O=S(=O)(O)C", "CN", "C[N+](C)(C)C", "N=C", "CCl"]
    named = {**structures.MOTIFS, **{f"group {k}": v for k, v in structures.GROUPS.items()}, **{f"tox {k}": v for k, v in structures.TOXICOPHORES.items()}}
    named |= {f"basic {k}": v for k, v in enumerate(structures.BASIC)} | {f"acidic {k}": v for k, v in enumerate(structures.ACIDIC)} | {f"permanent {k}": v for k, v in enumerate(structures.PERMANENT)}
    m = structures.read_structures(spark.createDataFrame([(s,) for s in small], "s string"), "s")
    for part in (list(named)[i : i + 20] for i in range(0, len(named), 20)):
        rows = m.select("structure", *[structures.matches(F.col("molecule.atoms"), named[k]).alias(f"p{i}") for i, k in enumerate(part)]).collect()
        for r in rows:
            atoms = molecule.read(r.structure)
            for i, k in enumerate(part):
                got = [frozenset(x) for x in r[f"p{i}"]]
                assert len(got) == len(set(got)) and set(got) == brute(atoms, named[k]), (r.structure, k)


def test_profile_to_clusters(spark):
    """From texts to fingerprints to cluster numbers; the order of a text's atoms changes nothing."""
    texts = ["CCCCO", "OCCCC", "CCCCCO", "c1ccccc1C(=O)O", "OC(=O)c1ccccc1", "bad(", None, "C[Si](C)(C)O[Si](C)(C)C"]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, smiles string")
    out = structures.profiled(df, "smiles").cache()
    got = {r.pos: r.found for r in out.collect()}
    assert got[6] is None and not got[5].valid
    assert got[0].canonical == got[1].canonical and got[0].bits == got[1].bits and got[3].bits == got[4].bits and got[0].bits != got[2].bits
    assert got[3].features == ["Carboxylic acid"] and got[3].scaffold == "c1ccccc1" and got[7].features == ["Siloxane"] and got[3].acidic and got[0].descriptors.rotatable_bonds == 2
    assert got[0].topology.alcohol_substitution == "Primary Alcohol" and got[3].topology.rings.topology_modifiers == "Aromatic"
    made = out.where("found.valid").select("pos", F.col("found.canonical").alias("s"), F.lit("all").alias("family"), F.col("found.bits").alias("bits"))
    clusters = {r.pos: (r.cluster_id, r.cluster_size, r.unique_count) for r in cluster.gated_clusters(made, "pos", "s", "family", "bits", "pos", 0.6).collect()}
    assert clusters[0] == clusters[1] and clusters[3] == clusters[4] and clusters[3][1:] == (2, 1) and len({c for c, *_ in clusters.values()}) >= 3
    out.unpersist()


def test_thresholds_and_their_rules(spark):
    """Three ethers make a polyether, or as many as the rules say; a crown is macrocyclic."""
    from gneiss.plans import policies

    rules = {"rule_version": "1", "taxonomy_dictionary_version": "1", "thresholds": dict(structures.THRESHOLDS), "primary_class_vocabulary": ["Ether", "Polyether"]}
    assert policies.classification(rules).version == "1"
    for bad in ({"rule_version": ""}, {"thresholds": {}}, {"thresholds": {**structures.THRESHOLDS, "macrocyclic_min_ring_size": 0}}, {"primary_class_vocabulary": ["a", "a"]}):
        with pytest.raises(ValueError):
            policies.classification({**rules, **bad})
    assert policies.ontology_mappings({"mappings": {"R": {"direct_parent": "x"}}}) == {"R": {"direct_parent": "x"}}
    m = structures.read_structures(spark.createDataFrame([("COCOC",), ("COCCOCCOC",), ("C1COCCOCCOCCOCCO1",)], "s string"), "s").withColumn("motifs", structures.motif_columns(F.col("molecule.atoms")))
    of = lambda limits: {r.structure: r.f for r in m.select("structure", structures.features(F.col("molecule.atoms"), F.col("molecule.rings"), F.col("motifs"), limits)[0].alias("f")).collect()}
    got = of(structures.THRESHOLDS)
    assert "Polyether" not in got["COCOC"] and "Polyether" in got["COCCOCCOC"] and "Macrocyclic polyether" in got["C1COCCOCCOCCOCCO1"] and "Macrocyclic polyether" not in got["COCCOCCOC"]
    assert "Polyether" in of({**structures.THRESHOLDS, "polyether_min_ether_bridges": 2})["COCOC"]


def test_run_from_structures(spark, tmp_path):
    """Texts and names are enough: classes, families, clusters, evidence."""
    from gneiss.plans import pipeline

    texts = ["CCCCO", "CCCCCO", "CCCCCCO", "c1ccccc1C(=O)O", "CC(=O)O", "bad(", None, "C[Si]1(C)O[Si](C)(C)O[Si](C)(C)O1"]
    rows = [(i, f"n{i}", f"{i}-1", s, f"K{i}", "Resolved", 1.0) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "src_pos long, name string, casrn string, smiles string, inchikey string, identity_status string, conc double")
    out = pipeline.run(spark, df, f"file://{tmp_path}/run", contract=["name", "chemical_class", "cluster_id", "scaffold", "topology_class", "ionisation"])
    got = {r.name: r for r in out.compounds.collect()}
    assert [got[f"n{i}"].chemical_class for i in range(8)] == ["Alcohol", "Alcohol", "Alcohol", "Carboxylic acid", "Carboxylic acid", "Unclassified", "Unclassified", "Cyclic siloxane"]
    assert got["n3"].scaffold == "c1ccccc1" and got["n5"].scaffold == "Invalid" and got["n3"].ionisation == "Likely acidic" and got["n7"].topology_class == "Monocyclic"
    assert got["n5"].cluster_id is None and got["n0"].cluster_id is not None
    matrix = out.side["evidence_matrix"]
    kinds = {r.Evidence_Type for r in matrix.select("Evidence_Type").distinct().collect()}
    assert {"Deterministic cluster", "Scaffold", "Domain status", "Calculated property ranges"} <= kinds and out.side["matrix_hash"].count() == matrix.select("Cluster_ID").distinct().count()
    register = [(r.Category, r.Level, r.Reason) for r in out.side["register"].collect()]
    assert register and {c for c, *_ in register} <= {"Identity", "Structure", "Reactivity", "Property", "Biological", "Exposure", "Domain"}


def test_hazard_records_are_whole(spark):
    from gneiss.operators import ledger

    raw = spark.createDataFrame([("D1", "Mutagenicity", ">", "5", "mg", None, "In vitro", "Rat", "Oral", "28 d"), ("D1", "cancer", "", "7", None, "r2", "x", None, "", None), ("D2", "nothing", "", "1", "", "", "", "", "", "")], "id string, text string, q string, v string, u string, rec string, study string, sp string, route string, dur string")
    out = sorted(ledger.hazard_records(raw, "id", "text", "q", "v", "u", "rec", "study", "sp", "route", "service", "dur", "https://x", "v1").collect(), key=lambda r: r.endpoint)
    assert [r.endpoint for r in out] == ["Carcinogenicity", "Genotoxicity"]
    a, b = out
    assert (a.source_record, a.dose, a.dose_unit, a.study_type, a.species, a.route, a.duration) == ("r2", "7", "", "Other", "Not reported", "Not reported", "")
    assert (b.dose, b.dose_unit, b.duration, b.source_url, b.source_database_version, b.reviewer_status) == ("> 5", "mg", "28 d", "https://x", "v1", "Not reviewed") and b.source_record.startswith("EPA-CTX-") and len(b.source_record) == 24 and b.notes
