"""Queries over structures: texts composed from the tables' keys, with the result that the composition implies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chemistry, rules, structures
from .catalogue import query, t

#: What ends a chain, and the features, functional groups besides the chain, and toxicophores that it makes.
ENDS = (
    ("", "Hydrocarbon", "", ""),
    ("O", "Alcohol", "Alcohol,Hydroxyl", ""),
    ("C(=O)O", "Carboxylic acid", "Carboxylic Acid,Hydroxyl", ""),
    ("C(=O)OC", "Ester,Ether", "Ester,Ether", ""),
    ("C#N", "Nitrile", "Nitrile", ""),
    ("N", "Amine", "Amine", ""),
    ("OC", "Ether", "Ether", ""),
    ("C=O", "Aldehyde", "Aldehyde", "Aldehyde"),
    ("C(=O)C", "Ketone", "Ketone", ""),
    ("Cl", "Halogenated compound", "Halogen", "Alkyl halide"),
    ("C(=O)N", "Amide", "Amide", ""),
    ("OO", "Organic hydroperoxide", "Hydroxyl", "Peroxide"),
    ("S(=O)(=O)Cl", "Halogenated compound,Sulfur-containing compound — not further classified", "Halogen", "Sulfonyl halide"),
    ("C(=O)C=C", "Ketone", "Ketone", "Michael acceptor"),
    ("O[Si](C)(C)O[Si](C)(C)C", "Siloxane", "Siloxane", ""),
    ("c1ccccc1O", "Phenol", "Aromatic Ring,Hydroxyl,Phenol", ""),
    ("C1CCCCC1", "Hydrocarbon", "", ""),
    ("OP(=O)(OC)OC", "Phosphate ester,Trialkyl phosphate", "Phosphate", ""),
    ("C1CC(=O)NC1", "Amide,Lactam", "Amide", ""),
    ("C1OCCO1", "Acetal,Cyclic acetal,Cyclic ether,Ether", "Ether", ""),
)
#: Ring systems: the text, class, rings, aromatic rings, pairs that are fused, and spiro.
SYSTEMS = (
    ("CCO", "Acyclic", 0, 0, 0, 0), ("c1ccccc1", "Monocyclic", 1, 1, 0, 0), ("C1=CC=CC=C1", "Monocyclic", 1, 1, 0, 0), ("C1CCCCC1", "Monocyclic", 1, 0, 0, 0),
    ("c1ccc2ccccc2c1", "Fused Polycyclic", 2, 2, 1, 0), ("C1CCC2(CC1)CCCC2", "Spirocyclic", 2, 0, 0, 1), ("C1CC2CCC1C2", "Fused Polycyclic", 2, 0, 1, 0), ("c1ccc(cc1)-c1ccccc1", "Bicyclic", 2, 2, 0, 0),
    ("C1COCCOCCOCCOCCO1", "Macrocyclic", 1, 0, 0, 0), ("c1ccc2cc3ccccc3cc2c1", "Fused Polycyclic", 3, 3, 2, 0), ("C1CC1CC1CC1CC1CC1", "Polycyclic", 3, 0, 0, 0), ("C12C3C4C1C5C2C3C45", "Fused Polycyclic", 5, 0, 8, 0),
)


#: The family, functional group and path of each end's class.
KINDS = (
    ("Hydrocarbon", "Hydrocarbon", "Hydrocarbon → Acyclic Hydrocarbon"),
    ("Oxygen-containing Compound", "Alcohol", "Oxygen-containing Compound → Alcohol → Acyclic Alcohol → Primary Alcohol"),
    ("Oxygen-containing Compound", "Carboxylic Acid", "Oxygen-containing Compound → Carboxylic Acid"),
    ("Oxygen-containing Compound", "Ester", "Oxygen-containing Compound → Ester"),
    ("Nitrogen-containing Compound", "Nitrile", "Nitrogen-containing Compound → Nitrile"),
    ("Nitrogen-containing Compound", "Amine", "Nitrogen-containing Compound → Amine"),
    ("Oxygen-containing Compound", "Ether", "Oxygen-containing Compound → Ether"),
    ("Oxygen-containing Compound", "Aldehyde", "Oxygen-containing Compound → Aldehyde"),
    ("Oxygen-containing Compound", "Ketone", "Oxygen-containing Compound → Ketone"),
    ("Halogenated Compound", "Halogenated compound", "Halogenated Compound"),
    ("Nitrogen-containing Compound", "Amide", "Nitrogen-containing Compound → Amide"),
    ("Oxygen-containing Compound", "Hydroperoxide", "Oxygen-containing Compound → Hydroperoxide → Organic Hydroperoxide"),
    ("Halogenated Compound", "Halogenated compound", "Halogenated Compound"),
    ("Oxygen-containing Compound", "Ketone", "Oxygen-containing Compound → Ketone"),
    ("Silicon-containing Compound", "Siloxane", "Silicon-containing Compound → Siloxane"),
    ("Oxygen-containing Compound", "Phenol", "Oxygen-containing Compound → Phenol"),
    ("Hydrocarbon", "Hydrocarbon", "Hydrocarbon → Monocyclic Hydrocarbon"),
    ("Phosphorus-containing Compound", "Phosphate Ester", "Phosphorus-containing Compound → Phosphate Ester → Trialkyl Phosphate"),
    ("Nitrogen-containing Compound", "Amide", "Nitrogen-containing Compound → Amide → Lactam → Cyclic Lactam"),
    ("Oxygen-containing Compound", "Acetal", "Oxygen-containing Compound → Acetal → Cyclic Acetal"),
)


def _taxonomy(place: int) -> str:
    return "CASE c_custkey % " + str(len(ENDS)) + " " + " ".join(f"WHEN {k} THEN '{x[place]}'" for k, x in enumerate(KINDS)) + " END"


def _end(place: int) -> str:
    return "CASE c_custkey % " + str(len(ENDS)) + " " + " ".join(f"WHEN {k} THEN '{x[place]}'" for k, x in enumerate(ENDS)) + " END"


def _choose(choices, key):
    out = F.lit(choices[0])
    for k, x in enumerate(choices[1:], 1):
        out = F.when(key == k, F.lit(x)).otherwise(out)
    return out


def _chains(spark, d):
    """Customers with a chain of four to eight carbons and an end."""
    k = F.col("c_custkey")
    chain = F.repeat(F.lit("C"), (4 + k % 5).cast("int"))
    return t(spark, d, "customer").select("c_custkey", chain.alias("chain"), F.concat(chain, _choose([x[0] for x in ENDS], k % len(ENDS))).alias("smiles"))


def _of_structures(df, smiles: str, **columns):
    """Columns of ``molecule``, worked out once for each distinct structure and joined back."""
    m = structures.read_structures(df, smiles)
    found = m.select(F.col("structure").alias(smiles), *[c.alias(n) for n, c in columns.items()])
    return df.join(found, smiles)


def _atoms():
    return F.col("molecule.atoms")


def _rings():
    return F.col("molecule.rings")


@query(f"""SELECT c_custkey, {_end(1)} AS features, split_part({_end(1)}, ',', 1) AS first_feature, 4 + c_custkey % 5 AS chain FROM customer""")
def structure_features(spark, d):
    c = _chains(spark, d)
    m = structures.read_structures(c, "smiles").withColumn("motifs", structures.motif_columns(_atoms()))
    names, _ = structures.features(_atoms(), _rings(), F.col("motifs"))
    found = m.select(F.col("structure").alias("smiles"), F.array_join(F.array_sort(names), ",").alias("features"))
    return c.join(found, "smiles").select("c_custkey", "features", F.substring_index("features", ",", 1).alias("first_feature"), F.length("chain").alias("chain"))


@query(f"""SELECT c_custkey, {_end(1)} AS features, CASE c_custkey % {len(ENDS)} WHEN 0 THEN 'STC-HYD-001' WHEN 1 THEN 'STC-ALC-001' WHEN 2 THEN 'STC-ACD-001' WHEN 3 THEN 'STC-EST-001' WHEN 4 THEN 'STC-NIT-001' WHEN 5 THEN 'STC-AMI-001'
WHEN 6 THEN 'STC-ETH-004' WHEN 7 THEN 'STC-ALD-001' WHEN 8 THEN 'STC-KET-003' WHEN 9 THEN 'STC-HAL-001' WHEN 10 THEN 'STC-AMD-001' WHEN 11 THEN 'STC-HYP-001' WHEN 12 THEN 'STC-HAL-001' WHEN 13 THEN 'STC-KET-003' WHEN 14 THEN 'STC-SIL-001'
WHEN 15 THEN 'STC-PHE-001' WHEN 16 THEN 'STC-HYD-001' WHEN 17 THEN 'STC-PHO-001' WHEN 18 THEN 'STC-LAC-001' ELSE 'STC-ACE-001' END AS rule_id,
{_taxonomy(0)} AS family, {_taxonomy(1)} AS functional_group, {_taxonomy(2)} AS path FROM customer""")
def structure_classes(spark, d):
    """From the text of a structure to the rule that classifies it."""
    c = _chains(spark, d)
    m = structures.read_structures(c, "smiles").withColumn("motifs", structures.motif_columns(_atoms()))
    names, _ = structures.features(_atoms(), _rings(), F.col("motifs"))
    top = structures.topology(_atoms(), _rings(), F.col(f"motifs.m{list(structures.MOTIFS).index('Alcohol')}"))
    named = m.select(F.col("structure").alias("smiles"), names.alias("f"), top.alias("top")).withColumn("c", rules.classify(F.col("f"), F.lit(True)))
    kind = rules.taxonomy(F.col("c.label"), F.col("f"), F.col("top.rings.topology_class"), F.col("top.rings.aromatic_ring_count"), F.col("top.rings.ring_count"), F.col("top.alcohol_substitution"))
    found = named.select("smiles", F.array_join(F.array_sort("f"), ",").alias("features"), "c.rule_id", kind.alias("k"))
    return c.join(found, "smiles").select("c_custkey", "features", "rule_id", "k.family", "k.functional_group", F.array_join("k.path", " → ").alias("path"))


@query(f"SELECT c_custkey, {_end(2)} AS groups, {_end(3)} AS toxicophores, CASE WHEN c_custkey % {len(ENDS)} = 2 THEN 'Likely acidic' WHEN c_custkey % {len(ENDS)} = 5 THEN 'Likely basic' ELSE 'Neutral' END AS ionisation FROM customer")
def structure_groups(spark, d):
    c = _chains(spark, d)
    names = F.transform(structures.groups(_atoms()), lambda g: g["name"])
    out = _of_structures(
        c, "smiles", groups=F.array_join(F.array_sort(F.filter(names, lambda g: g != "Aliphatic Chain")), ","), toxicophores=F.array_join(F.array_sort(structures.named(_atoms(), structures.TOXICOPHORES)), ","),
        ionisation=chemistry.ionisation_label(*structures.ionisation(_atoms())),
    )
    return out.select("c_custkey", "groups", "toxicophores", "ionisation")


def _system(place: int) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE p_partkey % " + str(len(SYSTEMS)) + " " + " ".join(f"WHEN {k} THEN {quote(x[place])}" for k, x in enumerate(SYSTEMS)) + " END"


@query(f"SELECT p_partkey, {_system(1)} AS topology_class, {_system(2)} AS ring_count, {_system(3)} AS aromatic_ring_count, {_system(4)} AS fused_pairs, {_system(5)} AS spiro_pairs FROM part")
def structure_topology(spark, d):
    p = t(spark, d, "part").select("p_partkey", _choose([x[0] for x in SYSTEMS], F.col("p_partkey") % len(SYSTEMS)).alias("smiles"))
    out = _of_structures(p, "smiles", top=structures.topology(_atoms(), _rings(), F.array().cast("array<array<int>>")))
    return out.select("p_partkey", *[F.col(f"top.rings.{n}").alias(n) for n in ("topology_class", "ring_count", "aromatic_ring_count", "fused_pairs", "spiro_pairs")])


#: Ends that can be written first, as they are read from the chain's far end.
BACKWARDS = (("O", "O"), ("C(=O)O", "OC(=O)"), ("C#N", "N#C"), ("N", "N"), ("C=O", "O=C"), ("Cl", "Cl"), ("c1ccccc1", "c1ccc(cc1)"), ("C1CCCCC1", "C1CCC(CC1)"))


@query("SELECT c_custkey, true AS same_text, true AS same_bits, true AS same_parent, CASE c_custkey % 8 WHEN 6 THEN 'c1ccccc1' WHEN 7 THEN 'C1CCCCC1' ELSE '' END AS scaffold FROM customer")
def structure_canonical(spark, d):
    """A structure written from either end, and as a salt: one canonical text, one fingerprint, one parent."""
    k = F.col("c_custkey") % len(BACKWARDS)
    chain = F.repeat(F.lit("C"), (2 + F.col("c_custkey") % 7).cast("int"))
    forth, back = F.concat(chain, _choose([x[0] for x in BACKWARDS], k)), F.concat(_choose([x[1] for x in BACKWARDS], k), chain)
    salt = F.when(k == 1, F.concat(F.lit("[Na+].[O-]C(=O)"), chain)).otherwise(F.concat(back, F.lit(".Cl")))
    c = t(spark, d, "customer").select("c_custkey", forth.alias("forth"), back.alias("back"), salt.alias("salt"))
    texts = c.select(F.explode(F.array("forth", "back", "salt")).alias("s"))
    m = structures.read_structures(texts, "s").select("structure", F.col("molecule.canonical").alias("text"), F.col("molecule.parent").alias("parent"), F.col("molecule.scaffold").alias("scaffold"), structures.circular(_atoms()).alias("bits"))
    one = lambda n: m.select(F.col("structure").alias(n), F.struct("text", "parent", "scaffold", "bits").alias(f"{n}_"))
    out = c.join(one("forth"), "forth").join(one("back"), "back").join(one("salt"), "salt")
    return out.select(
        "c_custkey", (F.col("forth_.text") == F.col("back_.text")).alias("same_text"), (F.col("forth_.bits") == F.col("back_.bits")).alias("same_bits"),
        (F.col("salt_.parent") == F.col("forth_.text")).alias("same_parent"), F.col("forth_.scaffold").alias("scaffold"),
    )


@query("SELECT c_custkey, 5 + c_custkey % 5 AS heavy_atoms, 1 AS donors, 1 AS acceptors, 2 + c_custkey % 5 AS rotatable_bonds, 0 AS formal_charge, 1.0 AS saturated_share, round((4 + c_custkey % 5) * 12.011 + 15.999 + (10 + 2 * (c_custkey % 5)) * 1.008, 3) AS weight FROM customer")
def structure_descriptors(spark, d):
    """Counts of straight alcohols."""
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.repeat(F.lit("C"), (4 + F.col("c_custkey") % 5).cast("int")), F.lit("O")).alias("smiles"))
    out = _of_structures(c, "smiles", x=structures.descriptors(_atoms()))
    return out.select("c_custkey", "x.*")
