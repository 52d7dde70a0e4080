"""Look-ups in outside services: cached, paced, and cut off at a deadline.

A source is a function from a key to a JSON text (None: nothing found). Keys with a fresh cache entry are not asked for, whether it
holds an answer or that there is none. Several tasks ask at a time and share the pace: each has its own part of the rate
(``Pace``), so that together they never go beyond it. A chain of sources is asked in order, each for what the ones before
it have left open. A failure or a passed deadline is a status of the row, never a failure of the job. Answers are
written before they are used, so that nothing is asked twice when an executor is lost later.

Defined cases: null keys are not asked and have no status; repeated keys are asked once; a deadline holds for all tasks and sources of a call, by
the clock; entries of a cache that are older than allowed are asked for again; of several entries of a key the latest counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import fresh
from ..operators.stage import materialize

Fetch = Callable[[str], str | None]
LATE = "Unavailable: StageDeadlineExceeded"


@dataclass
class Pace:
    """A bucket of tokens: ``rate`` of them a second, at most ``burst`` at once. ``share`` is a task's part of it."""

    rate: float
    burst: float = 1.0

    def share(self, tasks: int) -> Pace:
        return Pace(self.rate / tasks, max(1.0, self.burst / tasks))

    def __post_init__(self) -> None:
        self.held, self.at = 0.0, None

    def wait(self, clock=time.monotonic, sleep=time.sleep) -> None:
        """Take a token, as soon as there is one."""
        now = clock()
        self.held = min(self.burst, self.held + (now - self.at) * self.rate) if self.at is not None else self.burst
        self.at = now
        if self.held < 1:
            sleep((1 - self.held) / self.rate)
            self.held, self.at = 1.0, clock()
        self.held -= 1


def ask(keys: DataFrame, key: str, fetch: Fetch, interval: float = 0.25, deadline: float = 300.0, tasks: int = 1, until: float | None = None) -> DataFrame:
    """(key, status, payload): OK, Not found, or Unavailable with the reason. ``tasks`` ask at a time, together one key in
    ``interval`` seconds; ``until`` is the deadline by the clock, ``deadline`` seconds from now if it isn't given."""
    until = time.time() + deadline if until is None else until
    pace = Pace(1 / interval if interval > 0 else 1e9).share(tasks)

    def run(batches):
        mine = Pace(pace.rate, pace.burst)
        for pdf in batches:
            rows = []
            for k in pdf[key]:
                if time.time() > until:
                    rows.append((k, LATE, None))
                    continue
                mine.wait()
                try:
                    got = fetch(k)
                    rows.append((k, "Not found" if got is None else "OK", got))
                except Exception as e:  # the service's failure, whatever its kind
                    rows.append((k, f"Unavailable: {type(e).__name__}", None))
            yield pd.DataFrame(rows, columns=[key, "status", "payload"])

    known = keys.select(key).where(F.col(key).isNotNull()).distinct()
    kind = keys.schema[key].dataType.simpleString()
    return known.repartition(tasks, key).mapInPandas(run, f"{key} {kind}, status string, payload string")


def enrich(rows: DataFrame, key: str, cache: DataFrame, fetch: Fetch, now: Column, days: int, interval: float = 0.25, deadline: float = 300.0, tasks: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with status and payload, new cache entries). ``cache`` has (key, payload, retrieved_at)."""
    known = fresh(cache, key, "retrieved_at", now, days).select(key, F.lit("OK").alias("status"), "payload")
    asked = materialize(ask(rows.join(known, key, "left_anti"), key, fetch, interval, deadline, tasks), "answers")
    new = asked.where("status = 'OK'").select(key, "payload", now.alias("retrieved_at"))
    return rows.join(known.unionByName(asked), key, "left"), new


@dataclass
class Source:
    """A service in a chain: its name, what asks it, the pace it allows, and for how many days its answers, and the lack of
    one, are believed."""

    name: str
    fetch: Fetch
    interval: float = 0.25
    days: int = 30
    days_without: int = 7


def resolve(rows: DataFrame, key: str, sources: list[Source], cache: DataFrame, now: Column, deadline: float = 300.0, tasks: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows with status, source and payload; new cache entries). Sources are asked in order, each for the keys that no one before it has
    answered. ``cache`` has (source, key, payload, retrieved_at); a null payload is the lack of an answer. A key that
    none has answered is Not found, unless a source was unavailable: then it has that source's status, so that it is asked again."""
    until, entries, answers = time.time() + deadline, None, None
    open_ = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("failed", F.lit(None).cast("string"))
    for s in sources:
        latest = cache.where(F.col("source") == s.name).groupBy(key).agg(F.max_by(F.struct("payload", "retrieved_at"), "retrieved_at").alias("e")).select(key, "e.*")
        held = fresh(latest.where("payload IS NOT NULL"), key, "retrieved_at", now, s.days).select(key, "payload")
        without = fresh(latest.where("payload IS NULL"), key, "retrieved_at", now, s.days_without).select(key, F.lit(None).cast("string").alias("payload"))
        cached = open_.join(held.unionByName(without), key)
        asked = materialize(ask(open_.join(cached.select(key), key, "left_anti"), key, s.fetch, s.interval, tasks=tasks, until=until), "answers")
        said = cached.select(key, F.when(F.col("payload").isNull(), F.lit("Not found")).otherwise(F.lit("OK")).alias("status"), "payload").unionByName(asked)
        state = materialize(open_.join(said, key), "resolved")
        won = state.where("status = 'OK'").select(key, "status", F.lit(s.name).alias("source"), "payload")
        new = asked.where("status IN ('OK', 'Not found')").select(F.lit(s.name).alias("source"), key, "payload", now.alias("retrieved_at"))
        answers = won if answers is None else answers.unionByName(won)
        entries = new if entries is None else entries.unionByName(new)
        open_ = state.where("status <> 'OK'").select(key, F.coalesce("failed", F.when(F.col("status") != "Not found", F.col("status"))).alias("failed"))
    left = open_.select(key, F.coalesce("failed", F.lit("Not found")).alias("status"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("payload"))
    return rows.join(left if answers is None else answers.unionByName(left), key, "left"), entries if entries is not None else cache.limit(0)


# ---- answers ----


def fields(payload: Column) -> Column:
    """map<string,string> of a JSON object's fields by lower-case name; values that are no texts stay JSON. Of names that
    differ only in case the first counts."""
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(low, lambda e, i: F.array_position(F.transform(low, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(kept)


def first_field(payload: Column, *names: str) -> Column:
    """The first of the fields, in any case, that is there and not empty; an empty text for none."""
    held = fields(payload)
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(held, F.lit(n.lower()))), F.lit("")) for n in names], F.lit(""))


def records(payload: Column, *names: str) -> Column:
    """array<string> of an answer's records: the answer itself, if it is a list; else the first list among its fields
    ``names``, or else an answer of one record."""
    listed = lambda c: F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>")
    held = fields(payload)
    one = F.when(F.ltrim(payload).startswith("{"), F.array(payload))
    return F.coalesce(listed(payload), *[listed(F.try_element_at(held, F.lit(n.lower()))) for n in names], one, F.array().cast("array<string>"))


def identity_fields(payload: Column) -> Column:
    """struct of what an identity service says of a compound: the first of the names that a field goes by. Null without a
    list of properties."""
    one = F.get(F.from_json(F.get_json_object(payload, "$.PropertyTable.Properties"), "array<string>"), F.lit(0))
    # The service's names of each field, in order.
    names = {
        "cid": ("CID",), "name": ("Title",), "iupac_name": ("IUPACName",), "smiles": ("CanonicalSMILES", "IsomericSMILES", "SMILES", "ConnectivitySMILES"),
        "inchi": ("InChI",), "inchikey": ("InChIKey",), "formula": ("MolecularFormula",), "molecular_weight": ("MolecularWeight",),
    }
    return F.when(one.isNotNull(), F.struct(*[first_field(one, *ns).alias(n) for n, ns in names.items()]))


def identity_status(asked: Column, found: Column) -> Column:
    """Whether the name that was asked for is the one found: one within the other, whatever their case."""
    a, f = F.lower(F.trim(asked)), F.lower(F.trim(found))
    same = (a != "") & (f != "") & (f.contains(a) | a.contains(f))
    return F.when(F.coalesce(same, F.lit(False)), F.lit("Exact Match")).otherwise(F.lit("Partial Match"))


def bioactivity_fields(molecules: Column, mechanisms: Column) -> Column:
    """struct(max_phase, targets) of a bioactivity service's two answers: the first molecule's phase, and its targets with what is done to
    them, each once in order; ``None`` without any."""
    first = F.get(records(molecules, "molecules"), F.lit(0))
    each = F.transform(F.coalesce(F.from_json(F.get_json_object(mechanisms, "$.mechanisms"), "array<string>"), F.array().cast("array<string>")), lambda m: F.concat(
        F.coalesce(F.get_json_object(m, "$.target_chembl_id"), F.lit("Unknown Target")), F.lit(" ("), F.coalesce(F.get_json_object(m, "$.action_type"), F.lit("Unknown Action")), F.lit(")"),
    ))
    text = F.array_join(F.array_sort(F.array_distinct(each)), ", ")
    found = F.coalesce(F.get_json_object(first, "$.molecule_chembl_id"), F.lit("")) != ""
    return F.struct(F.when(found, F.coalesce(F.get_json_object(first, "$.max_phase").try_cast("double"), F.lit(0.0))).alias("max_phase"), F.when(found & (text != ""), text).otherwise(F.lit("None")).alias("targets"))


def taxonomy_fields(payload: Column) -> Column:
    """struct of the classification's levels and sorted distinct substituents of a JSON answer; null
    if it has no hierarchy."""
    name = lambda p: F.coalesce(F.trim(F.get_json_object(payload, f"$.{p}.name")), F.trim(F.get_json_object(payload, f"$.{p}")), F.lit(""))
    levels = {p: name(p) for p in ("kingdom", "superclass", "class", "subclass", "direct_parent")}
    frame = F.trim(F.coalesce(F.get_json_object(payload, "$.molecular_framework"), F.lit("")))
    subs = F.coalesce(F.from_json(F.get_json_object(payload, "$.substituents"), "array<string>"), F.array().cast("array<string>"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform(subs, lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.name"), x))), lambda x: x != "")))
    some = F.lit(False)
    for p in ("kingdom", "superclass", "class", "direct_parent"):
        some = some | (levels[p] != "")
    return F.when(some, F.struct(*[v.alias(k) for k, v in levels.items()], frame.alias("molecular_framework"), F.array_join(items, "; ").alias("substituents")))


def local_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload, cache_version) of a JSON file of records by exact key: a cache that asks no service. Keys
    are upper-case; without the file there are no records."""
    kind = "key string, payload string, cache_version string"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)
    records = F.from_json(F.get_json_object("value", "$.records"), "map<string,string>")
    return text.select(F.explode(records).alias("key", "payload"), F.get_json_object("value", "$.cache_version").alias("cache_version")).select(F.upper(F.trim("key")).alias("key"), "payload", "cache_version")
