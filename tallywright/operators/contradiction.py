"""Contradictions between decisions and their quarantine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import replaced, saved, written
from ..functions.scalars import uuid_v5
from .fold import ordered_fold

SKIPPED = ("quarantined", "superseded")
#: Fixed value: the sentence that tells people why a row is quarantined.
REASON = "Proposed decision '%s' contradicts active decision '%s' (ID: %s) in scope %s/%s"


@dataclass(frozen=True)
class Rule:
    """Titles with one word contradict titles with the other, where the new row's system is among ``systems``."""

    one: str
    other: str
    systems: tuple[str, ...]


RULES = (Rule("postgres", "mongodb", ("db", "database")),)


def is_contradictory(new_title: Column, new_system: Column, old_title: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Equal titles as they are, or opposing words in any case."""
    out = new_title == old_title
    a, b = F.lower(new_title), F.lower(old_title)
    for r in rules:
        out = out | (new_system.isin(*r.systems) & ((a.contains(r.one) & b.contains(r.other)) | (a.contains(r.other) & b.contains(r.one))))
    return F.coalesce(out, F.lit(False))


def title_class(title: Column, rule: Rule = RULES[0]) -> Column:
    """A, B, AB or none: which words of a rule a title has."""
    low = F.lower(title)
    return F.when(low.contains(rule.one) & low.contains(rule.other), "AB").when(low.contains(rule.one), "A").when(low.contains(rule.other), "B").otherwise("none")


def _lookups(new: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """tenant_id, id and the keys under which a new row looks for others: its scope, where "*" means any, and a term: its title, or a word that a rule opposes to one of its own."""
    low = F.lower(F.coalesce("title", F.lit("")))
    system = F.coalesce("scope_system", F.lit(""))
    terms = [F.concat(F.lit("title "), F.coalesce("title", F.lit("")))]
    for n, r in enumerate(rules):
        ruled = system.isin(*r.systems)
        terms += [F.when(ruled & low.contains(r.one), F.lit(f"word {n} other")), F.when(ruled & low.contains(r.other), F.lit(f"word {n} one"))]
    return new.select("tenant_id", "id", _scope_key("scope_domain").alias("_d"), _scope_key("scope_system").alias("_s"), F.explode(F.array_compact(F.array(*terms))).alias("_term"))


def _scope_key(part: str) -> Column:
    value = F.coalesce(part, F.lit(""))
    return F.when(value == "", "*").otherwise(F.concat(F.lit("="), value))


def _findable(old: DataFrame, rules: tuple[Rule, ...], patterns: list[tuple[bool, bool]]) -> DataFrame:
    """tenant_id, conflicting_id, conflicting_at and the keys under which a row is found, for each of the scope patterns (domain given, system given) that lookups have."""
    low = F.lower(F.coalesce("title", F.lit("")))
    terms = [F.concat(F.lit("title "), F.coalesce("title", F.lit("")))]
    for n, r in enumerate(rules):
        terms += [F.when(low.contains(r.one), F.lit(f"word {n} one")), F.when(low.contains(r.other), F.lit(f"word {n} other"))]
    domain, system = F.concat(F.lit("="), F.coalesce("scope_domain", F.lit(""))), F.concat(F.lit("="), F.coalesce("scope_system", F.lit("")))
    scopes = [F.struct((domain if d else F.lit("*")).alias("d"), (system if s else F.lit("*")).alias("s")) for d, s in patterns]
    rows = old.select("tenant_id", F.col("id").alias("conflicting_id"), F.col("created_at").alias("conflicting_at"), F.array(*scopes).alias("_scopes"), F.explode(F.array_compact(F.array(*terms))).alias("_term"))
    return rows.select("*", F.explode("_scopes").alias("_at")).select("tenant_id", "conflicting_id", "conflicting_at", F.col("_at.d").alias("_d"), F.col("_at.s").alias("_s"), "_term")


_KEYS = ["tenant_id", "_d", "_s", "_term"]


def _matched(new: DataFrame, existing: DataFrame, rules: tuple[Rule, ...], skipped: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    looks = _lookups(new, rules)
    patterns = [tuple(r) for r in looks.select(F.col("_d") != "*", F.col("_s") != "*").distinct().collect()]  # four rows at most
    old = existing.filter(~F.coalesce("status", F.lit("")).isin(*skipped))
    return looks, _findable(old, rules, patterns or [(True, True)])


def conflict_pairs(new: DataFrame, existing: DataFrame, rules: tuple[Rule, ...] = RULES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(tenant_id, id, conflicting_id, conflicting_at): each new row with every active row that contradicts it.

    One join by equality on tenant, scope and term, so rows of a busy scope meet only where they contradict each
    other. An empty scope part of the new row means any. As long as the pairs themselves: for the earliest conflict
    take :func:`earliest_conflicts`. Null titles count as empty.
    """
    looks, found = _matched(new, existing, rules, skipped)
    return looks.join(found, _KEYS).filter(F.col("id") != F.col("conflicting_id")).select("tenant_id", "id", "conflicting_id", "conflicting_at").distinct()


def first_conflict(pairs: DataFrame) -> DataFrame:
    """The earliest conflicting row of each new one out of given pairs."""
    return pairs.groupBy("tenant_id", "id").agg(F.min(F.struct("conflicting_at", "conflicting_id")).alias("m")).select("tenant_id", "id", F.col("m.conflicting_id").alias("conflicting_id"))


def earliest_conflicts(new: DataFrame, existing: DataFrame, rules: tuple[Rule, ...] = RULES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(tenant_id, id, conflicting_id): the earliest active row that contradicts each new one (C04), without the pairs.

    Existing rows come down to the first two of each key before they are joined (the second counts where the first
    is the new row itself), so the join has one row a key.
    """
    looks, found = _matched(new, existing, rules, skipped)
    place = F.struct("conflicting_at", "conflicting_id")
    one = saved(found.groupBy(*_KEYS).agg(F.min(place).alias("_one")))
    two = found.join(one, _KEYS).filter(F.col("conflicting_id") != F.col("_one.conflicting_id")).groupBy(*_KEYS).agg(F.min(place).alias("_two"))
    firsts = one.join(two, _KEYS, "left")
    hit = F.when(F.col("_one.conflicting_id") != F.col("id"), F.col("_one")).otherwise(F.col("_two"))
    return first_conflict(looks.join(firsts, _KEYS).select("tenant_id", "id", hit.alias("_hit")).filter("_hit IS NOT NULL").select("tenant_id", "id", "_hit.*"))


def _worded(title: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a title has a word of any rule."""
    low, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(False)
    for r in rules:
        out = out | low.contains(r.one) | low.contains(r.other)
    return out


def _without_existing(new: DataFrame, existing: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """new with ``_hit``, the earliest active existing row in conflict with it."""
    if existing is None:
        return new.withColumn("_hit", F.lit(None).cast(new.schema["id"].dataType))
    hits = earliest_conflicts(new, existing, rules).withColumnRenamed("conflicting_id", "_hit")
    return new.join(hits, ["tenant_id", "id"], "left")


def quarantine(new: DataFrame, existing: DataFrame | None = None, rules: Rule | tuple[Rule, ...] = RULES) -> DataFrame:
    """new with status, conflicting_id and conflict_kind as if its rows came one after another by (created_at, id).

    Rows in conflict with an active existing row are quarantined. Rows of one tenant can then only meet where they
    have the same title, or where both have words of rules; these are the groups of :func:`quarantine_fold`. Groups
    in which every row has both scope parts, under one rule, have a closed form per tenant and scope: a row falls
    if its title was there before, or if the first row with a word of the rule has the opposing one: two
    aggregates and two joins, no window and no loop. The others (empty scope parts, several rules) settle in rounds
    (see :func:`_settled`). Ids are taken to be unique in a tenant; null titles and scopes count as empty.
    """
    rules = (rules,) if isinstance(rules, Rule) else tuple(rules)
    rows = _without_existing(new, existing, rules)
    empty = (F.coalesce("scope_domain", F.lit("")) == "") | (F.coalesce("scope_system", F.lit("")) == "")
    rows = saved(rows.withColumns({"_wild": empty, "_group": group_of(rules)}))
    hit = rows.filter("_hit IS NOT NULL").withColumns({"conflicting_id": F.col("_hit"), "conflict_kind": F.lit("existing")})
    free = rows.filter("_hit IS NULL")
    if len(rules) == 1:
        wild = free.filter("_wild").select("tenant_id", "_group").distinct().withColumn("_folded", F.lit(True))
        free = free.alias("r").join(wild.alias("w"), F.col("r.tenant_id").eqNullSafe(F.col("w.tenant_id")) & (F.col("r._group") == F.col("w._group")), "left").select("r.*", "_folded")
        settled = [hit, _closed_form(free.filter("_folded IS NULL").drop("_folded"), rules[0])]
        rest = free.filter("_folded").drop("_folded")
    else:
        settled, rest = [hit], free
    out = settled[0]
    for part in [*settled[1:], _settled(rest, rules)]:
        out = out.unionByName(part)
    return out.withColumn("status", F.when(F.col("conflicting_id").isNotNull(), "quarantined").otherwise(F.col("status"))).select(*new.columns, "conflicting_id", "conflict_kind")


def group_of(rules: tuple[Rule, ...]) -> Column:
    """Rows of a tenant that can meet share this: all rows with words of rules, else the rows of a title."""
    return F.when(_worded(F.col("title"), rules), "words").otherwise(F.concat(F.lit("title "), F.coalesce("title", F.lit(""))))


def _closed_form(rows: DataFrame, rule: Rule) -> DataFrame:
    """conflicting_id and conflict_kind of rows whose scope parts are all set."""
    cls = F.when(F.col("scope_system").isin(*rule.systems), title_class(F.coalesce("title", F.lit("")), rule)).otherwise("none")
    rows = rows.withColumns({"_class": cls, "_place": F.struct("created_at", "id"), "_title": F.coalesce("title", F.lit(""))})
    scope = ["tenant_id", "scope_domain", "scope_system"]
    leads = rows.filter("_class <> 'none'").groupBy(*scope).agg(F.min(F.struct("_place", "_class")).alias("_lead"))
    titles = rows.groupBy(*scope, "_title").agg(F.min("_place").alias("_first"))

    def on(left: str, right: str, keys: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])

    joined = rows.alias("r").join(leads.alias("l"), on("r", "l", scope), "left").join(titles.alias("t"), on("r", "t", [*scope, "_title"]), "left").select("r.*", "_lead", "_first")
    word = (F.col("_class") != "none") & (F.col("_place") != F.col("_lead._place")) & ~((F.col("_class") == F.col("_lead._class")) & (F.col("_class") != "AB"))
    word = F.coalesce(word, F.lit(False))
    again = F.col("_place") != F.col("_first")
    found = F.when(word, F.col("_lead._place.id")).when(again, F.col("_first.id"))
    return joined.withColumns({"conflicting_id": found, "conflict_kind": F.when(word, "keyword").when(again, "title")}).drop("_class", "_place", "_title", "_lead", "_first")


def quarantine_fold(new: DataFrame, rules: tuple[Rule, ...] = RULES, existing: DataFrame | None = None) -> DataFrame:
    """The sequential rule itself: existing rows first, empty scope parts as wildcards, several rules. It is what :func:`quarantine` must equal; that one has no task a tenant.

    Rows are folded by tenant and group of rows that can meet. The state of a title's group is one id for each scope
    that has it; that of a tenant's rows with rule words also has their surviving titles.
    """
    rows = _without_existing(new, existing, rules).withColumn("_group", group_of(rules))
    hit = rows.filter("_hit IS NOT NULL").withColumn("conflicting_id", F.col("_hit"))
    out = hit.unionByName(_folded(rows.filter("_hit IS NULL"), rules).drop("conflict_kind"))
    return out.withColumn("status", F.when(F.col("conflicting_id").isNotNull(), "quarantined").otherwise(F.col("status"))).select(*new.columns, "conflicting_id")


class Survivors:
    """The surviving rows of a group of rows that can meet: for each scope pattern and term the first one's place and id."""

    def __init__(self, rules: tuple[Rule, ...], first: dict | None = None):
        self.rules, self.first = rules, first if first is not None else {}

    def take(self, id_, title: str | None, domain: str | None, system: str | None) -> tuple:
        """(id of the earliest survivor in conflict, kind); a row without one survives: (None, None)."""
        title, domain, system = title or "", domain or "", system or ""
        low = title.lower()
        has = [(r.one in low, r.other in low) for r in self.rules]
        scope = (domain or None, system or None)
        found = []
        for n, (r, (one, other)) in enumerate(zip(self.rules, has, strict=True)):
            if system in r.systems:
                found += [(*self.first[k], "keyword") for k in [(*scope, f"word {n} other")] if one and k in self.first]
                found += [(*self.first[k], "keyword") for k in [(*scope, f"word {n} one")] if other and k in self.first]
        found += [(*self.first[k], "title") for k in [(*scope, "title " + title)] if k in self.first]
        if found:
            return min(found, key=lambda f: f[0])[1:]
        place = len(self.first)
        terms = ["title " + title, *[f"word {n} {w}" for n, pair in enumerate(has) for w, there in zip(("one", "other"), pair, strict=True) if there]]
        for term in terms:
            for d in {domain, None}:
                for s in {system, None}:
                    self.first.setdefault((d, s, term), (place, id_))
        return None, None


def _folded(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    def step(state: Survivors, row: tuple) -> tuple[Survivors, tuple]:
        return state, state.take(*row)

    kind = rows.schema["id"].dataType.simpleString()
    return ordered_fold(rows, ["tenant_id", "_group"], ["created_at", "id"], ["id", "title", "scope_domain", "scope_system"], lambda _: Survivors(rules), step, f"conflicting_id {kind}, conflict_kind string")


_PLACE = ["_d", "_s", "_term", "_t"]


def _settled(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """conflicting_id and conflict_kind as the fold gives them, by rounds of joins on (tenant, scope pattern, term) instead of a task a tenant.

    In a round each row that is not settled looks up, under each of its keys, the earliest survivor and the earliest row
    that is still open. With a survivor before it, it falls (and can be in nobody's way any more); its conflict is
    known once no open row stands before that survivor. With neither before it, it survives. The earliest open row of
    a tenant always settles, and rows of different keys settle side by side: for orders that do not follow the
    conflicts the rounds grow with the logarithm of the longest chain of rows that wait for each other.
    """
    kept = saved(rows.withColumn("_r", F.monotonically_increasing_id()))
    tenant = F.coalesce(F.concat(F.lit("="), F.col("tenant_id").cast("string")), F.lit("*"))
    base = kept.select(tenant.alias("tenant_id"), F.col("_r").alias("id"), "title", "scope_domain", "scope_system", F.struct("created_at", F.col("id").alias("i"), F.col("_r").alias("r")).alias("created_at"))
    places = base.select(F.col("id").alias("_r"), F.col("created_at").alias("_at"))
    looks = _lookups(base, rules)
    patterns = [tuple(r) for r in looks.select(F.col("_d") != "*", F.col("_s") != "*").distinct().collect()]  # four rows at most
    looks = written(looks.select(F.col("id").alias("_r"), F.col("tenant_id").alias("_t"), "_d", "_s", "_term").join(places, "_r"))
    finds = written(_findable(base, rules, patterns or [(True, True)]).select(F.col("conflicting_id").alias("_r"), F.col("conflicting_at").alias("_at"), F.col("tenant_id").alias("_t"), "_d", "_s", "_term"))
    best, known = None, []
    while not looks.isEmpty():
        near = looks.join(finds.groupBy(*_PLACE).agg(F.min("_at").alias("_wait")), _PLACE, "left")
        near = near.withColumn("_best", F.lit(None).cast(near.schema["_at"].dataType)) if best is None else near.join(best, _PLACE, "left")
        kind = F.when(F.col("_term").startswith("word "), 0).otherwise(1)
        seen = near.groupBy("_r", "_at").agg(
            F.min(F.when(F.col("_wait") < F.col("_at"), F.col("_wait"))).alias("_wait"),
            F.min(F.when(F.col("_best") < F.col("_at"), F.struct(F.col("_best").alias("at"), kind.alias("kind")))).alias("_hit"),
        )
        sure = F.when(F.col("_hit").isNull(), F.col("_wait").isNull()).otherwise(F.col("_wait").isNull() | (F.col("_hit.at") < F.col("_wait")))
        state = written(seen.select("_r", F.col("_hit.at.i").alias("_by"), F.col("_hit.kind").alias("_kind"), F.col("_hit").isNotNull().alias("_falls"), sure.alias("_sure")))
        known.append(state.filter("_sure").select("_r", "_by", "_kind"))
        stays = finds.join(state.filter("NOT _falls AND _sure").select("_r"), "_r", "left_semi").groupBy(*_PLACE).agg(F.min("_at").alias("_best"))
        best = replaced(stays if best is None else best.unionByName(stays).groupBy(*_PLACE).agg(F.min("_best").alias("_best")), best)
        finds = replaced(finds.join(state.filter("_falls OR _sure").select("_r"), "_r", "left_anti"), finds)
        looks = replaced(looks.join(state.filter("_sure").select("_r"), "_r", "left_anti"), looks)
    kind_of = rows.schema["id"].dataType
    if not known:
        return rows.withColumns({"conflicting_id": F.lit(None).cast(kind_of), "conflict_kind": F.lit(None).cast("string")})
    found = reduce(DataFrame.unionByName, known)
    out = kept.join(found, "_r", "left").withColumns({"conflicting_id": F.col("_by"), "conflict_kind": F.when(F.col("_kind") == 0, "keyword").when(F.col("_kind") == 1, "title")})
    return out.drop("_r", "_by", "_kind")


def contradiction_records(quarantined: DataFrame, now: Column) -> DataFrame:
    """A record for each quarantined row: decision_a exists, decision_b was proposed."""
    hit = quarantined.filter(F.col("conflicting_id").isNotNull())
    a, b = F.col("conflicting_id").cast("string"), F.col("id").cast("string")
    return hit.select(uuid_v5(F.concat(a, F.lit("|"), b)).alias("id"), "tenant_id", a.alias("decision_a"), b.alias("decision_b"), F.lit("medium").alias("severity"), F.lit(True).alias("quarantined"), F.lit(False).alias("resolved"), F.lit("human").alias("resolution_strategy"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("timestamp").alias("auto_resolved_at"))


def reason(quarantined: DataFrame, existing_titles: DataFrame) -> DataFrame:
    """A sentence for people (C07). ``existing_titles`` has tenant_id, conflicting_id and conflicting_title."""
    text = F.format_string(REASON, F.col("title"), F.col("conflicting_title"), F.col("conflicting_id").cast("string"), F.col("scope_domain"), F.col("scope_system"))
    return quarantined.filter(F.col("conflicting_id").isNotNull()).join(existing_titles, ["tenant_id", "conflicting_id"]).withColumn("reason", text)


def resolve(contradictions: DataFrame, resolutions: DataFrame, now: Column) -> DataFrame:
    """Marks contradictions (tenant_id, id) of ``resolutions`` (with strategy) as resolved."""
    joined = contradictions.join(resolutions.select("tenant_id", "id", F.col("strategy").alias("_s")), ["tenant_id", "id"], "left")
    hit = F.col("_s").isNotNull()
    auto = F.coalesce(F.col("_s") == "auto_supersede", F.lit(False))
    return joined.withColumns({"resolved": hit | F.col("resolved"), "resolution_strategy": F.coalesce("_s", "resolution_strategy"), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")), "auto_resolved_at": F.when(auto, now).otherwise(F.col("auto_resolved_at"))}).select(*contradictions.columns)


def apply_status(df: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Sets a status on the rows whose (tenant_id, id) is listed."""
    flagged = ids.select("tenant_id", "id").distinct().withColumn("_hit", F.lit(True))
    return df.join(flagged, ["tenant_id", "id"], "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(*df.columns)
