"""The lifecycle of facts as prefix computations: no task holds a fact's events.

A key's rows are cut into spans of their sequence numbers. What a span adds to all later rows is small (a count, a largest
value, a map of states), so spans are reduced apart from each other, their results are scanned in order, and every row takes
what its span got from before. Shared withdrawals are numbered by running counts; a site's record is a map of eight states for
each span of its events, and maps compose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers of a span. A span of a key is one group; a key has one small row for each of its spans.
SPAN = 4096

#: States of a site's record: status and origin. Their places are what maps are made of.
STATES = ((None, None), ("monitor-only", "query"), ("monitor-only", "local"), ("monitor-only", "restore"), ("active", "commit"), ("revoked", "local"), ("disputed", "dispute"), ("revoked", "dispute"))


def running(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], span: int = SPAN, after: bool = False) -> DataFrame:
    """rows and, under each name, the largest value of the rows of the same keys before this one (after it, if asked), null if none.

    Values must be comparable; a struct that starts with `order` gives the last row that has one. Rows of equal order in a span
    do not see each other.
    """
    place = F.floor(F.col(order) / span)
    cut = rows.withColumn("_span", place).select("*", *(v.alias(f"_v_{n}") for n, v in values.items()))
    direction = F.desc if after else F.asc
    inside = Window.partitionBy(*keys, "_span").orderBy((-F.col(order)) if after else F.col(order)).rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(direction("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(*keys, "_span").agg(*(F.max(f"_v_{n}").alias(f"_s_{n}") for n in values))
    carried = spans.select(*keys, "_span", *(F.max(f"_s_{n}").over(across).alias(f"_c_{n}") for n in values))
    own = cut.select("*", *(F.max(f"_v_{n}").over(inside).alias(f"_o_{n}") for n in values))
    joined = own.join(carried, [*keys, "_span"])
    return joined.select(*rows.columns, *(F.greatest(f"_o_{n}", f"_c_{n}").alias(n) for n in values))


def running_count(rows: DataFrame, keys: list[str], order: str, name: str, counted: Column, span: int = SPAN) -> DataFrame:
    """rows and how many of the rows of the same keys before this one are counted."""
    cut = rows.withColumn("_span", F.floor(F.col(order) / span)).withColumn("_n", F.when(counted, 1).otherwise(0).cast("long"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(*keys, "_span").agg(F.sum("_n").alias("_all")).select(*keys, "_span", F.coalesce(F.sum("_all").over(across), F.lit(0)).alias("_before"))
    own = cut.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return own.join(spans, [*keys, "_span"]).select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def withdrawals(log: DataFrame) -> DataFrame:
    """log (fact, seq, op, site_id, ...) and `kind`: what the event does to the fact as a whole, null if nothing; `opened`: the
    episode's first dispute.

    1 is the first dispute of an episode, 2 the first one by another site, 0 the restore that ends an episode with disputes.
    Episodes lie between restores.
    """
    numbered = running_count(log, ["fact"], "seq", "episode", F.col("op") == "restore")
    disputes = numbered.where("op = 'dispute'").select("fact", "episode", "seq", "site_id")
    first = disputes.groupBy("fact", "episode").agg(F.min(F.struct("seq", "site_id")).alias("first"))
    other = disputes.join(first, ["fact", "episode"]).where("site_id <> first.site_id").groupBy("fact", "episode").agg(F.min("seq").alias("second"))
    open_ = first.join(other, ["fact", "episode"], "left").select("fact", "episode", F.col("first.seq").alias("opened"), "second")
    kind = F.when((F.col("op") == "restore") & F.col("opened").isNotNull(), 0).when(F.col("seq") == F.col("opened"), 1).when(F.col("seq") == F.col("second"), 2)
    return numbered.join(open_, ["fact", "episode"], "left").withColumn("kind", kind).drop("episode", "second")


def _between(x: str, e: str, since: str) -> str:
    """SQL of the record x (state s, last change q) just before the event e, when the record's event before was at `since`.

    e.mark is the fact's last withdrawal or restore before e, e.down its last withdrawal. Local vetoes stay what they are.
    """
    touched = f"y.s not in (0, 5) and {e}.mark.seq > {since} and (y.s in (6, 7) or {e}.down > {since})"
    to = f"case when not coalesce({e}.down > {since}, false) or {e}.mark.kind = 0 then 3 when {e}.mark.kind = 1 then 6 else 7 end"
    return f"transform(array({x}), y -> case when {touched} then struct({to} as s, {e}.mark.seq as q) else struct(y.s as s, y.q as q) end)[0]"


def _after(x: str, e: str) -> str:
    """SQL of the record x after the event e: queries and commits need an admissible fact and, like lifted vetoes, no open dispute."""
    to = f"""case when {e}.op = 'query' and {e}.ok and z.s = 0 then 1 when {e}.op = 'commit' and {e}.ok and z.s in (1, 2, 3) then 4
      when {e}.op = 'revoke' and z.s in (1, 2, 3, 4) then 5 when {e}.op = 'restore_local' and {e}.free and z.s = 5 then 2 end"""
    return f"transform(array({x}), z -> case when {to} is null then struct(z.s as s, z.q as q) else struct({to} as s, {e}.seq as q) end)[0]"


_IDENTITY = "transform(sequence(0, 7), i -> struct(i as s, cast(null as bigint) as q))"
# Maps of spans: `first` and `last` are its first and last event, `m` what became of each of the eight states. A change keeps its place.
_MAP = f"""aggregate(events, struct(cast(null as bigint) as since, {_IDENTITY} as m), (acc, e) ->
  struct(e.seq as since, transform(acc.m, x -> {_after(_between('x', 'e', 'acc.since'), 'e')}) as m))"""


def _marked(log: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Events of sites' own records with the fact's last mark before each, and each fact's last mark of all."""
    rows = withdrawals(log.where("fact is not null").select("fact", "seq", "op", "site_id", F.coalesce("admissible", F.lit(False)).alias("admissible")))
    mark = F.when(F.col("kind").isNotNull(), F.struct("seq", "kind"))
    down = F.when(F.col("kind") > 0, F.col("seq"))
    last = rows.groupBy("fact").agg(F.max(mark).alias("mark"), F.max(down).alias("down"))
    seen = running(rows, ["fact"], "seq", {"mark": mark, "down": down}, span).where("op in ('query', 'commit', 'revoke', 'restore_local')")
    free = F.coalesce(F.col("mark.kind") == 0, F.lit(True))
    return seen.select("fact", "site_id", "seq", "op", "mark", "down", free.alias("free"), (free & F.col("admissible")).alias("ok")), last


def _maps(events: DataFrame, span: int) -> DataFrame:
    """fact, site_id, span, events of the span in order, first event, since (last event), m."""
    item = F.struct("seq", "op", "ok", "free", "mark", "down")
    spans = events.groupBy("fact", "site_id", F.floor(F.col("seq") / span).alias("span")).agg(F.array_sort(F.collect_list(item)).alias("events"))
    return spans.withColumn("r", F.expr(_MAP)).select("fact", "site_id", "span", "events", F.expr("events[0]").alias("first"), "r.since", "r.m")


#: A record that goes through a span: what lies before its first event, then its map; the span's last change counts, else the earlier one.
_THROUGH = "transform(array({before}), w -> struct(e.m[w.s].s as s, coalesce(e.m[w.s].q, w.q) as q))[0]"


def _joined(maps: DataFrame, by: list[str]) -> DataFrame:
    """Maps of several spans as one: first, since and m of the spans of each group, in order."""
    items = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("span", "first", "since", "m"))).alias("items"))
    through = _THROUGH.format(before=_between("x", "e.first", "acc.since"))
    m = f"aggregate(items, struct(cast(null as bigint) as since, {_IDENTITY} as m), (acc, e) -> struct(e.since as since, transform(acc.m, x -> {through}) as m))"
    return items.withColumn("r", F.expr(m)).select(*by, F.expr("items[0].first").alias("first"), "r.since", "r.m")


def _named(state: str) -> list[Column]:
    at = F.col(f"{state}.s")
    status, origin = (F.element_at(F.array(*(F.lit(x[i]) for x in STATES)), at + 1) for i in (0, 1))
    return [status.alias("status"), origin.alias("origin"), F.col(f"{state}.q").alias("seq")]


def fold(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Final state of every (fact, site): fact, site_id, status, origin, seq of the last change.

    log: fact, seq, op, site_id, admissible; seq orders a fact's events without ties. A span's events become one map, the maps
    of `span` spans become one again, and a record is led through what is left, from no record to what the fact's last
    withdrawal or restore makes of it.
    """
    events, last = _marked(log, span)
    maps = _joined(_maps(events, span).withColumn("part", F.floor(F.col("span") / span)), ["fact", "site_id", "part"])
    whole = _joined(maps.withColumnRenamed("part", "span"), ["fact", "site_id"]).join(last, "fact")
    done = whole.withColumn("x", F.expr("m[0]")).withColumn("e", F.struct("mark", "down")).withColumn("x", F.expr(_between("x", "e", "since")))
    return done.where("x.s > 0").select("fact", "site_id", *_named("x"))


def trace(log: DataFrame, span: int = SPAN) -> DataFrame:
    """fact, site_id, seq, op, status, origin: a site's record after each of its own events, null without a record."""
    events, _ = _marked(log, span)
    maps = _maps(events, span)
    scanned = maps.groupBy("fact", "site_id").agg(F.array_sort(F.collect_list(F.struct("span", "first", "since", "m"))).alias("items"))
    through = _THROUGH.format(before=_between("acc[size(acc) - 1].x", "e.first", "acc[size(acc) - 1].since"))
    start = "array(struct(cast(null as bigint) as span, struct(0 as s, cast(null as bigint) as q) as x, cast(null as bigint) as since))"
    entered = scanned.withColumn("r", F.expr(f"aggregate(items, {start}, (acc, e) -> concat(acc, array(struct(e.span as span, {through} as x, e.since as since))))"))
    entered = entered.select("fact", "site_id", F.expr("explode(transform(sequence(1, size(r) - 1), i -> struct(r[i].span as span, r[i - 1].x as x, r[i - 1].since as since)))").alias("r")).select("fact", "site_id", "r.*")
    own = maps.select("fact", "site_id", "span", "events").join(entered, ["fact", "site_id", "span"])
    after = _after(_between("acc[size(acc) - 1].x", "e", "acc[size(acc) - 1].since"), "e")
    begin = "array(struct(cast(null as string) as op, x, since))"
    filled = own.withColumn("r", F.expr(f"aggregate(events, {begin}, (acc, e) -> concat(acc, array(struct(e.op as op, {after} as x, e.seq as since))))"))
    rows = filled.select("fact", "site_id", F.explode(F.expr("slice(r, 2, size(events))")).alias("r"))
    status, origin, _ = _named("r.x")
    return rows.select("fact", "site_id", F.col("r.since").alias("seq"), "r.op", status, origin)


def versions(log: DataFrame, span: int = SPAN) -> DataFrame:
    """fact, valid_from, valid_to (null while it holds), event, status, score, accepted: every version of a fact's score.

    log: fact, seq, op (score, dispute, restore), site_id, score, accepted. A fact exists from its first score. A first dispute
    disputes it, one by another site revokes it; scores meanwhile change the value, not the status; restore makes the last
    active version's value hold again. Versions are only ever added: an earlier one never changes but for its end.
    """
    first = log.where("op = 'score' and fact is not null").groupBy("fact").agg(F.min("seq").alias("born"))
    known = log.where("op in ('score', 'dispute', 'restore')").join(first, "fact").where("seq >= born").drop("born")
    rows = withdrawals(known.select("fact", "seq", "op", "site_id", "score", "accepted"))
    rows = running(rows, ["fact"], "seq", {"mark": F.when(F.col("kind").isNotNull(), F.struct("seq", "kind", "opened"))}, span)
    rows = rows.withColumn("now", F.when(F.col("kind").isNotNull(), F.struct("seq", "kind", "opened")).otherwise(F.col("mark"))).withColumn("level", F.coalesce(F.col("now.kind"), F.lit(0)))
    value = F.when(F.col("op") == "score", F.struct("seq", "score", "accepted"))
    rows = running(rows, ["fact"], "seq", {"active": F.when(F.col("level") == 0, value), "any": value}, span)
    rows = rows.where("op = 'score' or kind is not null")
    during = (F.col("level") > 0) & (F.col("any.seq") > F.col("now.opened"))
    held = F.when(F.col("op") == "score", F.struct("seq", "score", "accepted")).when(during, F.col("any")).otherwise(F.col("active"))
    event = F.when(F.col("op") == "score", "score").otherwise(F.element_at(F.array(F.lit("restore"), F.lit("dispute"), F.lit("revoke")), F.col("kind") + 1))
    status = F.element_at(F.array(F.lit("active"), F.lit("disputed"), F.lit("revoked")), F.col("level") + 1)
    made = rows.select("fact", F.col("seq").alias("valid_from"), event.alias("event"), status.alias("status"), held["score"].alias("score"), held["accepted"].alias("accepted"))
    return running(made.withColumn("_at", -F.col("valid_from")), ["fact"], "valid_from", {"valid_to": F.col("_at")}, span, after=True).withColumn("valid_to", -F.col("valid_to")).select("fact", "valid_from", "valid_to", "event", "status", "score", "accepted")


def as_of(held: DataFrame, probes: DataFrame, span: int = SPAN) -> DataFrame:
    """probes (fact, seq, ...) and the status, score and accepted of the version that holds then; null before the first one.

    Probes and versions are one sequence, so a fact with many of both is cut like any other.
    """
    version = held.select("fact", F.col("valid_from").alias("seq"), F.struct(F.col("valid_from").alias("seq"), "status", "score", "accepted").alias("_version"))
    own = [c for c in probes.columns if c not in ("fact", "seq")]
    both = version.select("fact", "seq", "_version", F.lit(None).cast(probes.select(F.struct(F.lit(1), *own)).schema[0].dataType).alias("_own")).unionByName(probes.select("fact", "seq", F.lit(None).cast(version.schema["_version"].dataType).alias("_version"), F.struct(F.lit(1), *own).alias("_own")))
    # A version holds from its own number on, so it sorts before a probe of that number.
    twice = both.withColumn("_order", F.col("seq") * 2 + F.col("_own").isNotNull().cast("int"))
    found = running(twice, ["fact"], "_order", {"_last": F.col("_version")}, 2 * span).where("_own is not null")
    return found.select("fact", "seq", *(F.col(f"_own.{c}").alias(c) for c in own), F.col("_last.status").alias("status"), F.col("_last.score").alias("score"), F.col("_last.accepted").alias("accepted"))
