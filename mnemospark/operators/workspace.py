"""Concepts, provenance and views of a workspace: upserts, merges and their undoing, projections, lists and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import first_of_equals


def store_concepts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """key, action, strength, salience, confidence_low after each incoming concept met the live one of the same text, whatever its case.

    Matched: the larger strength and salience, sure once a confidence is 0.8.
    New: strength max(confidence * salience, 0.5). Several arrivals of one text
    are one. Both: text, strength or confidence, salience, confidence_low.
    """
    old = stored.groupBy(F.lower("text").alias("key")).agg(F.max("strength").alias("old_strength"), F.max("salience").alias("old_salience"), F.bool_and("confidence_low").alias("old_low"))
    new = incoming.groupBy(F.lower("text").alias("key")).agg(F.max(F.col("confidence") * F.col("salience")).alias("made"), F.max("salience").alias("new_salience"), F.max("confidence").alias("confidence"))
    j = new.join(old, "key", "left")
    met = F.col("old_strength").isNotNull()
    strength = F.when(met, F.greatest("made", "old_strength")).otherwise(F.greatest("made", F.lit(0.5)))
    low = F.when(met, F.col("old_low") & (F.col("confidence") < 0.8)).otherwise(F.col("confidence") < 0.8)
    return j.select("key", F.when(met, "reinforced").otherwise("created").alias("action"), F.round(strength, 6).alias("strength"), F.round(F.greatest("new_salience", F.coalesce("old_salience", "new_salience")), 6).alias("salience"), low.alias("confidence_low"))


def contradictions(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Merge events old_id, new_id, pre_strength of pairs (old_id, new_id, at): the first that archives a live old concept counts."""
    w = Window.partitionBy("old_id").orderBy("at", "new_id")
    first = pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    live = concepts.where("NOT archived").select(F.col("id").alias("old_id"), F.col("strength").alias("pre_strength"))
    return first.join(live, "old_id").select("old_id", "new_id", "at", "pre_strength")


def apply_merges(concepts: DataFrame, events: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """id, strength, archived, deprecated_by after merge events, and after some of them (old_id) were rolled back.

    A merge archives the old concept; its rollback restores it with the
    strength it had and archives the new one.
    """
    back = events.join(rolled_back.select("old_id").distinct(), "old_id", "left_semi")
    kept = events.join(rolled_back.select("old_id").distinct(), "old_id", "left_anti")
    gone = kept.select(F.col("old_id").alias("id"), F.col("new_id").alias("deprecated_by"))
    restored = back.select(F.col("old_id").alias("id"), "pre_strength")
    undone = back.select(F.col("new_id").alias("id")).distinct().withColumn("undone", F.lit(True))
    j = concepts.join(gone, "id", "left").join(restored, "id", "left").join(undone, "id", "left")
    archived = F.when(F.col("pre_strength").isNotNull(), False).otherwise(F.col("archived") | F.col("deprecated_by").isNotNull() | F.coalesce("undone", F.lit(False)))
    return j.select("id", F.coalesce("pre_strength", "strength").alias("strength"), archived.alias("archived"), "deprecated_by")


def reviewed(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, confidence, confidence_low, archived: confirmed nodes are sure (0.95), rejected ones archived. verdicts: id, confirmed."""
    j = nodes.join(verdicts, "id", "left")
    yes, no = F.coalesce("confirmed", F.lit(False)), F.coalesce(~F.col("confirmed"), F.lit(False))
    return j.select("id", F.when(yes, 0.95).otherwise(F.col("confidence")).alias("confidence"), (F.col("confidence_low") & ~yes).alias("confidence_low"), (F.col("archived") | no).alias("archived"))


def authority(kind: Column) -> Column:
    """The authority of a row; what is null or unknown is earned."""
    return F.when(kind.isin("earned", "projected"), kind).otherwise("earned")


def stale_projections(rows: DataFrame, source: str, version: str) -> DataFrame:
    """Projected rows of a source at another version than the current one; rows without a version are left out."""
    return rows.where((authority(F.col("authority")) == "projected") & (F.col("source") == source) & (F.col("source_version") != version))


def drop_projections(rows: DataFrame, by: str) -> DataFrame:
    """Dry run per source: deleted (its projections) and skipped_earned (its other rows)."""
    projected = authority(F.col("authority")) == "projected"
    return rows.groupBy(by).agg(F.count_if(projected).alias("deleted"), F.count_if(~projected).alias("skipped_earned"))


def strongest_by_text(nodes: DataFrame) -> DataFrame:
    """text, id: the strongest live node of each text, case left aside; ties by the least id."""
    w = Window.partitionBy(F.lower("text")).orderBy(F.desc("strength"), "id")
    return nodes.where("NOT archived").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.lower("text").alias("text"), "id")


def store_relations(relations: DataFrame, nodes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """src, dst, rel_type, n of relations between texts (a, b, rel_type), merged: only allowed types, and ends that a live node has."""
    ends = strongest_by_text(nodes)
    j = relations.where(F.col("rel_type").isin(*allowed)).withColumns({"la": F.lower("a"), "lb": F.lower("b")})
    j = j.join(ends.select(F.col("text").alias("la"), F.col("id").alias("src")), "la").join(ends.select(F.col("text").alias("lb"), F.col("id").alias("dst")), "lb")
    return j.where("src <> dst").groupBy("src", "dst", "rel_type").agg(F.count("*").alias("n"))


def workers(work: DataFrame) -> DataFrame:
    """worker, first_seen, last_seen, solved (distinct nodes) of what agents did; other sources are no workers. work: source, node, at."""
    own = work.where(F.col("source").startswith("agent:")).withColumn("worker", F.substring_index("source", ":", -1))
    return own.groupBy("worker").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count_distinct("node").alias("solved"))


def outcome_lessons(plans: DataFrame, above: float = 0.7) -> DataFrame:
    """Lessons of plans that went clearly well or badly: plan, kind, strength. plans: plan, valence, outcome."""
    strong = plans.where(F.abs("valence") > above)
    return strong.select("plan", F.when(F.col("valence") > 0, "success").otherwise("failure").alias("kind"), F.abs("valence").alias("strength"))


def upsert_lessons(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """key, action, strength: a given id updates its lesson (+ 0.1), a known dedupe key changes nothing, the rest is new (0.5).

    stored: id, key, strength. incoming: id (null: none given), key; arrivals with one key are one.
    """
    named = incoming.where("id IS NOT NULL").select("id").distinct().join(stored, "id").select("key", F.lit("updated").alias("action"), F.round(F.least(F.lit(1.0), F.col("strength") + 0.1), 6).alias("strength"))
    other = incoming.where("id IS NULL").select("key").distinct().join(stored.select("key", F.col("strength").alias("old")), "key", "left")
    return named.unionByName(other.select("key", F.when(F.col("old").isNull(), "created").otherwise("unchanged").alias("action"), F.round(F.coalesce("old", F.lit(0.5)), 6).alias("strength")))


def per_label_top(nodes: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """A view of the graph: the strongest live nodes of each label, as many as its quota. nodes: id, label, strength, archived."""
    w = Window.partitionBy("label").orderBy(F.desc("strength"), "id")
    quota = F.coalesce(*[F.when(F.col("label") == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
    return nodes.where("NOT archived").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota).select("label", "id", "rank")


def neighbours(edges: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """node, other, rel_type, rank: the first `most` undirected neighbours of each wanted node. edges: src, dst, rel_type."""
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel_type")
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type").unionByName(back).distinct()
    w = Window.partitionBy("node").orderBy("other", "rel_type")
    return both.join(wanted, "node", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hop(edges: DataFrame, frontier: DataFrame, most: int = 25) -> DataFrame:
    """One hop of a card's dependencies: from each node of the frontier, either way, at most `most` edges of each type. Returns node, other, rel_type, direction."""
    out = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type", F.lit("out").alias("direction"))
    into = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel_type", F.lit("in").alias("direction"))
    w = Window.partitionBy("node", "rel_type", "direction").orderBy("other")
    return out.unionByName(into).distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def continuity(sessions: DataFrame, since: Column, most: int = 5) -> DataFrame:
    """app, session_id, rank: an app's newest sessions after `since`. sessions: app, session_id, started_at."""
    w = Window.partitionBy("app").orderBy(F.desc("started_at"), "session_id")
    return sessions.where(F.col("started_at") >= since).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("app", "session_id", "started_at", "rank")


def relative_time(at: Column, now: Column) -> Column:
    """today, 1 day ago, n days ago by whole days; earlier where nothing is known."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000)
    return F.when(at.isNull(), "earlier").when(days <= 0, "today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def disambiguation(events: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Pending pairs (a, b, at) newest first, with the neighbours (src, dst) they share: a, b, shared."""
    page = events.orderBy(F.desc("at"), "a", "b").limit(most)
    x = page.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("na")).distinct(), "a").join(edges.select(F.col("src").alias("b"), F.col("dst").alias("nb")).distinct(), ["b"])
    shared = x.where("na = nb").groupBy("a", "b").agg(F.sort_array(F.collect_set("na")).alias("shared"))
    return page.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce(F.array_join("shared", ","), F.lit("")).alias("shared"))


def chain_end(edges: DataFrame) -> DataFrame:
    """id, last, hops: where each node's chain of SUPERSEDED_BY edges (src, dst; one a src) ends, by pointer doubling.

    A node on a cycle, or whose chain leads into one, has no end: both are
    null. n edges make no chain of more than n steps, so what still moves
    after log2(n) + 1 doublings is in a cycle.
    """
    from mnemospark.storage import cut

    at = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("last"), F.lit(1).cast("long").alias("hops")), "chain")
    moves = at.withColumn("moves", F.lit(False))
    for _ in range(at.count().bit_length() + 1):
        further = at.select(F.col("id").alias("last"), F.col("last").alias("next"), F.col("hops").alias("more"))
        on = at.select("id", "last", "hops").join(further, "last", "left")
        moves = cut(on.select("id", F.coalesce("next", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moves")), "chain")
        at = moves.drop("moves")
        if moves.where("moves").isEmpty():
            return at
    ends = lambda c: F.when(~F.col("moves"), F.col(c)).alias(c)
    return moves.select("id", ends("last"), ends("hops"))


def plan_steps(text: Column) -> Column:
    """The ordered steps of a text: numbered lines and lines that begin with first, then, next or finally (or bullets that do); repeats and crumbs go."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    number, word, bullet = r"(?i)^(?:step\s+)?\d+[.):]\s+(.+)$", r"(?i)^(?:first|then|next|finally)\b[:\-]?\s*(.+)$", r"^[\-\x{2022}]\s+(.+)$"
    found = F.transform(
        lines,
        lambda x: F.when(x.rlike(number), F.trim(F.regexp_extract(x, number, 1))).when(x.rlike(word), F.trim(F.regexp_extract(x, word, 1))).when(F.regexp_extract(x, bullet, 1).rlike(word), F.trim(F.regexp_extract(x, bullet, 1))),
    )
    long = F.filter(found, lambda x: x.isNotNull() & (F.length(x) >= 3))
    return first_of_equals(long)


def sentence_of(text: Column, entity: Column) -> Column:
    """The sentence (between full stops) around the first place of entity, case left aside; the whole text where it is not found."""
    at = F.instr(F.lower(text), F.lower(entity))
    before, rest = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    stop = F.instr(rest, F.lit("."))
    begin = F.length(before) - F.when(F.instr(before, F.lit(".")) > 0, F.length(F.substring_index(before, ".", -1))).otherwise(F.length(before))
    found = F.trim(F.concat(F.substring(before, begin + 1, F.length(before)), F.when(stop > 0, F.substring(rest, F.lit(1), stop)).otherwise(rest)))
    return F.when((at == 0) | (found == ""), text).otherwise(found)


def redacted(key: Column, value: Column) -> Column:
    """A value for logs: credentials as the head of a hash, bulky fields as their length, the rest cut to 300 characters."""
    low = F.lower(key)
    secret = low.rlike("api_key|secret|password|token|authorization|cookie")
    bulky = low.rlike("content|text|embedding|body|html") & (F.length(value) > 100)
    hashed = F.when(value == "", value).otherwise(F.concat(F.substring(F.sha2(value, 256), 1, 8), F.lit(":[redacted]")))
    return F.when(secret, hashed).when(bulky, F.concat(F.lit("["), F.length(value).cast("string"), F.lit(" chars]"))).otherwise(F.substring(value, 1, 300))


def signal_floor(text: Column) -> Column:
    """False for a lone token of under six characters, which says nothing on its own."""
    bare = F.trim(text)
    return F.coalesce((text == "") | bare.contains(" ") | (F.length(bare) >= 6), F.lit(True))
