"""Batches of reports on a memory graph: outcomes, resolved ambiguities, anomalies, mechanics; manifests, snapshots and card targets.

A batch is a table of calls; where calls meet in one row, the latest (largest
`at`, then the other columns) counts last, as if they had come one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges that follow a concept when it is merged into another (fixed values).
REDIRECTED = ("REQUIRES", "ENABLES", "REPLACES", "CONTRADICTS", "PART_OF", "CHOSEN_OVER", "IMPLEMENTS", "EXTENDS", "ALTERNATIVE_TO", "CO_OCCURS_WITH")


def _reports(reports: DataFrame) -> DataFrame:
    """Reports that name a plan, an outcome and a number, with that number within -1 and 1."""
    told = reports.where("plan IS NOT NULL AND trim(outcome) <> '' AND valence IS NOT NULL AND NOT isnan(valence)")
    return told.withColumn("valence", F.greatest(F.least("valence", F.lit(1.0)), F.lit(-1.0)))


def step_outcomes(reports: DataFrame, acts_on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, step, outcome, valence, status) by the last report of each step, and signals (plan, step, concept, valence).

    reports: plan, step (null: of the whole plan), outcome, valence, at;
    acts_on: plan, step, concept. A step has failed below 0. Signals come from
    negative reports only, and a later good report leaves them, with the last
    negative valence. Reports without plan, outcome or number are no reports.
    """
    told = _reports(reports).where("step IS NOT NULL")
    latest = F.struct("at", "valence", "outcome")
    last = told.groupBy("plan", "step").agg(F.max(latest).alias("r")).select("plan", "step", "r.outcome", "r.valence")
    bad = told.where("valence < 0").groupBy("plan", "step").agg(F.max(latest).alias("r")).select("plan", "step", F.col("r.valence").alias("valence"))
    signals = bad.join(acts_on.select("plan", "step", "concept").distinct(), ["plan", "step"])
    return last.withColumn("status", F.when(F.col("valence") >= 0, "succeeded").otherwise("failed")), signals


def plan_outcomes(reports: DataFrame) -> DataFrame:
    """plan, outcome, valence, source, status of plans with a report of the whole: the last one; source is explicit unless given."""
    told = _reports(reports).where("step IS NULL").withColumn("source", F.coalesce(F.when(F.trim("source") != "", F.trim("source")), F.lit("explicit")))
    last = told.groupBy("plan").agg(F.max(F.struct("at", "valence", "outcome", "source")).alias("r"))
    return last.select("plan", "r.outcome", "r.valence", "r.source", F.lit("completed").alias("status"))


def procedure_stats(procedures: DataFrame, reports: DataFrame) -> DataFrame:
    """id, applied, succeeded, rate after the reports of whole plans that name a procedure (and perhaps say whether it succeeded: worked)."""
    told = _reports(reports).where("step IS NULL AND procedure IS NOT NULL")
    worked = F.coalesce(F.col("worked"), F.col("valence") >= 0)
    new = told.groupBy(F.col("procedure").alias("id")).agg(F.count("*").alias("more"), F.count_if(worked).alias("good"))
    applied, succeeded = F.coalesce("applied", F.lit(0)) + F.col("more"), F.coalesce("succeeded", F.lit(0)) + F.col("good")
    return procedures.join(new, "id").select("id", applied.alias("applied"), succeeded.alias("succeeded"), (succeeded / applied).alias("rate"))


def _pending(events: DataFrame, concepts: DataFrame) -> DataFrame:
    """Pending events between two known concepts, with the older (a where equal or unknown) as canonical."""
    c = concepts.select("id", "created_at", "text")
    a = c.select(F.col("id").alias("a"), F.col("created_at").alias("a_at"), F.col("text").alias("a_text"))
    b = c.select(F.col("id").alias("b"), F.col("created_at").alias("b_at"), F.col("text").alias("b_text"))
    both = events.where("status = 'pending' AND resolution IN ('merge', 'separate', 'skip')").join(a, "a").join(b, "b")
    first = F.coalesce(F.col("a_at") <= F.col("b_at"), F.lit(True))
    return both.select(
        "event", "resolution", "a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("duplicate"), F.when(first, F.col("b_text")).otherwise(F.col("a_text")).alias("label"),
    )


def resolved_concepts(events: DataFrame, concepts: DataFrame) -> DataFrame:
    """id, strength, archived, sure, labels of the concepts that a batch of resolutions changes.

    events: event, a, b, status, resolution. A merge archives the newer
    concept, gives the older 0.15 of strength and the newer's text as a label;
    a separation makes both sure. Skipped, unknown and settled events, and
    those of unknown concepts, change nothing.
    """
    p = _pending(events, concepts)
    merged, apart = p.where("resolution = 'merge'"), p.where("resolution = 'separate'")
    none, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    changes = (
        merged.select(F.col("canonical").alias("id"), F.lit(1).alias("gain"), no.alias("gone"), yes.alias("sure"), "label")
        .union(merged.select("duplicate", F.lit(0), yes, no, none))
        .union(apart.select("a", F.lit(0), no, yes, none))
        .union(apart.select("b", F.lit(0), no, yes, none))
    )
    agg = changes.groupBy("id").agg(F.sum("gain").alias("gain"), F.bool_or("gone").alias("gone"), F.bool_or("sure").alias("sure"), F.sort_array(F.collect_set("label")).alias("labels"))
    return concepts.select("id", "strength", "archived").join(agg, "id").select("id", (F.col("strength") + 0.15 * F.col("gain")).alias("strength"), (F.col("archived") | F.col("gone")).alias("archived"), "sure", "labels")


def resolved_edges(events: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges src, dst, rel_type of a batch of resolutions: the duplicate's outgoing ones of `REDIRECTED`, and DISTINCT_FROM.

    Every event sees the edges from before the batch. An edge that exists, or
    would lead to its own source, is not made again.
    """
    p = _pending(events, concepts)
    moved = edges.where(F.col("rel_type").isin(*REDIRECTED)).join(p.where("resolution = 'merge'").select(F.col("duplicate").alias("src"), "canonical"), "src")
    moved = moved.where("dst <> canonical").select(F.col("canonical").alias("src"), "dst", "rel_type").distinct()
    moved = moved.join(edges.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti")
    return moved.unionByName(p.where("resolution = 'separate'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("DISTINCT_FROM").alias("rel_type")))


def flag_anomalies(flags: DataFrame, nodes: DataFrame, constraints: DataFrame) -> DataFrame:
    """node, type, text, anomaly, confidence, constraint, constraint_text: one row a pair of node and constraint, by its last flag.

    flags: node, constraint, anomaly, confidence, at. Flags of unknown nodes
    or constraints make no edge.
    """
    last = flags.groupBy("node", "constraint").agg(F.max(F.struct("at", "anomaly", "confidence")).alias("r")).select("node", "constraint", "r.anomaly", "r.confidence")
    n = nodes.select(F.col("id").alias("node"), "type", "text")
    c = constraints.select(F.col("id").alias("constraint"), F.col("text").alias("constraint_text"))
    return last.join(n, "node").join(c, "constraint").select("node", "type", "text", "anomaly", F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), "constraint", "constraint_text")


def mechanic_id(action_set: Column, name: Column, task: Column) -> Column:
    """The given fields' stable id."""
    text = F.concat_ws(":", F.coalesce(action_set, F.lit("unknown")), F.coalesce(name, F.lit("")), F.coalesce(task, F.lit("")))
    return F.concat(F.lit("mech-"), F.substring(F.sha2(text, 256), 1, 24))


def publish_mechanics(stored: DataFrame, summaries: DataFrame) -> DataFrame:
    """mechanic, confidence, evidence, tasks after a batch of summaries (mechanic, task, confidence, at), one row a published mechanic.

    Each summary is one more piece of evidence; the last confidence (0.5 where
    it is null) counts. Tasks are the stored ones (an array), then new ones in
    the order of their first summary, each once, without empty names.
    """
    s = summaries.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    last = s.groupBy("mechanic").agg(F.count("*").alias("more"), F.max(F.struct("at", "confidence"))["confidence"].alias("confidence"))
    firsts = s.where("task <> ''").groupBy("mechanic", "task").agg(F.min("at").alias("at"))
    names = firsts.groupBy("mechanic").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "task"))), lambda x: x["task"]).alias("new"))
    empty = F.array().cast("array<string>")
    old = stored.select("mechanic", "evidence", "tasks")
    j = last.join(names, "mechanic", "left").join(old, "mechanic", "left")
    tasks = F.array_distinct(F.concat(F.coalesce("tasks", empty), F.coalesce("new", empty)))
    return j.select("mechanic", "confidence", (F.coalesce("evidence", F.lit(0)) + F.col("more")).alias("evidence"), tasks.alias("tasks"))


def recall_mechanics(mechanics: DataFrame, patterns: DataFrame, least: float, limit: int) -> DataFrame:
    """The `limit` surest mechanics (the later updated, then the smaller id, first) of `least` confidence, with rank and their sorted patterns."""
    top = mechanics.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), F.desc("updated_at"), "mechanic").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("confidence"), F.desc("updated_at"), "mechanic"))  # of at most `limit` rows
    near = patterns.join(top.select("mechanic"), "mechanic", "left_semi").groupBy("mechanic").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))
    return top.withColumn("rank", rank).join(near, "mechanic", "left").select("rank", "mechanic", "confidence", F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))


def snippet(text: Column, most: int) -> Column:
    """Longer texts end at the last full stop of the first `most` characters if it lies past their middle, else in three dots."""
    cut = F.substring(text, 1, most)
    stop = F.length(cut) - F.locate(".", F.reverse(cut)) + 1
    at = F.when(F.contains(cut, F.lit(".")) & (stop - 1 > most // 2), F.substring(cut, F.lit(1), stop)).otherwise(F.concat(F.rtrim(cut), F.lit("...")))
    return F.when(F.length(text) <= most, text).otherwise(at)


def trigger_manifest(procedures: DataFrame, lessons: DataFrame, most: int = 2000) -> DataFrame:
    """id, source_type, name, pattern, strength, snippet of live procedures (id, name, description, steps) and lessons (id, kind, text) that have a trigger pattern.

    A procedure's snippet is its name, description and first three steps. The
    order of a manifest is procedures before lessons, each by falling strength;
    it is left to the sink, so nothing is sorted here.
    """
    live = "NOT archived AND pattern <> ''"
    steps = F.transform(F.slice(F.coalesce("steps", F.array().cast("array<string>")), 1, 3), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    head = F.filter(F.array("name", "description"), lambda x: x != "")
    whole = F.array_join(F.concat(head, steps), "\n")
    p = procedures.where(live).select("id", F.lit("procedure").alias("source_type"), "name", "pattern", "strength", snippet(whole, most).alias("snippet"))
    name = F.when(F.col("kind") != "", F.concat(F.lit("Lesson ("), "kind", F.lit(")"))).otherwise("Lesson")
    return p.union(lessons.where(live).select("id", F.lit("lesson"), name, "pattern", "strength", snippet(F.coalesce("text", F.lit("")), most)))


def snapshots(plans: DataFrame, decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """session, snapshot: the active goal, the latest 5 live decisions and the latest 10 files of each session of `plans`.

    plans: session, goal (one row a session); decisions: session, id, text,
    archived, at; artifacts: session, path, title, at. Goals and decisions are
    cut to 120 characters; empty decisions and paths take a place but no line.
    """

    def latest(rows: DataFrame, most: int, tie: str, line: Column, title: str, name: str) -> DataFrame:
        w = Window.partitionBy("session").orderBy(F.desc("at"), tie)
        top = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
        lines = F.transform(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("rn", line.alias("line"))))), lambda x: x["line"])
        return top.groupBy("session").agg(F.array_join(F.concat(F.array(F.lit(title)), lines), "\n").alias(name))

    said = F.when(F.col("text") != "", F.concat(F.lit("- "), F.substring("text", 1, 120)))
    file = F.when(F.col("path") != "", F.concat(F.lit("- "), "path", F.when(F.col("title") != "", F.concat(F.lit(" — "), "title")).otherwise("")))
    d = latest(decisions.where("NOT archived"), 5, "id", said, "**Recent decisions:**", "decided")
    a = latest(artifacts, 10, "path", file, "**Files in flight:**", "files")
    goal = F.coalesce("goal", F.lit(""))
    number = F.regexp_extract(goal, r"\bB\d+\b", 0)
    card = F.when(number != "", number).when(goal != "", F.substring(goal, 1, 30)).otherwise("No active card")
    head = F.concat(F.lit("**Active card:** "), card, F.when(goal != "", F.concat(F.lit("\n**Goal:** "), F.substring(goal, 1, 120))).otherwise(""))
    return plans.join(d, "session", "left").join(a, "session", "left").select("session", F.concat_ws("\n", head, "decided", "files").alias("snapshot"))


def card_target(cards: DataFrame, branches: DataFrame, target: str) -> DataFrame:
    """The one row (type, id, how) that a target names: a card of that text, else one that contains it, else a branch of that name.

    cards: type, rank (the order of the types), id, text; branches: id, name.
    Of equally good ones the smallest id; no row if there is none.
    """
    exact, within = F.col("text") == target, F.contains("text", F.lit(target))
    c = cards.where(within).select(F.when(exact, 0).otherwise(1).alias("tier"), "rank", "type", "id", F.when(exact, "exact").otherwise("lexical").alias("how"))
    b = branches.where(F.col("name") == target).select(F.lit(2), F.lit(0), F.lit("Workspace"), "id", F.lit("branch"))
    return c.union(b).orderBy("tier", "rank", "id").limit(1).select("type", "id", "how")


def meta_lessons(clusters: DataFrame, lessons: DataFrame, boost: float = 1.3) -> tuple[DataFrame, DataFrame]:
    """(cluster, size, strength, confidence) of one general lesson a cluster, and (id, strength) of its lessons, which fade by `boost`.

    clusters: id, cluster; lessons: id, strength, confidence, null being 0.
    Strength is 1.2 of the largest, at most 1; confidence the mean and 0.05,
    at most 0.99. The general lesson's text is a model's or the caller's.
    """
    s, c = F.coalesce("strength", F.lit(0.0)), F.coalesce("confidence", F.lit(0.0))
    both = clusters.select("id", "cluster").join(lessons.select("id", s.alias("strength"), c.alias("confidence")), "id")
    made = both.groupBy("cluster").agg(F.count("*").alias("size"), F.least(F.lit(1.0), F.max("strength") * 1.2).alias("strength"), F.least(F.lit(0.99), F.avg("confidence") + 0.05).alias("confidence"))
    return made, both.select("id", (F.col("strength") / boost).alias("strength"))


def avoidance(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """cluster, name, salience, confidence, strength, warnings: one procedure of avoidance a cluster of salient nodes.

    clusters: id, cluster, rn (place in it, the leader first); nodes: id,
    text, salience. Named after the leader (60 characters); the first five
    texts, cut to 100 characters, are the warnings; empty ones take a place.
    """
    text = F.coalesce("text", F.lit(""))
    both = clusters.join(nodes.select("id", text.alias("text"), "salience"), "id")
    warn = F.when((F.col("rn") <= 5) & (F.col("text") != ""), F.struct("rn", F.concat(F.lit("Avoid: "), F.substring("text", 1, 100)).alias("action")))
    agg = both.groupBy("cluster").agg(F.min_by("text", "rn").alias("topic"), F.avg("salience").alias("salience"), F.transform(F.sort_array(F.collect_list(warn)), lambda x: x["action"]).alias("warnings"))
    return agg.select("cluster", F.concat(F.lit("Avoid: "), F.substring("topic", 1, 60)).alias("name"), "salience", F.least(F.col("salience") / 1.6, F.lit(1.0)).alias("confidence"), F.least(F.col("salience") * 0.6, F.lit(1.0)).alias("strength"), "warnings")
