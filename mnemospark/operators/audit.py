"""Audits and repairs of a memory graph: stale and orphaned lessons, polarities judged anew, plans seen in hindsight, reified concepts, types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import valence
from mnemospark.operators.scan import scan
from mnemospark.storage import cut

# The type of each class of entity, with its properties.
ROUTES = {
    "Restriction": ("Demand", ["eligibleCustomerType", "availability", "validFrom", "validThrough", "businessFunction", "description"]),
    "PlannedEvent": ("Action", ["agent", "object", "target", "actionStatus", "startTime", "endTime", "result", "instrument"]),
    "PhysicalThing": ("Product", ["name", "identifier", "description", "version", "inLanguage", "isAccessoryOrSparePartFor"]),
    "Magnitude": ("QuantitativeValue", ["value", "unitCode", "unitText", "minValue", "maxValue", "valueReference"]),
    "Category": ("DefinedTerm", ["name", "description", "termCode", "inDefinedTermSet", "sameAs"]),
    "Agent:PERSON": ("Person", ["name", "jobTitle", "description", "email", "knowsAbout"]),
    "Agent:ORG": ("Organization", ["name", "description", "member", "parentOrganization", "contactPoint"]),
    "Event": ("Event", ["name", "startDate", "endDate", "eventStatus", "location", "organizer", "description"]),
    "": ("Thing", ["name", "description"]),
}


def schema_type(gist: Column, label: Column) -> Column:
    """struct(schema_type, properties): agents by their label, classes without a route are things; so are agents without a known label."""
    key = F.when(gist == "Agent", F.concat(F.lit("Agent:"), F.coalesce(label, F.lit("")))).otherwise(F.coalesce(gist, F.lit("")))
    made = {k: F.struct(F.lit(t).alias("schema_type"), F.array(*map(F.lit, p)).alias("properties")) for k, (t, p) in ROUTES.items()}
    return reduce(lambda rest, k: F.when(key == k, made[k]).otherwise(rest), [k for k in made if k], made[""])


def flags(lessons: DataFrame, edges: DataFrame, before: Column) -> DataFrame:
    """id, stale, orphan of live lessons that are either: old and with no outgoing use, or with no source. lessons: id, archived, kind, created_at; edges: src, dst, rel_type."""
    out = edges.where(F.col("rel_type").isin("APPLIES_TO", "RELATED_TO", "GENERALIZES_LESSON")).select(F.col("src").alias("id"), F.lit(True).alias("used")).distinct()
    into = edges.where(F.col("rel_type").isin("CONTAINS_LESSON", "PRODUCED_LESSON", "PRODUCED_PLAN_LESSON", "LEARNED")).select(F.col("dst").alias("id"), F.lit(True).alias("founded")).distinct()
    marked = lessons.where("NOT archived").join(out, "id", "left").join(into, "id", "left")
    stale = F.col("used").isNull() & F.coalesce((F.col("kind") != "synthesis") & (F.col("created_at") < before), F.lit(False))
    return marked.select("id", stale.alias("stale"), F.col("founded").isNull().alias("orphan")).where("stale OR orphan")


def polarity_repairs(lessons: DataFrame) -> DataFrame:
    """id, action, old, new_text, new_valence of outcome lessons whose stated polarity their text does not bear out. lessons: id, text, archived.

    A text that speaks for neither side is archived, one that speaks for the
    other is relabelled; lessons with a trigger or relabel mark were seen to already.
    """
    pattern = r"(?s)^Plan outcome \((success|failure)\):\s*(.*)$"
    c = lessons.where("NOT coalesce(archived, false)").where(F.col("text").startswith("Plan outcome (") & ~F.col("text").contains("[valence_trigger:") & ~F.col("text").contains("[valence_relabel:") & F.col("text").rlike(pattern))
    v = c.select("id", "text", F.regexp_extract("text", pattern, 1).alias("old"), valence(F.regexp_extract("text", pattern, 2)).alias("new_valence"))
    new = F.when(F.col("new_valence") > 0, "success").when(F.col("new_valence") < 0, "failure")
    found = v.withColumn("new", new).where("new IS NULL OR new <> old")
    swapped = F.concat(F.lit("Plan outcome ("), "new", F.lit("):"), F.substring(F.col("text"), F.lit(len("Plan outcome ():") + 8), F.length("text")), F.lit("\n[valence_relabel: was "), "old", F.lit("]"))
    return found.select("id", F.when(F.col("new").isNull(), "archive").otherwise("flip").alias("action"), "old", swapped.alias("new_text"), "new_valence")


def plan_repairs(plans: DataFrame, steps: DataFrame) -> DataFrame:
    """id, valence, new_valence of plans whose goal and outcomes, in order, speak for the other sign. plans: id, goal, valence, source, archived; steps: id, number, outcome."""
    p = plans.where("valence IS NOT NULL AND NOT coalesce(archived, false) AND (source IS NULL OR source = 'system')")
    said = steps.where("outcome <> ''").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", "outcome"))).alias("o"))
    body = F.concat_ws("\n", F.coalesce("goal", F.lit("")), F.col("o.outcome"))
    judged = p.join(said, "id", "left").select("id", "valence", valence(body).alias("new_valence"))
    return judged.where(F.signum("new_valence") != F.signum("valence"))


def retrospective(items: DataFrame, plans: DataFrame, least: int = 3, first: int = 5, same: float = 0.90) -> DataFrame:
    """session, goal, steps: a plan from the first items of a session that has `least` or more, unless one of its domain is much like it.

    items: session, domain, at, text, v (of the text); plans: domain, v. Near
    plans are looked for within the domain, and only goals are on one side.
    """
    told = items.where("session IS NOT NULL AND trim(text) <> ''")
    n = F.row_number().over(Window.partitionBy("session").orderBy("at"))
    step = F.struct("n", F.trim("text").alias("text"))
    lead = lambda c: F.max_by(c, F.when(F.col("n") == 1, 1))
    heads = told.withColumn("n", n).where(F.col("n") <= max(first, least)).groupBy("session").agg(F.max("n").alias("found"), F.array_sort(F.collect_list(step)).alias("all"), lead("domain").alias("domain"), lead("v").alias("v"))
    goals = cut(heads.where(F.col("found") >= least).select("session", "domain", "v", F.slice("all.text", 1, first).alias("steps")), "goals")
    # Vectors meet in blocks, each pair of blocks of a domain in a task of its own; of the plans much like a goal a block hands on one.
    asked = goals.select(F.col("session").alias("query_id"), "domain", F.col("v").alias("q"))
    met = plans.select(F.monotonically_increasing_id().alias("node_id"), "domain", "v")
    known = scan(met, asked, above=same, k=1, within="domain").select(F.col("query_id").alias("session"))
    return goals.join(known, "session", "left_anti").select("session", F.substring(F.col("steps")[0], 1, 240).alias("goal"), "steps")


def temporal_context(nodes: DataFrame, edges: DataFrame, rels: tuple[str, ...] = ("NEXT_MESSAGE", "CAUSED_BY", "ESTABLISHED_IN"), window: int = 3, chars: int = 200) -> DataFrame:
    """id, context: the texts of the first `window` neighbours over temporal edges, either way, by neighbour. nodes: id, text; edges: src, dst, rel_type.

    Only the neighbours that stay are joined with their texts.
    """
    e = edges.where(F.col("rel_type").isin(*rels)).select("src", "dst")
    near = e.union(e.select("dst", "src")).toDF("id", "near").distinct()
    told = near.join(nodes.where("text <> ''").select(F.col("id").alias("near")), "near", "left_semi")
    first = told.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("near"))).where(F.col("n") <= window)
    texts = first.join(nodes.select(F.col("id").alias("near"), F.substring("text", 1, chars).alias("text")), "near")
    return texts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t")).select("id", F.col("t.text").alias("context"))


def dictionary(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """key, name, labels, is_new: entries (name, labels) folded into concepts (key, name, labels); names and labels meet case-folded, labels are united."""
    key = F.lower(F.trim("name"))
    named = entries.where("trim(name) <> ''")
    labels = named.select(key.alias("key"), F.explode("labels").alias("label")).union(concepts.select("key", F.explode("labels").alias("label")))
    united = labels.where("trim(label) <> ''").groupBy("key", F.lower(F.trim("label")).alias("low")).agg(F.min(F.trim("label")).alias("label")).where("low <> key")
    every = named.select(key.alias("key"), F.trim("name").alias("name"), F.lit(True).alias("new")).union(concepts.select("key", "name", F.lit(False)))
    heads = every.groupBy("key").agg(F.coalesce(F.min(F.when(~F.col("new"), F.col("name"))), F.min("name")).alias("name"), F.bool_and("new").alias("is_new"))
    return heads.join(united.groupBy("key").agg(F.sort_array(F.collect_list("label")).alias("labels")), "key", "left").select("key", "name", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "is_new")


def reify(concepts: DataFrame, least: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """Artifacts (artifact_id, kind, text, confidence, confidence_low) of confident concepts, and their edges (src, dst, rel_type).

    concepts: id, kind, text, confidence, message, session; one of kind noise, or none, makes no artifact.
    """
    sure = concepts.where((F.col("confidence") >= least) & F.col("kind").isNotNull() & (F.col("kind") != "noise")).withColumn("artifact_id", F.sha2(F.concat_ws("|", "kind", "id"), 256))
    ends = F.array(
        F.struct(F.col("id").cast("string").alias("src"), F.col("artifact_id").alias("dst"), F.lit("REIFIED_AS").alias("rel_type")),
        F.struct(F.col("message").cast("string").alias("src"), F.col("artifact_id").alias("dst"), F.lit("ESTABLISHED").alias("rel_type")),
        F.struct(F.col("artifact_id").alias("src"), F.col("session").cast("string").alias("dst"), F.lit("ESTABLISHED_IN").alias("rel_type")),
    )
    made = sure.select("artifact_id", "kind", "text", "confidence", (F.col("confidence") < 0.90).alias("confidence_low"))
    return made, sure.select(F.explode(ends).alias("e")).select("e.*").where("src IS NOT NULL AND dst IS NOT NULL")


def warm(edges: DataFrame) -> DataFrame:
    """session, node, activation (none: 0; of several the greatest) of the nodes that sessions keep warm; the session `unknown` has none. edges: session, node, activation."""
    return edges.where("session <> 'unknown' AND node IS NOT NULL").groupBy("session", "node").agg(F.max(F.coalesce("activation", F.lit(0.0))).alias("activation"))
