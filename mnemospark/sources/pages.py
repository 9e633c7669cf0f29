"""Page projections: nodes of a graph as text pages for personas, of which only the changed ones are written.

A persona takes pages type by type in a fixed order, each type ordered by
itself, until its limit is filled: the same as the first `limit` nodes in the
order of (type, place within the type). Pages are rendered by expressions,
compared by hash with those of the last run, and the changed ones are written
as one folder each, which a run replaces or leaves alone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.sources.versioned import Tables, Upsert
from mnemospark.storage import cut


@dataclass(frozen=True)
class Persona:
    """Which node types and domains a persona sees (None: all), and how many pages at most."""

    name: str
    limit: int
    types: tuple[str, ...] | None = None
    domains: tuple[str, ...] | None = None


def select_pages(nodes: DataFrame, personas: list[Persona], order: list[str]) -> DataFrame:
    """persona, place and the columns of nodes: each persona's pages.

    nodes: node_type, node_id, domain, weight (larger first within a type) and
    others. Types outside `order` make no page.
    """
    known = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("node_type"))
    wide = nodes.withColumn("type_place", known).where("type_place > 0")
    sees = lambda p: (F.col("node_type").isin(*p.types) if p.types is not None else F.lit(True)) & (F.col("domain").isin(*p.domains) if p.domains is not None else F.lit(True))
    mine = F.filter(F.array(*[F.when(F.coalesce(sees(p), F.lit(False)), F.struct(F.lit(p.name).alias("persona"), F.lit(p.limit).alias("most"))) for p in personas]), lambda x: x.isNotNull())
    each = wide.withColumn("for", F.explode(mine)).select("for.persona", "for.most", *wide.columns)
    w = Window.partitionBy("persona").orderBy("type_place", F.desc_nulls_last("weight"), "node_id")
    most = max((p.limit for p in personas), default=0)
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).where(F.col("place") <= F.col("most")).drop("most", "type_place")


def render(title: Column, sections: Mapping[str, Column]) -> Column:
    """A page: its title, then each section that has a body; line ends within a title become spaces."""
    parts = [F.concat(F.lit("# "), F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))]
    parts += [F.when(F.trim(body) != "", F.concat(F.lit(f"## {name}\n\n"), F.trim(body))) for name, body in sections.items()]
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))


def glossary(terms: DataFrame, most: int, least_confidence: float = 0.6) -> Column | DataFrame:
    """One page for each persona: its strongest terms (term, meaning, strength, confidence) as lines, the strongest first."""
    w = Window.partitionBy("persona").orderBy(F.desc("strength"), "term")
    first = terms.where(F.col("confidence") >= least_confidence).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    line = F.concat(F.lit("- **"), F.col("term"), F.lit("**: "), F.coalesce("meaning", F.lit("")))
    lines = first.groupBy("persona").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # `most` lines
    return lines.select("persona", F.lit("glossary").alias("page"), F.concat(F.lit("# Glossary\n\n"), F.array_join(F.col("lines.line"), "\n"), F.lit("\n")).alias("text"))


def project(pages: DataFrame, store: Tables, path: str) -> dict[str, int]:
    """Write the changed pages (persona, page, text; one row each) under path; how many were written, skipped and removed.

    The store's table `pages` has persona, page, sha256 and live of every page
    ever written. It is committed after the files: a run that dies between
    writes the same pages again.
    """
    now = cut(pages.select("persona", "page", "text", F.sha2("text", 256).alias("sha256")), "pages")
    before = store.read("pages")
    if before is None:
        before = now.select("persona", "page", "sha256", F.lit(True).alias("live")).limit(0)
    had = before.select("persona", "page", F.col("sha256").alias("was"), F.col("live").alias("lives"))
    told = cut(now.join(had, ["persona", "page"], "full"), "pages-told")
    same = F.coalesce((F.col("sha256") == F.col("was")) & F.col("lives"), F.lit(False))
    changed = told.where(F.col("sha256").isNotNull() & ~same)
    gone = told.where(F.col("sha256").isNull() & F.col("lives"))
    counts = told.agg(F.count_if(F.col("sha256").isNotNull() & ~same).alias("written"), F.count_if(F.col("sha256").isNotNull() & same).alias("skipped"), F.count_if(F.col("sha256").isNull() & F.col("lives")).alias("removed")).first().asDict()
    if counts["written"]:
        line = F.when(F.endswith("text", F.lit("\n")), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))  # the writer ends lines itself
        changed.select("persona", "page", line.alias("value")).repartition("persona", "page").write.partitionBy("persona", "page").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").mode("overwrite").text(path)
    if counts["written"] or counts["removed"]:
        marked = changed.select("persona", "page", "sha256", F.lit(True).alias("live")).unionByName(gone.select("persona", "page", F.col("was").alias("sha256"), F.lit(False).alias("live")))
        store.commit({"pages": Upsert(marked, ["persona", "page"])})
    return counts
