"""Memory decisions: which recall a prompt asks for, by an ordered table of rules, for many prompts at once.

The rules become one CASE expression: the first that matches wins. Each rule's
triggers are one alternation over the lower-cased prompt.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules in their order, as tool, confidence and triggers.
RULES: list[tuple[str, float, list[str]]] = [
    ("compile_context", 0.85, ["everything about", "full context", "brief me on", "what do we know about", "summary of", "overview of", "bundle", "compile"]),
    ("context_status", 0.92, ["context", "token", "bloat", "memory usage", "how much space", "memory have i used"]),
    ("recall_scene_graph_priors", 0.74, ["scene graph", "grid", "layout"]),
    ("recall_mechanic_priors", 0.76, [" arc ", "world model", "world-model", "mechanic", "transformation", "puzzle"]),
    ("current_truth", 0.86, ["what did we decide", "what decision", "prior decision", "constraint", "preference", "did we choose", "are the requirements", "what's the standard", "are the rules"]),
    ("diff_since", 0.80, ["what changed", "since last", "since the", "since when", "diff", "difference", "what's different", "other agent", "sub agent", "finished"]),
    ("reconstruct_timeline", 0.82, ["timeline", "sequence", "what happened", "in order", "step by step", "chronolog", "debug history", "trace", "walk me through", "how did we get here"]),
    ("analogical_search", 0.72, ["like before", "similar situation", "similar problem", "analogy", "analogous", "resembles", "reminds me", "we did this", "comparable"]),
    ("recall_plans", 0.75, ["plan", "implement", "backlog card", "how did we", "last time we", "before we", "strategy", "approach"]),
    ("recall_procedures", 0.83, ["procedure", "workflow", "how do we usually", "standard", "process", "routine", "checklist", "steps"]),
    ("recall_relevant_lessons", 0.78, ["lesson", "learned", "avoid", "mistake", "best practice", "should we", "don't", "pitfall"]),
]
NO_RULE = ("none", 0.80)
#: Words that turn a prompt about mechanics into one about scenes.
SPATIAL = ["scene", "spatial", "position"]
#: Context windows of known clients, in tokens.
WINDOWS = {"claude_code": 128000, "codex": 128000, "chatgpt_desktop": 128000, "claude_desktop": 200000, "gemini_cli": 1000000}
UNKNOWN_BUDGET, LARGEST_BUDGET, SHARE = 32000, 128000, 4
QUERY_CHARS = 50


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def many_topics(prompt: Column) -> Column:
    """Two proper nouns (capitalised words, not all capitals, past the first of a sentence) or two quoted terms."""
    bare = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    words = F.flatten(F.transform(F.split(prompt, r"[.!?]\s+"), lambda s: F.slice(F.split(bare(s), r"(?U)\s+"), 2, 1 << 30)))
    proper = F.filter(words, lambda w: w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}"))
    return (F.size(proper) >= 2) | (F.regexp_count(prompt, F.lit("\"[^\"]+\"|'[^']+'")) >= 2)


def budget(client: Column) -> Column:
    """A quarter of the client's window, bounded; a fixed budget where the client is unknown."""
    known = F.lower(F.replace(F.trim(client), F.lit("-"), F.lit("_")))
    cases = reduce(lambda c, x: c.when(known == x[0], F.lit(min(x[1] // SHARE, LARGEST_BUDGET))), WINDOWS.items(), F.when(F.lit(False), 0))
    return F.coalesce(cases.otherwise(F.lit(UNKNOWN_BUDGET)), F.lit(UNKNOWN_BUDGET))


def recall_query(prompt: Column) -> Column:
    """The prompt up to the first question mark or full stop, cut to 50 characters."""
    head = F.trim(F.split_part(F.split_part(prompt, F.lit("?"), F.lit(1)), F.lit("."), F.lit(1)))
    return F.when(F.length(head) > QUERY_CHARS, F.concat(F.substring(head, 1, QUERY_CHARS - 3), F.lit("..."))).otherwise(head)


def decide(prompts: DataFrame) -> DataFrame:
    """prompts (prompt, client and any other columns) with tool, confidence, query and token_budget.

    A null prompt asks for nothing; the budget is null but for bundles.
    """
    low = F.lower(F.coalesce("prompt", F.lit("")))
    matched = {tool: low.rlike(_any(words)) for tool, _, words in RULES}
    matched["compile_context"] |= many_topics(F.coalesce("prompt", F.lit("")))
    matched["recall_mechanic_priors"] |= low.startswith("arc ")
    matched["recall_scene_graph_priors"] |= matched["recall_mechanic_priors"] & low.rlike(_any(SPATIAL))
    pick = lambda k, none: reduce(lambda c, r: c.when(matched[r[0]], F.lit(r[k])), RULES[1:], F.when(matched[RULES[0][0]], F.lit(RULES[0][k]))).otherwise(F.lit(none))
    told = prompts.withColumn("tool", pick(0, NO_RULE[0])).withColumn("confidence", pick(1, NO_RULE[1]))
    query = F.when(F.col("tool") == "none", "").when(F.col("tool") == "context_status", "context window health").otherwise(recall_query(F.col("prompt")))
    return told.withColumn("query", query).withColumn("token_budget", F.when(F.col("tool") == "compile_context", budget(F.col("client"))))
