"""Queries of page projections and memory decisions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import decisions
from mnemospark.sources import pages
from mnemospark.sources.memory_tables import table
from mnemospark.sources.versioned import Tables
from mnemospark.storage import shared_path

_ORDER = ["Lesson", "Procedure", "Decision"]
_PERSONAS = [pages.Persona("all", 300), pages.Persona("buyer", 120, types=("Decision", "Lesson"), domains=("1", "3", "7")), pages.Persona("keeper", 40, types=("Procedure",)), pages.Persona("nobody", 0)]


def _nodes(spark, sf_dir) -> DataFrame:
    """Parts as lessons, suppliers as procedures, customers as decisions; the domain is the last digit of the key."""
    made = []
    for name, kind, key, title, weight in (("part", "Lesson", "p_partkey", "p_name", "p_retailprice"), ("supplier", "Procedure", "s_suppkey", "s_name", "s_acctbal"), ("customer", "Decision", "c_custkey", "c_name", "c_acctbal")):
        t = table(spark, sf_dir, name)
        made.append(t.select(F.lit(kind).alias("node_type"), F.col(key).alias("node_id"), F.substring(F.col(key).cast("string"), -1, 1).alias("domain"), F.round(weight, 2).cast("decimal(12,2)").alias("weight"), F.col(title).alias("title")))
    return reduce(DataFrame.unionByName, made)


def _pages(nodes: DataFrame) -> DataFrame:
    chosen = pages.select_pages(nodes, _PERSONAS, _ORDER)
    text = pages.render(F.concat(F.col("node_type"), F.lit(": "), F.col("title")), {"Domain": F.col("domain"), "Weight": F.col("weight").cast("string"), "Notes": F.lit(" ")})
    return chosen.select("persona", F.concat_ws("-", F.lower("node_type"), "node_id").alias("page"), text.alias("text"))


def wiki_pages(spark, sf_dir):
    """Pages after three runs (the first over even keys, then all twice) as the files have them, with the runs' counts."""
    nodes, store, path = _nodes(spark, sf_dir), Tables(spark, shared_path(spark, "wiki-manifest")), shared_path(spark, "wiki")
    runs = [pages.project(_pages(part), store, path) for part in (nodes.where("node_id % 2 = 0"), nodes, nodes)]
    files = spark.read.text(path, wholetext=True).select("persona", "page", F.sha2("value", 256).alias("sha256"))
    live = store.read("pages").where("live").join(files, ["persona", "page", "sha256"]).select("persona", "page", "sha256")
    counts = spark.createDataFrame([(f"run {k}", what, str(n)) for k, r in enumerate(runs, 1) for what, n in r.items()], "persona string, page string, sha256 string")  # nine rows
    return live.unionByName(counts)


def wiki_glossary(spark, sf_dir):
    """The strongest parts of each brand as a glossary."""
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_brand").alias("persona"), F.concat_ws("-", "p_name", "p_partkey").alias("term"), F.col("p_brand").alias("meaning"), F.round("p_retailprice", 2).cast("decimal(12,2)").alias("strength"), (F.col("p_partkey") % 10 / 10).alias("confidence"))
    return pages.glossary(terms, 10).select("persona", "page", F.sha2("text", 256).alias("sha256"))


#: Words of rules, put before turns so that every rule has prompts.
_SAID = ["", "What did we decide about ", "what changed in ", "Walk me through ", "how did we do ", "a checklist for ", "should we avoid ", "how many tokens in ", "grid or scene of ", "puzzle with ", "a comparable one to ", "tell me everything about "]
_CLIENTS = ["codex", "Claude-Desktop", "gemini_cli", "other"]


def memory_decisions(spark, sf_dir):
    """The decision for every turn, some of them put as questions."""
    said, clients = F.array(*[F.lit(s) for s in _SAID]), F.array(*[F.lit(c) for c in _CLIENTS])
    key = F.col("conv_id") + F.col("turn")
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.get(said, (key % len(_SAID)).cast("int")), F.col("text")).alias("prompt"), F.get(clients, (key % 5).cast("int")).alias("client"))
    return decisions.decide(prompts).select("conv_id", "turn", "tool", "confidence", "query", "token_budget")


QUERIES = {f.__name__: f for f in (wiki_pages, wiki_glossary, memory_decisions)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(k: int, none: str) -> str:
    out = "CASE WHEN many"
    for tool, confidence, words in decisions.RULES:
        found = " OR ".join("contains(low, '" + w.replace("'", "''") + "')" for w in words)
        spatial = " OR ".join(f"contains(low, '{w}')" for w in decisions.SPATIAL)
        mechanic = " OR ".join(f"contains(low, '{w}')" for w in decisions.RULES[3][2]) + " OR starts_with(low, 'arc ')"
        if tool == "recall_scene_graph_priors":
            found += f" OR (({mechanic}) AND ({spatial}))"
        if tool == "recall_mechanic_priors":
            found = mechanic
        value = f"'{tool}'" if k == 0 else f"{confidence}::DOUBLE"
        out += (" OR " if tool == "compile_context" else " WHEN ") + f"{found} THEN {value}"
    return out + f" ELSE {none} END"


_PAGES = """WITH n AS (
  SELECT 'Lesson' AS node_type, 1 AS tp, p_partkey AS node_id, CAST(round(p_retailprice, 2) AS DECIMAL(12, 2)) AS weight, p_name AS title FROM part
  UNION ALL SELECT 'Procedure', 2, s_suppkey, CAST(round(s_acctbal, 2) AS DECIMAL(12, 2)), s_name FROM supplier
  UNION ALL SELECT 'Decision', 3, c_custkey, CAST(round(c_acctbal, 2) AS DECIMAL(12, 2)), c_name FROM customer
), r(run) AS (VALUES (1), (2)), m AS (SELECT run, n.*, right(CAST(node_id AS VARCHAR), 1) AS domain FROM n, r WHERE run = 2 OR node_id % 2 = 0
), e AS (SELECT 'all' AS persona, 300 AS most, m.* FROM m UNION ALL SELECT 'buyer', 120, m.* FROM m WHERE node_type IN ('Decision', 'Lesson') AND domain IN ('1', '3', '7')
  UNION ALL SELECT 'keeper', 40, m.* FROM m WHERE node_type = 'Procedure'
), t AS (SELECT run, persona, lower(node_type) || '-' || node_id AS page,
  sha256('# ' || node_type || ': ' || regexp_replace(title, '\\s+', ' ', 'g') || chr(10) || chr(10) || '## Domain' || chr(10) || chr(10) || domain || chr(10) || chr(10) || '## Weight' || chr(10) || chr(10) || weight || chr(10)) AS sha256
  FROM e QUALIFY row_number() OVER (PARTITION BY run, persona ORDER BY tp, weight DESC, node_id) <= most
), a AS (SELECT * FROM t WHERE run = 1), b AS (SELECT * FROM t WHERE run = 2),
c AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a SEMI JOIN b USING (persona, page, sha256)) AS same)"""

ORACLE_SQL = {
    "wiki_pages": _PAGES + """ SELECT persona, page, sha256 FROM b
UNION ALL SELECT v.run, v.what, CAST(v.n AS VARCHAR) FROM c, LATERAL (VALUES ('run 1', 'written', a), ('run 1', 'skipped', 0), ('run 1', 'removed', 0), ('run 2', 'written', b - same), ('run 2', 'skipped', same), ('run 2', 'removed', a - same),
  ('run 3', 'written', 0), ('run 3', 'skipped', b), ('run 3', 'removed', 0)) v(run, what, n)""",
    "wiki_glossary": """WITH t AS (SELECT p_brand AS persona, p_name || '-' || p_partkey AS term, CAST(round(p_retailprice, 2) AS DECIMAL(12, 2)) AS strength FROM part WHERE p_partkey % 10 >= 6
), r AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY strength DESC, term) AS place FROM t)
SELECT persona, 'glossary' AS page, sha256('# Glossary' || chr(10) || chr(10) || string_agg('- **' || term || '**: ' || persona, chr(10) ORDER BY place) || chr(10)) AS sha256 FROM r WHERE place <= 10 GROUP BY persona""",
    "memory_decisions": rf"""WITH p AS (SELECT conv_id, turn, ({_list(_SAID)})[1 + (conv_id + turn) % {len(_SAID)}] || text AS prompt, ({_list(_CLIENTS)})[1 + (conv_id + turn) % 5] AS client FROM conversations
), x AS (SELECT *, lower(coalesce(prompt, '')) AS low, len(list_filter(flatten(list_transform(string_split_regex(coalesce(prompt, ''), '[.!?]\s+'), lambda s: (string_split_regex(trim(s, ' ' || chr(9) || chr(10) || chr(13)), '\s+'))[2:])),
  lambda w: regexp_matches(w, '^\p{{Lu}}') AND regexp_matches(w, '\p{{Ll}}'))) >= 2 OR len(regexp_extract_all(coalesce(prompt, ''), '"[^"]+"|''[^'']+''')) >= 2 AS many FROM p
), t AS (SELECT *, {_case(0, "'none'")} AS tool, {_case(1, "0.80::DOUBLE")} AS confidence, trim(split_part(split_part(prompt, '?', 1), '.', 1)) AS head FROM x)
SELECT conv_id, turn, tool, confidence, CASE tool WHEN 'none' THEN '' WHEN 'context_status' THEN 'context window health' ELSE CASE WHEN length(head) > 50 THEN substr(head, 1, 47) || '...' ELSE head END END AS query,
  CASE WHEN tool = 'compile_context' THEN CASE replace(lower(client), '-', '_') WHEN 'codex' THEN 32000 WHEN 'claude_desktop' THEN 50000 WHEN 'gemini_cli' THEN 128000 ELSE 32000 END END AS token_budget FROM t""",
}
