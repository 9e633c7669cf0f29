"""Queries of the text rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.sources.memory_tables import messages, table

#: Phrases that the corpus lacks; each message gets one, so that every rule has work.
PHRASES = [
    "we decided to ship it", "you must not deploy", "we need this today", "we will build next step", "that broke and the build failed", "perfect, all tests pass", "ugh, wrong again", "brilliant, love this",
    "asap, this is critical", "the config was selected and chosen", "must always ensure backups", "see B12 and B345", "revert and try again but approved", "docker install", "permission denied",
]
GISTS = ["Restriction", "PlannedEvent", "PhysicalThing", "Agent", "Category"]
_NAMES = ["data", "B12", "docker container", "the api gateway", "# heading", "to be", "snake_case", "camelCase", "3.14", "deadbeef99", "1st", "ok", "**bold**", "release plan v2", "***a"]


def _pick(values: list[str], n) -> F.col:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def spoken(spark, sf_dir):
    """Messages with a phrase appended: message_id, role, gist, text."""
    m = messages(spark, sf_dir)
    n = F.col("session_id") * 3 + F.col("turn")
    return m.select("message_id", "session_id", "turn", "role", _pick(GISTS, F.col("message_id")).alias("gist"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(PHRASES, n)).alias("text"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SPOKEN_SQL = f"""spoken AS (SELECT conv_id * 10000 + turn AS message_id, conv_id AS session_id, turn, role, {_list(GISTS)}[CAST((conv_id * 10000 + turn) % {len(GISTS)} + 1 AS INTEGER)] AS gist,
  coalesce(text, '') || ' ' || {_list(PHRASES)}[CAST((conv_id * 3 + turn) % {len(PHRASES)} + 1 AS INTEGER)] AS text FROM conversations)"""


def hits_sql(kind: str) -> str:
    parts = []
    for p in T.SIGNALS[kind]:
        if "(?!" in p:  # the one look-ahead: "must" that no "not" follows
            parts.append(r"CAST(regexp_matches(regexp_replace(lower(text), '\bmust\s+not', '', 'g'), '\bmust\b') AS INTEGER)")
        else:
            parts.append("CAST(regexp_matches(lower(text), '" + p.replace("'", "''") + "') AS INTEGER)")
    return "(" + " + ".join(parts) + ")"


_S, _F = hits_sql("success"), hits_sql("failure")
_VALENCE = f"CASE WHEN {_F} = 0 AND {_S} > 0 THEN 0.8 WHEN {_S} = 0 AND {_F} > 0 THEN -0.8 WHEN {_S} - {_F} >= 2 THEN 0.8 WHEN {_F} - {_S} >= 2 THEN -0.8 END"


def text_signal_counts(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return s.select("message_id", *[T.hits(F.col("text"), k).alias(k) for k in T.SIGNALS])


def text_outcome_valence(spark, sf_dir):
    return spoken(spark, sf_dir).select("message_id", T.valence(F.col("text")).alias("valence"))


def text_salience(spark, sf_dir):
    return spoken(spark, sf_dir).select("message_id", F.round(T.salience(F.col("text")), 6).alias("salience"))


def text_artifact_classify(spark, sf_dir):
    s = spoken(spark, sf_dir).select("message_id", T.artifact(F.col("text"), F.col("gist"), F.col("role")).alias("a"))
    return s.select("message_id", "a.artifact_type", F.round("a.confidence", 6).alias("confidence"), "a.confidence_low", "a.proceed")


def text_junk_filter(spark, sf_dir):
    s = spoken(spark, sf_dir).select("message_id", _pick(_NAMES, F.col("session_id") + F.col("turn")).alias("name"))
    return s.select("message_id", "name", T.junk(F.col("name")).alias("junk"))


def text_trigger_pattern(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.trigger_pattern(F.concat(F.lit("the "), "p_name", F.lit(" for each-one of "), "p_type")).alias("pattern"))


def text_keywords(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.keywords(F.concat_ws(" ", "p_name", "p_type")), ",").alias("keywords"))


def text_identifiers(spark, sf_dir):
    s = spoken(spark, sf_dir).select("message_id", T.identifiers(F.col("text")).alias("ids"))
    return s.where(F.size("ids") > 0).select("message_id", F.array_join("ids", ",").alias("ids"))


def text_signal_type(spark, sf_dir):
    return spoken(spark, sf_dir).select(T.signal_type(F.col("text")).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def text_token_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def text_dedupe_key(spark, sf_dir):
    """Live documents: the first of each dedupe key by id; every fiftieth carries its own key."""
    d = table(spark, sf_dir, "documents")
    key = T.dedupe_key("Document", F.col("text"), F.col("source"), F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(" k"), F.col("doc_id").cast("string"))))
    return d.groupBy(key.alias("dedupe_key")).agg(F.min("doc_id").alias("live_id"), F.count("*").alias("seen"))


def text_input_router(spark, sf_dir):
    p = table(spark, sf_dir, "documents")
    ext = _pick([".csv", ".md", "", "", ""], F.col("doc_id"))
    mime = _pick(["", "text/csv", "application/pdf", "text/plain"], F.col("doc_id"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("a,b\n1,2\n3,4")).when(F.col("doc_id") % 7 == 1, F.lit('[{"a": 1}]')).otherwise(F.col("text"))
    r = p.select("doc_id", T.route(F.concat(F.lit("f"), ext), mime, body).alias("r"))
    return r.groupBy("r.storage_type", "r.confidence", "r.tool").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (text_signal_counts, text_outcome_valence, text_salience, text_artifact_classify, text_junk_filter, text_trigger_pattern, text_keywords, text_identifiers, text_signal_type, text_token_estimate, text_dedupe_key, text_input_router)}

_STOP = _list(T.STOPWORDS)
_KINDS = ("decision", "constraint", "requirement", "action_item")
_PRIOR = "CASE gist " + " ".join(f"WHEN '{g}' THEN '{k}'" for g, (k, _) in T.PRIORS.items() if k) + " END"
_WEIGHT = "CASE gist " + " ".join(f"WHEN '{g}' THEN CAST({w} AS DOUBLE)" for g, (k, w) in T.PRIORS.items() if k) + " END"

ORACLE_SQL = {
    "text_signal_counts": f"WITH {SPOKEN_SQL} SELECT message_id, " + ", ".join(f'{hits_sql(k)} AS "{k}"' for k in T.SIGNALS) + " FROM spoken",
    "text_outcome_valence": f"WITH {SPOKEN_SQL} SELECT message_id, CAST({_VALENCE} AS DOUBLE) AS valence FROM spoken",
    "text_salience": f"""WITH {SPOKEN_SQL} SELECT message_id, round(least(1.0 + 0.15 * ({hits_sql('frustration')} + 0.7 * {hits_sql('excitement')} + 0.8 * {hits_sql('urgency')}
  + CASE WHEN ({_VALENCE}) IS NOT NULL THEN 0.5 ELSE 0 END), 1.6), 6)::DOUBLE AS salience FROM spoken""",
    "text_artifact_classify": f"""WITH {SPOKEN_SQL}, h AS (SELECT *, {', '.join(f'{hits_sql(k)} AS h_{k}' for k in _KINDS)} FROM spoken
), b AS (SELECT *, greatest({', '.join(f'h_{k}' for k in _KINDS)}) AS best, {_PRIOR} AS prior, {_WEIGHT} AS weight FROM h
), t AS (SELECT *, CASE best {' '.join(f"WHEN h_{k} THEN '{k}'" for k in _KINDS)} END AS top FROM b
), c AS (SELECT *, CASE WHEN best > 0 THEN top ELSE prior END AS kind, CASE WHEN best = 0 THEN weight WHEN prior = top THEN least(least(0.67 + best * 0.15, 0.97) + 0.10, 0.98)
    ELSE least(0.67 + best * 0.15, 0.97) END AS raw0 FROM t
), d AS (SELECT *, CASE WHEN trim(text) <> '' AND NOT contains(trim(text), ' ') THEN least(raw0, 0.6) ELSE raw0 END AS raw FROM c
), e AS (SELECT *, CASE WHEN raw >= 0.6 AND role = 'assistant' THEN least(raw, 0.85) ELSE raw END AS capped FROM d)
SELECT message_id, coalesce(kind, 'noise') AS artifact_type, round(CASE WHEN kind IS NULL THEN 0 ELSE capped END, 6)::DOUBLE AS confidence,
  kind IS NULL OR raw < 0.6 OR capped < 0.9 AS confidence_low, kind IS NOT NULL AND raw >= 0.6 AS proceed FROM e""",
    "text_junk_filter": f"""WITH j(name, junk) AS (VALUES {', '.join(f"('{n}', {'false' if n in ('B12', 'docker container', 'the api gateway', 'release plan v2') else 'true'})" for n in _NAMES)}
), m AS (SELECT conv_id * 10000 + turn AS message_id, {_list(_NAMES)}[CAST((conv_id + turn) % {len(_NAMES)} + 1 AS INTEGER)] AS name FROM conversations) SELECT message_id, name, junk FROM m JOIN j USING (name)""",
    "text_trigger_pattern": f"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array('the ' || p_name || ' for each-one of ' || p_type, '[^a-zA-Z0-9_-]+'), lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, lower(w))) AS ws FROM part)
SELECT p_partkey, CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(ws[1:5], lambda w: replace(w, '-', '\\-')), '|') END AS pattern FROM w""",
    "text_keywords": f"""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z'']+')), lambda w: len(w) >= 4 AND NOT list_contains({_STOP}, w))), ',') AS keywords FROM part""",
    "text_identifiers": f"WITH {SPOKEN_SQL}, i AS (SELECT message_id, regexp_extract_all(text, '\\bB\\d+\\b') AS ids FROM spoken) SELECT message_id, array_to_string(ids, ',') AS ids FROM i WHERE len(ids) > 0",
    "text_signal_type": f"WITH {SPOKEN_SQL} SELECT CASE WHEN {hits_sql('error')} > 0 THEN 'error' WHEN {hits_sql('action')} > 0 THEN 'action' END AS signal, count(*) AS n FROM spoken GROUP BY 1",
    "text_token_estimate": "SELECT source, count(*) AS n, CAST(sum(coalesce(length(text) // 3, 0)) AS BIGINT) AS tokens FROM documents GROUP BY source",
    "text_dedupe_key": """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'idemp:k' || doc_id
  ELSE sha256('Document' || chr(1) || trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g')) || chr(1) || coalesce(source, '')) END AS dedupe_key FROM documents)
SELECT dedupe_key, min(doc_id) AS live_id, count(*) AS seen FROM k GROUP BY dedupe_key""",
    "text_input_router": """WITH d AS (SELECT doc_id, doc_id % 5 AS e, doc_id % 4 AS m, doc_id % 7 AS b, text FROM documents
), l AS (SELECT *, string_split(trim(text), chr(10)) AS ls FROM d
), c AS (SELECT *, list_filter(ls[1:10], lambda x: trim(x) <> '') AS f FROM l
), n AS (SELECT *, list_transform(f, lambda x: len(x) - len(replace(x, ',', ''))) AS commas, list_transform(f, lambda x: len(x) - len(replace(x, chr(9), ''))) AS tabs FROM c
), t AS (SELECT *, coalesce(len(ls) >= 3 AND ((commas[1] > 0 AND len(list_distinct(commas)) <= 2) OR (tabs[1] > 0 AND len(list_distinct(tabs)) <= 2)), false) OR coalesce(starts_with(trim(text), '[') AND ends_with(trim(text), ']') AND json_valid(trim(text)), false) AS tabular FROM n
), r AS (SELECT CASE WHEN e = 0 THEN 1 WHEN e = 1 THEN 2 WHEN m = 1 THEN 3 WHEN m = 3 THEN 4 WHEN b < 2 OR tabular THEN 5 WHEN len(text) > 2000 THEN 6 ELSE 7 END AS k FROM t)
SELECT ['tabular','document','tabular','document','graph+tabular','document','graph'][k] AS storage_type, [0.95, 0.95, 0.9, 0.85, 0.75, 0.7, 0.6][k]::DOUBLE AS confidence,
  ['ingest_tabular','ingest_document','ingest_tabular','ingest_document','ingest_tabular','ingest_document','notify_turn'][k] AS tool, count(*) AS n FROM r GROUP BY ALL""",
}
