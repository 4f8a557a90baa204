"""Queries of group H: quotes, citations, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import grounding as G
from quire.queries.registry import registry
from quire.views import with_views

QUERIES, ORACLES, query = registry()


def _hits(lib):
    """Two neighbouring benchmark items as the hits of an answer."""
    b = lib.table("benchmark")
    own = b.select(F.col("item_id").alias("answer_id"), F.lit(1).alias("rank"), "text")
    return own.unionByName(b.select((F.col("item_id") - 1).alias("answer_id"), F.lit(2).alias("rank"), "text").where("answer_id >= 0"))


def _answers(lib):
    quote = F.translate("text", '"\n', "' ")
    return lib.table("benchmark").select(
        F.col("item_id").alias("answer_id"), F.concat(F.lit('As said [1]"'), F.when(F.col("item_id") % 2 == 0, quote).otherwise(F.reverse(quote)), F.lit('" and [2, 9].')).alias("answer")
    )


@query(
    "h1_build_context",
    "SELECT item_id % 10 AS query_id, string_agg('[' || item_id || '] src' || (item_id % 3) || ' (p.' || (item_id % 7) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY item_id) AS context FROM benchmark GROUP BY 1",
)
def _(lib):
    hits = lib.table("benchmark").select(
        (F.col("item_id") % 10).alias("query_id"), F.col("item_id").alias("rank"), F.concat(F.lit("src"), F.col("item_id") % 3).alias("source"), F.concat(F.lit("p."), F.col("item_id") % 7).alias("locator"), "text"
    )
    return G.build_context(hits)


@query(
    "h2_extract_citations",
    """WITH b AS (SELECT item_id AS answer_id, translate(text, '"' || chr(10), '''' || ' ') AS q FROM benchmark)
SELECT answer_id, 1 AS marker, CASE WHEN length(q) BETWEEN 8 AND 300 THEN CASE WHEN answer_id % 2 = 0 THEN q ELSE reverse(q) END END AS quote FROM b UNION ALL SELECT answer_id, 2, NULL FROM b UNION ALL SELECT answer_id, 9, NULL FROM b""",
)
def _(lib):
    return G.extract_citations(_answers(lib))


# a quote has 8 to 300 characters; longer ones are no quotes
_SHARE = r"""p AS (SELECT item_id, length(text) BETWEEN 8 AND 300 AS quoted, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s, regexp_replace(lower(CASE WHEN item_id % 2 = 0 THEN translate(text, '"' || chr(10), '''' || ' ') ELSE reverse(translate(text, '"' || chr(10), '''' || ' ')) END), '[^\p{L}\p{N}]+', '', 'g') AS q FROM benchmark),
w AS (SELECT item_id, quoted, s, q, list_transform(range(1, greatest(length(q) - 3, 1) + 1, 2), lambda i: substr(q, i, 4)) AS g FROM p),
v AS (SELECT item_id, quoted, round(CASE WHEN q = '' THEN 0.0 WHEN contains(s, q) THEN 1.0 ELSE len(list_filter(g, lambda x: contains(s, x))) / len(g) END, 6) AS share FROM w)
"""


@query("h3_quote_supported", "WITH " + _SHARE + "SELECT item_id, share, share >= 0.42 AS supported FROM v")
def _(lib):
    a = _answers(lib).join(lib.table("benchmark"), F.col("answer_id") == F.col("item_id"))
    quote = F.regexp_extract("answer", '"([^"]*)"', 1)
    share = F.round(G.quote_share(G.plain(quote), G.plain(F.col("text"))), 6)
    return a.select("item_id", share.alias("share"), (share >= 0.42).alias("supported"))


@query(
    "h4_verify_citations",
    "WITH " + _SHARE + """SELECT item_id AS answer_id, 1 AS marker, CASE WHEN quoted THEN share END AS share, CASE WHEN NOT quoted THEN 'unverified' WHEN share >= 0.42 THEN 'verified' ELSE 'mismatched' END AS state FROM v
UNION ALL SELECT item_id, 2, NULL, CASE WHEN item_id + 1 IN (SELECT item_id FROM benchmark) THEN 'unverified' ELSE 'out_of_range' END FROM benchmark UNION ALL SELECT item_id, 9, NULL, 'out_of_range' FROM benchmark""",
)
def _(lib):
    return G.verify_citations(_answers(lib), _hits(lib))


@query("h5_grounded", "WITH " + _SHARE + "SELECT item_id AS answer_id, NOT quoted OR share >= 0.42 AS grounded, (quoted AND share >= 0.42)::BIGINT AS verified, (item_id + 1 IN (SELECT item_id FROM benchmark))::BIGINT + (NOT quoted)::BIGINT AS unverified, (quoted AND share < 0.42)::BIGINT AS mismatched FROM v")
def _(lib):
    return G.grounded(G.verify_citations(_answers(lib), _hits(lib)))


@query(
    "h6_contamination",
    r"""WITH a AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
b AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ga AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM a WHERE len(w) > 0),
gb AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM ga GROUP BY 1)
SELECT doc_id, item_id, round(k / n, 6) AS share FROM (SELECT doc_id, item_id, count(*) AS k FROM ga JOIN gb ON ga.g = gb.g GROUP BY ALL) JOIN n USING (item_id) WHERE round(k / n, 6) >= 0.8""",
)
def _(lib):
    return G.contamination(lib.table("documents"), lib.table("benchmark"))


@query("h7_needs_context", with_views("messages", f"SELECT message_id, regexp_matches(text, '{G.ANAPHORA}') OR (length(trim(text)) <= 12 AND NOT regexp_matches(text, '[A-Za-z]{{3}}')) AS needs_context FROM messages WHERE role = 'user'"))
def _(lib):
    return G.needs_context(lib.messages)


@query(
    "h8_history_window",
    with_views("messages", r"""k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, message_id DESC) AS k FROM messages WHERE role IN ('user', 'assistant')),
l AS (SELECT conv_id, list(role || ': ' || substr(CASE WHEN role = 'assistant' THEN regexp_replace(text, '\[\d+(?:,\s*\d+)*\]', '', 'g') ELSE text END, 1, 4000) ORDER BY turn, message_id) AS h FROM k WHERE k <= 6 GROUP BY 1)
SELECT conv_id, array_to_string(h, chr(10)) AS history, substr(sha256(array_to_string(h[greatest(len(h) - 1, 1):greatest(len(h) - 1, 1) + 1], chr(10))), 1, 16) AS fingerprint FROM l"""),
)
def _(lib):
    return G.history_window(lib.messages)


@query("h10_truncate_after", with_views("messages", "SELECT message_id FROM messages m WHERE conv_id % 2 = 1 OR turn <= 1"))
def _(lib):
    edits = lib.messages.where("conv_id % 2 = 0 AND turn = 1").select("conv_id", "message_id")
    # conversations without a second turn have nothing after it
    return G.truncate_after(lib.messages, edits).select("message_id")


@query(
    "h11_conversation_list",
    with_views("messages", "SELECT conv_id, conv_id % 10 = 0 AS pinned, count(*) AS n_messages, substr(arg_min(text, message_id) FILTER (role = 'user'), 1, 60) AS title, max(created_at) AS last_at FROM messages GROUP BY conv_id"),
)
def _(lib):
    return G.conversation_list(lib.messages, lib.messages.where("conv_id % 10 = 0").select("conv_id").distinct()).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
