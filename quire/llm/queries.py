"""Queries over the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents, fold
from quire.llm.decontaminate import find_leaks
from quire.llm.language_crf import fit_language_crf, label_languages
from quire.llm.license_index import LICENCE_WORD, RARE, TEMPLATES, scan_licences
from quire.llm.quality_mil import fit_quality_mil, score_quality
from quire.llm.quality_rules import RULES as QUALITY_RULES
from quire.llm.link_trust import RULES as URL_RULES
from quire.llm.link_trust import LINK, MARGIN, filter_urls
from quire.llm.merkle import COLUMNS, FAN, merkle_manifest
from quire.llm.packing import pack_documents
from quire.llm.quality_rules import quality_cascade
from quire.llm.secret_scan import RULES as SECRET_RULES
from quire.llm.secret_scan import scan_secrets
from quire.llm.shingle_join import near_duplicates
from quire.llm.site_style import extract_main_text
from quire.llm.token_alignment import align_tokenizers
from quire.llm.toxicity_gru import fit_toxicity, score_toxicity


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in SECRET_RULES if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *map(n, base), F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def _op2_sql() -> str:
    parts = []
    for k, r in enumerate(SECRET_RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS ord, '{r.kind}' AS kind, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS i, m AS ms, g"
            f" FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS m, string_split_regex(coalesce(text, ''), '{p}') AS g FROM documents)"
            f" WHERE len(m) > 0"
        )
    short = " AND ".join(
        f"NOT (kind = '{r.kind}' AND length(regexp_extract(m, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.value})) < {r.min_chars})" for r in SECRET_RULES
    )
    return f"""
WITH hits AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT doc_id, ord, kind, m,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM hits WHERE {short}),
spans AS (SELECT doc_id, kind, ord, s, kind || ':' || s || ':' || (s + length(m)) AS t FROM placed),
summed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(t, ',' ORDER BY s, ord) FILTER (kind IN ('assign', 'access', 'hex')), '') AS base, string_agg(t, ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id"""


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def d5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of bodies alike in either case of any script, by the same join."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _op6_sql(damping: float = 0.85, rounds: int = 12) -> str:
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    longest = sorted(URL_RULES, key=lambda r: -len(r.text))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in longest) + " END"
    # as many rounds as the given tables need until nothing moves
    steps = ["s0 AS MATERIALIZED (SELECT kind, host, mass AS score FROM seeds)"]
    for k in range(rounds):
        steps.append(
            f"s{k + 1} AS MATERIALIZED (SELECT s.kind, o.dst AS host, {damping} * sum(s.score * o.share) AS score FROM s{k} s JOIN shares o ON s.kind = o.kind AND s.host = o.src GROUP BY ALL)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(rounds + 1))
    return f"""
WITH p AS (SELECT page_id, html, {lower("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS MATERIALIZED (SELECT *, {case('text')} AS rule, {case('verdict')} AS ruled FROM p),
own AS (SELECT DISTINCT host FROM j WHERE host <> ''),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]*\\.(.*)$', 1) AS dst FROM own WHERE len(string_split(host, '.')) > 3),
hosts AS (SELECT host FROM own UNION SELECT dst FROM up),
named AS (SELECT src, dst, count(*) AS weight FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{LINK.replace(chr(39), chr(39) * 2)}', 1), lambda x: {lower("x")}))) AS dst FROM j WHERE host <> '')
  WHERE src <> dst AND dst IN (SELECT host FROM hosts) GROUP BY ALL),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM named UNION ALL SELECT src, dst, 1 FROM up) GROUP BY ALL),
kinds AS (SELECT 'allow' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'block', dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM kinds),
counted AS (SELECT ruled AS kind, host, count(*) AS n FROM j WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS mass FROM counted),
{", ".join(steps)},
x AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM (SELECT kind, host, sum(score) AS score FROM ({every}) GROUP BY ALL)),
t AS (SELECT host, coalesce(sum(score) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'block'), 0) AS distrust FROM x GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust * (1 + {MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN t ON j.host = t.host"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op7_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    one = lambda k, t: f"({k}, '{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {quoted(t.phrase)}, {t.at}, {t.votes}, {str(bool(t.key)).lower()})"
    return f"""
WITH templates(t, label, base, tw, phrase, key_at, votes, passage) AS (VALUES {", ".join(one(k, t) for k, t in enumerate(TEMPLATES))}),
ws AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LICENCE_WORD}') AS w FROM documents),
postings AS (SELECT t, tw[o] AS x, o - 1 AS o FROM templates, LATERAL (SELECT unnest(range(1, len(tw) + 1)) AS o)),
df AS (SELECT x, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS x FROM ws) WHERE x IN (SELECT x FROM postings) GROUP BY x),
idf AS (SELECT x, ln((1 + (SELECT count(*) FROM ws)) / (1 + coalesce(n, 0))) AS idf FROM (SELECT DISTINCT x FROM postings) p LEFT JOIN df USING (x)),
possible AS (SELECT r, t FROM ws, templates WHERE list_has_all(w, phrase)),
held AS (SELECT r, t, x, row_number() OVER (PARTITION BY r, t ORDER BY idf DESC, x) AS k FROM possible JOIN ws USING (r) JOIN (SELECT DISTINCT t, x FROM postings) USING (t) JOIN idf USING (x) WHERE list_contains(w, x)),
spots AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM ws WHERE r IN (SELECT r FROM possible)),
starts AS (SELECT r, t, i - o AS s FROM held JOIN spots USING (r, x) JOIN postings USING (t, x) WHERE k <= {RARE} GROUP BY ALL HAVING count(DISTINCT x) >= any_value((SELECT votes FROM templates v WHERE v.t = held.t))),
hits AS (SELECT r, t, s, label, base, passage FROM starts JOIN templates USING (t) JOIN ws USING (r) WHERE s + key_at >= 0 AND w[s + key_at + 1:s + key_at + len(phrase)] = phrase),
mass AS (SELECT t, sum(idf) AS total FROM postings JOIN idf USING (x) GROUP BY t),
placed AS (SELECT r, t, s, sum(idf) AS placed FROM hits JOIN postings USING (t) JOIN idf USING (x) JOIN ws USING (r) WHERE s + o >= 0 AND w[s + o + 1] = x GROUP BY ALL),
scored AS (SELECT r, max(CASE WHEN passage AND total > 0 THEN round(placed / total, 6) ELSE 1.0 END) AS score, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS f, max(s) FILTER (base) AS l,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al FROM hits JOIN mass USING (t) LEFT JOIN placed USING (r, t, s) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM ws LEFT JOIN scored USING (r)"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_cascade(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op8_sql() -> str:
    base = " OR ".join(f"({r.rejects})" for r in QUALITY_RULES if r.base)
    every = " OR ".join(f"({r.rejects})" for r in QUALITY_RULES)
    less = lambda chars: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"
    return f"""
WITH ts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM ts),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
c AS (
  SELECT ws.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, {less('#*$%&|<>')} AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, {less('A-Z')} AS n_upper, {less('!')} AS n_bangs, {less('0-9')} AS n_digits
  FROM ws LEFT JOIN cov ON ws.doc_id = cov.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({base}) AS base_failed, NOT ({every}) AS kept
FROM c"""


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def _learnable(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    return labels.select("doc_id", F.col(column).alias("label"))


def _scored(found: DataFrame, at: float) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op5_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(score_toxicity(docs, fit_toxicity(docs, _learnable(spark, sf_dir, "toxic"))), 0.5)


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(score_quality(docs, fit_quality_mil(docs, _learnable(spark, sf_dir, "quality"))), 0.3)


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    crf = fit_language_crf(docs.withColumn("_out", held_out), "NOT _out AND text IS NOT NULL AND lang IS NOT NULL")
    found = label_languages(docs, crf)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest(documents(spark, sf_dir))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _op12_sql() -> str:
    shown = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(shown(text if c == "text" else c) for c in COLUMNS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # eight shifts for each character of the id, each preceded by the character itself
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    above = lambda name, nodes: f"""{name}(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, digest, n FROM {nodes}
  UNION ALL SELECT tree, level + 1, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {FAN} - 1) // {FAN} FROM {name} WHERE n > 1 GROUP BY tree, level, n, pos // {FAN})"""  # noqa: E731
    runs = lambda nodes: f"SELECT tree, level, pos // {FAN} AS run, list(digest ORDER BY pos) AS ds FROM {nodes} WHERE n > 1 GROUP BY ALL"
    k = f"c.pos % {FAN}"
    climb = lambda name, base, over: f"""{name}(r, tree, level, pos, n, fold, proof) AS (
  SELECT * FROM {base}
  UNION ALL SELECT r, c.tree, c.level + 1, c.pos // {FAN}, (n + {FAN} - 1) // {FAN},
    sha256(array_to_string(ds[:{k}], '') || fold || array_to_string(ds[{k} + 2:], '')), proof || array_to_string(ds[:{k}], '') || array_to_string(ds[{k} + 2:], '')
  FROM {name} c JOIN {over} o ON c.tree = o.tree AND c.level = o.level AND c.pos // {FAN} = o.run WHERE n > 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf('text')} AS digest, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS found FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r FROM leaves),
{above('low', 'placed')},
subroots AS MATERIALIZED (SELECT tree AS grp, 'top' AS tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{above('high', 'subroots')},
low_runs AS MATERIALIZED ({runs('low')}), high_runs AS MATERIALIZED ({runs('high')}),
starts AS (SELECT r, tree, 0 AS level, pos, n, found, '' AS proof FROM placed),
{climb('inner_climb', 'starts', 'low_runs')},
starts_above AS (SELECT r, 'top' AS tree, 0 AS level, s.pos, s.n, fold, proof FROM inner_climb c JOIN subroots s ON c.tree = s.grp WHERE c.n = 1),
{climb('outer_climb', 'starts_above', 'high_runs')}
SELECT doc_id, p.digest AS leaf, s.digest AS subroot, h.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h.digest AS verified
FROM placed p JOIN subroots s ON p.tree = s.grp JOIN outer_climb o ON p.r = o.r AND o.n = 1 CROSS JOIN (SELECT digest FROM high WHERE n = 1) h"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


QUERIES = {
    "op1_hierarchical_packing": op1_hierarchical_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_shingle_join": op3_shingle_join,
    "op4_decontaminate": op4_decontaminate,
    "d5_near_duplicates": d5_near_duplicates,
    "op5_toxicity_gru": op5_toxicity_gru,
    "op6_link_trust": op6_link_trust,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_mil": op9_quality_mil,
    "op10_language_crf": op10_language_crf,
    "op11_site_style": op11_site_style,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {"op2_secret_scan": _op2_sql(), "op6_link_trust": _op6_sql(), "op7_license_scan": _op7_sql(), "op8_quality_rules": _op8_sql(), "op12_merkle_manifest": _op12_sql()}
