"""Registered queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.llm.decontamination import contaminated
from rillstat.llm.fingerprints import compared
from rillstat.llm.hard_negatives import mined
from rillstat.llm.manifest import folded, manifest, siblings, spelled as spelled_fields
from rillstat.llm.metric_join import jaccard_components
from rillstat.llm.mixing import mixed
from rillstat.llm.near_duplicates import near_duplicates
from rillstat.llm.preferences import preferences, spliced_pairs
from rillstat.llm.quality import quality
from rillstat.llm.secrets import secret_spans, spelled
from rillstat.llm.sharding import sharded
from rillstat.llm.toxicity import toxicity
from rillstat.llm.url_filter import Rule, host_of, judged


#: Targets of the mixture: the power of each marginal's shares.
TARGETS = {"source": 0.5, "lang": 0.5, "topic": 0.5}


#: The rules that pages are judged by.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Words in a host that put its pages on the list to block; the tables hold no list of their own.
LISTED_HOSTS = ("casino", "bets", "pills")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score of toxicity."""
    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every place where a document holds a benchmark item."""
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its secrets."""
    found = secret_spans(_table(spark, folder, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda span: span["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(spelled(of("assign", "access", "hex")), 256).alias("base_sha256"),
        spelled("spans").alias("spans"),
        F.size(of("literal")).cast("bigint").alias("n_literal"),
    )


def op4_mix_to_targets(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of the documents with the square roots of the shares of sources, languages and topics for targets."""
    chosen = mixed(_table(spark, folder, "documents"), TARGETS)
    return chosen.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"),
        F.col("mix_probability").alias("probability"), F.col("mix_weight").alias("weight"),
    )


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(_table(spark, folder, "documents"))


def op6_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with the second half of the next one."""
    made = preferences(spliced_pairs(_table(spark, folder, "conversations")))

    def spelled_mask(mask: str):
        return F.array_join(F.transform(mask, lambda span: F.concat_ws("-", span["start"], span["end"])), ",").alias(mask)

    return made.select(
        F.col("pair_id").alias("conv_id"), "common", "prompt", "chosen", "rejected", spelled_mask("chosen_mask"), spelled_mask("rejected_mask")
    )


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score of quality."""
    return quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return compared(_table(spark, folder, "documents"))


def op9_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its shard of 16 and its slot there."""
    return sharded(_table(spark, folder, "documents"), carry=False)


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its verdict, by the rules or by the list of pages on listed hosts."""
    pages = _table(spark, folder, "pages")
    bad = pages.filter(host_of("url").rlike("|".join(LISTED_HOSTS))).select("url")
    return judged(pages, bad, RULES)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, where every seventh has the next label."""
    rows = _table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf and proof, and whether the proof holds where some counts are tampered with."""
    docs = _table(spark, folder, "documents")

    def leaf(n_chars):
        return F.sha2(spelled_fields(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")), 256)

    count = F.col("n_chars").cast("decimal(20,0)")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    keep = {"doc_id": F.col("doc_id"), "forged": F.when(tampered, leaf(count + 1))}
    made = manifest(docs, leaf(count), "lang", ["doc_id"], keep)
    made = made.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), "path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_metric_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of documents with four fifths of their shingles in common."""
    return jaccard_components(_table(spark, folder, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_mix_to_targets": op4_mix_to_targets,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_preference_format": op6_preference_format,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_sampled_splitters": op9_sampled_splitters,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_metric_jaccard_join": op13_metric_jaccard_join,
}

def _linked(numerator: int) -> str:
    """Shingle sets, links at ``numerator`` hundredths and the least document that each reaches."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {numerator} * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


ORACLES = {
    "op5_minhash_near_dedup": _linked(75) + """
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
""",
    "op6_preference_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
h AS (SELECT conv_id, greatest(1, count(*) // 2) AS half FROM t GROUP BY conv_id),
sides AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL SELECT t.conv_id, 'rejected', turn, role, text FROM t JOIN h USING (conv_id) WHERE turn < half
  UNION ALL SELECT h.conv_id, 'rejected', turn, role, text FROM t JOIN h ON t.conv_id - 1 = h.conv_id WHERE turn >= half),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS pos FROM sides),
c AS (SELECT * FROM placed WHERE side = 'chosen'), r AS (SELECT * FROM placed WHERE side = 'rejected'),
pairs AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
    coalesce(min(CASE WHEN c.role = r.role AND c.text = r.text THEN NULL ELSE coalesce(c.pos, r.pos) END) - 1, max(c.pos)) AS common
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos GROUP BY 1),
shown AS (
  SELECT conv_id, side, role, text, pos, common, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS line
  FROM placed JOIN pairs USING (conv_id)),
rest AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, side ORDER BY pos) AS stop FROM shown WHERE pos > common),
done AS (
  SELECT conv_id, side, string_agg(line, '' ORDER BY pos) AS completion,
    string_agg(concat(stop - length(text) - 8, '-', stop), ',' ORDER BY pos) FILTER (WHERE role = 'assistant') AS mask
  FROM rest GROUP BY conv_id, side),
prompts AS (SELECT conv_id, string_agg(line, '' ORDER BY pos) AS prompt FROM shown WHERE side = 'chosen' AND pos <= common GROUP BY conv_id)
SELECT p.conv_id, p.common::BIGINT AS common, coalesce(prompt, '') AS prompt,
  coalesce(x.completion, '') AS chosen, coalesce(y.completion, '') AS rejected, coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask
FROM pairs p LEFT JOIN prompts USING (conv_id) LEFT JOIN done x ON x.conv_id = p.conv_id AND x.side = 'chosen'
LEFT JOIN done y ON y.conv_id = p.conv_id AND y.side = 'rejected'
""",
    "op10_url_filter": r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, concat(regexp_replace(host, '^www\.', ''), regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '')) AS address FROM b),
l AS (SELECT DISTINCT address FROM c WHERE regexp_matches(host, 'casino|bets|pills') AND address <> ''),
j AS (SELECT c.*, l.address IS NOT NULL AS listed FROM c LEFT JOIN l USING (address)),
r AS (SELECT *, concat('.', host) AS h FROM j),
s AS (SELECT *, CASE
  WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
  WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM s
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
""",
    "op12_merkle_manifest": """
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: list_prepend(256 + ascii(c), [512, 512, 512, 512, 512, 512, 512, 512])))::UBIGINT[]),
    lambda a, x: CASE WHEN x < 512 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM documents),
d AS (SELECT *, coalesce(concat('=', lang), '') AS g, concat(
    coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
    coalesce(concat(strlen(lang), ':', lang), '-')) AS head, coalesce(concat(strlen(text), ':', text), '-') AS tail
  FROM documents JOIN crc USING (doc_id)),
t AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos,
    sha256(concat(head, coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'), tail)) AS leaf,
    sha256(concat(head, coalesce(concat(strlen((n_chars + 1)::VARCHAR), ':', n_chars + 1), '-'), tail)) AS forged,
    xor(c, 4294967295::UBIGINT) % 7 = 0 AS bad FROM d),
nodes AS (
  SELECT g, 0 AS lev, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM t
  UNION ALL SELECT g, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, lev, pos // 2),
subs AS (SELECT g, h, lev FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lev, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n FROM subs
  UNION ALL SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY lev, pos // 2),
places AS (SELECT g, h AS subroot, lev AS depth, row_number() OVER (ORDER BY g) - 1 AS spot FROM subs),
steps AS (
  SELECT t.doc_id, n.lev, n.pos < (t.pos >> n.lev) AS lefthand, n.h FROM t JOIN nodes n ON n.g = t.g AND n.pos = xor(t.pos >> n.lev, 1)
  UNION ALL SELECT t.doc_id, depth + tops.lev, tops.pos < (spot >> tops.lev), tops.h
  FROM t JOIN places USING (g) JOIN tops ON tops.pos = xor(spot >> tops.lev, 1)),
high AS (SELECT doc_id, depth + (SELECT max(lev) FROM tops) AS levels FROM t JOIN places USING (g)),
fold AS (
  SELECT doc_id, 0 AS lev, CASE WHEN bad THEN forged ELSE leaf END AS h FROM t
  UNION ALL SELECT f.doc_id, f.lev + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.lefthand THEN concat(s.h, f.h) ELSE concat(f.h, s.h) END)
  FROM fold f JOIN high USING (doc_id) LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.lev = f.lev WHERE f.lev < levels),
proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY lev)) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT t.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM t JOIN places USING (g) CROSS JOIN (SELECT h AS root FROM tops WHERE n = 1) JOIN high USING (doc_id)
JOIN fold ON fold.doc_id = t.doc_id AND fold.lev = levels LEFT JOIN proofs ON proofs.doc_id = t.doc_id
""",
    "op13_metric_jaccard_join": _linked(80) + """
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
""",
}
