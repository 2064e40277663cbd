r"""Secret scans with multipart credential linking. DataFrame functions only.

Base spans are found in every whole text: assignments of passwords and tokens (assign), access
identifiers (access) and long runs of hexadecimal digits (hex). Three kinds of weak candidates
are looked for as well: named identities, opaque tokens and endpoints. A weak candidate says
little by itself; it is reported only if complementary parts of a credential stand in its scope,
which is the same document at no more than SCOPE code points:

* an identity, with a secret part (assign, hex or opaque),
* an opaque token, with an identifying part (access or identity),
* an endpoint, with both.

Positions come from the lengths of the matches and of what lies between them, summed up per
document and kind. Parts meet in an interval join: each interval is entered in the buckets of
BUCKET code points that it touches, so the join is on (document, bucket), and a bucket holds as
many parts as find place in it. Only texts with a match take part in it, as positions without texts.

Nulls, ties and repeats: a null text is empty. A weak candidate that overlaps a base span is left
out. Spans are in order of start, then kind. Each row is scanned by itself, so repeated rows, and
rows with a null doc_id, have their own results. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table, texts_of, work_folder, written

#: The base patterns, in the order of the kinds.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The failing matches of the two simple patterns are told by their length alone.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: The weak kinds.
IDENTITY = r"""(?i:(?:client|account|access|user|key)[_-]?(?:id|name))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"(?i:https?)://[A-Za-z0-9.-]+(?::[0-9]+)?"
PATTERNS = (ASSIGN, LONG_ACCESS, LONG_HEX, IDENTITY, OPAQUE, ENDPOINT)
KINDS = ("assign", "access", "hex", "identity", "opaque", "endpoint")
BASE = 3
MIN_VALUE = 6
SCOPE = 300
BUCKET = 1024
NAME = "element_at(array('" + "','".join(KINDS) + "'), kind + 1)"


def matches_of(docs: DataFrame) -> DataFrame:
    """doc_id, row and hits (kind, number, gap before, match) of every document."""
    text = F.coalesce("text", F.lit(""))

    def hits(kind, pattern):
        found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                             F.transform(F.split(text, pattern, -1), F.length).alias("gap"))
        rows = F.transform(found, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), x["gap"].cast("long").alias("gap"), x["match"].alias("match")))
        none = F.array().cast("array<struct<kind:int,number:int,gap:bigint,match:string>>")
        return F.when(text.rlike(pattern), F.filter(rows, lambda x: x["match"].isNotNull())).otherwise(none)
    return texts_of(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(
        *(hits(k, p) for k, p in enumerate(PATTERNS))).alias("hits"))


def spans_of(found: DataFrame) -> DataFrame:
    """row, kind, start, end of all candidates."""
    before = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    value = F.regexp_extract("match", ASSIGN, 2)
    opaque = F.col("match").rlike("[0-9]") & F.col("match").rlike("[a-z]") & F.col("match").rlike("[A-Z]")
    return found.where(F.size("hits") > 0).select("row", F.inline("hits")).select(
        "row", "kind", "match", F.length("match").cast("long").alias("size"),
        F.sum(F.col("gap") + F.length("match")).over(before).alias("end")).where(
        F.when(F.col("kind") == 0, F.length(value) >= MIN_VALUE).when(F.col("kind") == 4, opaque).otherwise(True)).select(
        "row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def near(weak: DataFrame, parts: DataFrame, reach: int) -> DataFrame:
    """Pairs of ``weak`` and ``parts`` less than ``reach`` + 1 code points apart (-1: overlapping).

    A pair that shares several buckets comes several times.
    """
    def buckets(lo, hi):
        return F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET))).alias("bucket")
    wide = weak.select("*", buckets(F.col("start") - max(reach, 0), F.col("end") + max(reach, 0)))
    other = parts.select("row", F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    other = other.select("*", buckets(F.col("start2"), F.col("end2")))
    return wide.join(other, ["row", "bucket"]).where(
        (F.col("start2") - F.col("end") <= reach) & (F.col("start") - F.col("end2") <= reach))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``spans`` that complementary parts vouch for."""
    base, weak = spans.where(F.col("kind") < BASE), spans.where(F.col("kind") >= BASE)
    key = ["row", "kind", "start", "end"]
    weak = weak.join(near(weak, base, -1).select(key).distinct(), key, "left_anti")
    kind2 = F.col("kind2")
    parts = base.unionByName(weak).where(F.col("kind") != KINDS.index("endpoint"))
    seen = near(weak, parts, scope).groupBy(key).agg(
        F.max(kind2.isin(0, 2, 4)).alias("secret"), F.max(kind2.isin(1, 3)).alias("identity"))
    return seen.where(F.when(F.col("kind") == 3, F.col("secret")).when(F.col("kind") == 4, F.col("identity"))
                      .otherwise(F.col("secret") & F.col("identity"))).select(key)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, row, spans (array of start, kind, end) of every row of ``docs``."""
    folder = work_folder(docs.sparkSession, "secrets")
    found = written(matches_of(docs), folder, "matches")
    spans = written(spans_of(found), folder, "spans")
    kept = spans.where(F.col("kind") < BASE).unionByName(linked(spans, scope)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return found.select("doc_id", "row").join(kept, "row", "left")


def mask_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """The columns of ``docs``; each secret span of the text gives way to ``mask``.

    Overlapping spans are masked as one. The text is cut at the spans by code points.
    """
    hit = F.lit(False)
    for pattern in PATTERNS:
        hit = hit | F.col("text").rlike(pattern)
    hit = F.coalesce(hit, F.lit(False))
    # only texts with a candidate are numbered, written and joined; the others pass as they are
    some = docs.where(hit).select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("number"))
    some = written(some, work_folder(docs.sparkSession, "secrets"), "candidates")
    found = scan_secrets(some.select(F.col("number").alias("doc_id"), F.col("doc.text").alias("text")), scope).where(
        F.col("spans").isNotNull()).select(F.col("doc_id").alias("number"), "spans")
    # what stays: for each span the text since the furthest end so far
    text = F.expr(f"""
      CASE WHEN spans IS NULL THEN doc.text ELSE
        aggregate(spans, named_struct('out', array(''), 'at', 0L),
          (s, x) -> named_struct(
            'out', IF(x.start < s.at, s.out, s.out || array(substr(doc.text, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT)), '{mask}')),
            'at', greatest(s.at, x.end)),
          s -> concat(array_join(s.out, ''), substr(doc.text, CAST(s.at + 1 AS INT)))) END""")
    masked = some.join(found, "number", "left").select(
        *(text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
    return docs.where(~hit).unionByName(masked)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint>>)"))
    rows = rows.select("doc_id", spans.alias("spans"))

    def count(kind):
        return F.expr(f"CAST(size(filter(spans, x -> x.kind = {KINDS.index(kind)})) AS BIGINT)").alias(f"n_{kind}")

    def told(which):
        name = NAME.replace("kind", "x.kind")
        return F.expr(f"array_join(transform({which}, x -> concat({name}, ':', x.start, ':', x.end)), ',')")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(told(f"filter(spans, x -> x.kind < {BASE})"), 256).alias("base_sha256"),
                       told("spans").alias("spans"))


def _sql_hits(kind: int, pattern: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start
    FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM d
      WHERE regexp_matches(text, '{p}')))) WHERE {keep}"""


OP2_SQL = ("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS MATERIALIZED ("
           + " UNION ALL ".join([
               _sql_hits(0, ASSIGN, "length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 6"),
               _sql_hits(1, LONG_ACCESS), _sql_hits(2, LONG_HEX), _sql_hits(3, IDENTITY),
               _sql_hits(4, OPAQUE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"),
               _sql_hits(5, ENDPOINT)]) + f"""),
w AS (SELECT * FROM s WHERE kind >= 3 AND NOT EXISTS (
        SELECT 1 FROM s b WHERE b.kind < 3 AND b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
p AS (SELECT * FROM s WHERE kind < 3 UNION ALL SELECT * FROM w WHERE kind < 5),
seen AS (
  SELECT w.doc_id, w.kind, w.start, w.stop, bool_or(p.kind IN (0, 2, 4)) AS secret, bool_or(p.kind IN (1, 3)) AS named
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.start - w.stop <= {SCOPE} AND w.start - p.stop <= {SCOPE} GROUP BY ALL),
k AS (
  SELECT * FROM s WHERE kind < 3 UNION ALL
  SELECT doc_id, kind, start, stop FROM seen
  WHERE CASE kind WHEN 3 THEN secret WHEN 4 THEN named ELSE secret AND named END),
t AS (SELECT *, ['assign', 'access', 'hex', 'identity', 'opaque', 'endpoint'][kind + 1] || ':' || start || ':' || stop AS told FROM k)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(told, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(told, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id""")
