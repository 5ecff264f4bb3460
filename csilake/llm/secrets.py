"""Secret scan with ownership frequency over the whole corpus.

Every text is searched for assignments, access keys and long hex runs (the base kinds), and for further long mixed
tokens. Each candidate's value is hashed, and the corpus is asked how many distinct owners, repositories and documents
hold it. A value is a widely copied example if SHARED_OWNERS owners hold it, or SHARED_REPOSITORIES repositories (one owner's too), or
SHARED_DOCUMENTS documents, as when one owner repeats an example all over; a rarer one looks live. The
frequency adds spans: a mixed token outside all base spans counts as a secret (kind ``owned``) if one owner
alone holds it and it isn't such an example. Base spans stay whatever their frequency; ``n_shared`` and ``n_live`` tell them apart.

A null or empty text has no spans. Null owners and repositories count as one. Repeated rows repeat their result, and each is a document.
Counting goes by (value, owner, repository), then (value, owner), then value, each combined before its shuffle, so a value
that a third of all rows hold is no hot task. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import stored, table, unused

# The base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")

MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: From so many owners, repositories or documents on, a value is an example.
SHARED_OWNERS, SHARED_REPOSITORIES, SHARED_DOCUMENTS = 3, 5, 20
#: Bits of entropy per character that a mixed token has at least.
ENTROPY = 3.5

_CANDIDATE = "struct<kind:int,start:int,end:int,value:bigint>"
FOUND = f"doc_id bigint, text_key string, n_assign bigint, n_access bigint, n_hex bigint, base string, candidates array<{_CANDIDATE}>, owner string, repository string"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_random(token: str) -> bool:
    kinds = (str.isdigit, str.isupper, str.islower)
    if not all(any(map(kind, token)) for kind in kinds):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= ENTROPY


def mixed_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long random-looking tokens that touch no base span."""
    free = ((m.start(), 3, m.end(), m[0]) for m in MIXED.finditer(text) if looks_random(m[0]))
    return [x for x in free if not any(s < x[2] and x[0] < e for s, _, e, _ in base)]


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _key(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, owner, repository in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            base = base_spans(text)
            every = base + mixed_spans(text, base)
            count = Counter(k for _, k, _, _ in base)
            rows.append(
                {
                    "doc_id": doc,
                    "text_key": hashlib.sha256(text.encode()).hexdigest() if every else None,
                    **{f"n_{KINDS[k]}": count[k] for k in range(3)},
                    "base": joined(base),
                    "candidates": [{"kind": k, "start": s, "end": e, "value": _key(v)} for s, k, e, v in every],
                    "owner": owner,
                    "repository": repository,
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.string()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base", pa.string()),
        ("candidates", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))),
        ("owner", pa.string()),
        ("repository", pa.string()),
    ]
)


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """Candidates of each row, in a table of the shared folder: the texts are searched once."""
    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
    )
    return stored(columns.mapInArrow(_scan, FOUND), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, n_documents over all rows. A repository is known by its name and owner; a document counts once."""
    held = found.select("owner", "repository", F.explode(F.array_distinct("candidates.value")).alias("value"))
    return (
        held.groupBy("value", "owner", "repository")
        .agg(F.count("*").alias("n"))
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
        .groupBy("value")
        .agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_documents"))
    )


def widely_copied() -> Column:
    return (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_repositories") >= SHARED_REPOSITORIES) | (F.col("n_documents") >= SHARED_DOCUMENTS)


def judged(found: DataFrame) -> DataFrame:
    """The scanned rows with all their spans: ``spans`` as text, ``ranges`` as an array, and the counts by ownership."""
    each = found.filter("text_key is not null").dropDuplicates(["text_key"]).select("text_key", F.explode("candidates").alias("c"))
    known = each.select("text_key", "c.*").join(ownership(found), "value")
    known = known.withColumn("shared", widely_copied())
    kept = known.filter((F.col("kind") < 3) | ((F.col("n_owners") == 1) & ~F.col("shared")))
    names = F.array(*map(F.lit, KINDS))
    by_text = kept.groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("ranges"),
        F.count_if(F.col("kind") == 3).alias("n_owned"),
        F.count_if((F.col("kind") < 3) & F.col("shared")).alias("n_shared"),
        F.count_if((F.col("kind") < 3) & ~F.col("shared")).alias("n_live"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
        F.max("n_documents").alias("most_documents"),
    )
    some = found.filter("text_key is not null").drop("candidates").join(by_text, "text_key", "left")
    none = found.filter("text_key is null").drop("candidates")
    whole = some.unionByName(none, allowMissingColumns=True)
    text = F.array_join(F.transform("ranges", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    counts = ("n_owned", "n_shared", "n_live", "most_owners", "most_repositories", "most_documents")
    return whole.withColumn("spans", F.coalesce(text, F.lit(""))).fillna(0, list(counts))


def redact(docs: DataFrame, marker: str = "[SECRET]", owner: str = "source", repository: str = "lang") -> DataFrame:
    """The rows with each secret span replaced; overlapping spans become one marker. Other columns stay.

    Only texts that hold a secret take part in the join; ``n_chars`` follows the new text if there is one.
    """
    ranges = judged(scan(docs, owner, repository)).filter(F.size("ranges") > 0).select("text_key", "ranges").dropDuplicates(["text_key"])
    key, spans = unused(docs, "_key", "_ranges")
    keyed = docs.withColumn(key, F.sha2("text", 256))
    marked = keyed.join(ranges.withColumnsRenamed({"text_key": key, "ranges": spans}), key, "left")

    def cut(state, x):
        far = F.greatest(state["at"], x["end"])
        apart = x["start"] >= state["at"]
        piece = F.substring(F.col("text"), state["at"] + 1, x["start"] - state["at"])
        done = F.when(apart, F.concat(state["out"], piece, F.lit(marker))).otherwise(state["out"])
        return F.struct(done.alias("out"), far.alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    new = F.aggregate(spans, start, cut, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    out = marked.withColumn("text", F.when(F.col(spans).isNotNull(), new).otherwise(F.col("text"))).drop(key, spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rows = judged(scan(table(spark, folder, "documents")))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_owned", "n_shared", "n_live", "most_owners", "most_repositories", "most_documents"
    )


#: The same by DuckDB: matches by pattern, their places from the lengths of what lies between them, holders by distinct counts over all rows.
OP3_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source::VARCHAR, '') AS owner, coalesce(lang::VARCHAR, '') AS repository FROM documents),
assign AS (SELECT '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS a),
cut AS (
  SELECT r, 0 AS kind, regexp_split_to_array(t, a) AS p, regexp_extract_all(t, a) AS m, regexp_extract_all(t, a, 2) AS v FROM d, assign
  UNION ALL SELECT r, 1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS x, x FROM d
  UNION ALL SELECT r, 2, regexp_split_to_array(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') AS x, x FROM d
  UNION ALL SELECT r, 3, regexp_split_to_array(t, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}') AS x, x FROM d
),
found AS MATERIALIZED (
  SELECT r, kind, v[i] AS v, len(m[i]) AS n, list_sum(list_transform(p[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT AS s
  FROM cut, unnest(range(1, len(m) + 1)) AS t(i)
),
base AS MATERIALIZED (SELECT r, kind, v, s, s + n AS e FROM found WHERE (kind = 0 AND len(v) >= 6) OR (kind = 1 AND n >= 20) OR kind = 2),
mixed AS (
  SELECT r, kind, v, s, s + n AS e FROM found WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
    AND list_aggregate(string_split(v, ''), 'entropy') >= 3.5 AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = found.r AND base.s < found.s + found.n AND found.s < base.e)
),
each AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM mixed),
held AS (
  SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories, count(DISTINCT r) AS n_documents FROM each JOIN d USING (r) GROUP BY v
),
known AS (SELECT *, n_owners >= 3 OR n_repositories >= 5 OR n_documents >= 20 AS shared FROM each JOIN held USING (v)),
kept AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS span FROM known WHERE kind < 3 OR (n_owners = 1 AND NOT shared)),
by_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind, e) AS spans,
    count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (kind < 3 AND shared) AS n_shared, count(*) FILTER (kind < 3 AND NOT shared) AS n_live,
    max(n_owners) AS most_owners, max(n_repositories) AS most_repositories, max(n_documents) AS most_documents
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_shared, 0) AS n_shared, coalesce(n_live, 0) AS n_live,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories, coalesce(most_documents, 0) AS most_documents
FROM d LEFT JOIN by_row USING (r)
"""
