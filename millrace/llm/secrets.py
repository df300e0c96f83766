"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Credential-shaped spans are found by pattern; candidates are then hashed, and each hash is counted over the
whole corpus by distinct repositories and distinct owners. A value that many owners or many repositories carry is a copied
example; one that a single owner holds, in few repositories, looks live. Pattern spans are always reported; long opaque tokens, which no
pattern names, are reported as spans only where ownership marks them live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, text_or_empty, written

#: Fixed values of the scan: the kinds, in order, and their patterns.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN = 8
#: A long token of letters and digits; its kind comes after the others.
OPAQUE = r"[A-Za-z0-9_-]{24,}"
#: A value held by at most so many owners, in at most so many repositories, looks live.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 3

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _spans(text: str, kind: str, rank: int, pattern: str, group: int, least: int, test: str = "true") -> Column:
    """Leftmost non-overlapping matches of pattern whose group is at least `least` long, with code point places.

    The pieces between the matches and the matches alternate through the text, so their running length gives the
    places. Texts without a match cost one search.
    """
    p = f"r'{pattern}'"
    return F.expr(
        f"""CASE WHEN {text} RLIKE {p} THEN aggregate(
          transform(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})), z -> named_struct('gap', z.`0`, 'hit', z.`1`, 'value', z.`2`)),
          named_struct('at', 0, 'out', CAST(array() AS {_SPAN})),
          (a, x) -> CASE WHEN x.hit IS NULL THEN a ELSE named_struct(
            'at', a.at + length(x.gap) + length(x.hit),
            'out', CASE WHEN length(x.value) >= {least} AND {test} THEN concat(a.out, array(named_struct(
                'start', a.at + length(x.gap), 'rank', {rank}, 'kind', '{kind}', 'end', a.at + length(x.gap) + length(x.hit), 'value', x.value)))
              ELSE a.out END) END,
          a -> a.out)
        ELSE CAST(array() AS {_SPAN}) END"""
    )


def _digest(spans: str) -> str:
    return f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def _drop_values(spans: str) -> str:
    return f"transform({spans}, s -> named_struct('start', s.start, 'rank', s.rank, 'kind', s.kind, 'end', s.end))"


def scan(docs: DataFrame) -> DataFrame:
    """docs' rows with the spans of each kind: columns s_assign, s_access, s_hex and s_opaque are added.

    Opaque tokens that hold both letters and digits and overlap no span of the other kinds are kept.
    """
    docs = docs.withColumn("s_text", text_or_empty())
    docs = docs.withColumn("s_assign", _spans("s_text", "assign", 0, ASSIGN, 2, ASSIGN_MIN))
    docs = docs.withColumn("s_access", _spans("s_text", "access", 1, ACCESS, 0, 16))
    docs = docs.withColumn("s_hex", _spans("s_text", "hex", 2, HEX, 0, 32))
    docs = docs.withColumn("s_base", F.expr("concat(s_assign, s_access, s_hex)"))
    docs = docs.withColumn("s_opaque", _spans("s_text", "opaque", 3, OPAQUE, 0, 24, "x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]'"))
    return docs.withColumn("s_opaque", F.expr("filter(s_opaque, o -> NOT exists(s_base, b -> b.start < o.end AND o.start < b.end))")).drop("s_text")


def ownership(candidates: DataFrame) -> DataFrame:
    """Per hash of candidates(hash, owner, repository): hash, n_rows, n_owners, n_repositories.

    Each step is a grouped count with partial sums on the reading side, so a value in a third of all rows sends one
    row per task and (owner, repository). A null owner or repository counts as one of its own.
    """
    one = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_repo = one.groupBy("hash", "repository").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n_rows"))
    by_owner = one.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return by_repo.join(by_owner, "hash").select("hash", "n_rows", "n_owners", "n_repositories")


def judged(docs: DataFrame, owner: str = "source", repository: str = "doc_id", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES, carry: list[str] | None = None) -> DataFrame:
    """Each row of docs (or its columns in carry) as a struct `row`, with s_base (pattern spans), s_added (live opaque spans), n_live and n_copied (their numbers of values by ownership).

    Null text: no spans. Repeated rows: each is judged, as one repository where they share the repository column.
    Null owner or repository: one of its own. Very long texts cost in proportion to their length. Empty input: no rows. The corpus-wide counts come from all
    rows. The patterns run once, on the way into a table; rows without a candidate are then passed on as they are, and only the others are joined.
    """
    found = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(owner).cast("string").alias("row_owner"), F.col(repository).cast("string").alias("row_repository"), F.col("text"))
    found = scan(found)
    found = found.select(
        F.monotonically_increasing_id().alias("row_key"),
        "row",
        "row_owner",
        "row_repository",
        *[F.size(f"s_{kind}").cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.expr(_drop_values("s_base")).alias("s_base"),
        F.expr("transform(concat(s_base, s_opaque), s -> named_struct('hash', sha2(s.value, 256), 'span', named_struct('start', s.start, 'rank', s.rank, 'kind', s.kind, 'end', s.end)))").alias("s_cands"),
    )
    found = written(found, "scan")
    some = found.where("size(s_cands) > 0")
    exploded = some.select("row_key", F.col("row_owner").alias("owner"), F.col("row_repository").alias("repository"), F.explode("s_cands").alias("c")).select("row_key", "owner", "repository", "c.hash", "c.span")
    facts = written(ownership(exploded), "owners")
    n_facts, n_rows = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    votes = keyed_join(exploded.select("row_key", "hash", "span"), facts, "hash", "n_rows", int(n_rows), int(n_facts))
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    per_doc = votes.groupBy("row_key").agg(
        F.collect_list(F.when(live & (F.col("span.kind") == "opaque"), F.col("span"))).alias("s_added"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live).cast("long")).alias("n_copied"),
    )
    empty = F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)")
    columns = ["row", "n_assign", "n_access", "n_hex", "s_base", "s_added", "n_live", "n_copied"]
    rest = found.where("size(s_cands) = 0").withColumns({"s_added": empty, "n_live": F.lit(0).cast("long"), "n_copied": F.lit(0).cast("long")})
    return some.join(per_doc, "row_key").select(columns).unionByName(rest.select(columns))


def secret_report(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, the counts of base spans by kind, their digest, all spans, and counts of live and copied values.

    Null or empty text: no spans. Null doc_id or source: kept, as a repository or owner of its own. Repeated rows: each
    reported. Equal starts: by kind as listed. Empty input: no rows. Other columns do not matter, whatever their names.
    """
    rows = judged(docs, carry=["doc_id"], **how)
    return rows.select(
        "row.doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.expr(_digest("s_base")), 256).alias("base_sha256"),
        F.expr(_digest("concat(s_base, s_added)")).alias("spans"),
        "n_live",
        "n_copied",
    )


def redact(docs: DataFrame, mask: str = "[secret]", **how) -> DataFrame:
    """docs with every span (base and added) of its text replaced by mask; overlapping spans become one mask.

    All columns are kept, whatever their names; null texts stay null; repeated rows are masked alike; empty input: no rows. Ownership is counted over all of docs.
    """
    columns = docs.columns
    rows = judged(docs, **how).withColumn("s_spans", F.expr("array_sort(concat(s_base, s_added))"))
    cut = f"""aggregate(s_spans, named_struct('at', 0, 'out', ''),
      (a, s) -> CASE WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', concat(a.out, substring(row.text, a.at + 1, s.start - a.at), '{mask}'))
        ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END,
      a -> concat(a.out, substring(row.text, a.at + 1)))"""
    rows = rows.withColumn("s_cut", F.when(F.size("s_spans") > 0, F.expr(cut)).otherwise(F.col("row.text")))
    return rows.select(*[(F.col("s_cut") if c == "text" else F.col("row").getField(c)).alias(c) for c in columns])


def _oracle_spans(kind: str, pattern: str, group: int, least: int, test: str = "true") -> str:
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
      'start': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda x: length(x))), 0) AS INTEGER),
      'kind': '{kind}', 'hit': regexp_extract_all(t, '{pattern}')[i], 'value': regexp_extract_all(t, '{pattern}', {group})[i]}}),
      lambda s: length(s.value) >= {least} AND {test})"""


_JOIN = "array_to_string(list_transform(list_sort(list_transform({0}, lambda s: {{'start': s.start, 'rank': CASE s.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END, 'kind': s.kind, 'end': s.start + length(s.hit)}})), lambda s: concat(s.kind, ':', s.start, ':', s.\"end\")), ',')"

#: The same rows as op10_secrets', by brute force.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT rid, doc_id, source, {_oracle_spans('assign', ASSIGN, 2, ASSIGN_MIN)} AS a, {_oracle_spans('access', ACCESS, 0, 16)} AS c, {_oracle_spans('hex', HEX, 0, 32)} AS h,
    {_oracle_spans('opaque', OPAQUE, 0, 24, "regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Za-z]')")} AS o FROM d
), based AS (
  SELECT rid, doc_id, source, len(a) AS n_assign, len(c) AS n_access, len(h) AS n_hex, list_concat(list_concat(a, c), h) AS base, o FROM found
), kept AS (
  SELECT *, list_filter(o, lambda x: len(list_filter(base, lambda b: b.start < x.start + length(x.hit) AND x.start < b.start + length(b.hit))) = 0) AS opaque FROM based
), cands AS (
  SELECT rid, doc_id, source, unnest(list_concat(base, opaque)) AS s FROM kept
), owners AS (
  SELECT s.value AS v, count(DISTINCT coalesce('s' || source, 'n')) <= {LIVE_OWNERS} AND count(DISTINCT coalesce('d' || doc_id, 'n')) <= {LIVE_REPOSITORIES} AS live FROM cands GROUP BY 1
), added AS (
  SELECT rid, list(s) FILTER (WHERE live AND s.kind = 'opaque') AS added, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
  FROM cands JOIN owners ON s.value = v GROUP BY rid
)
SELECT doc_id, CAST(n_assign AS BIGINT) AS n_assign, CAST(n_access AS BIGINT) AS n_access, CAST(n_hex AS BIGINT) AS n_hex,
  sha256({_JOIN.format('base')}) AS base_sha256, {_JOIN.format("list_concat(base, coalesce(added, []))")} AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM kept LEFT JOIN added USING (rid)
"""
