"""Scalar expressions over records: numbers, ranges, digests, texts and maps. All are built-in functions unless said otherwise."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIB = 1 << 30


def finite(value: Column) -> Column:
    """value as a double, or null if it is no finite number. A boolean is no number: cast from its JSON text, not from the flag."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def json_number(raw: Column, path: str) -> Column:
    """The finite number at a path of a JSON text; null for booleans, strings, integers too large for a double and absent paths."""
    token = F.get_json_object(raw, path)
    return F.when(token.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), finite(token))


def nonnegative(value: Column) -> Column:
    number = finite(value)
    return F.when(number >= 0, number)


def integral(text: Column) -> Column:
    """A count written in digits alone."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of named scalar columns with sorted keys; nulls are written."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_digest(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def ascii_json(raw: Column, spaced: bool = False, ascii_only: bool = True) -> Column:
    """A JSON text rewritten with sorted keys and ASCII escapes, compact or with default spaces (a pandas UDF: no built-in writes escapes)."""
    separators = (", ", ": ") if spaced else (",", ":")

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=ascii_only, separators=separators))

    return rewrite(raw)


def digest_key(prefix: str, *parts: Column, length: int = 12) -> Column:
    """prefix, a dash and the first digits of the parts' digest."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length))


def list_digest(values: Column) -> Column:
    """Digest of a list whose order does not count."""
    return F.sha2(F.array_join(F.array_sort(values), "\n"), 256)


def map_digest(values: Column) -> Column:
    """Digest of a map, by key."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "\n"), 256)


def parse_ranges(text: Column) -> Column:
    """'0-3,7' as an array of integers."""
    one = lambda part: F.sequence(F.split(part, "-")[0].cast("int"), F.element_at(F.split(part, "-"), -1).cast("int"))
    return F.when(F.trim(text) == "", F.array().cast("array<int>")).otherwise(F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), one)))


def as_ranges(df: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """Per group the distinct numbers as text of ranges, '5-9,15': islands of consecutive numbers by row number."""
    rows = df.select(*group, number).where(F.col(number).isNotNull()).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*group).orderBy(number))
    ends = rows.withColumn("island", island).groupBy(*group, "island").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("text")))).alias("r"))
    return listed.select(*group, F.array_join("r.text", ",").alias("ranges"))


def rounding_gib(tokens: Column, total_bytes: Column) -> Column:
    """Whole GiB that tokens exceed the bytes by, not below 0."""
    return F.greatest(F.lit(0), tokens - F.floor(total_bytes / GIB))


def remainder(peak: Column, owned: Column) -> Column:
    """What is still to be had of a peak; negative inputs are an error, and unknown ones leave it unknown."""
    checked = F.assert_true(F.coalesce((peak >= 0) & (owned >= 0), F.lit(True)), F.lit("a negative amount")).isNull()
    return F.when(checked & peak.isNotNull() & owned.isNotNull(), F.greatest(F.lit(0), peak - owned))


def external_bytes(total: Column, available: Column, resident: Column) -> Column:
    return F.greatest(F.lit(0), total - available - resident)


def capacity_gib(maximum: Column, free: Column, floor: Column, allowance: Column, held: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(maximum), F.floor((free - floor - allowance + held) / GIB)))


def utc_timestamp(text: Column) -> Column:
    """An ISO time with a zone as a timestamp; null without a zone."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00")))


def priority(labels: Column, title: Column, order: Sequence[str]) -> Column:
    """The first of `order` among the labels, else the one that the title begins with in brackets or before a colon."""
    named = F.array_intersect(F.array(*[F.lit(p) for p in order]), labels)
    prefix = F.upper(F.regexp_extract(title, r"^\s*\[?(?i:(" + "|".join(order) + r"))[\]:]", 1))
    return F.coalesce(F.get(named, F.lit(0)), F.when(prefix != "", prefix))


def references(text: Column) -> Column:
    """Distinct numbers after '#', in order of the text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#(\d+)"), F.lit(1)), lambda n: n.cast("bigint")))


def claims_without_proof(text: Column, claim: str = r"(?i)\b(fixed|resolved|passes|verified)\b", proof: str = r"https?://\S+|\b[0-9a-f]{40}\b") -> Column:
    return text.rlike(claim) & ~text.rlike(proof)


def literal_text(text: Column) -> Column:
    """Untrusted text as plain inline text: no line breaks, markup characters escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), r"([\\`*_{}\[\]<>()#|!])", r"\\$1")


def first_group(text: Column, pattern: str, kind: str = "int") -> Column:
    """The first group of a pattern, cast; null where it does not match."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.try_cast(kind))


def cascade(*arms: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first arm whose condition holds."""
    out = None
    for condition, value in arms:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def first_int(raw: Column, *paths: str) -> Column:
    """The first integer among several paths of a JSON text."""
    return F.coalesce(*[integral(F.regexp_replace(F.get_json_object(raw, p), "^-", "")) * F.when(F.startswith(F.get_json_object(raw, p), F.lit("-")), -1).otherwise(1) for p in paths])


def funded_remainder(need: Column, funded: Column) -> Column:
    """Per kind what funding leaves of a need; kinds that are covered are dropped."""
    return F.map_filter(F.map_zip_with(need, funded, lambda _, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))), lambda _, v: v > 0)


def without_fields(documents: Column, *names: str) -> Column:
    """A map of structs, each without the named fields: what is left tells whether the meaning changed."""
    return F.transform_values(documents, lambda _, v: v.dropFields(*names))


def inline_stream(text: Column, limit: int) -> Column:
    """struct(text cut to limit characters, full bytes, was_cut)."""
    return F.struct(F.substring(text, 1, limit).alias("text"), F.octet_length(text).alias("full_bytes"), (F.length(text) > limit).alias("was_cut"))


def allowed_view(raw: Column, allowed: Sequence[str], depth: int = 6, width: int = 200) -> Column:
    """A JSON text with only allow-listed keys, cut at a depth and at a string length (a pandas UDF: the nesting has no fixed schema)."""
    names = set(allowed)

    def view(value, level):
        if level > depth:
            return None
        if isinstance(value, dict):
            return {k: view(v, level + 1) for k, v in sorted(value.items()) if k in names}
        if isinstance(value, list):
            return [view(v, level + 1) for v in value]
        return value[:width] if isinstance(value, str) else value

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else json.dumps(view(json.loads(t), 0), sort_keys=True, separators=(",", ":")))

    return run(raw)


def package_of(path: Column) -> Column:
    """The folder of a path, or of a label before its colon."""
    return F.when(F.contains(path, F.lit(":")), F.regexp_replace(F.substring_index(path, ":", 1), "^//", "")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def normal_strings(values: Column) -> Column:
    """Distinct non-empty strings in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")))


def owner_terms(kinds: Column, tier: Column) -> Column:
    """map kind@tier -> window of an array of (kind, window), zero windows dropped."""
    return F.map_from_entries(F.transform(F.filter(kinds, lambda k: k["window"] > 0), lambda k: F.struct(F.concat_ws("@", k["kind"], tier), k["window"])))


def queue_row(action: Column) -> Column:
    """A nested action as a flat queue row; what is absent is null."""
    return F.struct(
        action["action_key"].alias("action_key"),
        action["published_unix"].alias("published_unix"),
        action["params"]["demand"].alias("demand"),
        action["params"]["placement"]["tags"].alias("tags"),
        F.coalesce(action["params"]["retry_policy"]["max_attempts"], F.lit(1)).alias("max_attempts"),
    )


def label_span(total_bytes: Column) -> Column:
    """The span of a batch in its manifest's own coordinates; null for a total that is not positive."""
    return F.when(total_bytes > 0, F.struct(F.lit("output-manifest").alias("coordinate_space"), F.lit(0).cast("long").alias("start_bytes"), total_bytes.cast("long").alias("end_bytes")))
