"""Scalar normalisation: conditions, labels, subject cards, names, buckets, metadata fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for a missing value.
MISSING = ["nan", "none", "null"]
MISSING_FIELD = ["", "unknown", "nan", "none", "null"]


def condition(c: Column) -> Column:
    """'none' for null, '' and words for missing, in any case; nothing is trimmed."""
    return F.when(c.isNull() | (c == "") | F.lower(c).isin(MISSING), "none").otherwise(c)


def condition_profiling(c: Column) -> Column:
    """The profiling scripts' rule: only null, '' and nan are missing."""
    return F.when(c.isNull() | (c == "") | (c == "nan"), "none").otherwise(c)


def condition_routing(c: Column) -> Column:
    """The router's rule: trimmed, in lower case."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def condition_column(c: Column) -> Column:
    """The one-hot columns' rule: trimmed, in lower case, missing words and '' as none."""
    t = condition_routing(c)
    return F.when((t == "") | t.isin(MISSING), "none").otherwise(t)


def tops(df: DataFrame, response: str, group: str) -> DataFrame:
    """_group, _top: the largest absolute value (1 at least) of groups with values outside [0, 1]."""
    r = F.col(response)
    return df.filter((r < 0) | (r > 1)).groupBy(F.col(group).alias("_group")).agg(F.greatest(F.max(F.abs(r)), F.lit(1.0)).alias("_top"))


def soft_labels(df: DataFrame, response: str, group: str, known: DataFrame | None = None) -> DataFrame:
    """label: values outside [0, 1] over the group's largest absolute value (1 at least), then clipped. known: tops() of df, if they are stored."""
    r = F.col(response)
    outside = (r < 0) | (r > 1)
    # one row a group, of a registry; only groups with values outside need theirs. Without the hint all rows would be dealt by group first
    out = df.join(F.broadcast(tops(df, response, group) if known is None else known), F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.withColumn("label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(outside, r / F.col("_top")).otherwise(r)))).drop("_group", "_top")


def hard_labels(r: Column, threshold: float = 0.5) -> Column:
    return F.when(r >= threshold, 1.0).otherwise(0.0)


def subject_card(name: Column, subject_id: Column, **fields: Column) -> Column:
    """'Name: ...' and a line for each field that has a value. Fields by label, in order."""
    shown = F.coalesce(F.when(name == "", None).otherwise(F.trim(name)), subject_id)
    lines = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{label}: "), c.cast("string"))) for label, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("Name: "), shown), *lines)


def subject_card_truthy(name: Column, subject_id: Column, **fields: Column) -> Column:
    """The harness's card: a field that is 0 has no line either, and names aren't trimmed."""
    zero = lambda c: c.isNull() | (c.cast("string") == "") | c.cast("string").isin("0", "0.0")
    lines = [F.when(~zero(c), F.concat(F.lit(f"{label}: "), c.cast("string"))) for label, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("Name: "), F.coalesce(F.when(name == "", None).otherwise(name), subject_id)), *lines)


def name_of_card(card: Column) -> Column:
    """The first line that begins with 'Name:', case-sensitive."""
    return F.trim(F.regexp_extract(F.coalesce(card, F.lit("")), r"(?m)^Name:\s*(.+?)\s*$", 1))


def name_of_card_any_case(card: Column) -> Column:
    """As name_of_card, in any case and after blanks."""
    return F.trim(F.regexp_extract(F.coalesce(card, F.lit("")), r"(?im)^\s*Name:\s*(.*?)\s*$", 1))


def name_by_lines(card: Column) -> Column:
    """The rest of the first line that begins with name: after trimming, in any case."""
    lines = F.filter(F.transform(F.split(F.coalesce(card, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.lower(x).startswith("name:"))
    return F.coalesce(F.trim(F.substring(F.get(lines, F.lit(0)), 6, 10_000)), F.lit(""))


def family_of_name(name: Column) -> Column:
    """What stands before the first '-' and ':', without digits, in lower case."""
    head = F.trim(F.substring_index(F.substring_index(F.lower(name), "-", 1), ":", 1))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(head, "[0-9]", "")), F.lit("")), F.lit("<unknown>"))


def safe_float(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(MISSING_FIELD), None).otherwise(s.try_cast("double"))


def bucket(x: Column, steps: list[tuple[float, str]], last: str, missing: str) -> Column:
    """The name of the first step that x is below."""
    out = F.when(x.isNull() | F.isnan(x), missing)
    for top, name in steps:
        out = out.when(x < top, name)
    return out.otherwise(last)


# Edges and names of the buckets, and the known keys of conditions.
PARAMS = [(3, "tiny_<3B"), (8, "small_3-8B"), (20, "medium_8-20B"), (70, "large_20-70B"), (200, "xlarge_70-200B")]
RELEASE = [(200, "very_recent"), (400, "recent"), (700, "mid"), (1000, "older")]
CONDITION_KEYS = ["skill", "aspect", "subset", "source", "prompt", "metric", "attack", "judge", "mode", "criterion", "aggregate"]


def params_bucket(x: Column) -> Column:
    return bucket(x, PARAMS, "huge_200B+", "unknown")


def release_bucket(x: Column) -> Column:
    return bucket(x, RELEASE, "ancient", "unknown")


def condition_flags(c: Column, known: list[str] = CONDITION_KEYS) -> dict[str, Column]:
    """0/1 for none, for each known key of 'k=v' pieces, and for any other key or a piece without '='."""
    s = F.trim(F.coalesce(c, F.lit("")))
    none = (s == "") | F.lower(s).isin(MISSING)
    pieces = F.when(none, F.array().cast("array<string>")).otherwise(F.split(s, r"\|"))
    found = F.transform(pieces, lambda x: F.when(F.contains(x, F.lit("=")), F.trim(F.substring_index(x, "=", 1))).otherwise("="))
    flags = {f"cond_has_{k}": F.array_contains(found, k).cast("int") for k in known}
    return {"cond_is_none": none.cast("int"), "cond_has_other": F.exists(found, lambda x: ~x.isin(known)).cast("int"), **flags}


def encoder_text(benchmark: Column, cond: Column, content: Column) -> Column:
    return F.concat(F.lit("Benchmark: "), benchmark, F.lit("\nCondition: "), cond, F.lit("\nItem: "), content)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    """Stable on either side of 0."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 128, "<=128").when(n <= 256, "<=256").when(n <= 512, "<=512").when(n <= 1024, "<=1024").otherwise(">1024")
