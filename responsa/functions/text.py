"""Form features of item texts, item types, interactions, answers and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the form features.
LATEX = r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$|\\\(.+?\\\)|\\\[.+?\\\]|\\begin\{[^}]+\}"
CODE = r"```|(?:^|\n)(?: {4,}|\t)[^ \t\n\r\f]"
NUMBER = r"\b\d+(?:\.\d+)?\b"
CHOICE = r"(?m)^\s*(?:\([A-Ea-e]\)|[A-Ea-e][).])"
COT = ["cot", "chain-of-thought", "chain of thought", "chainofthought", "step by step", "step-by-step", "scratchpad", "reasoning"]
COT_BASES = ["has_code", "has_latex", "is_multiple_choice", "n_numbers", "token_len", "type_mcq", "type_code", "type_math"]
POOL = ["token_len", "char_len", "has_latex", "has_code", "n_questions", "n_numbers", "is_multiple_choice", "n_choices", "lang_en"]
TYPES = ["type_mcq", "type_code", "type_math", "type_prose"]


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lang_en(text: Column) -> Column:
    """1 for blank texts and those without letters; else whether ASCII letters are 85 % of all letters."""
    letters, ascii_letters = _n(text, r"\p{L}"), _n(text, "[A-Za-z]")
    return F.when((letters == 0) | (ascii_letters >= 0.85 * letters), 1.0).otherwise(0.0)


def pool_features(text: Column) -> dict[str, Column]:
    s = F.coalesce(text, F.lit(""))
    chars = F.length(s).cast("double")
    choices = _n(s, CHOICE).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "token_len": chars / 4 + 1,
        "char_len": chars,
        "has_latex": flag(F.rlike(s, F.lit(LATEX))),
        "has_code": flag(F.rlike(s, F.lit(CODE))),
        "n_questions": (F.length(s) - F.length(F.replace(s, F.lit("?"), F.lit("")))).cast("double"),
        "n_numbers": _n(s, NUMBER).cast("double"),
        "is_multiple_choice": flag(choices >= 2),
        "n_choices": choices,
        "lang_en": lang_en(s),
    }


def is_cot(condition: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(condition, F.lit(""))))
    hit = F.exists(F.array(*map(F.lit, COT)), lambda t: F.contains(c, t))
    return F.when((c != "") & (c != "none") & hit, 1.0).otherwise(0.0)


def item_types() -> dict[str, Column]:
    """One flag each, of columns of pool_features(); code before multiple choice before mathematics before prose."""
    kind = F.when(F.col("has_code") >= 0.5, "type_code").when(F.col("is_multiple_choice") >= 0.5, "type_mcq").when((F.col("has_latex") >= 0.5) | (F.col("n_numbers") >= 5), "type_math").otherwise("type_prose")
    return {t: F.when(kind == t, 1.0).otherwise(0.0) for t in TYPES}


def cot_interactions(cot: Column, columns: list[str], bases: list[str] = COT_BASES) -> dict[str, Column]:
    """cot_x_<base>: products with those bases that are columns."""
    return {f"cot_x_{b}": cot * F.col(b) for b in bases if b in columns}


def max_length(q: Column, floor: int = 128, ceiling: int = 2048, multiple: int = 64) -> Column:
    """A quantile of lengths, rounded up, within bounds, then rounded up to a multiple."""
    bounded = F.least(F.greatest(F.ceil(q), F.lit(floor)), F.lit(ceiling))
    return F.greatest(F.ceil(bounded / multiple) * multiple, F.lit(multiple)).cast("long")


NO_ANSWER = "<none>"
BLANK, NUMBER_ANSWER = r"[ \t\n\r\f]", r"-?[0-9]+(?:\.[0-9]+)?"


def clean_token(t: Column) -> Column:
    """Lower case, single blanks, no punctuation around it, whole numbers without '.0'."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), BLANK + "+", " "), r"^[ .,:;$\\]+|[ .,:;$\\]+$", "")
    t = F.when(t.rlike(r"^-?[0-9]+\.0+$"), F.substring_index(t, ".", 1)).otherwise(t)
    return F.when(t == "", NO_ANSWER).otherwise(t)


def normalize_answer(text: Column) -> Column:
    """The last boxed answer; else what follows 'answer' (in the last four lines first): its box, last number, first choice letter or all of it; else a lone choice letter on the last line, the last number, the last line."""
    blank = BLANK
    s = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{blank}+|{blank}+$", "")
    every = lambda x, pattern, group: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    box, choice = r"\\boxed\{([^}]*)\}", r"\b([A-E])\b"
    answer = r"(?i)(?:final\s+answer|answer|the\s+answer\s+is)\s*[:\-]?\s*(.+)"
    lines = F.split(s, "\r?\n")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 3, F.lit(1)), 4), "\n")
    said = F.trim(F.coalesce(F.nullif(F.regexp_extract(tail, answer, 1), F.lit("")), F.nullif(F.regexp_extract(s, answer, 1), F.lit(""))))
    of_said = F.coalesce(last(every(said, box, 1)), last(every(said, NUMBER_ANSWER, 0)), F.nullif(F.regexp_extract(F.substring(said, 1, 8), choice, 1), F.lit("")), said)
    line = F.trim(F.coalesce(last(F.filter(lines, lambda x: F.trim(x) != "")), F.lit("")))
    lone = F.when(F.length(line) <= 3, F.nullif(F.regexp_extract(line, choice, 1), F.lit("")))
    return F.when(s == "", NO_ANSWER).otherwise(clean_token(F.coalesce(last(every(s, box, 1)), F.when(said.isNotNull(), of_said), lone, last(every(s, NUMBER_ANSWER, 0)), line)))


def answer_type(parsed: Column) -> Column:
    """none, number, mc or text, of a normalised answer."""
    p = F.lower(F.trim(F.coalesce(parsed, F.lit(""))))
    return F.when((p == "") | (p == NO_ANSWER), "none").when(p.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), "number").when(p.rlike("^[a-e]$"), "mc").otherwise("text")


def step_count(text: Column) -> Column:
    """Numbered steps if there are two or more; else paragraphs; else lines that aren't blank."""
    s = F.coalesce(text, F.lit(""))
    full = lambda parts: F.size(F.filter(parts, lambda x: x.rlike(r"[^ \t\n\r\f]")))
    numbered = _n(s, r"(?im)^[ \t\n\r\f]*(?:[0-9]+[ \t\n\r\f]*[.)]|step[ \t\n\r\f]+[0-9]+[ \t\n\r\f]*[:.])")
    paragraphs, lines = full(F.split(s, r"\n[ \t\n\r\f]*\n")), full(F.split(s, "\n"))
    return F.when(numbered >= 2, numbered).when(paragraphs >= 1, paragraphs).otherwise(lines)
