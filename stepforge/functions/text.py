"""Scalar text functions as native columns (they stay inside the JVM and whole-stage code where Spark allows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Unicode white space and the four separators U+001C to U+001F.
BLANKS = r"(?U)[\s\x1C-\x1F]+"
EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def filled(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    """Null gives an empty string; Unicode white space goes at both ends."""
    return F.regexp_replace(filled(x), EDGES, "")


def clean(x: Column) -> Column:
    """strip() with every inner run of white space made one space."""
    return F.btrim(F.regexp_replace(filled(x), BLANKS, " "), F.lit(" "))


def normalize(x: Column) -> Column:
    return F.lower(clean(x))


def preview(x: Column, most: int = 300) -> Column:
    flat = F.replace(filled(x), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def last_number(x: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(filled(x), F.lit(K.NUMBER), 0), F.lit(-1)).try_cast("double")


def reasoning(x: Column) -> Column:
    """The normalized text before the first answer mark."""
    return normalize(F.regexp_replace(filled(x), f"(?s){K.ANSWER_MARK}.*", ""))


def entity_name(x: Column) -> Column:
    return F.regexp_replace(normalize(x), "^[^a-z0-9]+|[^a-z0-9]+$", "")


def clauses(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, K.CLAUSE_END), normalize), lambda c: c != "")


def op_number(x: Column) -> Column:
    """Whole numbers pass, fractions of numeric columns are cut, other strings give null."""
    return x.try_cast("int")


def op_bucket(op: Column) -> Column:
    return (
        F.when(op.isNull(), "unknown")
        .when(op.between(2, 10), "op_2_10")
        .when(op.between(11, 14), "op_11_14")
        .when(op.between(15, 20), "op_15_20")
        .otherwise(F.concat(F.lit("op_other_"), op.cast("string")))
    )


def gold_answer(answer: Column, solution: Column) -> Column:
    return F.coalesce(last_number(answer), last_number(solution))


def item_id(id_: Column, problem: Column, question: Column, solution: Column) -> Column:
    """The stripped id, or the md5 of problem, question and solution if it is empty or null."""
    given = strip(id_)
    return F.when(given != "", given).otherwise(F.md5(F.concat_ws("\n", *[strip(x) for x in (problem, question, solution)])))


def chat(user: Column) -> Column:
    return F.concat(F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def task(problem: Column, question: Column) -> Column:
    head = F.concat(F.lit("Problem:\n"), problem)
    return F.when(question != "", F.concat(head, F.lit("\n\nQuestion:\n"), question)).otherwise(head)


def pair_prompt(problem: Column, question: Column) -> Column:
    return chat(task(strip(problem), strip(question)))


def train_prompt(problem: Column, question: Column) -> Column:
    return chat(task(clean(problem), clean(question)))


def eval_prompt(problem: Column, question: Column) -> Column:
    system = F.lit(f"<|im_start|>system\n{K.SYSTEM_MESSAGE}\n<|im_end|>\n<|im_start|>user\nProblem:\n")
    return F.concat(system, strip(problem), F.lit("\n\nQuestion:\n"), strip(question), F.lit(f"\n\n{K.STEP_REQUEST}\n<|im_end|>\n<|im_start|>assistant\n"))


def request_prompt(problem: Column, question: Column, solution: Column) -> Column:
    """The user message that asks a generator for wrong variants of a solution."""
    middle = F.when(strip(question) != "", F.concat(F.lit("\n\nQuestion:\n"), strip(question))).otherwise("")
    return F.concat(F.lit("Problem:\n"), strip(problem), middle, F.lit("\n\nCorrect solution:\n"), strip(solution))


def whole_word(text: Column, word: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"\b"), word, F.lit(r"\b")))


def words_in(text: Column, candidates: Column) -> Column:
    """The candidates that the text holds as whole words, in their own order, each once."""
    return F.array_distinct(F.filter(candidates, lambda v: whole_word(text, v)))


def rank_hash(*parts: Column, seed: int = 42) -> Column:
    """A portable pseudo-random order: the md5 of the parts and a seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_number(digest: Column) -> Column:
    """A number from 0 to 2**28 - 1 out of an md5 string."""
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def perturbed(number: Column, digest: Column) -> Column:
    """A different positive whole number at a distance of 1 or 2 that the digest chooses; 0 gives 1."""
    delta = F.element_at(F.array(*[F.lit(x).cast("decimal(38,0)") for x in (-2, -1, 1, 2)]), (hash_number(digest) % 4 + 1).cast("int"))
    value = number.cast("decimal(38,0)")
    moved = F.when(value + delta <= 0, value + F.abs(delta)).otherwise(value + delta)
    return F.when(value == 0, F.lit("1")).otherwise(moved.cast("string"))


def json_variant(x: Column) -> Column:
    """Parsed JSON, or the part from the first { to the last } parsed, or null."""
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(F.nullif(F.regexp_extract(filled(x), r"(?s)\{.*\}", 0), F.lit(""))))


def percent(x: Column) -> Column:
    """A share as whole percents, halves to the even number."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))
