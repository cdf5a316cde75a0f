"""Equations, assignments, entities and dependency graphs of a reasoning text, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import text as T


def equations(x: Column) -> Column:
    """Distinct (a, op, b, c) of all ``a op b = c``; the operands of sums and products are sorted."""
    # of the letters in the pattern only x has a capital
    found = F.regexp_extract_all(F.replace(T.filled(x), F.lit("X"), F.lit("x")), F.lit(K.EQUATION), 0)
    # a match is number, sign, number, equals sign, number; split() would compile its pattern at every call
    cut = F.transform(found, lambda m: F.struct(F.regexp_extract_all(m, F.lit(r"\d+(?:\.\d+)?"), 0).alias("n"), F.regexp_extract(m, r"[+\-*/x×÷]", 0).alias("o")))

    def entry(e: Column) -> Column:
        op = F.when(e["o"].isin("x", "×"), "*").when(e["o"] == "÷", "/").otherwise(e["o"])
        a, b, c = (e["n"][k].cast("double") for k in range(3))
        swap = op.isin("+", "*")
        return F.struct(F.when(swap, F.least(a, b)).otherwise(a).alias("a"), op.alias("op"), F.when(swap, F.greatest(a, b)).otherwise(b).alias("b"), c.alias("c"))

    return F.array_distinct(F.transform(cut, entry))


def raw_edges(reasoning: Column) -> Column:
    """Distinct (lhs, dep) of all assignments in a normalized text; CONST if a right side has numbers but no variable."""
    found = F.regexp_extract_all(reasoning, F.lit(K.ASSIGNMENT), 0)
    zipped = F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, K.ASSIGNMENT, k + 1).alias("lr"[k]) for k in range(2)]))
    reserved = F.array(*map(F.lit, K.RESERVED))

    def edges(e: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(e["r"], F.lit(rf"\b({K.IDENTIFIER})\b"), 1))
        deps = F.filter(names, lambda v: (v != e["l"]) & ~F.array_contains(reserved, v))
        known = F.transform(deps, lambda d: F.struct(e["l"].alias("lhs"), d.alias("dep")))
        constant = F.when(F.regexp_like(e["r"], F.lit(r"\d")), F.array(F.struct(e["l"].alias("lhs"), F.lit("CONST").alias("dep")))).otherwise(F.filter(F.array(F.struct(e["l"].alias("lhs"), F.lit("CONST").alias("dep"))), lambda _: F.lit(False)))
        return F.when(F.size(deps) > 0, known).otherwise(constant)

    return F.array_distinct(F.flatten(F.transform(zipped, edges)))


def definitions(reasoning: Column) -> Column:
    """(entity, var) of every clause that defines one, in order, each clause by both patterns; empty entities are out.

    The text is normalized, so its clauses are but for blanks at their ends. A clause is searched by a pattern only if it
    has the pattern's fixed words.
    """

    def of(clause: Column) -> Column:
        name = lambda x: F.regexp_replace(x, "^[^a-z0-9]+|[^a-z0-9]+$", "")
        searched = [(p, F.when(clause.contains(word), clause).otherwise("")) for p, word in ((K.ENTITY_AS, " as "), (K.ENTITY_EQUALS, "="))]
        both = F.array(*[F.struct(name(F.regexp_extract(c, p, 1)).alias("entity"), F.regexp_extract(c, p, 2).alias("var")) for p, c in searched])
        return F.filter(both, lambda d: (d["entity"] != "") & (d["var"] != ""))

    clauses = F.filter(F.regexp_extract_all(reasoning, F.lit(r"[^.;\n]+"), 0), lambda c: c.contains("define"))
    return F.flatten(F.transform(clauses, lambda c: of(F.btrim(c, F.lit(" ")))))


def last_wins(pairs: Column, key: str) -> Column:
    """The pairs without those whose key a later pair has too."""
    once = F.size(F.array_distinct(pairs[key])) == F.size(pairs)
    return F.when(once, pairs).otherwise(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q[key] == p[key])))


def graph_columns(reasoning: Column, raw: Column, defined: Column) -> dict[str, Column]:
    """entities, edges and nodes from columns that hold raw_edges() and definitions().

    An entity's edge leads to the entity that used its variable last, usually itself. Without entity edges, assignments
    make the graph.
    """
    entities = last_wins(defined, "entity")
    owner = last_wins(defined, "var")
    tag = lambda e: F.concat(F.lit("ENTITY::"), e)
    to_owner = F.transform(entities, lambda d: F.struct(tag(d["entity"]).alias("src"), tag(F.filter(owner, lambda o: o["var"] == d["var"])[0]["entity"]).alias("dst")))
    var = lambda v: F.when(v == "CONST", v).otherwise(F.concat(F.lit("VAR::"), v))
    fallback = F.transform(raw, lambda e: F.struct(F.concat(F.lit("VAR::"), e["lhs"]).alias("src"), var(e["dep"]).alias("dst")))
    edges = F.array_distinct(F.when(F.size(entities) > 0, to_owner).otherwise(fallback))
    return {"entities": F.transform(entities, lambda d: tag(d["entity"])), "edges": edges}


def nodes(edges: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["src"], e["dst"]))))


def f1(pred: Column, gold: Column) -> Column:
    """F1 of two arrays of distinct values: 1 if both are empty, 0 if one is or nothing is shared."""

    def of(both: Column) -> Column:
        p, r = both.cast("double") / F.size(pred), both.cast("double") / F.size(gold)
        return F.when((F.size(pred) == 0) & (F.size(gold) == 0), F.lit(1.0)).when((F.size(pred) == 0) | (F.size(gold) == 0) | (both == 0), F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))

    # a variable of a lambda is computed once, however often it is used; equal arrays need no search
    both = F.when(pred == gold, F.size(pred)).otherwise(F.size(F.array_intersect(pred, gold)))
    return F.transform(F.array(both), of)[0]


FEATURES = ("equations", "raw", "entities", "edges", "nodes")


def features(df, text: str, prefix: str):
    """Adds prefix + each of FEATURES for a text column; every step is kept from being computed twice."""
    keep = [c for c in df.columns]
    step = df.select(*keep, F.explode(F.array(T.reasoning(F.col(text)))).alias("_r"))
    step = step.select(*keep, F.explode(F.array(F.struct(F.col("_r").alias("r"), raw_edges(F.col("_r")).alias("raw"), definitions(F.col("_r")).alias("defined")))).alias("_g"))
    graph = graph_columns(F.col("_g.r"), F.col("_g.raw"), F.col("_g.defined"))
    step = step.select(*keep, F.explode(F.array(F.struct(equations(F.col(text)).alias("equations"), F.col("_g.raw").alias("raw"), graph["entities"].alias("entities"), graph["edges"].alias("edges")))).alias("_f"))
    return step.select(*keep, *[F.col(f"_f.{x}").alias(prefix + x) for x in FEATURES[:-1]], nodes(F.col("_f.edges")).alias(prefix + "nodes"))


def chain_score(pred: str, gold: str) -> dict[str, Column]:
    """graph_score, equation_score and final_score of features with these prefixes."""
    part = lambda x: f1(F.col(pred + x), F.col(gold + x))
    w = K.GRAPH_WEIGHTS
    graph = F.lit(w["edge"]) * part("edges") + F.lit(w["node"]) * part("nodes") + F.lit(w["entity"]) * part("entities") + F.lit(w["raw"]) * part("raw")
    equation = part("equations")
    empty = (F.size(pred + "equations") == 0) & (F.size(gold + "equations") == 0)
    return {"graph_score": graph, "equation_score": equation, "final_score": F.greatest(graph, equation), "no_equations_both": empty}


def answer_correct(pred: Column, gold: Column, eps: float = K.EPS) -> Column:
    return F.coalesce(F.abs(pred - gold) < eps, F.lit(False))


def chain_correct(answer_ok: Column, score: Column, threshold: float = K.CHAIN_THRESHOLD) -> Column:
    return F.coalesce(answer_ok & (score >= threshold), F.lit(False))
