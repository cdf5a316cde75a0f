"""Registered queries over the driver's tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions import chains
from stepforge.functions import constants as K
from stepforge.functions import similarity as S
from stepforge.functions import text as T
from stepforge.operators import corrupt, dag, generation, passk, qc, reports, sampling

from . import corpus, pipelines, reporting
from .corpus import table

QUERIES: dict = {}
ORACLES: dict = {}
KS = (1, 2, 4)
WITH = f"with {corpus.SQL}"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL fragments -------------------------------------------------------------------------------------------------
def sql_number(x: str) -> str:
    return rf"try_cast(regexp_extract_all({x}, '-?\d+(?:\.\d+)?')[-1] as double)"


def sql_bucket(op: str) -> str:
    return f"case when {op} is null then 'unknown' when {op} between 2 and 10 then 'op_2_10' when {op} between 11 and 14 then 'op_11_14' when {op} between 15 and 20 then 'op_15_20' else concat('op_other_', {op}) end"


def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def sql_f1(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    p, r = f"({n}::double / len({a}))", f"({n}::double / len({b}))"
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 or {n} = 0 then 0.0::double else 2.0::double * {p} * {r} / ({p} + {r}) end"


SQL_SCORED = f"sc as (select id, op, j, coalesce(abs({sql_number('txt')} - {sql_number('solution')}) < 1e-6, false) ok from cand)"
SQL_HITS = f"pp as (select id, op, {sql_bucket('op')} bucket, {', '.join(f'coalesce(bool_or(ok) filter (where j < {k}), false) pass_{k}' for k in KS)} from sc group by id, op)"
SQL_RATES = ", ".join(f"count(*) filter (where pass_{k})::double / count(*) pass_{k}" for k in KS) + ", count(*) num_samples"
PASSED = f"{WITH}, {SQL_SCORED}, {SQL_HITS}"
FLAGS = [f"pass_{k}" for k in KS]


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Per problem: id, op, bucket and pass flags."""
    scored = passk.score_answers(corpus.candidates(spark, sf), T.last_number(F.col("solution")))
    return passk.per_problem(scored, ["id", "op"], KS).withColumn("bucket", T.op_bucket(F.col("op")))


# ---- pass@k --------------------------------------------------------------------------------------------------------
@query(f"{PASSED} select bucket, {SQL_RATES} from pp group by bucket")
def pass_at_k_by_bucket(spark, sf):
    return hits(spark, sf).groupBy("bucket").agg(*passk.rates(None, FLAGS))


@query(f"{PASSED} select {SQL_RATES} from pp")
def pass_at_k_overall(spark, sf):
    return hits(spark, sf).agg(*passk.rates(None, FLAGS))


@query(f"{PASSED} select op, {SQL_RATES} from pp where op is not null group by op")
def pass_at_k_by_op(spark, sf):
    return hits(spark, sf).filter("op is not null").groupBy("op").agg(*passk.rates(None, FLAGS))


@query(f"{PASSED} select case when grouping(bucket) = 1 and grouping(op) = 1 then 'overall' when grouping(bucket) = 0 then 'bucket' else 'op' end scope, case when grouping(bucket) = 1 and grouping(op) = 1 then 'overall' when grouping(bucket) = 0 then bucket else cast(op as varchar) end target, {SQL_RATES} from pp group by grouping sets ((), (bucket), (op))")
def pass_at_k_grouping_sets(spark, sf):
    return passk.by_level(hits(spark, sf), FLAGS)


@query(f"{PASSED}, e as (select avg(pass_1::int) filter (where bucket = 'op_2_10') easy, avg(pass_1::int) filter (where bucket in ('op_11_14', 'op_15_20')) hard from pp) select easy, hard, case when hard is not null and easy > 0 then greatest(0.0::double, (easy - hard) / easy) end decay from e")
def generalization_decay(spark, sf):
    return passk.decay(hits(spark, sf))


@query(f"{PASSED} select bucket, count(*) n from pp group by bucket")
def bucket_histogram(spark, sf):
    return hits(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"))


# ---- chains --------------------------------------------------------------------------------------------------------
def sql_features(source: str, name: str) -> str:
    """Feature lists of source(key..., txt): equations, raw edges, entities, edges and nodes."""
    eq, assign, entity = K.EQUATION, K.ASSIGNMENT, K.ENTITY_AS
    reserved = ", ".join(f"'{x}'" for x in K.RESERVED)
    a, b, o = f"regexp_extract(m, '{eq}', 1)::double", f"regexp_extract(m, '{eq}', 3)::double", f"replace(replace(replace(regexp_extract(m, '{eq}', 2), 'x', '*'), '×', '*'), '÷', '/')"
    lhs, rhs = f"regexp_extract(m, '{assign}', 1)", f"regexp_extract(m, '{assign}', 2)"
    deps = rf"list_filter(list_distinct(regexp_extract_all({rhs}, '\b([A-Za-z][A-Za-z0-9_]*)\b', 1)), lambda v: v <> {lhs} and v not in ({reserved}))"
    before_answer = sql_norm(r"string_split_regex(txt, '%s')[1]" % K.ANSWER_MARK)
    return rf"""
{name}_a as (select * exclude (txt), {before_answer} r,
   list_distinct(list_transform(regexp_extract_all(lower(txt), '{eq}'), lambda m: case when {o} in ('+', '*')
     then concat(least({a}, {b}), {o}, greatest({a}, {b}), '=', regexp_extract(m, '{eq}', 4)::double)
     else concat({a}, {o}, {b}, '=', regexp_extract(m, '{eq}', 4)::double) end)) equations from {source}),
{name}_b as (select *, list_distinct(flatten(list_transform(regexp_extract_all(r, '{assign}'), lambda m: case
     when len({deps}) > 0 then list_transform({deps}, lambda d: concat({lhs}, '>', d))
     when regexp_matches({rhs}, '\d') then [concat({lhs}, '>CONST')] else []::varchar[] end))) raw,
   list_distinct(list_filter(list_transform(string_split_regex(r, '[.;\n]+'), lambda c: regexp_replace(trim(regexp_extract(c, '{entity}', 1)), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda e: e <> '')) entities from {name}_a),
{name} as (select *, case when len(entities) > 0 then list_transform(entities, lambda e: concat(e, '>', e)) else raw end edges,
   case when len(entities) > 0 then entities else list_distinct(flatten(list_transform(raw, lambda e: string_split(e, '>')))) end nodes from {name}_b)"""


SQL_CHAIN = f"""{WITH},
ps as (select id, op, j, txt, {sql_number('txt')} pa from cand), gs as (select id, solution txt, {sql_number('solution')} ga from sol),
{sql_features('ps', 'p')}, {sql_features('gs', 'g')},
s0 as (select p.id, p.op, p.j, coalesce(abs(p.pa - g.ga) < 1e-6, false) ok,
   {sql_f1('p.edges', 'g.edges')} e, {sql_f1('p.nodes', 'g.nodes')} n, {sql_f1('p.entities', 'g.entities')} t, {sql_f1('p.raw', 'g.raw')} w, {sql_f1('p.equations', 'g.equations')} equation_score
   from p join g using (id)),
s1 as (select *, 0.45::double * e + 0.2::double * n + 0.2::double * t + 0.15::double * w graph_score from s0),
s2 as (select *, greatest(graph_score, equation_score) final_score from s1),
s as (select *, ok and final_score >= 0.35::double chain from s2)"""


def scored_chains(spark, sf) -> DataFrame:
    c = corpus.candidates(spark, sf)
    return passk.score_chains(c.select("id", "op", "j", "txt"), corpus.solutions(spark, sf).select("id", "solution"))


@query(f"{SQL_CHAIN} select id, j, graph_score, equation_score, final_score, ok is_correct, chain chain_correct from s")
def chain_score(spark, sf):
    return scored_chains(spark, sf).select("id", "j", "graph_score", "equation_score", "final_score", "is_correct", "chain_correct")


@query(f"{SQL_CHAIN}, c as (select id, {sql_bucket('op')} bucket, {', '.join(f'bool_or(chain) filter (where j < {k}) chain_{k}' for k in KS)} from s group by id, op) select bucket, {', '.join(f'count(*) filter (where chain_{k})::double / count(*) chain_{k}' for k in KS)}, count(*) num_samples from c group by bucket")
def chain_pass_at_k_by_bucket(spark, sf):
    per = passk.per_problem(scored_chains(spark, sf), ["id", "op"], KS, chain=True).withColumn("bucket", T.op_bucket(F.col("op")))
    return per.groupBy("bucket").agg(*passk.rates(per, [f"chain_{k}" for k in KS]))


@query(f"{SQL_CHAIN} select {sql_bucket('op')} bucket, count(*) filter (where chain)::double / count(*) top1_chain, count(*) num_samples from s where j = 0 group by 1")
def top1_chain_accuracy(spark, sf):
    per = passk.per_problem(scored_chains(spark, sf), ["id", "op"], (1,), chain=True).withColumn("bucket", T.op_bucket(F.col("op")))
    return per.groupBy("bucket").agg(*passk.rates(per, ["top1_chain"]))


@query(f"{SQL_CHAIN}, c as (select id, {sql_bucket('op')} bucket, {', '.join(f'bool_or(ok) filter (where j < {k}) a{k}, bool_or(chain) filter (where j < {k}) c{k}' for k in KS)} from s group by id, op) select bucket, {', '.join(f'count(*) filter (where a{k})::double / count(*) - count(*) filter (where c{k})::double / count(*) gap_{k}' for k in KS)} from c group by bucket")
def answer_reasoning_gap(spark, sf):
    per = passk.per_problem(scored_chains(spark, sf), ["id", "op"], KS, chain=True).withColumn("bucket", T.op_bucket(F.col("op")))
    wide = per.groupBy("bucket").agg(*passk.rates(per, [f"{x}_{k}" for x in ("pass", "chain") for k in KS]))
    return reports.gaps(wide, KS).select("bucket", *[f"gap_{k}" for k in KS])


@query(f"{SQL_CHAIN} select id, j, equation_score from s")
def equation_f1(spark, sf):
    return scored_chains(spark, sf).select("id", "j", "equation_score")


@query(f"{SQL_CHAIN} select id, j, n node_f1 from s")
def node_f1(spark, sf):
    return scored_chains(spark, sf).select("id", "j", chains.f1(F.col("p_nodes"), F.col("g_nodes")).alias("node_f1"))


ANSWER_SQL = "case id % 4 when 0 then concat('The answer is ', ans + 1) when 1 then 'no number' when 2 then '' end"


def answered(spark, sf) -> DataFrame:
    """Problems with an answer of their own, which differs from the solution's or holds no number."""
    s, i = corpus.solutions(spark, sf), F.col("id") % 4
    return s.select("id", "solution", F.when(i == 0, F.concat(F.lit("The answer is "), (F.col("ans") + 1).cast("string"))).when(i == 1, "no number").when(i == 2, "").alias("answer"))


@query(f"{WITH}, a as (select id, coalesce({sql_number(ANSWER_SQL)}, {sql_number('solution')}) gold from sol) select cand.id, j, gold gold_answer, coalesce(abs({sql_number('txt')} - gold) < 1e-6, false) is_correct from cand join a using (id)")
def gold_answer(spark, sf):
    scored = passk.score_chains(corpus.candidates(spark, sf).select("id", "j", "txt"), answered(spark, sf))
    return scored.select("id", "j", "gold_answer", "is_correct")


def gold_features(spark, sf) -> DataFrame:
    return chains.features(corpus.solutions(spark, sf).select("id", "solution"), "solution", "")


SQL_GOLD = f"{WITH}, gs as (select id, solution txt from sol), {sql_features('gs', 'g')}"


@query(f"{SQL_GOLD} select id, unnest(equations) equation from g")
def equations_extract(spark, sf):
    e = gold_features(spark, sf).select("id", F.explode("equations").alias("e"))
    return e.select("id", F.concat(F.col("e.a").cast("string"), F.col("e.op"), F.col("e.b").cast("string"), F.lit("="), F.col("e.c").cast("string")).alias("equation"))


@query(f"{SQL_GOLD}, u as (select id, unnest(raw) e from g) select id, string_split(e, '>')[1] lhs, string_split(e, '>')[2] dep from u")
def assignment_edges(spark, sf):
    return gold_features(spark, sf).select("id", F.explode("raw").alias("e")).select("id", "e.lhs", "e.dep")


@query(f"{SQL_GOLD} select id, concat('ENTITY::', unnest(entities)) entity from g")
def entity_map(spark, sf):
    return gold_features(spark, sf).select("id", F.explode("entities").alias("entity"))


@query(f"{SQL_GOLD}, u as (select id, unnest(edges) e from g) select id, concat('ENTITY::', string_split(e, '>')[1]) src, concat('ENTITY::', string_split(e, '>')[2]) dst from u")
def dep_graph_edges(spark, sf):
    return gold_features(spark, sf).select("id", F.explode("edges").alias("e")).select("id", "e.src", "e.dst")


# ---- text ----------------------------------------------------------------------------------------------------------
@query(f"select page_id, {sql_number('html')} last_number from pages")
def last_number_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.last_number(F.col("html")).alias("last_number"))


@query(f"select event_id, {sql_number('props')} last_number from events")
def last_number_events(spark, sf):
    return table(spark, sf, "events").select("event_id", T.last_number(F.col("props")).alias("last_number"))


@query(f"select doc_id, md5({sql_norm('text')}) digest from documents")
def normalize_text_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query(f"select doc_id, md5({sql_clean('text')}) digest from documents")
def clean_text_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("with f as (select doc_id, replace(coalesce(text, ''), chr(10), '\\n') t from documents) select doc_id, case when length(t) > 300 then concat(substr(t, 1, 300), '...') else t end preview from f")
def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


SQL_REASON = sql_norm(r"string_split_regex(txt, '%s')[1]" % K.ANSWER_MARK)


@query(f"{WITH} select id, j, {SQL_REASON} reasoning from cand")
def reasoning_text(spark, sf):
    return corpus.candidates(spark, sf).select("id", "j", T.reasoning(F.col("txt")).alias("reasoning"))


@query(f"{WITH}, c as (select id, unnest(string_split_regex({SQL_REASON.replace('txt', 'solution')}, '[.;\\n]+')) c from sol) select id, trim(c) clause from c where trim(c) <> ''")
def clause_split(spark, sf):
    s = corpus.solutions(spark, sf).select("id", F.explode(F.array(T.reasoning(F.col("solution")))).alias("r"))
    return s.select("id", F.explode(T.clauses(F.col("r"))).alias("clause"))


@query(f"{WITH} select id, case when id % 2 = 0 then cast(id as varchar) else md5(concat({sql_strip('problem')}, chr(10), {sql_strip('question')}, chr(10), {sql_strip('solution')})) end item_id from prob")
def stable_item_id(spark, sf):
    given = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.col("id").cast("string"))).when(F.col("id") % 3 == 0, F.lit("  "))
    return corpus.problems(spark, sf).select("id", T.item_id(given, F.col("problem"), F.col("question"), F.col("solution")).alias("item_id"))


def sql_chat(user: str) -> str:
    return f"concat('<|im_start|>user', chr(10), {user}, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10))"


def sql_task(clean) -> str:
    p, q = clean("problem"), clean("question")
    return f"concat('Problem:', chr(10), {p}, case when {q} <> '' then concat(chr(10), chr(10), 'Question:', chr(10), {q}) else '' end)"


@query(f"{WITH} select id, {sql_chat(sql_task(sql_strip))} prompt from prob")
def prompt_pair(spark, sf):
    return corpus.problems(spark, sf).select("id", T.pair_prompt(F.col("problem"), F.col("question")).alias("prompt"))


@query(f"{WITH} select id, {sql_chat(sql_task(sql_clean))} prompt from prob")
def prompt_train(spark, sf):
    return corpus.problems(spark, sf).select("id", T.train_prompt(F.col("problem"), F.col("question")).alias("prompt"))


@query(f"{WITH} select id, concat('<|im_start|>system', chr(10), '{K.SYSTEM_MESSAGE}', chr(10), '<|im_end|>', chr(10), '<|im_start|>user', chr(10), 'Problem:', chr(10), {sql_strip('problem')}, chr(10), chr(10), 'Question:', chr(10), {sql_strip('question')}, chr(10), chr(10), '{K.STEP_REQUEST}', chr(10), '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) prompt from prob")
def prompt_eval(spark, sf):
    return corpus.problems(spark, sf).select("id", T.eval_prompt(F.col("problem"), F.col("question")).alias("prompt"))


@query(f"{WITH} select id, concat('Problem:', chr(10), {sql_strip('problem')}, case when {sql_strip('question')} <> '' then concat(chr(10), chr(10), 'Question:', chr(10), {sql_strip('question')}) else '' end, chr(10), chr(10), 'Correct solution:', chr(10), {sql_strip('solution')}) prompt from prob")
def prompt_request(spark, sf):
    return corpus.problems(spark, sf).select("id", T.request_prompt(F.col("problem"), F.col("question"), F.col("solution")).alias("prompt"))


# ---- DAG -----------------------------------------------------------------------------------------------------------
SQL_BLOCKS = rf"""{WITH}, bl as (select id, solution, list_filter(list_transform(string_split(regexp_replace(substr(solution, instr(solution, 'Define ')), '\s+(Define\s|We\s+know\s|Answer:)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: starts_with(x, 'Define')) blocks from sol),
b as (select id, generate_subscripts(blocks, 1) - 1 block_idx, unnest(blocks) block from bl),
st as (select id, block_idx step_pos, regexp_extract(block, '(?s)^Define\s+(.*?)\s+as\s+([A-Za-z][A-Za-z0-9_]*)\s*;\s*(.*)$', 2) var, regexp_extract(block, '(?s)^Define\s+(.*?)\s+as\s+([A-Za-z][A-Za-z0-9_]*)\s*;\s*(.*)$', 1) "desc", regexp_extract(block, '(?s)^Define\s+(.*?)\s+as\s+([A-Za-z][A-Za-z0-9_]*)\s*;\s*(.*)$', 3) body, block step_text from b),
ed as (select s.id, s.step_pos, e.var src, s.var dst from st s join st e on e.id = s.id and e.step_pos < s.step_pos and e.var <> s.var and regexp_matches(s.body, '\b' || e.var || '\b'))"""


def parsed(spark, sf) -> DataFrame:
    return dag.parse(corpus.problems(spark, sf))


@query(f"{SQL_BLOCKS} select id, block_idx, block from b")
def dag_blocks(spark, sf):
    return dag.split_solution(corpus.solutions(spark, sf).select("id", "solution")).select("id", F.posexplode("blocks").alias("k", "block")).select("id", F.col("k").cast("long").alias("block_idx"), "block")


@query(f'{SQL_BLOCKS} select id, step_pos, var, "desc", step_text from st')
def dag_steps(spark, sf):
    return parsed(spark, sf).select("id", F.explode("steps").alias("s")).select("id", F.col("s.step_pos").cast("long").alias("step_pos"), "s.var", "s.desc", "s.step_text")


@query(f"{SQL_BLOCKS} select id, step_pos, src, dst from ed")
def dag_edges(spark, sf):
    return dag.edges(parsed(spark, sf)).withColumn("step_pos", F.col("step_pos").cast("long"))


@query(f"{SQL_BLOCKS} select st.id, st.var, (select count(*) from ed where ed.id = st.id and ed.dst = st.var) indegree, (select count(*) from ed where ed.id = st.id and ed.src = st.var) outdegree from st")
def dag_degrees(spark, sf):
    return dag.degrees(parsed(spark, sf)).select("id", "var", F.col("indegree").cast("long"), F.col("outdegree").cast("long"))


@query(f"{WITH} select id, solution rebuilt from sol")
def dag_reconstruct(spark, sf):
    return parsed(spark, sf).select("id", dag.reconstruct(F.col("preamble"), dag.step_texts(F.col("steps")), F.col("tail")).alias("rebuilt"))


@query(f"{SQL_BLOCKS}, t as (select 1 ok from st group by id union all select 0 ok from cand where not contains(txt, 'Define ')) select sum(ok)::bigint n_ok, count(*) - sum(ok)::bigint n_failed, (count(*) - sum(ok))::double / count(*) error_rate from t")
def dag_parse_stats(spark, sf):
    bare = corpus.candidates(spark, sf).filter(~F.col("txt").contains("Define ")).select("id", F.col("txt").alias("solution"))
    return dag.parse_stats(dag.parse(corpus.solutions(spark, sf).select("id", "solution").unionByName(bare)))


SQL_DAG = f"""{SQL_BLOCKS}, dp as (select st.id, st.step_pos, list(ed.src order by ed.step_pos) filter (where ed.src is not null) deps from st left join ed on ed.id = st.id and ed.step_pos = st.step_pos group by all)"""


@query(rf"""{SQL_DAG}, nd as (select id, string_agg(concat('"', var, '":{{"var":"', var, '","desc":"', "desc", '","step_text":"', step_text, '","dependencies":[', array_to_string(list_transform(coalesce(deps, []::varchar[]), lambda d: concat('"', d, '"')), ','), '],"step_idx":', step_pos, '}}'), ',' order by step_pos) nodes, string_agg(concat('"', var, '"'), ',' order by step_pos) names from st join dp using (id, step_pos) group by id)
select id, concat('{{"preamble":"We read the order.","order":[', names, '],"tail":"Answer: ', ans, '","nodes":{{', nodes, '}}}}') dag from nd join sol using (id)""")
def dag_json(spark, sf):
    return parsed(spark, sf).select("id", dag.as_json(F.col("preamble"), F.col("steps"), F.col("tail")).alias("dag"))


@query(rf"""{SQL_DAG}, nd as (select id, count(*) c, string_agg(concat(chr(10), '    [', step_pos, '] ', var, '  deps=[', array_to_string(list_transform(coalesce(deps, []::varchar[]), lambda d: concat(chr(39), d, chr(39))), ', '), ']'), '' order by step_pos) lines from st join dp using (id, step_pos) group by id)
select id, concat('=== ReasoningDAG ===', chr(10), '  Preamble: ', chr(39), 'We read the order.', chr(39), chr(10), '  Steps (', c, '):', lines, chr(10), '  Tail: ', chr(39), 'Answer: ', ans, chr(39)) summary from nd join sol using (id)""")
def dag_summary(spark, sf):
    return parsed(spark, sf).select("id", dag.summary(F.col("preamble"), F.col("steps"), F.col("tail")).alias("summary"))


# ---- corruption ----------------------------------------------------------------------------------------------------
def corrupted(spark, sf, kind) -> DataFrame:
    return corrupt.corrupt(parsed(spark, sf), (kind,)).select("id", "rejected")


SQL_PICK = "(('0x' || substr(md5(concat_ws('|', id, '{kind}', 42)), 1, 7))::bigint)"


@query(rf"""{SQL_BLOCKS}, n as (select id, list(step_text order by step_pos) t, count(*) c from st group by id),
d as (select *, concat_ws('|', id, 'computer_error', 42) k from n),
p as (select *, md5(k) h, ('0x' || substr(md5(k), 1, 7))::bigint % c spot, ('0x' || substr(md5(md5(k)), 1, 7))::bigint % 4 dx from d),
q as (select *, t[spot + 1] s, regexp_extract(t[spot + 1], '(?s)^(.*)\b(\d+)\b(.*)$', 2)::bigint v, [-2, -1, 1, 2][dx + 1] delta from p),
r as (select *, case when v = 0 then 1 when v + delta <= 0 then v + abs(delta) else v + delta end w from q)
select r.id, concat('We read the order. ', array_to_string(list_transform(range(0, c), lambda i: case when i = spot then concat(regexp_extract(s, '(?s)^(.*)\b(\d+)\b(.*)$', 1), w, regexp_extract(s, '(?s)^(.*)\b(\d+)\b(.*)$', 3)) else t[i + 1] end), ' '), ' Answer: ', sol.ans) rejected from r join sol using (id)""")
def corrupt_computer_error(spark, sf):
    return corrupted(spark, sf, "computer_error")


@query(rf"""{SQL_BLOCKS}, o as (select ed.id, ed.step_pos spot, ed.src was, e.var became, row_number() over (partition by ed.id order by ed.step_pos, e.step_pos) - 1 k, count(*) over (partition by ed.id) m
   from ed join st e on e.id = ed.id and e.step_pos < ed.step_pos and e.var <> ed.src),
c as (select * from o where k = ('0x' || substr(md5(concat_ws('|', id, 'dependency_mismatch', 42)), 1, 7))::bigint % m),
x as (select st.id, string_agg(case when step_pos = c.spot then regexp_replace(step_text, '\b' || c.was || '\b', c.became) else step_text end, ' ' order by step_pos) t, max(c.spot) spot from st left join c using (id) group by st.id)
select id, case when spot is not null then concat('We read the order. ', t, ' Answer: ', ans) end rejected from x join sol using (id)""")
def corrupt_dependency_mismatch(spark, sf):
    return corrupted(spark, sf, "dependency_mismatch")


@query(rf"""{SQL_BLOCKS}, n as (select id, count(*) c from st group by id),
i as (select st.*, md5(concat_ws('|', id, 'missing_nodes', 42)) d from st join n using (id) where step_pos > 0 and step_pos < c - 1),
k as (select *, row_number() over (partition by id order by md5(concat_ws('|', d, step_pos)), step_pos) rn, count(*) over (partition by id) m from i),
g as (select id, step_pos from k where rn <= case when m >= 2 then 1 + ('0x' || substr(d, 1, 7))::bigint % 2 else 1 end),
x as (select st.id, string_agg(step_text, ' ' order by step_pos) t from st anti join g using (id, step_pos) group by st.id)
select sol.id, case when sol.id in (select id from g) then concat('We read the order. ', x.t, ' Answer: ', ans) end rejected from sol join x using (id)""")
def corrupt_missing_nodes(spark, sf):
    return corrupted(spark, sf, "missing_nodes")


@query(rf"""{SQL_BLOCKS}, e as (select ed.id, s.step_pos u, ed.step_pos v, row_number() over (partition by ed.id order by ed.step_pos, s.step_pos) - 1 k, count(*) over (partition by ed.id) m from ed join st s on s.id = ed.id and s.var = ed.src),
c as (select id, u, v from e where k = ('0x' || substr(md5(concat_ws('|', id, 'disorder', 42)), 1, 7))::bigint % m),
o as (select st.id, step_text, case when step_pos = c.v then c.u - 0.5 else step_pos end p, c.u from st left join c using (id)),
x as (select id, string_agg(step_text, ' ' order by p) t, max(u) u from o group by id)
select id, case when u is not null then concat('We read the order. ', t, ' Answer: ', ans) end rejected from x join sol using (id)""")
def corrupt_disorder(spark, sf):
    return corrupted(spark, sf, "disorder")


@query(f"""{WITH}, w as (select count(*) attempted, count(*) filter (where n >= 3) three, count(*) filter (where n >= 2) two from sol)
select 'computer_error' error_type, attempted, attempted succeeded, 1.0::double rate from w union all select 'dependency_mismatch', attempted, three, three::double / attempted from w
union all select 'missing_nodes', attempted, three, three::double / attempted from w union all select 'disorder', attempted, two, two::double / attempted from w""")
def corruption_stats(spark, sf):
    """Of the derived solutions, mismatches and missing steps need three steps, disorder needs two."""
    return corrupt.corrupt_stats(corpus.solutions(spark, sf).select("id", "solution"))


# ---- quality control -----------------------------------------------------------------------------------------------
SQL_PAIRS = f"{WITH}, pr as (select id, j, case id % 4 when 0 then 'computer_error' when 1 then 'dependency_mismatch' when 2 then 'missing_nodes' else 'disorder' end error_type, {sql_strip('solution')} chosen, {sql_strip('case when (id + j) % 7 = 0 then concat(txt, chr(10), ' + chr(39) + 'Error Type: x' + chr(39) + ') else txt end')} rejected from cand)"


def toy_pairs(spark, sf) -> DataFrame:
    c = corpus.candidates(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, K.ERROR_TYPES)), (F.col("id") % 4 + 1).cast("int"))
    txt = F.when((F.col("id") + F.col("j")) % 7 == 0, F.concat(F.col("txt"), F.lit("\nError Type: x"))).otherwise(F.col("txt"))
    return c.select("id", "j", kind.alias("error_type"), T.strip(F.col("solution")).alias("chosen"), T.strip(txt).alias("rejected"))


SQL_MARKED = " or ".join(f"contains(lower(rejected), '{m}')" for m in K.BAD_MARKERS)
SQL_REASONS = f"""case when rejected = '' then 'empty_rejected' when rejected = chosen then 'identical' when length(rejected) < 30 then 'too_short' when length(chosen) < 50 then 'chosen_too_short'
 when error_type = 'missing_nodes' and length(rejected)::double / greatest(length(chosen), 1) > 0.98::double then 'missing_nodes_not_shorter'
 when error_type <> 'missing_nodes' and length(rejected)::double / greatest(length(chosen), 1) < 0.4::double then concat(error_type, '_too_short')
 when {SQL_MARKED} then 'bad_marker' else 'ok' end"""


@query(f"{SQL_PAIRS} select id, j, {SQL_REASONS} reason from pr")
def qc_reasons_native(spark, sf):
    return toy_pairs(spark, sf).select("id", "j", qc.native_reason(F.col("chosen"), F.col("rejected"), F.col("error_type")).alias("reason"))


@query()
def qc_similarity(spark, sf):
    return qc.with_reason(toy_pairs(spark, sf)).select("id", "j", "similarity", "reason")


@query()
def qc_generated(spark, sf):
    return qc.generated_reason(toy_pairs(spark, sf)).select("id", "j", "similarity", "reason")


@query()
def pair_differences(spark, sf):
    """The first difference of the first three pairs of each type (a report of that size)."""
    order = Window.partitionBy("error_type").orderBy(T.rank_hash(F.col("id"), F.col("j")), "id", "j")
    top = toy_pairs(spark, sf).withColumn("n", F.row_number().over(order)).filter("n <= 3")
    return top.withColumn("d", S.differences(F.col("chosen"), F.col("rejected"))).select("error_type", "id", "j", "d.tag", F.col("d.chosen").alias("chosen_part"), F.col("d.rejected").alias("rejected_part"))


SQL_JUDGED = f"{SQL_PAIRS}, jd as (select id, j, error_type, {SQL_REASONS} reason, md5(concat_ws('|', id, error_type, j, 42)) h from pr), f as (select * from (select *, row_number() over (partition by error_type, id order by h) n from jd) where n = 1)"


def judged(spark, sf) -> DataFrame:
    p = toy_pairs(spark, sf).withColumn("reason", qc.native_reason(F.col("chosen"), F.col("rejected"), F.col("error_type")))
    return sampling.first_per_id(p.withColumn("rank_hash", T.rank_hash(F.col("id"), F.col("error_type"), F.col("j"))).drop("chosen", "rejected"))


@query(f"{SQL_JUDGED} select error_type, id, j, reason from f")
def pairs_dedupe(spark, sf):
    return judged(spark, sf).select("error_type", "id", "j", "reason")


QUOTA = 500
SQL_QUOTA = f"{SQL_JUDGED}, a as (select *, coalesce(sum((reason = 'ok')::int) over (partition by error_type order by h, id rows between unbounded preceding and 1 preceding), 0) before from f), t as (select * from a where before < {QUOTA})"


@query(f"{SQL_QUOTA} select error_type, id, j from t where reason = 'ok'")
def pairs_quota(spark, sf):
    return sampling.quota(judged(spark, sf), QUOTA).filter("kept").select("error_type", "id", "j")


@query(f"{SQL_QUOTA}, n as (select *, row_number() over (order by case error_type when 'computer_error' then 0 when 'dependency_mismatch' then 1 when 'missing_nodes' then 2 else 3 end, h, id) - 1 k from t where reason = 'ok') select concat_ws('__', id, error_type, k) pair_id from n")
def pair_ids(spark, sf):
    return sampling.number_pairs(sampling.quota(judged(spark, sf), QUOTA).filter("kept")).select("pair_id")


@query(f"{SQL_QUOTA} select error_type, reason, count(*) n from t where reason <> 'ok' group by 1, 2")
def qc_failures(spark, sf):
    return sampling.quota(judged(spark, sf), QUOTA).filter("attempted and reason <> 'ok'").groupBy("error_type", "reason").agg(F.count("*").alias("n"))


@query(f"{SQL_PAIRS} select error_type, count(*) n, sum(length(chosen))::double / count(*) avg_chosen, sum(length(rejected))::double / count(*) avg_rejected, round(sum(length(rejected)::double / greatest(length(chosen), 1)) / count(*), 6) avg_ratio from pr group by 1")
def qc_type_stats(spark, sf):
    return qc.type_stats(toy_pairs(spark, sf)).select("error_type", "n", "avg_chosen", "avg_rejected", F.round("avg_ratio", 6).alias("avg_ratio"))


@query(f"""{WITH}, t as (select id, j, {sql_clean('case when id % 2 = 0 then problem end')} p, {sql_clean('c.solution')} chosen, {sql_clean('txt')} rejected, problem, question from cand c join prob using (id)),
u as (select id, j, case when p <> '' then p else {sql_clean(sql_chat(sql_task(sql_clean)))} end prompt, chosen, rejected from t)
select id, j, md5(prompt) prompt, md5(chosen) chosen, md5(rejected) rejected from u where length(prompt) >= 5 and length(chosen) >= 10 and length(rejected) >= 10 and chosen <> rejected""")
def dpo_clean_filter(spark, sf):
    p = corpus.problems(spark, sf).select("id", "problem", "question")
    rows = corpus.candidates(spark, sf).join(p, "id").withColumn("prompt", F.when(F.col("id") % 2 == 0, F.col("problem")))
    out = qc.clean_training(rows.withColumnsRenamed({"solution": "chosen", "txt": "rejected"}))
    return out.select("id", "j", *[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")])


def with_fields(df: DataFrame) -> DataFrame:
    """Fields that pairs carry along, made of the id."""
    return df.withColumns({"template": F.concat(F.lit("t"), (F.col("id") % 5).cast("string")), "op": 2 + F.col("id") % 19, "mode": F.when(F.col("id") % 2 == 0, "normal"), "length": F.col("id") % 4, "d": (F.col("id") % 3).cast("string")})


SQL_NUMBERED = f"{SQL_QUOTA}, n as (select *, row_number() over (order by case error_type when 'computer_error' then 0 when 'dependency_mismatch' then 1 when 'missing_nodes' then 2 else 3 end, h, id) - 1 k from t where reason = 'ok')"


@query(f"{SQL_NUMBERED} select concat_ws('__', n.id, n.error_type, k) pair_id, n.id, concat('t', n.id % 5) template, 2 + n.id % 19 op, case when n.id % 2 = 0 then 'normal' end \"mode\", n.id % 4 \"length\", cast(n.id % 3 as varchar) d, n.error_type, md5({sql_chat(sql_task(sql_strip))}) prompt, md5(chosen) chosen, md5(rejected) rejected, {sql_strip('problem')} source_problem, {sql_strip('question')} source_question from n join pr using (id, j) join prob using (id)")
def pair_fields(spark, sf):
    """Published pairs with the record's fields, by the rules that SQL has too."""
    texts = with_fields(corpus.problems(spark, sf).select("id", "problem", "question"))
    numbered = sampling.number_pairs(sampling.quota(judged(spark, sf), QUOTA).filter("kept"))
    both = toy_pairs(spark, sf).select("id", "j", "chosen", "rejected")
    return pipelines.pair_record(numbered.join(texts, "id").join(both, ["id", "j"])).withColumns({c: F.md5(c) for c in ("prompt", "chosen", "rejected")})


@query()
def build_pairs(spark, sf):
    """The whole pair construction, with all rules."""
    return pipelines.build_pairs(with_fields(corpus.problems(spark, sf)), per_type=QUOTA)


# ---- samples -------------------------------------------------------------------------------------------------------
@query(f"{WITH}, r as (select id, row_number() over (order by md5(concat_ws('|', id, 30)), id) n, count(*) over () c from sol) select id, n <= ceil(0.1::double * c) is_test from r")
def train_test_split(spark, sf):
    return sampling.split(corpus.solutions(spark, sf).select("id"), "id").select("id", "is_test")


@query(f"{WITH} select id from sol order by md5(concat_ws('|', id, 42)), id limit 100")
def sample_n(spark, sf):
    return sampling.sample(corpus.solutions(spark, sf).select("id"), "id", 100)


# ---- generation log ------------------------------------------------------------------------------------------------
KINDS = K.GENERATED_ERROR_TYPES
SQL_LOG = f"""{WITH}, lg as (select id, error_type, case id % 5 when 0 then 'not json' when 1 then '{{}}' when 2 then concat('note {{"', error_type, '":{{"rejected":"r', id, '"}}}} end') when 3 then concat('{{"', error_type, '":{{"rejected":5}}}}') else concat('{{"', error_type, '":{{"other":"x"}}}}') end reply,
 case when id % 3 = 0 then 'failed' else 'ok' end status, id % 7 prompt_tokens, id % 11 completion_tokens, id % 7 + id % 11 total_tokens from sol cross join (values ('{KINDS[0]}'), ('{KINDS[1]}'), ('{KINDS[2]}')) k(error_type))"""


def toy_log(spark, sf) -> DataFrame:
    s = corpus.solutions(spark, sf).select("id", F.explode(F.array(*map(F.lit, KINDS))).alias("error_type"))
    i, kind = F.col("id"), F.col("error_type")
    body = lambda inner: F.concat(F.lit('{"'), kind, F.lit('":{'), inner, F.lit("}}"))
    good = F.concat(F.lit("note "), body(F.concat(F.lit('"rejected":"r'), i.cast("string"), F.lit('"'))), F.lit(" end"))
    reply = F.when(i % 5 == 0, "not json").when(i % 5 == 1, "{}").when(i % 5 == 2, good).when(i % 5 == 3, body(F.lit('"rejected":5'))).otherwise(body(F.lit('"other":"x"')))
    return s.select("id", "error_type", reply.alias("reply"), F.when(i % 3 == 0, "failed").otherwise("ok").alias("status"), (i % 7).alias("prompt_tokens"), (i % 11).alias("completion_tokens"), (i % 7 + i % 11).alias("total_tokens"))


@query(f"{SQL_LOG} select id, error_type, case id % 5 when 0 then 'not_json' when 1 then 'missing_key' when 3 then 'not_string' when 4 then 'missing_rejected' end error, case when id % 5 = 2 then regexp_extract(reply, '\"rejected\":\"([^\"]*)\"', 1) end rejected from lg")
def llm_log_validate(spark, sf):
    log = toy_log(spark, sf)
    return log.select("id", "error_type", *[c.alias(n) for n, c in generation.reply_fields(F.col("reply"), F.col("error_type")).items()])


@query(f"{SQL_LOG}, it as (select id, error_type from sol cross join (values ('{KINDS[0]}'), ('{KINDS[1]}'), ('{KINDS[2]}')) k(error_type)) select id, error_type from it where not exists (select 1 from lg where lg.id = it.id and lg.error_type = it.error_type and status = 'ok')")
def llm_resume_antijoin(spark, sf):
    items = corpus.solutions(spark, sf).select("id", F.explode(F.array(*map(F.lit, KINDS))).alias("error_type"))
    return generation.pending(items, toy_log(spark, sf))


@query(f"{SQL_LOG} select sum(prompt_tokens)::bigint prompt_tokens, sum(completion_tokens)::bigint completion_tokens, sum(total_tokens)::bigint total_tokens from lg")
def llm_token_usage(spark, sf):
    return generation.token_usage(toy_log(spark, sf))


def stub_model() -> Callable[[str], tuple[str, dict]]:
    """A generator made of the order's number: good at once, good at the second try, never answering, or never good."""
    tries: dict[str, int] = {}

    def model(prompt: str) -> tuple[str, dict]:
        tries[prompt] = tries.get(prompt, 0) + 1
        number = int(re.search(r"Order (\d+) has", prompt)[1])
        kind = next(k for k in KINDS if f'"{k}"' in prompt)
        if number % 4 == 2:
            raise RuntimeError("no answer")
        good = number % 4 == 0 or number % 4 == 1 and tries[prompt] % 3 == 2
        reply = json.dumps({kind: {"rejected": f"r{number}"}}) if good else json.dumps({kind: {"rejected": 5}}) if number % 4 == 3 else "not json"
        return reply, {"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5}

    return model


@query(f"""{WITH}, x as (select id, error_type, [1, 2, 3, 3][id % 4 + 1] attempts, [1, 2, 0, 3][id % 4 + 1] answered from sol cross join (values ('{KINDS[0]}'), ('{KINDS[1]}'), ('{KINDS[2]}')) k(error_type))
select cast(id as varchar) id, error_type, case when id % 4 < 2 then 'ok' else 'failed' end status, attempts, case id % 4 when 2 then null when 3 then concat('{{"', error_type, '": {{"rejected": 5}}}}') else concat('{{"', error_type, '": {{"rejected": "r', id, '"}}}}') end reply,
case id % 4 when 2 then 'no answer' when 3 then 'not_string' end error, 2 * answered prompt_tokens, 3 * answered completion_tokens, 5 * answered total_tokens from x""")
def llm_generate_stub(spark, sf):
    """Requests of every type to a stub, with the retries that bad replies and errors cause."""
    wanted = reporting.requests(corpus.problems(spark, sf).select("id", "problem", "question", "solution"))
    asked = wanted.withColumn("prompt", reporting.request_prompts(K.REQUEST_TEMPLATES))
    return generation.generate(asked, stub_model(), sleep=lambda _: None)


# ---- several models ------------------------------------------------------------------------------------------------
RAW_NAMES = (*[n for n, _ in K.MODEL_NAMES], "dpo_full_mismatch_414_extra", "QWEN2_0.5B_SFT_OP10_CHECKPOINT-10339", "mix_disorder_compute_error_200each", "injection_missing_1pct", "someone_else", "base")
SQL_RAW = "(values " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(RAW_NAMES)) + ") r(k, raw)"


def raw_names(spark) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, RAW_NAMES))).alias("k", "raw"))


SQL_MODEL_NAME = "case " + " ".join(f"when contains(lower(raw), '{n.lower()}') or contains('{n.lower()}', lower(raw)) then '{s}'" for n, s in K.MODEL_NAMES) + " else raw end"


def sql_held(words) -> str:
    return "(" + " or ".join(f"contains(lower(raw), '{w}')" for w in words) + ")"


SQL_FIGURE = f"case when {sql_held(K.FIGURE_GATE)} then case {' '.join(f'when {sql_held(words)} then {chr(39)}{name}{chr(39)}' for name, words in K.FIGURE_NAMES)} else raw end else raw end"


@query(f"select k, raw, {SQL_MODEL_NAME} model, {SQL_FIGURE} figure from {SQL_RAW}")
def model_name_rules(spark, sf):
    return raw_names(spark).select("k", "raw", reports.model_name(F.col("raw")).alias("model"), reports.figure_name(F.col("raw")).alias("figure"))


@query(f"select raw, coalesce(p, {len(K.MODEL_ORDER)}) pos from (select raw, nullif(coalesce(list_position({[*K.MODEL_ORDER]}, {SQL_MODEL_NAME}), 0), 0) - 1 p from {SQL_RAW})")
def ordered_model_sort(spark, sf):
    out = raw_names(spark).withColumn("pos", reports.position(reports.model_name(F.col("raw")), K.MODEL_ORDER))
    return out.orderBy(F.col("pos").asc_nulls_last(), "raw").select("raw", F.coalesce(F.col("pos"), F.lit(len(K.MODEL_ORDER))).cast("int").alias("pos"))


SQL_MODELS = f"{WITH}, {SQL_SCORED}, mo as (select m, model from (values {', '.join(f'({k}, {chr(39)}{m}{chr(39)})' for k, m in enumerate(K.MODEL_ORDER))}) x(m, model)), ms as (select model, id, op, {sql_bucket('op')} bucket, (j + 4 - m % 4) % 4 j, ok and (id + m) % 6 <> 0 ok from sc cross join mo), pp as (select model, id, op, bucket, {', '.join(f'bool_or(ok) filter (where j < {k}) pass_{k}' for k in KS)} from ms group by all)"


def model_hits(spark, sf) -> DataFrame:
    """Six models with the corpus candidates in other orders and with other problems failed."""
    scored = passk.score_answers(corpus.candidates(spark, sf), T.last_number(F.col("solution")))
    m = scored.select("id", "op", "j", "is_correct", F.posexplode(F.array(*map(F.lit, K.MODEL_ORDER))).alias("m", "model"))
    m = m.select("model", "id", "op", ((F.col("j") + 4 - F.col("m") % 4) % 4).alias("j"), (F.col("is_correct") & ((F.col("id") + F.col("m")) % 6 != 0)).alias("is_correct"))
    return passk.per_problem(m, ["model", "id", "op"], KS).withColumn("bucket", T.op_bucket(F.col("op")))


@query(f"{SQL_MODELS}, l as (select model, {SQL_RATES} from pp group by model) select model, pass_1 overall_pass_1, pass_2 overall_pass_2, pass_4 overall_pass_4 from l")
def overall_pivot(spark, sf):
    wide = model_hits(spark, sf).groupBy("model").agg(*passk.rates(None, FLAGS))
    long = reports.unpivot_metrics(wide.select("model", *FLAGS), ["model"], FLAGS)
    return reports.pivot_metrics(long, ["model"], "metric", "value", FLAGS, "overall_")


@query(f"{SQL_MODELS}, l as (select model, bucket, {SQL_RATES} from pp group by model, bucket) select model, bucket, unnest(['pass_1', 'pass_2', 'pass_4']) metric, unnest([pass_1, pass_2, pass_4]) \"value\" from l")
def metrics_unpivot(spark, sf):
    wide = model_hits(spark, sf).groupBy("model", "bucket").agg(*passk.rates(None, FLAGS)).select("model", "bucket", *FLAGS)
    return reports.unpivot_metrics(wide, ["model", "bucket"], FLAGS)


SQL_BY_BUCKET = f"{SQL_MODELS}, l as (select model, bucket, {SQL_RATES} from pp group by model, bucket)"


@query(f"{SQL_BY_BUCKET} select model, max(pass_1) filter (where bucket = 'op_2_10') op_2_10, max(pass_1) filter (where bucket = 'op_11_14') op_11_14, max(pass_1) filter (where bucket = 'op_15_20') op_15_20 from l group by model")
def bucket_pivot(spark, sf):
    wide = model_hits(spark, sf).groupBy("model", "bucket").agg(*passk.rates(None, FLAGS))
    return reports.pivot_metrics(wide, ["model"], "bucket", "pass_1", [*K.BUCKETS])


@query(f"{SQL_BY_BUCKET} select model, b.bucket, coalesce(l.pass_4, 0.0) pass_4 from (select model from mo union all select 'absent') cross join (values ('op_2_10'), ('op_11_14'), ('op_15_20')) b(bucket) left join l using (model, bucket)")
def model_bucket_grid(spark, sf):
    wide = model_hits(spark, sf).groupBy("model", "bucket").agg(*passk.rates(None, FLAGS))
    return reports.grid([*K.MODEL_ORDER, "absent"], wide, "pass_4", spark)


@query(f"{SQL_BY_BUCKET} select h.model, h.bucket, h.pass_1 / nullif(a.pass_1, 0) retention from l h left join l a on a.model = h.model and a.bucket = 'op_2_10' where h.bucket in ('op_11_14', 'op_15_20')")
def retention_vs_easy(spark, sf):
    wide = model_hits(spark, sf).groupBy("model", "bucket").agg(*passk.rates(None, FLAGS))
    return reports.retention(wide, "pass_1")


SQL_GAPS = f"{SQL_BY_BUCKET}, g as (select m.model, b.bucket, coalesce(l.pass_4 - l.pass_1, 0.0) gap from (select model from mo union all select 'absent') m cross join (values ('op_2_10'), ('op_11_14'), ('op_15_20')) b(bucket) left join l on l.model = m.model and l.bucket = b.bucket)"


@query(f"{SQL_GAPS} select * from g")
def bucket_gap(spark, sf):
    """The gap of two rates in every bucket of every model, 0 where a model was not measured."""
    wide = model_hits(spark, sf).groupBy("model", "bucket").agg(*passk.rates(None, FLAGS))
    return reports.bucket_gaps([*K.MODEL_ORDER, "absent"], wide, "pass_4", "pass_1", spark)


@query(f"{SQL_BY_BUCKET}, r as (select 'pass_1' metric, h.model, h.bucket, h.pass_1 / nullif(a.pass_1, 0) v from l h join l a on a.model = h.model and a.bucket = 'op_2_10' union all select 'pass_4', h.model, h.bucket, h.pass_4 / nullif(a.pass_4, 0) from l h join l a on a.model = h.model and a.bucket = 'op_2_10') select metric, model, max(v) filter (where bucket = 'op_11_14') op_11_14, max(v) filter (where bucket = 'op_15_20') op_15_20 from r group by all")
def retention_pivot(spark, sf):
    wide = model_hits(spark, sf).groupBy("model", "bucket").agg(*passk.rates(None, FLAGS))
    return reports.retentions(wide, ["pass_1", "pass_4"])


SQL_EXPERIMENTS = ", ".join(f"('exp1', '{n}')" for n in K.MIXTURES) + ", " + ", ".join(f"('exp2', '{n}')" for n in K.INJECTIONS)
SQL_PLACES = ", ".join(f"{{'at': instr(n, '{w}'), 't': '{t}'}}" for w, t in K.MIXTURE_TYPES.items())


@query(rf"""with e(g, n) as (values {SQL_EXPERIMENTS}), p as (select *, list_sort(list_filter([{SQL_PLACES}], lambda x: x.at > 0)) t, try_cast(nullif(regexp_extract(n, '_(\d+)pct_', 1), '') as int) pct, coalesce(try_cast(nullif(regexp_extract(n, '_total(\d+)$', 1), '') as int), 2 * try_cast(nullif(regexp_extract(n, '_(\d+)each$', 1), '') as int)) total from e),
q as (select *, cast(case when pct is null then total // 2 else total * pct // 100 end as int) first_n from p)
select g exp_group, n experiment, t[1].t first_type, first_n, t[2].t second_type, total - first_n second_n, total from q""")
def experiment_dimension(spark, sf):
    return reporting.experiments(spark)


@query(f"{SQL_MODELS}, e as (select model, avg(pass_1::int) filter (where bucket = 'op_2_10') easy, avg(pass_1::int) filter (where bucket in ('op_11_14', 'op_15_20')) hard from pp group by model) select model, easy, hard, case when hard is not null and easy > 0 then greatest(0.0::double, (easy - hard) / easy) end decay from e")
def model_decay(spark, sf):
    return passk.decay(model_hits(spark, sf), keys=["model"])


@query(f"{SQL_MODELS}, o as (select model, op, count(*) filter (where pass_4) n from pp where model in ('sft', 'compute_error', 'missing_nodes', 'dependency_mismatch') group by model, op) select model, op, avg(n) over (partition by model order by op rows between 1 preceding and 1 following) smoothed from o")
def boundary_moving_avg(spark, sf):
    by_op = model_hits(spark, sf).filter(F.col("model").isin(*K.MAIN_MODELS)).groupBy("model", "op").agg(F.count_if("pass_4").cast("double").alias("n"))
    return reports.moving_average(by_op, "n")


@query(f"{SQL_PAIRS}, u as (select error_type, count(*) n from pr where error_type = 'computer_error' group by 1 union all select error_type, count(*) from pr where error_type = 'disorder' group by 1 union all select 'mixed', count(*) from pr where error_type in ('computer_error', 'disorder')) select * from u")
def mixed_union(spark, sf):
    p = toy_pairs(spark, sf)
    one, two = (p.filter(F.col("error_type") == t) for t in ("computer_error", "disorder"))
    mixed = one.unionByName(two)
    return mixed.groupBy("error_type").agg(F.count("*").alias("n")).unionByName(mixed.agg(F.lit("mixed").alias("error_type"), F.count("*").alias("n")).select("error_type", "n"))


@query(f"{SQL_MODELS}, b as (select model model_name, 'bucket' evaluation_type, bucket evaluation_target, {SQL_RATES} from pp group by model, bucket), o as (select model model_name, 'overall' evaluation_type, 'overall' evaluation_target, count(*) filter (where pass_1)::double / count(*) pass_1, count(*) num_samples from pp group by model) select * from b union all by name select * from o")
def merge_runs(spark, sf):
    h = model_hits(spark, sf)
    level = lambda kind, target: [F.lit(kind).alias("evaluation_type"), target.alias("evaluation_target")]
    b = h.groupBy("model", "bucket").agg(*passk.rates(None, FLAGS)).select(F.col("model").alias("model_name"), *level("bucket", F.col("bucket")), *FLAGS, "num_samples")
    o = h.groupBy("model").agg(*passk.rates(None, ["pass_1"])).select(F.col("model").alias("model_name"), *level("overall", F.lit("overall")), "pass_1", "num_samples")
    return reports.merge([b, o])
