"""Sentences from computed numbers, and questions answered from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeflow.operators import impact as im
from scopeflow.operators import planner as pl
from scopeflow.operators import rollup as ru

# Words that open a greeting, phrases of greetings and of questions about the engine, and words that mark a topic.
GREETINGS = ("hi", "hello", "hey", "yo", "hiya", "sup", "howdy", "greetings", "hallo", "hii")
GREETING_PHRASES = ("good morning", "good afternoon", "good evening", "hey there", "hi there")
ABOUT = ("who are you", "who r u", "what are you", "what r u", "your name", "what can you do", "what do you do", "what can you answer", "what can i ask", "what is this", "how do i use", "what do you know")
TOPICS = ("scope", "how many", "confirmed", "inferred", "hitter", "biggest", "distributor", "hidden", "splunk", "bam", "tokeniz", "tokenis", "descope", "crn", "why", "reach", "risk", "leverage", "intervention", "impact")
# Words of each question, asked in this order.
ON_SCOPE = ("scope", "how many", "confirmed", "inferred")
ON_DISTRIBUTORS = ("heavy hitter", "hitter", "biggest", "distributor", "top ", "most pan", "leverage", "intervention", "tokeniz")
ON_HIDDEN = ("hidden", "splunk", "bam miss", "didn't know", "leak", "unknown")
ON_CHANGE = ("tokenize", "tokenise", "what if", "descope", "crn", "clean-stream", "clean stream")


def explanation(estate) -> DataFrame:
    """One paragraph on the estate."""
    t = ru.totals(estate)
    return t.select(F.format_string("%d of %d systems are in scope: %d on recorded flows, %d by inference. %d systems hold card data unknown to the inventory. %d origins feed all of it.", "in_scope", "systems", "confirmed", "inferred_only", "hidden", "origins").alias("explanation"))


def memo_facts(estate, inst: pl.Instance) -> DataFrame:
    """The numbers behind a decision memo as rows (section, item, value): scope, sources, the greedy plan, the origins that matter most, the saturation
    curve, and the three sets to compare."""
    steps = pl.plan_rows(estate, inst)
    freed = steps[-1][3] if steps else 0
    totals = ru.totals(estate).select("in_scope", "carriers", "pan_systems", "hidden", "origins").first()
    known = [("scope", "in_scope", totals.in_scope), ("scope", "descopable", inst.total), ("scope", "after", totals.in_scope - freed)]
    known += [("scope", "declared_pan", totals.carriers), ("scope", "actual_pan", totals.pan_systems), ("scope", "hidden", totals.hidden), ("sources", "true_sources", totals.origins)]
    known += [("greedy_plan", f"{step:02d} {system}", got) for step, system, _, got, *_ in steps]
    rows = estate.spark.createDataFrame([(a, b, str(c)) for a, b, c in known], "section string, item string, value string")
    top = im.exposure(estate).orderBy(F.desc("solo_descope"), F.desc("feeds_removed"), "system").limit(15)
    top = top.select(F.lit("top_sources"), "system", F.concat_ws("/", "downstream_reach", "solo_descope", "parent_reduction"))
    curve = im.saturation(estate).select(F.lit("saturation_curve"), F.col("k").cast("string"), F.col("fully_descoped").cast("string"))
    sets = im.block_comparison(estate, [r[1] for r in steps]).select(F.lit("block_comparison"), "label", F.col("nodes_descoped").cast("string"))
    return rows.unionAll(top).unionAll(curve).unionAll(sets)


def curve_cliff(curve: DataFrame) -> DataFrame:
    """(pre_k, pre_descoped, post_k, post_descoped, delta, max_descoped): the largest rise between neighbours of a saturation curve, the first on ties;
    no row where nothing rises. A curve has a point for each of a few budgets."""
    points = F.array_sort(F.collect_list(F.struct("k", "fully_descoped")))
    n = F.size("p")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((F.get("p", i)["fully_descoped"] - F.get("p", i - 1)["fully_descoped"]).alias("delta"), (-i).alias("at")))
    out = curve.agg(points.alias("p")).where(n > 1).select("p", F.array_max(steps).alias("best")).where("best.delta > 0")
    pre, post = F.get("p", -F.col("best.at") - 1), F.get("p", -F.col("best.at"))
    return out.select(pre["k"].alias("pre_k"), pre["fully_descoped"].alias("pre_descoped"), post["k"].alias("post_k"), post["fully_descoped"].alias("post_descoped"), F.col("best.delta").alias("delta"), F.array_max(F.transform("p", lambda x: x["fully_descoped"])).alias("max_descoped"))


def memo(estate, inst: pl.Instance) -> str:
    facts = {(r.section, r.item): r.value for r in memo_facts(estate, inst).collect()}
    plan = [item.split(" ", 1)[1] for section, item in facts if section == "greedy_plan"]
    c = curve_cliff(im.saturation(estate)).first()
    jump = f" Most of it comes between {c.pre_k} and {c.post_k} sources, where {c.delta} of {c.max_descoped} systems leave at once." if c else ""
    return f"{facts['scope', 'in_scope']} systems are in scope below {facts['sources', 'true_sources']} origins; {facts['scope', 'hidden']} are hidden. Tokenizing {', '.join(plan) or 'nothing'} leaves {facts['scope', 'after']} of them, where {facts['scope', 'descopable']} could go.{jump}"


def hidden_brief(estate) -> str:
    rows = ru.hidden(estate).orderBy(F.desc("downstream_reach"), "system").limit(5).collect()
    return "; ".join(f"{r.system} ({r.finding}, reaches {r.downstream_reach})" for r in rows) or "no hidden systems"


def scope_rationale(estate) -> str:
    """Why systems are in each category, in one sentence a category."""
    n = {r.category: r["count"] for r in estate.facts.groupBy("category").count().collect()}
    return f"{n.get('cde', 0)} systems hold card data, or a flow of it reaches them; {n.get('connected', 0)} hold none but feed one that does; {n.get('out', 0)} are on no such path. Each placement follows from a path in the recorded and inferred flows."


def chat_ids(questions: DataFrame, nodes: DataFrame, key: str = "id", text: str = "question") -> DataFrame:
    """(key, system) for every system that a question names."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([0-9A-Za-z]{2,8})"), F.lit(1)), lambda w: F.upper(w)))
    return questions.select(F.col(key).alias("question"), F.explode(words).alias("system")).join(nodes.select(F.col("id").alias("system")), "system", "left_semi").select("question", "system")


def grounded_answer(estate, question: str) -> tuple[str, list[str]]:
    """The answer and what it rests on. Questions are tried in turn: greeting, scope, distributors, hidden systems (these only if no system is named),
    then what a change at a system does, and why it is in scope."""
    low = question.strip().lower()
    if not low:
        return "Ask about scope, distributors, hidden systems, or a system by its id.", []
    has = lambda words: any(w in low for w in words)
    named = sorted(r.system for r in chat_ids(estate.spark.createDataFrame([(0, question)], "id int, question string"), estate.nodes).collect())
    opening = re.findall(r"[a-z']+", low)[:1]
    greets = (opening and opening[0] in GREETINGS or has(GREETING_PHRASES)) and not has(TOPICS)
    if (greets or has(ABOUT) or low in ("help", "help me", "?")) and not named:
        top = [r.system for r in im.heavy_hitters(estate, 3).collect()]
        return f"I answer from the computed graph alone. {explanation(estate).first().explanation} The widest distributors are {', '.join(top) or 'none'}. Ask about scope, distributors, hidden systems, or a system by its id.", ["totals", *top]
    if has(ON_SCOPE) and not named:
        return explanation(estate).first().explanation, ["totals"]
    if has(ON_DISTRIBUTORS) and not named:
        top = im.heavy_hitters(estate, 5).collect()
        return "Widest distributors: " + ", ".join(f"{r.system} ({r.downstream_reach}, alone {r.solo_descope})" for r in top) + ".", [r.system for r in top]
    if has(ON_HIDDEN) and not named:
        first = [r.system for r in ru.hidden(estate).orderBy(F.desc("downstream_reach"), "system").limit(5).collect()]
        return f"{estate.facts.where('hidden').count()} hidden systems: {hidden_brief(estate)}.", first
    if named and has(ON_CHANGE):
        r = im.impact(estate, im.labelled(estate, {"asked": named[:1]})).first()
        return f"Tokenizing {named[0]} frees {r.nodes_descoped} of {r.scope_before} systems and takes a feed from {r.feeds_removed}.", named[:1]
    if named:
        r = estate.facts.where(F.col("id") == named[0]).first()
        if not r.in_scope:
            return f"{named[0]} is out of scope: no flow of card data reaches it.", named[:1]
        into = estate.edges.where(F.col("dst") == named[0]).groupBy("src").agg(F.max("signal").alias("signal")).orderBy("src").limit(6).collect()
        fed = " It is fed by " + ", ".join(x.src + (f" [{x.signal}]" if x.signal else "") for x in into) + "." if into else ""
        basis = "on recorded flows" if r.confirmed else "by inference alone"
        also = " It is hidden: the inventory calls it out of scope." if r.hidden else ""
        return f"{named[0]} is in scope {basis}: {r.origin_count} origins reach it.{fed}{also} Risk {r.risk}, tier {r.tier}, reaches {r.reach}.", [named[0], *(x.src for x in into)]
    return f"{explanation(estate).first().explanation} I can answer on scope, distributors, hidden systems, and what tokenizing a system would do.", ["totals"]


def answer(estate, question: str) -> str:
    return grounded_answer(estate, question)[0]


def suggested_questions(estate) -> list[str]:
    top = im.top_intervention(estate).first()
    lever = top.system if top else "a source"
    return ["How many systems are in scope?", "Who are the widest distributors?", "Which hidden systems were missed?", f"What if we tokenize {lever}?", f"Why is {lever} in scope?"]
