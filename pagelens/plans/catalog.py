"""Rule sets used by the registered queries over the page tables.

These are rules in the selector form (rules are data); each id maps to the
path it means (``Step.display``).  The first group is simple enough that a
SQL engine can reproduce it with regular expressions over the cleaned page,
which is how the oracle queries check the tree-based engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import learn
from ..operators import select as S
from ..operators.select import Branch, Step

VALIDATION_TASK = "extract article titles"

# (rule id, regex tag pattern for the SQL check, step)
FLAT_RULES = [
    ("r_title", "title", Step([Branch(tags=["title"], output="text")])),
    ("r_h1", "h1", Step([Branch(tags=["h1"], output="text")])),
    ("r_headings", "h[123]", learn.CANDIDATES["title"]),
    ("r_link_text", "a", Step([Branch(tags=["a"], output="text")])),
    ("r_ad", "div", Step([Branch(tags=["div"], class_any=["ad"], output="text")])),
    ("r_footer", "footer", Step([Branch(tags=["footer"], output="text")])),
]
LINKS_RULE = ("r_links", Step([Branch(tags=["a"], output="attr", out_attr="href")]))

# Heavier rules for the throughput bench (descendant texts, every text node)
TREE_RULES = [
    ("r_paragraphs", Step([Branch(tags=["p"], output="text")])),
    ("r_article_text", Step([Branch(tags=["article"], output="desc_text", nonblank=True)])),
    ("r_generic", learn.CANDIDATES["generic"]),
]

# One multi-step rule (E9: step values concatenated, de-duplicated)
MULTI_RULE = ("r_multi", [FLAT_RULES[0][2], FLAT_RULES[1][2], FLAT_RULES[5][2]])

LEARN_TASKS = ["Extract article titles", "Extract all links", "Extract product prices", "Extract page text"]


def flat_steps(spark: SparkSession) -> DataFrame:
    return S.steps_frame(spark, {rid: [st] for rid, _, st in FLAT_RULES})


def bench_steps(spark: SparkSession) -> DataFrame:
    rules = {rid: [st] for rid, _, st in FLAT_RULES}
    rules[LINKS_RULE[0]] = [LINKS_RULE[1]]
    for rid, st in TREE_RULES:
        rules[rid] = [st]
    return S.steps_frame(spark, rules)


#: Rules judged across pages: the flat rules and the multi-step one, of which
#: the last action that finds something counts.
VALIDATED = {rid: [st] for rid, _, st in FLAT_RULES} | {MULTI_RULE[0]: MULTI_RULE[1]}


def validated_steps(spark: SparkSession) -> DataFrame:
    return S.steps_frame(spark, VALIDATED)


def validation_rules(spark: SparkSession) -> DataFrame:
    """(sequence_id, task, rule_ord) for the validated rules."""
    return spark.createDataFrame(
        [(rid, VALIDATION_TASK, i + 1) for i, rid in enumerate(VALIDATED)],
        "sequence_id string, task string, rule_ord int",
    )
