"""Registered queries: bulk criteria validation, intent resolution, tagging, vocabulary checks and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.fixtures import Fixtures
from pointpanel.functions.rounding import half_up
from pointpanel.functions.vocabulary import CONCEPTS
from pointpanel.operators import concepts
from pointpanel.plans.oracle_views import rnd

_F1 = ("CASE k % 6 WHEN 0 THEN 'PeRatio' WHEN 1 THEN 'PbRatio' WHEN 2 THEN 'ClosePrice' WHEN 3 THEN 'Volume' "
       "WHEN 4 THEN 'DebtToEquity' ELSE 'Momentum' END")
_O1 = ("CASE k % 7 WHEN 0 THEN 'LessThan' WHEN 1 THEN 'LessThanOrEqual' WHEN 2 THEN 'GreaterThan' "
       "WHEN 3 THEN 'GreaterThanOrEqual' WHEN 4 THEN 'LessThan' WHEN 5 THEN 'GreaterThan' ELSE 'Equal' END")
_SHAPE = "CASE WHEN k % 17 = 3 THEN 'empty' WHEN k % 13 = 4 THEN 'deep' WHEN k % 29 = 2 THEN 'many' ELSE 'flat' END"
_OP = "CASE WHEN k % 11 = 5 THEN 'Or' ELSE 'And' END"
_LIMIT = "CASE k % 19 WHEN 7 THEN 0 WHEN 8 THEN 1001 WHEN 9 THEN NULL ELSE 50 END"
_SORT = "k % 23 = 1"


def criteria(fx: Fixtures) -> DataFrame:
    """One criteria document per customer; some break one rule or several."""
    c = fx.table("customer").selectExpr("c_custkey AS k").selectExpr(
        "k", f"{_F1} AS f1", f"{_O1} AS o1", "k % 120 AS v1", f"{_SHAPE} AS shape", f"{_OP} AS op", f"{_LIMIT} AS lim", f"{_SORT} AS odd_sort"
    )
    one = F.format_string('{"kind":"comparison","field":"%s","operator":"%s","value":%s}', "f1", "o1", F.col("v1").cast("string"))
    fixed = F.lit('{"kind":"comparison","field":"ReturnOnEquity","operator":"GreaterThan","value":5}')
    deep = one
    for _ in range(3):
        deep = F.concat(F.lit('{"kind":"group","op":"And","children":['), deep, F.lit("]}"))
    children = (
        F.when(F.col("shape") == "empty", "")
        .when(F.col("shape") == "deep", deep)
        .when(F.col("shape") == "many", F.array_join(F.array_repeat(one, 21), ","))
        .otherwise(F.concat(one, F.lit(","), fixed))
    )
    limit = F.coalesce(F.concat(F.lit(',"limit":'), F.col("lim").cast("string")), F.lit(""))
    sort = F.when(F.col("odd_sort"), ',"sort":{"field":"Bogus","direction":"Asc"}').otherwise("")
    text = F.concat(F.lit('{"universe":{},"root":{"kind":"group","op":"'), "op", F.lit('","children":['), children, F.lit("]}"), sort, limit, F.lit("}"))
    return c.select(F.col("k").alias("strategy_id"), text.alias("criteria_json"))


def q_criteria_validate_bulk(spark, sf):
    return concepts.validate_criteria(criteria(Fixtures(spark, sf)))


SPOKEN = [k for name, aliases, _ in CONCEPTS for k in [name.replace("_", " "), *aliases]]
SPOKEN_CONCEPT = [name for name, aliases, _ in CONCEPTS for _ in [name, *aliases]]
N = len(SPOKEN)


def _spoken(i):
    return F.element_at(F.array(*[F.lit(s) for s in SPOKEN]), (i + 1).cast("int"))


def _meant(i):
    return F.element_at(F.array(*[F.lit(s) for s in SPOKEN_CONCEPT]), (i + 1).cast("int"))


def intents(fx: Fixtures) -> DataFrame:
    """What a parser made of each customer's request."""
    k = F.col("c_custkey")
    named = F.array(_spoken(k % N), _spoken(k * 7 % N))
    named = F.when(k % 9 == 4, F.array_append(named, F.lit("momentum"))).otherwise(named)
    none = F.array().cast("array<struct<field:string,operator:string,value:double>>")

    def one(field, op, value):
        return F.array(F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), value.cast("double").alias("value")))

    filters = F.when(k % 31 == 2, one("cheap", "LessThan", k % 10)).when(k % 3 == 0, one("PeRatio", "LessThan", k % 40)).when(
        k % 3 == 1, one("DebtToEquity", "GreaterThan", k % 60)).otherwise(none)
    empty = k % 37 == 5
    return fx.table("customer").select(
        k.alias("intent_id"), F.when(empty, F.array().cast("array<string>")).otherwise(named).alias("concepts"),
        F.when(empty, none).otherwise(filters).alias("filters"),
    )


def q_intent_resolve_bulk(spark, sf):
    return concepts.resolve_intents(intents(Fixtures(spark, sf)))


def prompts(fx: Fixtures) -> DataFrame:
    """Documents and conversation turns, each opening with a request that names two concepts."""
    d = fx.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    c = fx.table("conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return d.unionByName(c).withColumns({"i": F.col("id") % N, "j": F.col("id") * 7 % N}).withColumn(
        "prompt", F.concat(F.lit("Show "), _spoken(F.col("i")), F.lit(" but "), _spoken(F.col("j")), F.lit(" names!\n"), "text")
    )


def q_concept_tagging(spark, sf):
    return prompts(Fixtures(spark, sf)).select(
        "kind", "id", F.explode_outer(concepts.tags(F.col("prompt"))).alias("concept")
    ).filter(F.col("concept").isNotNull())


def q_eval_pass_rate(spark, sf):
    """Concepts tagged in whole texts against those intended; a request whose opening line holds a digit should have been asked back."""
    p = prompts(Fixtures(spark, sf)).withColumn("head", F.split("prompt", "\n")[0])
    p = p.withColumn("head", F.when(F.col("id") % 10 == 0, F.concat("head", F.lit(" under 12"))).otherwise(F.col("head")))
    none = F.array().cast("array<string>")
    whole = F.concat_ws("\n", "head", "text")
    cases = p.select(
        F.array(_meant(F.col("i")), _meant(F.col("j"))).alias("expected_concepts"), concepts.tags(whole).alias("actual_concepts"),
        F.when(F.col("id") % 5 == 1, F.array(F.lit("PeRatio LessThan 12"))).otherwise(none).alias("expected_filters"), none.alias("actual_filters"),
        (F.col("id") % 20 == 0).alias("expect_clarification"), F.col("head").rlike(r"\d").alias("got_clarification"),
    )
    out = concepts.score(cases)
    return out.select("n", *[half_up(c, 4).alias(c) for c in ("concept_pass_rate", "filter_pass_rate")])


def drafts(fx: Fixtures) -> DataFrame:
    """A concept draft per customer, owned by a nation's desk."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Desk Pick "), (k % 400).cast("string"))
    aliases = F.array(
        F.concat(F.lit("pick-"), k.cast("string")),
        F.when(k % 5 == 0, name).otherwise(F.concat(F.lit("own "), k.cast("string"))),
        F.when(k % 7 == 0, F.lit("Blue Chip")).when(k % 11 == 0, F.lit("!!")).otherwise(F.concat(F.lit("PICK "), k.cast("string"), F.when(k % 3 == 0, "").otherwise("b"))),
    )
    many = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.concat(F.lit("m "), k.cast("string"), F.lit(" "), i.cast("string")))
    return fx.table("customer").select(
        k.alias("draft_id"), F.col("c_nationkey").alias("owner"), name.alias("name"), F.when(k % 13 == 1, many).otherwise(aliases).alias("aliases")
    )


def q_concept_conflicts(spark, sf):
    return concepts.draft_errors(drafts(Fixtures(spark, sf)))


QUERIES = {
    "criteria_validate_bulk": q_criteria_validate_bulk, "intent_resolve_bulk": q_intent_resolve_bulk,
    "concept_tagging": q_concept_tagging, "eval_pass_rate": q_eval_pass_rate, "concept_conflicts": q_concept_conflicts,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_C = f"""WITH c AS (SELECT *, CASE shape WHEN 'deep' THEN 'root.children[0].children[0].children[0].children[0]' END AS deep_path FROM (
  SELECT c_custkey AS k, {_F1.replace('k %', 'c_custkey %')} AS f1, {_O1.replace('k %', 'c_custkey %')} AS o1, c_custkey % 120 AS v1,
         {_SHAPE.replace('k %', 'c_custkey %')} AS shape, {_OP.replace('k %', 'c_custkey %')} AS op, {_LIMIT.replace('k %', 'c_custkey %')} AS lim FROM customer) t),
cmp AS (SELECT *, deep_path AS p FROM c WHERE shape = 'deep' UNION ALL SELECT *, 'root.children[0]' FROM c WHERE shape = 'flat'
        UNION ALL SELECT c.*, concat('root.children[', i, ']') FROM c CROSS JOIN range(21) r(i) WHERE shape = 'many')
SELECT k AS strategy_id, 'root' AS path, 'TreeTooDeep' AS code FROM c WHERE shape = 'deep'
UNION ALL SELECT k, 'root', 'TooManyComparisons' FROM c WHERE shape = 'many'
UNION ALL SELECT k, 'root', unnest(['NoComparisons', 'EmptyGroup']) FROM c WHERE shape = 'empty'
UNION ALL SELECT k, 'root', 'OperatorNotSupportedInV1' FROM c WHERE op = 'Or'
UNION ALL SELECT k, 'sort.field', 'UnknownConcept' FROM c WHERE k % 23 = 1
UNION ALL SELECT k, 'limit', 'InvalidLimit' FROM c WHERE lim = 0 OR lim > 1000
UNION ALL SELECT k, concat(p, '.field'), 'UnknownConcept' FROM cmp WHERE f1 = 'Momentum'
UNION ALL SELECT k, concat(p, '.operator'), 'OperatorNotAllowedForField' FROM cmp WHERE f1 <> 'Momentum' AND o1 = 'Equal'
UNION ALL SELECT k, concat(p, '.value'), 'ValueOutOfRange' FROM cmp WHERE (f1 = 'PbRatio' AND v1 > 100) OR (f1 = 'DebtToEquity' AND v1 > 50)"""

_SPOKEN_SQL = ", ".join(f"({i}, {_q(s)}, {_q(c)})" for i, (s, c) in enumerate(zip(SPOKEN, SPOKEN_CONCEPT)))
_DEF_SQL = ", ".join(f"({_q(n)}, {_q(f)}, {_q(o)}, {v}::DOUBLE)" for n, _, d in CONCEPTS for f, o, v in d)
_INTENT = f"""WITH spoken AS (SELECT * FROM (VALUES {_SPOKEN_SQL}) t(i, s, concept)), defs AS (SELECT * FROM (VALUES {_DEF_SQL}) t(concept, field, operator, value)),
cust AS (SELECT c_custkey AS k, c_custkey % 37 = 5 AS empty FROM customer),
named AS (SELECT DISTINCT k, concept FROM cust JOIN spoken ON i = k % {N} OR i = k * 7 % {N} WHERE NOT empty),
filt AS (SELECT k, CASE WHEN k % 31 = 2 THEN 'cheap' WHEN k % 3 = 0 THEN 'PeRatio' ELSE 'DebtToEquity' END AS field,
           CASE WHEN k % 31 = 2 OR k % 3 = 0 THEN 'LessThan' ELSE 'GreaterThan' END AS operator,
           CAST(CASE WHEN k % 31 = 2 THEN k % 10 WHEN k % 3 = 0 THEN k % 40 ELSE k % 60 END AS DOUBLE) AS value FROM cust WHERE NOT empty AND (k % 31 = 2 OR k % 3 < 2)),
err1 AS (SELECT k, 'UnknownStrategyConcept' AS code FROM cust WHERE NOT empty AND k % 9 = 4 UNION ALL SELECT k, 'UnknownConcept' FROM filt WHERE field = 'cheap'
         UNION ALL SELECT k, 'EmptyIntent' FROM cust WHERE empty),
comp AS (SELECT n.k, d.field, d.operator, d.value FROM named n JOIN defs d USING (concept) WHERE NOT EXISTS (SELECT 1 FROM filt f WHERE f.k = n.k AND f.field = d.field)
         UNION ALL SELECT * FROM filt),
err2 AS (SELECT k, 'ValueOutOfRange' AS code FROM comp WHERE field = 'DebtToEquity' AND value > 50 AND k NOT IN (SELECT k FROM err1)),
err AS (SELECT * FROM err1 UNION ALL SELECT * FROM err2)
SELECT k AS intent_id, 'error' AS kind, code AS field, CAST(NULL AS VARCHAR) AS operator, CAST(NULL AS DOUBLE) AS value FROM err
UNION ALL SELECT k, 'comparison', field, operator, value FROM comp WHERE k NOT IN (SELECT k FROM err)"""

_PROMPT = f"""spoken AS (SELECT * FROM (VALUES {_SPOKEN_SQL}) t(i, s, concept)),
src AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations),
prompts AS (SELECT p.kind, p.id, concat('Show ', a.s, ' but ', b.s, ' names!') AS head, p.text, a.concept AS ca, b.concept AS cb
            FROM src p JOIN spoken a ON a.i = p.id % {N} JOIN spoken b ON b.i = p.id * 7 % {N})"""


def _tag_chain(text: str) -> str:
    """The keys removed one after the other, longest first; each column is the text left so far."""
    cols = [f"concat('_', trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+', '_', 'g'), '_'), '_') AS r0"]
    for n, (k, _) in enumerate(concepts.tag_keys(), 1):
        cols.append(f"replace(r{n - 1}, {_q('_' + k + '_')}, '_') AS r{n}")
    hits = ", ".join(f"CASE WHEN r{n} <> r{n - 1} THEN {_q(c)} END" for n, (_, c) in enumerate(concepts.tag_keys(), 1))
    return f"tagged AS (SELECT *, [{hits}] AS hits FROM (SELECT *, {', '.join(cols)} FROM heads) z)"


_DRAFT = """WITH d AS (SELECT c_custkey AS k, c_nationkey AS owner, concat('desk_pick_', c_custkey % 400) AS name, CASE WHEN c_custkey % 13 = 1
  THEN [concat('m_', c_custkey, '_', i) for i in range(1, 14)] ELSE [concat('pick_', c_custkey), CASE WHEN c_custkey % 5 = 0 THEN concat('desk_pick_', c_custkey % 400) ELSE concat('own_', c_custkey) END,
  CASE WHEN c_custkey % 7 = 0 THEN 'blue_chip' WHEN c_custkey % 11 = 0 THEN '' ELSE concat('pick_', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'b' END) END] END AS al FROM customer),
a AS (SELECT k, owner, name, unnest(al) AS key, generate_subscripts(al, 1) - 1 AS pos FROM d),
claims AS (SELECT k, owner, key, concat('aliases[', pos, ']') AS path FROM a WHERE key <> '' UNION ALL SELECT k, owner, name, 'name' FROM d)
SELECT k AS draft_id, 'aliases' AS path, 'InvalidConceptName' AS code FROM d WHERE len(al) > 12
UNION SELECT k, concat('aliases[', pos, ']'), 'InvalidConceptName' FROM a WHERE key = ''
UNION SELECT k, concat('aliases[', pos, ']'), 'ConceptNameInUse' FROM a WHERE key = name
UNION SELECT x.k, concat('aliases[', x.pos, ']'), 'ConceptNameInUse' FROM a x JOIN a y ON x.k = y.k AND x.key = y.key AND y.pos < x.pos WHERE x.key <> ''
UNION SELECT k, path, 'ConceptNameInUse' FROM claims WHERE key = 'blue_chip'
UNION SELECT k, path, 'KeyContested' FROM claims c WHERE EXISTS (SELECT 1 FROM claims o WHERE o.owner = c.owner AND o.key = c.key AND o.k <> c.k)"""

_SAME = "list_sort(list_distinct([ca, cb])) = list_sort(list_distinct(list_filter(hits, lambda h: h IS NOT NULL)))"
ORACLES = {
    "criteria_validate_bulk": _C,
    "intent_resolve_bulk": _INTENT,
    "concept_tagging": f"WITH {_PROMPT}, heads AS (SELECT *, concat(head, chr(10), text) AS t FROM prompts), {_tag_chain('t')} "
                       "SELECT DISTINCT kind, id, concept FROM (SELECT kind, id, unnest(hits) AS concept FROM tagged) u WHERE concept IS NOT NULL",
    "eval_pass_rate": f"WITH {_PROMPT}, heads AS (SELECT *, concat(CASE WHEN id % 10 = 0 THEN concat(head, ' under 12') ELSE head END, chr(10), text) AS t FROM prompts), {_tag_chain('t')} "
                      f"SELECT count(*) AS n, {rnd(f'100 * CAST(count(*) FILTER (id % 20 = 0 OR (id % 10 <> 0 AND {_SAME})) AS DOUBLE) / count(*)', 4)} AS concept_pass_rate, "
                      f"{rnd('100 * CAST(count(*) FILTER (id % 20 = 0 OR (id % 10 <> 0 AND id % 5 <> 1)) AS DOUBLE) / count(*)', 4)} AS filter_pass_rate FROM tagged",
    "concept_conflicts": _DRAFT,
}
