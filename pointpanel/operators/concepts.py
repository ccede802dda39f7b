"""Bulk work on criteria, intents and the concept vocabulary. All of it is row-wise: arrays in, arrays out, no shuffle.

Computed arrays are exploded with ``explode_outer`` and a null filter: for a plain ``explode`` the optimizer adds a filter
on the array's size, which would evaluate the whole fold a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointpanel.functions.text import NOT_A_WORD, concept_key
from pointpanel.functions.vocabulary import (
    ALLOWED_OPERATORS, CONCEPTS, DEFAULT_LIMIT, MAX_ALIASES, MAX_COMPARISONS, MAX_DEPTH, MAX_LIMIT, MAX_NAME_LENGTH, METRICS,
)

# --- criteria ---------------------------------------------------------------------------------------------------------

_NODE = "kind:string,op:string,field:string,operator:string,value:double"
#: Trees of up to so many levels are read with one schema; deeper ones are walked token by token, each at its own cost.
LEVELS = 8
#: A string, a mark or a bare value of a JSON text.
_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_TOKEN = _STRING + r'|[\[\]{}:,]|[^\s\[\]{}:,"]+'


def nesting(text: Column) -> Column:
    """How deeply arrays are nested in a JSON text; brackets inside strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step, lambda acc: acc["most"])


def criteria_schema(levels: int = LEVELS) -> str:
    node = f"struct<{_NODE}>"
    for _ in range(levels - 1):
        node = f"struct<{_NODE},children:array<{node}>>"
    universe = "struct<exchange:string,sector:string,index:string>"
    return f"struct<universe:{universe},root:{node},sort:struct<field:string,direction:string>,limit:int>"


def facts(text: Column) -> Column:
    """(path, name, value) of every scalar member of every object in a JSON text, and (path, '{', null) for the object itself.

    One fold over the tokens with the open objects and arrays as a stack, so the depth of one text costs no other text anything.
    """
    frame = "struct<path:string,at:int>"
    start = F.struct(
        F.array().cast(f"array<{frame}>").alias("stack"), F.lit("").alias("name"), F.lit("").alias("before"),
        F.array().cast("array<struct<path:string,name:string,value:string>>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        stack, top, name = acc["stack"], F.try_element_at(acc["stack"], F.lit(-1)), acc["name"]
        path = F.when(top.isNull(), "").when(top["at"] >= 0, F.concat(top["path"], F.lit("["), top["at"].cast("string"), F.lit("]"))).when(
            top["path"] == "", name).otherwise(F.concat(top["path"], F.lit("."), name))
        opened = F.struct(path.alias("path"), F.when(token == "[", 0).otherwise(-1).alias("at")).cast(frame)
        shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        counted = F.struct(top["path"].alias("path"), (top["at"] + 1).alias("at")).cast(frame)
        row = lambda p, n, v: F.struct(p.alias("path"), n.alias("name"), v.alias("value"))
        value = ~token.isin("{", "}", "[", "]", ":", ",") & (acc["before"] == ":")
        return F.struct(
            F.when(token.isin("{", "["), F.array_append(stack, opened)).when(token.isin("}", "]"), shorter).when(
                (token == ",") & (top["at"] >= 0), F.array_append(shorter, counted)).otherwise(stack).alias("stack"),
            F.when(token == ":", F.regexp_replace(acc["before"], '^"|"$', "")).otherwise(name).alias("name"),
            token.alias("before"),
            F.when(token == "{", F.array_append(acc["out"], row(path, F.lit("{"), F.lit(None).cast("string")))).when(
                value, F.array_append(acc["out"], row(top["path"], name, token))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step, lambda acc: acc["out"])


def _fact(found: Column, path, name: str) -> Column:
    """The last value of a member; a JSON null is null."""
    own = F.filter(found, lambda x: (x["path"] == path) & (x["name"] == name))
    return F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(own, F.lit(-1))["value"], F.lit("}")), "$.v")


def _walked(found: Column) -> Column:
    """The nodes of a tree of any depth, as ``_nodes`` gives them."""
    objects = F.transform(F.filter(found, lambda x: (x["name"] == "{") & x["path"].rlike(r"^root(\.children\[\d+\])*$")), lambda x: x["path"])
    return F.transform(objects, lambda p: F.struct(
        p.alias("path"), _fact(found, p, "kind").alias("kind"), _fact(found, p, "op").alias("op"),
        F.when(F.array_contains(objects, F.concat(p, F.lit(".children[0]"))), 1).otherwise(0).alias("n_children"),
        _fact(found, p, "field").alias("field"), _fact(found, p, "operator").alias("operator"),
        _fact(found, p, "value").try_cast("double").alias("value"),
        F.size(F.split(p, r"\.children\[")).alias("depth")))


def read_criteria(criteria: DataFrame) -> DataFrame:
    """(strategy_id, nodes, exchange, sector, index, sort_field, direction, limit): the parts of each ``criteria_json``."""
    read = criteria.select("strategy_id", "criteria_json", F.from_json("criteria_json", criteria_schema()).alias("c"), (
        nesting(F.col("criteria_json")) >= LEVELS).alias("deep"))
    read = read.withColumn("facts", F.when(F.col("deep"), facts(F.col("criteria_json"))))
    own = lambda path, name, flat: F.when(F.col("deep"), _fact(F.col("facts"), F.lit(path), name)).otherwise(F.col(flat))
    return read.select(
        "strategy_id", F.when(F.col("deep"), _walked(F.col("facts"))).otherwise(_nodes(F.col("c.root"), LEVELS)).alias("nodes"),
        *(own("universe", k, f"c.universe.{k}").alias(k) for k in ("exchange", "sector", "index")),
        own("sort", "field", "c.sort.field").alias("sort_field"), own("sort", "direction", "c.sort.direction").alias("direction"),
        F.when(F.col("deep"), _fact(F.col("facts"), F.lit(""), "limit").try_cast("int")).otherwise(F.col("c.limit")).alias("limit"))


def _nodes(root: Column, levels: int) -> Column:
    """Every node of the tree with its path and depth, level by level."""
    level = F.array(F.struct(F.lit("root").alias("path"), root.alias("node")))
    flat = []
    for depth in range(1, levels + 1):
        leaf = depth == levels

        def project(n, d=depth, last=leaf):
            size = F.lit(0) if last else F.coalesce(F.size(n["node"]["children"]), F.lit(0))
            return F.struct(
                n["path"].alias("path"), n["node"]["kind"].alias("kind"), n["node"]["op"].alias("op"),
                F.greatest(size, F.lit(0)).alias("n_children"), n["node"]["field"].alias("field"),
                n["node"]["operator"].alias("operator"), n["node"]["value"].alias("value"), F.lit(d).alias("depth"),
            )

        flat.append(F.transform(level, lambda n: project(n)))
        if not leaf:
            inner = F.filter(level, lambda n: n["node"]["children"].isNotNull())
            level = F.flatten(F.transform(inner, lambda n: F.transform(
                n["node"]["children"],
                lambda c, i: F.struct(F.concat(n["path"], F.lit(".children["), i.cast("string"), F.lit("]")).alias("path"), c.alias("node")),
            )))
    return F.concat(*flat)


def _error(path, code: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code"))


def _metric_ranges() -> Column:
    return F.create_map(*[x for name, _, _, lo, hi, _ in METRICS for x in (
        F.lit(name), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])


def _comparison_errors(path: Column, field: Column, op: Column, value: Column, ranges: Column) -> Column:
    known = F.try_element_at(ranges, field)
    return F.array(
        F.when(known.isNull(), _error(F.concat(path, F.lit(".field")), "UnknownConcept")),
        F.when(known.isNotNull() & ~F.coalesce(op.isin(ALLOWED_OPERATORS), F.lit(False)),
               _error(F.concat(path, F.lit(".operator")), "OperatorNotAllowedForField")),
        F.when((value < known["lo"]) | (value > known["hi"]), _error(F.concat(path, F.lit(".value")), "ValueOutOfRange")),
    )


def validate_criteria(criteria: DataFrame) -> DataFrame:
    """(strategy_id, path, code) for every rule a criteria_json breaks; valid criteria yield no row."""
    return _broken(read_criteria(criteria))


def _broken(read: DataFrame) -> DataFrame:
    parsed = read.withColumn("ranges", _metric_ranges())
    n_cmp = F.size(F.filter("nodes", lambda n: n["kind"] == "comparison"))
    top = F.array(
        F.when(F.array_max(F.transform("nodes", lambda n: n["depth"])) > MAX_DEPTH, _error("root", "TreeTooDeep")),
        F.when(n_cmp > MAX_COMPARISONS, _error("root", "TooManyComparisons")),
        F.when(n_cmp == 0, _error("root", "NoComparisons")),
        F.when(F.col("sort_field").isNotNull() & F.try_element_at("ranges", F.col("sort_field")).isNull(),
               _error("sort.field", "UnknownConcept")),
        F.when((F.col("limit") <= 0) | (F.col("limit") > MAX_LIMIT), _error("limit", "InvalidLimit")),
    )

    def of_node(n):
        group = F.array(
            F.when(n["op"] != "And", _error(n["path"], "OperatorNotSupportedInV1")),
            F.when(n["n_children"] == 0, _error(n["path"], "EmptyGroup")),
        )
        return F.when(n["kind"] == "group", group).otherwise(
            _comparison_errors(n["path"], n["field"], n["operator"], n["value"], F.col("ranges"))
        )

    errors = F.array_compact(F.concat(top, F.flatten(F.transform("nodes", of_node))))
    return parsed.select("strategy_id", F.explode_outer(errors).alias("e")).filter(F.col("e").isNotNull()).select(
        "strategy_id", "e.path", "e.code"
    )


def parsed_criteria(criteria: DataFrame) -> DataFrame:
    """(strategy_id, exchange, sector, comparisons, sort_field, descending, limit) of criteria that break no rule.

    Only And groups are valid, so a tree of them is the list of its comparisons. A missing limit is the default one. Criteria with an
    error, or with an index in their universe, are left out; ``refused_criteria`` names them.
    """
    return runnable(read_criteria(criteria))


def runnable(read: DataFrame) -> DataFrame:
    """``parsed_criteria`` of what ``read_criteria`` gave."""
    valid = read.join(refused(read).select("strategy_id").distinct(), "strategy_id", "left_anti")
    comparisons = F.transform(F.filter("nodes", lambda n: n["kind"] == "comparison"), lambda n: F.struct(
        n["field"].alias("field"), n["operator"].alias("operator"), n["value"].alias("value")))
    return valid.select(
        "strategy_id", "exchange", "sector", comparisons.alias("comparisons"), "sort_field",
        F.coalesce(F.col("direction") == "Desc", F.lit(False)).alias("descending"), F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"))


def refused_criteria(criteria: DataFrame) -> DataFrame:
    """(strategy_id, path, code) of what keeps criteria from running: broken rules, and an index, for which there is no membership data."""
    return refused(read_criteria(criteria))


def refused(read: DataFrame) -> DataFrame:
    return _broken(read).union(read.where(F.col("index").isNotNull()).select(
        "strategy_id", F.lit("universe.index").alias("path"), F.lit("IndexNotSupported").alias("code")))


# --- intents ----------------------------------------------------------------------------------------------------------


def concept_lookup() -> Column:
    """normalised name or alias -> (name, definition), from the system vocabulary."""
    entries, seen = [], set()
    for name, aliases, definition in CONCEPTS:
        body = F.struct(F.lit(name).alias("name"), F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), F.lit(v).alias("value")) for f, o, v in definition
        ]).alias("definition"))
        for key in [name, *[a.replace(" ", "_") for a in aliases]]:
            if key not in seen:  # the first writer of a key keeps it
                seen.add(key)
                entries += [F.lit(key), body]
    return F.create_map(*entries)


def resolve_intents(intents: DataFrame) -> DataFrame:
    """Concept names and explicit numbers to comparisons, or to errors.

    ``intents``: intent_id, concepts array<string>, filters array<struct<field, operator, value>>. An explicit number
    replaces every comparison the concepts make on its field; naming a concept twice counts once; any error voids the
    intent. Rows out: (intent_id, kind, field, operator, value), an error with its code as the field.
    """
    df = intents.withColumns({"lookup": concept_lookup(), "ranges": _metric_ranges()})
    df = df.withColumn("found", F.transform("concepts", lambda c: F.try_element_at("lookup", concept_key(c))))
    df = df.withColumn("overridden", F.transform("filters", lambda f: f["field"]))
    kept = F.filter(
        F.flatten(F.transform(F.array_distinct(F.array_compact("found")), lambda d: d["definition"])),
        lambda c: ~F.array_contains("overridden", c["field"]),
    )
    df = df.withColumn("comparisons", F.concat(kept, F.col("filters")))
    code = lambda text: F.lit(text)
    resolution = F.concat(
        F.transform(F.filter("found", lambda d: d.isNull()), lambda d: code("UnknownStrategyConcept")),
        F.transform(F.filter("filters", lambda f: F.try_element_at("ranges", f["field"]).isNull()), lambda f: code("UnknownConcept")),
        F.when((F.size("concepts") == 0) & (F.size("filters") == 0), F.array(code("EmptyIntent"))).otherwise(F.array().cast("array<string>")),
    )
    df = df.withColumn("resolution_errors", resolution)
    invalid = F.array_compact(F.flatten(F.transform(
        "comparisons", lambda c: _comparison_errors(F.lit(""), c["field"], c["operator"], c["value"], F.col("ranges"))
    )))
    errors = F.when(F.size("resolution_errors") > 0, F.col("resolution_errors")).otherwise(F.concat(
        F.when(F.size("comparisons") == 0, F.array(code("NoComparisons"))).otherwise(F.array().cast("array<string>")),
        F.transform(invalid, lambda e: e["code"]),
    ))
    df = df.withColumn("errors", errors)
    row = lambda kind, f, o, v: F.struct(F.lit(kind).alias("kind"), f.alias("field"), o.alias("operator"), v.alias("value"))
    good = F.transform("comparisons", lambda c: row("comparison", c["field"], c["operator"], c["value"]))
    bad = F.transform("errors", lambda e: row("error", e, F.lit(None).cast("string"), F.lit(None).cast("double")))
    return df.select("intent_id", F.explode_outer(F.when(F.size("errors") > 0, bad).otherwise(good)).alias("r")).filter(
        F.col("r").isNotNull()
    ).select("intent_id", "r.*")


# --- tagging ----------------------------------------------------------------------------------------------------------


def tag_keys() -> list[tuple[str, str]]:
    """(key, concept), the longest key first; keys of one length keep the vocabulary's order."""
    keys = [(k, name) for name, aliases, _ in CONCEPTS for k in [name, *[a.replace(" ", "_") for a in aliases]]]
    return sorted(keys, key=lambda k: -len(k[0]))


def tags(text: Column) -> Column:
    """Concepts named in a text: whole words only, and a matched span is gone for every shorter key.

    So a negated concept never also counts as the concept it denies. Words no key uses shrink to one mark per run first: they can
    only separate matches, so the fold over the key list works on a few words instead of the whole text.
    """
    keys = F.array(*[F.struct(F.lit(f"_{k}_").alias("k"), F.lit(c).alias("c")) for k, c in tag_keys()])
    used = sorted({w for k, _ in tag_keys() for w in k.split("_")})
    words = F.transform(F.split(F.lower(text), NOT_A_WORD), lambda w: F.when(w.isin(used), w).otherwise("~"))
    short = F.regexp_replace(F.array_join(words, "_"), "(?:~_)+", "~_")
    start = F.struct(F.concat(F.lit("_"), short, F.lit("_")).alias("rest"), F.array().cast("array<string>").alias("found"))
    folded = F.aggregate(
        keys, start,
        lambda acc, k: F.when(
            F.contains(acc["rest"], k["k"]),
            F.struct(F.replace(acc["rest"], k["k"], F.lit("_")).alias("rest"), F.array_append(acc["found"], k["c"]).alias("found")),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )
    return F.array_distinct(folded)


# --- vocabulary ------------------------------------------------------------------------------------------------------


def draft_errors(drafts: DataFrame) -> DataFrame:
    """(draft_id, path, code) of concept drafts: bad names, repeated aliases, too many of them, keys already taken.

    ``drafts``: draft_id, owner, name, aliases. A key taken by the system vocabulary and a key that several drafts of one
    owner claim are both errors; claims are counted per key, so no draft is compared with another.
    """
    d = drafts.select(
        "draft_id", "owner", concept_key(F.col("name")).alias("name"), F.transform("aliases", concept_key).alias("aliases")
    )
    own = F.transform("aliases", lambda a, i: F.when(a == "", F.lit("InvalidConceptName")).when(
        (a == F.col("name")) | F.array_contains(F.slice("aliases", F.lit(1), i), a), F.lit("ConceptNameInUse")
    ))
    spots = F.transform(own, lambda c, i: F.when(c.isNotNull(), F.struct(
        F.concat(F.lit("aliases["), i.cast("string"), F.lit("]")).alias("path"), c.alias("code"))))
    head = F.array(
        F.when((F.col("name") == "") | (F.length("name") > MAX_NAME_LENGTH), _error("name", "InvalidConceptName")),
        F.when(F.size("aliases") > MAX_ALIASES, _error("aliases", "InvalidConceptName")),
    )
    local = d.select("draft_id", F.explode(F.array_compact(F.concat(head, spots))).alias("e")).select("draft_id", "e.*")
    claims = d.select("draft_id", "owner", F.posexplode(F.concat(F.array("name"), F.col("aliases"))).alias("pos", "key")).filter(
        F.col("key") != ""
    ).withColumn("path", F.when(F.col("pos") == 0, "name").otherwise(F.concat(F.lit("aliases["), (F.col("pos") - 1).cast("string"), F.lit("]"))))
    contested = claims.groupBy("owner", "key").agg(F.min("draft_id").alias("a"), F.max("draft_id").alias("b")).filter("a < b")
    shared = claims.join(contested, ["owner", "key"], "left_semi").select("draft_id", "path", F.lit("KeyContested").alias("code"))
    taken = claims.filter(F.col("key").isin([k for k, _ in tag_keys()])).select("draft_id", "path", F.lit("ConceptNameInUse").alias("code"))
    return local.unionByName(shared).unionByName(taken).distinct()


# --- scoring ---------------------------------------------------------------------------------------------------------


def _set(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.col(c)))


def score(cases: DataFrame) -> DataFrame:
    """Share of cases, in percent, whose concepts and whose filters match exactly as sets.

    ``cases``: expected/actual concepts and filters (arrays), expect_clarification, got_clarification.
    """
    clear = ~F.col("expect_clarification") & ~F.col("got_clarification")
    asked = F.col("expect_clarification") & F.col("got_clarification")
    concepts = asked | (clear & (_set("expected_concepts") == _set("actual_concepts")))
    filters = asked | (clear & (_set("expected_filters") == _set("actual_filters")))
    share = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    return cases.agg(
        F.count(F.lit(1)).alias("n"), share(concepts).alias("concept_pass_rate"), share(filters).alias("filter_pass_rate")
    )
