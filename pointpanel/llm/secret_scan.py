"""Secret scans: a random forest that removes false positives from candidate strings.

Built from DataFrame functions only. Candidates are long runs of key characters in words of the whole text, values of at least six
printable characters that are assigned to a keyword (to the closing quote, or else to the next blank, quote, or separator that another
assignment follows), and passwords of any length in addresses. Their features are length, character transitions and classes, coverage by a
dictionary that is counted over all documents, path signs, and the words beside them.
The forest is trained from labelled findings, level by level for all trees at once: a level is one histogram over (tree, node,
feature, bin), one window over bins, and one step of every training row to its child. Trees differ by the findings they see (two of
three bags, by a hash of the id) and by the features each node may use. The finished forest has a bounded number of nodes, which score
every candidate as literals.

Bounds: at most ``TRAINING_FINDINGS`` labelled findings are learned from, chosen by a hash of the finding; candidates, dictionary and
scores cover all documents.

Defined results: null and empty texts have no candidates; repeated rows give repeated findings; a null doc_id is an id like others; without
labelled findings every score is 0.5; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointpanel.llm.line_rules import let, words_of
from pointpanel.session import stored

TRAINING_FINDINGS = 20_000
TREES, DEPTH, TRIED, BAGS = 16, 5, 5, 60
BINS = 15
DICTIONARY_DOCS = 5
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
KEYWORD = "(?i)(secret|token|passw|pwd|api_?key|apikey|access_?key|private_?key|auth(?!or(?!i[sz]))|credential)"
#: What names a value: a keyword, the rest of its name, closing marks, and a sign of assignment with at most one blank on either side.
NAMED = f"{KEYWORD}[A-Za-z0-9_.-]*[\"'`\\])]* ?(?::=|=>|={{1,3}}|:) ?"
#: Values that end in the last word of a text: quoted, the start of a quoted one that goes on, and unquoted.
QUOTED = {q: f"{NAMED}{q}([^{q} ]{{6,}}){q}(?=[^ ]*$)" for q in "\"'`"}
OPENED = {q: f"{NAMED}{q}([^{q} ]+)$" for q in "\"'`"}
BARE = f"{NAMED}(?!//)([^ \"'`]{{6,}}?)(?=[;&,][A-Za-z_][A-Za-z0-9_.-]*=[^ ]*$|[.,;:)\\]}}>]*$|[\"'`][^ ]*$)"
LOGIN = "://[^/:@]*:([^/]+)@"
#: Formats of issued keys, fixed by those who issue them.
ISSUED = "^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
FEATURES = [
    "length", "transitions", "digits", "capitals", "dictionary", "distinct", "path", "keyword", "assigned", "quoted",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at, found, named, word, before, before2): each candidate with the place of its word and the two words before it.

    ``named`` tells the values of keywords and passwords in addresses from other runs.
    """
    none = F.array().cast("array<string>")

    def all_of(text: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), group)

    def opened(near: Column, rest: Column, quote: str) -> Column:
        """The quoted value that begins at the end of ``near`` and ends in ``rest``, the words that follow."""
        value = F.concat_ws(" ", F.regexp_extract(near, OPENED[quote], 2), F.substring_index(rest, quote, 1))
        return F.when(near.rlike(OPENED[quote]) & F.contains(rest, F.lit(quote)) & (F.length(value) >= 6), F.array(value)).otherwise(none)

    def named(words: Column, w: Column, i: Column) -> Column:
        near = F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1), w)
        rest = F.array_join(F.slice(words, i + 2, F.size(words)), " ")
        goes_on = lambda t: F.when(t.rlike("|".join(OPENED.values())), let(
            rest, lambda r: F.concat(*(opened(t, r, q) for q in OPENED)))).otherwise(none)
        values = let(near, lambda t: F.when(t.rlike(KEYWORD), F.concat(
            *(all_of(t, p, 2) for p in QUOTED.values()), all_of(t, BARE, 2), goes_on(t))).otherwise(none))
        return F.concat(values, F.when(F.contains(w, F.lit("://")), all_of(w, LOGIN, 1)).otherwise(none))

    def likely(words: Column) -> Column:
        def of(w: Column, i: Column) -> Column:
            sign = lambda x: F.contains(x, F.lit("=")) | F.contains(x, F.lit(":"))
            # A value of a keyword has a sign of assignment in its own word or in the one before.
            values = F.when(sign(w) | F.coalesce(sign(F.get(words, i - 1)), F.lit(False)), named(words, w, i)).otherwise(none)
            runs = F.when(F.length(w) >= 16, all_of(w, f"({CANDIDATE})", 1)).otherwise(none)
            return F.struct(i.alias("at"), w.alias("word"), F.get(words, i - 1).alias("before"), F.get(words, i - 2).alias("before2"),
                            values.alias("values"), runs.alias("runs"))

        return F.filter(F.transform(words, of), lambda x: (F.size(x["values"]) > 0) | (F.size(x["runs"]) > 0))

    hits = docs.select("doc_id", F.explode(let(words_of(F.col("text")), likely)).alias("h")).select("doc_id", "h.*")
    both = F.concat(F.transform(F.array_distinct("values"), lambda v: F.struct(v.alias("found"), F.lit(True).alias("named"))),
                    F.transform(F.array_except("runs", "values"), lambda v: F.struct(v.alias("found"), F.lit(False).alias("named"))))
    return hits.select("doc_id", "at", F.explode(both).alias("f"), "word", "before", "before2").select(
        "doc_id", "at", "f.found", "f.named", "word", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("before2", F.lit("")).alias("before2"))


def dictionary(docs: DataFrame, min_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """(word): runs of at least three letters that are whole words, marks aside, in at least ``min_docs`` rows of ``docs``."""
    bare = F.transform(words_of(F.col("text")), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))))
    own = F.array_distinct(F.filter(bare, lambda w: F.length(w).between(3, 15) & w.rlike("^[a-z]+$")))
    return docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("word")


def _coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(found, covered): letters of each distinct candidate in runs that are words of the dictionary."""
    runs = found.select("found").distinct().select("found", F.explode(
        F.regexp_extract_all(F.lower("found"), F.lit("([a-z]{3,15})"), 1)).alias("word"))
    return runs.join(words, "word").groupBy("found").agg(F.sum(F.length("word")).alias("covered"))


def _binned(share: Column) -> Column:
    return F.least(F.floor(share * BINS), F.lit(BINS)).cast("int")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``x``: the features as bins 0 to 15, in the order of ``FEATURES``."""
    size = F.length("found")
    kinds = F.col("found")
    for pattern, kind in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "_")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    count = lambda p: size - F.length(F.regexp_replace("found", p, ""))
    keyword = F.when(F.col("word").rlike(KEYWORD), 3).when(F.col("before").rlike(KEYWORD), 2).when(
        F.col("before2").rlike(KEYWORD), 1).when(F.col("named"), 3).otherwise(0)
    assigned = F.col("named") | F.col("before").rlike("^(=|:|=>|:=)$") | F.col("before").rlike("[=:]$") | F.col("word").rlike("[=:][\"']?[A-Za-z0-9+/_-]{16,}")
    slashes = F.length("word") - F.length(F.regexp_replace("word", "/", ""))
    x = F.array(
        F.least(F.floor(size / 4), F.lit(BINS)).cast("int"), _binned((F.length(kinds) - 1) / F.greatest(size - 1, F.lit(1))),
        _binned(count("[0-9]") / size), _binned(count("[A-Z]") / size), _binned(F.coalesce("covered", F.lit(0)) / size),
        _binned(F.size(F.array_distinct(F.split("found", ""))) / F.least(size, F.lit(32))),
        F.least(slashes, F.lit(5)) + F.when(F.col("word").rlike("://|^www\\."), 6).otherwise(0), keyword, assigned.cast("int"),
        F.col("word").rlike("^[\"'`(]").cast("int"))
    return found.join(_coverage(found, words), "found", "left").withColumn("x", x).drop("covered")


def rule_labels(findings: DataFrame) -> DataFrame:
    """``findings`` with ``y`` where a rule is sure: 1 for issued formats and mixed strings assigned to a keyword, but for calls and
    references; 0 for strings of one kind of character, or in a path or address, without keyword or assignment, and for words of the
    dictionary; null otherwise."""
    near = (F.element_at("x", 8) > 0) & (F.element_at("x", 9) > 0)
    apart = (F.element_at("x", 8) == 0) & (F.element_at("x", 9) == 0)
    plain = F.col("found").rlike("^([a-z]+|[A-Z]+|[A-Z]?[a-z]+|[0-9]+|[_=+/-]+)$")
    mixed = F.col("found").rlike("[0-9]") & F.col("found").rlike("[A-Za-z]")
    refers = F.col("found").rlike("[(\\[{<]|^[$%]")
    known = F.col("named") & F.col("found").rlike("^[A-Za-z-]+[.,;:!?]*$") & (F.element_at("x", 5) >= BINS * 4 // 5)
    y = F.when(F.col("found").rlike(ISSUED) | near & mixed & ~refers, 1).when(apart & (plain | (F.element_at("x", 7) > 5)) | known, 0)
    return findings.withColumn("y", y)


def _chance(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1000)) / 1000


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, tried: int = TRIED) -> list[dict]:
    """The nodes of a forest fitted to ``labelled`` (doc_id, found, x, y): at most ``trees * 2 ** (depth + 1)`` rows."""
    rows = labelled.where("y is not null").orderBy(F.xxhash64("doc_id", "found"), "found", "y").limit(TRAINING_FINDINGS)
    bagged = rows.groupBy("x", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(BAGS)).alias("bag")).agg(F.count("*").alias("c"))
    state = stored(bagged.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(
        _chance("tree", "bag") < 2 / 3).select("tree", F.lit(1).alias("node"), "x", "y", "c"), "bags")
    nodes: list[dict] = []
    for level in range(depth + 1):
        of_node = state.groupBy("tree", "node").agg(F.sum(F.col("c") * F.col("y")).alias("p"), F.sum("c").alias("n"))
        if level == depth:
            nodes += [r.asDict() | {"f": -1, "b": 0} for r in of_node.collect()]
            break
        allowed = _chance("tree", "node", "f") < tried / len(FEATURES)
        bins = state.select("tree", "node", "y", "c", F.posexplode("x").alias("f", "b")).where(allowed).groupBy("tree", "node", "f", "b").agg(
            F.sum(F.col("c") * F.col("y")).alias("p"), F.sum("c").alias("n"))
        over = Window.partitionBy("tree", "node", "f")
        below = bins.select("tree", "node", "f", "b", F.sum("p").over(over.orderBy("b")).alias("lp"), F.sum("n").over(over.orderBy("b")).alias("ln"),
                            F.sum("p").over(over).alias("p"), F.sum("n").over(over).alias("n")).where("ln < n")
        # Largest sum of squared class shares, that is least Gini impurity, of the two sides.
        pure = lambda p, n: (p * p + (n - p) * (n - p)) / n
        gain = pure(F.col("lp"), F.col("ln")) + pure(F.col("p") - F.col("lp"), F.col("n") - F.col("ln")) - pure(F.col("p"), F.col("n"))
        best = below.withColumn("gain", gain).where("gain > 1e-9").groupBy("tree", "node").agg(
            F.max_by(F.struct("f", "b"), F.struct(F.col("gain"), -F.col("f"), -F.col("b"))).alias("s")).select("tree", "node", "s.*")
        best = stored(of_node.join(best, ["tree", "node"], "left").withColumn("f", F.coalesce("f", F.lit(-1))).withColumn(
            "b", F.coalesce("b", F.lit(0))), "splits")
        nodes += [r.asDict() for r in best.collect()]
        moved = state.join(best.where("f >= 0").select("tree", "node", "f", "b"), ["tree", "node"])
        state = stored(moved.select("tree", (2 * F.col("node") + (F.get("x", F.col("f")) > F.col("b")).cast("int")).alias("node"), "x", "y", "c")
                       .groupBy("tree", "node", "x", "y").agg(F.sum("c").alias("c")), "level")
    return nodes


def forest_score(x: Column, nodes: list[dict], depth: int = DEPTH) -> Column:
    """The mean over trees of the share of secrets in the leaf that ``x`` reaches."""
    if not nodes:
        return F.lit(0.5)
    trees = sorted({r["tree"] for r in nodes})
    size = 2 << depth
    parts = []
    for tree in trees:
        feature, cut, share = [-1] * size, [0] * size, [0.5] * size
        for r in (r for r in nodes if r["tree"] == tree):
            # Laplace's correction keeps small leaves from being sure.
            feature[r["node"]], cut[r["node"]], share[r["node"]] = r["f"], r["b"], (r["p"] + 1) / (r["n"] + 2)
        parts.append(F.struct(F.lit(feature).alias("feature"), F.lit(cut).alias("cut"), F.lit(share).alias("share")))

    def leaf(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            f = F.get(tree["feature"], node)
            return F.when(f < 0, node).otherwise(2 * node + (F.get(x, f) > F.get(tree["cut"], node)).cast("int"))

        return F.get(tree["share"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step))

    return F.aggregate(F.array(*parts), F.lit(0.0), lambda total, tree: total + leaf(tree)) / len(trees)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, at, found, named, word, before, before2, x, y, score, is_secret) of every candidate.

    ``labelled`` (doc_id, found, x, y) are findings that were judged; without it the sure rules label the findings themselves.
    """
    found = stored(candidates(docs), "candidates")
    findings = rule_labels(featured(found, stored(dictionary(docs), "dictionary")))
    findings = stored(findings, "findings")
    score = forest_score(F.col("x"), train(findings if labelled is None else labelled))
    return findings.withColumn("score", score).withColumn("is_secret", F.col("score") >= 0.5)
