"""Code as a graph: lines are nodes, relations between lines are typed edges.

All nodes of a file are built as one array inside the file's row, in linear time and
without a shuffle.  Only the typed edges, whose number can exceed the text, are made by an
equi-join on what lines share (a function, a variable, a call), so they spread over tasks.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.lookup import let
from ..session import unfolded
from .segments import function_blocks


def line_type(line: Column) -> Column:
    w = fixed.LINE_TYPE_WORDS
    called = F.contains(line, F.lit("(")) & F.contains(line, F.lit(")"))
    assigned = F.contains(line, F.lit("=")) & ~F.contains(line, F.lit("=="))
    return (
        F.when(T.contains_any(line, w["declaration"]), F.when(called, "function_def").otherwise("var_declaration"))
        .when(T.contains_any(line, w["control_flow"]), "control_flow")
        .when(F.contains(line, F.lit("return")), "return")
        .when(assigned, "assignment")
        .when(T.contains_any(line, w["function_call"]), "function_call")
        .when(T.contains_any(line, w["potential_vulnerability"]), "potential_vulnerability")
        .when(T.contains_any(line, w["import"]), "import")
        .otherwise("statement")
    )


def function_name(line: Column) -> Column:
    words = F.filter(F.split(F.substring_index(line, "(", 1), f"{T.BLANK}+"), lambda w: w != "")
    return (
        F.when(F.contains(line, F.lit("main")), "main")
        .when(F.size(words) >= 2, F.element_at(words, -1))
        .otherwise("unknown")
    )


def _node_array(content: Column) -> Column:
    """array<struct<line, text, type>> of the lines that are neither blank nor comments."""
    def keep(n):
        return (n["text"] != "") & ~T.starts_with_any(n["text"], ["//", "#"])
    stripped = F.transform(T.split_lines(content), lambda l, i: F.struct((i + 1).alias("line"), T.strip(l).alias("text")))
    return F.transform(
        F.filter(stripped, keep),
        lambda n, i: F.struct(i.alias("id"), n["line"].alias("line"), n["text"].alias("text"), line_type(n["text"]).alias("type")),
    )


def _with_function(nodes: Column) -> Column:
    """Add to every node the function last named at or before it.

    The array is cut at the naming nodes, so the pass is linear in the file.
    """
    def names(n):
        return n["type"].isin("function_def", "function_call") | F.contains(n["text"], F.lit("int main"))

    def labelled(part, name):
        return F.transform(part, lambda n: F.struct(
            n["id"].alias("id"), n["line"].alias("line"), n["text"].alias("text"), n["type"].alias("type"), name.alias("function")))

    def cut(at):
        before = labelled(F.slice(nodes, 1, F.coalesce(F.get(at, 0), F.size(nodes))), F.lit(None).cast("string"))
        parts = F.transform(at, lambda start, k: let(
            function_name(F.get(nodes, start)["text"]),
            lambda name: labelled(F.slice(nodes, start + 1, F.coalesce(F.get(at, k + 1), F.size(nodes)) - start), name)))
        return F.concat(before, F.flatten(parts))

    return let(F.transform(F.filter(nodes, names), lambda n: n["id"]), cut)


def file_graphs(files: DataFrame, *keep: str) -> DataFrame:
    """One row per file with its ``nodes`` array (id, line, text, type, function)."""
    keep = keep or ("file_id",)
    typed = files.select(*keep, _node_array(F.col("content")).alias("_typed"))
    return typed.select(*keep, let(F.col("_typed"), _with_function).alias("nodes"))


def graph_nodes(files: DataFrame) -> DataFrame:
    return file_graphs(files).select("file_id", F.inline("nodes"))


def _neighbours(nodes: Column, n: Column) -> Column:
    """Nodes at most two lines away: they are at most two places away in the array."""
    start = F.greatest(n["id"] - 1, F.lit(1))
    around = F.slice(nodes, start, n["id"] + 4 - start)
    return F.filter(around, lambda o: (F.abs(o["line"] - n["line"]) <= 2) & (o["id"] != n["id"]))


def nearby_nodes(files: DataFrame) -> DataFrame:
    """(file, node, other, other_type) for nodes within two lines of each other."""
    def pairs(nodes):
        return F.flatten(F.transform(nodes, lambda n: F.transform(
            _neighbours(nodes, n), lambda o: F.struct(n["id"].alias("id"), o["id"].alias("other_id"), o["type"].alias("other_type")))))

    return file_graphs(files).select("file_id", F.inline(let(F.col("nodes"), pairs)))


def node_context(files: DataFrame) -> DataFrame:
    def flags(nodes, n):
        lower = F.lower(n["text"])
        return F.struct(
            n["id"].alias("id"), n["function"].alias("function"),
            T.contains_any(lower, fixed.NODE_MEMORY_WORDS).alias("has_memory_ops"),
            T.contains_any(lower, fixed.NODE_INPUT_WORDS).alias("has_user_input"),
            T.contains_any(lower, fixed.NODE_OUTPUT_WORDS).alias("has_output"),
            F.array_join(F.transform(_neighbours(nodes, n), lambda o: o["type"]), ",").alias("nearby_types"),
        )

    described = let(F.col("nodes"), lambda nodes: F.transform(nodes, lambda n: flags(nodes, n)))
    return file_graphs(files).select("file_id", F.inline(described))


def node_features(text: Column, kind: Column) -> Column:
    """62 numbers per node: type, patterns, semantics, structure, security, data flow."""
    lower = F.lower(text)

    def has(column, words):
        return T.contains_any(column, words).cast("double")

    words = F.filter(F.split(text, f"{T.BLANK}+"), lambda w: w != "")
    features = [(kind == slot).cast("double") for slot in fixed.NODE_TYPE_SLOTS]
    features += [has(lower, [w.lower() for w in ws]) for _, ws in fixed.NODE_PATTERN_WORDS]
    features += [has(lower, [w.lower() for w in ws]) for _, ws in fixed.NODE_SEMANTIC_WORDS]
    features += [F.length(text).cast("double")]
    features += [T.count_of(text, mark).cast("double") for mark in ["\n", "(", "[", "{", ";"]]
    features += [F.size(words).cast("double"), has(text, ["*"]), has(text, ["[]"]), has(text, ["->", "."])]
    features += [has(text, ws) for _, ws in fixed.NODE_SECURITY_WORDS]
    features += [
        (F.length(text) > 100).cast("double"), (T.count_of(text, "*") > 1).cast("double"),
        has(text, fixed.NODE_TYPE_MODIFIERS), has(text, fixed.NODE_FORMAT_MARKS),
    ]
    assigned = F.contains(text, F.lit("=")) & ~F.contains(text, F.lit("=="))
    features += [
        has(lower, ["input", "user"]), has(lower, ["output", "print"]), assigned.cast("double"),
        has(text, ["return"]), has(text, fixed.NODE_PARAMETER_WORDS), has(text, fixed.NODE_GLOBAL_WORDS),
    ]
    return F.array(*features)


def pooled_features(files: DataFrame) -> DataFrame:
    """(file_id, dim, mean, max, sum) of the node features of each file.

    Nodes leave their file's row once; the features are flat columns of generated code, and a file's rows are
    summed where they lie before they are shuffled.
    """
    nodes = graph_nodes(files).select("file_id", F.posexplode(node_features(F.col("text"), F.col("type"))).alias("dim", "value"))
    return nodes.groupBy("file_id", "dim").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.sum("value").alias("sum"))


def pooled_vectors(files: DataFrame) -> DataFrame:
    """(file_id, features): the pooled means, maxima and sums of each file as one vector."""
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean", "max", "sum")))  # one row per dimension
    pooled = pooled_features(files).groupBy("file_id").agg(rows.alias("rows"))
    return pooled.select("file_id", F.concat("rows.mean", "rows.max", "rows.sum").alias("features"))


# ------------------------------------------------------------------------------- edges

#: Files of more lines are worked on by several tasks.
LONG_FILE = 1000

_ASSIGNED = f"({T.WORD}+){T.BLANK}*="
_CALLED = f"({T.WORD}+){T.BLANK}*\\("


def _ends(nodes: Column, variables: Column, calls: Column) -> Column:
    """Per node the (kind, key) pairs it offers as the source and as the target of an edge."""
    def end(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def many(kind, keys):
        return F.transform(keys, lambda key: end(kind, key))

    def one(test, kind, key):
        return F.array_compact(F.array(F.when(test, end(kind, key))))

    def of(n):
        text, lower = n["text"], F.lower(n["text"])
        inside = one(n["function"] != "", "ast_child", n["function"])

        def paired(position):
            return F.array_compact(F.array(*[
                F.when(F.contains(lower, F.lit(pair[position])), end("vulnerability", F.lit(str(i))))
                for i, pair in enumerate(fixed.VULNERABLE_PAIRS)]))

        sources = F.concat(
            F.array(end("control_flow", (n["line"] - 1).cast("string")), end("control_flow", (n["line"] + 1).cast("string"))),
            inside,
            many("data_flow", F.array_distinct(F.regexp_extract_all(text, F.lit(_ASSIGNED), 1))),
            many("call_flow", F.array_distinct(F.regexp_extract_all(text, F.lit(_CALLED), 1))),
            one(T.contains_any(text, fixed.ALLOC_WORDS), "memory_flow", F.lit("")),
            paired(0))
        targets = F.concat(
            F.array(end("control_flow", n["line"].cast("string"))),
            inside,
            many("data_flow", F.filter(variables, lambda v: F.contains(text, v) & ~F.contains(text, F.concat(v, F.lit("="))))),
            many("call_flow", F.filter(calls, lambda c: F.contains(text, F.concat(c, F.lit("("))))),
            one(T.contains_any(text, fixed.FREE_WORDS), "memory_flow", F.lit("")),
            paired(1))
        return F.struct(n["id"].alias("id"), sources.alias("sources"), targets.alias("targets"))

    return F.transform(nodes, of)


def _is_long(long_file: int) -> Column:
    return T.line_count(F.col("content")) > long_file


def _long_files(files: DataFrame, long_file: int) -> DataFrame | None:
    """The files that several tasks work on; None where there are none, so that plans without them stay small."""
    long = files.filter(_is_long(long_file))
    return None if long.isEmpty() else long


def _run_of(text: Column, length: int):
    return lambda i: F.substring(text, i, F.lit(length))


def _grams(text: Column) -> Column:
    """All different runs of up to ``GRAM`` characters of a text."""
    size = F.length(text)
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1))), _run_of(text, k))
            for k in range(1, GRAM + 1)]
    return F.array_distinct(F.filter(F.concat(*runs), lambda g: g != ""))


#: Characters by which a name is looked up among the lines of a long file.
GRAM = 3


def names_in_lines(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, name, id, text): every line whose text contains a name of its file.

    ``names`` has (file_id, name), ``lines`` (file_id, id, text).  A name is looked up by the run of its characters that
    the fewest lines of the file hold, so work follows the text and the hits, not names times lines.
    """
    held = lines.select("file_id", "id", F.explode(_grams(F.col("text"))).alias("gram"))
    counts = held.groupBy("file_id", "gram").agg(F.count("*").alias("n"))
    wanted = names.filter("name <> ''").distinct().select("file_id", "name", F.explode(_grams(F.col("name"))).alias("gram"))
    # long runs first among equals; a run that no line holds rules its name out
    rated = wanted.join(unfolded(counts), ["file_id", "gram"], "left").groupBy("file_id", "name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("gram")).alias("longest"), "gram")).alias("best"))
    looked_up = rated.filter("best.n > 0").select("file_id", "name", F.col("best.gram").alias("gram"))
    found = looked_up.join(unfolded(held), ["file_id", "gram"]).join(unfolded(lines), ["file_id", "id"])
    return found.filter(F.contains("text", F.col("name"))).select("file_id", "name", "id", "text")


def _edge_ends(files: DataFrame, long_file: int = LONG_FILE) -> DataFrame:
    """(file_id, id, sources, targets): the relations each node offers as either end.

    In a file of up to ``long_file`` lines every name is tested on every line inside the file's row; in a longer one names are
    looked up (``names_in_lines``).
    """
    def names(nodes, pattern):
        return F.array_distinct(F.flatten(F.transform(nodes, lambda n: F.regexp_extract_all(n["text"], F.lit(pattern), 1))))

    none = F.array().cast("array<string>")
    in_row = let(F.col("nodes"), lambda nodes: let(names(nodes, _ASSIGNED), lambda variables: let(
        names(nodes, _CALLED), lambda calls: _ends(nodes, variables, calls))))
    without = let(F.col("nodes"), lambda nodes: _ends(nodes, none, none))
    short = file_graphs(files.filter(~_is_long(long_file))).select("file_id", F.inline(in_row))
    long = _long_files(files, long_file)
    if long is None:
        return short
    ends = file_graphs(long).select("file_id", F.inline(without))
    lines = graph_nodes(long).select("file_id", "id", "text")

    def named(pattern):
        return lines.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name"))

    read = names_in_lines(named(_ASSIGNED), lines).filter(~F.contains("text", F.concat("name", F.lit("=")))).select(
        "file_id", "id", F.struct(F.lit("data_flow").alias("kind"), F.col("name").alias("key")).alias("end"))
    called = names_in_lines(named(_CALLED).select("file_id", F.concat("name", F.lit("(")).alias("name")), lines).select(
        "file_id", "id", F.struct(F.lit("call_flow").alias("kind"), F.expr("substring(name, 1, length(name) - 1)").alias("key")).alias("end"))
    more = read.unionByName(called).groupBy("file_id", "id").agg(F.collect_list("end").alias("more"))  # the names in one line
    full = ends.join(unfolded(more), ["file_id", "id"], "left").select(
        "file_id", "id", "sources", F.concat("targets", F.coalesce("more", F.array().cast("array<struct<kind:string,key:string>>"))).alias("targets"))
    return short.unionByName(full)


def graph_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst, eight 0/1 slots) for every ordered pair with some relation.

    A relation is an equality on a key both lines offer: a line number, a function, a name, a
    word pair.  One equi-join serves all relations, so its size is that of the edges; nothing
    compares all lines with all lines.
    """
    ends = _edge_ends(files)
    source = ends.select("file_id", F.col("id").alias("src"), F.inline("sources"))
    target = ends.select("file_id", F.col("id").alias("dst"), F.inline("targets"))
    pairs = source.join(unfolded(target), ["file_id", "kind", "key"]).filter("src <> dst")
    return pairs.groupBy("file_id", "src", "dst").agg(
        *[F.max((F.col("kind") == slot).cast("int")).alias(slot) for slot in fixed.EDGE_SLOTS])


def edge_counts(files: DataFrame) -> DataFrame:
    """(file_id, num_edges) without listing the edges inside functions.

    A function of n lines has n (n - 1) ordered pairs; only pairs of other relations that cross functions are joined.
    """
    ends = _edge_ends(files)
    function = F.get(F.filter("sources", lambda e: e["kind"] == "ast_child"), 0)["key"]
    ends = ends.withColumn("function", F.coalesce(function, F.lit("")))

    def others(column, node, owner):
        kept = F.filter(column, lambda e: e["kind"] != "ast_child")
        return ends.select("file_id", F.col("id").alias(node), F.col("function").alias(owner), F.inline(kept))

    pairs = others("sources", "src", "src_function").join(
        unfolded(others("targets", "dst", "dst_function")), ["file_id", "kind", "key"])
    outside = (F.col("src_function") == "") | (F.col("src_function") != F.col("dst_function"))
    across = pairs.filter((F.col("src") != F.col("dst")) & outside).select("file_id", "src", "dst").distinct()
    within = ends.filter("function <> ''").groupBy("file_id", "function").agg(F.count("*").alias("n"))
    return across.groupBy("file_id").agg(F.count("*").alias("e")).unionByName(
        within.groupBy("file_id").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("e"))).groupBy("file_id").agg(F.sum("e").alias("num_edges"))


def graph_stats(files: DataFrame) -> DataFrame:
    """Nodes, edges, degree and densities of each file's graph."""
    nodes = file_graphs(files).select("file_id", F.size("nodes").cast("long").alias("num_nodes"))
    edges = edge_counts(files)
    n, e = F.col("num_nodes"), F.coalesce("num_edges", F.lit(0))

    def ratio(bottom):
        return F.coalesce(F.try_divide(e, bottom), F.lit(0.0))

    return nodes.join(unfolded(edges), "file_id", "left").select(
        "file_id", "num_nodes", e.alias("num_edges"), ratio(n).alias("edges_per_node"),
        ratio(n * (n - 1)).alias("density"), ratio(n * n).alias("square_density"))


def follows_edges(files: DataFrame) -> DataFrame:
    """Each node to the node on the next occupied line."""
    return file_graphs(files).select("file_id", F.inline(let(F.col("nodes"), _steps)))


def _definition_pairs(nodes: Column) -> Column:
    """(definition, use) of calls and returns: the latest earlier assignment of each name used."""
    assigned = F.filter(F.transform(
        F.filter(nodes, lambda n: n["type"] == "assignment"),
        lambda n: F.struct(n["id"].alias("id"), T.strip(F.substring_index(n["text"], "=", 1)).alias("name"))),
        lambda d: d["name"] != "")
    uses = F.filter(nodes, lambda n: n["type"].isin("function_call", "return"))

    def latest(known, u):
        names = F.array_distinct(F.transform(known, lambda d: d["name"]))
        return F.transform(names, lambda name: F.struct(
            F.array_max(F.transform(F.filter(known, lambda d: d["name"] == name), lambda d: d["id"])).alias("src"),
            u["id"].alias("dst")))

    def of_uses(definitions):
        return F.flatten(F.transform(uses, lambda u: let(
            F.filter(definitions, lambda d: (d["id"] < u["id"]) & F.contains(u["text"], d["name"])),
            lambda known: latest(known, u))))

    return F.array_distinct(let(assigned, of_uses))


def _steps(nodes: Column) -> Column:
    """(node, next node) for all but the last node."""
    return F.transform(
        F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0))),
        lambda n: F.struct(n["id"].alias("src"), (n["id"] + 1).alias("dst")))


def definition_edges(files: DataFrame, long_file: int = LONG_FILE) -> DataFrame:
    """(file_id, src, dst): each call or return and the latest earlier assignment of every name in it."""
    short = file_graphs(files.filter(~_is_long(long_file))).select("file_id", F.inline(let(F.col("nodes"), _definition_pairs)))
    long = _long_files(files, long_file)
    return short if long is None else short.unionByName(_definitions_by_name(long))


def _definitions_by_name(files: DataFrame) -> DataFrame:
    """The same for long files: names are looked up, and a name's last definition is carried on to its uses."""
    nodes = graph_nodes(files)
    defined = nodes.filter("type = 'assignment'").select("file_id", T.strip(F.substring_index("text", "=", 1)).alias("name"), F.col("id").alias("src"))
    defined = defined.filter("name <> ''")
    uses = nodes.filter(F.col("type").isin("function_call", "return")).select("file_id", "id", "text")
    used = names_in_lines(defined.select("file_id", "name"), uses).select("file_id", "name", F.col("id").alias("dst"))
    none = F.lit(None).cast("int")
    events = defined.select("file_id", "name", "src", none.alias("dst")).unionByName(used.select("file_id", "name", none.alias("src"), "dst"))
    # the places of one name in one file
    before = Window.partitionBy("file_id", "name").orderBy(F.coalesce("src", "dst")).rowsBetween(Window.unboundedPreceding, -1)
    found = events.select("file_id", F.max("src").over(before).alias("src"), "dst")
    return found.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def node_type_counts(files: DataFrame) -> DataFrame:
    return graph_nodes(files).groupBy("file_id", "type").agg(F.count("*").alias("count"))


#: Cells (nodes times sources) of the tables that one block of sources needs.
BLOCK_CELLS = 1 << 21

def _links(files: DataFrame, *keep: str) -> DataFrame:
    """Per file the line of each node and the ends of its step and definition links."""
    linked = let(F.col("nodes"), lambda nodes: let(
        F.array_union(_steps(nodes), _definition_pairs(nodes)),
        lambda links: F.struct(
            F.transform(nodes, lambda n: n["line"]).alias("lines"), F.transform(links, lambda l: l["src"]).alias("src"),
            F.transform(links, lambda l: l["dst"]).alias("dst"))))
    return file_graphs(files, *keep).select(*keep, linked.alias("g")).select(*keep, "g.*")


def _long_links(files: DataFrame) -> DataFrame:
    """``_links`` of long files, whose definition links are looked up rather than tested line by line."""
    defined = _definitions_by_name(files).groupBy("file_id").agg(F.collect_list(F.struct("src", "dst")).alias("found"))  # one file's
    steps = file_graphs(files).select("file_id", let(F.col("nodes"), lambda nodes: F.struct(
        F.transform(nodes, lambda n: n["line"]).alias("lines"), _steps(nodes).alias("steps"))).alias("g")).select("file_id", "g.*")
    none = F.array().cast("array<struct<src:int,dst:int>>")
    joined = steps.join(unfolded(defined), "file_id", "left").select(
        "file_id", "lines", F.array_union("steps", F.coalesce("found", none)).alias("links"))
    return joined.select("file_id", "lines", F.col("links.src").alias("src"), F.col("links.dst").alias("dst"))


def line_centrality(files: DataFrame, long_file: int = LONG_FILE, cells: int = BLOCK_CELLS) -> DataFrame:
    """(file_id, id, line, centrality): betweenness of every node that lies on some shortest path between two others.

    The sources of a long file are dealt to blocks, each worked on by a task of its own; the blocks' shares add up by
    node.  A file of n nodes and e links takes n (n + e) steps whatever the number of tasks, as the measure asks.
    """
    @F.pandas_udf("array<struct<id:int,line:int,share:double>>")
    def shares(lines: pd.Series, src: pd.Series, dst: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        def one(ls, a, b, first, last):
            n = len(ls)
            if n < 3:
                return []
            scale = (n - 1) * (n - 2)
            score = np.zeros(n)
            step = max(1, cells // n)
            preds = predecessors(n, a, b)
            for start in range(first, min(last, n), step):
                score += through_shares(preds, start, min(start + step, last, n))
            return [{"id": int(i), "line": int(ls[i]), "share": score[i] / scale} for i in np.flatnonzero(score)]
        return pd.Series([one(*row) for row in zip(lines, src, dst, low, high)])

    def of(part, dealt):
        linked = _long_links(part) if dealt else _links(part, "file_id")
        n = F.size("lines")
        if dealt:
            step = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.greatest(n, F.lit(1)))).cast("int")
            starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, step)).otherwise(F.array(F.lit(0)))
            blocks = linked.select("*", step.alias("step"), F.explode(starts).alias("low"))
            linked = blocks.withColumn("high", F.col("low") + F.col("step")).repartition("file_id", "low")
        else:
            linked = linked.select("*", F.lit(0).alias("low"), n.alias("high"))
        found = linked.select("file_id", F.inline(shares("lines", "src", "dst", "low", "high")))
        return found if not dealt else found.groupBy("file_id", "id").agg(F.min("line").alias("line"), F.sum("share").alias("share"))

    # a short file is settled inside its row, without a shuffle
    found, long = of(files.filter(~_is_long(long_file)), False), _long_files(files, long_file)
    if long is not None:
        found = found.unionByName(of(long, True))
    return found.select("file_id", "id", "line", F.col("share").alias("centrality"))


def central_lines(files: DataFrame, top: int = 5, over: float = 0.1) -> DataFrame:
    """The most central lines of each file's step-and-definition graph, at most ``top`` and all above ``over``."""
    order = Window.partitionBy("file_id").orderBy(F.desc("centrality"), "id")
    central = line_centrality(files).filter(F.col("centrality") > over)
    best = central.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return best.select("file_id", "line", "centrality")


def hot_lines(files: DataFrame, top: int = 5, over: float = 0.1) -> DataFrame:
    """(file_id, hot): per file the line numbers of its most central lines, in order."""
    central = central_lines(files, top, over)
    return central.groupBy("file_id").agg(F.array_sort(F.collect_set("line")).alias("hot"))


def predecessors(n: int, src, dst) -> list:
    """For each node the nodes that link to it; links lead forward, from a smaller number to a larger."""
    before = [[] for _ in range(n)]
    for a, b in zip(src, dst):
        if a >= b:
            raise ValueError(f"link from {a} back to {b}")
        before[b].append(int(a))
    return before


def through_shares(preds: list, low: int, high: int, kind=float) -> np.ndarray:
    """For each node the shares of shortest paths from the sources low to high that lead through it.

    As links lead forward, one pass over the nodes in order counts the paths from all sources of the block at once, and
    one pass back adds up the shares.  Counts beyond a float are taken as whole numbers of any size.
    """
    n, width = len(preds), high - low
    far = np.iinfo(np.int32).max - 1
    depth = np.full((n - low, width), far, np.int32)
    paths = np.zeros((n - low, width), kind)
    own = np.arange(width)
    depth[own, own], paths[own, own] = 0, 1
    before = [[u - low for u in preds[v] if u >= low] for v in range(low, n)]
    for v in range(1, n - low):
        for u in before[v]:
            reached = depth[u] + 1
            nearer, same = reached < depth[v], (reached == depth[v]) & (reached < far)
            with np.errstate(over="ignore"):
                paths[v] = np.where(nearer, paths[u], np.where(same, paths[v] + paths[u], paths[v]))
            depth[v] = np.where(nearer, reached, depth[v])
    if kind is float and not np.isfinite(paths).all():
        return through_shares(preds, low, high, object)
    share = np.zeros((n - low, width))
    for v in range(n - low - 1, 0, -1):
        for u in before[v]:
            on_path = (depth[u] + 1 == depth[v]) & (depth[v] < far)
            if on_path.any():
                share[u][on_path] += (paths[u][on_path] / paths[v][on_path]).astype(float) * (1.0 + share[v][on_path])
    share[own, own] = 0.0
    return np.concatenate([np.zeros(low), share.sum(axis=1)])


def risk_factors(code: Column) -> dict:
    def has(*words):
        return T.contains_any(code, words)
    indicators = T.words_present(code, fixed.INDICATOR_WORDS)
    factors = F.array_compact(F.array(
        F.when(has("malloc") & ~has("free"), "Memory leak potential"),
        F.when(has("strcpy", "gets"), "Buffer overflow risk"),
        F.when(has("system", "exec"), "Command injection risk"),
    ))
    return {
        "indicators": F.array_join(indicators, ","), "has_vulnerabilities": F.size(indicators) > 0,
        "factors": F.array_join(factors, ","), "complexity_score": T.line_count(code) / 10.0,
    }


def block_features(files: DataFrame) -> DataFrame:
    """Per block: kind, size, decision counts, dangerous calls and SQL verbs."""
    blocks = function_blocks(files, "file_id")
    code, first = F.col("code"), F.substring_index("code", "\n", 1)
    occupied = F.filter(T.split_lines(code), lambda l: ~T.is_blank(l))
    return blocks.select(
        "file_id", "start_line", T.contains_any(first, fixed.BLOCK_STARTS).alias("is_function"),
        F.size(occupied).alias("children"), F.col("line_count").alias("lines"), F.length(code).alias("chars"),
        (T.line_count(code) - 1).alias("newlines"),
        *[T.count_of(code, w).alias(f"n_{w.strip()}") for w in fixed.BLOCK_COUNT_WORDS],
        *[F.contains(code, F.lit(w)).alias(f"has_{w}") for w in ["eval", "exec", "system"]],
        F.contains(F.lower(code), F.lit("sql")).alias("has_sql"),
        *[F.contains(F.upper(code), F.lit(w)).alias(f"has_{w.lower()}") for w in fixed.SQL_WORDS],
    )
