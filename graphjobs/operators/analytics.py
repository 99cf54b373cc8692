"""Queries on a graph: coverage, degrees, neighbours, shortest paths, evidence.

An undirected step visits a self loop once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C
from ..sources.scratch import broadcast_if_small, written
from .conflicts import _named


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, deg); a self loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("deg"))


def term_coverage(nodes: DataFrame, edges: DataFrame, terms=C.TERMS) -> DataFrame:
    """(term, present, degree, connected); the degree sums over nodes of that name."""
    spark = nodes.sparkSession
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    own = nodes.join(F.broadcast(listed), nodes["name"] == listed["term"])
    deg = own.join(degrees(edges), "node_id", "left").groupBy("term").agg(F.count("*").alias("n"), F.sum(F.coalesce("deg", F.lit(0))).alias("d"))
    out = listed.join(deg, "term", "left")
    d = F.coalesce("d", F.lit(0))
    return out.select("term", F.col("n").isNotNull().alias("present"), d.alias("degree"), (d > 0).alias("connected"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 10, label: str | None = None) -> DataFrame:
    if label:
        nodes = nodes.filter(F.array_contains("labels", label))
    out = nodes.join(degrees(edges), "node_id", "left").select("name", "labels", "node_id", F.coalesce("deg", F.lit(0)).alias("deg"))
    return out.orderBy(F.desc("deg"), "name", "node_id").limit(k).select("name", "labels", "deg")


def entity_neighbors(nodes: DataFrame, edges: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(name, direction, rel_type, other, labels) of the names' edges, `limit` for each
    name and direction, by relation, neighbour and id."""
    wanted = nodes.join(names.select("name").distinct(), "name", "left_semi").select(F.col("node_id").alias("own_id"), "name")
    other = nodes.select(F.col("node_id").alias("other_id"), F.col("name").alias("other"), "labels")

    def side(own: str, far: str, direction: str) -> DataFrame:
        rows = edges.join(wanted, edges[own] == wanted["own_id"]).withColumn("other_id", F.col(far)).join(other, "other_id")
        return rows.select("name", F.lit(direction).alias("direction"), "rel_type", "other", "labels", "edge_id")

    both = side("src_id", "dst_id", "out").union(side("dst_id", "src_id", "in"))
    order = Window.partitionBy("name", "direction").orderBy("rel_type", "other", "edge_id")
    return both.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n", "edge_id")


#: A step of a path: from a node to its neighbour by an edge.
_STEPS = "array<struct<at:string,to:string,via:string>>"


def _step(at: str, to: str, via: str) -> F.Column:
    return F.struct(F.col(at).alias("at"), F.col(to).alias("to"), F.col(via).alias("via"))


def _turned(steps: F.Column) -> F.Column:
    """The same way back."""
    return F.reverse(F.transform(steps, lambda s: F.struct(s["to"].alias("at"), s["at"].alias("to"), s["via"].alias("via"))))


def neighbor_steps(edges: DataFrame) -> DataFrame:
    """(at, to, via) for each node and different neighbour, by the least edge between them."""
    ends = edges.filter("src_id != dst_id").select("src_id", "dst_id", "edge_id")
    both = ends.union(ends.select("dst_id", "src_id", "edge_id")).toDF("at", "to", "via")
    return both.groupBy("at", "to").agg(F.min("via").alias("via"))


def _words_of(column: str, words: int) -> tuple[str, str]:
    """The 64-bit word, of so many, and the three of its bits that stand for a value."""
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64({column}), {at}) & 63 AS INT))" for at in (30, 40, 50))
    return f"(xxhash64({column}) & {words - 1})", f"({bits})"


def _perhaps_of(edges: DataFrame, side: str, nodes: DataFrame, n: int) -> DataFrame:
    """Edges whose end at `side` is one of n nodes (node_id), and few others: bits of the
    nodes' hashes are broadcast, so that Spark drops most edges where it reads them."""
    words = 1 << min(20, max(10, (n // 4).bit_length()))
    if n > 32 * words:  # most bits would be set
        return edges
    word, bits = _words_of("node_id", words)
    marks = nodes.select(F.expr(word).alias("_word"), F.expr(bits).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    word, bits = _words_of(side, words)
    return edges.join(F.broadcast(marks), F.expr(f"_word = {word} AND (_bits & {bits}) = {bits}"), "left_semi")


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that begin or end at one of nodes (node_id, distinct), each once."""
    n = nodes.count()
    own = {side: nodes.withColumnRenamed("node_id", side) for side in ("src_id", "dst_id")}
    at_src, at_dst = (_perhaps_of(edges, side, nodes, n).join(of, side, "left_semi") for side, of in own.items())
    return at_src.unionByName(at_dst.join(own["src_id"], "src_id", "left_anti"))


def surroundings(edges: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """The edges that a path of at most depth steps between two of ends (node_id) can hold.
    Each has an end that is at most (depth - 1) // 2 steps from one of them, whatever the
    graph holds beyond; only these edges are written and shuffled later on."""
    edges = edges.filter("src_id != dst_id").select("edge_id", "src_id", "dst_id", "type", "rel_type", "season")
    near = written(ends.select("node_id").distinct(), "path-near-0")
    for k in range((depth - 1) // 2):
        met = _touching(edges, near).select(F.explode(F.array("src_id", "dst_id")).alias("node_id"))
        near = written(near.union(met).distinct(), f"path-near-{k + 1}")
    return written(_touching(edges, near), "path-edges")


def peeled(steps: DataFrame, ends: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(core, hung): the graph without nodes that hang on one neighbour, and for each of
    ends (node_id) its anchor in the core with the steps that lead there.

    A node with one neighbour lies on no shortest path but those that begin or end there or
    in what hangs on it, so each round takes all such nodes away. Ends among them move to
    their neighbour and remember the step. Of two nodes that have only each other the lesser
    stays. Rounds stop early when nothing hangs any more.
    """
    core = steps
    hung = ends.select("node_id").distinct().select("node_id", F.col("node_id").alias("anchor"), F.lit(None).cast(_STEPS).alias("chain")).withColumn("chain", F.coalesce("chain", F.array().cast(_STEPS)))
    for k in range(rounds):
        single = core.groupBy("at").agg(F.count("*").alias("n"), F.min("to").alias("to"), F.min("via").alias("via")).filter("n = 1").drop("n")
        leaves = written(single, f"leaves-{k}")
        pairs = leaves.alias("a").join(leaves.alias("b"), (F.col("a.to") == F.col("b.at")) & (F.col("a.at") < F.col("a.to"))).select(F.col("a.at").alias("at"))
        leaves = written(leaves.join(pairs, "at", "left_anti"), f"hanging-{k}")
        if leaves.isEmpty():
            break
        moved = leaves.select(F.col("at").alias("anchor"), F.array(_step("at", "to", "via")).alias("_more"), F.col("to").alias("_next"))
        hung = hung.join(moved, "anchor", "left").select("node_id", F.coalesce("_next", "anchor").alias("anchor"), F.when(F.col("_next").isNull(), F.col("chain")).otherwise(F.concat("chain", "_more")).alias("chain"))
        gone = leaves.select("at")
        core = core.join(gone, "at", "left_anti").join(gone.withColumnRenamed("at", "to"), "to", "left_anti").select("at", "to", "via")
        core, hung = written(core, f"core-{k}"), written(hung, f"hung-{k}")
    return core, hung


def _balls(starts: DataFrame, core: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """Tables (start, node_id, path) of the nodes at 0, 1 ... depth steps of each start. A
    start is searched from once, whatever number of pairs it is in; of equally long paths
    the one by the least parent and edge stays."""
    level = written(starts.select(F.col("node_id").alias("start"), "node_id", F.array().cast(_STEPS).alias("path")), f"{name}-0")
    levels = [level]
    for d in range(1, depth + 1):
        near = _opened(level, core)
        for known in levels[-2:]:  # a neighbour of a level is in the level before, in this one or new
            near = near.join(known.select("start", "node_id"), ["start", "node_id"], "left_anti")
        level = written(near, f"{name}-{d}")
        levels.append(level)
    return levels


def _opened(level: DataFrame, core: DataFrame) -> DataFrame:
    """The neighbours of a level's nodes, each once for its start."""
    met = level.join(core, level["node_id"] == core["at"]).select("start", F.col("to").alias("node_id"), "at", "via", "path")
    last = F.struct("at", "via", "path")
    return met.groupBy("start", "node_id").agg(F.min(last).alias("p")).select("start", "node_id", F.concat("p.path", F.array(F.struct(F.col("p.at").alias("at"), F.col("node_id").alias("to"), F.col("p.via").alias("via")))).alias("path"))


def _core_paths(core: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(a, b, path) of the shortest path in the core, of at most depth steps, for each of
    pairs (a, b) of different nodes.

    Both ends are opened to half of the depth. The last level of the nearer half isn't kept:
    its nodes are held against the other side's at once, and only those that some end of
    the other side reaches are looked at.
    """
    ahead, back = depth - depth // 2, depth // 2
    far = _balls(pairs.select(F.col("b").alias("node_id")).distinct(), core, back, "path-back")
    near = _balls(pairs.select(F.col("a").alias("node_id")).distinct(), core, ahead - 1, "path-ahead")
    reached = None
    for d, level in enumerate(far):
        rows = level.select(F.col("start").alias("b"), "node_id", F.lit(d).alias("rest"), F.col("path").alias("back"))
        reached = rows if reached is None else reached.union(rows)
    nodes = written(reached.select("node_id").distinct(), "path-reached")
    last = _opened(near[-1], core.join(nodes.withColumnRenamed("node_id", "to"), "to", "left_semi"))
    found = None
    for d, level in enumerate([*near, last]):
        rows = level.join(pairs, level["start"] == pairs["a"]).select("a", "b", "node_id", F.lit(d).alias("steps"), "path")
        met = rows.join(reached, ["b", "node_id"]).select("a", "b", F.struct((F.col("steps") + F.col("rest")).alias("total"), "node_id", "steps", "path", "back").alias("m"))
        found = met if found is None else found.union(met)
    best = found.groupBy("a", "b").agg(F.min("m").alias("m"))
    return best.select("a", "b", F.concat("m.path", _turned(F.col("m.back"))).alias("path"))


def shortest_path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_depth: int = 4) -> DataFrame:
    """(pair_id, hop, source, relation, target, season): one undirected shortest path of
    at most max_depth edges for each of pairs (pair_id, src, dst), hop by hop.

    The graph is reduced first, to the edges around the ends; what hangs on one neighbour
    is taken away, and ends that hang move to where they hang. Ends in one hanging part meet there; the others are
    searched between their anchors, each different pair of anchors once and each anchor's
    surroundings once, so that a hub is not opened for every pair that hangs on it. Of
    equally long paths one is taken that does not depend on how rows lie. A pair of equal
    names has no path of edges and no rows.
    """
    ids = nodes.select("node_id", "name")
    named = pairs.select("pair_id", "src", "dst").filter("src != dst")
    own = named.join(ids, named["src"] == ids["name"]).select("pair_id", "dst", F.col("node_id").alias("a"))
    own = written(own.join(ids, own["dst"] == ids["name"]).select("pair_id", "a", F.col("node_id").alias("b")).distinct(), "path-pairs")
    ends = own.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    edges = surroundings(edges, ends, max_depth)
    core, hung = peeled(written(neighbor_steps(edges), "path-steps"), ends, max(1, max_depth // 2))
    for side in ("a", "b"):
        own = own.join(hung.select(F.col("node_id").alias(side), F.col("anchor").alias(f"{side}0"), F.col("chain").alias(f"chain_{side}")), side)

    def through(side: str) -> F.Column:
        return F.concat(F.array(side), F.transform(f"chain_{side}", lambda s: s["to"]))

    own = own.withColumns({"_na": through("a"), "_nb": through("b")}).withColumn("_at", F.get(F.array_intersect("_na", "_nb"), F.lit(0)))
    upto = lambda side: F.slice(f"chain_{side}", F.lit(1), F.array_position(f"_n{side}", F.col("_at")).cast("int") - 1)
    own = written(own.withColumn("path", F.when(F.col("_at").isNotNull(), F.concat(upto("a"), _turned(upto("b"))))).drop("_na", "_nb", "_at"), "path-hung")
    spent = F.size("chain_a") + F.size("chain_b")
    apart = own.filter(F.col("path").isNull() & (spent < max_depth))
    anchors = written(apart.select(F.col("a0").alias("a"), F.col("b0").alias("b")).distinct(), "path-anchors")
    depth = max_depth - (apart.agg(F.min(spent)).first()[0] or 0)
    between = _core_paths(core, anchors, depth).withColumnsRenamed({"a": "a0", "b": "b0", "path": "core_path"})
    whole = apart.drop("path").join(between, ["a0", "b0"]).select("pair_id", "a", "b", F.concat("chain_a", "core_path", _turned(F.col("chain_b"))).alias("path"))
    paths = own.filter("path is not null").select("pair_id", "a", "b", "path").union(whole).filter(F.size("path") <= max_depth)
    best = paths.groupBy("pair_id").agg(F.min(F.struct(F.size("path").alias("n"), "a", "b", "path")).alias("p"))
    hops = best.select("pair_id", F.posexplode("p.path").alias("hop", "s")).select("pair_id", (F.col("hop") + 1).alias("hop"), F.col("s.at").alias("from_id"), F.col("s.to").alias("to_id"), F.col("s.via").alias("via"))
    out = hops.join(edges.select(F.col("edge_id").alias("via"), "type", "rel_type", "season"), "via")
    out = out.join(ids.select(F.col("node_id").alias("from_id"), F.col("name").alias("source")), "from_id")
    out = out.join(ids.select(F.col("node_id").alias("to_id"), F.col("name").alias("target")), "to_id")
    return out.select("pair_id", "hop", "source", F.coalesce("type", "rel_type").alias("relation"), "target", F.coalesce("season", F.lit("")).alias("season"))


def _fits(season: F.Column, words: F.Column) -> F.Column:
    """Whether a row (n_name, m_name, raw, season) answers a request."""
    in_season = season.isNull() | F.coalesce(F.col("season") == season, F.lit(False)) | F.contains("m_name", season) | F.contains("n_name", season)
    held = F.exists(words, lambda w: F.contains(F.coalesce(F.col("raw"), F.lit("")), w) | F.contains(F.col("m_name"), w))
    return in_season & ((F.size(words) == 0) | held)


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    first = F.when(F.col("asked").isNotNull() & (F.col("season") == F.col("asked")), 0).otherwise(1)
    order = Window.partitionBy("request_id").orderBy(first, "relation", "target", "source", "season")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("request_id", "source", "relation", "target", "season", "rank")


def _edge_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _named(edges, nodes).select("source", "target", F.col("type").alias("raw"), F.coalesce("type", "rel_type").alias("relation"), "season")


def neighbor_query(nodes: DataFrame, edges: DataFrame, requests: DataFrame, limit: int = 30) -> DataFrame:
    """(request_id, source, relation, target, season, rank): the first `limit` distinct
    relations of each request's (request_id, focus, season, keywords) focus.

    Edges of the focus count if they are of the season (by their own or by a name) and
    hold a keyword in type or neighbour; those of the season come first. Equal requests
    are answered once, so that many questions about one hub read it once.
    """
    distinct = requests.select("focus", "season", "keywords").distinct()
    distinct = distinct.withColumn("request_id", F.sha2(F.to_json(F.struct("focus", "season", "keywords")), 256))
    rows = _edge_rows(nodes, edges)
    out = rows.withColumns({"n_name": F.col("source"), "m_name": F.col("target")})
    back = rows.filter("source != target").withColumns({"n_name": F.col("target"), "m_name": F.col("source")})
    asked = distinct.select("request_id", F.col("focus").alias("n_name"), F.col("season").alias("asked"), "keywords")
    found = out.union(back).join(asked, "n_name").filter(_fits(F.col("asked"), F.col("keywords")))
    found = found.select("request_id", "asked", "source", "relation", "target", F.coalesce("season", F.lit("")).alias("season")).distinct()
    return _back(requests, distinct, _ranked(found, limit))


#: The term that is in every text, for requests that ask for no season or no word.
_ANY = ""


def _grams(text: F.Column) -> F.Column:
    """The different characters and pairs of neighbouring characters of a text."""
    text = F.coalesce(text, F.lit(""))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    ones = F.transform(places, lambda i: F.substring(text, i, F.lit(1)))
    twos = F.transform(F.filter(places, lambda i: i < F.length(text)), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.concat(ones, twos))


def posted(rows: DataFrame, terms: DataFrame, texts: tuple[str, ...], name: str, whole: str | None = None) -> DataFrame:
    """Rows under each of the terms (term) that a text of theirs holds, as column `name`; the
    term '' is in every text. Where the column `whole` is the term, no text has to hold it.

    The rows' characters and pairs meet the terms' beginnings by an equal join, and what
    begins like a term is then looked at. Terms are distinct.
    """
    keys = F.array_distinct(F.concat(F.array(F.lit(_ANY)), *(_grams(F.col(t)) for t in texts)))
    holds = None
    for t in texts:
        one = F.contains(F.coalesce(F.col(t), F.lit("")), F.col("_term"))
        holds = one if holds is None else holds | one
    own = terms.select(F.col("term").alias("_term"), F.substring("term", 1, 2).alias("_key"))
    met = rows.withColumn("_key", F.explode(keys)).join(broadcast_if_small(own), "_key").filter(holds)
    if whole:
        equal = rows.join(broadcast_if_small(own.drop("_key")), F.col(whole) == F.col("_term")).filter(~holds)
        met = met.drop("_key").unionByName(equal)
    return met.select(*rows.columns, F.col("_term").alias(name))


def general_query(nodes: DataFrame, edges: DataFrame, requests: DataFrame, limit: int = 30) -> DataFrame:
    """The same over all directed edges for requests (request_id, season, keywords) without a
    focus.

    Edges are posted under the pairs of a season and a keyword that some request asks for.
    Of each list the first `limit` are kept, by the tasks before they are shuffled and then
    for all; a request's answer is the first of its keywords' lists, put together. An edge
    among a request's first stands among the first of each list that has it, so the lists'
    beginnings are enough.
    """
    distinct = requests.select("season", "keywords").distinct()
    distinct = written(distinct.withColumn("request_id", F.sha2(F.to_json(F.struct("season", "keywords")), 256)), "requests")
    # an empty keyword is in every text
    words = F.when((F.size("keywords") <= 0) | F.array_contains("keywords", ""), F.array(F.lit(_ANY))).otherwise(F.col("keywords"))
    words = F.array_distinct(F.filter(F.coalesce(words, F.array(F.lit(_ANY))), lambda w: w.isNotNull()))
    # an empty season asks for none
    season = F.when(F.col("season") != "", F.col("season"))
    asked = written(distinct.select("request_id", F.coalesce(season, F.lit(_ANY)).alias("_s"), season.alias("asked"), F.explode(words).alias("_w")), "asked")
    seasons, terms = (asked.select(F.col(c).alias("term")).distinct() for c in ("_s", "_w"))
    rows = _named(edges, nodes).select("edge_id", "source", "target", F.col("type").alias("raw"), F.coalesce("type", "rel_type").alias("relation"), F.coalesce("season", F.lit("")).alias("season"))
    lists = posted(posted(rows, seasons, ("source", "target"), "_s", "season"), terms, ("raw", "target"), "_w")
    lists = lists.join(broadcast_if_small(asked.select("_s", "_w").distinct()), ["_s", "_w"], "left_semi")
    first = F.when((F.col("_s") != _ANY) & (F.col("season") == F.col("_s")), 0).otherwise(1)
    order = (first, "relation", "target", "source", "season", "edge_id")
    kept = lists.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_w").orderBy(*order))).filter(F.col("_n") <= limit)
    found = asked.join(kept.drop("_n"), ["_s", "_w"]).select("request_id", "asked", "edge_id", "source", "relation", "target", "season").distinct()
    return _back(requests, distinct, _ranked(found, limit))


def _back(requests: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """Answers of distinct requests for each request that asked so."""
    keys = [c for c in distinct.columns if c != "request_id"]
    same = None
    for k in keys:
        one = requests[k].eqNullSafe(distinct[k])
        same = one if same is None else same & one
    links = requests.join(distinct.withColumnRenamed("request_id", "_asked"), same).select("request_id", "_asked")
    return links.join(found.withColumnRenamed("request_id", "_asked"), "_asked").select("request_id", "source", "relation", "target", "season", "rank")
