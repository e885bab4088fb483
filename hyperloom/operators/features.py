"""Graphs from numeric tables: events, samples, pixels, embeddings; and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entropy
from ..model import sorted_set
from . import neighbours as nearby


def temporal_edges(rows: DataFrame, key: str, order: list[str], member: Column, information: Column | None = None, prefix: str = "ev", predicate: str = "temporal") -> DataFrame:
    """Edges over the neighbours [i - 1, i + 1] of each row but the last of its key; two members at least.

    edge_id, nodes, I_value, key, i. Information is 0.6 + (i mod 4) / 10 unless given.
    """
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumn("__m", member).withColumn("i", F.row_number().over(w) - 1)
    r = r.withColumn("__near", F.collect_list("__m").over(w.rowsBetween(-1, 1))).withColumn("__next", F.lead("__m").over(w))
    r = r.filter(F.col("__next").isNotNull()).withColumn("nodes", sorted_set("__near")).filter(F.size("nodes") >= 2)
    value = information if information is not None else F.lit(0.6) + (F.col("i") % 4) * F.lit(0.1)
    return r.select(F.concat_ws(":", F.lit(prefix), F.col(key).cast("string"), F.col("i").cast("string")).alias("edge_id"), "nodes", value.alias("I_value"), F.lit(predicate).alias("predicate"), F.col(key), "i")


def window_features(samples: DataFrame, size: int = 1024, least: int = 32, most: int | None = 512) -> DataFrame:
    """samples(series, pos, value) -> series, win, n, energy, zcr, feat of fixed windows.

    A window of fewer than ``least`` samples is left out, and so is what follows ``most`` windows (None: nothing).
    """
    s = samples.withColumn("win", F.floor(F.col("pos") / size))
    if most is not None:
        s = s.filter(F.col("win") < most)
    before = F.lag("value").over(Window.partitionBy("series", "win").orderBy("pos"))
    s = s.withColumn("__cross", F.when(before * F.col("value") < 0, 1).otherwise(0))
    v = F.col("value").cast("double")
    g = s.groupBy("series", "win").agg(F.count("*").alias("n"), F.avg(v * v).alias("energy"), (F.sum("__cross") / F.count("*")).alias("zcr")).filter(F.col("n") >= least)
    return g.withColumn("feat", feature_hash(F.col("energy")))


def feature_hash(energy: Column) -> Column:
    return (F.floor(energy * 1000) % 65536).cast("long")


def patches(pixels: DataFrame, size: int = 16) -> DataFrame:
    """pixels(x, y, r, g, b) -> px, py, mean colours, packed colour and its hex text."""
    g = pixels.groupBy(F.floor(F.col("x") / size).alias("px"), F.floor(F.col("y") / size).alias("py"))
    g = g.agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    packed = F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))
    return g.withColumn("packed", packed).withColumn("color", F.lower(F.lpad(F.hex("packed"), 6, "0")))


#: Neighbours of a cell, in the order in which they are taken.
OFFSETS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1)]


def grid_edges(cells: DataFrame, most: int = 4, by: tuple[str, ...] = (), sep: str = ":") -> DataFrame:
    """cells(px, py) -> px, py, nodes: each cell with its first ``most`` neighbours, if it has two (in each grid of the columns ``by``)."""
    near = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(OFFSETS)]))
    name = lambda x, y: F.concat(F.lit("patch:"), x.cast("string"), F.lit(sep), y.cast("string"))
    a = cells.select(*by, "px", "py", near.alias("o")).select(*by, "px", "py", "o.k", (F.col("px") + F.col("o.dx")).alias("qx"), (F.col("py") + F.col("o.dy")).alias("qy"))
    hits = a.join(cells.select(*by, F.col("px").alias("qx"), F.col("py").alias("qy")), [*by, "qx", "qy"])
    g = hits.groupBy(*by, "px", "py").agg(F.array_sort(F.collect_list(F.struct("k", name(F.col("qx"), F.col("qy")).alias("n")))).alias("near")).filter("size(near) >= 2")
    members = F.concat(F.transform(F.slice("near", 1, most), lambda s: s["n"]), F.array(name(F.col("px"), F.col("py"))))
    return g.select(*by, "px", "py", F.array_sort(members).alias("nodes"))


def paint(cells: DataFrame, size: int = 16, width: int = 256, height: int = 256) -> DataFrame:
    """cells(px, py, color hex) -> x, y, r, g, b of every pixel inside; bad colours are grey."""
    ok = F.col("color").rlike("^[0-9a-fA-F]{6}$")
    part = lambda k: F.when(ok, F.conv(F.substring("color", k, 2), 16, 10).cast("int")).otherwise(128)
    p = cells.select("px", "py", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("k"))
    p = p.select((F.col("px") * size + F.col("k") % size).alias("x"), (F.col("py") * size + F.floor(F.col("k") / size)).alias("y"), "r", "g", "b")
    return p.filter((F.col("x") < width) & (F.col("y") < height))


def cells_of(nodes: DataFrame, size: int = 16, prefix: str = "patch:") -> DataFrame:
    """x0, y0, color of the nodes that are patches, by their id's prefix and their attributes (JSON texts)."""
    value = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.col("attributes")[k], F.lit("}")), "$.v")
    n = nodes.filter(F.col("node_id").startswith(prefix))
    place = lambda k: F.coalesce(value(k).cast("int"), F.lit(0))
    return n.select("node_id", place("x0").alias("x0"), place("y0").alias("y0"), F.coalesce(value("avg_color"), F.lit("000000")).alias("color"))


def paint_nodes(nodes: DataFrame, size: int = 16, width: int = 256, height: int = 256) -> DataFrame:
    """nodes -> x, y, r, g, b of the pixels that patches cover; of patches that overlap, the last id counts."""
    c = cells_of(nodes, size)
    at = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("k")
    ok = F.col("color").rlike("^[0-9a-fA-F]{6}$")
    part = lambda k: F.when(ok, F.conv(F.substring("color", k, 2), 16, 10).cast("int")).otherwise(128)
    p = c.select("node_id", "x0", "y0", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), at)
    p = p.select("node_id", (F.col("x0") + F.col("k") % size).alias("x"), (F.col("y0") + F.floor(F.col("k") / size)).alias("y"), "r", "g", "b")
    p = p.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return p.groupBy("x", "y").agg(F.max_by(F.struct("r", "g", "b"), "node_id").alias("c")).select("x", "y", "c.*")


def neighbours(vectors: DataFrame, k: int = 4, threshold: float = 0.0, centres: int = nearby.CENTRES) -> DataFrame:
    """vectors(id, v double array) -> i, j, sim, rank: the k most similar others by cosine, ties to the smaller id; from ``threshold`` on, if that is above 0."""
    best = nearby.nearest(vectors, k, centres)
    return best.filter(F.col("sim") >= threshold) if threshold > 0 else best


def similarity_edges(near: DataFrame, prefix: str = "sim") -> DataFrame:
    """An edge for each row with its neighbours; information is the mean similarity on [0, 1]."""
    g = near.groupBy("i").agg(F.sort_array(F.collect_list(F.col("j").cast("string"))).alias("m"), F.avg("sim").alias("mean"))
    nodes = sorted_set(F.concat(F.array(F.col("i").cast("string")), F.col("m")))
    return g.select(F.concat_ws(":", F.lit(prefix), F.col("i").cast("string")).alias("edge_id"), nodes.alias("nodes"), entropy.information(F.col("mean")).alias("I_value"))


def fidelity(nodes: DataFrame, edges: DataFrame, kinds: list[str], original: int) -> DataFrame:
    """retention of typed nodes, mean information, and their product to four digits."""
    kept = nodes.filter(F.col("attributes")["type"].isin(kinds)).agg(F.count("*").alias("kept"))
    mean = edges.agg(F.coalesce(F.avg("I_value"), F.lit(0.0)).alias("mean_information"))
    r = kept.join(mean)  # one row each
    return r.withColumn("retention", F.col("kept") / F.lit(float(max(1, original)))).withColumn("fidelity", F.round(F.col("retention") * F.col("mean_information"), 4))


def grid_place(index: Column, side: int, total: int) -> tuple[Column, Column]:
    """Column and row of a patch; a number of patches that is no square is one row."""
    return (F.pmod(index, F.lit(side)), F.floor(index / side)) if side * side == total else (index, F.lit(0))


def head_average(weights: DataFrame) -> DataFrame:
    """weights(i, j, head, w) -> i, j, sim: attention averaged over heads."""
    return weights.groupBy("i", "j").agg(F.avg("w").alias("sim"))


def _pick(seed: int, what: str, n: Column | int) -> Column:
    """A number below n by the MD5 of (id, what, seed): reruns and other engines agree."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(what), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(n) if isinstance(n, int) else n)


def random_triples(spark: SparkSession, entities: int = 500, relations: int = 20, triples: int = 2000, seed: int = 42) -> DataFrame:
    """id, s, p, o drawn evenly."""
    r = spark.range(triples)
    name = lambda p, n, k: F.concat(F.lit(p), _pick(seed, k, n).cast("string"))
    return r.select("id", name("e", entities, "s").alias("s"), name("r", relations, "p").alias("p"), name("e", entities, "o").alias("o"))


# Entity types, and relations (subject's type, object's type, name)
TYPES = ["Person", "Organization", "Location", "Event", "Product", "CreativeWork", "Periodical"]
RELATIONS = [
    ("Person", "Location", "bornIn"),
    ("Person", "Person", "knows"),
    ("Person", "Organization", "worksFor"),
    ("Person", "CreativeWork", "authored"),
    ("Organization", "Location", "headquarteredIn"),
    ("Organization", "Person", "employs"),
    ("Organization", "Organization", "subsidiaryOf"),
    ("Location", "Location", "borders"),
    ("Location", "Person", "capitalOf"),
    ("Event", "Location", "takesPlaceIn"),
    ("Event", "Person", "hasParticipant"),
    ("Product", "Organization", "manufacturedBy"),
    ("Product", "Periodical", "reviewedIn"),
    ("CreativeWork", "Person", "creator"),
    ("CreativeWork", "Periodical", "publishedIn"),
]


def relations(spark: SparkSession, n: int = 20, seed: int = 42) -> DataFrame:
    """id, domain, range, p: the named relations, padded to ``n`` by others between types drawn evenly."""
    named = spark.createDataFrame([(k, *x) for k, x in enumerate(RELATIONS[:n])], "id long, domain string, range string, p string")
    kind = lambda what: F.element_at(F.array(*map(F.lit, TYPES)), (_pick(seed, what, len(TYPES)) + 1).cast("int"))
    more = spark.range(len(RELATIONS), max(n, len(RELATIONS)))
    return named.union(more.select("id", kind("domain"), kind("range"), F.format_string("rel:%03d", "id")))


def entity_types(spark: SparkSession, entities: int = 500, seed: int = 42) -> DataFrame:
    """id, entity, type: one or two types for each entity."""
    e = spark.range(entities)
    one = _pick(seed, "type", len(TYPES))
    two = (one + 1 + _pick(seed, "other", len(TYPES) - 1)) % len(TYPES)
    both = F.when(_pick(seed, "types", 2) == 1, F.array(one, two)).otherwise(F.array(one))
    kinds = F.transform(both, lambda k: F.element_at(F.array(*map(F.lit, TYPES)), (k + 1).cast("int")))
    return e.select("id", F.format_string("ent:%04d", "id").alias("entity"), F.explode(kinds).alias("type"))


def semantic_triples(spark: SparkSession, entities: int = 500, relation_count: int = 20, triples: int = 2000, seed: int = 42) -> DataFrame:
    """id, s, p, o: a relation drawn evenly, then a subject and an object of its types.

    Entities are numbered within their type, and joined by (type, number); a
    type that no entity has takes any entity.
    """
    e = entity_types(spark, entities, seed)
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("id")) - 1)
    have = e.groupBy("type").agg(F.count("*").alias("have"))
    rel = relations(spark, relation_count, seed).withColumnRenamed("id", "r")
    t = spark.range(triples).withColumn("r", _pick(seed, "relation", relation_count)).join(rel, "r")
    for side, kind in (("s", "domain"), ("o", "range")):
        size = have.select(F.col("type").alias(kind), F.col("have").alias("size"))
        own = e.select(F.col("type").alias(kind), "n", F.col("entity").alias("own"))
        t = t.join(size, kind, "left").withColumn("n", _pick(seed, side, F.coalesce("size", F.lit(1)))).join(own, [kind, "n"], "left")
        t = t.withColumn(side, F.coalesce("own", F.format_string("ent:%04d", _pick(seed, side, entities)))).drop("size", "n", "own")
    return t.select("id", "s", "p", "o")


# The patterns of the evolving graphs (predicate, members, attribute types)
PATTERNS = [
    ("Person_bornIn_Location", 2, ["age", "pop"]),
    ("Person_worksFor_Organization", 2, ["salary", "size"]),
    ("Organization_headquarteredIn_Location", 2, ["revenue"]),
    ("Person_knows_Person", 2, []),
    ("Event_takesPlaceIn_Location", 2, ["date"]),
    ("Product_manufacturedBy_Organization", 2, ["price"]),
    ("CreativeWork_authoredBy_Person", 2, ["year"]),
    ("Location_borders_Location", 2, []),
    ("Person_employs_Person", 3, ["role"]),
    ("Organization_subsidiaryOf_Organization", 3, []),
]


def evolving_edges(spark: SparkSession, rounds: int = 5, graphs: int = 3, edges: int = 200, nodes: int = 100, rate: float = 0.3, seed: int = 42) -> DataFrame:
    """round, graph, pos, edge_id, nodes, predicate, I_value, attr_types: ``graphs`` graphs a round; from the second
    round on, a round adds a pattern of its own with probability ``rate``, and all patterns take turns in a graph's edges."""
    draw = spark.range(rounds).select(F.col("id"), (_pick(seed, "evolve", 1000) < int(rate * 1000)).alias("new"), (2 + _pick(seed, "arity", 2)).cast("int").alias("arity")).filter("new and id > 0")
    base = spark.createDataFrame([(0, k, *x) for k, x in enumerate(PATTERNS)], "since int, k long, predicate string, arity int, attr_types array<string>")
    late = draw.select(F.col("id").cast("int").alias("since"), (F.lit(len(PATTERNS)) + F.col("id")).alias("k"), F.format_string("new_rel:%d", "id").alias("predicate"), "arity", F.array().cast("array<string>").alias("attr_types"))
    pats = base.union(late)
    active = spark.range(rounds).select(F.col("id").cast("int").alias("round")).join(pats, F.col("since") <= F.col("round"))
    active = active.withColumn("turn", F.row_number().over(Window.partitionBy("round").orderBy("k")) - 1).withColumn("turns", F.count("*").over(Window.partitionBy("round")))
    r = spark.range(rounds * graphs * edges).withColumn("g", F.floor(F.col("id") / edges).cast("int")).withColumn("round", F.floor(F.col("g") / graphs).cast("int")).withColumn("e", F.col("id") % edges)
    e = r.join(active, (r["round"] == active["round"]) & (r["e"] % active["turns"] == active["turn"])).drop(active["round"])
    graph = F.format_string("r%dg%d", "round", F.col("g") % graphs)
    first = _pick(seed, "a", nodes)
    members = F.transform(F.sequence(F.lit(0), F.col("arity") - 1), lambda j: F.format_string("%s_n%d", graph, (first + j * (1 + _pick(seed, "b", max(1, nodes // 3 - 1)))) % nodes))
    info = F.lit(0.5) + _pick(seed, "info", 5001) / F.lit(10000.0)
    return e.select("round", graph.alias("graph"), F.col("id").alias("pos"), F.format_string("%s_e%d", graph, F.col("e")).alias("edge_id"), sorted_set(members).alias("nodes"), "predicate", F.round(info, 4).alias("I_value"), F.array_sort("attr_types").alias("attr_types"))
