"""Candidate pairs by four channels: blocks, part numbers, lexical and embedding neighbours."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matlink.operators.graph import cut

BLOCK, LEXICAL, DENSE, PART_NUMBER = 1, 2, 4, 8
LETTERS = {"B": BLOCK, "L": LEXICAL, "D": DENSE, "M": PART_NUMBER}
BLOCK_ATTR = {"FASTENER": "thread", "MOTOR": "power_kw"}  # others: size_dn


def block_value(category: Column, attrs: Column) -> Column:
    """The attribute that blocks a category's items."""
    out = attrs["size_dn"]
    for name, attr in BLOCK_ATTR.items():
        out = F.when(category == name, attrs[attr]).otherwise(out)
    return out


def allowed(a_org: Column, b_org: Column, mode: str) -> Column:
    if mode not in ("CROSS", "WITHIN", "BOTH"):
        raise ValueError(f"unknown mode {mode}")
    return {"CROSS": a_org != b_org, "WITHIN": a_org == b_org, "BOTH": F.lit(True)}[mode]


def _self_pairs(rows: DataFrame, keys: list[str], mode: str) -> DataFrame:
    a = rows.select(*keys, F.col("id").alias("id_a"), F.col("org").alias("org_a"))
    b = rows.select(*keys, F.col("id").alias("id_b"), F.col("org").alias("org_b"))
    return a.join(b, keys).where((F.col("id_a") < F.col("id_b")) & allowed(F.col("org_a"), F.col("org_b"), mode)).select("id_a", "id_b")


def block_sizes(records: DataFrame) -> DataFrame:
    return records.where("category is not null and block is not null").groupBy("category", "block").agg(F.count("*").alias("size"))


def each(array: Column) -> Column:
    """explode(), in a step of its own.

    Spark's generated code holds all rows that it makes of a row before it hands on the first, so two arrays exploded in one piece of
    code are held as all their pairs. A lambda isn't generated code and ends the piece: what is held is one array's rows.
    """
    return F.explode(F.transform(array, lambda x: x))


def _chunks(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """rows with __chunk: which of a group's chunks of near `chunk` rows, by a hash of the id, each is in."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("__chunks"))
    return rows.join(sizes, keys).withColumn("__chunk", F.pmod(F.xxhash64("id"), F.col("__chunks"))).drop("__chunks")


def _met(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __own, __a, __b): __held of each two chunks of equal keys once, dealt over all tasks; __own is a chunk with itself."""
    spark = held.sparkSession
    a, b = (held.select(*keys, F.col("__chunk").alias(f"{s}_chunk"), F.col("__held").alias(s)) for s in ("__a", "__b"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    met = a.join(b, keys).where("__a_chunk <= __b_chunk")
    return met.select(*keys, (F.col("__a_chunk") == F.col("__b_chunk")).alias("__own"), "__a", "__b").repartition(parts)


def array_pairs(rows: DataFrame, keys: list[str], columns: list[str], chunk: int = 2000) -> DataFrame:
    """(keys, a, b): all pairs of rows of equal keys with a.id < b.id, as structs of columns (id among them).

    A group is cut to arrays of near `chunk` rows. Two arrays are a row, dealt over all tasks, and become
    pairs in the task that has it: what is shuffled is smaller than the pairs by about the arrays' size.
    """
    held = _chunks(rows, keys, chunk).groupBy(*keys, "__chunk").agg(F.collect_list(F.struct(*columns)).alias("__held"))
    one = _met(held, keys).select(*keys, "__own", "__b", each(F.col("__a")).alias("a"))
    a, b = F.col("a"), F.col("b")
    two = one.select(*keys, "__own", "a", F.explode("__b").alias("b")).where(~F.col("__own") | (a["id"] < b["id"]))
    back = a["id"] > b["id"]
    return two.select(*keys, F.when(back, b).otherwise(a).alias("a"), F.when(back, a).otherwise(b).alias("b"))


def block_pairs(records: DataFrame, mode: str = "CROSS", cap: int | None = None, chunk: int = 2000) -> DataFrame:
    """All pairs of a category and block; with a cap, only of blocks of at most cap records.

    As array_pairs(), but a chunk holds an array of ids for each org, so orgs are compared once for two arrays.
    """
    keys = ["category", "block"]
    rows = records.where("category is not null and block is not null").select(*keys, "id", "org")
    if cap is not None:
        rows = rows.join(block_sizes(records).where(F.col("size") <= cap).select(*keys), keys, "left_semi")
    held = _chunks(rows, keys, chunk).groupBy(*keys, "__chunk", "org").agg(F.collect_list("id").alias("ids"))
    held = held.groupBy(*keys, "__chunk").agg(F.collect_list(F.struct("org", "ids")).alias("__held"))
    one = _met(held, keys).select("__own", "__b", each(F.col("__a")).alias("a"))
    two = one.select("__own", "a", F.explode("__b").alias("b")).where(allowed(F.col("a.org"), F.col("b.org"), mode))
    first = two.select("__own", F.col("b.ids").alias("ids"), each(F.col("a.ids")).alias("a"))
    pairs = first.select("__own", "a", F.explode("ids").alias("b")).where("not __own or a < b")
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def unblocked(records: DataFrame, cap: int | None = 2000) -> DataFrame:
    """Records with a category that block_pairs() leaves out at this cap."""
    if cap is None:
        return records.where("category is not null and block is null")
    small = block_sizes(records).where(F.col("size") <= cap).select("category", "block")
    return records.where("category is not null").join(small, ["category", "block"], "left_anti")


def part_number_pairs(records: DataFrame, mode: str = "CROSS", cap: int = 200) -> DataFrame:
    """Pairs of the same maker and part number, for groups of 2 to cap; categories don't matter."""
    rows = records.select("id", "org", F.upper(F.trim("maker")).alias("maker"), F.upper(F.trim("mpn")).alias("mpn")).where("maker <> '' and mpn <> ''")
    groups = rows.groupBy("maker", "mpn").agg(F.count("*").alias("size")).where(F.col("size").between(2, cap)).select("maker", "mpn")
    return _self_pairs(rows.join(groups, ["maker", "mpn"]), ["maker", "mpn"], mode)


def bm25_scores(corpus: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, share: float = 0.25) -> DataFrame:
    """(category, query, id, score) of the records of corpus that share a token with a query.

    corpus and queries have category, id and tokens; an inverted index joins them by category
    and token. Tokens in more than half of a category's records weigh share of its mean idf. A row of corpus counts as
    often as its copies say, where it has that column.
    """
    copies = F.col("copies") if "copies" in corpus.columns else F.lit(1).cast("long").alias("copies")
    docs = corpus.select("category", "id", "tokens", F.size("tokens").alias("len"), copies)
    totals = docs.groupBy("category").agg(F.sum("copies").alias("n"), (F.sum(F.col("len") * F.col("copies")) / F.sum("copies")).alias("mean_len"))
    tf = docs.select("category", "id", "len", "copies", F.explode("tokens").alias("token")).groupBy("category", "id", "len", "copies", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("category", "token").agg(F.sum("copies").alias("df")).join(totals, "category")
    df = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy("category").agg(F.avg("raw").alias("mean_idf"))
    df = df.join(mean, "category").withColumn("idf", F.when(F.col("raw") < 0, share * F.col("mean_idf")).otherwise(F.col("raw")))
    q = queries.select("category", F.col("id").alias("query"), F.explode("tokens").alias("token")).groupBy("category", "query", "token").agg(F.count("*").alias("times"))
    index = tf.join(df.select("category", "token", "idf", "mean_len"), ["category", "token"])
    weight = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return q.join(index, ["category", "token"]).groupBy("category", "query", "id").agg(F.sum(weight).alias("score"))


def _lowest(records: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n lowest ids of each group; a group is cut by a hash first, so no task sorts a whole one."""
    parts = Window.partitionBy(*keys, F.pmod(F.xxhash64("other"), F.lit(64))).orderBy("other")
    few = records.withColumn("r", F.row_number().over(parts)).where(F.col("r") <= n)
    return few.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("other"))).where(F.col("r") <= n).drop("r")


def _unscored(q: DataFrame, d: DataFrame, k: int, mode: str) -> DataFrame:
    """(query, other) of ids low enough to fill up any query's k best, whatever it has a score with.

    A query that needs filling up has fewer than k others with a score and itself to pass over, so the lowest 2 k
    allowed ids are enough. With other orgs allowed: the lowest 2 k of each org, and of these the first 4 k, hold
    them, as at most 2 k of those are of the query's own org.
    """
    if mode == "WITHIN":
        pool = _lowest(d, ["category", "org"], 2 * k).withColumnRenamed("org", "query_org")
        return q.join(pool, ["category", "query_org"]).select("query", "other")
    pool = _lowest(_lowest(d, ["category", "org"], 2 * k), ["category"], 4 * k) if mode == "CROSS" else _lowest(d, ["category"], 2 * k)
    return q.join(pool, "category").where(allowed(F.col("query_org"), F.col("org"), mode)).select("query", "other")


def _text_classes(rows: DataFrame) -> DataFrame:
    """rows (category, id, org, tokens) with text: the smallest id of those of the category with the same tokens in any order."""
    keyed = rows.select("category", "id", "org", F.array_sort("tokens").alias("tokens")).withColumn("key", F.sha2(F.to_json("tokens"), 256))
    few = keyed.groupBy("category", "key").agg(F.min("id").alias("text"))
    return keyed.join(few, ["category", "key"]).drop("key")


def lexical_neighbours(corpus: DataFrame, queries: DataFrame, k: int = 200, mode: str = "CROSS", digits: int = 9) -> DataFrame:
    """(id_a, id_b, score, rank): each query's k best allowed records of its category.

    Records without a shared token score 0 and rank by id among the others. Texts of the same tokens have the same scores, so
    each two texts are scored once, and only a text's k + 1 lowest ids of an org can be among a query's k best. Only texts that
    share a token are met by the inverted index; of the others, the lowest ids of the category fill up (see _unscored).
    """
    d = cut(_text_classes(corpus))
    texts = d.groupBy("category", F.col("text").alias("id")).agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    q = cut(_text_classes(queries).withColumnRenamed("org", "query_org"))
    asked = q.groupBy("category", F.col("text").alias("id")).agg(F.first("tokens").alias("tokens"))
    scores = cut(bm25_scores(texts, asked).select("category", F.col("query").alias("asked"), F.col("id").alias("text"), F.round("score", digits).alias("score")))
    # queries of a text and an org ask the same, but for passing over themselves
    asks = q.groupBy("category", F.col("text").alias("asked"), "query_org").agg(F.min("id").alias("query"))
    lowest = _lowest(d.withColumnRenamed("id", "other"), ["category", "text", "org"], k + 1).select("category", "text", "org", "other")
    order = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "other"))
    pool = scores.join(lowest, ["category", "text"]).withColumn("r", order("category", "asked", "org")).where(F.col("r") <= k + 1).drop("r", "text")
    shared = asks.join(pool, ["category", "asked"]).where(allowed(F.col("query_org"), F.col("org"), mode)).select("query", "other", "score")
    rest = _unscored(asks.select("category", "query", "query_org"), d.select("category", F.col("id").alias("other"), "org"), k + 1, mode)
    rest = rest.join(asks.select("query", "category", "asked"), "query").join(d.select(F.col("id").alias("other"), "category", "text"), ["category", "other"])
    rest = rest.join(scores, ["category", "asked", "text"], "left").select("query", "other", F.coalesce("score", F.lit(0.0)).alias("score"))
    best = shared.unionByName(rest).distinct().withColumn("r", order("query")).where(F.col("r") <= k + 1).drop("r")
    of = q.join(asks, (q["category"] == asks["category"]) & (q["text"] == asks["asked"]) & q["query_org"].eqNullSafe(asks["query_org"])).select(q["id"].alias("id_a"), "query")
    pairs = of.join(best, "query").where("id_a <> other")
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id_a", F.col("other").alias("id_b"), "score", "rank")


def unit_vector(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / size)


def _best(queries: pa.Table, members: pa.Table, k: int, slack: float) -> pa.Table:
    """Of one chunk of queries and one of a cell's members: each query's k best, and what is within slack of the last."""
    ids, at = members["m_id"].to_numpy(), queries["id"].to_numpy()
    q, m = (np.stack(t[c].to_numpy()) if len(t) else np.zeros((0, 1)) for t, c in ((queries, "v"), (members, "m_v")))
    dots = q @ m.T if len(q) and len(m) else np.zeros((len(q), len(m)))
    dots[at[:, None] == ids[None, :]] = -np.inf
    n = min(k, len(ids))
    least = np.partition(dots, len(ids) - n, axis=1)[:, len(ids) - n] if n else np.zeros(len(at))
    least = np.maximum(least, queries["least"].to_numpy())
    i, j = np.nonzero((dots >= least[:, None] - slack) & (dots > -np.inf))
    return pa.table({"id_a": at[i], "id_b": ids[j], "dot": dots[i, j]})


def dense_neighbours(records: DataFrame, k: int = 20, digits: int = 5, cell: int = 2000, pivots: int = 64) -> DataFrame:
    """(id_a, id_b, score, rank): the k nearest records by cosine within a category (id, category, vector). Exact.

    A category's pivots (records of the lowest hashes, more of them for more records, `pivots` at most) divide it into
    cells of the records nearest to each. A first pass compares each record with a chunk of its own cell, which bounds
    the angle to its k-th neighbour. By the triangle inequality of angles, a cell whose widest member is farther from a
    record than that can't hold a neighbour; the record meets the chunks of all others. Chunks of `cell` records
    are multiplied as matrices, and only each record's best of a chunk become rows. Equal scores, after rounding,
    rank by id. Records without a category or a vector have no neighbours.
    """
    slack, key = 1.01 * 10.0**-digits, ["category", "cell", "chunk", "part"]
    rows = records.select("id", F.col("category").cast("string").alias("category"), unit_vector(F.col("vector")).alias("v"))
    rows = cut(rows.where("category is not null and v is not null"))
    sizes = rows.groupBy("category").agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy("category").orderBy(F.xxhash64("id"), "id"))
    few = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 20))).join(F.broadcast(sizes), "category")
    few = few.where(F.col("h") * F.col("n") <= F.lit(float(4 * pivots << 20)))  # some of the lowest hashes: near 4 x pivots of any number
    chosen = few.withColumn("r", order).where((F.col("r") <= pivots) & (F.col("r") <= F.ceil(F.col("n") / cell)))
    held = chosen.groupBy("category").agg(F.collect_list(F.struct(F.col("r").alias("cell"), "v")).alias("all"))  # at most `pivots` of each
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    angles = F.transform("all", lambda p: F.struct(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p["v"], F.col("v"))))).alias("angle"), p["cell"].alias("cell")))
    far = rows.join(held, "category").select("id", "category", "v", angles.alias("angles")).withColumn("own", F.array_min("angles"))
    far = cut(far.select("id", "category", "v", "angles", F.col("own.cell").alias("cell"), F.col("own.angle").alias("angle")))
    cells = cut(far.groupBy("category", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide")).withColumn("chunks", F.ceil(F.col("n") / cell).cast("int")))
    far = far.join(cells.select("category", "cell", "chunks"), ["category", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    members = far.select("id", "category", "v", "cell", "chunk")
    total = sizes.withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))  # queries of a chunk come in parts, too

    def met(queries: DataFrame, of: DataFrame) -> DataFrame:
        kind = "id_a long, id_b long, dot double"
        asked = queries.join(total.select("category", "parts"), "category").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")).select("id", "v", "least", *key)
        spread = of.join(total.select("category", "parts"), "category").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.select(*(F.col(c).alias(f"m_{c}") for c in ("id", "v", *key)))
        return asked.groupBy(*key).cogroup(spread.groupBy(*(f"m_{c}" for c in key))).applyInArrow(lambda a, b: _best(a, b, k, slack), kind)

    ranked = lambda found: found.withColumn("score", F.round("dot", digits)).withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))).where(F.col("rank") <= k)
    none = F.lit(-2.0)  # below any cosine
    first = cut(ranked(met(members.withColumn("least", none), members)))
    known = first.groupBy("id_a").agg(F.count("*").alias("n"), F.min("dot").alias("known")).where(F.col("n") == k).select(F.col("id_a").alias("id"), "known")
    bound = far.join(known, "id", "left").withColumn("least", F.coalesce("known", none))
    reach = F.acos(F.greatest(F.lit(-1.0), F.col("least") - slack)) + 1e-9
    todo = bound.select("id", "category", "v", "least", F.col("cell").alias("own"), F.col("chunk").alias("done"), reach.alias("reach"), F.explode("angles").alias("a"))
    todo = todo.select("id", "category", "v", "least", "own", "done", "reach", "a.angle", "a.cell").join(cells, ["category", "cell"])
    todo = todo.where((F.col("cell") == F.col("own")) | (F.col("angle") - F.col("wide") <= F.col("reach"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    todo = todo.where((F.col("cell") != F.col("own")) | (F.col("chunk") != F.col("done")))
    found = first.select("id_a", "id_b", "dot").unionByName(met(todo.select("id", "category", "v", "least", "cell", "chunk"), members))
    return ranked(found).select("id_a", "id_b", "score", "rank")


def merged(**channels: DataFrame) -> DataFrame:
    """Pairs of all channels (by letter) once, the smaller id first, with the channels as a bit mask."""
    parts = [df.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.lit(LETTERS[letter]).alias("bit")) for letter, df in channels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("id_a <> id_b").groupBy("id_a", "id_b").agg(F.bit_or("bit").alias("channels"))


def channel_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*(F.count_if(F.col("channels").bitwiseAND(bit) > 0).alias(letter) for letter, bit in LETTERS.items()))
