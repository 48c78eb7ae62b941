"""SimHash fingerprints, with DataFrame operations only.

A text's terms are its word shingles; a term weighs as often as it occurs. Each term's
hash votes on every bit of the fingerprint, for 1 or against it, and the majority wins.
Votes are counted eight to a long: for blocks of up to 127 terms, the sums of the eight
masked shifts of a hash hold the ones of all its 64 bits; block sums are then added up.

hamming_links() finds all pairs of fingerprints within a radius r by permuted block
tables: of r + 2 blocks at least two are equal, so each pair of blocks is a table's key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 128
_SPACE = "' \\t\\n\\u000B\\f\\r'"
_ONES = "72340172838076673L"  # a one in each byte
_BLOCK = 127


def _terms(df: DataFrame, words: int) -> DataFrame:
    """A row for each term of __text: its hash (null for a text without words) and its block."""
    df = df.withColumn("__t", F.expr(f"trim(BOTH {_SPACE} FROM lower(__text))"))
    df = df.withColumn("__w", F.expr("transform(CASE WHEN __t = '' THEN cast(array() AS array<string>) ELSE split(__t, '[ \\\\t\\\\n\\\\u000B\\\\f\\\\r]+') END, w -> xxhash64(w))"))
    df = df.drop("__t", "__text").withColumn("__n", F.size("__w"))
    df = df.withColumn("__i", F.explode(F.expr(f"sequence(0, greatest(__n - {words}, 0))")))
    parts = ", ".join(f"__w[__i + {j}]" for j in range(words))
    h0 = F.expr(f"CASE WHEN __n >= {words} THEN xxhash64({parts}) WHEN __n > 0 THEN xxhash64(__w) END")
    return df.withColumn("__h0", h0).withColumn("__block", F.expr(f"__i div {_BLOCK}"))


def fingerprints(df: DataFrame, keys: list[str], text: Column, words: int = 5) -> DataFrame:
    """keys, fp0 and fp1 (the fingerprint's 64-bit halves) of each row; keys must tell the rows apart.

    A text of fewer words than a shingle is one term; one without words, or null, has
    fingerprint 0. Texts that are equal but for letter case and white space have equal ones.
    """
    names, keys = keys, [f"__k{i}" for i in range(len(keys))]  # whatever the caller calls them
    terms = _terms(df.select(*(F.col(f"`{n}`").alias(k) for n, k in zip(names, keys, strict=True)), F.coalesce(text, F.lit("")).alias("__text")), words)
    terms = terms.select(*keys, "__block", "__h0", F.when(F.col("__h0").isNotNull(), F.xxhash64("__h0")).alias("__h1"))
    sums = [F.sum(F.expr(f"shiftrightunsigned(__h{w}, {j}) & {_ONES}")).alias(f"__s{w}_{j}") for w in (0, 1) for j in range(8)]
    blocks = terms.groupBy(*keys, "__block").agg(F.count("__h0").alias("__n"), *sums)
    votes = [F.sum(F.expr(f"shiftrightunsigned(__s{b // 64}_{b % 8}, {b % 64 // 8 * 8}) & 255")).alias(f"__v{b}") for b in range(BITS)]
    counts = blocks.groupBy(*keys).agg(F.sum("__n").alias("__n"), *votes)

    def half(w: int) -> Column:
        bits = [F.expr(f"CASE WHEN 2 * __v{64 * w + b} > __n THEN shiftleft(1L, {b}) ELSE 0L END") for b in range(64)]
        while len(bits) > 1:
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    return counts.select(*(F.col(k).alias(n) for n, k in zip(names, keys, strict=True)), half(0).alias("fp0"), half(1).alias("fp1"))


def as_text(fp0: Column, fp1: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(fp0), 16, "0"), F.lpad(F.hex(fp1), 16, "0")))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of equal bits of two fingerprints."""
    return 1 - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / F.lit(float(BITS))


def hamming_links(prints: DataFrame, radius: int = 12) -> DataFrame:
    """(a0, a1, b0, b1, distance) of all pairs of different fingerprints (fp0, fp1) within radius bits.

    Equal fingerprints are one class; rows find theirs by fp0 and fp1. Null ones have none.
    """
    marks = prints.select("fp0", "fp1").where("fp0 is not null and fp1 is not null").distinct()
    count = radius + 2
    bounds = [BITS * i // count for i in range(count + 1)]

    def block(i: int) -> Column:
        lo, hi = bounds[i], bounds[i + 1]
        parts = []
        for w in (0, 1):
            a, b = max(lo, 64 * w) - 64 * w, min(hi, 64 * w + 64) - 64 * w
            if a < b:
                part = F.shiftrightunsigned(F.col(f"fp{w}"), a)
                parts.append(part.bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else part)
        return F.xxhash64(*parts) if len(parts) > 1 else parts[0]

    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(block(i), block(j)).alias("key")) for t, (i, j) in enumerate(combinations(range(count), 2))))
    rows = marks.select("fp0", "fp1", F.explode(tables).alias("x")).select("fp0", "fp1", F.col("x.t").alias("t"), F.col("x.key").alias("key"))
    a = rows.select("t", "key", F.col("fp0").alias("a0"), F.col("fp1").alias("a1"))
    b = rows.select("t", "key", F.col("fp0").alias("b0"), F.col("fp1").alias("b1"))
    far = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    pairs = a.join(b, ["t", "key"]).where("a0 < b0 or (a0 = b0 and a1 < b1)").withColumn("distance", far).where(F.col("distance") <= radius)
    return pairs.select("a0", "a1", "b0", "b1", "distance").distinct()


def _bucket(ids: DataFrame, per_bucket: int, most: int) -> Column:
    """An expression of column k that cuts its values into ranges of about per_bucket rows, most ranges at most."""
    rows = ids.agg(F.count("*")).first()[0]
    n = int(min(max(-(-rows // per_bucket), 1), most))
    if n == 1:
        return F.lit(0)
    shares = ",".join(str(i / n) for i in range(1, n))
    at = ids.agg(F.expr(f"percentile_approx(k, array({shares}), {max(10_000, 4 * n)})")).first()[0]
    bounds = sorted(set(at or []))
    if not bounds:
        return F.lit(0)
    # both lists are folded to constant arrays, so a row looks at about twice the root of the number of ranges
    wide = max(int(len(bounds) ** 0.5), 1)
    longs = lambda values: f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)"
    row = f"size(filter({longs(bounds[::wide])}, x -> x <= k))"
    inside = f"size(filter(slice({longs(bounds)}, (row - 1) * {wide} + 1, {wide}), x -> x <= k))"
    return F.expr(f"element_at(transform(array({row}), row -> CASE WHEN row = 0 THEN 0 ELSE (row - 1) * {wide} + {inside} END), 1)")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 100, most_buckets: int = 65536) -> DataFrame:
    """bucket, place, guest, id and text of each row, and next: the text of the next by descending id.

    After the last comes the first. Ids are cut into ranges (buckets) by quantiles; the first row
    of each range is also dealt, as a guest, to the range before it, so one shuffle by bucket
    brings every row and its next together. Rows of equal ids follow each other by a hash of the
    text; null ids come last; a null text is empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bucket = _bucket(rows.select("k"), per_bucket, most_buckets)
    rows = rows.withColumn("bucket", bucket)
    # at most most_buckets rows, so one task may order them and all may hold them
    heads = rows.groupBy("bucket").agg(F.max("k").alias("k"))
    order = Window.orderBy("bucket")
    heads = heads.select("k", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("host"))
    rows = rows.join(F.broadcast(heads), "k", "left")
    places = F.expr("CASE WHEN host IS NULL THEN array(named_struct('bucket', bucket, 'guest', false)) ELSE array(named_struct('bucket', bucket, 'guest', false), named_struct('bucket', host, 'guest', true)) END")
    rows = rows.select("id", "k", "text", F.explode(places).alias("p")).select("id", "k", "text", "p.bucket", "p.guest")
    near = Window.partitionBy("bucket").orderBy("guest", F.desc("k"), F.desc(F.xxhash64("text")))
    return rows.select("bucket", F.row_number().over(near).alias("place"), "guest", "id", "text", F.lead("text").over(near).alias("next"))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n, half = F.char_length("text"), F.expr("char_length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half.cast("int")))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    # fixed-width columns only, so that the terms are summed up by hash
    rows = rows.select("bucket", "place", "guest", "id", "n_chars", *(F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.when(~F.col("guest"), F.col("edited")).alias("body")))).alias("v"))
    rows = rows.select("*", "v.kind", "v.body").where("kind = 0 or not guest")
    keys = ["bucket", "place", "guest", "id", "n_chars", "sha0", "sha1", "sha2", "sha3", "kind"]
    prints = fingerprints(rows, keys, F.col("body"))
    own = [F.max(F.when(F.col("kind") == k, F.col(f"fp{w}"))).alias(f"{name}{w}") for k, name in ((0, "a"), (1, "e")) for w in (0, 1)]
    prints = prints.groupBy(*keys[:-1]).agg(*own)
    near = Window.partitionBy("bucket").orderBy("place")
    prints = prints.withColumn("n0", F.lead("a0").over(near)).withColumn("n1", F.lead("a1").over(near)).where(~F.col("guest"))
    c = F.col
    return prints.select(
        c("id").alias("doc_id"),
        "n_chars",
        F.lower(F.concat(*(F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)))).alias("edited_sha256"),
        as_text(c("a0"), c("a1")).alias("fingerprint"),
        as_text(c("e0"), c("e1")).alias("edited_fingerprint"),
        likeness(c("a0"), c("a1"), c("e0"), c("e1")).alias("near_edited"),
        likeness(c("a0"), c("a1"), c("n0"), c("n1")).alias("near_next"),
    )
