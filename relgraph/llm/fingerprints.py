"""Document fingerprints: bottom-k sketches of hashed word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.llm import native

K = 256
SHINGLE = 5


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles; a shorter text is one shingle, no words are none."""
    n = F.size(words)
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < size, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), n - size),
                lambda i: F.xxhash64(*[words[i + k] for k in range(size)]),
            )
        )
    )


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending. Fewer than k: the whole set."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union, from the sketches of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _position(x: Column) -> Column:
    """Share of the 64-bit hashes up to x."""
    return (x.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    n = F.size(s)
    return F.when(n < k, n.cast("double")).otherwise(F.lit(float(k - 1)) / _position(s[k - 1]))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both hold.

    Two empty sets are alike (1), an empty and a filled one are not (0).
    """
    both = F.struct(merged(a, b, k).alias("all"), F.array_intersect(a, b).alias("shared"))
    return native.let(
        both,
        lambda x: F.when(F.size(x["all"]) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(x["all"], x["shared"])) / F.size(x["all"])
        ),
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    j = resemblance(a, b, k)
    shared = j * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(s: Column) -> Column:
    """Sixteen hex digits for each hash, ascending."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and sketch of every whole text; a null text counts as empty."""
    split = docs.select("doc_id", native.words(F.col("text")).alias("w"))
    return split.select("doc_id", sketch(shingle_hashes(F.col("w")), k).alias("sketch"))


def merged_fingerprints(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """Sketch of each key's union of parts (columns ``key`` and ``sketch``).

    Only the k smallest hashes of a part can be among the k smallest of the union, so the
    parts' sketches are unnested, made distinct and ranked; a hot key is first reduced in 64
    parts.
    """
    flat = parts.select(F.col(key).alias("key"), F.explode("sketch").alias("h")).distinct()
    part = Window.partitionBy("key", F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h")
    whole = Window.partitionBy("key").orderBy("h")
    ranked = flat.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    ranked = ranked.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    found = ranked.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    return found.select(F.col("key").alias(key), "sketch")


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above the value, by two short searches."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    up_to = lambda xs: F.size(F.filter(xs, lambda c: c <= value))
    block = F.greatest(up_to(longs(cuts[::step])) - 1, F.lit(0))
    return native.let(block, lambda b: b * step + up_to(F.slice(longs(cuts), b * step + 1, step)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text and the text of the next document in doc_id order; the last one's next is the first.

    The ids are cut into ranges at values that occur. Each row goes to the range it is in;
    the rows that begin a range go to the range before it as well, so each range sees its
    successor without a second pass, and no range holds more than its share of rows. Null
    ids come first; rows of one id follow each other by text.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"),
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    probs = [i / parts for i in range(1, parts)]
    spec = rows.agg(
        F.min("o").alias("first"),
        F.percentile_approx("o", probs, 100 * parts).alias("cuts") if probs else F.lit(None).alias("cuts"),
    ).first()
    cuts = sorted({c for c in (spec["cuts"] or []) if c > spec["first"]})
    home = _range_of(F.col("o"), cuts)
    starts = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    before = (
        F.when(F.col("o") == F.lit(spec["first"]), F.lit(len(cuts)))
        .when(F.array_contains(starts, F.col("o")), F.col("home") - 1)
    )
    # a row at a range's start is also the successor of the range before; the very first
    # row is the successor of the very last
    placed = rows.withColumn("home", home).withColumn(
        "at",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("home").alias("range"), F.lit(0).alias("copy")),
                    F.struct(before.alias("range"), F.lit(1).alias("copy")),
                ),
                lambda x: x["range"].isNotNull(),
            )
        ),
    )
    return placed.select("o", "doc_id", "text", "at.range", "at.copy").repartition(parts, "range")


def edited_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and its edited text, and how like they are.

    The edited text keeps all but the last floor(n/2) code points and goes on with the
    first as many of the next document (all of a shorter one). docs: doc_id, text; other
    columns are not read. Null texts count as empty; an only document is its own next;
    each of several rows with one doc_id gets a row; an empty table gives no rows.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = with_next(docs, parts)
    sketched = placed.withColumn("w", native.words(F.col("text"))).withColumn(
        "fp", sketch(shingle_hashes(F.col("w")), k)
    ).drop("w")
    order = Window.partitionBy("range").orderBy("copy", "o", "text")
    following = sketched.select(
        "doc_id", "text", "fp", "copy",
        F.lead("text").over(order).alias("next_text"),
        F.lead("fp").over(order).alias("next_fp"),
    ).where("copy = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = following.select(
        "doc_id", "fp", "next_fp",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    hashed = edited.withColumn("w", native.words(F.col("edited"))).select(
        "doc_id", "n_chars", "fp", "next_fp",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch(shingle_hashes(F.col("w")), k).alias("edited_fp"),
    )
    return hashed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        distinct_count(F.col("fp"), k).alias("n_shingles_estimate"),
        containment(F.col("fp"), F.col("edited_fp"), k).alias("contained_in_edited"),
    )
